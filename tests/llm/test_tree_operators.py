"""K-d tree shards, Merkle manifests and importance resampling against brute force on small tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tempestry.llm import kd_shards, merkle, resample
from tempestry.llm.common import numbered, stored

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, row string, place int, hash string, node int"


def table(spark, rows):
    """Rows (doc_id, text, lang, source), with columns of names that the operators use themselves."""
    given = [(i, t, lang, s, None if t is None else len(t), "x", 7, "h", 3) for i, t, lang, s in rows]
    return spark.createDataFrame(given, DOCS)


def some_rows(rng, n, hot=0.0):
    texts = ["same text"] + ["".join(rng.choices("ab é\n", k=rng.randint(0, 60))) for _ in range(n)]
    rows = []
    for i in range(n):
        if rng.random() < hot:
            rows.append((5, texts[0], "en", "hot"))
        else:
            rows.append((i * 3 % 1009, rng.choice([None, "", *texts]), rng.choice([None, "en", "de"]), rng.choice([None, "", "a", "b", "é"])))
    return rows


# Numbering


def test_numbered_counts_within_keys(spark):
    rng = random.Random(1)
    rows = [(rng.choice([None, "a", "b"]) if rng.random() < 0.5 else "hot", rng.randint(0, 9)) for _ in range(500)]
    df = stored(spark.createDataFrame(rows, "k string, v int").withColumn("row", F.monotonically_increasing_id()), "t")
    got = numbered(df, ["k"], ["v", "row"], "n").collect()
    sizes = Counter(k for k, _ in rows)
    by_key = defaultdict(list)
    for r in got:
        assert r.total == sizes[r.k]
        by_key[r.k].append((r.place, r.v, r.row))
    for found in by_key.values():
        found.sort()
        assert [p for p, _, _ in found] == list(range(len(found)))
        assert [x[1:] for x in found] == sorted(x[1:] for x in found)
    firsts = {r.k: r.first for r in got}
    assert firsts[None] < firsts["a"] < firsts["b"] < firsts["hot"]
    assert numbered(df.limit(0), ["k"], ["v"], "n").count() == 0


# K-d tree


def plain_shards(rows, shards):
    """Shard of each row (doc_id, text, lang, source): the same tree on sorted lists."""

    def start(text):
        return float(int.from_bytes((text or "").encode()[:6].ljust(6, b"\0"), "big"))

    def dims(row):
        i, t, lang, s = row
        return (float(i or 0), float(len(t or "")), start(s), start(lang))

    facts = []
    for place, row in enumerate(rows):
        tie = int(hashlib.md5(("" if row[0] is None else str(row[0])).encode()).hexdigest()[:13], 16)
        facts.append((dims(row), tie, place, len((row[1] or "").encode()) + 1))
    spans = [max(f[0][d] for f in facts) - min(f[0][d] for f in facts) for d in range(4)]
    out = {}

    def split(own, count, first):
        if count == 1 or not own:
            for f in own:
                out[f[2]] = first
            return
        shares = []
        for d in range(4):
            values = [f[0][d] for f in own]
            shares.append((max(values) - min(values)) / spans[d] if spans[d] else 0.0)
        d = shares.index(max(shares))
        own = sorted(own, key=lambda f: (f[0][d], f[1], f[2]))
        total, upto, left = sum(f[3] for f in own), 0, []
        for f in own:
            if (2 * upto + f[3]) * count > 2 * total * (count // 2):
                break
            left.append(f)
            upto += f[3]
        split(left, count // 2, first)
        split(own[len(left) :], count - count // 2, first + count // 2)

    split(facts, shards, 0)
    return out


@pytest.mark.parametrize("shards,hot,bins", [(16, 0.0, 1 << 15), (7, 0.4, 64), (1, 0.2, 64)])
def test_kd_shards_equal_brute_force(spark, monkeypatch, shards, hot, bins):
    monkeypatch.setattr(kd_shards, "BINS", bins)
    rows = some_rows(random.Random(shards), 300, hot)
    got = kd_shards.kd_shards(table(spark, rows).coalesce(1), shards=shards).collect()
    want = plain_shards(rows, shards)
    expected = Counter(
        (i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), want[place]) for place, (i, t, _, _) in enumerate(rows)
    )
    assert Counter((r.doc_id, r.size, r.text_crc32, r.shard) for r in got) == expected
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append((r.slot, r.doc_id))
    for found in slots.values():
        found.sort()
        assert [s for s, _ in found] == list(range(len(found))) and [i for _, i in found] == sorted(i for _, i in found)


def test_kd_shards_are_even_whatever_is_hot(spark):
    """A third of the rows have one id, another third no id, and all of them one text and source."""
    rows = [(5, "t" * 50, "en", "s")] * 400 + [(None, "t" * 50, "en", "s")] * 400 + [(i, "u" * 50, "de", "s") for i in range(400)]
    sizes = Counter()
    for r in kd_shards.kd_shards(table(spark, rows), target_bytes=51 * 75).collect():
        sizes[r.shard] += 1
    assert sorted(sizes) == list(range(16)) and max(sizes.values()) - min(sizes.values()) <= 2


def test_kd_shards_of_odd_tables(spark):
    assert kd_shards.kd_shards(table(spark, []), shards=4).count() == 0
    assert kd_shards.kd_shards(table(spark, []), target_bytes=4).count() == 0
    few = kd_shards.kd_shards(table(spark, [(1, None, None, None), (2, "x" * 100_000, "en", "a")]), shards=8).collect()
    assert sorted((r.doc_id, r.size, r.slot) for r in few) == [(1, 1, 0), (2, 100_001, 0)] and len({r.shard for r in few}) == 2
    odd = spark.createDataFrame([("a", "x", float("nan")), ("b", "y", float("inf")), (None, None, None)], "id string, t string, q double")
    got = kd_shards.kd_shards(odd, ["q", "id"], shards=3, id_col="id", text_col="t").collect()
    assert sorted(r.shard for r in got) == [0, 1, 2]
    with pytest.raises(ValueError):
        kd_shards.kd_shards(odd)


# Merkle manifest


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(row, text=None):
    i, t, lang, s = row
    values = (i, s, lang, None if t is None else len(t), t if text is None else text)
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_tree(leaves):
    """(root, siblings left and right of each leaf, level by level)."""
    nodes, of, paths = list(leaves), list(range(len(leaves))), [[] for _ in leaves]
    while len(nodes) > 1:
        for path, at in zip(paths, of):
            run = at // 16 * 16
            path.append(("".join(nodes[run:at]), "".join(nodes[at + 1 : run + 16])))
        nodes = [sha("".join(nodes[i : i + 16])) for i in range(0, len(nodes), 16)]
        of = [at // 16 for at in of]
    return nodes[0], paths


def plain_manifest(rows):
    sources = defaultdict(list)
    for row in rows:
        sources[row[3]].append((row[0] is not None, row[0] or 0, plain_leaf(row), row))
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = [plain_tree([leaf for _, _, leaf, _ in sorted(sources[s], key=lambda x: x[:3])]) for s in names]
    root, tops = plain_tree([tree[0] for tree in trees])
    out = []
    for name, (subroot, paths), top in zip(names, trees, tops):
        for (_, _, leaf, row), path in zip(sorted(sources[name], key=lambda x: x[:3]), paths):
            node = leaf
            if zlib.crc32(("" if row[0] is None else str(row[0])).encode()) % 5 == 0 and row[1] is not None:
                node = plain_leaf(row, row[1].translate({c: c + 32 for c in range(65, 91)}))
            for left, right in path + top:
                node = sha(left + node + right)
            proof = sha("".join(left + right for left, right in path + top))
            out.append((row[0], leaf, subroot, root, proof, node, node == root))
    return out


def lowered(df):
    small = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    hit = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0
    return {"text": F.when(hit, small).otherwise(F.col("text"))}


@pytest.mark.parametrize("n,sources", [(700, 3), (40, 40), (17, 1), (1, 1)])
def test_manifest_equals_brute_force(spark, n, sources):
    rng = random.Random(n)
    names = [None, "", *(f"s{i}" for i in range(sources))][: max(1, sources)]
    rows = []
    for i in range(n):
        text = rng.choice([None, "", "Mixed Case", "lower", "ÄÖ A", "x" * 3000 + "Y"])
        source = names[0] if rng.random() < 0.4 else rng.choice(names)
        rows.append((rng.choice([None, 7, i]), text, rng.choice([None, "en"]), source))
    rows += rows[:2]
    df = table(spark, rows)
    got = merkle.manifest(df, tampered=lowered(df)).collect()
    assert Counter(map(tuple, got)) == Counter(plain_manifest(rows))
    assert all(r.verified for r in merkle.manifest(df).collect())


def test_manifest_of_no_rows(spark):
    df = table(spark, [])
    got = merkle.manifest(df, tampered=lowered(df))
    assert got.count() == 0 and got.columns[:2] == ["doc_id", "leaf"]


# Importance resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_features(text):
    words = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return words, words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def plain_resample(rows, target):
    def bucket(feature):
        return zlib.crc32(feature.encode()) % 10000

    ours = Counter(bucket(f) for r in rows for f in plain_features(r[1])[1])
    theirs = Counter(bucket(f) for t in target for f in plain_features(t)[1])
    n, m = sum(ours.values()), sum(theirs.values())
    out = []
    for place, (i, text, *_) in enumerate(rows):
        words, features = plain_features(text)
        total = sum(math.floor(1000 * math.log((theirs[b] + 1) * (n + 10000) / ((ours[b] + 1) * (m + 10000)))) for b in map(bucket, features))
        weight = total // len(features) if features else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append((i, len(words), len(features), weight, score))
    able = sorted((x for x in out if x[1] >= 20), key=lambda x: (-x[4], x[0] is not None, x[0] or 0))
    ranks = defaultdict(list)
    for place, x in enumerate(able[: 25 * len(able) // 100]):
        ranks[x].append(place + 1)
    return out, ranks


@pytest.mark.parametrize("piece", [1 << 20, 16])
def test_resample_equals_brute_force(spark, monkeypatch, piece):
    monkeypatch.setattr(resample, "PIECE", piece)
    rng = random.Random(4)
    vocabulary = ["Alpha", "beta", "é", "日本", "x1", "GAMMA", "d" * 40, "\x7f", "-", "\x00"]
    rows = [(None, None, "en", "a"), (1, "", "en", "a"), (2, " \n", "en", "b"), (3, "one", "en", "b")]
    rows += [(i, " ".join(rng.choices(vocabulary, k=rng.randint(0, 60))), "en", "c") for i in range(4, 120)]
    rows += [rows[20], rows[20], (None, "beta x1 " * 30, "en", "d")]
    target = [None, "", "alpha beta alpha", "x1,x1 É"]
    df, wanted = table(spark, rows), spark.createDataFrame([(t,) for t in target], "text string")
    got = resample.resample(df, wanted).collect()
    scored, ranks = plain_resample(rows, target)
    assert Counter(tuple(r)[:5] for r in got) == Counter(scored)
    found = defaultdict(list)
    for r in got:
        if r["rank"] is not None:
            found[tuple(r)[:5]].append(r["rank"])
    assert {k: sorted(v) for k, v in found.items()} == dict(ranks)


def test_resample_of_odd_tables(spark):
    df, none = table(spark, [(1, "a b " * 20, "en", "a")]), spark.createDataFrame([], "text string")
    assert resample.resample(df.limit(0), df).count() == 0
    assert [(r.n_words, r.n_features, r["rank"]) for r in resample.resample(df, none).collect()] == [(40, 79, None)]
    long = "ab " * 700_000
    assert [(r.n_words, r.n_features) for r in resample.resample(table(spark, [(1, long, "en", "a")]), df).collect()] == [(700_000, 1_399_999)]


def test_crc_with_a_space():
    crcs = np.array([zlib.crc32(w) for w in (b"", b"a", "é".encode())], np.uint32)
    assert resample.with_space(crcs).tolist() == [zlib.crc32(w + b" ") for w in (b"", b"a", "é".encode())]
