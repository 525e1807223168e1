"""Operators that look across documents, against brute force on small tables."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tempestry.llm import byte_bpe, chat_format, context_tree, imatch, language_id, packing, simhash

DOCS = "doc_id bigint, text string, lang string, fingerprint string, block int"


def words(rng, n, letters="abcdefghij"):
    return " ".join("".join(rng.choices(letters, k=rng.randint(1, 6))) for _ in range(n))


def docs(spark, texts, ids=None, langs=None):
    ids = ids or list(range(len(texts)))
    langs = langs or ["en"] * len(texts)
    return spark.createDataFrame([(i, t, lang, "x", 7) for i, t, lang in zip(ids, texts, langs)], DOCS)


# SimHash


def plain_print(text):
    parts = (text or "").encode().lower().split()
    shingles = [b" ".join(parts[i : i + 4]) for i in range(max(1, len(parts) - 3))] if parts else []
    value = 0
    for bit in range(64):
        ones = sum(xxhash.xxh64_intdigest(s, 42) >> bit & 1 for s in shingles)
        value |= (2 * ones > len(shingles)) << bit
    return value


def plain_components(prints):
    parent = list(range(len(prints)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(prints))]


def near_texts(rng):
    texts = [None, "", " \n", "one", "a b c", "A B c"]
    for _ in range(12):
        base = words(rng, 300).split()
        texts.append(" ".join(base))
        for _ in range(4):
            base[rng.randrange(len(base))] = "changed"
            texts.append(" ".join(base))
    return texts + texts[8:10]


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(5)
    texts = near_texts(rng)
    ids = [rng.randrange(10**6) for _ in texts]
    got = simhash.near_duplicates(docs(spark, texts, ids)).collect()
    prints = [plain_print(t) for t in texts]
    roots = plain_components(prints)
    low = {r: min(i for i, x in zip(ids, roots) if x == r) for r in roots}
    want = sorted((i, f"{p:016x}", low[r]) for i, p, r in zip(ids, prints, roots))
    assert sorted(map(tuple, got)) == want
    assert simhash.near_duplicates(docs(spark, texts, ids).limit(0)).count() == 0


def test_keep_one_of_each_group(spark):
    rng = random.Random(6)
    texts = near_texts(rng)
    ids = [rng.randrange(10**6) for _ in texts]
    df = docs(spark, texts, ids).withColumn("row", F.lit(1)).withColumn("fp", F.lit(2))
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    prints = [plain_print(t) for t in texts]
    roots = plain_components(prints)
    assert sorted(r.doc_id for r in kept.collect()) == sorted({min(i for i, x in zip(ids, roots) if x == r) for r in roots})
    twice = docs(spark, ["a b c d e"] * 3 + ["v w x y z"], [3, 3, None, None])
    assert sorted((r.doc_id or -1, r.text) for r in simhash.keep_one(twice).collect()) == [(-1, "v w x y z"), (3, "a b c d e")]


def test_crowded_keys_lose_no_link():
    rng = np.random.default_rng(1)
    for _ in range(10):
        base = rng.integers(0, 2**64, 5, dtype=np.uint64)
        prints = []
        for _ in range(200):
            x = int(base[rng.integers(5)])
            for bit in rng.integers(0, 40, rng.integers(0, 9)):
                x ^= 1 << int(bit)
            prints.append(x)
        prints = np.unique(np.array(prints, dtype=np.uint64))
        table = np.bitwise_count(prints[:, None] ^ simhash.pivot_fingerprints()[None])
        union = simhash.Union(len(prints))
        found = simhash.crowd_links(prints, table, 4)
        assert len(found) < len(prints)
        for a, b in found:
            assert int(prints[a] ^ prints[b]).bit_count() <= 4
            union.join(int(a), int(b))
        assert [union.root(i) for i in range(len(prints))] == plain_components([int(p) for p in prints])
        pairs = simhash.small_links(np.zeros(len(prints)), prints, table, 4)
        every = {(i, j) for i in range(len(prints)) for j in range(i) if int(prints[i] ^ prints[j]).bit_count() <= 4}
        assert {(b, a) for a, b in pairs.tolist()} == every


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(40)] + [(100, 99)], "u bigint, v bigint")
    got = {r.node: r.root for r in simhash.components(edges).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {100: 99}


# Context trees


def plain_tree_score(training, texts, depth):
    """Context-tree weighting by recursion over dictionaries."""
    counts = Counter()

    def coded(text):
        data = bytes(depth) + (text or "").encode().lower() + b"\0"
        for at in range(depth, len(data)):
            yield data[at - depth : at][::-1], data[at]

    def decisions(byte):
        return [((1 << j) | byte >> (8 - j), byte >> (7 - j) & 1) for j in range(8)]

    for text in training:
        for context, byte in coded(text):
            for node, bit in decisions(byte):
                for d in range(depth + 1):
                    counts[context[:d], node, bit] += 1
    children = {}
    for context, node, _ in counts:
        if context:
            children.setdefault((context[:-1], node), set()).add(context)
    memo = {}

    def own(context, node):
        a, b = counts[context, node, 0], counts[context, node, 1]
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def weighted(context, node):
        if (context, node) not in memo:
            estimate = own(context, node)
            if len(context) < depth:
                below = sum(weighted(c, node) for c in children.get((context, node), ()))
                estimate = np.logaddexp(math.log(0.5) + estimate, math.log(0.5) + below)
            memo[context, node] = estimate
        return memo[context, node]

    def probability(context, node, bit):
        mixed = 0.0
        for d in range(depth, -1, -1):
            c = context[:d]
            a, b = counts[c, node, bit], counts[c, node, 0] + counts[c, node, 1]
            estimate = (a + 0.5) / (b + 1)
            share = 1.0 if d == depth else math.exp(math.log(0.5) + own(c, node) - weighted(c, node))
            mixed = share * estimate + (1 - share) * mixed
        return mixed

    return [
        sum(math.log10(probability(c, n, b)) for c, byte in coded(t) for n, b in decisions(byte)) for t in texts
    ]


def test_context_tree_equals_brute_force(spark):
    rng = random.Random(2)
    texts = [None, "", "aé A", *[words(rng, rng.randint(1, 40), "abcA") for _ in range(25)], "unseen Ω"]
    texts += texts[3:5]
    df = docs(spark, texts, list(range(100, 100 + len(texts))))
    train = [zlib.crc32(str(100 + i).encode()) % 10 != 0 for i in range(len(texts))]
    got = context_tree.score_texts(df, ~context_tree.held_out(F.col("doc_id")), block_bytes=500)
    got = {r.doc_id - 100: r for r in got.collect()}
    assert len(got) == len(texts)
    scores = plain_tree_score([t for t, on in zip(texts, train) if on], texts, context_tree.DEPTH)
    tokens = [(t or "").encode().lower().split() + [None] for t in texts]
    counts = Counter(w for t, on in zip(tokens, train) if on for w in t)
    total, kinds = sum(counts.values()), len(counts)
    for i, r in got.items():
        assert r.training == train[i]
        assert r.n_tokens == len(tokens[i]) and r.train_tokens == total
        assert r.n_known == sum(counts[w] > 0 for w in tokens[i])
        base = sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (kinds + 1))) for w in tokens[i])
        assert r.base_score == pytest.approx(base, abs=1e-6)
        assert r.score == pytest.approx(scores[i], abs=1e-6)


def test_no_id_fills_a_block_of_the_context_tree(spark):
    rng = random.Random(3)
    df = docs(spark, [words(rng, 5) for _ in range(200)], [None] * 100 + [7] * 100)
    block = context_tree.block_of(F.col("doc_id"), F.col("text").cast("binary"), 10).alias("block")
    sizes = df.groupBy("doc_id", block).count().collect()
    assert len(sizes) == 20 and max(r["count"] for r in sizes) < 30


def test_context_tree_without_training_or_rows(spark):
    df = docs(spark, ["ab", None])
    got = {r.doc_id: r.score for r in context_tree.score_texts(df, F.lit(False)).collect()}
    assert got[0] == pytest.approx(-3 * 8 * math.log10(2)) and got[1] == pytest.approx(-8 * math.log10(2))
    assert context_tree.score_texts(df.limit(0), F.lit(True)).count() == 0


def test_log_gamma():
    z = np.array([0.5, 1, 1.5, 7, 100.5, 1e6])
    assert np.allclose(context_tree.log_gamma(z), [math.lgamma(x) for x in z], rtol=1e-11, atol=1e-9)


# Language


def test_language_held_out_accuracy(spark):
    rng = random.Random(4)
    vocabulary = {"aa": "the of and with ing tion".split(), "bb": "der die und sch keit ung".split(), "cc": "les de que eau tion oi".split()}
    texts, langs = [], []
    for i in range(150):
        lang = rng.choice(sorted(vocabulary))
        parts = vocabulary[lang]
        texts.append(" ".join("".join(rng.choices(parts, k=rng.randint(1, 3))) for _ in range(30)))
        langs.append(lang if i % 10 else None)
    truth = langs[:]
    texts += [None, "", "123 !!", "²"]
    langs += ["aa", "aa", "bb", "bb"]
    df = docs(spark, texts, langs=langs)
    model = language_id.fit(df, ~language_id.held_out(F.col("doc_id")))
    assert model.languages == ["aa", "bb", "cc"]
    got = df.select("doc_id", language_id.predict_language(F.col("text"), model, spark).alias("p")).collect()
    out = {r.doc_id: r.p for r in got}
    right = [out[i].lang_pred == lang for i, lang in enumerate(truth) if lang and zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(right) > 10 and sum(right) / len(right) > 0.95
    assert all(0 <= p.score <= 1 for p in out.values())
    assert all(out[150 + i].lang_pred == "und" and out[150 + i].score == 0 for i in range(4))
    nothing = language_id.fit(df, F.lit(False))
    assert nothing.predictor()("some text") == ("und", 0.0)
    assert df.limit(0).select(language_id.predict_language(F.col("text"), model, spark)).count() == 0


def test_unseen_words_back_off():
    model = language_id.Model(["x", "y"], {}, {"<qu": 0, "u": 1}, np.log(np.array([[0.9, 0.1], [0.2, 0.8]])))
    assert np.allclose(model.unseen("queue"), model.table[0])
    assert np.allclose(model.unseen("bus"), model.table[1])
    assert np.allclose(model.unseen("zzz"), 0)


# Chats


def test_chats_read_back(spark):
    rng = random.Random(9)
    said = ["<|im_end|><|im_start|>assistant ok", "<\\|im_sep|>", "<", "|", "a\nb", "", "日本😀", "\\<|x", "<|im_sep|>", "$1"]
    turns = []
    for conv in range(12):
        for turn in range(rng.randint(1, 9)):
            text = "".join(rng.choices(said, k=3)) if rng.random() > 0.1 else None
            turns.append((conv if conv else None, turn, rng.choice(["user", "assistant", "system", "a\n%b", None]), text, "x"))
    df = spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string, formatted string")
    chats = chat_format.format_chats(df.repartition(3))
    got = chats.select(
        "conv_id", "formatted", chat_format.read_turns(F.col("formatted")).alias("turns"),
        chat_format.read_loss(F.col("formatted"), F.col("loss")).alias("loss"),
    ).collect()
    assert len(got) == 12
    for r in got:
        own = [(t[2] or "", t[3] or "") for t in turns if t[0] == r.conv_id]
        assert [tuple(t) for t in r.turns] == own
        assert "".join(r.loss) == "".join(text for role, text in own if role == "assistant")
        runs = sum(1 for i, t in enumerate(own) if not i or t[0] != own[i - 1][0])
        assert r.formatted.count("<|im_start|>") == runs == r.formatted.count("<|im_end|>")
    assert chat_format.format_chats(df.limit(0)).count() == 0


# Packing


def plain_ids(text):
    bpe = byte_bpe.byte_bpe(byte_bpe.default_path())
    return [*bpe.library.encode(text or "", add_special_tokens=False).ids, 0]


@pytest.mark.parametrize("width", [8, 64])
def test_packing_covers_every_token_once(spark, width):
    rng = random.Random(width)
    texts = [None, "", "x", *[words(rng, rng.randint(0, 90)) for _ in range(80)]]
    texts += [texts[5]] * 20
    got = packing.pack(docs(spark, texts), byte_bpe.default_path(), width=width).collect()
    ids = [plain_ids(t) for t in texts]
    pieces, sequences = {}, {}
    for r in got:
        own = np.array(ids[r.doc_id][r.start : r.start + r.length], dtype="<u4")
        assert len(own) == r.length > 0 and zlib.crc32(own.tobytes()) == r.ids_crc32
        assert r.doc_tokens == len(ids[r.doc_id])
        pieces.setdefault(r.doc_id, []).append((r.start, r.length))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(pieces) == set(range(len(texts)))
    for doc, found in pieces.items():
        at = 0
        for start, length in sorted(found):
            assert start == at
            at += length
        assert at == len(ids[doc])
    padding = 0
    for found in sequences.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= width
        padding += width - at
    assert padding < width


def test_balance_prefers_the_cheapest_sequence():
    plan = packing.balance({5: 1, 3: 1, 2: 1, 1: 2}, width=6)
    assert [(p[0], p[5]) for p in plan][:3] == [(5, 0), (3, 1), (2, 1)]
    assert packing.balance({}, 8) == []


def test_packing_of_no_rows_and_repeated_rows(spark):
    assert packing.pack(docs(spark, ["a"]).limit(0), byte_bpe.default_path()).count() == 0
    got = packing.pack(docs(spark, ["a b", "a b", None], [1, 1, None]), byte_bpe.default_path()).collect()
    assert sorted((r.doc_id or 0, r.length, r.offset) for r in got) == [(0, 1, 6), (1, 3, 0), (1, 3, 3)]


# I-Match


def test_imatch_equals_brute_force(spark):
    rng = random.Random(8)
    texts = [None, "", "  ", "Solo", *[words(rng, rng.randint(1, 80)) for _ in range(40)]]
    texts += [texts[6], texts[7]]
    ids = [7 * i % 997 for i in range(len(texts))]
    df = docs(spark, texts, ids)
    got = {r.doc_id: r for r in imatch.fingerprint_edits(df).collect()}
    assert len(got) == len(texts)
    counts = Counter(w for t in texts for w in set((t or "").encode().lower().split()))
    n = len(texts)
    lexicon = {w: imatch.kept_by(w) for w, c in counts.items() if imatch.LEAST_SHARE * n <= c <= max(1, imatch.MOST_SHARE * n)}
    assert imatch.build_lexicon(df) == lexicon
    order = sorted(range(n), key=lambda i: ids[i])
    for place, i in enumerate(order):
        text, following = texts[i] or "", texts[order[(place + 1) % n]] or ""
        half = len(text) // 2
        changed = text[: len(text) - half] + following[:half]
        own, other, after = (imatch.hashes(t.encode(), lexicon) for t in (text, changed, following))
        r = got[ids[i]]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert r.fingerprint == "".join(own) and r.edited_fingerprint == "".join(other)
        assert r.near_edited == imatch.alike(own, other) and r.near_next == imatch.alike(own, after)
    assert got[ids[6]].fingerprint == got[ids[44]].fingerprint


def test_imatch_columns_and_odd_tables(spark):
    df = docs(spark, ["a b c d", "a b c e", None])
    lexicon = imatch.build_lexicon(df)
    prints = df.select("doc_id", imatch.fingerprint(F.col("text"), lexicon, spark).alias("p"))
    a, b = prints.where("doc_id = 0").select(F.col("p").alias("a")), prints.select(F.col("p").alias("b"))
    for r in a.join(b, F.lit(True)).select("a", "b", imatch.likeness(F.col("a"), F.col("b")).alias("near")).collect():
        cut = [[x[i : i + 8] for i in range(0, len(x), 8)] for x in (r.a, r.b)]
        assert r.near == imatch.alike(*cut)
    assert imatch.fingerprint_edits(df.limit(0)).count() == 0
    alone = imatch.fingerprint_edits(docs(spark, ["ab cd"])).collect()
    assert [(r.n_chars, r.near_next) for r in alone] == [(5, 1.0)]
    tied = imatch.fingerprint_edits(docs(spark, ["x", "y", "z", "w"], [1, 1, None, None])).collect()
    assert sorted((r.doc_id or 0, r.n_chars) for r in tied) == [(0, 1), (0, 1), (1, 1), (1, 1)]


# Near-duplicates of the pipeline


def test_pipeline_drops_near_copies_like_brute_force(spark):
    rng = random.Random(16)
    texts = near_texts(rng)
    ids = rng.sample(range(10**6), len(texts))
    kept = corpus_pipeline.near_duplicates(spark, docs(spark, texts, ids), "")
    roots = plain_components([plain_print(t) for t in texts])
    assert sorted(r.doc_id for r in kept.collect()) == sorted({min(i for i, x in zip(ids, roots) if x == r) for r in roots})
    assert corpus_pipeline.near_duplicates(spark, docs(spark, texts, ids).limit(0), "").count() == 0


def test_language_sample_draws_rows_apart(spark):
    """Missing ids, one hot id and copies are drawn like any other rows, and about as many as the bound says."""
    texts = ["the same text"] * 1500 + [f"text number {i}" for i in range(1500)]
    for ids in ([None] * 3000, [7] * 3000, list(range(3000))):
        df = docs(spark, texts, ids, ["en"] * 2000 + ["de"] * 1000)
        got = language_id.training_sample(df, F.lit(True), 100).groupBy("lang").count().collect()
        assert {r.lang for r in got} == {"en", "de"} and all(50 <= r["count"] <= 160 for r in got)
    assert language_id.training_sample(df, F.lit(True), 5000).count() == 3000
