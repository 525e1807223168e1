"""Registered corpus queries and the pipeline on the given tables."""

import hashlib
import math
import os
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from tempestry.llm import byte_bpe, imatch, queries, sentence_pieces, token_counts
from workload import check

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")

#: Access keys, as the base rules say.
PLAIN_SECRET = re.compile(r"AKIA[A-Z0-9]{16,}")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_matches_sql(spark, name):
    good, message = check.compare(spark, check.connect(SF_DIR), SF_DIR, entry.queries()[name], entry.oracle_sql()[name])
    assert good, message


def test_op5_query_matches_brute_force(spark):
    from test_corpus_operators import plain_components, plain_print

    rows = entry.queries()["op5_simhash"](spark, SF_DIR).collect()
    given = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()
    prints = [plain_print(r.text) for r in given]
    different = sorted(set(prints))
    root = dict(zip(different, plain_components(different)))
    low = {}
    for r, p in zip(given, prints):
        low[root[p]] = min(r.doc_id, low.get(root[p], r.doc_id))
    want = sorted((r.doc_id, f"{p:016x}", low[root[p]]) for r, p in zip(given, prints))
    assert sorted(map(tuple, rows)) == want


def test_pipeline_stages_follow_the_queries(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    kept = {r.doc_id for r in entry.queries()["op9_quality_rules"](spark, SF_DIR).where("kept").collect()}
    found = entry.queries()["op4_language_id"](spark, SF_DIR)
    known = {r.doc_id for r in found.where((F.col("lang_pred") != "und") & (F.col("score") >= 0.5)).collect()}
    stages = dict(corpus_pipeline.STAGES)
    assert {r.doc_id for r in stages["quality_rules"](spark, docs, SF_DIR).collect()} == kept
    assert {r.doc_id for r in stages["language_id"](spark, docs, SF_DIR).collect()} == known


@pytest.fixture(scope="module")
def given(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def ids_of(given):
    """Ids by an untouched library tokenizer, with the end id."""
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(byte_bpe.default_path())
    return {i: [*plain.encode(r.text or "", add_special_tokens=False).ids, 0] for i, r in given.items()}


def result(spark, name):
    return entry.queries()[name](spark, SF_DIR).collect()


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_op2_query_counts_and_base_score(spark, given):
    tokens = {i: (r.text or "").encode().lower().split() for i, r in given.items()}
    training = {i for i in given if zlib.crc32(str(i).encode()) % 10}
    end = object()
    counts = Counter(t for i in training for t in [*tokens[i], end])
    total = sum(counts.values())
    rows = result(spark, "op2_context_tree")
    assert sorted(r.doc_id for r in rows) == sorted(given)
    for r in rows:
        own = [*tokens[r.doc_id], end]
        assert r.held_out == (r.doc_id not in training) and r.train_tokens == total
        assert (r.n_tokens, r.n_known) == (len(own), sum(t in counts for t in own))
        base = sum(math.log10((counts[t] + 0.1) / (total + 0.1 * (len(counts) + 1))) for t in own)
        assert r.base_score == pytest.approx(base) and r.score < 0
        n_bytes = len((given[r.doc_id].text or "").encode()) + 1
        assert r.bits_per_byte == pytest.approx(-r.score / math.log10(2) / n_bytes) and r.bits_per_byte < 8


def test_op3_query_equals_the_library(spark, given):
    library = sentence_pieces.piece_encoder(sentence_pieces.default_path()).library
    want = []
    for i, r in given.items():
        ids = library.encode(r.text or "")
        want.append((i, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids))))
    assert sorted(map(tuple, result(spark, "op3_sentence_pieces"))) == sorted(want)


def test_op4_query_is_right_on_held_out_texts(spark, given):
    rows = result(spark, "op4_language_id")
    assert sorted(r.doc_id for r in rows) == sorted(given)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1
        if not any(map(str.isalpha, given[r.doc_id].text or "")):
            assert r.lang_pred == "und"
    sure = [r for r in rows if r.held_out and given[r.doc_id].lang and len((given[r.doc_id].text or "").split()) >= 20]
    assert sum(r.lang_pred == given[r.doc_id].lang for r in sure) >= 0.95 * len(sure) > 0


def test_op7_query_equals_brute_force(spark, ids_of):
    lengths = [len(ids) - 1 for ids in ids_of.values()]
    rows = result(spark, "op7_token_counts")
    answers = {r.n_tokens: r for r in rows if r.quantile_of is None}
    assert set(answers) == set(lengths) | set(token_counts.CONTEXT_LIMITS)
    for n, r in answers.items():
        assert (r.docs, r.docs_over, r.tokens_over) == (lengths.count(n), sum(x > n for x in lengths), sum(x for x in lengths if x > n))
        assert (r.tokens_kept, r.tokens_truncated) == (sum(x for x in lengths if x <= n), sum(min(x, n) for x in lengths))
    ordered = sorted(lengths)
    found = {r.quantile_of: r.n_tokens for r in rows if r.quantile_of is not None}
    assert found == {s: ordered[max(0, math.ceil(round(s * len(ordered), 9)) - 1)] for s in token_counts.SHARES}


def packed_well(rows, ids_of, width=1024):
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        own = ids_of[r.doc_id][r.start : r.start + r.length]
        assert r.doc_tokens == len(ids_of[r.doc_id]) and len(own) == r.length > 0
        assert r.ids_crc32 == zlib.crc32(np.array(own, dtype="<u4").tobytes())
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts, total in [(p, len(ids_of[i])) for i, p in pieces.items()] + [(s, None) for s in sequences.values()]:
        at = 0
        for start, length in sorted(parts):
            assert start == at
            at += length
        assert at == total or total is None and at <= width
    tokens = sum(len(ids_of[i]) for i in pieces)
    assert len(sequences) * width - tokens < width
    return set(pieces)


def test_op8_query_packs_every_id_once(spark, given, ids_of):
    assert packed_well(result(spark, "op8_packing"), ids_of) == set(given)


def plain_quality(text):
    text = text or ""
    words = [w for w in "".join(c if c not in "\t\n\x0b\x0c\r" else " " for c in text).split(" ") if w]
    windows = Counter(zip(words, words[1:], words[2:]))
    repeated = set()
    for i, w in enumerate(zip(words, words[1:], words[2:])):
        if windows[w] > 1:
            repeated |= {i, i + 1, i + 2}
    lines, dup = set(), 0
    for line in text.split("\n"):
        if any(c not in " \t\x0b\x0c\r" for c in line):
            dup += line in lines
            lines.add(line)
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(repeated)


def test_op9_query_counts_equal_brute_force(spark, given):
    rows = result(spark, "op9_quality_rules")
    assert sorted(r.doc_id for r in rows) == sorted(given)
    for r in rows:
        counts = plain_quality(given[r.doc_id].text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts
        assert r.base_failed == (counts[0] < 50 or 100 * counts[4] > 50 * counts[0])
        assert not (r.base_failed and r.kept)
    assert sum(r.kept for r in rows) > len(rows) / 2


def test_op10_query_equals_brute_force(spark, given):
    order = sorted(given)
    counts = Counter(w for r in given.values() for w in set((r.text or "").encode().lower().split()))
    n = len(given)
    lexicon = {w: imatch.kept_by(w) for w, c in counts.items() if imatch.LEAST_SHARE * n <= c <= max(1, imatch.MOST_SHARE * n)}
    found = {r.doc_id: r for r in result(spark, "op10_imatch")}
    assert sorted(found) == order
    for place, i in enumerate(order):
        text, after = given[i].text or "", given[order[(place + 1) % n]].text or ""
        changed = imatch.edited(text, after)
        own, other, following = (imatch.hashes(t.encode(), lexicon) for t in (text, changed, after))
        r = found[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), sha(changed))
        assert (r.fingerprint, r.edited_fingerprint) == ("".join(own), "".join(other))
        assert (r.near_edited, r.near_next) == (imatch.alike(own, other), imatch.alike(own, following))


def test_pipeline_run_and_its_last_stages(spark, given):
    """The whole run: what each stage decides holds for what the next one gets."""
    from tokenizers import Tokenizer

    stages, docs, kept = dict(corpus_pipeline.STAGES), spark.read.parquet(f"{SF_DIR}/documents.parquet"), []
    for name in list(stages)[:-1]:
        before = docs.columns
        docs = spark.createDataFrame(stages[name](spark, docs, SF_DIR).collect(), docs.schema)
        assert docs.columns == before
        kept.append({r.doc_id: r for r in docs.collect()})
    quality, language, single, clean = kept
    assert set(given) >= set(quality) >= set(language) >= set(single) == set(clean)
    for i, r in clean.items():
        spans = PLAIN_SECRET.findall(r.text or "")
        assert not spans and (r.text == single[i].text or r.n_chars == len(r.text))
    plain = Tokenizer.from_file(byte_bpe.default_path())
    ids_of = {i: [*plain.encode(r.text or "", add_special_tokens=False).ids, 0] for i, r in clean.items()}
    rows = corpus_pipeline.run(spark, SF_DIR).collect()
    assert packed_well(rows, ids_of) == set(clean)


def test_pipeline_stages_on_odd_rows(spark):
    """Null, empty and very long texts, repeated rows, null ids and columns that stages use themselves."""
    prose = [r.text for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").where("n_chars > 1500 AND n_chars < 4000").limit(8).collect()]
    long = " ".join(f"{w}{i % 89}" if i % 3 == 0 else w for i, w in enumerate(" ".join(prose).split() * 40))
    texts = [None, "", " \n", *prose, prose[0], long, "AKIA" + "Q" * 20 + " " + prose[1]]
    rows = [(None if i % 4 == 0 else i % 9, t, "en", None, None if t is None else len(t), "row", "fp", 3, "x") for i, t in enumerate(texts)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, row string, fp string, at int, found string"
    docs = spark.createDataFrame(rows + rows[:6], schema)
    stages = dict(corpus_pipeline.STAGES)
    for name in list(stages)[:-1]:
        made = stages[name](spark, docs, SF_DIR)
        assert made.columns == docs.columns and made.where("row != 'row' OR fp != 'fp' OR at != 3 OR found != 'x'").count() == 0
        kept = Counter((r.doc_id, r.text) for r in made.collect())
        if name != "secret_scan":
            assert not kept - Counter((r[0], r[1]) for r in rows + rows[:6])
        else:
            assert sum(kept.values()) == docs.count() and not any("AKIAQ" in (t or "") for _, t in kept)
        empty = stages[name](spark, docs.limit(0), SF_DIR)
        assert empty.count() == 0 and empty.columns == docs.columns
    packed = stages["packing"](spark, docs, SF_DIR)
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
    assert stages["packing"](spark, docs.limit(0), SF_DIR).count() == 0
