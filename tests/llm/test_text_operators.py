"""Operators that read single texts, against plain re-implementations."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tempestry.llm import automata, byte_bpe, quality, secret_scan, sentence_pieces, token_counts

PATTERNS = {
    r.kind: re.compile(f"({r.lead})({r.run}+)", (re.I if r.ignore_case else 0) | re.A) for r in secret_scan.RULES
}
PIECES = [
    "token", "=", ":", "Password", " ", '"', "'", "abcdef0123456789", "AKIA", "ABCDEF0123456789", "é", "api_key",
    "APIKEY", "secret", "passwd", "deadbeef" * 4, "xoxb-", "ghp_", "A" * 18, "\n", "==", "bearer ", "eyJ", ".",
    "0" * 9, "-----BEGIN RSA PRIVATE KEY-----", "sk_live_", "AIza", "_", "日本",
]

DOCS = "doc_id bigint, text string, spans string, counts int"


def found_by_re(text):
    spans = []
    for place, rule in enumerate(secret_scan.RULES):
        for m in PATTERNS[rule.kind].finditer(text):
            if m.end() - m.end(1) >= rule.need:
                spans.append((m.start(), place, m.end(), rule.kind))
    return [(kind, start, end) for start, _, end, kind in sorted(spans)]


@pytest.fixture(scope="module")
def scanner():
    return secret_scan.Scanner()


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=14))
def test_spans_are_those_of_the_rules_expressions(scanner, parts):
    text = "".join(parts)
    assert scanner.spans(text.encode()) == found_by_re(text)


def test_a_short_match_is_consumed(scanner):
    assert scanner.spans(b"token=token:abcdefgh") == []
    assert scanner.spans(b"token=token:abcdefghtoken=abcdefgh") == [("assign", 20, 34)]


def test_automaton_is_minimal_and_complete():
    a = automata.compile_patterns([("(ab|cb)", False)])
    assert len(a.masks) == 4  # start, one letter read, matched, dead
    assert a.longest(b"cb", 0, 2) == 2 and a.longest(b"cc", 0, 2) == -1
    with pytest.raises(ValueError):
        automata.compile_patterns([("a)", False)])


def test_secrets_of_odd_rows_and_redaction(spark):
    rows = [
        (1, None, "x", 1), (2, "", "x", 1), (3, "é password=abcdefgh1 z", "x", 1), (3, "é password=abcdefgh1 z", "x", 1),
        (None, "key " + "0123456789abcdef" * 2, None, None), (4, "a" * 200_000, "x", 1),
        (5, 'token = "' + "ab" * 20 + '" end', "x", 1),
    ]
    df = spark.createDataFrame(rows, DOCS)
    got = df.select("doc_id", "text", "spans", secret_scan.find_secrets(F.col("text")).alias("found"))
    got = got.select("doc_id", secret_scan.span_list(F.col("found")).alias("s"), secret_scan.redact(F.col("text"), F.col("found")).alias("r"))
    out = {(r.doc_id, r.s): r.r for r in got.collect()}
    assert out[3, "assign:2:20"] == "é <assign> z"
    assert out[None, "hex:4:36"] == "key <hex>"
    assert out[4, "hex:0:200000"] == "<hex>"
    assert out[5, "assign:0:49,hex:9:49"] == '<assign>" end'
    assert out[1, ""] is None and out[2, ""] == ""
    assert got.count() == len(rows)
    assert df.limit(0).select(secret_scan.find_secrets(F.col("text"))).count() == 0


ODD = [
    "", None, " a", "a ", "a  b", "a \n b", "\n\na b", "\0x y", "<|endoftext|> hi", "日本 語 é", "a  b", " ", "x 　y",
    "it's 'll  \t z", "emoji 😀😀 x", " ▁x ▁▁y ", "a\n\n  b", "▁", "  a  b   c ", "word " * 3000,
]


@pytest.fixture(scope="module")
def bpe():
    return byte_bpe.ByteBpe(byte_bpe.default_path())


def library_ids(bpe, text):
    return bpe.library.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("text", ODD)
def test_byte_bpe_equals_the_library(bpe, text):
    assert np.frombuffer(bpe.encode(text), bpe.dtype).tolist() == library_ids(bpe, text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab thé\n\t '1.日😀 ")), max_size=40))
def test_byte_bpe_equals_the_library_on_any_text(bpe, text):
    assert np.frombuffer(bpe.encode(text), bpe.dtype).tolist() == library_ids(bpe, text)


def test_every_token_of_the_vocabulary_encodes_alike(bpe):
    texts = [bpe.library.decode([i]) for i in range(0, 50256, 7)]
    for text in texts:
        if "�" not in text:
            assert np.frombuffer(bpe.encode(text), bpe.dtype).tolist() == library_ids(bpe, text)


def test_token_histogram(spark, bpe):
    texts = [t for t in ODD] + ["a b", "a b", "c"]
    df = spark.createDataFrame([(i, t, "x", 0) for i, t in enumerate(texts)], DOCS)
    lengths = sorted(len(library_ids(bpe, t)) for t in texts)
    answers = token_counts.limits(token_counts.length_histogram(df, byte_bpe.default_path()))
    got = {r.n_tokens: r for r in answers.collect()}
    assert {n: r.docs for n, r in got.items()} == Counter(lengths)
    for n, r in got.items():
        assert r.docs_over == sum(x > n for x in lengths)
        assert r.tokens_over == sum(x for x in lengths if x > n)
        assert r.tokens_kept == sum(x for x in lengths if x <= n)
        assert r.tokens_truncated == sum(min(x, n) for x in lengths)
        assert r.share_within == sum(x <= n for x in lengths) / len(lengths)
    quantiles = {r.share: r.n_tokens for r in token_counts.quantiles(answers, [0.5, 1.0]).collect()}
    assert quantiles == {0.5: lengths[-(-len(lengths) // 2) - 1], 1.0: lengths[-1]}
    assert token_counts.truncated_total(answers, 4).first().tokens == sum(min(x, 4) for x in lengths)
    empty = token_counts.limits(token_counts.length_histogram(df.limit(0), byte_bpe.default_path()))
    assert empty.count() == 0


@pytest.fixture(scope="module")
def encoder():
    return sentence_pieces.PieceEncoder(sentence_pieces.default_path())


@pytest.mark.parametrize("text", ODD)
def test_pieces_equal_the_library(encoder, text):
    assert encoder.encode([text])[0] == encoder.library.encode(text or "")


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("abcthe é\n▁ 1.,日😀 ")), max_size=60))
def test_agenda_equals_the_library_on_any_text(encoder, text):
    assert encoder.encode([text])[0] == encoder.library.encode(text)
    whole = encoder.library.normalize(text)
    assert encoder.merged_short(whole) == encoder.merged_long(whole)


def test_round_trip_digests(spark, encoder):
    df = spark.createDataFrame([(i, t, "x", 0) for i, t in enumerate(ODD)], DOCS)
    path = sentence_pieces.default_path()
    got = df.select("doc_id", "text", sentence_pieces.round_trip(F.col("text"), path).alias("t")).collect()
    for r in got:
        ids = encoder.library.encode(r.text or "")
        assert r.t.n_tokens == len(ids)
        assert r.t.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.t.decoded_sha256 == hashlib.sha256(encoder.library.decode(ids).encode()).hexdigest()
    ids = df.select("text", sentence_pieces.encode_pieces(F.col("text"), path).alias("ids"))
    for r in ids.select("text", "ids", sentence_pieces.decode_pieces(F.col("ids"), path).alias("back")).collect():
        assert r.ids == encoder.library.encode(r.text or "")
        assert r.back == encoder.library.decode(r.ids)


def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    times = Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i in range(len(words) - 2) if times[tuple(words[i : i + 3])] > 1 for k in range(3)}
    seen, repeated = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            repeated += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), repeated, len(covered)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab \n\té#|\x0b\x0c\r \x85日")), max_size=60))
def test_quality_counts(text):
    assert quality.counts_of(text.encode())[:5] == plain_counts(text)


def test_supervision_finds_the_better_rules():
    rng = np.random.default_rng(3)
    good = rng.random(6000) < 0.85
    votes = np.zeros((6000, 5), dtype=int)
    votes[:, 0] = np.where(rng.random(6000) < np.where(good, 0.95, 0.3), 1, 0)
    for rule, (false, true) in enumerate([(0.002, 0.5), (0.003, 0.5), (0.002, 0.4), (0.1, 0.12)], start=1):
        votes[:, rule] = -(rng.random(6000) < np.where(good, false, true)).astype(int)
    patterns, documents = np.unique(votes, axis=0, return_counts=True)
    model = quality.Supervision("abcde").fit(patterns, documents.astype(float))
    bad = model.weights()[1]
    assert bad[1:4].max() < -2 and bad[4] > -1 and abs(model.prior - 0.85) < 0.06
    assert ((model.log_odds(votes) > 0) == good).mean() > 0.93
    assert quality.Supervision("ab").fit(np.empty((0, 2)), np.empty(0)).prior == 0.9


def test_quality_verdicts(spark):
    rng = random.Random(1)
    vocabulary = ["".join(rng.choices("abcdefgh", k=rng.randint(3, 8))) for _ in range(400)]
    good = [(i, " ".join(rng.choices(vocabulary, k=200)) + ".", "x", 0) for i in range(60)]
    bad = [(100 + i, " ".join(w.upper() + "!!" for w in rng.choices(vocabulary, k=120)), "x", 0) for i in range(8)]
    marked = [(200 + i, " ".join(w + "###" for w in rng.choices(vocabulary, k=120)), "x", 0) for i in range(8)]
    odd = [(300, None, "x", 0), (301, "", "x", 0), (302, "only a few words", "x", 0), (None, "spam " * 90, None, None)]
    df = spark.createDataFrame(good + bad + marked + odd + good[:1], DOCS)
    counted = quality.counted_documents(df, keep=["doc_id"])
    verdict = quality.judged(counted, quality.fit_supervision(counted))
    got = counted.select("doc_id", verdict["kept"].alias("kept"), verdict["base_failed"].alias("failed")).collect()
    kept = sorted(r.doc_id for r in got if r.kept)
    assert kept == sorted([0, *range(60)])
    assert {r.doc_id for r in got if r.failed} == {300, 301, 302, None}
    assert len(got) == 60 + 8 + 8 + 4 + 1
    empty = quality.counted_documents(df.limit(0), keep=["doc_id"])
    verdict = quality.judged(empty, quality.fit_supervision(empty))
    assert empty.select(verdict["kept"]).count() == 0


@pytest.mark.parametrize("text", ["<|endoftext|> hi", "a <|endoftext|>", "<|endoftext|>", "x<|endoftext|><|endoftext|> y  <|endof", "<|endof text|>"])
def test_added_tokens_get_the_ids_of_an_untouched_tokenizer(bpe, text):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(byte_bpe.default_path())
    assert np.frombuffer(bpe.encode(text), bpe.dtype).tolist() == plain.encode(text, add_special_tokens=False).ids


def test_agendas_side_by_side_equal_single_ones():
    encoder = sentence_pieces.piece_encoder(sentence_pieces.default_path())
    rng = random.Random(3)
    letters = "aeioutnrsléßж日\U0001f600\x01▁Q"
    segments = list({"▁" + "".join(rng.choices(letters, k=rng.randint(0, 14))) for _ in range(4000)})
    assert {k: list(v) for k, v in encoder.agendas(segments).items()} == {s: list(encoder.agenda(s)) for s in segments}
