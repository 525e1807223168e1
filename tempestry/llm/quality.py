"""Document quality by weak supervision.

Rules over simple counts of a text vote good (1), bad (-1) or abstain (0). Expectation-maximisation over the
counts of all vote patterns of the corpus estimates the share of good documents and, for each rule, how often its
vote is right on good and on bad documents. A document is kept when its posterior probability of being good is
at least a half; no single rule decides.

Only the counts of different vote patterns, at most 3 to the number of rules, reach the driver, and they cover
every document. Null and empty texts have no words. Repeated rows each count. An empty corpus gives no rows. Very long texts are
counted whole. Ids are only passed on, null or repeated ones too; a posterior of exactly a half keeps the document.
"""

import math
from collections import Counter
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempestry.llm.common import stored, text_function

#: The characters counted as symbols, and the bounds of the base verdict.
SYMBOLS = "#*$%&|<>"
LEAST_WORDS = 50
MOST_REPEATED = 0.5
#: No vote is taken to be rarer than this.
LEAST_SHARE = 1e-5

COUNTS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_lines", "n_upper_words", "n_marked_words", "n_letters", "n_chars",
)
COUNT_TYPE = "struct<" + ",".join(f"{name}:bigint" for name in COUNTS) + ">"

WHITE = bytes(range(9, 14)) + b" "
SYMBOL_BYTES = SYMBOLS.encode()
#: ASCII bytes that are no letters: what is left of a text without them is letters, but for rare other signs.
NO_LETTERS = bytes(b for b in range(128) if not chr(b).isalpha())
CONTINUATION = bytes(range(128, 192))


def counts_of(data):
    """COUNTS of one text in UTF-8. Words are runs of bytes outside ASCII white space."""
    words = data.split()
    n = len(words)
    chars = len(data.translate(None, CONTINUATION))
    white = len(data) - len(data.translate(None, WHITE))
    symbols = len(data) - len(data.translate(None, SYMBOL_BYTES))
    lines = list(filter(bytes.strip, data.split(b"\n")))
    windows = list(zip(words, words[1:], words[2:]))
    times = Counter(windows)
    repeated = 0
    if len(times) < len(windows):
        covered = bytearray(n)
        for i in compress(range(n), (times[w] > 1 for w in windows)):
            covered[i : i + 3] = b"\1\1\1"
        repeated = sum(covered)
    return (
        n,
        chars - white,
        symbols,
        len(lines) - len(set(lines)),
        repeated,
        len(lines),
        sum(len(w) > 1 for w in filter(bytes.isupper, words)),
        sum(map(bytes.endswith, words, ((b"!!", b"###", b"***", b"$$$", b"%%%", b"&&&"),) * n)),
        len(data.translate(None, NO_LETTERS + CONTINUATION)),
        chars,
    )


def quality_counts(text: Column) -> Column:
    """struct<n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ...> of a text column."""

    def make():
        def work(texts):
            rows = [counts_of(t) if t else (0,) * len(COUNTS) for t in texts]
            columns = zip(*rows) if rows else [()] * len(COUNTS)
            return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], names=list(COUNTS))

        return work

    return text_function(make, COUNT_TYPE, "quality_counts")(text)


def base_failed(c) -> Column:
    return (c["n_words"] < LEAST_WORDS) | (100 * c["n_repeat_words"] > 100 * MOST_REPEATED * c["n_words"])


def fault(found: Column) -> Column:
    """-1 where a fault is found, else an abstention."""
    return F.when(found, -1).otherwise(0)


def either(good: Column, bad: Column) -> Column:
    return F.when(good, 1).when(bad, -1).otherwise(0)


def rule_votes(c) -> dict[str, Column]:
    """The rules. Bounds are parameters of the rules, not of the corpus."""
    words = F.greatest(c["n_words"], F.lit(1))
    length, symbols = c["word_chars"] / words, c["n_symbols"] / words
    letters = c["n_letters"] / F.greatest(c["n_chars"] - c["n_words"], F.lit(1))
    return {
        "length": either(c["n_words"] >= 80, c["n_words"] < LEAST_WORDS),
        "word_length": either(length.between(3, 9), ~length.between(2, 16)),
        "prose": either((letters >= 0.78) & (symbols <= 0.02), letters < 0.5),
        "repetition": fault(c["n_repeat_words"] / words >= 0.4),
        "symbols": fault(symbols >= 0.2),
        "lines": fault(c["n_dup_lines"] / F.greatest(c["n_lines"], F.lit(1)) >= 0.5),
        "capitals": fault(c["n_upper_words"] / words >= 0.4),
        "emphasis": fault(c["n_marked_words"] / words >= 0.3),
        "letters": fault(letters <= 0.75),
    }


class Supervision:
    """Prior of good and, per rule, P(vote good) and P(vote bad) on good and on bad documents.

    The starting values say that a bad vote is rare on good documents and that a rule sees few of the bad ones,
    as each looks for a fault of its own. Estimates lean on them by `strength` documents.
    """

    def __init__(self, names, prior=0.9, strength=10.0, rounds=300):
        self.names, self.prior, self.strength, self.rounds = list(names), prior, strength, rounds
        n = len(self.names)
        #: Rows: vote good on good, vote good on bad, vote bad on good, vote bad on bad.
        self.shares = np.repeat(np.array([[0.8], [0.6], [0.001], [0.2]]), n, axis=1)

    def weights(self):
        """Log odds of good that a good vote, a bad vote and an abstention of each rule give."""
        logs = np.log(self.shares)
        abstain = np.log(np.maximum(1 - self.shares[:2] - self.shares[2:], LEAST_SHARE))
        return logs[0] - logs[1], logs[2] - logs[3], abstain[0] - abstain[1]

    def log_odds(self, votes):
        good, bad, abstain = self.weights()
        odds = (votes > 0) @ good + (votes < 0) @ bad + (votes == 0) @ abstain
        return math.log(self.prior) - math.log1p(-self.prior) + odds

    def fit(self, votes, documents):
        """votes: patterns by rules; documents: how many have each pattern."""
        if not len(votes):
            return self
        lean = self.strength * self.shares
        for _ in range(self.rounds):
            good = documents / (1 + np.exp(-np.clip(self.log_odds(votes), -500, 500)))
            bad = documents - good
            counts = np.array([good @ (votes > 0), bad @ (votes > 0), good @ (votes < 0), bad @ (votes < 0)])
            sizes = np.array([good.sum(), bad.sum(), good.sum(), bad.sum()]) + self.strength
            shares = (counts + lean) / sizes[:, None]
            # A vote never speaks for the opposite of what it says.
            shares[1] = np.minimum(shares[1], shares[0])
            shares[2] = np.minimum(shares[2], shares[3])
            prior = float(np.clip((good.sum() + 0.9) / (documents.sum() + 1), 0.05, 0.999))
            change = max(abs(shares - self.shares).max(), abs(prior - self.prior))
            self.shares, self.prior = np.clip(shares, LEAST_SHARE, 1.0), prior
            if change < 1e-9:
                break
        return self

    def posterior(self, votes: dict[str, Column]) -> Column:
        """P(good | votes) as a column."""
        odds = F.lit(math.log(self.prior) - math.log1p(-self.prior))
        for name, good, bad, abstain in zip(self.names, *(w.tolist() for w in self.weights())):
            odds = odds + F.when(votes[name] > 0, good).when(votes[name] < 0, bad).otherwise(abstain)
        return 1 / (1 + F.exp(-odds))


def counted_documents(docs: DataFrame, keep: list, text_col="text", name="quality-counts") -> DataFrame:
    """The columns `keep` and a column counts, written once: texts are read by Python a single time."""
    return stored(docs.select(*keep, quality_counts(F.col(text_col)).alias("counts")), name)


def fit_supervision(counted: DataFrame, counts="counts") -> Supervision:
    """EM on the vote patterns of a table with a column of quality_counts."""
    votes = rule_votes(F.col(counts))
    pattern = counted.select(*[v.cast("int").alias(name) for name, v in votes.items()])
    rows = pattern.groupBy(*votes).agg(F.count(F.lit(1)).alias("documents")).orderBy(*votes).toArrow()
    table = rows.to_pydict()
    matrix = np.array([table[name] for name in votes], dtype=np.int64).reshape(len(votes), -1).T
    return Supervision(votes).fit(matrix, np.array(table["documents"], dtype=float))


def judged(counted: DataFrame, supervision: Supervision, counts="counts") -> dict[str, Column]:
    """Columns base_failed, quality and kept for a table with a column of quality_counts."""
    c = F.col(counts)
    quality = supervision.posterior(rule_votes(c))
    failed = base_failed(c)
    return {"base_failed": failed, "quality": quality, "kept": ~failed & (quality >= 0.5)}
