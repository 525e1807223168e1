"""Importance resampling towards a target text: hashed word and word-pair features, log likelihood ratios, Gumbel draw.

Features are all runs of one and two consecutive words of a text, repeats counted; each falls in the bucket
crc32(UTF-8 bytes) modulo `BUCKETS`. A bucket's gain is 1000 times the log ratio of its smoothed shares among the target's and
among the documents' features, rounded down. A text's weight is the mean gain of its features, rounded down. The
highest weights plus Gumbel noise, which depends on the id alone, are a sample without replacement.

Batch concatenation: the texts of a batch are joined with separators that no word holds, one pass of a regular
expression finds all words, searching their beginnings in the texts' offsets tells their texts, and pairs whose words lie in
different texts are masked before buckets are counted. A joined run is read in bounded pieces that end behind a
separator or other non-word byte and hand their last word on, so a very long text needs no more room than its own bytes.

Null and empty texts and texts without a word have no features and weight 0. Null ids count as the empty string, and come
first among equal scores; rows of equal score and id are told apart by their place in the table. Repeated rows
have equal scores. An empty table, as documents or target, counts no features. Extra columns take no part.
"""

import re
import zlib
from itertools import chain
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempestry.llm.common import numbered, stored, text_function

BUCKETS = 10_000
SEED = 7
LEAST_WORDS, PERCENT = 20, 25
SENTINEL = b"\x00"
#: Words of texts in which A-Z are lower-cased; every byte of a character above ASCII belongs to a word.
WORD = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
GAP = re.compile(rb"[\x00-\x2f\x3a-\x60\x7b-\x7f]")
PIECE = 1 << 20


def byte_table():
    """crc32's table of single bytes."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, np.uint32(0xEDB88320) ^ (table >> 1), table >> 1)
    return table


CRC_TABLE = byte_table()


def with_space(crcs):
    """The crc32 of texts with a space behind them, from those of the texts."""
    inner = ~crcs
    return ~(CRC_TABLE[(inner ^ np.uint32(0x20)) & np.uint32(0xFF)] ^ (inner >> np.uint32(8)))


def pieces(joined):
    """(begin, piece) that together are `joined`, cut behind bytes that belong to no word."""
    begin = 0
    while begin < len(joined):
        end = begin + PIECE
        gap = GAP.search(joined, end - 1) if end < len(joined) else None
        end = gap.end() if gap else len(joined)
        yield begin, joined[begin:end]
        begin = end


def batch_features(texts):
    """(texts' numbers, buckets, whether they are words) of the features of a batch, a bounded run at a time."""
    joined = SENTINEL.join(t.lower() if t else b"" for t in texts)
    offsets = np.cumsum([0, *(len(t or b"") + 1 for t in texts[:-1])])
    carried = np.empty(0, np.uint32), np.empty(0, np.int64)
    for begin, piece in pieces(joined):
        spans = [m.span() for m in WORD.finditer(piece)]
        if not spans:
            continue
        words = [piece[a:b] for a, b in spans]
        starts = np.fromiter((a for a, _ in spans), np.int64, len(spans)) + begin
        text_of = np.searchsorted(offsets, starts, side="right") - 1
        crcs = np.fromiter(map(zlib.crc32, words), np.uint32, len(words))
        # The word before this piece, if any, is the first of a pair.
        firsts = np.concatenate([carried[0], crcs[:-1]])
        seconds = words if len(carried[0]) else words[1:]
        pairs = np.fromiter(map(zlib.crc32, seconds, with_space(firsts).tolist()), np.uint32, len(seconds))
        of_first = np.concatenate([carried[1], text_of[:-1]])
        of_second = text_of[len(text_of) - len(seconds) :]
        within = of_first == of_second
        carried = crcs[-1:], text_of[-1:]
        yield text_of, crcs % BUCKETS, True
        yield of_second[within], pairs[within] % BUCKETS, False


def bucket_counts(texts: DataFrame, text_col="text") -> np.ndarray:
    """The number of features in each bucket over all rows: each task adds up its own before they meet."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, dtype=np.int64)
        for batch in batches:
            rows = batch.column(0).cast(pa.binary()).to_pylist()
            for _, buckets, _ in batch_features(rows):
                total += np.bincount(buckets, minlength=BUCKETS)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], names=["bucket", "n"])

    counted = texts.select(text_col).mapInArrow(count, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    # At most BUCKETS rows.
    total = np.zeros(BUCKETS, dtype=np.int64)
    for row in counted.collect():
        total[row["bucket"]] = row["n"]
    return total


def gains(documents: np.ndarray, target: np.ndarray) -> np.ndarray:
    share = (target + 1.0) * float(documents.sum() + BUCKETS) / ((documents + 1.0) * float(target.sum() + BUCKETS))
    return np.floor(1000 * np.log(share)).astype(np.int64)


def weigh(text: Column, gain: np.ndarray) -> Column:
    """struct<n_words, n_features, weight> of a text column; gain has a number for each bucket."""

    def make():
        def work(texts):
            totals = np.zeros((3, len(texts)), dtype=np.int64)
            if texts:
                for text_of, buckets, are_words in batch_features(texts):
                    n = np.bincount(text_of, minlength=len(texts))
                    totals[0] += n if are_words else 0
                    totals[1] += n
                    # Sums of whole numbers, exact in doubles.
                    totals[2] += np.bincount(text_of, gain[buckets], minlength=len(texts)).astype(np.int64)
            n_words, n_features, summed = totals
            return pa.StructArray.from_arrays(
                [pa.array(n_words), pa.array(n_features), pa.array(summed // np.maximum(n_features, 1))],
                names=["n_words", "n_features", "weight"],
            )

        return work

    return text_function(make, "struct<n_words:bigint,n_features:bigint,weight:bigint>", "weigh")(text)


def noise(id_column: Column, seed=SEED) -> Column:
    """Gumbel noise in thousandths, rounded down, from the first 32 bits of the digest of seed and id."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(id_column.cast("string"), F.lit("")))
    high = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((high + 0.5) / F.lit(4294967296.0))))


def resample(
    docs: DataFrame, target: DataFrame, id_col="doc_id", text_col="text", target_col="text",
    percent=PERCENT, least_words=LEAST_WORDS, seed=SEED,
) -> DataFrame:
    """(id, n_words, n_features, weight, score, rank), a row per row of docs; rank is null for rows not drawn.

    Drawn are `percent` % of the rows with at least `least_words` words.
    """
    gain = gains(bucket_counts(docs, text_col), bucket_counts(target, target_col))
    weighed = docs.select(F.col(id_col).alias("id"), weigh(F.col(text_col), gain).alias("w")).select("id", "w.*")
    weighed = weighed.withColumn("score", F.col("weight") + noise(F.col("id"), seed))
    weighed = stored(weighed.withColumn("row", F.monotonically_increasing_id()), "weighed")
    able = F.col("n_words") >= least_words
    ordered = numbered(weighed.where(able).withColumn("falling", -F.col("score")), [], ["falling", "id", "row"], "ordered")
    drawn = F.col("place") < F.floor(F.col("total") * percent / 100)
    columns = [F.col("id").alias(id_col), "n_words", "n_features", "weight", "score"]
    ranked = ordered.select(*columns, F.when(drawn, F.col("place") + 1).alias("rank"))
    return ranked.unionByName(weighed.where(~able).select(*columns, F.lit(None).cast("long").alias("rank")))
