"""Document frequencies of words, counted in each task before anything is shuffled."""

import zlib
from collections import Counter
from itertools import groupby
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempestry.llm.common import shuffle_partitions

WORDS_AT_ONCE = 500_000
PACKED = pa.schema([("bucket", pa.int32()), ("words", pa.binary()), ("counts", pa.binary())])


def words_of(data):
    """Words of UTF-8 bytes: runs outside ASCII white space, A to Z in lower case."""
    return data.lower().split()


def packed(counts, buckets):
    """A batch with one row per bucket: its words, space-joined, and their counts."""
    some = [[] for _ in range(buckets)]
    for word in counts:
        some[zlib.crc32(word) % buckets].append(word)
    rows = [
        (bucket, b" ".join(words), np.fromiter(map(counts.__getitem__, words), np.int64, len(words)).tobytes())
        for bucket, words in enumerate(some)
        if words
    ]
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), PACKED)], schema=PACKED)


def document_frequencies(docs: DataFrame, text_col: str, least: float, most: float) -> DataFrame:
    """(word binary, documents bigint) for words in least to most documents. Null texts have no words."""
    buckets = min(max(shuffle_partitions(docs.sparkSession), 4), 2048)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counter()
        for batch in batches:
            for data in batch.column(0).to_pylist():
                counts.update(set(words_of(data)))
                if len(counts) > WORDS_AT_ONCE:
                    yield packed(counts, buckets)
                    counts.clear()
        if counts:
            yield packed(counts, buckets)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
        for _, some in groupby(rows, key=lambda row: row[0]):
            counts = Counter()
            for _, words, numbers in some:
                for word, n in zip(words.split(b" "), np.frombuffer(numbers, np.int64).tolist()):
                    counts[word] += n
            kept = [(w, n) for w, n in counts.items() if least <= n <= most]
            yield pa.RecordBatch.from_arrays(
                [pa.array([w for w, _ in kept], pa.binary()), pa.array([n for _, n in kept], pa.int64())],
                names=["word", "documents"],
            )

    texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    parts = texts.mapInArrow(count, "bucket int, words binary, counts binary")
    parts = parts.repartition(buckets, "bucket").sortWithinPartitions("bucket")
    return parts.mapInArrow(total, "word binary, documents bigint")
