"""Language-model scores by context-tree weighting over bytes.

A byte is coded as eight binary decisions. Each decision sits in a tree of contexts, the last 0 to `depth` bytes;
every context node keeps a Krichevsky-Trofimov estimate, and a node's weighted probability is the even mixture
of its own estimate and its children's product. The trees are built from all training texts and then scored
with: the probability of a byte is the mixture over all depths along its context path. A text is its bytes with
A to Z in lower case and one end byte (0); before it stand zero bytes as context. Null texts count as empty.

How it is spread out: texts are hashed with their ids into blocks of about equal size; only repeated rows
of equal id and text must share one. A block's different contexts-with-byte and words, with their training counts, go in packed sorted runs to buckets (by the last two context bytes, or
the word). A bucket holds whole subtrees, so it builds its part of the trees; only the nodes of the last byte
and the root, at most 257 * 255, pass through the driver. Each bucket then answers every block's entries with
their log-probability, and blocks score their texts from the answers. What is gathered grows with the corpus.

Repeated rows are counted and scored each; a null id is trained and scored as the empty id. Empty tables give
no rows; without training texts every byte has probability 1/256.
"""

import math
import zlib
from collections import Counter
from itertools import groupby
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempestry.llm.common import crc_bucket, shuffle_partitions, stored

DEPTH = 5
BLOCK_BYTES = 12_000_000
PART = "kind string, block int, bucket int, entries binary, counts binary"
PART_TYPE = pa.schema(
    [("kind", pa.string()), ("block", pa.int32()), ("bucket", pa.int32()), ("entries", pa.binary()), ("counts", pa.binary())]
)
BYTES_AT_ONCE = 2_000_000
HALF = math.log(0.5)


def log_gamma(z):
    """ln Γ(z) for z > 0, by Stirling's series after a shift by eight."""
    shifted = z + 8.0
    product = np.ones_like(shifted)
    for i in range(8):
        product *= z + i
    inverse = 1.0 / shifted
    square = inverse * inverse
    series = inverse * (1 / 12 - square * (1 / 360 - square * (1 / 1260 - square / 1680)))
    return (shifted - 0.5) * np.log(shifted) - shifted + 0.5 * math.log(2 * math.pi) + series - np.log(product)


def log_estimate(zeros, ones):
    """Log of the Krichevsky-Trofimov probability of that many zeros and ones."""
    total = log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1.0)
    return total - math.log(math.pi)


def contexts(texts, depth):
    """(keys, texts' bounds): per coded byte its context, last byte first, then the byte itself, as a number."""
    pad = bytes(depth)
    stream = np.frombuffer(b"".join([pad + t + b"\0" for t in texts]), np.uint8).astype(np.uint64)
    sizes = np.array([len(t) + 1 for t in texts], dtype=np.int64)
    begins = np.cumsum(sizes + depth) - sizes
    ends = np.cumsum(sizes)
    at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(begins - (ends - sizes), sizes)
    keys = stream[at]
    for back in range(1, depth + 1):
        keys |= stream[at - back] << np.uint64(8 * (depth + 1 - back))
    return keys, ends - sizes


def portions(texts, limit=BYTES_AT_ONCE):
    """Runs of texts of about so many bytes."""
    some, size = [], 0
    for text in texts:
        some.append(text)
        size += len(text)
        if size >= limit:
            yield some
            some, size = [], 0
    if some:
        yield some


class Tally:
    """Different keys of a block with their training counts, as sorted runs that are merged now and then."""

    def __init__(self):
        self.runs, self.size = [], 0

    def add(self, keys, counts):
        self.runs.append((keys, counts))
        self.size += len(keys)
        if self.size > 4_000_000:
            self.merged()

    def merged(self):
        if not self.runs:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        keys = np.concatenate([k for k, _ in self.runs])
        counts = np.concatenate([c for _, c in self.runs])
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        self.runs = [(keys[first], np.add.reduceat(counts, first))]
        self.size = len(first)
        return self.runs[0]


class Subtrees:
    """The parts of all trees below contexts of two bytes, for sorted keys with training counts."""

    def __init__(self, keys, counts, depth):
        self.keys, self.depth = keys, depth
        level, n, index = keys, counts.astype(np.float64), np.arange(len(keys))
        self.inside, child = None, None
        for d in range(depth, 1, -1):
            if d < depth:
                shorter = (level >> np.uint64(16) << np.uint64(8)) | (level & np.uint64(255))
                level, up = np.unique(shorter, return_inverse=True)
                n = np.bincount(up, weights=n, minlength=len(level))
                index = up[index]
            nodes, predicted = [], np.empty((8, len(keys)))
            for j in range(8):
                prefix = level >> np.uint64(8 - j)
                first = np.flatnonzero(np.r_[True, prefix[1:] != prefix[:-1]])
                run = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(level)]))
                bit = (level >> np.uint64(7 - j)) & np.uint64(1)
                total, ones = np.add.reduceat(n, first), np.add.reduceat(n * bit, first)
                own = log_estimate(total - ones, ones)
                weighted, share = own, None
                if child is not None:
                    below_first, below = child[j]
                    product = np.bincount(run[up[below_first]], weights=below, minlength=len(first))
                    weighted = np.logaddexp(HALF + own, HALF + product)
                    share = np.exp(HALF + own - weighted)
                here = (np.where(bit == 1, ones[run], (total - ones)[run]) + 0.5) / (total[run] + 1.0)
                predicted[j] = here[index]
                if share is not None:
                    at = share[run][index]
                    predicted[j] = at * predicted[j] + (1 - at) * self.inside[j]
                nodes.append((first, weighted, total - ones, ones))
            self.inside, child = predicted, [(first, weighted) for first, weighted, *_ in nodes]
        self.level, self.nodes = level, nodes

    def top_nodes(self):
        """(context of two bytes, decision, zeros, ones, log of the weighted probability)."""
        found = []
        for j, (first, weighted, zeros, ones) in enumerate(self.nodes):
            key = self.level[first].astype(np.int64)
            decision = (1 << j) | ((key & 255) >> (8 - j))
            found.append((key >> 8, decision, zeros, ones, weighted))
        return [np.concatenate(c) for c in zip(*found)]

    def log_probabilities(self, top):
        """Natural logarithm of each key's byte given its context, mixed over all depths."""
        byte = (self.keys & np.uint64(255)).astype(np.int64)
        last = (self.keys >> np.uint64(8 * self.depth)).astype(np.int64)
        total = np.zeros(len(self.keys))
        for j in range(8):
            decision, bit = (1 << j) | (byte >> (8 - j)), (byte >> (7 - j)) & 1
            mixed = self.inside[j]
            for row in (last + 1, 0):
                share, one = top[0][row, decision], top[1][row, decision]
                mixed = share * np.where(bit == 1, one, 1 - one) + (1 - share) * mixed
            total += np.log(mixed)
        return total


def top_tables(context, decision, zeros, ones, product):
    """Mixing shares and estimates of a one: row 0 for the root, row 1 + b for the context of one byte b."""
    n = np.zeros((2, 257, 256))
    below = np.zeros((257, 256))
    rows = np.asarray(context) + 1
    n[0][rows, decision], n[1][rows, decision], below[rows, decision] = zeros, ones, product
    n[:, 0] = n[:, 1:].sum(axis=1)
    own = log_estimate(n[0], n[1])
    weighted = np.logaddexp(HALF + own, HALF + below)
    below[0] = weighted[1:].sum(axis=0)
    weighted[0] = np.logaddexp(HALF + own[0], HALF + below[0])
    return np.exp(HALF + own - weighted), (n[1] + 0.5) / (n[0] + n[1] + 1.0)


def pack_sorted(numbers):
    """Sorted unsigned numbers as compressed differences."""
    return zlib.compress(np.diff(numbers, prepend=numbers[:0].dtype.type(0)).tobytes(), 1)


def unpack_sorted(data):
    return np.cumsum(np.frombuffer(zlib.decompress(data), np.uint64), dtype=np.uint64)


def pack_counts(counts):
    return zlib.compress(counts.astype(np.int64).tobytes(), 1)


def unpack_counts(data):
    return np.frombuffer(zlib.decompress(data), np.int64)


def pack_words(words):
    return zlib.compress(b" ".join(words), 1)


def unpack_words(data):
    return zlib.decompress(data).split(b" ")


def block_parts(block, words, tally, buckets):
    """Packed runs of a block's words and keys, by bucket."""
    by_bucket = [[] for _ in range(buckets)]
    for word in words:
        by_bucket[zlib.crc32(word) % buckets].append(word)
    for bucket, some in enumerate(by_bucket):
        if some:
            some.sort()
            counts = np.fromiter(map(words.__getitem__, some), np.int64, len(some))
            yield "word", block, bucket, pack_words(some), pack_counts(counts)
    keys, counts = tally.merged()
    pair = (keys >> np.uint64(8 * (DEPTH - 1))).astype(np.int64)
    bucket_of = (pair * 40503 & 0xFFFF) * buckets >> 16
    order = np.argsort(bucket_of, kind="stable")
    bounds = np.searchsorted(bucket_of[order], np.arange(buckets + 1))
    for bucket in range(buckets):
        some = order[bounds[bucket] : bounds[bucket + 1]]
        if len(some):
            yield "key", block, bucket, pack_sorted(keys[some]), pack_counts(counts[some])


def part_batch(rows):
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), PART_TYPE)], schema=PART_TYPE)


def streamed(batches):
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def collect_parts(buckets, depth=DEPTH):
    """Rows (block, training, text) in the order of blocks to packed parts of each block."""

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, rows in groupby(streamed(batches), key=lambda row: row[0]):
            words, tally, fed = Counter(), Tally(), ([], [])
            sizes = [0, 0]

            def feed(training):
                if fed[training]:
                    keys, counts = np.unique(contexts(fed[training], depth)[0], return_counts=True)
                    tally.add(keys, counts if training else np.zeros_like(counts))
                    fed[training].clear()
                    sizes[training] = 0

            for _, training, text in rows:
                text = (text or b"").lower()
                if training:
                    words.update(text.split())
                else:
                    words.update(dict.fromkeys(text.split(), 0))
                fed[training].append(text)
                sizes[training] += len(text)
                if sizes[training] > BYTES_AT_ONCE:
                    feed(training)
            feed(0)
            feed(1)
            yield part_batch(list(block_parts(block, words, tally, buckets)) or [("word", block, 0, pack_words([]), pack_counts(np.zeros(1)))])

    return collect


def merged_keys(rows):
    tally = Tally()
    for row in rows:
        tally.add(unpack_sorted(row[3]), unpack_counts(row[4]))
    return tally.merged()


def merged_words(rows):
    counts = Counter()
    for row in rows:
        for word, n in zip(unpack_words(row[3]), unpack_counts(row[4]).tolist()):
            counts[word] += n
    return counts


def by_bucket(batches):
    """(kind, rows) of each bucket; rows sorted by kind and bucket come in."""
    for (kind, _), rows in groupby(streamed(batches), key=lambda row: (row[0], row[2])):
        yield kind, list(rows)


def block_of(id_column: Column, text: Column, blocks: int) -> Column:
    """The block of a row. The text takes part: rows of one id, or without one, would fill a block."""
    return F.pmod(F.xxhash64(F.coalesce(id_column.cast("string"), F.lit("")), text), F.lit(blocks)).cast("int")


def score_texts(
    docs: DataFrame, training: Column, id_col="doc_id", text_col="text", depth=DEPTH, block_bytes=BLOCK_BYTES
) -> DataFrame:
    """One row per document: id, training, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    score: log10 probability of the text by the context trees; base_score: by smoothed counts of words and ends.
    """
    if depth != DEPTH:
        raise ValueError(f"keys are laid out for depth {DEPTH}")
    spark = docs.sparkSession
    rows = docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"), training.cast("int").alias("training")
    )
    size = rows.agg(F.sum(F.length("text") + 1)).first()[0] or 1
    blocks = max(1, -(-size // block_bytes))
    buckets = min(max(shuffle_partitions(spark), 4), 2048)
    rows = rows.withColumn("block", block_of(F.col("id"), F.col("text"), blocks))
    width = min(blocks, 4 * shuffle_partitions(spark))
    ordered = rows.select("block", "training", "text").repartition(width, "block").sortWithinPartitions("block")
    parts = stored(ordered.mapInArrow(collect_parts(buckets), PART), "context-parts")
    packed = parts.repartition(buckets, "bucket").sortWithinPartitions("kind", "bucket")

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for kind, found in by_bucket(batches):
            if kind == "key":
                columns = Subtrees(*merged_keys(found), DEPTH).top_nodes()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c.astype(t)) for c, t in zip(columns, "i4 i4 f8 f8 f8".split())],
                    names=["context", "decision", "zeros", "ones", "weighted"],
                )
            else:
                words = merged_words(found)
                words.pop(b"", None)
                # Totals of the words travel as a row of context -1: tokens and different tokens of training texts.
                known = [n for n in words.values() if n]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([-1], "int32"), pa.array([0], "int32"), *(pa.array([float(x)]) for x in (sum(known), len(known), 0))],
                    names=["context", "decision", "zeros", "ones", "weighted"],
                )

    node_type = "context int, decision int, zeros double, ones double, weighted double"
    last = F.when(F.col("context") < 0, -1).otherwise(F.shiftright("context", 8)).alias("last")
    tops = packed.mapInArrow(nodes, node_type).groupBy(last, "decision")
    tops = tops.agg(*[F.sum(c).alias(c) for c in ("zeros", "ones", "weighted")]).toArrow()
    tops = {name: tops[name].to_numpy() for name in tops.column_names}
    words = tops["last"] < 0
    ends = rows.where("training = 1").count()
    tokens = int(tops["zeros"][words].sum()) + ends
    different = int(tops["ones"][words].sum()) + (ends > 0)
    top = top_tables(*(tops[c][~words] for c in ("last", "decision", "zeros", "ones", "weighted")))

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for kind, found in by_bucket(batches):
            if kind == "key":
                keys, counts = merged_keys(found)
                value = Subtrees(keys, counts, DEPTH).log_probabilities(top) / math.log(10)
                for row in found:
                    own = value[np.searchsorted(keys, unpack_sorted(row[3]))]
                    yield part_batch([(kind, row[1], row[2], row[3], own.tobytes())])
            else:
                counts = merged_words(found)
                for row in found:
                    own = np.array([counts[w] for w in unpack_words(row[3])])
                    yield part_batch([(kind, row[1], row[2], row[3], pack_counts(own))])

    answers = packed.mapInArrow(answer, PART)
    scale = math.log10(tokens + 0.1 * (different + 1))
    end = math.log10(ends + 0.1)

    def score(texts: pa.Table, found: pa.Table) -> pa.Table:
        keys, values, words = [np.empty(0, np.uint64)], [np.empty(0)], {}
        for kind, entries, numbers in zip(*(found[c].to_pylist() for c in ("kind", "entries", "counts"))):
            if kind == "key":
                keys.append(unpack_sorted(entries))
                values.append(np.frombuffer(numbers))
            else:
                words.update(zip(unpack_words(entries), np.log10(unpack_counts(numbers) + 0.1).tolist()))
        keys, values = np.concatenate(keys), np.concatenate(values)
        order = np.argsort(keys)
        keys, values = keys[order], values[order]
        out = {name: [] for name in ("n_tokens", "n_known", "base_score", "score", "bits_per_byte")}
        for some in portions(t.lower() for t in texts["text"].to_pylist()):
            coded, begins = contexts(some, DEPTH)
            scores = np.add.reduceat(values[np.searchsorted(keys, coded)], begins)
            for text, total in zip(some, scores.tolist()):
                own = np.array(list(map(words.__getitem__, text.split())))
                out["n_tokens"].append(len(own) + 1)
                out["n_known"].append(int((own > -0.9).sum()) + (ends > 0))
                out["base_score"].append(float(own.sum()) + end - (len(own) + 1) * scale)
                out["score"].append(total)
                out["bits_per_byte"].append(-total / math.log10(2) / (len(text) + 1))
        columns = {"id": texts["id"], "training": texts["training"], "train_tokens": pa.array([tokens] * len(texts), pa.int64())}
        columns |= {n: pa.array(v, pa.int64() if n[0] == "n" else pa.float64()) for n, v in out.items()}
        return pa.table(columns)

    kind = dict(rows.dtypes)["id"]
    result = (
        f"id {kind}, training int, train_tokens bigint, n_tokens bigint, n_known bigint, base_score double,"
        " score double, bits_per_byte double"
    )
    scored = rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, result)
    return scored.select(
        F.col("id").alias(id_col), (F.col("training") == 1).alias("training"), "n_tokens", "n_known", "train_tokens",
        "base_score", "score", "bits_per_byte",
    )


def held_out(id_column: Column) -> Column:
    return crc_bucket(id_column, 10) == 0
