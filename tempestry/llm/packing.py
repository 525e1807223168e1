"""Cost-balanced packing of token sequences.

A document's ids, an end id last, are cut into pieces of `width` tokens, which fill sequences alone, and a
shorter tail. A piece of n tokens costs linear * n + quadratic * n * n, as attention stays within a piece.
Tails go, longest first, each to the sequence of lowest cost that still has room for it, among as many
sequences as all tails' tokens need; when none has room, the piece is cut to fill the roomiest one and its rest
takes its turn by its own length. So all padding together is less than one sequence.

As equal lengths cost the same, the assignment depends on how many tails have each length, at most width - 1
numbers. The driver makes it for ranges of ranks within a length and ranges of sequences; executors number the
tails of a length (in salted groups, so that a frequent length is no single task) and look their place up.

Null and empty texts are the end id alone. Repeated rows are packed each on its own; null ids are kept. An
empty table gives no rows. Token tables are written once to the shared folder, so texts are encoded once.
"""

import bisect
import heapq
import zlib
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tempestry.llm.byte_bpe import byte_bpe
from tempestry.llm.common import stored, text_function

WIDTH = 1024
LINEAR, QUADRATIC = 1.0, 1 / 512
SALTS = 64
TOKENS = "struct<doc_tokens:bigint,full_crcs:array<bigint>,tail:binary>"
PIECES = "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def crc(ids):
    return zlib.crc32(ids.astype("<u4").tobytes())


def tokenised(docs: DataFrame, path: str, width: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, doc_tokens, full_crcs, tail): what later steps need of each document's ids."""

    def make():
        bpe = byte_bpe(path)

        def work(texts):
            rows = []
            for text in texts:
                ids = np.frombuffer(bpe.encode(text.decode() if text else None), bpe.dtype).astype("<u4")
                ids = np.append(ids, np.uint32(0))
                full = len(ids) // width
                small = ids[full * width :].astype(bpe.dtype)
                crcs = [crc(ids[i * width : (i + 1) * width]) for i in range(full)]
                rows.append({"doc_tokens": len(ids), "full_crcs": crcs, "tail": small.tobytes()})
            kind = pa.struct(
                [("doc_tokens", pa.int64()), ("full_crcs", pa.list_(pa.int64())), ("tail", pa.binary())]
            )
            return pa.array(rows, kind)

        return work

    tokens = text_function(make, TOKENS, "tokenise")(F.col(text_col))
    return docs.select(F.col(id_col), tokens.alias("t")).select(id_col, "t.*")


class Sequences:
    """Ranges of sequences with equal content, found by cost among those with room."""

    def __init__(self, width, count):
        self.width = width
        self.heaps = [[] for _ in range(width + 1)]
        self.lowest = np.full(width + 1, np.inf)
        self.put(0, 0.0, 0, count)

    def put(self, fill, cost, first, count):
        if count:
            heapq.heappush(self.heaps[fill], (cost, first, count))
            self.lowest[fill] = self.heaps[fill][0][0]

    def take(self, length, count):
        """(fill, cost, first, count) of lowest-cost sequences with room for length, at most count; or None."""
        fill = int(np.argmin(self.lowest[: self.width - length + 1]))
        if self.lowest[fill] == np.inf:
            return None
        cost, first, there = heapq.heappop(self.heaps[fill])
        self.lowest[fill] = self.heaps[fill][0][0] if self.heaps[fill] else np.inf
        used = min(there, count)
        self.put(fill, cost, first + used, there - used)
        return fill, cost, first, used

    def room(self):
        """The largest room that any sequence has."""
        return self.width - int(np.flatnonzero(self.lowest < np.inf)[0])


def balance(counts, width=WIDTH, linear=LINEAR, quadratic=QUADRATIC):
    """Where tails go. counts: {length: number of tails}.

    Rows (tail length, first rank, ranks, start in the tail, piece length, first sequence, offset): the ranks
    from the first on go to the sequences from the first on. Rows cover each tail completely.
    """
    total = sum(length * n for length, n in counts.items())
    sequences = Sequences(width, -(-total // width))
    todo = {length: [(length, 0, n, 0)] for length, n in counts.items() if n}
    plan = []
    for length in range(width, 0, -1):
        for tail, rank, n, start in todo.pop(length, ()):
            while n:
                piece = length
                found = sequences.take(piece, n)
                if found is None:
                    piece = sequences.room()
                    found = sequences.take(piece, n)
                fill, cost, first, used = found
                plan.append((tail, rank, used, start, piece, first, fill))
                sequences.put(fill + piece, cost + linear * piece + quadratic * piece * piece, first, used)
                if piece < length:
                    todo.setdefault(length - piece, []).append((tail, rank, used, start + piece))
                rank, n = rank + used, n - used
    return plan


def pack(docs: DataFrame, path: str, width=WIDTH, id_col="doc_id", text_col="text", linear=LINEAR, quadratic=QUADRATIC):
    """One row per piece: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset)."""
    # Drawn by the row's place too: rows of one id, or without any, would all get one salt.
    salt = F.pmod(F.xxhash64(F.col(id_col), F.monotonically_increasing_id()), F.lit(SALTS)).cast("int")
    tokens = stored(tokenised(docs, path, width, id_col, text_col).withColumn("_salt", salt), "tokens")
    dtype = byte_bpe(path).dtype
    tail_length = (F.length("tail") / F.lit(dtype.itemsize)).cast("int")
    keyed = tokens.select(id_col, "doc_tokens", "full_crcs", "tail", tail_length.alias("_tail"), "_salt")
    groups = keyed.groupBy("_tail", "_salt").agg(
        F.count(F.lit(1)).alias("docs"), F.sum(F.size("full_crcs")).alias("full")
    )
    # At most width * SALTS rows of counts, whatever the number of documents.
    table = groups.orderBy("_tail", "_salt").toArrow().to_pydict()
    counts, rank_before, full_before, full = {}, {}, {}, 0
    for tail, salt_at, n, pieces in zip(table["_tail"], table["_salt"], table["docs"], table["full"]):
        rank_before[tail, salt_at] = counts.get(tail, 0)
        full_before[tail, salt_at] = full
        counts[tail] = counts.get(tail, 0) + n
        full += pieces
    counts.pop(0, None)
    plan = {}
    for tail, rank, n, start, piece, first, offset in sorted(balance(counts, width, linear, quadratic)):
        plan.setdefault((tail, start), []).append((rank, n, piece, first, offset))
    starts = {}
    for tail, start in sorted(plan):
        starts.setdefault(tail, []).append(start)
    ranks = {key: [row[0] for row in rows] for key, rows in plan.items()}

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {name: [] for name in ("id", *(c.split(" ")[0] for c in PIECES.split(", ")))}
            add = [c.append for c in columns.values()]
            ids = batch.column(0)
            source = []
            rest = [batch.column(i).to_pylist() for i in range(1, batch.num_columns)]
            for row, (doc_tokens, crcs, tail, tail_n, salt_at, rank, full_at) in enumerate(zip(*rest)):
                found = [
                    (i * width, width, c, doc_tokens, full_before[tail_n, salt_at] + full_at + i, 0)
                    for i, c in enumerate(crcs)
                ]
                rank += rank_before[tail_n, salt_at]
                small = np.frombuffer(tail, dtype)
                for start in starts.get(tail_n, ()):
                    at = bisect.bisect_right(ranks[tail_n, start], rank) - 1
                    if at < 0:
                        continue
                    low, n, piece, first, offset = plan[tail_n, start][at]
                    if rank < low + n:
                        sequence = full + first + rank - low
                        found.append(
                            (
                                len(crcs) * width + start,
                                piece,
                                crc(small[start : start + piece]),
                                doc_tokens,
                                sequence,
                                offset,
                            )
                        )
                for values in found:
                    source.append(row)
                    for put, value in zip(add[1:], values):
                        put(value)
            del columns["id"]
            arrays = [ids.take(pa.array(source, pa.int64())), *(pa.array(c, pa.int64()) for c in columns.values())]
            yield pa.RecordBatch.from_arrays(arrays, names=[id_col, *columns])

    order = Window.partitionBy("_tail", "_salt").orderBy(id_col, "doc_tokens", "full_crcs", "tail")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    ranked = keyed.withColumns(
        {
            "_rank": F.row_number().over(order) - 1,
            "_full": F.coalesce(F.sum(F.size("full_crcs")).over(before), F.lit(0)),
        }
    )
    kind = dict(docs.dtypes)[id_col]
    return ranked.mapInArrow(places, f"`{id_col}` {kind}, {PIECES}")
