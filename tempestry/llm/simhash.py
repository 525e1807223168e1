"""SimHash near-duplicates with pivot distance tables.

The fingerprint of a text is the bitwise majority of the XXH64 hashes (seed 42) of its 4-word shingles, repeats
included; a tie gives 0. Two fingerprints are linked when at most `distance` (4) of the 64 bits differ.

Search: two linked fingerprints agree on at least two of six blocks of bits, so each different fingerprint is
put under the 15 pairs of blocks, and only fingerprints under one key are compared. There, the table of Hamming
distances to the reference fingerprints (pivots) discards pairs: distances to any pivot of linked fingerprints
differ by at most 4. The survivors are verified on all bits. Under a crowded key, members become pivots too: all
within 4 of such a leader are linked to it at once, and only members of different components within 8 of a
leader remain to be compared. So a crowd of near copies gives links in proportion to its size, and no link between
components is lost. Components come from alternating large-star and small-star steps on distributed tables.

Null and empty texts have fingerprint 0, which is linked like any other. Documents with a null id take part and
get their component's smallest id, null if it has none. Repeated rows get equal results. An empty table gives no
rows. Words are runs outside ASCII white space; A to Z are lower-cased. Very long texts are read whole, their shingles hashed
a bounded number at a time. Extra columns, whatever their names, are passed on by `keep_one`.
"""

from itertools import combinations
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempestry.llm.common import shuffle_partitions, stored, text_function

SHINGLE, SEED, DISTANCE = 4, 42, 4
#: Bounds of six blocks of bits.
BLOCKS = (0, 11, 22, 33, 44, 54, 64)
#: A key with more fingerprints than this is searched by leaders.
CROWD = 24
HASHES_AT_ONCE = 1 << 15


def pivot_fingerprints(count=16):
    """Reference fingerprints: fixed pseudo-random numbers, the same in every task."""
    return np.random.default_rng(SEED).integers(0, 2**64, count, dtype=np.uint64)


def majority(data):
    """The fingerprint of a UTF-8 text, as a signed number."""
    from xxhash import xxh64_digest

    words = data.lower().split()
    if not words:
        return 0
    last = len(words) - SHINGLE
    if last < 0:
        shingles = [b" ".join(words)]
    else:
        shingles = list(map(b" ".join, zip(*(words[i : last + 1 + i] for i in range(SHINGLE)))))
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(shingles), HASHES_AT_ONCE):
        digests = b"".join([xxh64_digest(s, SEED) for s in shingles[i : i + HASHES_AT_ONCE]])
        bits = np.unpackbits(np.frombuffer(digests, np.uint8)).reshape(-1, 64)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(shingles)).tobytes(), "big", signed=True)


def fingerprint(text: Column) -> Column:
    """The fingerprint of a text column, as a signed 64-bit number."""

    def make():
        def work(texts):
            return pa.array([majority(t) if t else 0 for t in texts], pa.int64())

        return work

    return text_function(make, "bigint", "fingerprint")(text)


def differing(a, b):
    return np.bitwise_count(a ^ b)


def small_links(key, prints, distances, distance):
    """Index pairs of linked fingerprints under equal keys: neighbours 1, 2, ... apart, pivots first."""
    step, found = 1, []
    while step < len(prints):
        same = np.flatnonzero(key[step:] == key[:-step])
        if not len(same):
            break
        gap = np.abs(distances[same].astype(np.int8) - distances[same + step].astype(np.int8)).max(axis=1)
        same = same[gap <= distance]
        same = same[differing(prints[same], prints[same + step]) <= distance]
        found.append(np.column_stack([same, same + step]))
        step += 1
    return np.concatenate(found) if found else np.empty((0, 2), dtype=np.int64)


class Union:
    def __init__(self, n):
        self.parent = list(range(n))

    def root(self, x):
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def join(self, a, b):
        a, b = self.root(a), self.root(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)
        return a != b


def crowd_links(prints, distances, distance):
    """Index pairs that link the same components as all linked pairs of one crowded key do."""
    n, found = len(prints), []
    union, open_members, leaders = Union(n), np.ones(n, dtype=bool), []
    while open_members.any():
        leader = int(np.argmax(open_members))
        apart = differing(prints, prints[leader])
        near = np.flatnonzero(apart <= distance)
        open_members[near] = False
        leaders.append(leader)
        found += [(leader, int(x)) for x in near if union.join(leader, int(x))]
    for leader in leaders:
        apart = differing(prints, prints[leader])
        around = np.flatnonzero((apart > distance) & (apart <= 2 * distance))
        own = union.root(leader)
        around = around[[union.root(int(x)) != own for x in around]] if len(around) else around
        if not len(around):
            continue
        for member in np.flatnonzero(apart <= distance):
            gap = np.abs(distances[around].astype(np.int8) - distances[member].astype(np.int8)).max(axis=1)
            close = around[gap <= distance]
            close = close[differing(prints[close], prints[member]) <= distance]
            found += [(int(member), int(x)) for x in close if union.join(int(member), int(x))]
    return np.array(found, dtype=np.int64).reshape(-1, 2)


def block_bits(block):
    return (1 << BLOCKS[block + 1]) - (1 << BLOCKS[block])


def links(prints: DataFrame, distance=DISTANCE) -> DataFrame:
    """(u, v), u > v: links between different fingerprints (column fp) that connect all linked ones."""
    masks = []
    for first, second in combinations(range(len(BLOCKS) - 1), 2):
        mask = block_bits(first) | block_bits(second)
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
    keys = [F.struct(F.lit(k).alias("part"), F.col("fp").bitwiseAND(F.lit(m)).alias("bits")) for k, m in enumerate(masks)]
    keyed = prints.select("fp", F.explode(F.array(*keys)).alias("key")).select("fp", "key.*")
    pivots = pivot_fingerprints()

    def search(part, bits, fps):
        """Linked fingerprints of rows sorted by key; whole keys only."""
        begins = np.flatnonzero(np.r_[True, (part[1:] != part[:-1]) | (bits[1:] != bits[:-1])])
        sizes = np.diff(np.r_[begins, len(part)])
        run = np.repeat(np.arange(len(begins)), sizes)
        shared = np.flatnonzero((sizes > 1)[run])
        run, prints_ = run[shared], fps[shared].view(np.uint64)
        distances = np.bitwise_count(prints_[:, None] ^ pivots[None, :])
        small = (sizes <= CROWD)[run]
        where = np.flatnonzero(small)
        pairs = [where[small_links(run[where], prints_[where], distances[where], distance)]]
        for crowd in np.flatnonzero(sizes > CROWD):
            where = np.flatnonzero(run == crowd)
            pairs.append(where[crowd_links(prints_[where], distances[where], distance)])
        pairs = np.concatenate(pairs).reshape(-1, 2)
        ends = fps[shared][pairs]
        return ends.max(axis=1), ends.min(axis=1)

    def search_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            rows = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)])
            rows = rows if held is None else np.concatenate([held, rows])
            # The last key may go on in the next batch.
            cut = int(np.flatnonzero(np.r_[True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1)])[-1]) if len(rows) else 0
            held = rows[cut:]
            if cut:
                u, v = search(rows[:cut, 0], rows[:cut, 1], np.ascontiguousarray(rows[:cut, 2]))
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])
        if held is not None and len(held):
            u, v = search(held[:, 0], held[:, 1], np.ascontiguousarray(held[:, 2]))
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    by_key = keyed.repartition(shuffle_partitions(prints.sparkSession), "part", "bits")
    by_key = by_key.sortWithinPartitions("part", "bits", "fp").select(F.col("part").cast("long"), "bits", "fp")
    return by_key.mapInArrow(search_sorted, "u bigint, v bigint").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each node's component, for nodes with a link.

    Alternates two steps until nothing changes: every node's larger neighbours are linked to its smallest
    neighbour, then its smaller ones. Each round is checkpointed.
    """
    edges = edges.checkpoint()
    before = None
    while True:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("low"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v"))
        large = large.where("u != v").distinct().checkpoint()
        low = large.groupBy("u").agg(F.min("v").alias("low"))
        moved = large.join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v")).where("u != v")
        edges = moved.unionAll(low.select("u", F.col("low").alias("v"))).distinct().checkpoint()
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state


def classes(prints: DataFrame, id_col="doc_id", distance=DISTANCE, edges=None) -> DataFrame:
    """(fp, root, component_id) of a table (id, fp): each fingerprint's component and the smallest id in it.

    edges: links (u, v) found in another way.
    """
    groups = prints.groupBy("fp").agg(F.min(id_col).alias("smallest"))
    if edges is None:
        edges = stored(links(groups.select("fp"), distance), "links")
    roots = components(edges)
    rooted = groups.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", "smallest", F.coalesce("root", "fp").alias("root")
    )
    # Only the components of several fingerprints are brought together; they are few rows of links.
    own = roots.select(F.col("root").alias("fp"), "root").distinct()
    members = groups.join(roots.select(F.col("node").alias("fp"), "root").unionAll(own), "fp")
    lowest = members.groupBy("root").agg(F.min("smallest").alias("lowest"))
    return rooted.join(lowest, "root", "left").select("fp", "root", F.coalesce("lowest", "smallest").alias("component_id"))


def near_duplicates(docs: DataFrame, id_col="doc_id", text_col="text", distance=DISTANCE) -> DataFrame:
    """(id, fingerprint, component_id), one row per input row; fingerprint as 16 hexadecimal digits."""
    prints = stored(docs.select(F.col(id_col), fingerprint(F.col(text_col)).alias("fp")), "fingerprints")
    found = prints.join(classes(prints, id_col, distance), "fp")
    return found.select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col="doc_id", text_col="text", distance=DISTANCE) -> DataFrame:
    """The rows of docs, all columns, without near-duplicates: of each component the row with the smallest id.

    A null id comes after all others. Among rows of equal id and fingerprint the first of the table stays. Rows are
    written once, and moved once more with their number alone as the key; which stay is found on narrow tables.
    """
    numbered = [F.struct("*").alias("row"), fingerprint(F.col(text_col)).alias("fp"), F.monotonically_increasing_id().alias("at")]
    marked = stored(docs.select(*numbered), "fingerprinted")
    prints = marked.select(F.col(f"row.{id_col}").alias("id"), "fp", "at")
    first = F.min(F.struct(F.col("id").isNull().alias("missing"), "id", "at")).alias("first")
    # Copies meet in one row per fingerprint, added up in each task before they are moved.
    smallest = prints.groupBy("fp").agg(first).join(classes(prints, "id", distance).select("fp", "root"), "fp")
    kept = smallest.groupBy("root").agg(F.min("first").alias("first")).select("first.at")
    return marked.join(kept, "at", "left_semi").select("row.*")
