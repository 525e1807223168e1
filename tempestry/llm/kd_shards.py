"""Shards of near-equal bytes by a k-d tree over metadata columns, in DataFrame operations only.

The tree begins with all rows. A node that is to give k shards is split along its widest dimension (its extent
as a share of the whole table's; the first listed among equals), at the weighted median: the rows below the cut get
as near floor(k / 2) / k of the node's bytes as whole rows allow. Nodes of one shard are leaves, so all shards come
within about the size of a row per level of each other.

The weighted medians of all nodes of a level are found together, without sorting or collecting rows. Each pass adds
up bytes in bins between the lowest and highest value a cut can have; the next pass looks into the bin that holds it, and
so on until that bin is one row. Rows of equal value are ordered by a digest of their id, then by their place
in the table, so a value, an id or a text that a third of all rows share is split like any other. What comes
to the driver, and what it sends back as small tables, is bounded by the number of shards.

Dimensions: numbers as they are, text by its first six UTF-8 bytes; null and NaN count as 0. The size of a row is
its text's UTF-8 bytes plus 1, so null and empty texts have size 1. Repeated rows are rows of their own. A
table of fewer rows than shards leaves shards empty; an empty table gives no rows. Further columns take no part.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempestry.llm.common import local_rows, numbered, stored

DIMENSIONS = ("doc_id", "n_chars", "source", "lang")
#: Bins of one pass, dealt among the nodes that are split in it.
BINS, LEAST_BINS = 1 << 15, 16
#: Above any value.
HIGH = 1e300
PARTS = ("value", "tie", "row")


def coordinate(name: str, kind: str) -> Column:
    """A column as a finite number that rises with it."""
    if kind == "string":
        start = F.substring(F.hex(F.encode(F.col(name), "UTF-8")), 1, 12)
        return F.coalesce(F.conv(F.rpad(start, 12, "0"), 16, 10).cast("double"), F.lit(0.0))
    number = F.col(name).cast("double")
    return F.greatest(F.least(F.coalesce(F.nanvl(number, F.lit(0.0)), F.lit(0.0)), F.lit(HIGH / 10)), F.lit(-HIGH / 10))


def id_digest(id_column: Column) -> Column:
    """52 bits of the id's digest, exact as a double."""
    return F.conv(F.substring(F.md5(F.coalesce(id_column.cast("string"), F.lit(""))), 1, 13), 16, 10).cast("double")


@dataclass
class Search:
    """Where the cut of a node is known to lie: in part `part` of (value, tie, row), between low and high.

    before: bytes of the node's rows below that; edge: the highest value of this part that is known to be left; known:
    the earlier parts.
    """

    node: int
    shards: int
    first: int
    dim: int
    total: int
    low: float
    high: float
    part: int = 0
    before: int = 0
    edge: float = -HIGH
    known: tuple = ()
    cut: tuple | None = None

    @property
    def left(self):
        return self.shards // 2

    def settle(self, *last):
        """The cut: rows up to and including it are left; parts not given are above any value."""
        self.cut = (*self.known, *last, HIGH, HIGH, HIGH)[:3]

    def narrow(self, bins):
        """Looks at the bins, (low, high, bytes, rows) in ascending order, and stays with the one that holds the cut."""
        for low, high, size, rows in bins:
            # The first bin that ends beyond the wanted bytes.
            if (self.before + size) * self.shards > self.total * self.left:
                break
            self.before, self.edge = self.before + size, high
        else:
            return self.settle(self.edge)
        if self.before * self.shards == self.total * self.left:
            return self.settle(self.edge)
        if rows == 1 or low == high and self.part == 2:
            # One row: it goes to the side that gets nearer to the wanted bytes.
            nearer = (2 * self.before + size) * self.shards <= 2 * self.total * self.left
            return self.settle(high if nearer else self.edge)
        if low == high:
            self.known, self.part = (*self.known, low), self.part + 1
            self.low, self.high, self.edge = None, None, -HIGH
        else:
            self.low, self.high = low, high


def axis_value(dims: list[str]) -> Column:
    return F.element_at(F.array(*dims), F.col("dim") + 1)


def widest(extents, whole):
    """The dimension of the largest extent as a share of the whole table's."""
    shares = [(high - low) / (top - bottom) if top > bottom else 0.0 for (low, high), (bottom, top) in zip(extents, whole)]
    return max(range(len(shares)), key=lambda d: shares[d])


def look(rows: DataFrame, searches: list[Search], dims: list[str]) -> dict[int, list]:
    """Bins of the open searches: {node: [(low, high, bytes, rows), ...]} in ascending order."""
    bins = max(LEAST_BINS, BINS // len(searches))
    spec = [
        {
            "at": s.node, "dim": s.dim, "part": s.part, "low": s.low, "high": s.high,
            "value_is": s.known[0] if s.part > 0 else None, "tie_is": s.known[1] if s.part > 1 else None,
        }
        for s in searches
    ]
    schema = "at:bigint,dim:int,part:int,low:double,high:double,value_is:double,tie_is:double"
    table = F.broadcast(local_rows(rows.sparkSession, spec, schema))
    found = rows.join(table, F.col("node") == F.col("at")).withColumn("value", axis_value(dims))
    found = found.where(F.col("value_is").isNull() | (F.col("value") == F.col("value_is")))
    found = found.where(F.col("tie_is").isNull() | (F.col("tie") == F.col("tie_is")))
    found = found.withColumn("own", F.when(F.col("part") == 0, F.col("value")).when(F.col("part") == 1, F.col("tie")).otherwise(F.col("row").cast("double")))
    found = found.where(F.col("low").isNull() | F.col("own").between(F.col("low"), F.col("high")))
    # A part that is looked at first has no bounds yet: ties are numbers below 2 ** 52, rows take their partition's bits.
    low = F.coalesce("low", F.lit(0.0))
    high = F.coalesce("high", F.when(F.col("part") == 1, F.lit(2.0**52)).otherwise(F.lit(2.0**63)))
    place = F.least(F.floor((F.col("own") - low) / (high - low) * bins), F.lit(bins - 1))
    counted = found.groupBy("node", place.alias("bin")).agg(
        F.min("own").alias("low"), F.max("own").alias("high"), F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")
    )
    out = {s.node: [] for s in searches}
    for row in sorted(counted.collect(), key=lambda r: (r["node"], r["bin"])):
        out[row["node"]].append((row["low"], row["high"], row["bytes"], row["rows"]))
    return out


def grow(rows: DataFrame, dims: list[str], shards=None, target_bytes=None):
    """(rows with the number `node` of their leaf, {node: shard}); they come with that of the root, 1."""
    extents = [f(d).alias(f"{f.__name__}_{d}") for d in dims for f in (F.min, F.max)]
    todo, leaves, whole = None, {}, None
    while todo is None or todo:
        wanted = rows if todo is None else rows.join(
            F.broadcast(local_rows(rows.sparkSession, [{"at": n} for n in todo], "at:bigint")), F.col("node") == F.col("at"), "left_semi"
        )
        facts = wanted.groupBy("node").agg(F.sum("size").alias("bytes"), *extents).collect()
        if todo is None:
            count = shards or max(1, -(-sum(f["bytes"] for f in facts) // target_bytes))
            todo = {1: (count, 0)}
        searches = []
        for f in facts:
            count, first = todo[f["node"]]
            own = [(f[f"min_{d}"], f[f"max_{d}"]) for d in dims]
            whole = whole or own
            if count == 1:
                leaves[f["node"]] = first
            else:
                dim = widest(own, whole)
                searches.append(Search(f["node"], count, first, dim, f["bytes"], *own[dim]))
                if own[dim][0] == own[dim][1]:
                    searches[-1].known, searches[-1].part = (own[dim][0],), 1
                    searches[-1].low = searches[-1].high = None
        while still := [s for s in searches if s.cut is None]:
            found = look(rows, still, dims)
            for s in still:
                s.narrow(found[s.node])
        todo = {}
        for s in searches:
            todo[2 * s.node] = s.left, s.first
            todo[2 * s.node + 1] = s.shards - s.left, s.first + s.left
        for node in [n for n, (count, _) in todo.items() if count == 1]:
            leaves[node] = todo.pop(node)[1]
        if searches:
            cuts = [{"at": s.node, "dim": s.dim, **{f"cut_{p}": c for p, c in zip(PARTS, s.cut)}} for s in searches]
            schema = "at:bigint,dim:int," + ",".join(f"cut_{p}:double" for p in PARTS)
            marked = rows.join(F.broadcast(local_rows(rows.sparkSession, cuts, schema)), F.col("node") == F.col("at"), "left")
            own = F.struct(axis_value(dims).alias("a"), F.col("tie").alias("b"), F.col("row").cast("double").alias("c"))
            cut = F.struct(*[F.col(f"cut_{p}").alias(n) for p, n in zip(PARTS, "abc")])
            child = F.col("node") * 2 + F.when(own <= cut, 0).otherwise(1)
            rows = marked.withColumn("node", F.when(F.col("at").isNull(), F.col("node")).otherwise(child)).select(*rows.columns)
    return rows, leaves


def kd_shards(
    docs: DataFrame, dimensions=DIMENSIONS, shards: int | None = None, target_bytes: int | None = None, id_col="doc_id", text_col="text"
) -> DataFrame:
    """(id, size, text_crc32, shard, slot): the shards are `shards` in number, or as many as give `target_bytes` each.

    Slots number a shard's rows from 0 without gaps, by id.
    """
    if (shards is None) == (target_bytes is None):
        raise ValueError("either the number of shards or their bytes are given")
    kinds = dict(docs.dtypes)
    text = F.coalesce(F.col(text_col), F.lit(""))
    dims = [f"d{i}" for i in range(len(dimensions))]
    # Texts are read once; what follows reads these few numbers.
    measured = docs.select(
        F.col(id_col).alias("id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("crc"),
        *[coordinate(c, kinds[c]).alias(d) for c, d in zip(dimensions, dims)],
        id_digest(F.col(id_col)).alias("tie"),
        F.monotonically_increasing_id().alias("row"),
        # Written with the rest: joined as a constant, it would leave a join without a key.
        F.lit(1).cast("long").alias("node"),
    )
    rows, leaves = grow(stored(measured, "measured"), dims, shards, target_bytes)
    numbers = local_rows(docs.sparkSession, [{"leaf": n, "shard": s} for n, s in leaves.items()], "leaf:bigint,shard:int")
    placed = rows.join(F.broadcast(numbers), F.col("node") == F.col("leaf")).select("id", "size", "crc", "shard", "row")
    placed = numbered(placed, ["shard"], ["id", "row"], "sharded")
    return placed.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", F.col("place").alias("slot"))
