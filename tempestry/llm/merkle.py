"""Merkle manifest of a table: a leaf per row, a tree per source, a tree of the sources' roots.

A row's leaf is the digest of its columns, each `-` where null, else its UTF-8 byte count, a colon and its value. The
leaves of a source, by id, are the lowest level of its tree; every 16 consecutive nodes give a parent, the digest of
their digests, until one node is left. The sources' last nodes, ordered by source, are the leaves of the top tree.

Up: a slot pivot. Conditional aggregates spread the children of each parent into 16 columns; the concatenated
columns give its digest. Down: a child's siblings are its parent's columns without its own slot, kept as those to
the left and those to the right of it. Each level is one aggregate and one join on (tree, place), and a path is carried by
parents, so that 16 rows share it. Only the number of levels, from the largest count of nodes, comes to the driver.

Row numbers within a source come from ranges, so no source is one task. Null ids come first; rows of equal id are
ordered by leaf, and equal rows get equal leaves. A null source is a source of its own, before the others. Null and
empty texts differ (`-` and `0:`). Columns that are not named take no part. An empty table gives no rows.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempestry.llm.common import numbered, stored

FANOUT = 16
#: The columns of a leaf, in order.
LEAF_COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
SLOTS = [f"c{k}" for k in range(FANOUT)]
PATH = "array<struct<left:string,right:string>>"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def leaf(columns: list[Column]) -> Column:
    """The digest of a row's values; none can run into the next, as each says its length."""

    def field(value):
        text = value.cast("string")
        return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text), F.lit(":"), text))

    return digest(*map(field, columns))


def parents(nodes: DataFrame) -> DataFrame:
    """(tree, place, total, c0 ... c15, hash): the next level of the trees that have several nodes.

    nodes: (tree, place, total, hash), total being the number of nodes of the tree on this level.
    """
    slot = F.col("place") % FANOUT
    spread = [F.max(F.when(slot == k, F.col("hash"))).alias(name) for k, name in enumerate(SLOTS)]
    place = F.floor(F.col("place") / FANOUT)
    total = F.ceil(F.max("total") / FANOUT)
    grouped = nodes.where("total > 1").groupBy("tree", place.alias("place")).agg(total.alias("total"), *spread)
    return grouped.withColumn("hash", F.sha2(F.concat_ws("", *SLOTS), 256))


def levels(nodes: DataFrame, name: str) -> list[DataFrame]:
    """The given nodes and all levels above them, each written once."""
    most = nodes.agg(F.max("total")).first()[0] or 0
    found = [nodes]
    while most > 1:
        found.append(stored(parents(found[-1]), f"{name}-{len(found)}"))
        most = -(-most // FANOUT)
    return found


def last_nodes(level_tables: list[DataFrame]) -> DataFrame:
    """(tree, hash): what remains of each tree."""
    return reduce(DataFrame.unionByName, [t.where("total = 1").select("tree", "hash") for t in level_tables])


def under(children: DataFrame, above: DataFrame) -> DataFrame:
    """Children with the path of their parent, and their siblings put before it.

    above: (tree, place, c0 ... c15, path and further columns, which come along).
    """
    carried = [c for c in above.columns if c not in {"tree", "place", "total", "hash", "path", *SLOTS}]
    parent = above.select(
        F.col("tree").alias("_tree"), F.col("place").alias("_place"), F.col("path").alias("_path"), *carried,
        *[F.col(c).alias(f"_{c}") for c in SLOTS],
    )
    same = (F.col("tree") == F.col("_tree")) & (F.floor(F.col("place") / FANOUT) == F.col("_place"))
    slot = F.col("place") % FANOUT
    left = F.concat_ws("", *[F.when(slot > k, F.col(f"_{c}")) for k, c in enumerate(SLOTS)])
    right = F.concat_ws("", *[F.when(slot < k, F.col(f"_{c}")) for k, c in enumerate(SLOTS)])
    own = F.array(F.struct(left.alias("left"), right.alias("right")))
    joined = children.where("total > 1").join(parent, same)
    return joined.select(*children.columns, F.concat(own, F.col("_path")).alias("path"), *carried)


def paths(level_tables: list[DataFrame], tops: DataFrame) -> DataFrame:
    """The lowest level with each node's path: its siblings, left and right, level by level up to the root.

    tops: (tree, path, ...), the path of each tree's last node and further columns to come along.
    """
    above = None
    for table in reversed(level_tables):
        found = table.where("total = 1").join(tops, "tree").select(*table.columns, *[c for c in tops.columns if c != "tree"])
        above = found if above is None else found.unionByName(under(table, above))
    return above


def manifest(
    docs: DataFrame, columns=LEAF_COLUMNS, id_col="doc_id", source_col="source", tampered: dict[str, Column] | None = None
) -> DataFrame:
    """(id, leaf, subroot, root, proof_sha256, folded_root, verified), a row per row of docs.

    proof_sha256 is the digest of all siblings up to the root. folded_root is recomputed from the row's leaf and
    those siblings; `tampered` gives columns other values for that leaf alone, as a check of the proofs.
    """
    other = leaf([(tampered or {}).get(c, F.col(c)) for c in columns])
    # Digests are short beside texts; they are written once, so texts are read once.
    leaves = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), leaf([F.col(c) for c in columns]).alias("hash"), other.alias("start"))
    leaves = stored(leaves.withColumn("row", F.monotonically_increasing_id()), "leaves")
    nodes = numbered(leaves, ["source"], ["id", "hash", "row"], "leaves-by-source").withColumnRenamed("first", "tree")
    nodes = nodes.select("tree", "place", "total", "hash", "id", "start")
    own = levels(nodes, "nodes")
    subroots = stored(last_nodes(own), "subroots")
    sources = numbered(subroots, [], ["tree"], "subroots-in-order").select(F.col("tree").alias("source"), "place", "total", "hash")
    sources = sources.select(F.lit(0).cast("long").alias("tree"), "*")
    top = levels(sources, "top")
    root = last_nodes(top).select("tree", F.lit(None).cast(PATH).alias("path"), F.col("hash").alias("root"))
    root = root.withColumn("path", F.array().cast(PATH))
    tops = paths(top, root).select(F.col("source").alias("tree"), "path", "root", F.col("hash").alias("subroot"))
    proved = paths(own, stored(tops, "subroot-paths"))
    siblings = F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), "")
    folded = F.aggregate("path", F.col("start"), lambda node, s: digest(s["left"], node, s["right"]))
    return proved.select(
        F.col("id").alias(id_col), F.col("hash").alias("leaf"), "subroot", "root",
        F.sha2(siblings, 256).alias("proof_sha256"), folded.alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
