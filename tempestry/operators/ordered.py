"""Ordered per-key work that stays balanced when one key holds most rows.

``Window.partitionBy(key).orderBy(time)`` sends all rows of a key to one task.
That is right for ordinary storms and wrong for one that owns a third of the
table.  The work is done in three steps, all of them parts of one lazy plan:

``with_bins`` gives each row a bin.  Keys of fewer than ``min_rows`` rows have one bin.  The others, at most one in ``min_rows``
rows of the table, have their bins between their lowest and highest order value, a number in proportion to their rows.
Bins rise with the order value, so what lies in lower bins comes first.

``bin_totals`` adds up rows per key and bin; running sums of these few totals say how many rows come before each
bin.  ``with_position`` numbers the rows within their bins and adds that.

``blocks`` then cuts every key into runs of ``BLOCK_ROWS`` consecutive numbers
and repeats the few rows at the edge of a run in the next one, so that lags,
leads and short row frames are exact inside a run.  It needs no statistics, and
a table that arrives hash-partitioned by the key needs no further exchange.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempestry.functions.clock import micros

POINT = "point"
NUMBER = "_tempestry_number"
BLOCK_ROWS = 1_000_000
MIN_HOT_ROWS = 1_000_000
#: Bins of a large key for each ``min_rows`` of its rows, so that uneven values still give small bins, and at most.
BINS_EACH, MOST_BINS = 64, 1 << 20

_BLOCK = "_tempestry_block"
_HALO = "_tempestry_halo"
BIN, HOME, LARGE = "_tempestry_bin", "_tempestry_home", "_tempestry_large"


# -- numbering ---------------------------------------------------------------------------------


def as_number(value: Column, kind: str) -> Column:
    """A double that never falls as the value rises."""
    if kind == "timestamp_ntz":
        value = micros(value)
    elif kind == "timestamp":
        value = F.unix_micros(value)
    elif kind == "date":
        value = F.unix_date(value)
    return value.cast("double")


def same(left: list[str], right: list[str]) -> Column:
    """Equality of columns, missing values being equal, as a check beside the equality that a join is planned by.

    Written so that it does not become part of that: rows already lie by the hash of these columns.
    """

    def row(names):
        return F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(names)])

    return F.array_contains(F.array(row(right)), row(left))


def with_bins(df: DataFrame, keys: list[str], order: str, min_rows: int = MIN_HOT_ROWS) -> DataFrame:
    """The table with ``BIN`` and ``LARGE``, whether the row's key has several bins.

    ``BIN`` is 0 for ordinary keys and missing order values, and rises from 0 with the values of a large key.  Large keys
    are found by one aggregate with partial sums.  Their table has at most one row for each ``min_rows`` rows, so
    it is sent to all tasks.  An order column that is no number or time gives one bin.
    """
    kind = dict(df.dtypes)[order]
    if kind in ("string", "binary", "boolean") or kind.startswith(("array", "struct", "map")):
        return df.withColumns({BIN: F.lit(0).cast("long"), LARGE: F.lit(False)})
    value = as_number(F.col(order), kind)
    finite = F.when(F.abs(value) < float("inf"), value)
    key = F.xxhash64(*keys)
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_tempestry_rows"), F.min(finite).alias("_tempestry_low"), F.max(finite).alias("_tempestry_high"))
    large = sizes.where(F.col("_tempestry_rows") >= min_rows).select(
        key.alias("_tempestry_own"),
        *[F.col(k).alias(f"_tempestry_own_{k}") for k in keys],
        "_tempestry_low",
        "_tempestry_high",
        F.least(F.ceil(F.col("_tempestry_rows") * float(BINS_EACH) / min_rows), F.lit(MOST_BINS)).cast("double").alias("_tempestry_bins"),
    )
    own = [f"_tempestry_own_{k}" for k in keys]
    joined = df.join(F.broadcast(large), (key == F.col("_tempestry_own")) & same(keys, own), "left")
    share = F.try_divide(value - F.col("_tempestry_low"), F.col("_tempestry_high") - F.col("_tempestry_low"))
    # infinities and NaN come to lie in the outer bins, where they belong
    place = F.least(F.greatest(share * F.col("_tempestry_bins"), F.lit(0.0)), F.col("_tempestry_bins") - 1)
    return joined.withColumns(
        {BIN: F.coalesce(F.floor(place), F.lit(0)).cast("long"), LARGE: F.col("_tempestry_bins").isNotNull()}
    ).drop("_tempestry_own", *own, "_tempestry_low", "_tempestry_high", "_tempestry_bins")


def spread(binned: DataFrame, keys: list[str]) -> DataFrame:
    """Rows exchanged by key and bin, with the hash of both as ``HOME``; what follows per key and bin needs no exchange."""
    return binned.withColumn(HOME, F.xxhash64(*keys, BIN)).repartition(HOME)


def bin_totals(binned: DataFrame, keys: list[str], **sums: Column) -> DataFrame:
    """Per key and bin: rows in it (``_in``), in all lower bins (``_before``) and in all (``_rows``), and the given sums.

    The running sums go over bins, at most ``MOST_BINS`` of a key.
    """
    totals = binned.groupBy(HOME, *keys, BIN).agg(F.count(F.lit(1)).alias("_tempestry_in"), *[c.alias(n) for n, c in sums.items()])
    whole = Window.partitionBy(*keys)
    earlier = whole.orderBy(BIN).rowsBetween(Window.unboundedPreceding, -1)
    return totals.withColumns(
        {"_tempestry_before": F.coalesce(F.sum("_tempestry_in").over(earlier), F.lit(0)), "_tempestry_rows": F.sum("_tempestry_in").over(whole)}
    )


def join_totals(rows: DataFrame, totals: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Rows with the columns of their bin's total."""
    own = [HOME, *keys, BIN]
    renamed = totals.withColumnsRenamed({c: f"_tempestry_own{c}" for c in own})
    matching = (F.col(HOME) == F.col(f"_tempestry_own{HOME}")) & same(own[1:], [f"_tempestry_own{c}" for c in own[1:]])
    return rows.join(renamed, matching, how).drop(*[f"_tempestry_own{c}" for c in own])


def with_position(
    df: DataFrame,
    keys: list[str],
    order: str,
    ties: list[str] | None = None,
    name: str = POINT,
    min_rows: int = MIN_HOT_ROWS,
) -> DataFrame:
    """Number the rows of each key in order, from 1."""
    binned = with_bins(df, keys, order, min_rows)
    # only large keys have bins with rows before them
    crowded = binned.where(LARGE).select(*keys, BIN).withColumn(HOME, F.xxhash64(*keys, BIN))
    later = bin_totals(crowded, keys).where("_tempestry_before > 0").select(HOME, *keys, BIN, "_tempestry_before")
    own = F.row_number().over(Window.partitionBy(HOME, *keys, BIN).orderBy(order, *(ties or [])))
    numbered = join_totals(spread(binned, keys).withColumn(name, own.cast("long")), later, keys, "left")
    return numbered.withColumn(name, F.col(name) + F.coalesce("_tempestry_before", F.lit(0))).drop("_tempestry_before", BIN, HOME, LARGE)


# -- neighbours --------------------------------------------------------------------------------


def blocks(
    df: DataFrame, point: str = POINT, before: int = 0, after: int = 0, size: int = BLOCK_ROWS
) -> DataFrame:
    """Cut keys into runs of ``size`` numbers, with the rows a window looks back or ahead to.

    Use ``run_window`` for the windows and ``settle`` afterwards.
    """
    if max(before, after) >= size:
        raise ValueError("a block must be longer than the rows a window reaches")
    own = F.floor((F.col(point) - 1) / size).cast("long")
    within = (F.col(point) - 1) % size
    places = [own]
    if before:
        places.append(F.when(within >= size - before, own + 1))
    if after:
        places.append(F.when((within < after) & (own > 0), own - 1))
    return (
        df.withColumn(_BLOCK, F.explode(F.array_compact(F.array(*places))))
        .withColumn(_HALO, F.col(_BLOCK) != own)
    )


def run_window(keys: list[str], point: str = POINT):
    """Rows of one block in order."""
    return Window.partitionBy(*keys, _BLOCK).orderBy(point)


def settle(blocked: DataFrame) -> DataFrame:
    """Drop repeated rows and helper columns."""
    return blocked.filter(~F.col(_HALO)).drop(_BLOCK, _HALO)


def with_points(df: DataFrame, keys: list[str], order: str, numbered: str | None = None) -> DataFrame:
    """The table with the column ``NUMBER``: numbered in order, or a copy of ``numbered``.

    ``numbered`` names a column that numbers each key's rows from 1 without gaps.  No
    column is taken for such a number by its name.
    """
    if numbered:
        return df.withColumn(NUMBER, F.col(numbered))
    return with_position(df, keys, order, name=NUMBER)
