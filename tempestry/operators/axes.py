"""Axis dictionaries of a grid: its distinct coordinates in order, and the place of a coordinate among them.

Row and column of a cell inside a box are differences of places, so an image needs no ranking of its cells, and a box that
crosses the dateline counts its columns on from its west edge.  Both axes come from one aggregate over the two
coordinate columns, as small as the grid's resolution, whatever the number of times.  They are cut into
whole degrees: a coordinate meets the row of its degree by an equi-join and is compared with the few values in it.
That table has a row per degree, so it is sent to all tasks.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempestry.functions.geo import wrap_longitude

#: Whole degrees that are told apart; every coordinate lies inside.
LOW, HIGH = -181, 181
ROWS, COLS = "rows", "cols"


def axis_table(grid: DataFrame) -> DataFrame:
    """One row per whole degree (``degree``) with, for both axes, the values in it, the number before and the length.

    Rows run from north to south, so their values are negated latitudes; columns from west to east.
    """
    distinct = grid.agg(
        F.collect_set(-F.col("latitude").cast("double")).alias(ROWS),
        F.collect_set(wrap_longitude(F.col("longitude")).cast("double")).alias(COLS),
    )
    each = distinct.select(ROWS, COLS, F.explode(F.sequence(F.lit(LOW), F.lit(HIGH))).alias("degree"))

    def part(name):
        before = F.size(F.filter(name, lambda v: v < F.col("degree")))
        values = F.filter(name, lambda v: F.floor(v) == F.col("degree"))
        return F.struct(before.alias("before"), values.alias("values"), F.size(name).alias("length")).alias(name)

    return each.select(F.col("degree").cast("long").alias("degree"), F.struct(part(ROWS), part(COLS)).alias("axes"))


def with_place(df: DataFrame, table: DataFrame, name: str, axis: str, edge: Column, closed: bool = False) -> DataFrame:
    """Adds the number of axis values below an edge, with ``closed`` also those on it; ``_length`` is that of the axis.

    For a value of the axis the number is its place, from 0.
    """
    inside = F.greatest(F.least(edge.cast("double"), F.lit(float(HIGH))), F.lit(float(LOW)))
    own = F.broadcast(table.select(F.col("degree").alias("_tempestry_degree"), F.col("axes").alias("_tempestry_axes")))
    joined = df.drop("_tempestry_length").withColumn("_tempestry_edge", inside).join(own, F.floor("_tempestry_edge") == F.col("_tempestry_degree"))
    here = F.col(f"_tempestry_axes.{axis}")
    below = (lambda v: v <= F.col("_tempestry_edge")) if closed else (lambda v: v < F.col("_tempestry_edge"))
    count = here["before"] + F.size(F.filter(here["values"], below))
    return joined.withColumns({name: count, "_tempestry_length": here["length"]}).drop("_tempestry_edge", "_tempestry_degree", "_tempestry_axes")


def box_places(boxes: DataFrame, table: DataFrame) -> DataFrame:
    """Boxes with ``_top`` and ``_left``, the places of their first row and column, and ``n_rows``, ``n_cols``.

    A box runs from ``west`` to ``east``, over the dateline where ``east`` is beyond 180 or ``west`` below -180.
    ``_turn`` is the number of columns once around.
    """
    west, east = wrap_longitude(F.col("west")), wrap_longitude(F.col("east"))
    placed = with_place(boxes, table, "_tempestry_top", ROWS, -F.col("lat_max"))
    placed = with_place(placed, table, "_tempestry_bottom", ROWS, -F.col("lat_min"), closed=True)
    placed = with_place(placed, table, "_tempestry_left", COLS, west)
    placed = with_place(placed, table, "_tempestry_right", COLS, east, closed=True).withColumnRenamed("_tempestry_length", "_tempestry_turn")
    width = F.col("_tempestry_right") - F.col("_tempestry_left")
    around = F.col("east") - F.col("west") >= 360
    return placed.withColumns(
        {
            "n_rows": F.greatest(F.col("_tempestry_bottom") - F.col("_tempestry_top"), F.lit(0)),
            "n_cols": F.when(around, F.col("_tempestry_turn")).when(west >= east, width + F.col("_tempestry_turn")).otherwise(F.greatest(width, F.lit(0))),
        }
    ).drop("_tempestry_bottom", "_tempestry_right")


def numbered_cells(grid: DataFrame, table: DataFrame) -> DataFrame:
    """The grid with the places ``_lat_number`` and ``_lon_number`` of each cell on the axes."""
    placed = with_place(grid, table, "_tempestry_lat_number", ROWS, -F.col("latitude"))
    return with_place(placed, table, "_tempestry_lon_number", COLS, wrap_longitude(F.col("longitude"))).drop("_tempestry_length")
