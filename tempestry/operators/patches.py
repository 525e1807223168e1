"""Grid cells around storms: box joins that also work across the dateline.

A box join on plain inequalities would compare every box with every cell.  Here
both sides are cut into coarse tiles of about one box: a box is repeated once for
each tile it touches, a cell lies in exactly one tile, and the join is an
equi-join on tiles (and time) with the exact bounds as a residual filter.  Tiles
that many storms share are cut into parts by the number of their boxes, and a small track
side is broadcast when it is below the session's broadcast limit.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempestry.functions.clock import add_hours, nearest_step
from tempestry.functions.geo import wrap_longitude
from tempestry.operators import axes
from tempestry.schema import GRID_COORDS

DEFAULT_PATCH = 25.0
#: Boxes of one tile and time that one task takes.
DENSE_BOXES = 10_000


def _spans(west: Column, east: Column) -> Column:
    """Longitude ranges of a box: one, or two when its ends meet over the dateline."""
    low = F.when(west < -180, west + 360).otherwise(west)
    high = F.when(east > 180, east - 360).otherwise(east)

    def span(a, b):
        return F.struct(a.alias("lon_min"), b.alias("lon_max"))

    return F.when(low < high, F.array(span(low, high))).otherwise(
        F.array(span(low, F.lit(180.0)), span(F.lit(-180.0), high))
    )


def _tiles(low: Column, high: Column, size: float) -> Column:
    return F.sequence(F.floor(low / size), F.floor(high / size))


def tiled(boxes: DataFrame, cells: DataFrame, tile: float, on_times: bool, dense: int = DENSE_BOXES):
    """Boxes repeated for each coarse tile they touch, cells with theirs, the exact bounds and the columns to join on.

    Boxes are counted per tile and time.  Where there are more than ``dense`` of them, they are dealt into parts of
    about that many, and the tile's cells, which the grid's resolution bounds, go to each part: no task meets all boxes of a
    place, whatever share of the boxes lies there.  A dense tile stands for at least ``dense`` boxes, so their
    table is small and is sent to all tasks.
    """
    cells = cells.withColumn("longitude", wrap_longitude(F.col("longitude")))
    cells = cells.withColumns(
        {
            "_tempestry_lat_tile": F.floor(F.col("latitude") / tile),
            "_tempestry_lon_tile": F.floor(F.col("longitude") / tile),
        }
    )
    placed = boxes.withColumn("_tempestry_lat_tile", F.explode(_tiles(F.col("lat_min"), F.col("lat_max"), tile)))
    placed = placed.withColumn("_tempestry_lon_tile", F.explode(_tiles(F.col("lon_min"), F.col("lon_max"), tile)))
    keys = ["_tempestry_lat_tile", "_tempestry_lon_tile"]
    inside = F.col("latitude").between(F.col("lat_min"), F.col("lat_max")) & F.col(
        "longitude"
    ).between(F.col("lon_min"), F.col("lon_max"))
    if on_times:
        keys.append("time")
    else:
        keys.append("_tempestry_day")
        cells = cells.withColumn("_tempestry_day", F.to_date("time"))
        days = F.sequence(F.to_date("start_time"), F.to_date("end_time"), F.expr("interval 1 day"))
        placed = placed.withColumn("_tempestry_day", F.explode(days))
        inside = inside & F.col("time").between(F.col("start_time"), F.col("end_time"))
    counts = placed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_tempestry_boxes")).where(F.col("_tempestry_boxes") > dense)
    parts = F.ceil(F.col("_tempestry_boxes") / F.lit(float(dense))).alias("_tempestry_parts")
    crowded = F.broadcast(counts.select(*keys, parts))
    dealt = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.coalesce("_tempestry_parts", F.lit(1)))
    placed = placed.join(crowded, keys, "left").withColumn("_tempestry_part", dealt).drop("_tempestry_parts")
    each = F.sequence(F.lit(0).cast("long"), F.coalesce("_tempestry_parts", F.lit(1)) - 1)
    cells = cells.join(crowded, keys, "left").withColumn("_tempestry_part", F.explode(each)).drop("_tempestry_parts")
    return placed, cells, inside, [*keys, "_tempestry_part"]


def box_join(
    boxes: DataFrame,
    grid: DataFrame,
    tile: float,
    on_times: bool,
    variables: list[str] | None = None,
    dense: int = DENSE_BOXES,
) -> DataFrame:
    """Cells inside each box, ends included.

    Boxes carry ``lat_min, lat_max, lon_min, lon_max`` and either one ``time``
    (``on_times``) or a range ``start_time, end_time``.
    """
    keep = [v for v in variables if v in grid.columns] if variables else None
    cells = grid if keep is None else grid.select(*GRID_COORDS, *keep)
    placed, cells, inside, keys = tiled(boxes, cells, tile, on_times, dense)
    joined = placed.join(cells, keys).filter(inside)
    return joined.drop("_tempestry_lat_tile", "_tempestry_lon_tile", "_tempestry_day", "_tempestry_part")


def patch_extract(
    grid: DataFrame,
    centres: DataFrame,
    patch_size: float = DEFAULT_PATCH,
    variables: list[str] | None = None,
    step_hours: int | None = None,
) -> DataFrame:
    """Cells within half a patch of each fix, at the grid time of the fix.

    ``step_hours`` snaps fix times to the analysis step first.  Columns of the
    result: the fix (storm, timestamp, centre), then the cell.
    """
    at = nearest_step(F.col("timestamp"), step_hours) if step_hours else F.col("timestamp")
    boxes = patch_boxes(centres, at, patch_size)
    found = box_join(boxes, grid, patch_size, on_times=True, variables=variables)
    return found.drop("lat_min", "lat_max", "lon_min", "lon_max")


def patch_boxes(centres: DataFrame, at: Column, patch_size: float, keep: list[str] | None = None) -> DataFrame:
    """Boxes of the fixes at the grid time ``at``; one over the dateline is two rows, east and west of it."""
    half = patch_size / 2
    return centres.select(
        "storm_id",
        "timestamp",
        at.alias("time"),
        F.col("latitude").alias("centre_latitude"),
        F.col("longitude").alias("centre_longitude"),
        (F.col("latitude") - half).alias("lat_min"),
        (F.col("latitude") + half).alias("lat_max"),
        *(keep or []),
        F.explode(_spans(F.col("longitude") - half, F.col("longitude") + half)).alias("_tempestry_span"),
    ).select("*", "_tempestry_span.*").drop("_tempestry_span")


def patch_images(
    grid: DataFrame,
    centres: DataFrame,
    patch_size: float = DEFAULT_PATCH,
    variables: list[str] | None = None,
    step_hours: int | None = None,
    coordinates: DataFrame | None = None,
) -> DataFrame:
    """The cells of ``patch_extract`` with their ``row`` (north first) and ``col`` (west first) in the image.

    Numbers count the grid's own latitudes and longitudes from the north-west corner of the box, over the dateline
    too; ``n_rows`` and ``n_cols`` are those of the whole box, also where the grid lacks cells at that time.
    ``coordinates`` names a table of the grid's latitudes and longitudes, if there is one that is quicker to read.
    """
    at = nearest_step(F.col("timestamp"), step_hours) if step_hours else F.col("timestamp")
    half = patch_size / 2
    keep = variables and [v for v in variables if v in grid.columns]
    wide = grid if keep is None else grid.select(*GRID_COORDS, *keep)
    boxes = centres.select("storm_id", "timestamp", "latitude", "longitude").withColumns(
        {
            "lat_min": F.col("latitude") - half,
            "lat_max": F.col("latitude") + half,
            "west": F.col("longitude") - half,
            "east": F.col("longitude") + half,
        }
    )
    table = axes.axis_table(grid if coordinates is None else coordinates)
    placed = axes.box_places(boxes, table).drop("lat_min", "lat_max", "west", "east")
    kept = patch_boxes(placed, at, patch_size, ["_tempestry_top", "_tempestry_left", "_tempestry_turn", "n_rows", "n_cols"])
    found = box_join(kept, axes.numbered_cells(wide, table), patch_size, on_times=True)
    found = found.withColumns(
        {
            "row": F.col("_tempestry_lat_number") - F.col("_tempestry_top"),
            "col": F.pmod(F.col("_tempestry_lon_number") - F.col("_tempestry_left"), F.col("_tempestry_turn")),
        }
    )
    return found.drop("lat_min", "lat_max", "lon_min", "lon_max", "_tempestry_top", "_tempestry_left", "_tempestry_turn", "_tempestry_lat_number", "_tempestry_lon_number")


def fixes_with_cells(
    grid: DataFrame, centres: DataFrame, patch_size: float = DEFAULT_PATCH, step_hours: int | None = None
) -> DataFrame:
    """(storm_id, timestamp) of the fixes whose patch has a cell; only the grid's coordinates are read."""
    at = nearest_step(F.col("timestamp"), step_hours) if step_hours else F.col("timestamp")
    boxes = patch_boxes(centres, at, patch_size)
    placed, cells, inside, keys = tiled(boxes, grid.select(*GRID_COORDS), patch_size, on_times=True)
    cells = cells.withColumnsRenamed({k: f"_tempestry_cell_{k}" for k in keys})
    same = inside
    for k in keys:
        same = same & (F.col(k) == F.col(f"_tempestry_cell_{k}"))
    return placed.join(cells, same, "left_semi").select("storm_id", "timestamp").distinct()


def storm_boxes(
    tracks: DataFrame,
    patch_size: float = DEFAULT_PATCH,
    lead_hours: int = 6,
    lag_hours: int = 6,
) -> DataFrame:
    """Padded bounding box and time range of each storm.

    A storm whose longitudes span more than 180 degrees gets an east box
    (longitudes from 0) and a west box (below 0).  All bounds are partial
    aggregates of one pass.
    """
    half = patch_size / 2
    lon = F.col("longitude")
    east, west = F.when(lon >= 0, lon), F.when(lon < 0, lon)
    spans = tracks.groupBy("storm_id").agg(
        F.min("latitude").alias("_tempestry_south"),
        F.max("latitude").alias("_tempestry_north"),
        F.min(lon).alias("_tempestry_low"),
        F.max(lon).alias("_tempestry_high"),
        F.min(east).alias("_tempestry_east_low"),
        F.max(east).alias("_tempestry_east_high"),
        F.min(west).alias("_tempestry_west_low"),
        F.max(west).alias("_tempestry_west_high"),
        F.min("timestamp").alias("_tempestry_first"),
        F.max("timestamp").alias("_tempestry_last"),
    )

    def side(name, low, high):
        return F.struct(
            F.lit(name).alias("side"),
            (F.col(low) - half).alias("lon_min"),
            (F.col(high) + half).alias("lon_max"),
        )

    sides = F.when(
        F.col("_tempestry_high") - F.col("_tempestry_low") > 180,
        F.array(
            side("east", "_tempestry_east_low", "_tempestry_east_high"), side("west", "_tempestry_west_low", "_tempestry_west_high")
        ),
    ).otherwise(F.array(side("all", "_tempestry_low", "_tempestry_high")))
    return spans.select(
        "storm_id",
        (F.col("_tempestry_south") - half).alias("lat_min"),
        (F.col("_tempestry_north") + half).alias("lat_max"),
        add_hours(F.col("_tempestry_first"), F.lit(-lead_hours)).alias("start_time"),
        add_hours(F.col("_tempestry_last"), F.lit(lag_hours)).alias("end_time"),
        F.inline(sides),
    )


def storm_cube_extract(
    grid: DataFrame,
    tracks: DataFrame,
    patch_size: float = DEFAULT_PATCH,
    variables: list[str] | None = None,
    lead_hours: int = 6,
    lag_hours: int = 6,
) -> DataFrame:
    """All cells of each storm's padded box over its padded life time.

    A cell in both boxes of a dateline storm comes out once per box, as the two
    stitched extracts hold it.
    """
    boxes = storm_boxes(tracks, patch_size, lead_hours, lag_hours)
    # a padded side may reach past the dateline: its part beyond is a range of its own
    spans = F.explode(_spans(F.col("lon_min"), F.col("lon_max")))
    boxes = boxes.withColumn("_tempestry_span", spans).withColumns(
        {"lon_min": F.col("_tempestry_span.lon_min"), "lon_max": F.col("_tempestry_span.lon_max")}
    ).drop("_tempestry_span")
    found = box_join(boxes, grid, patch_size, on_times=False, variables=variables)
    return found.drop("lat_min", "lat_max", "lon_min", "lon_max", "start_time", "end_time")


def nearest_hour_align(tracks: DataFrame, grid: DataFrame, step_hours: int) -> DataFrame:
    """Fixes with their nearest analysis time, where the grid has that time."""
    times = grid.select(F.col("time").alias("analysis_time")).distinct()
    snapped = tracks.withColumn("analysis_time", nearest_step(F.col("timestamp"), step_hours))
    return snapped.join(times, "analysis_time", "left_semi")


def channel_concat(
    tiles: DataFrame, fields: DataFrame, on: list[str], keep: list[str] | None = None, within: list[str] | None = None
) -> DataFrame:
    """Satellite channels first, field channels after, for every field cell.

    ``on`` matches cells with tiles; ``keep`` names the columns of the result, ``on``
    by default.  Rows are brought together by ``on`` alone; whole numbers ``within`` are compared after that, for
    where few tiles have equal ``on``.
    """
    within = within or []
    own = [F.col(c).alias(f"_tempestry_own_{c}") for c in [*on, *within]]
    left = tiles.select(*own, F.col("channels").alias("_tempestry_tile"))
    matching = F.lit(True)
    for c in on:
        matching = matching & (F.col(c) == F.col(f"_tempestry_own_{c}"))
    for c in within:
        # a difference is no key to exchange rows by
        matching = matching & (F.col(c) - F.col(f"_tempestry_own_{c}") == 0)
    return fields.join(left, matching, "left").select(
        *(keep or [*on, *within]), F.concat(F.col("_tempestry_tile"), F.col("channels")).alias("channels")
    )


def as_channels(df: DataFrame, columns: list[str], on: list[str]) -> DataFrame:
    """Pack columns into one channel array per row."""
    return df.select(*on, F.array(*[F.col(c).cast("float") for c in columns]).alias("channels"))
