"""Track, grid, ensemble and request tables derived from the given tables.

Every derivation has a twin in ``oracle_sql`` of the same name.
"""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tempestry.functions.clock import add_hours
from tempestry.operators import ordered
from tempestry.sources.arrays import grid_from_arrays

TRACK_COLUMNS = [
    "storm_id",
    "point",
    "name",
    "timestamp",
    "storm_type",
    "latitude",
    "longitude",
    "max_wind",
    "min_pressure",
    "r34_ne",
    "r34_se",
    "r34_sw",
    "r34_nw",
]

# variable number in the embeddings table -> (name, base, scale)
FIELDS = [
    ("u10", 0.0, 40.0),
    ("v10", 0.0, 40.0),
    ("msl", 101300.0, 5000.0),
    ("t2m", 298.0, 20.0),
    ("d2m", 293.0, 20.0),
    ("u200", 0.0, 80.0),
    ("v200", 0.0, 80.0),
    ("u850", 0.0, 40.0),
    ("v850", 0.0, 40.0),
    ("sst", 300.0, 10.0),
]
GRID_STEP_HOURS = 12

VARIABLE_LISTS = [
    ["10m_u_component_of_wind", "sea_surface_temperature", "u_component_of_wind"],
    ["u_component_of_wind", "10m_u_component_of_wind", "sea_surface_temperature"],
    ["2m_temperature", "mean_sea_level_pressure"],
]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def numbered_tracks(spark: SparkSession, sf: str) -> DataFrame:
    """Track rows with the ids they came from and their number within the storm."""
    user, event, k = F.col("user_id"), F.col("event_id"), F.col("point")
    digits = user.cast("string")
    padded = F.lpad(digits, F.greatest(F.lit(6), F.length(digits)), F.lit("0"))
    events = table(spark, sf, "events").select(
        F.concat(F.lit("EV"), padded).alias("storm_id"),
        "user_id",
        "event_id",
        F.col("ts").alias("timestamp"),
        F.col("event_type").alias("storm_type"),
        "value",
    )
    # numbered by storm_id, so later windows per storm reuse the same exchange
    numbered = ordered.with_position(events, ["storm_id"], "timestamp", ["event_id"])
    wind = (F.lit(20) + F.floor(F.least(F.col("value"), F.lit(400.0)) / 4)).cast("double")
    rows = numbered.select(
        "storm_id",
        "user_id",
        "event_id",
        "point",
        F.concat(F.lit("STORM"), (user % 50).cast("string")).alias("name"),
        "timestamp",
        "storm_type",
        ((F.lit(8) + (user * 7) % 20) + k * 0.25 + (event % 5 - 2) * 0.125).alias("latitude"),
        ((F.lit(-20) - (user * 11) % 40) - k * 0.5 + (event % 7 - 3) * 0.125).alias("longitude"),
        wind.alias("max_wind"),
    )
    radii = {
        name: F.when(event % 3 != 0, (event % divisor).cast("double"))
        for name, divisor in (("r34_ne", 60), ("r34_se", 55), ("r34_sw", 45), ("r34_nw", 40))
    }
    scaled = F.col("max_wind") / 14.0
    return rows.withColumn(
        "min_pressure", F.lit(1013.0) - scaled * scaled + (event % 131 - 65)
    ).withColumns(radii)


def tracks(spark, sf):
    return numbered_tracks(spark, sf).select(*TRACK_COLUMNS)


def tracks_dirty(spark, sf):
    """Winds of -99, missing pressures and latitudes far off."""
    event = F.col("event_id")
    return (
        numbered_tracks(spark, sf)
        .withColumns(
            {
                "max_wind": F.when(event % 97 == 0, F.lit(-99.0)).otherwise(F.col("max_wind")),
                "min_pressure": F.when(event % 41 != 0, F.col("min_pressure")),
                "latitude": F.when(event % 211 == 0, F.col("latitude") + 30).otherwise(F.col("latitude")),
            }
        )
        .select(*TRACK_COLUMNS)
    )


def grid_coordinates(spark, sf):
    """Times and places of the grid's cells, without its fields."""
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    times = table(spark, sf, "embeddings").select(F.expr("vec_id div 10").alias("number")).distinct()
    cells = times.withColumn("pos", F.explode(F.sequence(F.lit(0), F.lit(63))))
    return cells.select(
        add_hours(start, F.col("number") * GRID_STEP_HOURS).alias("time"),
        (F.lit(45.0) - F.expr("pos div 8") * 5.0).alias("latitude"),
        (F.lit(-95.0) + (F.col("pos") % 8) * 10.0).alias("longitude"),
    )


def with_nan(df, column, where):
    """The column with NaN where a condition holds, as padded archives have it."""
    return df.withColumn(column, F.when(where, F.lit(float("nan"))).otherwise(F.col(column)))


def tracks_nan(spark, sf):
    """Latitudes and winds that are NaN here and there, where the SQL twin has NULL."""
    event = F.col("event_id")
    rows = with_nan(with_nan(numbered_tracks(spark, sf), "latitude", event % 173 == 0), "max_wind", event % 59 == 0)
    return rows.select(*TRACK_COLUMNS)


def _westward(longitude):
    moved = longitude - 110
    return F.when(moved < -180, moved + 360).otherwise(moved)


def tracks_dateline(spark, sf):
    """Every tenth storm moved 110 degrees west, over the dateline."""
    moved = F.when(F.col("user_id") % 10 == 0, _westward(F.col("longitude")))
    return (
        numbered_tracks(spark, sf)
        .withColumn("longitude", moved.otherwise(F.col("longitude")))
        .select(*TRACK_COLUMNS)
    )


def numbered_tracks_years(spark, sf):
    """Storms moved by -15, 0 or 15 days, so that some span two calendar years."""
    shift = (F.col("user_id") % 3 - 1) * 15 * 24
    return numbered_tracks(spark, sf).withColumn("timestamp", add_hours(F.col("timestamp"), shift))


def tracks_years(spark, sf):
    return numbered_tracks_years(spark, sf).select(*TRACK_COLUMNS)


def track_text(spark, sf):
    """Best-track lines: per storm one header, and its fixes spread over blocks of 16.

    Only the first block of a storm holds the header, as when a text split starts
    in the middle of a storm.
    """
    rows = numbered_tracks(spark, sf)
    file, block = F.col("storm_id").alias("file"), F.floor((F.col("point") - 1) / 16).alias("block")

    def degrees(column, plus, minus):
        value = F.round(column, 1)
        side = F.when(value < 0, F.lit(minus)).otherwise(F.lit(plus))
        return F.concat(F.format_string("%.1f", F.abs(value)), side)

    def whole(column):
        return F.coalesce(F.round(column).cast("long").cast("string"), F.lit("-999"))

    zeros = F.lit("    0,    0,    0,    0,    0,    0,    0,    0,")
    fix = F.concat_ws(
        ", ",
        F.date_format("timestamp", "yyyyMMdd"),
        F.date_format("timestamp", "HHmm"),
        F.lit(" "),
        F.col("storm_type"),
        degrees(F.col("latitude"), "N", "S"),
        degrees(F.col("longitude"), "E", "W"),
        whole(F.col("max_wind")),
        whole(F.col("min_pressure")),
        whole(F.col("r34_ne")),
        whole(F.col("r34_se")),
        whole(F.col("r34_sw")),
        whole(F.col("r34_nw")),
        zeros,
    )
    fixes = rows.select(file, block, F.col("point").alias("line_no"), fix.alias("value"))
    headers = rows.groupBy("storm_id", "name").agg(F.count(F.lit(1)).alias("n")).select(
        file,
        F.lit(0).cast("long").alias("block"),
        F.lit(0).cast("long").alias("line_no"),
        F.concat(F.col("storm_id"), F.lit(",   "), F.col("name"), F.lit(",  "), F.col("n"), F.lit(",")).alias("value"),
    )
    return headers.unionByName(fixes)


def in_file_order(lines):
    """Lines as a scan of files gives them: each split whole in one task and in order, splits in any task."""
    return lines.repartition("file", "block").sortWithinPartitions("file", "block", "line_no")


def renamed_text(spark, sf):
    """Files of 40 storms each, in which a storm comes twice: later under another name, before the storm's first fixes in time.

    (file, block, line_no, value) as in ``track_text``, five lines to a block; the second header of a storm stands after the fixes
    of the first part.
    """
    rows = numbered_tracks(spark, sf).withColumn("again", (F.col("point") <= 3).cast("int"))
    file = F.concat(F.lit("F"), F.expr("user_id div 40"))
    fix = F.concat_ws(
        ", ", F.date_format("timestamp", "yyyyMMdd"), F.date_format("timestamp", "HHmm"), F.lit(" "), F.col("storm_type"),
        F.lit("10.0N"), F.lit("20.0W"), F.col("max_wind").cast("long").cast("string"), F.lit("-999"),
    )
    place = ["again", "user_id", "point"]
    fixes = rows.select(file.alias("file"), *place, fix.alias("value"))
    name = F.concat(F.col("name"), F.when(F.col("again") == 1, F.lit("X")).otherwise(F.lit("")))
    value = F.concat(F.col("storm_id"), F.lit(", "), name, F.lit(", 0,"))
    headers = rows.select(file.alias("file"), "again", "user_id", F.lit(0).cast("long").alias("point"), value.alias("value")).distinct()
    over = Window.partitionBy("file").orderBy(*place)
    numbered = headers.unionByName(fixes).withColumn("line_no", F.row_number().over(over) - 1)
    return numbered.select("file", F.floor(F.col("line_no") / 5).alias("block"), "line_no", "value")


def storm_arrays(spark, sf):
    """Parallel arrays per storm, in rows of up to 512 fixes, with gaps as in padded archives."""
    event = F.col("event_id")
    rows = numbered_tracks(spark, sf).withColumns(
        {
            "time": F.when(event % 29 != 0, F.col("timestamp")),
            "lat": F.when(event % 31 != 0, F.col("latitude")),
            "_part": F.floor((F.col("point") - 1) / 512),
        }
    )
    fix = F.struct("point", "time", "lat", "longitude", "max_wind", "min_pressure")
    packed = rows.groupBy("storm_id", "name", "_part").agg(F.sort_array(F.collect_list(fix)).alias("f"))
    return packed.select(
        F.col("storm_id").cast("binary").alias("sid"),
        F.concat(F.col("name"), F.lit("   ")).cast("binary").alias("name"),
        F.col("f.time").alias("time"),
        F.col("f.lat").alias("lat"),
        F.col("f.longitude").alias("lon"),
        F.col("f.max_wind").alias("wmo_wind"),
        F.col("f.min_pressure").alias("wmo_pres"),
    )


def grid(spark, sf):
    """Wide grid of ten variables on 8 x 8 cells, from one vector per field."""
    vectors = table(spark, sf, "embeddings")
    number = (F.col("vec_id") % 10).cast("int") + 1

    def pick(values):
        return F.element_at(F.array(*[F.lit(v) for v in values]), number)

    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    fields = vectors.select(
        add_hours(start, F.expr("vec_id div 10") * GRID_STEP_HOURS).alias("time"),
        pick([f[0] for f in FIELDS]).alias("variable"),
        pick([f[1] for f in FIELDS]).alias("_base"),
        pick([f[2] for f in FIELDS]).alias("_scale"),
        "embedding",
    ).select(
        "time",
        "variable",
        F.transform("embedding", lambda x: F.col("_base") + F.col("_scale") * x.cast("double")).alias("values"),
    )
    pos = F.col("pos")
    return grid_from_arrays(
        fields,
        latitude=F.lit(45.0) - F.expr("pos div 8") * 5.0,
        longitude=F.lit(-95.0) + (pos % 8) * 10.0,
        variables=[f[0] for f in FIELDS],
    )


def grid_irregular(spark, sf):
    """The grid without every fourth time, the others moved by 0 to 4 hours and some minutes."""
    number = F.floor((F.unix_timestamp(F.col("time").cast("timestamp")) - 1704067200) / (GRID_STEP_HOURS * 3600))
    moved = add_hours(F.col("time"), number * 7 % 5) + F.make_dt_interval(F.lit(0), F.lit(0), (number * 13 % 47).cast("int"))
    return grid(spark, sf).where(number % 4 != 1).withColumn("time", moved)


def grid_dateline(spark, sf):
    """The grid, and a copy of it moved 110 degrees west over the dateline."""
    base = grid(spark, sf)
    return base.unionByName(base.withColumn("longitude", _westward(F.col("longitude"))))


def tiles_dateline(spark, sf):
    """2 x 2 tiles of the dateline tracks whose four cells all differ."""
    corners = F.array(*[F.struct(F.lit(r).alias("row"), F.lit(c).alias("col")) for r in (0, 1) for c in (0, 1)])
    fixes = tracks_dateline(spark, sf).select("storm_id", F.col("timestamp").alias("time"), "max_wind", F.inline(corners))
    row, col = F.col("row"), F.col("col")
    return fixes.select(
        "storm_id", "time", "row", "col",
        (F.col("max_wind") + row * 100 + col * 10).alias("ir1"),
        (row * 2 + col - 4).cast("double").alias("ir2"),
    )


def grid_gap(spark, sf):
    """The grid without sea temperatures in its two western columns."""
    return grid(spark, sf).withColumn("sst", F.when(F.col("longitude") >= -75, F.col("sst")))


def grid_nan(spark, sf):
    """The grid with NaN sea temperatures in its two western columns."""
    return with_nan(grid(spark, sf), "sst", F.col("longitude") < -75)


def levels(spark, sf):
    """Long pressure-level winds."""
    winds = F.array(
        *[
            F.struct(F.lit(level).alias("pressure_level"), F.col(f"u{level}").alias("u"), F.col(f"v{level}").alias("v"))
            for level in (200, 850)
        ]
    )
    return grid(spark, sf).select("time", "latitude", "longitude", F.inline(winds))


def event_probabilities(spark, sf):
    """Share of returned lines per order, and whether the order is finished."""
    share = (
        table(spark, sf, "lineitem")
        .groupBy(F.col("l_orderkey").alias("case_id"))
        .agg(F.avg(F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0)).alias("probability"))
    )
    orders = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("case_id"), (F.col("o_orderstatus") == "F").alias("event")
    )
    return share.join(orders, "case_id")


def requests(spark, sf):
    """One extraction request per storm."""
    half = 12.5
    lists = F.array(*[F.array(*[F.lit(v) for v in names]) for names in VARIABLE_LISTS])
    return (
        numbered_tracks_years(spark, sf)
        .groupBy("storm_id", "user_id")
        .agg(
            F.min("timestamp").alias("start_time"),
            F.max("timestamp").alias("end_time"),
            (F.max("latitude") + half).alias("north"),
            (F.min("longitude") - half).alias("west"),
            (F.min("latitude") - half).alias("south"),
            (F.max("longitude") + half).alias("east"),
        )
        .withColumn("variables", F.element_at(lists, (F.col("user_id") % 3).cast("int") + 1))
    )
