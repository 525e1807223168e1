"""Queries on gridded fields, patches around storms and conservation."""

import uuid

from pyspark.sql import functions as F

from tempestry.operators import asof, hooks, ordered, patches
from tempestry.operators import conservation as cv
from tempestry.operators import grid as gr
from tempestry.operators import quality as dq
from tempestry.plans import training as tp
from tempestry.sources import sinks, staging
from workload import fixtures as fx
from workload.oracle_tables import r
from workload.registry import Registry

Q = Registry()
AT = '"time", latitude, longitude'
VARIABLES = [f[0] for f in fx.FIELDS]


@Q.add("grid_from_arrays", f"SELECT {AT}, {r(*VARIABLES)} FROM grid")
def _(spark, sf):
    return fx.grid(spark, sf)


@Q.add(
    "grid_wind",
    f"SELECT {AT}, {r('sqrt(u10 * u10 + v10 * v10) AS wind_speed', 'degrees(atan2(v10, u10)) AS wind_direction')} FROM grid",
)
def _(spark, sf):
    return gr.grid_wind(fx.grid(spark, sf)).select("time", "latitude", "longitude", "wind_speed", "wind_direction")


_E = "6.112e0 * exp(17.67e0 * (d2m - 273.15e0) / (d2m - 273.15e0 + 243.5e0))"
_SAT = "exp(17.625e0 * ({t} - 273.15e0) / (243.04e0 + {t} - 273.15e0))"
_RH = f"least(greatest(100e0 * {_SAT.format(t='d2m')} / {_SAT.format(t='t2m')}, 0e0), 100e0)"


@Q.add(
    "grid_thermo",
    f"""SELECT {AT}, {r("t2m * pow(1000e0 / msl, 287e0 / 1004e0) AS theta", f"{_RH} AS relative_humidity",
        "t2m - d2m AS dewpoint_depression")}, {r(f"0.622e0 * {_E} / (msl / 100e0 - 0.378e0 * {_E}) AS specific_humidity")}
        FROM grid""",
)
def _(spark, sf):
    made = gr.grid_thermo(fx.grid(spark, sf))
    return made.select(
        "time", "latitude", "longitude", "theta", "relative_humidity", "dewpoint_depression", "specific_humidity"
    )


@Q.add(
    "grid_shear",
    f"""SELECT {AT}, {r("u200 - u850 AS vertical_wind_shear_u", "v200 - v850 AS vertical_wind_shear_v",
        "sqrt((u200 - u850) * (u200 - u850) + (v200 - v850) * (v200 - v850)) AS vertical_wind_shear")} FROM grid""",
)
def _(spark, sf):
    made = gr.grid_shear(fx.grid(spark, sf))
    return made.select(
        "time", "latitude", "longitude", "vertical_wind_shear_u", "vertical_wind_shear_v", "vertical_wind_shear"
    )


def slope(value, axis, other):
    """Edge-aware derivative in SQL."""
    over = f'OVER (PARTITION BY "time", {other} ORDER BY {axis})'
    fb, xb, fa, xa = f"lag({value}) {over}", f"lag({axis}) {over}", f"lead({value}) {over}", f"lead({axis}) {over}"
    hs, hd = f"({axis} - {xb})", f"({xa} - {axis})"
    inside = (
        f"({hs} * {hs} * {fa} + ({hd} * {hd} - {hs} * {hs}) * {value} - {hd} * {hd} * {fb})"
        f" / ({hs} * {hd} * ({hd} + {hs}))"
    )
    return (
        f"CASE WHEN {xb} IS NULL THEN ({fa} - {value}) / {hd}"
        f" WHEN {xa} IS NULL THEN ({value} - {fb}) / {hs} ELSE {inside} END"
    )


def slopes(source, u, v):
    return f"""SELECT *, {slope(u, "longitude", "latitude")} AS dudx, {slope(v, "longitude", "latitude")} AS dvdx,
        {slope(u, "latitude", "longitude")} AS dudy, {slope(v, "latitude", "longitude")} AS dvdy FROM {source}"""


@Q.add(
    "grid_kinematics",
    f"SELECT {AT}, {r('dvdx - dudy AS vorticity_10m', '-(dudx + dvdy) AS convergence_10m')} FROM spun",
    {"spun": slopes("grid", "u10", "v10")},
)
def _(spark, sf):
    made = gr.grid_kinematics(fx.grid(spark, sf))
    return made.select("time", "latitude", "longitude", "vorticity_10m", "convergence_10m")


_PIVOT = "SELECT " + AT + ", " + ", ".join(
    f"max(CASE WHEN pressure_level = {p} THEN {c} END) AS {c}{p}" for p in (200, 850) for c in ("u", "v")
) + ' FROM levels GROUP BY "time", latitude, longitude'


@Q.add("level_pivot", f"SELECT {AT}, {r('u200', 'v200', 'u850', 'v850')} FROM pivoted", {"pivoted": _PIVOT})
def _(spark, sf):
    return gr.level_pivot(fx.levels(spark, sf), [200, 850])


@Q.add(
    "cube_outer_merge",
    f"""SELECT {AT}, {r("u10", "msl", "u200", "v850")} FROM (SELECT {AT}, u10, msl FROM grid) AS s
        FULL JOIN (SELECT "time" + INTERVAL 12 HOUR AS "time", latitude, longitude, u200, v850 FROM pivoted) AS p
        USING ({AT})""",
    {"pivoted": _PIVOT},
)
def _(spark, sf):
    single = fx.grid(spark, sf).select("time", "latitude", "longitude", "u10", "msl")
    upper = gr.level_pivot(fx.levels(spark, sf), [200, 850]).select(
        (F.col("time") + F.expr("interval 12 hours")).alias("time"), "latitude", "longitude", "u200", "v850"
    )
    return gr.cube_outer_merge(single, upper)


@Q.add(
    "yearly_union",
    f"""SELECT {AT}, {r("u10", "sst")} FROM grid UNION ALL
        SELECT "time" - INTERVAL 30 DAY, latitude, longitude, {r("u10", "sst")} FROM grid""",
)
def _(spark, sf):
    cube = fx.grid(spark, sf).select("time", "latitude", "longitude", "u10", "sst")
    earlier = cube.withColumn("time", F.col("time") - F.expr("interval 30 days"))
    return gr.yearly_union([earlier, cube])


_STATS = "\nUNION ALL ".join(
    f"SELECT '{v}' AS variable, avg({v}) AS mean, stddev_pop({v}) AS std FROM grid_gap" for v in VARIABLES
)


@Q.add("grid_stats_fit", f"SELECT variable, {r('mean', 'std')} FROM fitted", {"fitted": _STATS})
def _(spark, sf):
    return gr.grid_stats_fit(fx.grid_gap(spark, sf))


_Z = [
    f"({v} - (SELECT mean FROM fitted WHERE variable = '{v}')) / ((SELECT std FROM fitted WHERE variable = '{v}') + 1e-8) AS {v}"
    for v in VARIABLES
]


@Q.add("grid_zscore_nan", f"SELECT {AT}, {r(*_Z)} FROM grid_gap", {"fitted": _STATS})
def _(spark, sf):
    return gr.grid_zscore(fx.grid_nan(spark, sf))


@Q.add("grid_zscore", f"SELECT {AT}, {r(*_Z)} FROM grid_gap", {"fitted": _STATS})
def _(spark, sf):
    return gr.grid_zscore(fx.grid_gap(spark, sf))


@Q.add(
    "grid_to_tensor",
    f"""SELECT "time", channel, y, x, {r("value", digits=4)} FROM (
          SELECT "time", unnest(['u10', 'msl', 'sst']) AS channel, unnest([u10, msl, sst]) AS value,
            CAST((45 - latitude) / 5 AS BIGINT) AS y, CAST((longitude + 95) / 10 AS BIGINT) AS x
          FROM (SELECT "time", latitude, longitude, CAST(CAST(u10 AS FLOAT) AS DOUBLE) AS u10,
                  CAST(CAST(msl AS FLOAT) AS DOUBLE) AS msl, CAST(CAST(sst AS FLOAT) AS DOUBLE) AS sst FROM grid))""",
    digits=4,
)
def _(spark, sf):
    tensor = gr.grid_to_tensor(fx.grid(spark, sf), ["u10", "msl", "sst"])
    channels = tensor.select("time", F.posexplode("tensor").alias("c", "field"), "variables")
    lines = channels.select("time", F.get("variables", F.col("c")).alias("channel"), F.posexplode("field").alias("y", "line"))
    return lines.select("time", "channel", "y", F.posexplode("line").alias("x", "value"))


@Q.add(
    "dq_grid",
    "\nUNION ALL ".join(
        [f"SELECT 'required_variable' AS rule, '{v}' AS subject, 1e0 AS value, TRUE AS is_valid" for v in ("u10", "v10", "msl", "t2m")]
        + [f"SELECT 'required_dimension', '{d}', 1e0, TRUE" for d in ("time", "latitude", "longitude")]
        + [
            f"SELECT 'missing_share', '{v}', round((count(*) - count({v})) * 100e0 / count(*), 6), (count(*) - count({v})) * 100e0 / count(*) <= 10 FROM grid_gap"
            for v in VARIABLES
        ]
        + [
            f"SELECT 'range_{side}', '{axis}', {f}({axis}), {f}({axis}) {op} {bound} FROM grid_gap"
            for axis, low, high in (("latitude", -90, 90), ("longitude", -180, 360))
            for side, f, op, bound in (("low", "min", ">=", low), ("high", "max", "<=", high))
        ]
    ),
)
def _(spark, sf):
    return dq.dq_grid(fx.grid_gap(spark, sf))


# -- storms on the grid ------------------------------------------------------------------------

_SNAP = """TIMESTAMP '1970-01-01' + to_hours(CAST(12 * ((epoch_us("timestamp") + 21600000000) // 43200000000) AS INTEGER))"""


@Q.add(
    "nearest_hour_align",
    f"""SELECT storm_id, "timestamp", analysis_time FROM (SELECT *, {_SNAP} AS analysis_time FROM tracks)
        WHERE analysis_time IN (SELECT "time" FROM grid)""",
)
def _(spark, sf):
    aligned = patches.nearest_hour_align(fx.tracks(spark, sf), fx.grid(spark, sf), fx.GRID_STEP_HOURS)
    return aligned.select("storm_id", "timestamp", "analysis_time")


@Q.add(
    "pruned_box_read",
    f"""SELECT {AT}, {r("msl", "u10")}, true AS some_files_skipped FROM grid_dateline
        WHERE latitude BETWEEN 12 AND 33 AND (longitude >= 160 OR longitude <= -150)
          AND "time" BETWEEN TIMESTAMP '2024-01-02 00:00:00' AND TIMESTAMP '2024-01-09 12:00:00'""",
)
def _(spark, sf):
    path = f"{staging.shared_dir(spark)}/pruned-{uuid.uuid4().hex}"
    sinks.write_pruned_grid(fx.grid_dateline(spark, sf).select("time", "latitude", "longitude", "msl", "u10"), path, 24.0, 24)
    box = (12, 33, 160, -150, "2024-01-02 00:00:00", "2024-01-09 12:00:00")
    skipped = sinks.box_files(spark, path, *box).count() < spark.read.parquet(f"{path}/index").count()
    return sinks.read_box(spark, path, *box).withColumn("some_files_skipped", F.lit(skipped))


@Q.add(
    "nearest_analysis_join",
    """SELECT storm_id, "timestamp", latitude, arg_min("time", (gap, "time")) AS analysis_time FROM (
          SELECT t.*, a."time", abs(epoch_us(t."timestamp") - epoch_us(a."time")) AS gap
          FROM tracks AS t, (SELECT DISTINCT "time" FROM grid_irregular) AS a)
        GROUP BY storm_id, "timestamp", latitude""",
)
def _(spark, sf):
    return asof.nearest_analysis(fx.tracks(spark, sf), fx.grid_irregular(spark, sf)).select(
        "storm_id", "timestamp", "latitude", "analysis_time"
    )


@Q.add(
    "last_analysis_join",
    """SELECT storm_id, "timestamp", latitude, analysis_time FROM (
          SELECT storm_id, "timestamp", latitude, max(CASE WHEN a."time" <= t."timestamp"
            AND t."timestamp" - a."time" <= INTERVAL 9 HOUR THEN a."time" END) AS analysis_time
          FROM tracks AS t, (SELECT DISTINCT "time" FROM grid_irregular) AS a GROUP BY storm_id, "timestamp", latitude)""",
)
def _(spark, sf):
    times = fx.grid_irregular(spark, sf)
    found = asof.asof_join(
        fx.tracks(spark, sf), times, "timestamp", "time", "analysis_time", direction="backward", tolerance_hours=9
    )
    return found.select("storm_id", "timestamp", "latitude", "analysis_time")


def _inside(half):
    """Box of a fix that may cross the dateline, by brute force."""
    return f"""c.latitude BETWEEN t.latitude - {half} AND t.latitude + {half} AND (
        c.longitude BETWEEN t.longitude - {half} AND t.longitude + {half}
        OR c.longitude + 360 BETWEEN t.longitude - {half} AND t.longitude + {half}
        OR c.longitude - 360 BETWEEN t.longitude - {half} AND t.longitude + {half})"""


@Q.add(
    "patch_extract",
    f"""SELECT t.storm_id, t."timestamp", c."time", c.latitude, c.longitude, {r("c.msl AS msl", "c.u10 AS u10")}
        FROM (SELECT *, {_SNAP} AS at FROM tracks_dateline) AS t JOIN grid_dateline AS c
          ON c."time" = t.at AND {_inside("12.5e0")}""",
)
def _(spark, sf):
    found = patches.patch_extract(
        fx.grid_dateline(spark, sf), fx.tracks_dateline(spark, sf), 25.0, ["msl", "u10"], fx.GRID_STEP_HOURS
    )
    return found.select("storm_id", "timestamp", "time", "latitude", "longitude", "msl", "u10")


_SIDES = {
    "spans": """
        SELECT storm_id, min(latitude) - 12.5e0 AS lat_min, max(latitude) + 12.5e0 AS lat_max,
          min("timestamp") - INTERVAL 6 HOUR AS start_time, max("timestamp") + INTERVAL 6 HOUR AS end_time,
          min(longitude) AS low, max(longitude) AS high,
          min(longitude) FILTER (longitude >= 0) AS east_low, max(longitude) FILTER (longitude >= 0) AS east_high,
          min(longitude) FILTER (longitude < 0) AS west_low, max(longitude) FILTER (longitude < 0) AS west_high
        FROM tracks_dateline GROUP BY storm_id""",
    "sides": """
        SELECT storm_id, lat_min, lat_max, start_time, end_time, 'all' AS side, low - 12.5e0 AS lon_min, high + 12.5e0 AS lon_max
        FROM spans WHERE high - low <= 180 UNION ALL
        SELECT storm_id, lat_min, lat_max, start_time, end_time, 'east', east_low - 12.5e0, east_high + 12.5e0
        FROM spans WHERE high - low > 180 UNION ALL
        SELECT storm_id, lat_min, lat_max, start_time, end_time, 'west', west_low - 12.5e0, west_high + 12.5e0
        FROM spans WHERE high - low > 180""",
}


@Q.add("dateline_boxes", "SELECT * FROM sides", _SIDES)
def _(spark, sf):
    return patches.storm_boxes(fx.tracks_dateline(spark, sf))


_CUBE = {
    **_SIDES,
    "found": f"""
        SELECT storm_id, side, c."time", c.latitude, c.longitude, c.msl, c.sst FROM sides AS b JOIN grid_dateline AS c
          ON c."time" BETWEEN b.start_time AND b.end_time AND c.latitude BETWEEN b.lat_min AND b.lat_max
          AND (c.longitude BETWEEN b.lon_min AND b.lon_max OR c.longitude + 360 BETWEEN b.lon_min AND b.lon_max
            OR c.longitude - 360 BETWEEN b.lon_min AND b.lon_max)""",
}


@Q.add(
    "storm_cube_extract",
    f"""SELECT storm_id, side, "time", count(*) AS n_cells, {r("avg(msl) AS mean_msl", "min(sst) AS min_sst", digits=4)}
        FROM found GROUP BY storm_id, side, "time" """,
    _CUBE,
    digits=4,
)
def _(spark, sf):
    cube = patches.storm_cube_extract(
        fx.grid_dateline(spark, sf), fx.tracks_dateline(spark, sf), 25.0, ["msl", "sst"]
    )
    return cube.groupBy("storm_id", "side", "time").agg(
        F.count(F.lit(1)).alias("n_cells"), F.avg("msl").alias("mean_msl"), F.min("sst").alias("min_sst")
    )


@Q.add(
    "storm_package",
    f"""SELECT storm_id, n_fixes, coalesce(n_cells, 0) AS n_cells, n_tiles, {r("mean_msl", digits=4)}
        FROM (SELECT storm_id, count(*) AS n_fixes, 4 * count(*) AS n_tiles FROM tracks_dateline GROUP BY storm_id)
        LEFT JOIN (SELECT storm_id, count(*) AS n_cells, avg(msl) AS mean_msl FROM found GROUP BY storm_id) USING (storm_id)""",
    _CUBE,
    digits=4,
)
def _(spark, sf):
    package = tp.storm_package(
        {"best_track": fx.tracks_dateline(spark, sf)}, grid=fx.grid_dateline(spark, sf), include_tiles=True,
        variables=["msl"],
    )
    fixes = package.track.groupBy("storm_id").agg(F.count(F.lit(1)).alias("n_fixes"))
    cells = package.grid.groupBy("storm_id").agg(F.count(F.lit(1)).alias("n_cells"), F.avg("msl").alias("mean_msl"))
    tiles = package.tiles.groupBy("storm_id").agg(F.count(F.lit(1)).alias("n_tiles"))
    return fixes.join(cells, "storm_id", "left").join(tiles, "storm_id").fillna(0, ["n_cells"])


_CHANNELS = {
    "fixes": f"SELECT *, {_SNAP} AS at FROM tracks",
    "patch": f"""
        SELECT t.storm_id, t."timestamp", c.latitude, c.longitude, c.u10, c.v10, c.msl, c.sst,
          dense_rank() OVER (PARTITION BY t.storm_id, t."timestamp" ORDER BY c.latitude DESC) - 1 AS row,
          dense_rank() OVER (PARTITION BY t.storm_id, t."timestamp" ORDER BY c.longitude) - 1 AS col
        FROM fixes AS t JOIN grid AS c ON c."time" = t.at AND {_inside("12.5e0")}""",
    "joined": """
        SELECT storm_id, "timestamp", row, col,
          unnest([0e0, 0e0, 0e0, CAST(CAST(u10 AS FLOAT) AS DOUBLE), CAST(CAST(v10 AS FLOAT) AS DOUBLE),
            CAST(CAST(msl AS FLOAT) AS DOUBLE), CAST(CAST(sst AS FLOAT) AS DOUBLE)]) AS value,
          unnest(range(0, 7)) AS channel
        FROM patch""",
}


@Q.add(
    "channel_concat",
    f"""SELECT storm_id, "timestamp", row, col, channel, {r("value", digits=4)} FROM joined""",
    _CHANNELS,
    digits=4,
)
def _(spark, sf):
    packed = tp.patch_channels(fx.tracks(spark, sf), fx.grid(spark, sf), fx.GRID_STEP_HOURS)
    return packed.select("storm_id", "timestamp", "row", "col", F.posexplode("channels").alias("channel", "value"))


@Q.add(
    "aligned_windows_patches",
    f"""SELECT a.storm_id, a.i AS window_index, b.i - a.i AS place, row, col, channel, b.latitude, b.max_wind,
          min(CASE WHEN channel IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY a.storm_id, a.i) = 1 AS complete,
          {r("value", digits=4)}
        FROM placed AS a JOIN placed AS b ON a.storm_id = b.storm_id AND b.i BETWEEN a.i AND a.i + 1
        LEFT JOIN joined AS j ON j.storm_id = b.storm_id AND j."timestamp" = b."timestamp"
        WHERE a.i + 3 <= a.n AND a.i < (SELECT min(greatest(n - 3 + 1, 0)) FROM placed)""",
    {
        **_CHANNELS,
        "placed": """SELECT *, row_number() OVER (PARTITION BY storm_id ORDER BY "timestamp") - 1 AS i,
            count(*) OVER (PARTITION BY storm_id) AS n FROM tracks""",
    },
    digits=4,
)
def _(spark, sf):
    made = tp.aligned_windows_patches(
        fx.tracks(spark, sf), fx.grid(spark, sf), fx.GRID_STEP_HOURS, 2, 1, numbered=ordered.POINT,
        coordinates=fx.grid_coordinates(spark, sf),
    )
    return made.select(
        "storm_id", "window_index", F.col("position").alias("place"), "row", "col",
        F.element_at("state", 1).alias("latitude"), F.element_at("state", 3).alias("max_wind"),
        "complete", F.posexplode_outer("channels").alias("channel", "value"),
    )


#: By brute force: columns in the order of their distance east of the patch's west edge.
_DATELINE_CHANNELS = {
    "fixes_dateline": f"SELECT *, {_SNAP} AS at FROM tracks_dateline",
    "patch_dateline": f"""
        SELECT t.storm_id, t."timestamp", t.max_wind, c.u10, c.msl,
          dense_rank() OVER (PARTITION BY t.storm_id, t."timestamp" ORDER BY c.latitude DESC) - 1 AS row,
          dense_rank() OVER (PARTITION BY t.storm_id, t."timestamp"
            ORDER BY (c.longitude - (t.longitude - 12.5e0) + 720e0) % 360e0) - 1 AS col
        FROM fixes_dateline AS t JOIN grid_dateline AS c ON c."time" = t.at AND {_inside("12.5e0")}""",
    "quartered_dateline": """
        SELECT *, CASE WHEN row * 2 > max(row) OVER w THEN 1 ELSE 0 END AS tr, CASE WHEN col * 2 > max(col) OVER w THEN 1 ELSE 0 END AS tc
        FROM patch_dateline WINDOW w AS (PARTITION BY storm_id, "timestamp")""",
    "joined_dateline": """
        SELECT storm_id, "timestamp", row, col,
          unnest([CAST(CAST(max_wind + tr * 100 + tc * 10 AS FLOAT) AS DOUBLE), tr * 2e0 + tc - 4,
            CAST(CAST(u10 AS FLOAT) AS DOUBLE), CAST(CAST(msl AS FLOAT) AS DOUBLE)]) AS value, unnest(range(0, 4)) AS channel
        FROM quartered_dateline""",
}


@Q.add(
    "channel_concat_dateline",
    f"""SELECT storm_id, "timestamp", row, col, channel, {r("value", digits=4)} FROM joined_dateline""",
    _DATELINE_CHANNELS,
    digits=4,
)
def _(spark, sf):
    packed = tp.patch_channels(
        fx.tracks_dateline(spark, sf), fx.grid_dateline(spark, sf), fx.GRID_STEP_HOURS, channels=["u10", "msl"],
        tiles=fx.tiles_dateline(spark, sf),
    )
    return packed.select("storm_id", "timestamp", "row", "col", F.posexplode("channels").alias("channel", "value"))


# -- conservation ------------------------------------------------------------------------------


def _by_time(aggregates):
    return f'SELECT "time", {aggregates} FROM grid GROUP BY "time"'


@Q.add(
    "loss_mse",
    f"""SELECT {AT}, {r("loss", "(u10 - u850) * 2e0 / n AS gradient")} FROM grid JOIN totals USING ("time")""",
    {"totals": _by_time("avg((u10 - u850) * (u10 - u850)) AS loss, count(*) AS n")},
)
def _(spark, sf):
    made = cv.loss_mse(fx.grid(spark, sf), "u10", "u850", ["time"])
    return made.select("time", "latitude", "longitude", "loss", "gradient")


@Q.add(
    "loss_mass",
    f"""SELECT {AT}, {r("gap * gap AS loss", "2e0 * gap AS gradient", digits=3)} FROM grid,
        (SELECT sum(u10) - sum(u850) AS gap FROM grid)""",
    digits=3,
)
def _(spark, sf):
    made = cv.loss_mass(fx.grid(spark, sf), "u10", "u850")
    return made.select("time", "latitude", "longitude", "loss", "gradient")


@Q.add(
    "loss_momentum",
    f"""SELECT {AT}, {r("gu * gu + gv * gv AS loss", "2e0 * gu AS gradient_u", "2e0 * gv AS gradient_v", digits=4)}
        FROM grid JOIN totals USING ("time")""",
    {"totals": _by_time("sum(u10) - sum(u850) AS gu, sum(v10) - sum(v850) AS gv")},
    digits=4,
)
def _(spark, sf):
    made = cv.loss_momentum(fx.grid(spark, sf), ("u10", "v10"), ("u850", "v850"), ["time"])
    return made.select("time", "latitude", "longitude", "loss", "gradient_u", "gradient_v")


_KE = "((u10 * u10 + v10 * v10) * 0.5e0 - (u850 * u850 + v850 * v850) * 0.5e0)"


@Q.add(
    "loss_kinetic",
    f"""SELECT {AT}, {r("loss", f"2e0 * {_KE} / n * u10 AS gradient_u", f"2e0 * {_KE} / n * v10 AS gradient_v", digits=4)}
        FROM grid JOIN totals USING ("time")""",
    {"totals": _by_time(f"avg({_KE} * {_KE}) AS loss, count(*) AS n")},
    digits=4,
)
def _(spark, sf):
    made = cv.loss_kinetic(fx.grid(spark, sf), ("u10", "v10"), ("u850", "v850"), ["time"])
    return made.select("time", "latitude", "longitude", "loss", "gradient_u", "gradient_v")


def _field_sql(t, u, v):
    return f"SELECT {AT}, msl / (287e0 * {t}) AS density, {u} AS u, {v} AS v, {t} AS temperature, 10e0 AS height, cos(radians(latitude)) AS weight FROM grid"


def _totals_sql(spun):
    return f"""SELECT "time", sum(density * weight) AS mass,
        sum((density * (u * u + v * v) * 0.5e0 + density * temperature * 1004e0 + density * height * 9.81e0) * weight) AS energy,
        sum((dvdx - dudy) * weight) AS vorticity FROM {spun} GROUP BY "time" """


def _fields(cube, t, u, v):
    return cv.with_cell_weight(cube).select(
        "time", "latitude", "longitude", "weight",
        (F.col("msl") / (F.col(t) * 287.0)).alias("density"), F.col(u).alias("u"), F.col(v).alias("v"),
        F.col(t).alias("temperature"), F.lit(10.0).alias("height"),
    )


@Q.add(
    "conservation_errors",
    "SELECT "
    + r(*[f"avg(abs(p.{q} - t.{q}) / abs(t.{q})) AS {q}_error" for q in ("mass", "energy", "vorticity")])
    + ' FROM predicted_totals AS p JOIN true_totals AS t USING ("time")',
    {
        "true_fields": _field_sql("t2m", "u10", "v10"),
        "predicted_fields": _field_sql("d2m", "u850", "v850"),
        "true_spun": slopes("true_fields", "u", "v"),
        "predicted_spun": slopes("predicted_fields", "u", "v"),
        "true_totals": _totals_sql("true_spun"),
        "predicted_totals": _totals_sql("predicted_spun"),
    },
)
def _(spark, sf):
    cube = fx.grid(spark, sf)
    return cv.conservation_errors(_fields(cube, "d2m", "u850", "v850"), _fields(cube, "t2m", "u10", "v10"))


# -- models ------------------------------------------------------------------------------------


def _vectors(spark, sf):
    return fx.table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("state"))


@Q.add(
    "model_score",
    f"""SELECT vec_id, pos, {r("value", digits=5)} FROM (
          SELECT vec_id, unnest(range(0, CAST(len(embedding) AS BIGINT))) AS pos,
            CAST(CAST(unnest(embedding) AS FLOAT) + CAST(1 AS FLOAT) AS DOUBLE) AS value FROM embeddings)""",
    digits=5,
)
def _(spark, sf):
    scored = hooks.model_score(_vectors(spark, sf), "state", lambda state: state + 1)
    return scored.select("vec_id", F.posexplode("prediction").alias("pos", "value"))


@Q.add(
    "model_rollout",
    f"""SELECT vec_id, step, pos, {r("v * pow(2e0, step) AS value", digits=5)} FROM (
          SELECT vec_id, unnest(range(0, CAST(len(embedding) AS BIGINT))) AS pos, CAST(unnest(embedding) AS DOUBLE) AS v
          FROM embeddings), range(1, 4) AS steps(step)""",
    digits=5,
)
def _(spark, sf):
    rolled = hooks.model_rollout(_vectors(spark, sf), "state", lambda state: state * 2, 3, every_step=True)
    return rolled.select("vec_id", "step", F.posexplode("prediction").alias("pos", "value"))
