"""Queries on sources, selections, features, windows and quality of tracks."""

from pyspark.sql import functions as F

from tempestry.functions.clock import temporal_features
from tempestry.operators import features as ft
from tempestry.operators import ordered
from tempestry.operators import quality as dq
from tempestry.operators import tracks as tr
from tempestry.plans import forecast as fc
from tempestry.plans import training as tp
from tempestry.sources import arrays, best_track, requests, tiles
from workload import fixtures as fx
from workload.oracle_tables import OVER, TRACK, r
from workload.registry import Registry

Q = Registry()

# -- sources -----------------------------------------------------------------------------------

_TEXT = r"""
SELECT storm_id, name, date_trunc('minute', "timestamp") AS "timestamp", '' AS record_identifier, storm_type,
  round(latitude, 1) AS latitude, round(longitude, 1) AS longitude, round(max_wind) AS max_wind,
  {pressure} AS min_pressure, r34_ne, r34_se, r34_sw, r34_nw
FROM base_tracks"""


@Q.add("track_text_parse", _TEXT.format(pressure="round(min_pressure)"))
def _(spark, sf):
    return best_track.scan_lines(fx.in_file_order(fx.track_text(spark, sf)), r"^[A-Z]{2}\d{6,},")


@Q.add(
    "track_sentinel_nulls",
    """SELECT storm_id, count(*) AS n_rows, count(r34_ne) AS n_ne, count(r34_se) AS n_se, count(r34_sw) AS n_sw,
         count(r34_nw) AS n_nw, count(min_pressure) AS n_pressure,
         CAST(sum(CASE WHEN round(max_wind) < 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_negative_wind
       FROM base_tracks GROUP BY storm_id""",
)
def _(spark, sf):
    parsed = best_track.parse_lines(fx.track_text(spark, sf), r"^[A-Z]{2}\d{6,},")
    return parsed.groupBy("storm_id").agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.count(f"r34_{q}").alias(f"n_{q}") for q in ("ne", "se", "sw", "nw")],
        F.count("min_pressure").alias("n_pressure"),
        F.count(F.when(F.col("max_wind") < 0, 1)).alias("n_negative_wind"),
    )


@Q.add(
    "array_storms_explode",
    f"""SELECT storm_id, name, "timestamp", latitude, longitude, max_wind, {r("min_pressure")}
        FROM base_tracks WHERE event_id % 29 <> 0 AND event_id % 31 <> 0""",
)
def _(spark, sf):
    return arrays.explode_storm_arrays(fx.storm_arrays(spark, sf))


_SPLIT = {
    "periods": """
        SELECT storm_id, start_time, end_time, y AS year,
          CASE WHEN year(start_time) = year(end_time) THEN start_time
               ELSE greatest(start_time, make_timestamp(y, 1, 1, 0, 0, 0)) END AS period_start,
          CASE WHEN year(start_time) = year(end_time) THEN end_time
               ELSE least(end_time, make_timestamp(y, 12, 31, 23, 59, 59.999999)) END AS period_end
        FROM (SELECT *, unnest(range(year(start_time), year(end_time) + 1)) AS y FROM requests)"""
}


@Q.add("year_split_periods", "SELECT storm_id, year, period_start, period_end FROM periods", _SPLIT)
def _(spark, sf):
    split = requests.year_split_periods(fx.requests(spark, sf))
    return split.select("storm_id", "year", "period_start", "period_end")


@Q.add(
    "period_day_expand",
    """SELECT storm_id, year, CAST(d AS DATE) AS date, h AS hour
       FROM (SELECT storm_id, year, unnest(generate_series(CAST(period_start AS DATE), CAST(period_end AS DATE), INTERVAL 1 DAY)) AS d
             FROM periods WHERE period_start <= period_end), range(0, 24) AS hours(h)""",
    _SPLIT,
)
def _(spark, sf):
    days = requests.period_day_expand(requests.year_split_periods(fx.requests(spark, sf)))
    return days.select("storm_id", "year", "date", "hour")


_SINGLE = "[" + ", ".join(f"'{v}'" for v in requests.SINGLE_LEVEL) + "]"


@Q.add(
    "variable_routing",
    f"""SELECT storm_id,
          array_to_string(list_filter(variables, lambda v: list_contains({_SINGLE}, v)), ',') AS single_level,
          array_to_string(list_filter(variables, lambda v: NOT list_contains({_SINGLE}, v)), ',') AS pressure_level,
          CASE WHEN len(list_filter(variables, lambda v: NOT list_contains({_SINGLE}, v))) > 0
               THEN '200,850' ELSE '' END AS levels
        FROM requests""",
)
def _(spark, sf):
    routed = requests.variable_routing(fx.requests(spark, sf))
    joined = [F.array_join(c, ",").alias(c) for c in ("single_level", "pressure_level", "levels")]
    return routed.select("storm_id", *joined)


_KEYS = {
    "keyed": """
        SELECT *, 'era_' || strftime(start_time, '%Y%m%d') || '_' || strftime(end_time, '%Y%m%d') || '_'
          || CAST(north AS VARCHAR) || 'N_' || CAST(abs(west) AS VARCHAR) || 'W_'
          || CAST(south AS VARCHAR) || 'N_' || CAST(abs(east) AS VARCHAR) || 'W_'
          || substr(md5(array_to_string(list_sort(variables), ',')), 1, 8) AS extract_key
        FROM requests"""
}


@Q.add("extract_key", "SELECT storm_id, extract_key FROM keyed", _KEYS)
def _(spark, sf):
    keyed = requests.extract_key(fx.requests(spark, sf), "era")
    return keyed.select("storm_id", "extract_key")


@Q.add(
    "pending_extracts",
    """SELECT storm_id, extract_key FROM keyed
       WHERE extract_key NOT IN (SELECT extract_key FROM keyed WHERE user_id % 4 = 0)""",
    _KEYS,
)
def _(spark, sf):
    keyed = requests.extract_key(fx.requests(spark, sf), "era")
    kept = keyed.filter(F.col("user_id") % 4 == 0)
    return requests.pending_extracts(keyed, kept).select("storm_id", "extract_key")


_BOX = {
    "box": """
        SELECT storm_id, min(latitude) - 12.5e0 AS lat_min, max(latitude) + 12.5e0 AS lat_max,
          min(longitude) - 12.5e0 AS lon_min, max(longitude) + 12.5e0 AS lon_max FROM tracks GROUP BY storm_id"""
}


@Q.add(
    "tile_placeholders",
    """SELECT storm_id, "timestamp" AS "time", latitude, longitude, 0e0 AS ir1, 0e0 AS ir2, 0e0 AS water_vapor
       FROM (SELECT storm_id, "timestamp", unnest([lat_min, lat_max]) AS latitude, lon_min, lon_max
             FROM tracks JOIN box USING (storm_id)) AS a,
            LATERAL (SELECT unnest([lon_min, lon_max]) AS longitude) AS b""",
    {"box": _BOX["box"], },
)
def _(spark, sf):
    return tiles.tile_placeholders(fx.tracks(spark, sf))


# -- selections and catalogues -----------------------------------------------------------------

_ALL = f"""SELECT storm_id, name, "timestamp", storm_type, latitude, longitude, max_wind, {r("min_pressure")},
  r34_ne, r34_se, r34_sw, r34_nw"""


@Q.add("storm_by_id", f"{_ALL} FROM tracks WHERE storm_id = 'EV000003'")
def _(spark, sf):
    return tr.storm_by_id(fx.tracks(spark, sf), "EV000003")


@Q.add("storms_by_year", 'SELECT DISTINCT storm_id FROM tracks_years WHERE year("timestamp") = 2023')
def _(spark, sf):
    return tr.storms_by_year(fx.tracks_years(spark, sf), 2023)


@Q.add("storms_by_name", "SELECT DISTINCT storm_id FROM tracks WHERE name = 'STORM7'")
def _(spark, sf):
    return tr.storms_by_name(fx.tracks(spark, sf), "storm7")


_FILE_ORDER = {
    "parts": """
        SELECT *, CASE WHEN k <= 3 THEN 1 ELSE 0 END AS again, 'F' || CAST(user_id // 40 AS VARCHAR) AS file FROM base_tracks""",
    "written": """
        SELECT file, again, user_id, k, storm_id, name || CASE WHEN again = 1 THEN 'X' ELSE '' END AS name, "timestamp" FROM parts
        UNION ALL SELECT DISTINCT file, again, user_id, 0, storm_id, NULL, NULL FROM parts""",
    "placed": "SELECT *, row_number() OVER (PARTITION BY file ORDER BY again, user_id, k) - 1 AS line_no FROM written",
}


@Q.add(
    "catalog_file_order",
    "SELECT storm_id, arg_min(name, line_no) AS name FROM placed WHERE k > 0 GROUP BY storm_id",
    _FILE_ORDER,
)
def _(spark, sf):
    lines = fx.in_file_order(fx.renamed_text(spark, sf))
    parsed = best_track.scan_lines(lines, r"^[A-Z]{2}\d{6,},", line_numbers=True)
    return tr.storm_catalog(parsed, ["file", "line_no"])


@Q.add(
    "file_line_numbers",
    """SELECT storm_id, name, date_trunc('minute', "timestamp") AS "timestamp", file, line_no FROM placed WHERE k > 0""",
    _FILE_ORDER,
)
def _(spark, sf):
    lines = fx.in_file_order(fx.renamed_text(spark, sf))
    parsed = best_track.scan_lines(lines, r"^[A-Z]{2}\d{6,},", line_numbers=True)
    return parsed.select("storm_id", "name", "timestamp", "file", "line_no")


@Q.add("storm_catalog", 'SELECT storm_id, arg_min(name, "timestamp") AS name FROM tracks GROUP BY storm_id')
def _(spark, sf):
    return tr.storm_catalog(fx.tracks(spark, sf))


@Q.add(
    "recent_storms",
    """SELECT storm_id, name, y AS year FROM (
         SELECT *, CAST(substr(storm_id, 5, 4) AS BIGINT) AS y FROM (SELECT DISTINCT storm_id, name FROM tracks))
       WHERE y >= 3 ORDER BY storm_id DESC LIMIT 10""",
)
def _(spark, sf):
    return tr.recent_storms(tr.storm_catalog(fx.tracks(spark, sf)), since_year=3)


@Q.add(
    "storm_list_tracks",
    f"{_ALL} FROM tracks WHERE storm_id IN (SELECT storm_id FROM tracks WHERE max_wind >= 100)",
)
def _(spark, sf):
    rows = fx.tracks(spark, sf)
    listed = rows.filter(F.col("max_wind") >= 100).select("storm_id").distinct()
    return tr.storm_list_tracks(rows, listed)


@Q.add(
    "season_split",
    """SELECT storm_id, "timestamp", CASE WHEN year("timestamp") BETWEEN 2010 AND 2019 THEN 'train'
         WHEN year("timestamp") BETWEEN 2020 AND 2021 THEN 'validation'
         WHEN year("timestamp") BETWEEN 2022 AND 2023 THEN 'test' ELSE 'unassigned' END AS split
       FROM tracks_years""",
)
def _(spark, sf):
    return tr.season_split(fx.tracks_years(spark, sf)).select("storm_id", "timestamp", "split")


_TRAIN = ["EV000000", "EV000001", "EV000002"]
_VALID = ["EV000003", "EV000004"]


@Q.add(
    "storm_list_split",
    f"""SELECT DISTINCT storm_id, split FROM (
          SELECT storm_id, CASE WHEN storm_id IN ({", ".join(f"'{s}'" for s in _TRAIN)}) THEN 'train'
            WHEN storm_id IN ({", ".join(f"'{s}'" for s in _VALID)}) THEN 'validation'
            WHEN year("timestamp") IN (2022, 2023) THEN 'test' END AS split FROM tracks_years)
        WHERE split IS NOT NULL""",
)
def _(spark, sf):
    return tr.storm_list_split(fx.tracks_years(spark, sf), _TRAIN, _VALID)


@Q.add(
    "history_truth_split",
    f"""SELECT storm_id, "timestamp", latitude, longitude, max_wind, step,
          CASE WHEN step <= 12 THEN 'history' ELSE 'truth' END AS role
        FROM (SELECT *, row_number() {OVER} AS step FROM tracks) WHERE step <= 20""",
)
def _(spark, sf):
    split = tr.history_truth_split(fx.tracks(spark, sf), 12, 8)
    return split.select("storm_id", "timestamp", "latitude", "longitude", "max_wind", "step", "role")


@Q.add(
    "last_fix",
    f"""{_ALL} FROM (SELECT *, row_number() OVER (PARTITION BY storm_id ORDER BY "timestamp" DESC) AS age FROM tracks)
        WHERE age = 1""",
)
def _(spark, sf):
    return tr.last_fix(fx.tracks(spark, sf))


@Q.add("archive_counts", "SELECT count(*) AS n_records, count(DISTINCT storm_id) AS n_storms FROM tracks")
def _(spark, sf):
    return tr.archive_counts(fx.tracks(spark, sf))


@Q.add("peak_intensity", "SELECT storm_id, max(max_wind) AS max_intensity FROM tracks GROUP BY storm_id")
def _(spark, sf):
    return tr.peak_intensity(fx.tracks(spark, sf))


@Q.add(
    "storm_bbox",
    """SELECT storm_id, min(latitude) - 12.5e0 AS lat_min, max(latitude) + 12.5e0 AS lat_max,
         min(longitude) - 12.5e0 AS lon_min, max(longitude) + 12.5e0 AS lon_max,
         min("timestamp") AS start_time, max("timestamp") AS end_time FROM tracks GROUP BY storm_id""",
)
def _(spark, sf):
    return tr.storm_bbox(fx.tracks(spark, sf), 12.5)


@Q.add(
    "storm_summary",
    f"""SELECT storm_id, min("timestamp") AS start_time, max("timestamp") AS end_time, max(max_wind) AS max_intensity,
          {r("min(min_pressure) AS min_pressure")}, count(*) AS num_records FROM tracks_dirty GROUP BY storm_id""",
)
def _(spark, sf):
    return tr.storm_summary(fx.tracks_dirty(spark, sf))


@Q.add(
    "training_catalog",
    f"""SELECT storm_id, name, year, max_intensity, {r("min_pressure")}, num_records
        FROM (SELECT storm_id, arg_min(name, "timestamp") AS name, max(max_wind) AS max_intensity,
                min(min_pressure) AS min_pressure, count(*) AS num_records FROM tracks_years GROUP BY storm_id)
        JOIN (SELECT DISTINCT storm_id, year("timestamp") AS year FROM tracks_years) USING (storm_id)
        WHERE year IN (2023, 2024) AND max_intensity >= 64""",
)
def _(spark, sf):
    return tr.training_catalog(fx.tracks_years(spark, sf), [2023, 2024], 64)


_PER_YEAR = {
    "per_year": """SELECT year("timestamp") AS year, count(DISTINCT storm_id) AS n_storms FROM tracks_years GROUP BY 1"""
}


@Q.add("storms_per_year", "SELECT year, n_storms FROM per_year UNION ALL SELECT 2022, 0", _PER_YEAR)
def _(spark, sf):
    return tr.storms_per_year(fx.tracks_years(spark, sf), [2022, 2023, 2024])


@Q.add(
    "year_activity",
    f"""SELECT {r("avg(n_storms) AS average_storms")},
          (SELECT year FROM per_year ORDER BY n_storms DESC, year LIMIT 1) AS most_active_year,
          max(n_storms) AS most_active_storms,
          (SELECT year FROM per_year ORDER BY n_storms, year LIMIT 1) AS least_active_year,
          min(n_storms) AS least_active_storms FROM per_year""",
    _PER_YEAR,
)
def _(spark, sf):
    return tr.year_activity(tr.storms_per_year(fx.tracks_years(spark, sf)))


@Q.add(
    "storm_category",
    """SELECT storm_id, "timestamp", max_wind, CAST(CASE WHEN max_wind >= 137 THEN 5 WHEN max_wind >= 113 THEN 4
         WHEN max_wind >= 96 THEN 3 WHEN max_wind >= 83 THEN 2 WHEN max_wind >= 64 THEN 1 ELSE 0 END AS BIGINT) AS category
       FROM tracks""",
)
def _(spark, sf):
    return tr.add_category(fx.tracks(spark, sf)).select("storm_id", "timestamp", "max_wind", "category")


_TYPES = ["click", "error", "purchase", "view"]


@Q.add(
    "storm_type_onehot",
    'SELECT storm_id, "timestamp", '
    + ", ".join(f"CAST(CASE WHEN storm_type = '{t}' THEN 1 ELSE 0 END AS BIGINT) AS storm_type_{t}" for t in _TYPES)
    + " FROM tracks",
)
def _(spark, sf):
    flags = [f"storm_type_{t}" for t in _TYPES]
    return tr.one_hot(fx.tracks(spark, sf), "storm_type", _TYPES).select("storm_id", "timestamp", *flags)


@Q.add(
    "archive_union",
    f"""{_ALL} FROM tracks UNION ALL
        {_ALL} FROM tracks_years AS s
        WHERE NOT EXISTS (SELECT 1 FROM tracks AS p WHERE p.storm_id = s.storm_id AND p."timestamp" = s."timestamp")""",
)
def _(spark, sf):
    return tr.archive_union(fx.tracks(spark, sf), fx.tracks_years(spark, sf))


# -- features and windows ----------------------------------------------------------------------

_FEATURES = {
    "motion": f"""
        SELECT *, (latitude - lag(latitude) {OVER}) / 6e0 AS lat_velocity,
          (longitude - lag(longitude) {OVER}) / 6e0 AS lon_velocity,
          max_wind - lag(max_wind) {OVER} AS wind_change,
          min_pressure - lag(min_pressure) {OVER} AS pressure_change FROM {{source}}""",
    "made": f"""
        SELECT storm_id, name, "timestamp", storm_type, coalesce(latitude, 0) AS latitude,
          coalesce(longitude, 0) AS longitude, coalesce(max_wind, 0) AS max_wind,
          coalesce(min_pressure, 0) AS min_pressure, coalesce(r34_ne, 0) AS r34_ne, coalesce(r34_se, 0) AS r34_se,
          coalesce(r34_sw, 0) AS r34_sw, coalesce(r34_nw, 0) AS r34_nw,
          coalesce(lat_velocity, 0) AS lat_velocity, coalesce(lon_velocity, 0) AS lon_velocity,
          coalesce(sqrt(lat_velocity * lat_velocity + lon_velocity * lon_velocity), 0) AS speed,
          coalesce(lat_velocity - lag(lat_velocity) {OVER}, 0) AS lat_acceleration,
          coalesce(lon_velocity - lag(lon_velocity) {OVER}, 0) AS lon_acceleration,
          coalesce(wind_change, 0) AS wind_change, coalesce(pressure_change, 0) AS pressure_change,
          CASE WHEN wind_change >= 30 THEN 1e0 ELSE 0e0 END AS rapid_intensification,
          coalesce(degrees(atan2(lon_velocity, lat_velocity)), 0) AS heading,
          hour("timestamp") AS hour, dayofyear("timestamp") AS day_of_year,
          sin(hour("timestamp") * (2 * pi()) / 24e0) AS hour_sin, cos(hour("timestamp") * (2 * pi()) / 24e0) AS hour_cos,
          sin(dayofyear("timestamp") * (2 * pi()) / 365e0) AS day_sin,
          cos(dayofyear("timestamp") * (2 * pi()) / 365e0) AS day_cos
        FROM motion""",
}


def _features_of(source):
    return {name: text.replace("{source}", source) for name, text in _FEATURES.items()}


_MADE = [
    "latitude", "longitude", "max_wind", "min_pressure", "lat_velocity", "lon_velocity", "speed", "lat_acceleration",
    "lon_acceleration", "wind_change", "pressure_change", "rapid_intensification", "heading", "hour_sin", "hour_cos",
    "day_sin", "day_cos",
]


@Q.add(
    "track_features",
    f"""SELECT storm_id, name, "timestamp", storm_type, r34_ne, r34_se, r34_sw, r34_nw, hour, day_of_year,
        {r(*_MADE)} FROM made""",
    _features_of("tracks_dirty"),
)
def _(spark, sf):
    return ft.track_features(fx.tracks_dirty(spark, sf))


@Q.add(
    "temporal_features",
    f"""SELECT storm_id, "timestamp", hour, day_of_year, {r("hour_sin", "hour_cos", "day_sin", "day_cos")} FROM made""",
    _features_of("tracks_years"),
)
def _(spark, sf):
    made = temporal_features(fx.tracks_years(spark, sf))
    return made.select("storm_id", "timestamp", "hour", "day_of_year", "hour_sin", "hour_cos", "day_sin", "day_cos")


HAVERSINE = (
    "CASE WHEN {a} IS NOT NULL THEN 2 * 6371e0 * asin(sqrt(least(1e0, pow(sin(radians({b} - {a}) / 2), 2)"
    " + cos(radians({a})) * cos(radians({b})) * pow(sin(radians({d} - {c}) / 2), 2)))) END"
)


@Q.add(
    "haversine_steps",
    f"""SELECT storm_id, "timestamp", {r(HAVERSINE.format(a="a", b="latitude", c="c", d="longitude") + " AS step_km")}
        FROM (SELECT *, lag(latitude) {OVER} AS a, lag(longitude) {OVER} AS c FROM tracks)""",
)
def _(spark, sf):
    return ft.haversine_steps(fx.tracks(spark, sf), numbered=ordered.POINT).select("storm_id", "timestamp", "step_km")


def _fit_sql(source, by=""):
    items = [f"{by} count(*) AS n_rows"]
    for c in ft.STATE_FEATURES:
        items.append(f"avg({c}) AS {c}_mean, stddev_pop({c}) AS {c}_std")
    return f"SELECT {', '.join(items)} FROM {source}" + (f" GROUP BY {by.rstrip(',')}" if by else "")


_STATS = [f"{c}_{s}" for c in ft.STATE_FEATURES for s in ("mean", "std")]
_Z = [
    f"(t.{c} - {c}_mean) / (CASE WHEN {c}_std = 0 THEN 1 ELSE {c}_std END)"
    f" * (CASE WHEN n_rows > 1 THEN sqrt((n_rows - 1) / n_rows) ELSE 1 END) AS {c}"
    for c in ft.STATE_FEATURES
]


@Q.add("scaler_fit", f"SELECT n_rows, {r(*_STATS)} FROM fitted", {"fitted": _fit_sql("tracks_dirty")})
def _(spark, sf):
    return ft.scaler_fit(fx.tracks_dirty(spark, sf))


@Q.add(
    "track_zscore",
    f'SELECT storm_id, "timestamp", {r(*_Z)} FROM tracks_dirty AS t, fitted',
    {"fitted": _fit_sql("tracks_dirty")},
)
def _(spark, sf):
    scaled = ft.track_zscore(fx.tracks_dirty(spark, sf))
    return scaled.select("storm_id", "timestamp", *ft.STATE_FEATURES)


@Q.add("scaler_fit_nan", f"SELECT n_rows, {r(*_STATS)} FROM fitted", {"fitted": _fit_sql("tracks_nan")})
def _(spark, sf):
    return ft.scaler_fit(fx.tracks_nan(spark, sf))


@Q.add(
    "track_zscore_nan",
    f'SELECT storm_id, "timestamp", {r(*_Z)} FROM tracks_nan AS t, fitted',
    {"fitted": _fit_sql("tracks_nan")},
)
def _(spark, sf):
    scaled = ft.track_zscore(fx.tracks_nan(spark, sf))
    return scaled.select("storm_id", "timestamp", *ft.STATE_FEATURES)


@Q.add(
    "track_zscore_by_storm",
    f'SELECT storm_id, "timestamp", {r(*_Z)} FROM tracks_dirty AS t JOIN fitted USING (storm_id)',
    {"fitted": _fit_sql("tracks_dirty", "storm_id,")},
)
def _(spark, sf):
    scaled = ft.track_zscore(fx.tracks_dirty(spark, sf), ["storm_id"])
    return scaled.select("storm_id", "timestamp", *ft.STATE_FEATURES)


@Q.add(
    "zscore_transform",
    f'SELECT storm_id, "timestamp", {r(*_Z)} FROM tracks_dateline AS t, fitted',
    {"fitted": _fit_sql("tracks_dirty")},
)
def _(spark, sf):
    fitted = ft.scaler_fit(fx.tracks_dirty(spark, sf))
    scaled = ft.zscore_transform(fx.tracks_dateline(spark, sf), fitted)
    return scaled.select("storm_id", "timestamp", *ft.STATE_FEATURES)


_NUMBERED = f'SELECT *, row_number() {OVER} - 1 AS i, count(*) OVER (PARTITION BY storm_id) AS n FROM '


def _windows_sql(length, values, limit="TRUE"):
    """Windows in long form: window start i, place p in the window, one row each."""
    return f"""SELECT a.storm_id, a.i AS window_index, b.i - a.i AS place, {values}
        FROM placed AS a JOIN placed AS b ON a.storm_id = b.storm_id AND b.i BETWEEN a.i AND a.i + {length - 1}
        WHERE a.i + {length} <= a.n AND {limit}"""


def _places(windows, names):
    """One row per window and place: inputs first, targets after."""
    run = F.concat("inputs", "targets")
    rows = windows.select("storm_id", "window_index", F.posexplode(run).alias("place", "_v"))
    values = [F.element_at("_v", i + 1).alias(n) for i, n in enumerate(names)]
    return rows.select("storm_id", "window_index", "place", *values)


@Q.add(
    "sliding_sequences",
    _windows_sql(6, "b.latitude, b.longitude, b.max_wind, " + r("b.min_pressure AS min_pressure")),
    {"placed": _NUMBERED + "tracks"},
)
def _(spark, sf):
    windows = ft.sliding_sequences(fx.tracks(spark, sf), 4, 2, ft.STATE_FEATURES)
    return _places(windows, ft.STATE_FEATURES)


@Q.add(
    "training_sequences",
    _windows_sql(6, r(*[f"b.{c} AS {c}" for c in ft.SEQUENCE_FEATURES])),
    {
        **_features_of("tracks_dirty"),
        "fitted": _fit_sql("made"),
        "scaled": f"SELECT t.* REPLACE ({', '.join(_Z)}) FROM made AS t, fitted",
        "placed": _NUMBERED + "scaled",
    },
)
def _(spark, sf):
    windows = tp.training_sequences(fx.tracks_dirty(spark, sf), 4, 2, numbered=ordered.POINT)
    return _places(windows, ft.SEQUENCE_FEATURES)


@Q.add(
    "common_window_count",
    "SELECT min(greatest(n - 12 + 1, 0)) AS n_windows FROM (SELECT count(*) AS n FROM tracks GROUP BY storm_id)",
)
def _(spark, sf):
    return ft.common_window_count(fx.tracks(spark, sf), 8, 4)


@Q.add(
    "aligned_windows",
    _windows_sql(
        12,
        "b.latitude, b.longitude, b.max_wind, " + r("b.min_pressure AS min_pressure"),
        "a.i < (SELECT min(greatest(n - 12 + 1, 0)) FROM placed)",
    ),
    {"placed": _NUMBERED + "tracks"},
)
def _(spark, sf):
    return _places(ft.aligned_windows(fx.tracks(spark, sf), 8, 4, numbered=ordered.POINT), ft.STATE_FEATURES)


# -- forecast tracks ---------------------------------------------------------------------------

_HOURS = "(epoch_us({b}) - epoch_us({a})) / 3.6e9"
_FORECAST = {
    "ranked": """
        SELECT *, row_number() OVER (PARTITION BY storm_id ORDER BY "timestamp" DESC) AS age,
          min("timestamp") OVER (PARTITION BY storm_id) AS first_time FROM tracks""",
    "past": f"""
        SELECT {TRACK}, CAST(floor({_HOURS.format(a="first_time", b='"timestamp"')}) AS BIGINT) AS lead_time FROM ranked""",
    "moving": """
        SELECT storm_id, (max(CASE WHEN age = 1 THEN latitude END) - arg_max(latitude, age)) / nullif(count(*) - 1, 0) AS dlat,
          (max(CASE WHEN age = 1 THEN longitude END) - arg_max(longitude, age)) / nullif(count(*) - 1, 0) AS dlon
        FROM ranked WHERE age <= 6 GROUP BY storm_id""",
    "future": f"""
        SELECT storm_id, name, "timestamp" + to_hours(CAST(6 * s AS INTEGER)) AS "timestamp", s AS step,
          latitude + coalesce(dlat, 0) * {{factor}} * s AS latitude, longitude + coalesce(dlon, 0) * {{factor}} * s AS longitude,
          max_wind, min_pressure,
          CAST(floor({_HOURS.format(a="first_time", b='"timestamp"')}) AS BIGINT) + 6 * s AS lead_time
        FROM ranked JOIN moving USING (storm_id), range(1, 21) AS steps(s) WHERE age = 1""",
}


def _forecast(factor):
    return {name: text.replace("{factor}", factor) for name, text in _FORECAST.items()}


@Q.add("lead_times", 'SELECT storm_id, "timestamp", lead_time FROM past', _forecast("0e0"))
def _(spark, sf):
    return fc.lead_times(fx.tracks(spark, sf)).select("storm_id", "timestamp", "lead_time")


@Q.add(
    "forecast_track",
    f"""SELECT storm_id, name, "timestamp", storm_type, latitude, longitude, max_wind, {r("min_pressure")},
          r34_ne, r34_se, r34_sw, r34_nw, lead_time, FALSE AS is_forecast FROM past UNION ALL
        SELECT storm_id, name, "timestamp", NULL, latitude, longitude, max_wind, {r("min_pressure")},
          NULL, NULL, NULL, NULL, lead_time, TRUE FROM future""",
    _forecast("0e0"),
)
def _(spark, sf):
    return fc.forecast_track(fx.tracks(spark, sf))


_TRAIL = "OVER (PARTITION BY storm_id ORDER BY step ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)"


@Q.add(
    "smooth_forecast",
    f"""SELECT storm_id, "timestamp", lead_time,
        {r(f"avg(latitude) {_TRAIL} AS latitude", f"avg(longitude) {_TRAIL} AS longitude")} FROM future""",
    _forecast("1e0"),
)
def _(spark, sf):
    made = fc.forecast_rows(fx.tracks(spark, sf), method="cliper5")
    return made.select("storm_id", "timestamp", "lead_time", "latitude", "longitude")


@Q.add(
    "position_at_lead",
    f"""SELECT storm_id, {r("latitude", "longitude")} FROM (
          SELECT *, row_number() OVER (PARTITION BY storm_id ORDER BY is_forecast, "timestamp") AS first_row FROM (
            SELECT storm_id, "timestamp", latitude, longitude, lead_time, FALSE AS is_forecast FROM past UNION ALL
            SELECT storm_id, "timestamp", latitude, longitude, lead_time, TRUE FROM future) WHERE lead_time = 700)
        WHERE first_row = 1""",
    _forecast("0e0"),
)
def _(spark, sf):
    return fc.position_at_lead(fc.forecast_track(fx.tracks(spark, sf)), 700)


@Q.add(
    "track_cone",
    """SELECT storm_id, latitude, longitude FROM past UNION ALL SELECT storm_id, latitude, longitude FROM future""",
    _forecast("0e0"),
)
def _(spark, sf):
    return fc.track_cone(fc.forecast_track(fx.tracks(spark, sf)))


# -- quality -----------------------------------------------------------------------------------

_CHECKED = {
    "stepped": f"""
        SELECT *, {_HOURS.format(a=f'lag("timestamp") {OVER}', b='"timestamp"')} AS hours,
          sqrt(pow(latitude - lag(latitude) {OVER}, 2) + pow(longitude - lag(longitude) {OVER}, 2)) * 60e0 AS moved,
          max_wind - lag(max_wind) {OVER} AS gain FROM tracks_dirty""",
    "counted": """
        SELECT storm_id,
          count(*) FILTER (abs(latitude) > 60) AS latitude_bounds, count(*) FILTER (abs(longitude) > 180) AS longitude_bounds,
          count(*) FILTER (max_wind > 200) AS wind_high, count(*) FILTER (max_wind < 0) AS wind_negative,
          count(*) FILTER (min_pressure < 850) AS pressure_low, count(*) FILTER (min_pressure > 1050) AS pressure_high,
          count(*) FILTER (latitude IS NULL OR longitude IS NULL) AS missing_coordinates,
          CASE WHEN count(*) < 4 THEN 1 ELSE 0 END AS short_track,
          count(*) FILTER (hours > 12) AS time_gap,
          count(*) FILTER (CASE WHEN hours = 0 THEN moved > 0 ELSE moved / hours > 70 END) AS motion_speed,
          count(*) FILTER (moved > 500) AS position_jump,
          count(*) FILTER (abs(min_pressure - (1013e0 - (max_wind / 14e0) * (max_wind / 14e0))) > 50) AS wind_pressure,
          count(*) FILTER (CASE WHEN hours = 0 THEN gain > 0 ELSE gain / hours > 2 * 50e0 / 24e0 END) AS intensification_rate
        FROM stepped GROUP BY storm_id""",
}


def _report(rules, ignored=()):
    return "\nUNION ALL ".join(
        f"SELECT storm_id, '{rule}' AS rule, CAST({rule} AS BIGINT) AS n_violations,"
        f" {'TRUE' if rule in ignored else f'{rule} = 0'} AS is_valid FROM counted"
        for rule in rules
    )


@Q.add("dq_bounds", _report(dq.BOUNDS_RULES), _CHECKED)
def _(spark, sf):
    return dq.dq_bounds(fx.tracks_dirty(spark, sf))


@Q.add("dq_track", _report(dq.TRACK_RULES, ["time_gap"]), _CHECKED)
def _(spark, sf):
    return dq.dq_track(fx.tracks_dirty(spark, sf))


@Q.add("dq_wind_pressure", _report(["wind_pressure"]), _CHECKED)
def _(spark, sf):
    return dq.dq_wind_pressure(fx.tracks_dirty(spark, sf))


@Q.add("dq_intensification", _report(["intensification_rate"]), _CHECKED)
def _(spark, sf):
    return dq.dq_intensification(fx.tracks_dirty(spark, sf))


@Q.add("dq_continuity", _report(dq.CONTINUITY_RULES), _CHECKED)
def _(spark, sf):
    return dq.dq_continuity(fx.tracks_dirty(spark, sf))


def _sum(rules):
    return "(" + " + ".join(rules) + " = 0)"


_HARD = dq.BOUNDS_RULES + dq.TRACK_RULES
_SOFT = [rule for rule in _HARD if rule != "time_gap"]
_GRID_OK = "(SELECT count(*) - count(sst) <= 0.1e0 * count(*) FROM grid_gap)"


@Q.add(
    "dq_verdict",
    f"""SELECT storm_id, {_sum(_SOFT)} AS track_valid, {_sum(dq.PHYSICS_RULES)} AS physics_valid,
          {_GRID_OK} AS grid_valid, {_sum(_SOFT)} AND {_GRID_OK} AS is_valid FROM counted""",
    _CHECKED,
)
def _(spark, sf):
    return dq.dq_verdict(fx.tracks_dirty(spark, sf), fx.grid_gap(spark, sf), numbered=ordered.POINT)


@Q.add(
    "dq_verdict_strict",
    f"""SELECT storm_id, {_sum(_HARD)} AS track_valid, {_sum(dq.PHYSICS_RULES)} AS physics_valid, TRUE AS grid_valid,
          {_sum(_HARD)} AND {_sum(dq.PHYSICS_RULES)} AS is_valid FROM counted""",
    _CHECKED,
)
def _(spark, sf):
    return dq.dq_verdict(fx.tracks_dirty(spark, sf), fx.grid(spark, sf), strict=True)


_REVALIDATED = {
    **_forecast("1e0"),
    "forecasted": """
        SELECT storm_id, "timestamp", latitude, longitude, max_wind, min_pressure FROM past UNION ALL
        SELECT storm_id, "timestamp", latitude, longitude, max_wind, min_pressure FROM future""",
    **{name: text.replace("FROM tracks_dirty", "FROM forecasted") for name, text in _CHECKED.items()},
}


@Q.add(
    "forecast_revalidation",
    f"""SELECT storm_id, {_sum(_SOFT)} AS track_valid, {_sum(dq.PHYSICS_RULES)} AS physics_valid, TRUE AS grid_valid,
          {_sum(_SOFT)} AS is_valid FROM counted""",
    _REVALIDATED,
)
def _(spark, sf):
    track, verdict = fc.checked_forecast(fx.tracks(spark, sf), method="cliper5", smooth=False)
    return verdict


@Q.add(
    "storm_from_archive",
    f"""SELECT storm_id, name, "timestamp", latitude, longitude, max_wind, {r("min_pressure")}
        FROM base_tracks WHERE event_id % 29 <> 0 AND event_id % 31 <> 0 AND storm_id = 'EV000003'""",
)
def _(spark, sf):
    return arrays.storm_from_arrays(fx.storm_arrays(spark, sf), "EV000003")


@Q.add(
    "hemisphere_signs",
    f"""SELECT storm_id, name, date_trunc('minute', "timestamp") AS "timestamp", {r(
        "CASE WHEN event_id % 2 = 0 THEN -1 ELSE 1 END * (event_id % 800 / 10e0) AS latitude",
        "CASE WHEN event_id % 3 = 0 THEN -1 ELSE 1 END * (event_id % 1790 / 10e0) AS longitude")} FROM base_tracks""",
)
def _(spark, sf):
    event = F.col("event_id")

    def degrees(steps, other, usual, opposite):
        side = F.when(event % other == 0, F.lit(opposite)).otherwise(F.lit(usual))
        return F.concat(F.format_string("%.1f", event % steps / 10.0), side)

    fix = F.concat_ws(
        ", ", F.date_format("timestamp", "yyyyMMdd"), F.date_format("timestamp", "HHmm"), F.lit(" "), F.lit("TS"),
        degrees(800, 2, "N", "S"), degrees(1790, 3, "E", "W"), F.lit("50"), F.lit("-999"),
    )
    header = F.concat(F.col("storm_id"), F.lit(", "), F.col("name"), F.lit(", 1,"))
    lines = fx.numbered_tracks(spark, sf).select(header.alias("_storm"), fix.alias("value"))
    return best_track.decode_fixes(lines).select("storm_id", "name", "timestamp", "latitude", "longitude")
