"""SQL twins of the derived tables, and the composer of oracle statements."""

import re

from workload.fixtures import FIELDS, GRID_STEP_HOURS, VARIABLE_LISTS

OVER = 'OVER (PARTITION BY storm_id ORDER BY "timestamp")'


def r(*columns, digits=6):
    """Rounded select items; adding zero turns -0.0 into 0.0."""
    items = []
    for c in columns:
        expression, _, alias = c.rpartition(" AS ")
        expression = expression or c
        items.append(f"round({expression}, {digits}) + 0e0 AS {alias}")
    return ", ".join(items)


def _list(names):
    return "[" + ", ".join(f"'{n}'" for n in names) + "]"


TRACK = 'storm_id, name, "timestamp", storm_type, latitude, longitude, max_wind, min_pressure, r34_ne, r34_se, r34_sw, r34_nw'

_fields = ", ".join(
    f"max(CASE WHEN v = {i} THEN {base!r}e0 + {scale!r}e0 * x END) AS {name}"
    for i, (name, base, scale) in enumerate(FIELDS)
)

TABLES = {
    "numbered": """
        SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events""",
    "winds": """
        SELECT *, CAST(20 + floor(least(value, 400e0) / 4) AS DOUBLE) AS max_wind FROM numbered""",
    "base_tracks": """
        SELECT user_id, event_id, k,
          'EV' || lpad(CAST(user_id AS VARCHAR), CAST(greatest(6, length(CAST(user_id AS VARCHAR))) AS INTEGER), '0') AS storm_id,
          'STORM' || CAST(user_id % 50 AS VARCHAR) AS name,
          ts AS "timestamp", event_type AS storm_type,
          (8 + (user_id * 7) % 20) + k * 0.25e0 + (event_id % 5 - 2) * 0.125e0 AS latitude,
          (-20 - (user_id * 11) % 40) - k * 0.5e0 + (event_id % 7 - 3) * 0.125e0 AS longitude,
          max_wind,
          1013e0 - (max_wind / 14e0) * (max_wind / 14e0) + (event_id % 131 - 65) AS min_pressure,
          CASE WHEN event_id % 3 <> 0 THEN CAST(event_id % 60 AS DOUBLE) END AS r34_ne,
          CASE WHEN event_id % 3 <> 0 THEN CAST(event_id % 55 AS DOUBLE) END AS r34_se,
          CASE WHEN event_id % 3 <> 0 THEN CAST(event_id % 45 AS DOUBLE) END AS r34_sw,
          CASE WHEN event_id % 3 <> 0 THEN CAST(event_id % 40 AS DOUBLE) END AS r34_nw
        FROM winds""",
    "tracks": f"SELECT {TRACK} FROM base_tracks",
    "tracks_dirty": """
        SELECT storm_id, name, "timestamp", storm_type,
          CASE WHEN event_id % 211 = 0 THEN latitude + 30 ELSE latitude END AS latitude, longitude,
          CASE WHEN event_id % 97 = 0 THEN -99e0 ELSE max_wind END AS max_wind,
          CASE WHEN event_id % 41 <> 0 THEN min_pressure END AS min_pressure,
          r34_ne, r34_se, r34_sw, r34_nw
        FROM base_tracks""",
    "tracks_nan": """
        SELECT storm_id, name, "timestamp", storm_type, CASE WHEN event_id % 173 <> 0 THEN latitude END AS latitude, longitude,
          CASE WHEN event_id % 59 <> 0 THEN max_wind END AS max_wind, min_pressure, r34_ne, r34_se, r34_sw, r34_nw
        FROM base_tracks""",
    "tracks_dateline": """
        SELECT storm_id, name, "timestamp", storm_type, latitude,
          CASE WHEN user_id % 10 <> 0 THEN longitude
               WHEN longitude - 110 < -180 THEN longitude - 110 + 360 ELSE longitude - 110 END AS longitude,
          max_wind, min_pressure, r34_ne, r34_se, r34_sw, r34_nw
        FROM base_tracks""",
    "base_tracks_years": """
        SELECT * REPLACE ("timestamp" + to_hours(CAST((user_id % 3 - 1) * 360 AS INTEGER)) AS "timestamp")
        FROM base_tracks""",
    "tracks_years": f"SELECT {TRACK} FROM base_tracks_years",
    "cells": """
        SELECT vec_id // 10 AS tix, vec_id % 10 AS v,
          unnest(range(0, CAST(len(embedding) AS BIGINT))) AS pos, CAST(unnest(embedding) AS DOUBLE) AS x
        FROM embeddings""",
    "grid": f"""
        SELECT TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST({GRID_STEP_HOURS} * tix AS INTEGER)) AS "time",
          45e0 - 5e0 * (pos // 8) AS latitude, -95e0 + 10e0 * (pos % 8) AS longitude, {_fields}
        FROM cells GROUP BY 1, 2, 3""",
    "grid_irregular": f"""
        SELECT * REPLACE ("time" + to_hours(CAST(i * 7 % 5 AS INTEGER)) + to_minutes(CAST(i * 13 % 47 AS INTEGER)) AS "time")
        FROM (SELECT *, CAST(date_diff('hour', TIMESTAMP '2024-01-01 00:00:00', "time") AS BIGINT) // {GRID_STEP_HOURS} AS i FROM grid)
        WHERE i % 4 <> 1""",
    "grid_dateline": """
        SELECT * FROM grid UNION ALL
        SELECT * REPLACE (CASE WHEN longitude - 110 < -180 THEN longitude - 110 + 360 ELSE longitude - 110 END AS longitude)
        FROM grid""",
    "grid_gap": "SELECT * REPLACE (CASE WHEN longitude >= -75 THEN sst END AS sst) FROM grid",
    "levels": """
        SELECT "time", latitude, longitude, 200 AS pressure_level, u200 AS u, v200 AS v FROM grid UNION ALL
        SELECT "time", latitude, longitude, 850, u850, v850 FROM grid""",
    "ensemble": """
        SELECT l_orderkey AS case_id, ln(l_extendedprice) AS member, ln(o_totalprice) AS observed
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "event_probabilities": """
        SELECT l_orderkey AS case_id, avg(CASE WHEN l_returnflag = 'R' THEN 1e0 ELSE 0e0 END) AS probability,
          any_value(o_orderstatus) = 'F' AS event
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_orderkey""",
    "requests": f"""
        SELECT storm_id, user_id, min("timestamp") AS start_time, max("timestamp") AS end_time,
          max(latitude) + 12.5e0 AS north, min(longitude) - 12.5e0 AS west,
          min(latitude) - 12.5e0 AS south, max(longitude) + 12.5e0 AS east,
          CASE user_id % 3 WHEN 0 THEN {_list(VARIABLE_LISTS[0])} WHEN 1 THEN {_list(VARIABLE_LISTS[1])}
            ELSE {_list(VARIABLE_LISTS[2])} END AS variables
        FROM base_tracks_years GROUP BY storm_id, user_id""",
}


def compose(body: str, extra: dict[str, str] | None = None) -> str:
    """Put the common table expressions a statement needs in front of it."""
    known = {**TABLES, **(extra or {})}
    ordered: list[str] = []

    def need(text, own=None):
        for name in known:
            if name != own and name not in ordered and re.search(rf"\b{name}\b", text):
                need(known[name], name)
                if name not in ordered:
                    ordered.append(name)

    need(body)
    if not ordered:
        return body
    return "WITH " + ",\n".join(f"{n} AS ({known[n]})" for n in ordered) + "\n" + body
