"""Views over the driver's tables that stand in for the engine's inputs. Each is one SQL text with the same meaning in Spark and DuckDB;
{name} stands for a table."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TILE = {"lat": "43.521955e0", "lon": "-5.62429e0", "width": 3072, "span": "600e0"}
_X0 = f"(radians({TILE['lon']}) * 6378137e0)"
_Y0 = f"(6378137e0 * ln(tan({3.141592653589793 / 4!r}e0 + radians({TILE['lat']}) / 2e0)))"

VIEWS: dict[str, str] = {}
VIEWS["points"] = """
SELECT event_id, 43.521955e0 + ((event_id % 1009) - 500) * 1e-3 AS lat, -5.62429e0 + ((event_id % 997) - 500) * 1e-3 AS lon,
  50e0 + (event_id % 7) * 30e0 AS span_m, value FROM {events}"""
VIEWS["tile_row"] = f"""
SELECT 3072 AS width, 3072 AS height, {_X0} - 300e0 AS minx, {_Y0} - 300e0 AS miny, {_X0} + 300e0 AS maxx, {_Y0} + 300e0 AS maxy"""
VIEWS["frame_scores"] = """
SELECT scenario, model, frame, t_s, gt_lat, gt_lon, est_lat, est_lon, n_inliers, n_inliers >= 20 AS locked, runtime_s,
  2e0 * 6378137e0 * asin(sqrt(pow(sin(radians(est_lat - gt_lat) / 2e0), 2e0) + cos(radians(gt_lat)) * cos(radians(est_lat)) * pow(sin(radians(est_lon - gt_lon) / 2e0), 2e0))) AS err_m
FROM (SELECT scenario, model, frame, t_s, gt_lat, gt_lon, runtime_s,
    CASE WHEN frame % 11 <> 0 THEN gt_lat + ((frame % 97) - 48) * value * 1e-8 END AS est_lat,
    CASE WHEN frame % 11 <> 0 THEN gt_lon + ((frame % 89) - 44) * value * 1e-8 END AS est_lon,
    CASE WHEN frame % 11 = 0 THEN 0 ELSE 5 + (frame * 7919) % 120 END AS n_inliers
  FROM (SELECT user_id % 10 AS scenario, event_type AS model, event_id AS frame, event_id / 29.97e0 AS t_s, value, value / 10e0 AS runtime_s,
      43.521955e0 + (event_id % 1009) * 1e-6 AS gt_lat, -5.62429e0 + (event_id % 997) * 1e-6 AS gt_lon FROM {events}) a) b"""
#: The same with several models for one frame.
VIEWS["contests"] = """
SELECT scenario, cast(floor(frame / 5e0) AS bigint) AS frame, model, max(est_lat) AS est_lat, max(est_lon) AS est_lon, max(gt_lat) AS gt_lat, max(gt_lon) AS gt_lon,
  max(n_inliers) AS n_inliers, max(n_inliers) >= 60 AS locked, max(err_m) AS err_m
FROM {frame_scores} GROUP BY scenario, cast(floor(frame / 5e0) AS bigint), model"""
VIEWS["candidates"] = """
SELECT l_orderkey AS frame, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS scan_idx,
  ((l_partkey % 5) - 2) * 60e0 AS x_m, ((l_suppkey % 5) - 2) * 60e0 AS y_m, 50e0 + (l_partkey % 4) * 30e0 AS span_m, cast(l_quantity AS bigint) AS n_inliers, l_returnflag <> 'R' AS has_pose
FROM {lineitem}"""
VIEWS["vo_links"] = """
SELECT user_id AS track, rn - 1 AS idx_from, rn AS idx_to, ((event_id % 13) - 6) / 100e0 AS theta, value / 10e0 AS tx, ((event_id % 7) - 3) * 1e0 AS ty,
  event_id % 23 = 0 AS is_break, event_id % 31 = 0 AS is_anchor, 12 + event_id % 90 AS n_inliers, event_id
FROM (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM {events}) a"""
VIEWS["gps_track"] = """
SELECT user_id AS track, event_id AS frame, 43.521955e0 + (event_id % 1009) * 1e-6 AS lat, -5.62429e0 + (event_id % 997) * 1e-6 AS lon FROM {events} WHERE event_type = 'view'"""
VIEWS["frames"] = """
SELECT user_id AS track, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS idx, event_id / 29.97e0 AS t_s, value AS blur_score FROM {events}"""
VIEWS["fusion_steps"] = """
SELECT user_id AS track, event_id AS frame, (event_id - min(event_id) OVER (PARTITION BY user_id)) / 10e0 AS t_s,
  CASE WHEN event_id % 3 <> 0 THEN value END AS pos_e, CASE WHEN event_id % 3 <> 0 THEN value / 2e0 END AS pos_n FROM {events}"""
VIEWS["homographies"] = """
SELECT event_id AS frame, 1e0 + ((event_id % 7) - 3) / 100e0 AS a, ((event_id % 11) - 5) / 100e0 AS b, 1000e0 + value AS tx, 1200e0 + value / 2e0 AS ty, (event_id % 5) * 1e-6 AS g FROM {events}"""


def _needs(sql: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", sql)))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = VIEWS[name]
    tables = {n: view(spark, sf_dir, n) if n in VIEWS else spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in _needs(sql)}
    return spark.sql(sql, **tables)


def ctes(*names: str) -> str:
    """WITH clause of these views for DuckDB, in the order of what they need."""
    done: dict[str, str] = {}

    def add(n: str) -> None:
        for m in _needs(VIEWS[n]):
            if m in VIEWS:
                add(m)
        done.setdefault(n, re.sub(r"\{(\w+)\}", r"\1", VIEWS[n]).strip())

    for n in names:
        add(n)
    return "WITH " + ",\n".join(f"{n} AS ({sql})" for n, sql in done.items())
