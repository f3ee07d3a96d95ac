"""Queries of search grids, candidates and gates, nearest joins and lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyfix.operators import asof, search
from skyfix.plans.fixtures import ctes, view
from skyfix.plans.geometry import lat_of, lon_of, merc_x, merc_y
from skyfix.plans.registry import query
from skyfix.plans.scoring import rounded
from skyfix.sources import benchmark, tables

PRIORS = "SELECT event_id, lat AS prior_lat, lon AS prior_lon, cast((event_id % 5) * 60 AS double) AS radius, cast(30 + (event_id % 3) * 30 AS double) AS step FROM {points}"
GRID = f""", p AS ({PRIORS.replace('{points}', 'points')}), q AS (SELECT *, CASE WHEN radius <= 0 OR step <= 0 OR step >= 2 * radius THEN 0 ELSE cast(floor((radius + 1e-9) / step) AS bigint) END AS n FROM p),
c AS (SELECT q.*, iy.i AS dy, ix.i AS dx FROM q JOIN (SELECT unnest(range(-8, 9)) AS i) iy ON abs(iy.i) <= q.n JOIN (SELECT unnest(range(-8, 9)) AS i) ix ON abs(ix.i) <= q.n)"""
POINT = f"round(CASE WHEN dx = 0 AND dy = 0 THEN prior_lat ELSE {lat_of(merc_y('prior_lat') + ' + dy * step')} END, 9) AS lat, round(CASE WHEN dx = 0 AND dy = 0 THEN prior_lon ELSE {lon_of(merc_x('prior_lon') + ' + dx * step')} END, 9) AS lon"


def _grid(spark, sf_dir):
    priors = spark.sql(PRIORS, points=view(spark, sf_dir, "points"))
    return search.grid_centres(priors, F.col("radius"), F.col("step"))


@query("grid_centers", ctes("points") + GRID + f" SELECT event_id, (dy + n) * (2 * n + 1) + dx + n AS centre_idx, {POINT} FROM c")
def grid_centers(spark, sf_dir):
    return rounded(_grid(spark, sf_dir).select("event_id", "centre_idx", "lat", "lon"), {"lat": 9, "lon": 9})


@query("candidate_grid", ctes("points") + GRID + """, s AS (SELECT * FROM (VALUES (0, 50e0), (1, 80e0), (2, 110e0), (3, 140e0)) v(scale_idx, span_m)), m AS (SELECT * FROM (VALUES (0, 'pnoa'), (1, 'esri')) v(provider_ord, provider))
SELECT event_id, provider, count(*) AS n_cells, max(((dy + n) * (2 * n + 1) + dx + n) * 4 + scale_idx) AS last_scan, round(sum(span_m), 3) AS span_sum FROM c, s, m GROUP BY event_id, provider""")
def candidate_grid(spark, sf_dir):
    return candidate_grid_all(spark, sf_dir)


@query("candidate_grid_all")
def candidate_grid_all(spark, sf_dir):
    """Every prior's cells."""
    providers = spark.createDataFrame([(0, "pnoa"), (1, "esri")], "provider_ord int, provider string")
    cells = search.candidates(_grid(spark, sf_dir), [50, 80, 110, 140]).join(F.broadcast(providers))
    return cells.groupBy("event_id", "provider").agg(F.count(F.lit(1)).alias("n_cells"), F.max("scan_idx").alias("last_scan"), F.round(F.sum("span_m"), 3).alias("span_sum"))


BEST = ", best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY n_inliers DESC, scan_idx) AS k FROM candidates WHERE has_pose) x WHERE k = 1)"
RIVAL = BEST + """, rival AS (SELECT * FROM (SELECT c.frame, c.scan_idx AS rival_idx, c.n_inliers AS rival_inliers, row_number() OVER (PARTITION BY c.frame ORDER BY c.n_inliers DESC, c.scan_idx) AS k FROM candidates c JOIN best b USING (frame)
  WHERE c.has_pose AND c.scan_idx <> b.scan_idx AND sqrt(pow(c.x_m - b.x_m, 2) + pow(c.y_m - b.y_m, 2)) >= 90e0) x WHERE k = 1)"""


@query("best_candidate", ctes("candidates") + BEST + " SELECT frame, scan_idx, n_inliers, span_m, x_m, y_m FROM best")
def best_candidate(spark, sf_dir):
    return search.best_candidate(view(spark, sf_dir, "candidates"), "frame").select("frame", F.col("scan_idx").cast("long").alias("scan_idx"), "n_inliers", "span_m", "x_m", "y_m")


@query("runner_up", ctes("candidates") + RIVAL + " SELECT frame, rival_idx, rival_inliers FROM rival")
def runner_up(spark, sf_dir):
    cands = view(spark, sf_dir, "candidates")
    return search.runner_up(cands, search.best_candidate(cands, "frame"), F.lit(90.0), "frame").select("frame", F.col("rival_idx").cast("long").alias("rival_idx"), "rival_inliers")


GATED = RIVAL + """, gated AS (SELECT f.frame, b.scan_idx, b.n_inliers, r.rival_inliers, b.n_inliers * 1e0 / nullif(r.rival_inliers, 0) AS margin_ratio,
  coalesce(b.n_inliers >= 20, false) AND NOT coalesce(b.n_inliers < 1.3e0 * r.rival_inliers, false) AS locked FROM (SELECT DISTINCT frame FROM candidates) f LEFT JOIN best b USING (frame) LEFT JOIN rival r USING (frame))"""


@query("lock_gate", ctes("candidates") + GATED + " SELECT frame, scan_idx, n_inliers, rival_inliers, round(margin_ratio, 9) AS margin_ratio, locked FROM gated")
def lock_gate(spark, sf_dir):
    out = search.lock_gate(view(spark, sf_dir, "candidates"), F.lit(90.0), 20, 1.3, "frame")
    return out.select("frame", F.col("scan_idx").cast("long").alias("scan_idx"), "n_inliers", "rival_inliers", F.round("margin_ratio", 9).alias("margin_ratio"), "locked")


FINE = "SELECT frame, scan_idx + 100 AS scan_idx, x_m, y_m, span_m, n_inliers + (scan_idx % 3) * 2 - 2 AS n_inliers, scan_idx % 4 <> 1 AS has_pose FROM {candidates}"


@query("refine_pick", ctes("candidates") + GATED + f""", fine AS ({FINE.replace('{candidates}', 'candidates')}), fb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY n_inliers DESC, scan_idx) AS k FROM fine WHERE has_pose) x WHERE k = 1)
SELECT g.frame, g.locked AND coalesce(fb.n_inliers >= g.n_inliers, false) AS refined, CASE WHEN g.locked AND fb.n_inliers >= g.n_inliers THEN fb.n_inliers ELSE g.n_inliers END AS best_inliers,
  CASE WHEN g.locked AND fb.n_inliers >= g.n_inliers THEN fb.scan_idx ELSE g.scan_idx END AS best_idx FROM gated g LEFT JOIN fb USING (frame)""")
def refine_pick(spark, sf_dir):
    cands = view(spark, sf_dir, "candidates")
    coarse = search.lock_gate(cands, F.lit(90.0), 20, 1.3, "frame")
    out = search.refine_pick(coarse, spark.sql(FINE, candidates=cands), "frame")
    return out.select("frame", "refined", F.col("best_inliers").cast("long").alias("best_inliers"), F.col("best_idx").cast("long").alias("best_idx"))


@query("tile_dedupe", ctes("points") + " SELECT count(*) AS n_tiles FROM (SELECT DISTINCT round_even(lat * 1e0 - lat % 1e-2, 7) AS lat, round_even(lon, 7) AS lon, span_m FROM points) t")
def tile_dedupe(spark, sf_dir):
    cands = view(spark, sf_dir, "points").select((F.col("lat") - F.col("lat") % 1e-2).alias("lat"), "lon", "span_m", F.lit(640).alias("pixels"))
    return search.tile_keys(cands).agg(F.count(F.lit(1)).alias("n_tiles"))


@query("cost_plan", """WITH s AS (SELECT event_id, event_type, cast((event_id % 5) * 60 AS double) AS radius, cast(30 + (event_id % 3) * 30 AS double) AS step FROM events)
SELECT event_id, CASE WHEN radius <= 0 OR step >= 2 * radius THEN 1 ELSE cast(pow(2 * floor((radius + 1e-9) / step) + 1, 2) AS bigint) END * 4 AS n_candidates,
  round(12 * CASE WHEN radius <= 0 OR step >= 2 * radius THEN 1 ELSE pow(2 * floor((radius + 1e-9) / step) + 1, 2) END * 4 * CASE event_type WHEN 'click' THEN 0.15e0 WHEN 'view' THEN 3.2e0 WHEN 'error' THEN 6e0 ELSE 1e0 END, 6) AS eta_s FROM s""")
def cost_plan(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("event_id", "event_type", "cast((event_id % 5) * 60 as double) as radius", "cast(30 + (event_id % 3) * 30 as double) as step")
    n = search.cost(F.col("radius"), F.col("step"), 4)
    seconds = F.expr("case event_type when 'click' then 0.15e0 when 'view' then 3.2e0 when 'error' then 6e0 else 1e0 end")
    return rows.select("event_id", n.alias("n_candidates"), F.round(12 * n * seconds, 6).alias("eta_s"))


PROBES = "SELECT user_id AS track, event_id AS frame FROM {events} WHERE event_type = 'click'"
NEAR = f""", probes AS ({PROBES.replace('{events}', 'events')}), near AS (SELECT p.track, p.frame, g.frame AS fix_frame, g.lat, g.lon, row_number() OVER (PARTITION BY p.track, p.frame ORDER BY abs(g.frame - p.frame), g.frame) AS k FROM probes p JOIN gps_track g USING (track))"""


def _probes(spark, sf_dir):
    return spark.sql(PROBES, events=spark.read.parquet(f"{sf_dir}/events.parquet"))


@query("nearest_fix_join", ctes("gps_track") + NEAR + " SELECT track, frame, fix_frame, round(lat, 9) AS lat, round(lon, 9) AS lon FROM near WHERE k = 1")
def nearest_fix_join(spark, sf_dir):
    out = asof.nearest(_probes(spark, sf_dir), view(spark, sf_dir, "gps_track"), "track").where("fix is not null")
    return rounded(out.select("track", "frame", F.col("fix.frame").alias("fix_frame"), "fix.lat", "fix.lon"), {"lat": 9, "lon": 9})


@query("left_nearest_join", ctes("gps_track") + NEAR.replace("JOIN gps_track g USING (track)", "JOIN (SELECT * FROM gps_track WHERE track % 3 <> 0) g USING (track)") + """
SELECT p.track, p.frame, n.fix_frame, round(n.lat, 9) AS lat FROM probes p LEFT JOIN near n ON n.track = p.track AND n.frame = p.frame AND n.k = 1""")
def left_nearest_join(spark, sf_dir):
    out = asof.nearest(_probes(spark, sf_dir), view(spark, sf_dir, "gps_track").where("track % 3 <> 0"), "track")
    return rounded(out.select("track", "frame", F.col("fix.frame").alias("fix_frame"), "fix.lat"), {"lat": 9})


STEM = "lower(regexp_replace(regexp_replace({}, '^.*/', ''), '\\.[^.]*$', ''))"


@query("stem_left_join", f"""WITH i AS (SELECT 'r' || (p_partkey % 2) AS region, 'dir/IMG_' || (p_partkey % 700) || '_' || p_partkey || '.JPG' AS path, p_partkey % 9 <> 0 AS readable FROM part),
t AS (SELECT 'r' || (s_suppkey % 2) AS region, 'img_' || (s_suppkey % 700) || '_' || s_suppkey || '.png' AS filename, s_acctbal, s_suppkey FROM supplier WHERE s_suppkey % 7 <> 0 UNION ALL SELECT 'r' || ((s_suppkey + 1) % 2), 'IMG_' || (s_suppkey % 700) || '_' || s_suppkey || '.png', -1e0, s_suppkey + 1000000 FROM supplier),
u AS (SELECT region, {STEM.format('filename')} AS stem, arg_max(s_acctbal, s_suppkey) AS lat FROM t GROUP BY 1, 2),
n AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY path) - 1 AS frame FROM i)
SELECT n.region, n.path, n.frame, {STEM.format('n.path')} AS stem, round(cast(u.lat AS double), 6) AS gt_lat FROM n LEFT JOIN u ON u.region = n.region AND u.stem = {STEM.format('n.path')} WHERE n.readable""")
def stem_left_join(spark, sf_dir):
    """Two regions whose files share their stems."""
    images = spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr("'r' || (p_partkey % 2) as region", "'dir/IMG_' || (p_partkey % 700) || '_' || p_partkey || '.JPG' as path", "p_partkey % 9 <> 0 as readable")
    supplier = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    name = "(s_suppkey % 700) || '_' || s_suppkey || '.png' as `Image_Name`"
    truth = supplier.where("s_suppkey % 7 <> 0").selectExpr("'r' || (s_suppkey % 2) as region", f"'img_' || {name}", "cast(s_acctbal as string) as ` GPS-lat`", "'1' as long", "s_suppkey as _order")
    other = supplier.selectExpr("'r' || ((s_suppkey + 1) % 2) as region", f"'IMG_' || {name}", "'-1' as ` GPS-lat`", "'1' as long", "s_suppkey + 1000000 as _order")
    return benchmark.region_samples(images, truth.unionByName(other)).select("region", "path", "frame", "stem", F.round("gt_lat", 6).alias("gt_lat"))


RANGED = "SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'sat' || s_suppkey || '.tif' WHEN 1 THEN 'map' || s_suppkey || '.png' ELSE 'm-' || s_suppkey || '.tif' END AS name, CASE WHEN s_suppkey % 11 <> 0 THEN s_suppkey / 10e0 END AS top FROM {supplier}"


@query("cascading_range_lookup", f"""WITH q AS (SELECT o_orderkey, 'sat' || (o_orderkey % 300) AS k0, 'map' || (o_custkey % 300) AS k1, cast(o_orderkey % 300 AS varchar) AS k2, cast(o_custkey % 300 AS varchar) AS k3 FROM orders),
r AS (SELECT * FROM ({RANGED.replace('{supplier}', 'supplier')}) x WHERE top IS NOT NULL),
s AS (SELECT lower(regexp_replace(name, '\\.[^.]*$', '')) AS key, arg_max(top, s_suppkey) AS top FROM r GROUP BY 1),
l AS (SELECT * FROM s UNION ALL SELECT * FROM (SELECT regexp_replace(name, '[^0-9]', '', 'g') AS key, arg_min(top, s_suppkey) AS top FROM r GROUP BY 1) d WHERE key NOT IN (SELECT key FROM s))
SELECT o_orderkey, round(coalesce(a.top, b.top, c.top, d.top), 6) AS max_lat, CASE WHEN a.top IS NOT NULL THEN 0 WHEN b.top IS NOT NULL THEN 1 WHEN c.top IS NOT NULL THEN 2 WHEN d.top IS NOT NULL THEN 3 END AS level
FROM q LEFT JOIN l a ON a.key = k0 LEFT JOIN l b ON b.key = k1 LEFT JOIN l c ON c.key = k2 LEFT JOIN l d ON d.key = k3""")
def cascading_range_lookup(spark, sf_dir):
    """Extents under the map's stem, the region's name, or the digits of either; rows without a corner have none."""
    regions = spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("o_orderkey", "'d/sat' || (o_orderkey % 300) || '.tif' as map_path", "'Map' || (o_custkey % 300) as region")
    rows = spark.sql(RANGED, supplier=spark.read.parquet(f"{sf_dir}/supplier.parquet"))
    ranges = rows.select(F.col("name").alias("Map Name"), F.col("top").alias("LT_lat_map"), F.lit(1.0).alias("west"), (F.col("top") - 1).alias("rb_lat"), F.lit(2.0).alias("east"), F.col("s_suppkey").alias("_order"))
    ranges = tables.aliased(ranges, tables.RANGE_ALIASES, ("_order",))
    return benchmark.region_maps(regions, ranges, "_order").select("o_orderkey", F.round("box.max_lat", 6).alias("max_lat"), F.col("level").cast("long").alias("level"))


@query("fine_cells", ctes("candidates") + GATED + """, f AS (SELECT g.frame, b.span_m AS span, 43.521955e0 + b.x_m * 1e-5 AS lat FROM gated g JOIN best b USING (frame) WHERE locked),
s AS (SELECT frame, span, unnest(list_sort(list_distinct([round_even(span * 0.85e0, 3), round_even(span * 0.925e0, 3), round_even(span, 3), round_even(span * 1.075e0, 3), round_even(span * 1.15e0, 3)]))) AS span_m FROM f)
SELECT frame, 25 * count(*) AS n_cells, 25 * count(*) - 1 AS last_scan, round(25 * sum(span_m), 3) AS span_sum FROM s GROUP BY frame""")
def fine_cells(spark, sf_dir):
    """Size of the fine pass of every locked frame."""
    cands = view(spark, sf_dir, "candidates").withColumns({"lat": F.lit(43.521955) + F.col("x_m") * 1e-5, "lon": F.lit(-5.62429) + F.col("y_m") * 1e-5})
    cells = search.fine_cells(search.lock_gate(cands, F.lit(90.0), 20, 1.3, "frame"), "frame")
    return cells.groupBy("frame").agg(F.count(F.lit(1)).alias("n_cells"), F.max("scan_idx").cast("long").alias("last_scan"), F.round(F.sum("span_m"), 3).alias("span_sum"))


SPANS = """, spans AS (SELECT g.frame, b.span_m AS span FROM gated g JOIN best b USING (frame) WHERE locked),
cells AS (SELECT frame, 25 * len(list_distinct([round_even(span * 0.85e0, 3), round_even(span * 0.925e0, 3), round_even(span, 3), round_even(span * 1.075e0, 3), round_even(span * 1.15e0, 3)])) AS n FROM spans),
fine AS (SELECT frame, scan_idx, (scan_idx * 37 + frame) % 60 AS n_inliers FROM (SELECT frame, unnest(range(0, n)) AS scan_idx FROM cells) c WHERE scan_idx % 4 <> 1),
fb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY n_inliers DESC, scan_idx) AS k FROM fine) x WHERE k = 1)"""


@query("two_pass_search", ctes("candidates") + GATED + SPANS + """ SELECT g.frame, g.locked AND coalesce(fb.n_inliers >= g.n_inliers, false) AS refined, CASE WHEN g.locked AND fb.n_inliers >= g.n_inliers THEN fb.n_inliers ELSE g.n_inliers END AS best_inliers,
  CASE WHEN g.locked AND fb.n_inliers >= g.n_inliers THEN fb.scan_idx ELSE g.scan_idx END AS best_idx FROM gated g LEFT JOIN fb USING (frame)""")
def two_pass_search(spark, sf_dir):
    """The cells of the fine pass about every lock, matched by rule, feed the pick."""
    cands = view(spark, sf_dir, "candidates").withColumns({"lat": F.lit(43.521955) + F.col("x_m") * 1e-5, "lon": F.lit(-5.62429) + F.col("y_m") * 1e-5})
    coarse = search.lock_gate(cands, F.lit(90.0), 20, 1.3, "frame")
    fine = search.fine_cells(coarse, "frame").withColumns({"n_inliers": (F.col("scan_idx") * 37 + F.col("frame")) % 60, "has_pose": F.col("scan_idx") % 4 != 1})
    out = search.refine_pick(coarse, fine, "frame")
    return out.select("frame", "refined", F.col("best_inliers").cast("long").alias("best_inliers"), F.col("best_idx").cast("long").alias("best_idx"))


ALONE = "SELECT frame, scan_idx, x_m, y_m, span_m, CASE WHEN scan_idx = 0 OR frame % 3 = 0 THEN n_inliers ELSE 0 END AS n_inliers, has_pose FROM {candidates}"


@query("lock_gate_alone", ctes("candidates").replace("candidates AS", "every AS") + f", candidates AS ({ALONE.replace('{candidates}', 'every')})" + GATED + " SELECT frame, scan_idx, n_inliers, rival_inliers, coalesce(rival_inliers = 0, false) AS unrivalled, locked FROM gated")
def lock_gate_alone(spark, sf_dir):
    """Best cells whose rivals have no inliers at all: their ratio is infinite, and they pass the gate."""
    out = search.lock_gate(spark.sql(ALONE, candidates=view(spark, sf_dir, "candidates")), F.lit(90.0), 20, 1.3, "frame")
    return out.select("frame", F.col("scan_idx").cast("long").alias("scan_idx"), "n_inliers", "rival_inliers", F.coalesce(F.col("margin_ratio") == float("inf"), F.lit(False)).alias("unrivalled"), "locked")


@query("missing_frames", "SELECT DISTINCT o_custkey AS frame FROM orders WHERE o_custkey NOT IN (SELECT user_id * 3 FROM events)")
def missing_frames(spark, sf_dir):
    wanted = spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("o_custkey as frame")
    return asof.missing(wanted, spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("user_id * 3 as frame"), "frame")
