"""Registered queries: targets, routing, stitching, instructions."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowfield.operators import routing as R
from rowfield.operators import spatial as X
from rowfield.operators import stitch as H
from rowfield.operators import targets as T
from rowfield.plans.common import scratch
from rowfield.sources import demo, driver


def derived_targets(spark, sf_dir):
    t = T.derived(driver.row_pieces(spark, sf_dir), driver.spots(spark, sf_dir).where("kind = 'waste'"))
    return t.select("id", "kind", F.round("x", 4).alias("x"), "y", "vineyard_id", "row_id")


def audit_sample(spark, sf_dir):
    rows = driver.row_pieces(spark, sf_dir).groupBy("vineyard_id", "row_id").agg((F.floor(F.round(F.avg("confidence"), 6) * 1000 + 0.5) / 1000).alias("confidence"))
    return T.audit_sample(rows)


def weakest_strips(spark, sf_dir):
    from rowfield.functions import scalars as S

    s = driver.interrows(spark, sf_dir).withColumn("confidence", F.round(S.interrow_confidence(F.col("veg_frac")), 6))
    return T.weakest(s)


def running_ids(spark, sf_dir):
    p = driver.row_pieces(spark, sf_dir)
    scope = p.where("tile_row < 9").select("tile").distinct()
    return T.running_ids(p.where("row_structure = 'disrupted'"), p.where("piece % 11 = 0"), scope).select("id", "piece")


def sequence_ids(spark, sf_dir):
    return T.sequence_ids(driver.spots(spark, sf_dir).where("kind = 'inspection'"), "I", scratch(spark, "sequence")).select("id", "sequence_id")


def inspector_checklist(spark, sf_dir):
    s = driver.spots(spark, sf_dir).withColumn("gap_m", F.floor(F.col("gap_m") * 10) / 10)
    return T.checklist(s.select((F.col("id") % 50).alias("tour"), F.col("id").alias("order"), "id", "kind", "gap_m", "x", "y"))


def co_located_targets(spark, sf_dir):
    s = driver.spots(spark, sf_dir).where("kind = 'waste'")
    return T.co_located(s.select(F.floor(F.col("x") / 25).cast("long").alias("block"), F.col("id").alias("ord"), "id", "x", "y"))


def walk_cells(spark, sf_dir):
    """Walkable cells: strips and a path, without forbidden ground and canopies."""
    strips = driver.interrows(spark, sf_dir).select(F.col("block").alias("scope"), *[(F.col(c) / 100.0).alias(c) for c in ("x0", "y0", "x1", "y1")])
    boxes = driver.canopies(spark, sf_dir).select(F.col("block").alias("scope"), *[(F.col(c) / 100.0).alias(c) for c in ("x0", "y0", "x1", "y1")])
    path = strips.select("scope").distinct().select("scope", F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.lit(2.0).alias("x1"), F.lit(100.0).alias("y1"))
    forbidden = strips.select("scope").distinct().select("scope", F.lit(20.0).alias("x0"), F.lit(10.0).alias("y0"), F.lit(30.0).alias("x1"), F.lit(20.0).alias("y1"))
    cells = lambda b: R.raster_boxes(b, 1.0)
    return R.walkable([cells(strips), cells(path)], [cells(boxes), cells(forbidden)])


def walk_edges(spark, sf_dir):
    e = R.edges(walk_cells(spark, sf_dir), 1.0)
    return e.groupBy("scope").agg(F.count(F.lit(1)).alias("edges"), F.round(F.sum("metres"), 4).alias("metres"), F.count_if((F.col("r") != F.col("r2")) & (F.col("c") != F.col("c2"))).alias("diagonals"))


def snapped_targets(spark, sf_dir):
    """Every inspection target on the site's cells; null cells where none is within 15 m."""
    s = driver.spots(spark, sf_dir).where("kind = 'inspection'").select((F.col("id") % 25).cast("int").alias("scope"), "id", "x", (F.col("y") / 4).alias("y"))
    return R.snap(s, walk_cells(spark, sf_dir), 1.0).select("id", "r", "c", "moved")


def _stops(spark, sf_dir):
    n = driver.blocks(spark, sf_dir).withColumn("k", F.substring("vineyard_id", 2, 2).cast("int"))
    return n.select((F.col("k") % 5).cast("string").alias("scope"), F.col("k").alias("ord"), F.col("vineyard_id").alias("id"), "x", "y")


def distance_matrix(spark, sf_dir):
    return R.distance_matrix(_stops(spark, sf_dir))


def exact_tours(spark, sf_dir):
    return R.tours(_stops(spark, sf_dir)).select("scope", F.array_join("stops", ",").alias("stops"), "length_m", "separate_m", "reduction_pct")


def site_tour(spark, sf_dir):
    """All blocks: nearest neighbour, 2-opt and Or-opt."""
    return R.tours(_stops(spark, sf_dir).withColumn("scope", F.lit("site"))).select("scope", F.size("stops").alias("stops"), "length_m", "separate_m")


def grid_routes(spark, sf_dir):
    """Closed walks over each block's cells through its six widest gaps that lie on them: a top-k a walk, by weight and id."""
    from pyspark.sql import Window

    cells = walk_cells(spark, sf_dir).select(F.col("scope").cast("string").alias("scope"), "r", "c")
    gaps = driver.spots(spark, sf_dir).where("kind = 'inspection'").select("id", (F.col("id") % 25).cast("string").alias("scope"), "gap_m")
    n = F.row_number().over(Window.partitionBy("scope").orderBy(F.desc("gap_m"), "id"))
    stops = snapped_targets(spark, sf_dir).where("r IS NOT NULL").join(gaps, "id").withColumn("ord", n).where("ord <= 6")
    return R.grid_routes(cells, stops.select("scope", "ord", "id", "r", "c"), 1.0).select("scope", F.size("stops").alias("stops"), "length_m", "unreachable")


def demo_tour(spark, sf_dir):
    return demo.tour(spark)


def demo_distances(spark, sf_dir):
    return demo.stop_distances(spark).withColumn("metres", F.round("metres", 6))


def walk_legs(spark, sf_dir):
    s = driver.spots(spark, sf_dir)
    return R.legs(s.select((F.col("id") % 50).alias("walk"), F.col("id").alias("ord"), "x", "y"))


def _steps(spark, sf_dir):
    s = driver.spots(spark, sf_dir)
    return s.select((F.col("id") % 50).alias("walk"), F.col("id").alias("ord"), (F.col("x") % 20 + 0.25).alias("metres"), ((F.col("id") * 7) % 360 + 0.5).alias("heading"))


def merged_steps(spark, sf_dir):
    return R.merged_steps(_steps(spark, sf_dir))


def instructions(spark, sf_dir):
    return R.instruction_text(R.merged_steps(_steps(spark, sf_dir)))


def lane_cover(spark, sf_dir):
    p = driver.interrows(spark, sf_dir).select("block", F.col("id").cast("string").alias("lane"), (F.col("id") * 7 % 60).alias("first"), (F.col("id") * 7 % 60 + F.col("x1") % 9).alias("last"))
    return R.lane_cover(p).select("block", F.size("lanes").alias("lanes"))


def serpentine(spark, sf_dir):
    s = driver.interrows(spark, sf_dir)
    return R.serpentine(s.select("block", F.col("y0").alias("offset"), F.col("id").alias("lane"), "x0", "x1"))


def sweep_costs(spark, sf_dir):
    """The cheapest of two variants at each stage of a walk."""
    b = driver.table(spark, sf_dir, "orders").select((F.col("o_custkey") % 40).alias("walk"), F.col("o_orderkey").alias("stage"), F.floor(F.col("o_totalprice")).cast("long").alias("p"))
    cost = lambda k: (F.col("p") % k).cast("double")
    return R.cheapest_variants(b.select("walk", "stage", F.array(F.array(cost(7), cost(11)), F.array(cost(13), cost(5))).alias("c")))


def path_sums(spark, sf_dir):
    t = driver.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), F.floor(F.col("p_partkey") / 2).cast("long").alias("parent"), F.col("p_size").cast("double").alias("w"))
    least = t.agg(F.min("node")).first()[0] or 0
    return R.path_sums(t.withColumn("parent", F.when(F.col("node") <= least, F.col("node")).otherwise(F.greatest("parent", F.lit(least)))), scratch(spark, "paths"))


def _block_pieces(spark, sf_dir):
    """A piece for each block and tile: a box that nearly fills the tile, and an axis by block that turns with the region,
    a few of them unknown. Neighbours of one block and region meet and lie alike; some of other blocks do, too."""
    p = driver.row_pieces(spark, sf_dir)
    g = p.groupBy("vineyard_id", "tile", "tile_row", "tile_col").agg(F.min("piece").alias("id"))
    k = F.substring("vineyard_id", 2, 9).cast("int")
    region = F.floor(F.col("tile_row") / 3) * 35 + F.floor(F.col("tile_col") / 4) * 55
    angle = ((k * 7 + region + F.col("id") % 3) % 180).cast("double")
    xmin, ymin = F.round(F.col("tile_col") * 51.2 + F.col("id") % 3, 4), F.round(F.col("tile_row") * 51.2 + F.col("id") % 2, 4)
    return g.select("id", "tile", "vineyard_id", xmin.alias("xmin"), ymin.alias("ymin"), F.round(xmin + 48, 4).alias("xmax"), F.round(ymin + 48, 4).alias("ymax"), F.when(F.col("id") % 211 != 0, angle).alias("angle"))


def stitch_edges(spark, sf_dir):
    return H.stitch_edges(_block_pieces(spark, sf_dir))


def stitched_blocks(spark, sf_dir):
    """Components of stitched pieces, numbered from north to south in bands."""
    pieces = _block_pieces(spark, sf_dir)
    roots = X.components(pieces.select(F.col("id").alias("node")), H.stitch_edges(pieces), scratch(spark, "stitch"))
    placed = pieces.join(roots, pieces["id"] == roots["node"]).groupBy("root").agg(F.round(F.avg("xmin"), 6).alias("x"), F.round(F.avg("ymin"), 6).alias("y"), F.count(F.lit(1)).alias("pieces"))
    return placed.select("root", "pieces")


def remaining_tiles(spark, sf_dir):
    p = driver.row_pieces(spark, sf_dir)
    return H.without_tiles(p, p.where("piece % 97 = 0").select("tile").distinct()).groupBy("tile").agg(F.count(F.lit(1)).alias("pieces"))


def global_ids(spark, sf_dir):
    p = driver.row_pieces(spark, sf_dir).select("piece", "tile", F.col("vineyard_id").alias("local_block"), F.col("row_id").alias("local_row"))
    vmap = p.where("piece % 2 = 0").select("tile", "local_block").distinct().withColumn("vineyard_id", F.concat(F.lit("S"), "local_block"))
    rmap = p.where("piece % 3 = 0").select("tile", "local_row").distinct().withColumn("row_id", F.concat(F.lit("S"), "local_row"))
    return H.global_ids(p, vmap, rmap).select("piece", "vineyard_id", "row_id")


_STOPS = "st AS (SELECT CAST(CAST(substr(vineyard_id, 2, 2) AS INTEGER) % 5 AS VARCHAR) AS scope, CAST(substr(vineyard_id, 2, 2) AS INTEGER) AS k, vineyard_id AS id, x, y FROM blocks)"
_PIECES = """bp AS (SELECT vineyard_id, tile, tile_row, tile_col, min(piece) AS id FROM row_pieces GROUP BY 1, 2, 3, 4),
bx AS (SELECT id, tile, vineyard_id, round(tile_col * 51.2e0 + id % 3, 4) AS xmin, round(tile_row * 51.2e0 + id % 2, 4) AS ymin, round(round(tile_col * 51.2e0 + id % 3, 4) + 48, 4) AS xmax, round(round(tile_row * 51.2e0 + id % 2, 4) + 48, 4) AS ymax,
 CASE WHEN id % 211 <> 0 THEN CAST((CAST(substr(vineyard_id, 2) AS BIGINT) * 7 + tile_row // 3 * 35 + tile_col // 4 * 55 + id % 3) % 180 AS DOUBLE) END AS angle FROM bp),
ed AS (SELECT l.id AS a, r.id AS b FROM bx l JOIN bx r ON l.id < r.id AND l.tile <> r.tile AND l.xmin - 3 <= r.xmax AND r.xmin <= l.xmax + 3 AND l.ymin - 3 <= r.ymax AND r.ymin <= l.ymax + 3
 AND (l.angle IS NULL OR r.angle IS NULL OR least(fmod(l.angle - r.angle + 180, 180), 180 - fmod(l.angle - r.angle + 180, 180)) <= 6))"""
_CELLS = """lay AS (SELECT 'g' AS k, block AS scope, x0 / 100e0 AS x0, y0 / 100e0 AS y0, x1 / 100e0 AS x1, y1 / 100e0 AS y1 FROM interrows
 UNION ALL SELECT DISTINCT 'g', block, 0e0, 0e0, 2e0, 100e0 FROM interrows UNION ALL SELECT DISTINCT 'b', block, 20e0, 10e0, 30e0, 20e0 FROM interrows
 UNION ALL SELECT DISTINCT 'b', block, x0 / 100e0, y0 / 100e0, x1 / 100e0, y1 / 100e0 FROM canopies),
cel AS (SELECT DISTINCT k, scope, r, c FROM (SELECT k, scope, r, unnest(range(CAST(ceil(x0 - 0.5e0) AS BIGINT), CAST(ceil(x1 - 0.5e0) AS BIGINT))) AS c FROM (SELECT *, unnest(range(CAST(ceil(y0 - 0.5e0) AS BIGINT), CAST(ceil(y1 - 0.5e0) AS BIGINT))) AS r FROM lay))),
wlk AS (SELECT scope, r, c FROM cel WHERE k = 'g' EXCEPT SELECT scope, r, c FROM cel WHERE k = 'b')"""
QUERIES = {
    "derived_targets": (derived_targets, "SELECT concat('gap-', row_id, '-', tile, '-', CAST(piece AS VARCHAR)) AS id, 'inspection' AS kind, round(x0 + length_m / 2, 4) AS x, y0 AS y, vineyard_id, row_id FROM row_pieces WHERE row_structure = 'disrupted' UNION ALL SELECT concat('waste-', CAST(id AS VARCHAR)), 'waste', round(x, 4), y, '', '' FROM spots WHERE kind = 'waste'"),
    "audit_sample": (audit_sample, """
WITH r AS (SELECT vineyard_id, row_id, floor(round(avg(confidence), 6) * 1000 + 0.5e0) / 1000 AS confidence FROM row_pieces GROUP BY 1, 2), m AS (SELECT *, row_number() OVER (PARTITION BY vineyard_id ORDER BY confidence, row_id) AS c, row_number() OVER (PARTITION BY vineyard_id ORDER BY row_id) AS i, count(*) OVER (PARTITION BY vineyard_id) AS n FROM r)
SELECT vineyard_id, row_id, CASE WHEN c <= 2 THEN 'low confidence' ELSE 'median sample' END AS reason, round(1 + 2 * (1 - confidence), 3) AS priority FROM m WHERE c <= 2 OR (n > 2 AND i = n // 2 + 1)"""),
    "weakest_strips": (weakest_strips, "SELECT vineyard_id, (min({'c': confidence, 'id': id})).id AS id, min(confidence) AS confidence FROM (SELECT *, round(least(1e0, 0.55e0 + 2 * least(abs(veg_frac - 0.25e0), abs(veg_frac - 0.75e0))), 6) AS confidence FROM interrows) GROUP BY 1"),
    "running_ids": (running_ids, """
WITH sc AS (SELECT DISTINCT tile FROM row_pieces WHERE tile_row < 9), w AS (SELECT tile, piece, row_number() OVER (PARTITION BY tile ORDER BY piece) AS j FROM row_pieces WHERE piece % 11 = 0)
SELECT concat('gap-', row_id, '-', CAST(row_number() OVER (PARTITION BY row_id ORDER BY tile, piece) AS VARCHAR)) AS id, piece FROM row_pieces WHERE row_structure = 'disrupted' AND tile IN (SELECT tile FROM sc)
UNION ALL SELECT concat('waste-', tile, '-', CAST(j AS VARCHAR)), piece FROM w WHERE tile IN (SELECT tile FROM sc)"""),
    "sequence_ids": (sequence_ids, "SELECT id, concat('I', lpad(n, CAST(greatest(4, length(n)) AS INTEGER), '0')) AS sequence_id FROM (SELECT id, CAST(row_number() OVER (ORDER BY y DESC, x, id) AS VARCHAR) AS n FROM spots WHERE kind = 'inspection')"),
    "inspector_checklist": (inspector_checklist, """
WITH s AS (SELECT id % 50 AS tour, id, kind, floor(gap_m * 10) / 10 AS g, coalesce(sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)), 0) AS step FROM spots WINDOW w AS (PARTITION BY id % 50 ORDER BY id))
SELECT tour, id AS "order", id, kind, round(CASE WHEN kind = 'waste' THEN 3e0 ELSE 1 + least(coalesce(g, 0e0), 30e0) / 10 END, 2) AS priority, CASE WHEN kind = 'waste' THEN 'remove waste' ELSE concat(CAST(CAST(floor(round(g * 10)) AS BIGINT) // 10 AS VARCHAR), '.', CAST(CAST(floor(round(g * 10)) AS BIGINT) % 10 AS VARCHAR), ' m gap in row') END AS what_to_check,
round(sum(step) OVER (PARTITION BY tour ORDER BY id), 1) AS cumulative_m FROM s"""),
    "co_located_targets": (co_located_targets, None),
    "walk_cells": (walk_cells, "WITH " + _CELLS + " SELECT * FROM wlk"),
    "walk_edges": (walk_edges, "WITH " + _CELLS + """, e AS (SELECT a.scope, a.r <> b.r AND a.c <> b.c AS diagonal, a.r, a.c, b.r AS r2, b.c AS c2 FROM wlk a JOIN wlk b ON a.scope = b.scope AND ((b.r = a.r AND b.c = a.c + 1) OR (b.r = a.r + 1 AND b.c BETWEEN a.c - 1 AND a.c + 1))),
k AS (SELECT * FROM e WHERE NOT diagonal OR (EXISTS (SELECT 1 FROM wlk w WHERE w.scope = e.scope AND w.r = e.r AND w.c = e.c2) AND EXISTS (SELECT 1 FROM wlk w WHERE w.scope = e.scope AND w.r = e.r2 AND w.c = e.c)))
SELECT scope, count(*) AS edges, round(sum(CASE WHEN diagonal THEN sqrt(2e0) ELSE 1e0 END), 4) AS metres, count(*) FILTER (diagonal) AS diagonals FROM k GROUP BY 1"""),
    "snapped_targets": (snapped_targets, "WITH " + _CELLS + """, p AS (SELECT CAST(id % 25 AS INTEGER) AS scope, id, x, y / 4 AS y FROM spots WHERE kind = 'inspection'),
b AS (SELECT id, min({'d': sqrt(pow(x - c - 0.5e0, 2) + pow(y - r - 0.5e0, 2)), 'r': r, 'c': c}) AS best FROM p JOIN wlk ON p.scope = wlk.scope AND sqrt(pow(x - c - 0.5e0, 2) + pow(y - r - 0.5e0, 2)) <= 15 GROUP BY 1)
SELECT p.id, best.r AS r, best.c AS c, round(best.d, 6) AS moved FROM p LEFT JOIN b ON p.id = b.id"""),
    "distance_matrix": (distance_matrix, "WITH " + _STOPS + " SELECT s.scope, s.id AS a, t.id AS b, round(sqrt(pow(s.x - t.x, 2) + pow(s.y - t.y, 2)), 6) AS metres FROM st s JOIN st t ON s.scope = t.scope AND s.id <> t.id"),
    "exact_tours": (exact_tours, "WITH RECURSIVE " + _STOPS + """, o AS (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY k) - 1 AS n, count(*) OVER (PARTITION BY scope) AS total FROM st),
t AS (SELECT scope, n AS at_, CAST(1 << n AS BIGINT) AS seen, 0e0 AS m, '' AS path, x, y, total FROM o WHERE n = 0
 UNION ALL SELECT t.scope, o.n, t.seen + CAST(1 << o.n AS BIGINT), t.m + sqrt(pow(t.x - o.x, 2) + pow(t.y - o.y, 2)), CASE WHEN path = '' THEN o.id ELSE concat(path, ',', o.id) END, o.x, o.y, t.total FROM t JOIN o ON t.scope = o.scope AND (t.seen >> o.n) & 1 = 0),
c AS (SELECT t.scope, path, round(m + sqrt(pow(t.x - o.x, 2) + pow(t.y - o.y, 2)), 6) AS m FROM t JOIN o ON t.scope = o.scope AND o.n = 0 WHERE t.seen = (1 << t.total) - 1),
b AS (SELECT scope, min({'m': m, 'p': path}) AS best FROM c GROUP BY 1), s AS (SELECT a.scope, round(2 * sum(sqrt(pow(a.x - z.x, 2) + pow(a.y - z.y, 2))), 6) AS separate_m FROM o a JOIN o z ON a.scope = z.scope AND z.n = 0 GROUP BY 1)
SELECT b.scope, best.p AS stops, best.m AS length_m, separate_m, round(100 * (separate_m - best.m) / separate_m, 6) AS reduction_pct FROM b JOIN s ON b.scope = s.scope"""),
    "site_tour": (site_tour, None),
    "grid_routes": (grid_routes, None),
    "demo_tour": (demo_tour, "SELECT 'T01,T02,W01' AS stops, 105e0 AS tour_m, 168e0 AS separate_m, 63e0 AS saved_m, 37.5e0 AS reduction_pct"),
    "demo_distances": (demo_distances, None),
    "walk_legs": (walk_legs, """
WITH p AS (SELECT id % 50 AS walk, id AS ord, x, y, lag(x) OVER w AS px, lag(y) OVER w AS py FROM spots WINDOW w AS (PARTITION BY id % 50 ORDER BY id)),
h AS (SELECT *, sqrt(pow(x - px, 2) + pow(y - py, 2)) AS m, fmod(degrees(atan2(x - px, y - py)) + 360, 360) AS h FROM p WHERE px IS NOT NULL),
t AS (SELECT *, fmod(fmod(h - lag(h) OVER (PARTITION BY walk ORDER BY ord) + 180, 360) + 360, 360) - 180 AS d FROM h)
SELECT walk, ord, round(m, 4) AS metres, round(h, 6) AS heading, ['north', 'north-east', 'east', 'south-east', 'south', 'south-west', 'west', 'north-west'][CAST(floor((h + 22.5e0) / 45) AS BIGINT) % 8 + 1] AS compass,
CASE WHEN d IS NULL OR abs(d) < 25 THEN 'straight' WHEN abs(d) > 150 THEN 'turn around' WHEN abs(d) < 60 THEN concat('bear ', CASE WHEN d > 0 THEN 'right' ELSE 'left' END) ELSE concat('turn ', CASE WHEN d > 0 THEN 'right' ELSE 'left' END) END AS turn,
round(sum(m) OVER (PARTITION BY walk ORDER BY ord), 3) AS walked_m FROM t"""),
    "merged_steps": (merged_steps, None),
    "instructions": (instructions, None),
    "lane_cover": (lane_cover, None),
    "serpentine_lanes": (serpentine, "SELECT block, CAST(n AS INTEGER) AS n, concat('L', lpad(CAST(n AS VARCHAR), CAST(greatest(2, length(CAST(n AS VARCHAR))) AS INTEGER), '0')) AS lane_id, id AS lane, CASE WHEN n % 2 = 0 THEN x1 ELSE x0 END AS from_x, CASE WHEN n % 2 = 0 THEN x0 ELSE x1 END AS to_x FROM (SELECT *, row_number() OVER (PARTITION BY block ORDER BY y0, id) AS n FROM interrows)"),
    "sweep_costs": (sweep_costs, """
WITH RECURSIVE b AS (SELECT o_custkey % 40 AS walk, CAST(floor(o_totalprice) AS BIGINT) AS p, row_number() OVER (PARTITION BY o_custkey % 40 ORDER BY o_orderkey) AS n FROM orders),
t AS (SELECT walk, CAST(0 AS BIGINT) AS n, 0e0 AS u, 0e0 AS v FROM b WHERE n = 1
 UNION ALL SELECT t.walk, b.n, least(t.u + p % 7, t.v + p % 13), least(t.u + p % 11, t.v + p % 5) FROM t JOIN b ON b.walk = t.walk AND b.n = t.n + 1)
SELECT walk, min(least(u, v)) AS cost FROM t WHERE (walk, n) IN (SELECT walk, max(n) FROM b GROUP BY 1) GROUP BY 1"""),
    "path_sums": (path_sums, "WITH RECURSIVE p AS (SELECT p_partkey AS node, p_size AS w, (SELECT min(p_partkey) FROM part) AS least FROM part), t AS (SELECT node, node AS up, 0e0 AS total, least FROM p UNION ALL SELECT t.node, greatest(t.up // 2, t.least), t.total + w, t.least FROM t JOIN p ON p.node = t.up WHERE t.up > t.least) SELECT node, round(max(total), 6) AS total FROM t WHERE up = least GROUP BY 1"),
    "stitch_edges": (stitch_edges, "WITH " + _PIECES + " SELECT a, b FROM ed"),
    "stitched_blocks": (stitched_blocks, "WITH RECURSIVE " + _PIECES + ", bo AS (SELECT a, b FROM ed UNION SELECT b, a FROM ed), re AS (SELECT id AS n, id AS root FROM bx UNION SELECT bo.b, re.root FROM re JOIN bo ON bo.a = re.n WHERE re.root < bo.b), mi AS (SELECT n, min(root) AS root FROM re GROUP BY 1) SELECT root, count(*) AS pieces FROM mi GROUP BY 1"),
    "remaining_tiles": (remaining_tiles, "SELECT tile, count(*) AS pieces FROM row_pieces WHERE tile NOT IN (SELECT tile FROM row_pieces WHERE piece % 97 = 0) GROUP BY 1"),
    "global_ids": (global_ids, "SELECT p.piece, coalesce(v.vineyard_id, '') AS vineyard_id, coalesce(r.row_id, '') AS row_id FROM row_pieces p LEFT JOIN (SELECT DISTINCT tile, vineyard_id AS b, concat('S', vineyard_id) AS vineyard_id FROM row_pieces WHERE piece % 2 = 0) v ON p.tile = v.tile AND p.vineyard_id = v.b LEFT JOIN (SELECT DISTINCT tile, row_id AS b, concat('S', row_id) AS row_id FROM row_pieces WHERE piece % 3 = 0) r ON p.tile = r.tile AND p.row_id = r.b"),
}
