"""Registered queries: summaries, request checks, export coordinates, buffers, user-drawn blocks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from rowfield.functions import geometry as G
from rowfield.functions import projection
from rowfield.sources import driver


def site_summary(spark, sf_dir):
    """One row as JSON: counts and totals of a run."""
    p = driver.row_pieces(spark, sf_dir).agg(F.countDistinct("vineyard_id").alias("blocks"), F.countDistinct("row_id").alias("rows"), F.round(F.sum("length_m"), 1).alias("row_m"))
    s = driver.spots(spark, sf_dir).agg(F.count_if(F.col("kind") == "waste").alias("waste"), F.count(F.lit(1)).alias("targets"))
    j = F.to_json(F.struct("blocks", "rows", "waste", "targets"))
    return p.join(s, F.lit(True), "left").select(j.alias("json"), "row_m")


def custom_blocks(spark, sf_dir):
    """Drawn blocks: rings are closed, those of fewer than three points refused, deleted ids go."""
    n = driver.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"))
    corner = lambda i: G.point((i % 2) * 10 + F.col("k"), F.floor(i / 2) * 10 + F.col("k"))
    ring = F.transform(F.sequence(F.lit(0), F.col("k") % 5), corner)
    drawn = n.select(F.concat(F.lit("custom-"), F.col("k").cast("string")).alias("id"), "k", ring.alias("ring"))
    valid = F.size("ring") >= 3
    kept = drawn.join(drawn.where("k % 4 = 0").select("id"), "id", "left_anti")
    return kept.select("id", F.when(valid, F.size(G.closed(F.col("ring")))).alias("points"), F.when(valid, "created").otherwise("refused").alias("status"))


def corner_transfers(spark, sf_dir):
    """The shortest way between two blocks of a band, over their exits and entries."""
    b = driver.blocks(spark, sf_dir).withColumn("band", F.floor(F.col("y") / 90).cast("int"))
    side = F.explode(F.array(*[F.struct(F.lit(float(dx)).alias("dx"), F.lit(float(dy)).alias("dy")) for dx in (-20, 20) for dy in (-15, 15)]))
    c = b.withColumn("s", side).select("band", "vineyard_id", (F.col("x") + F.col("s.dx")).alias("x"), (F.col("y") + F.col("s.dy")).alias("y"))
    d = c.select("band", F.col("vineyard_id").alias("b"), F.col("x").alias("u"), F.col("y").alias("v"))
    return c.join(d, "band").where("vineyard_id < b").groupBy(F.col("vineyard_id").alias("a"), "b").agg(F.round(F.min(F.hypot(F.col("x") - F.col("u"), F.col("y") - F.col("v"))), 6).alias("metres"))


def dropped_stops(spark, sf_dir):
    """Per block the worst stops that go when its share off the ground is over the cap: one to five, by the excess."""
    p = driver.row_pieces(spark, sf_dir)
    off = F.when(F.col("row_structure") == "unassessable", F.col("length_m")).otherwise(0.0)
    share = p.groupBy("vineyard_id").agg((F.sum(off) / F.sum("length_m")).alias("share"))
    k = F.greatest(F.lit(1), F.least(F.lit(5), F.floor((F.col("share") - 0.018) * 100))).cast("int")
    worst = F.row_number().over(Window.partitionBy("vineyard_id").orderBy(F.desc("length_m"), "piece"))
    over = share.where("share > 0.018").select("vineyard_id", k.alias("k"))
    return p.join(F.broadcast(over), "vineyard_id").withColumn("n", worst).where("n <= k").select("vineyard_id", "piece", "k")


def request_checks(spark, sf_dir):
    """Status and message of requests: unknown tiles, bad roles, missing starts; some unknown tiles are listed."""
    e = driver.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.when(F.col("event_type") == "view", "farmer").when(F.col("event_type") == "error", "auditor").otherwise(F.col("event_type")).alias("role"), driver.tile_name(F.col("event_id") % 22, F.col("user_id") % 20).alias("tile"), F.when(F.col("event_id") % 10 != 3, F.col("value")).alias("start"))
    known = driver.row_pieces(spark, sf_dir).select("tile").distinct().withColumn("known", F.lit(True))
    r = e.join(known, "tile", "left")
    status = F.when(~F.col("role").isin("farmer", "auditor"), 422).when(F.col("start").isNull(), 422).when(F.col("known").isNull(), 404).otherwise(200)
    text = F.when(~F.col("role").isin("farmer", "auditor"), "unknown role").when(F.col("start").isNull(), "no start").when(F.col("known").isNull(), F.concat(F.lit("unknown tile "), "tile")).otherwise("")
    return r.select("id", status.alias("status"), text.alias("message"))


def lon_lat(spark, sf_dir):
    s = driver.spots(spark, sf_dir)
    lon, lat = projection.lon_lat(F.col("x") * 100 + 600000, F.col("y") * 100 + 5200000, 35)
    return s.select("id", F.round(lon, 7).alias("lon"), F.round(lat, 7).alias("lat"))


def preview_pixels(spark, sf_dir):
    s = driver.spots(spark, sf_dir)
    return s.select("id", F.round((F.col("x") - 10) / 0.25, 1).alias("px"), F.round(-(F.col("y") - 400) / 0.25, 1).alias("py"))


def flat_buffers(spark, sf_dir):
    """Row lines grown to both sides with flat ends, as rings; and boxes grown on all sides."""
    p = driver.row_pieces(spark, sf_dir).select("piece", "x0", "y0", F.round("length_m", 3).alias("l"))
    ring = G.box_ring(F.col("x0"), F.col("y0") - 0.3, F.col("x0") + F.col("l"), F.col("y0") + 0.3)
    grown = G.box_ring(F.col("x0") - 1.5, F.col("y0") - 1.5, F.col("x0") + F.col("l") + 1.5, F.col("y0") + 1.5)
    return p.select("piece", F.round(G.area(ring), 4).alias("flat"), F.round(G.area(grown), 4).alias("grown"))


def coverage_area(spark, sf_dir):
    """The ground a route may use: the union of a block's tiles, and its extent with a margin."""
    from rowfield.operators.measure import box_unions

    t = driver.row_pieces(spark, sf_dir).select("vineyard_id", "tile_row", "tile_col").distinct()
    boxes = t.select("vineyard_id", (F.col("tile_col") * 512).alias("x0"), (F.col("tile_row") * 512).alias("y0"), (F.col("tile_col") * 512 + 512).alias("x1"), (F.col("tile_row") * 512 + 512).alias("y1"))
    extent = boxes.groupBy("vineyard_id").agg(((F.max("x1") - F.min("x0") + 800) * (F.max("y1") - F.min("y0") + 800)).alias("extent"))
    return box_unions(boxes, "vineyard_id").join(extent, "vineyard_id").select("vineyard_id", F.col("area").cast("long").alias("tiles"), F.col("extent").cast("long").alias("extent"))


QUERIES = {
    "site_summary": (site_summary, "SELECT concat('{\"blocks\":', CAST(b AS VARCHAR), ',\"rows\":', CAST(r AS VARCHAR), ',\"waste\":', CAST(w AS VARCHAR), ',\"targets\":', CAST(t AS VARCHAR), '}') AS json, row_m FROM (SELECT count(DISTINCT vineyard_id) AS b, count(DISTINCT row_id) AS r, round(sum(length_m), 1) AS row_m FROM row_pieces), (SELECT count(*) FILTER (kind = 'waste') AS w, count(*) AS t FROM spots)"),
    "custom_blocks": (custom_blocks, "SELECT concat('custom-', CAST(n_nationkey AS VARCHAR)) AS id, CASE WHEN n_nationkey % 5 >= 2 THEN CAST(n_nationkey % 5 + 2 AS INTEGER) END AS points, CASE WHEN n_nationkey % 5 >= 2 THEN 'created' ELSE 'refused' END AS status FROM nation WHERE n_nationkey % 4 <> 0"),
    "corner_transfers": (corner_transfers, "WITH c AS (SELECT CAST(floor(y / 90) AS INTEGER) AS band, vineyard_id AS v, x + dx AS x, y + dy AS y FROM blocks, (SELECT unnest([-20e0, 20e0]) AS dx), (SELECT unnest([-15e0, 15e0]) AS dy)) SELECT p.v AS a, q.v AS b, round(min(sqrt(pow(p.x - q.x, 2) + pow(p.y - q.y, 2))), 6) AS metres FROM c p JOIN c q ON p.band = q.band AND p.v < q.v GROUP BY 1, 2"),
    "dropped_stops": (dropped_stops, "WITH s AS (SELECT vineyard_id, sum(CASE WHEN row_structure = 'unassessable' THEN length_m ELSE 0e0 END) / sum(length_m) AS share FROM row_pieces GROUP BY 1), k AS (SELECT vineyard_id, CAST(greatest(1, least(5, floor((share - 0.018e0) * 100))) AS INTEGER) AS k FROM s WHERE share > 0.018), r AS (SELECT vineyard_id, piece, row_number() OVER (PARTITION BY vineyard_id ORDER BY length_m DESC, piece) AS n FROM row_pieces) SELECT r.vineyard_id, piece, k FROM r JOIN k ON r.vineyard_id = k.vineyard_id WHERE n <= k"),
    "request_checks": (request_checks, "WITH r AS (SELECT event_id AS id, event_type IN ('view', 'error') AS ok, concat('r', lpad(CAST(event_id % 22 AS VARCHAR), 3, '0'), '_c', lpad(CAST(user_id % 20 AS VARCHAR), 3, '0')) AS tile, event_id % 10 <> 3 AND value IS NOT NULL AS start FROM events) SELECT id, CASE WHEN NOT ok OR NOT start THEN 422 WHEN tile NOT IN (SELECT tile FROM row_pieces) THEN 404 ELSE 200 END AS status, CASE WHEN NOT ok THEN 'unknown role' WHEN NOT start THEN 'no start' WHEN tile NOT IN (SELECT tile FROM row_pieces) THEN concat('unknown tile ', tile) ELSE '' END AS message FROM r"),
    "lon_lat": (lon_lat, None),
    "preview_pixels": (preview_pixels, "SELECT id, round((x - 10) / 0.25e0, 1) AS px, round(-(y - 400) / 0.25e0, 1) AS py FROM spots"),
    "flat_buffers": (flat_buffers, "SELECT piece, round(0.6e0 * l, 4) AS flat, round((l + 3) * 3, 4) AS grown FROM (SELECT piece, round(length_m, 3) AS l FROM row_pieces)"),
    "coverage_area": (coverage_area, "SELECT vineyard_id, count(*) * 262144 AS tiles, CAST((max(c) * 512 + 512 - min(c) * 512 + 800) * (max(r) * 512 + 512 - min(r) * 512 + 800) AS BIGINT) AS extent FROM (SELECT DISTINCT vineyard_id, tile_row AS r, tile_col AS c FROM row_pieces) GROUP BY 1"),
}
