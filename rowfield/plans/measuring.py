"""Registered queries: measurements and aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowfield.functions import scalars as S
from rowfield.operators import measure as M
from rowfield.plans.common import scratch
from rowfield.sources import demo, driver

UNION_SQL = """
e{n} AS (SELECT DISTINCT {by}, x FROM (SELECT {by}, x0 AS x FROM {t} WHERE x1 > x0 AND y1 > y0 UNION ALL SELECT {by}, x1 FROM {t} WHERE x1 > x0 AND y1 > y0)),
s{n} AS (SELECT * FROM (SELECT {by}, x AS a, lead(x) OVER (PARTITION BY {by} ORDER BY x) AS b FROM e{n}) WHERE b IS NOT NULL),
d{n} AS (SELECT DISTINCT {by}, x0, y0, x1, y1 FROM {t} WHERE x1 > x0 AND y1 > y0),
m{n} AS (SELECT s{n}.{by}, a, b, y0, y1, max(y1) OVER (PARTITION BY s{n}.{by}, a ORDER BY y0, y1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM s{n} JOIN d{n} ON s{n}.{by} = d{n}.{by} AND d{n}.x0 <= a AND d{n}.x1 >= b),
u{n} AS (SELECT {by}, CAST(sum((b - a) * greatest(y1 - greatest(coalesce(seen, y0), y0), 0)) AS BIGINT) AS area FROM m{n} GROUP BY {by})
"""


def union_sql(table: str, by: str = "vineyard_id", tail: str = "") -> str:
    return UNION_SQL.format(t=table, by=by, n=tail).strip()


def measurements_levels(spark, sf_dir):
    return M.levels(driver.row_pieces(spark, sf_dir))


def row_lengths(spark, sf_dir):
    return M.row_lengths(driver.row_pieces(spark, sf_dir)).withColumn("length_m", F.round("length_m", 3))


def tile_row_lengths(spark, sf_dir):
    pieces = driver.row_pieces(spark, sf_dir)
    a, b = M.tile_row_lengths(pieces), M.tile_row_lengths(pieces, "last")
    return a.join(b.withColumnRenamed("length_m", "last_m"), ["tile", "row_id"]).select("tile", "row_id", F.round("length_m", 3).alias("length_m"), F.round("last_m", 3).alias("last_m"))


def block_union_area(spark, sf_dir):
    return M.box_unions(driver.canopies(spark, sf_dir), "vineyard_id").select("vineyard_id", F.col("area").cast("long").alias("area_cm2"))


def interrow_union_area(spark, sf_dir):
    return M.box_unions(driver.interrows(spark, sf_dir), "vineyard_id").select("vineyard_id", F.col("area").cast("long").alias("area_cm2"))


def site_union_area(spark, sf_dir):
    """The union over the whole site, not the sum of its blocks' unions; per-row unions beside it."""
    boxes = driver.canopies(spark, sf_dir)
    site = M.box_unions(boxes.withColumn("site", F.lit("all")), "site").select(F.lit("total").alias("level"), F.lit("all").alias("key"), F.col("area").cast("long").alias("area_cm2"))
    rows = M.box_unions(boxes.withColumn("row", F.concat_ws("-", "vineyard_id", (F.col("y0") / 250).cast("long").cast("string"))), "row").select(F.lit("row").alias("level"), F.col("row").alias("key"), F.col("area").cast("long").alias("area_cm2"))
    return site.unionByName(rows)


def block_measurements(spark, sf_dir):
    t = M.block_table(driver.row_pieces(spark, sf_dir), driver.canopies(spark, sf_dir), driver.interrows(spark, sf_dir))
    return t.select("vineyard_id", "row_count", F.round("row_length_m", 2).alias("row_length_m"), "canopy_count", F.round("canopy_area_m2", 4).alias("canopy_area_m2"), F.round("interrow_area_m2", 4).alias("interrow_area_m2"))


def _totals(profile):
    def run(spark, sf_dir):
        return M.site_totals(M.block_table(driver.row_pieces(spark, sf_dir), driver.canopies(spark, sf_dir), driver.interrows(spark, sf_dir)), profile)

    return run


def distinct_blocks(spark, sf_dir):
    ids = [driver.row_pieces(spark, sf_dir), driver.canopies(spark, sf_dir), driver.interrows(spark, sf_dir)]
    return ids[0].select("vineyard_id").union(ids[1].select("vineyard_id")).union(ids[2].select("vineyard_id")).distinct()


def layer_counts(spark, sf_dir):
    p = driver.row_pieces(spark, sf_dir).agg(F.countDistinct("tile").alias("tiles"), F.countDistinct("row_id").alias("rows"), F.countDistinct("vineyard_id").alias("blocks"))
    w = driver.spots(spark, sf_dir).agg(F.count_if(F.col("kind") == "waste").alias("waste"), F.count_if(F.col("kind") == "inspection").alias("inspections"))
    return p.join(w, F.lit(True), "left")


def axial_directions(spark, sf_dir):
    lines = driver.row_pieces(spark, sf_dir).select("vineyard_id", ((F.col("piece") % 13) * 0.7 + F.substring("vineyard_id", 2, 2).cast("int") * 7.0 - 3).alias("angle_deg"), "length_m")
    return M.axial_directions(lines, "vineyard_id").withColumn("direction", F.round("direction", 5))


def row_attributes(spark, sf_dir):
    return M.row_attributes(driver.row_pieces(spark, sf_dir))


def spacings(spark, sf_dir):
    return M.spacings(driver.row_pieces(spark, sf_dir).select("vineyard_id", F.col("y0").alias("offset")), "vineyard_id")


def extents(spark, sf_dir):
    return M.extent(driver.spots(spark, sf_dir), "kind")


def cover_classes(spark, sf_dir):
    strips = driver.interrows(spark, sf_dir).withColumn("occluded", (F.col("id") % 7) / 10.0)
    shown = strips.select("id", "vineyard_id", "veg_frac", S.cover(F.col("veg_frac"), F.col("occluded")).alias("cover"), F.round(S.interrow_confidence(F.col("veg_frac")), 6).alias("confidence"))
    return shown.groupBy("vineyard_id", "cover").agg(F.count(F.lit(1)).alias("strips"), F.round(F.avg("veg_frac"), 6).alias("veg_frac"), F.round(F.avg("confidence"), 6).alias("confidence"))


def half_widths(spark, sf_dir):
    """Exact 5th and 95th percentiles of canopy heights, clipped."""
    c = driver.canopies(spark, sf_dir).select("vineyard_id", ((F.col("y1") - F.col("y0")) / 200.0).alias("half"))
    clip = lambda q: F.round(F.greatest(F.lit(0.1), F.least(F.lit(1.2), F.percentile("half", q))), 6)
    return c.groupBy("vineyard_id").agg(clip(0.05).alias("low"), clip(0.95).alias("high"))


def route_comparison(spark, sf_dir):
    spots = driver.spots(spark, sf_dir).where("kind = 'inspection'").groupBy(F.floor(F.col("x") / 50).cast("long").alias("scope")).agg(F.sum(F.hypot("x", "y")).alias("single"), F.max(F.hypot("x", "y")).alias("far"))
    return spots.select("scope", *[F.round(c, 4).alias(n) for n, c in M.comparison(F.col("single"), 2.5 * F.col("far")).items()])


def off_ground_share(spark, sf_dir):
    p = driver.row_pieces(spark, sf_dir)
    off = (F.col("row_structure") == "unassessable") | (F.col("piece") % 9 == 0)
    return p.groupBy("vineyard_id").agg(F.round(F.sum(F.when(off, F.col("length_m")).otherwise(0.0)) / F.sum("length_m"), 6).alias("share"))


def detection_scores(spark, sf_dir):
    """All canopies against copies that are shifted by 20 and 10 cm: every pair of boxes that meet, best mutual pairs."""
    at = scratch(spark, "scores")
    driver.canopies(spark, sf_dir).where("x1 > x0").select("block", "x0", "y0", "x1", "y1").distinct().write.parquet(f"{at}/boxes")
    boxes = spark.read.parquet(f"{at}/boxes")
    name = F.concat_ws("_", "block", "x0", "y0", "x1", "y1")

    def side(dx, dy):
        # blocks lie beside each other, so that only boxes of one block share a tile
        left = F.col("block").cast("long") * 10_000_000
        return boxes.select(name.alias("name"), (left + F.col("x0") + dx).alias("xmin"), (F.col("y0") + dy).alias("ymin"), (left + F.col("x1") + dx).alias("xmax"), (F.col("y1") + dy).alias("ymax"))

    n = boxes.count()
    return M.match_scores(side(0, 0), side(20, 10), n, n, f"{at}/best")


def vine_spacing(spark, sf_dir):
    """The median of row periods of good quality within limits; 1.2 for blocks with fewer than three."""
    p = driver.row_pieces(spark, sf_dir).select("vineyard_id", ((F.col("piece") % 160) / 100.0 + 0.6).alias("period"), ((F.col("piece") % 83) / 100.0).alias("quality"))
    good = (F.col("quality") > 0.2) & F.col("period").between(0.85, 1.95)
    return p.groupBy("vineyard_id").agg(F.when(F.count_if(good) >= 3, F.median(F.when(good, F.col("period")))).otherwise(1.2).alias("spacing")).withColumn("spacing", F.round("spacing", 6))


def demo_metrics(spark, sf_dir):
    return demo.metrics(spark)


BLOCKS_SQL = (
    "WITH "
    + union_sql("canopies")
    + ", "
    + union_sql("interrows", tail="2")
    + """, r AS (SELECT vineyard_id, count(DISTINCT row_id) AS row_count, sum(length_m) AS row_length_m FROM row_pieces GROUP BY 1), n AS (SELECT vineyard_id, count(*) AS canopy_count FROM canopies GROUP BY 1),
ids AS (SELECT vineyard_id FROM row_pieces UNION SELECT vineyard_id FROM canopies UNION SELECT vineyard_id FROM interrows),
t AS (SELECT ids.vineyard_id, coalesce(row_count, 0) AS row_count, coalesce(row_length_m, 0e0) AS row_length_m, coalesce(canopy_count, 0) AS canopy_count, coalesce(u.area, 0) / 10000e0 AS canopy_area_m2, coalesce(u2.area, 0) / 10000e0 AS interrow_area_m2
 FROM ids LEFT JOIN r USING (vineyard_id) LEFT JOIN n USING (vineyard_id) LEFT JOIN u USING (vineyard_id) LEFT JOIN u2 USING (vineyard_id))
"""
)


def _totals_sql(value: str, places: int) -> str:
    v = lambda c: value.format(c)
    return BLOCKS_SQL + f"SELECT count(*) AS block_count, CAST(sum(row_count) AS BIGINT) AS row_count, CAST(sum(canopy_count) AS BIGINT) AS canopy_count, round(round(sum({v('row_length_m')}), 4), 2) AS row_length_m, round(round(sum({v('canopy_area_m2')}), 4), 2) AS canopy_area_m2, round(round(sum({v('interrow_area_m2')}), 4), 2) AS interrow_area_m2, round(sum({v('interrow_area_m2')}) / 10000, {places}) AS interrow_area_ha FROM t"


QUERIES = {
    "measurements_levels": (measurements_levels, """
SELECT CASE grouping(vineyard_id, row_id) WHEN 0 THEN 'row' WHEN 1 THEN 'block' ELSE 'total' END AS level, vineyard_id, row_id, round(sum(length_m), 2) AS row_length_m, count(*) AS pieces, count(DISTINCT row_id) AS row_count, count(DISTINCT vineyard_id) AS block_count
FROM row_pieces GROUP BY GROUPING SETS ((vineyard_id, row_id), (vineyard_id), ())"""),
    "row_lengths": (row_lengths, "SELECT vineyard_id, row_id, round(sum(length_m), 3) AS length_m, count(*) AS pieces FROM row_pieces GROUP BY 1, 2"),
    "tile_row_lengths": (tile_row_lengths, "SELECT tile, row_id, round(sum(length_m), 3) AS length_m, round(max_by(length_m, piece), 3) AS last_m FROM row_pieces GROUP BY 1, 2"),
    "block_union_area": (block_union_area, "WITH " + union_sql("canopies") + " SELECT vineyard_id, area AS area_cm2 FROM u"),
    "interrow_union_area": (interrow_union_area, "WITH " + union_sql("interrows") + " SELECT vineyard_id, area AS area_cm2 FROM u"),
    "site_union_area": (site_union_area, "WITH c1 AS (SELECT 'all' AS k, x0, y0, x1, y1 FROM canopies), c2 AS (SELECT concat_ws('-', vineyard_id, CAST(y0 // 250 AS BIGINT)) AS k, x0, y0, x1, y1 FROM canopies), " + union_sql("c1", "k") + ", " + union_sql("c2", "k", "2") + " SELECT 'total' AS level, k AS key, area AS area_cm2 FROM u UNION ALL SELECT 'row', k, area FROM u2"),
    "block_measurements": (block_measurements, BLOCKS_SQL + "SELECT vineyard_id, row_count, round(row_length_m, 2) AS row_length_m, canopy_count, round(canopy_area_m2, 4) AS canopy_area_m2, round(interrow_area_m2, 4) AS interrow_area_m2 FROM t"),
    "site_totals_backend": (_totals("backend"), _totals_sql("{}", 6)),
    "site_totals_service": (_totals("service"), _totals_sql("round({}, 2)", 5)),
    "distinct_blocks": (distinct_blocks, "SELECT vineyard_id FROM row_pieces UNION SELECT vineyard_id FROM canopies UNION SELECT vineyard_id FROM interrows"),
    "layer_counts": (layer_counts, "SELECT * FROM (SELECT count(DISTINCT tile) AS tiles, count(DISTINCT row_id) AS rows, count(DISTINCT vineyard_id) AS blocks FROM row_pieces), (SELECT count(*) FILTER (kind = 'waste') AS waste, count(*) FILTER (kind = 'inspection') AS inspections FROM spots)"),
    "axial_directions": (axial_directions, """
SELECT vineyard_id, round(CASE WHEN d < 0 THEN d + 180 ELSE d END, 5) AS direction FROM (SELECT vineyard_id, degrees(atan2(sum(length_m * sin(radians(a * 2))), sum(length_m * cos(radians(a * 2))))) / 2 AS d
FROM (SELECT vineyard_id, length_m, (piece % 13) * 0.7e0 + CAST(substr(vineyard_id, 2, 2) AS INTEGER) * 7e0 - 3 AS a FROM row_pieces) GROUP BY 1)"""),
    "row_attributes": (row_attributes, "SELECT row_id, floor(round(avg(coalesce(confidence, 0.7e0)), 6) * 1000 + 0.5e0) / 1000 AS confidence, CASE WHEN bool_or(row_structure = 'disrupted') THEN 'disrupted' WHEN bool_or(row_structure = 'regular') THEN 'regular' ELSE 'unassessable' END AS row_structure FROM row_pieces GROUP BY 1"),
    "spacings": (spacings, "SELECT vineyard_id, coalesce(median(step), 2.5e0) AS spacing FROM (SELECT vineyard_id, y0 - lag(y0) OVER (PARTITION BY vineyard_id ORDER BY y0) AS step FROM (SELECT DISTINCT vineyard_id, y0 FROM row_pieces)) GROUP BY 1"),
    "extents": (extents, "SELECT kind, min(x) AS xmin, min(y) AS ymin, max(x) AS xmax, max(y) AS ymax FROM spots GROUP BY 1"),
    "cover_classes": (cover_classes, """
SELECT vineyard_id, cover, count(*) AS strips, round(avg(veg_frac), 6) AS veg_frac, round(avg(confidence), 6) AS confidence FROM (SELECT vineyard_id, veg_frac,
CASE WHEN (id % 7) / 10e0 > 0.5 THEN 'unassessable' WHEN veg_frac < 0.25 THEN 'bare_soil' WHEN veg_frac > 0.75 THEN 'vegetation' ELSE 'mixed' END AS cover,
round(least(1e0, 0.55e0 + 2 * least(abs(veg_frac - 0.25e0), abs(veg_frac - 0.75e0))), 6) AS confidence FROM interrows) GROUP BY 1, 2"""),
    "half_widths": (half_widths, "SELECT vineyard_id, round(greatest(0.1e0, least(1.2e0, quantile_cont(h, 0.05))), 6) AS low, round(greatest(0.1e0, least(1.2e0, quantile_cont(h, 0.95))), 6) AS high FROM (SELECT vineyard_id, (y1 - y0) / 200e0 AS h FROM canopies) GROUP BY 1"),
    "route_comparison": (route_comparison, """
SELECT scope, round(2 * single, 4) AS separate_m, round(2.5e0 * far, 4) AS tour_m, round(2 * single - 2.5e0 * far, 4) AS saved_m, round(CASE WHEN single = 0 THEN 0e0 ELSE 100 * (2 * single - 2.5e0 * far) / (2 * single) END, 4) AS reduction_pct
FROM (SELECT CAST(floor(x / 50) AS BIGINT) AS scope, sum(sqrt(x * x + y * y)) AS single, max(sqrt(x * x + y * y)) AS far FROM spots WHERE kind = 'inspection' GROUP BY 1)"""),
    "off_ground_share": (off_ground_share, "SELECT vineyard_id, round(sum(CASE WHEN row_structure = 'unassessable' OR piece % 9 = 0 THEN length_m ELSE 0e0 END) / sum(length_m), 6) AS share FROM row_pieces GROUP BY 1"),
    "detection_scores": (detection_scores, """
WITH t AS (SELECT DISTINCT block, x0, y0, x1, y1, concat_ws('_', block, x0, y0, x1, y1) AS name FROM canopies WHERE x1 > x0),
m AS (SELECT t.name AS truth, f.name AS found, (least(t.x1, f.x1 + 20) - greatest(t.x0, f.x0 + 20)) * (least(t.y1, f.y1 + 10) - greatest(t.y0, f.y0 + 10)) AS both_, (t.x1 - t.x0) * (t.y1 - t.y0) + (f.x1 - f.x0) * (f.y1 - f.y0) AS sums
 FROM t JOIN t f ON t.block = f.block AND t.x0 < f.x1 + 20 AND f.x0 + 20 < t.x1 AND t.y0 < f.y1 + 10 AND f.y0 + 10 < t.y1),
q AS (SELECT truth, found, round(CAST(both_ AS DOUBLE) / (sums - both_), 9) AS iou FROM m WHERE round(CAST(both_ AS DOUBLE) / (sums - both_), 9) >= 0.5),
r AS (SELECT iou, row_number() OVER (PARTITION BY truth ORDER BY iou DESC, found) AS bt, row_number() OVER (PARTITION BY found ORDER BY iou DESC, truth) AS bf FROM q),
h AS (SELECT count(*) AS hits, avg(iou) AS mean_iou FROM r WHERE bt = 1 AND bf = 1)
SELECT hits, round(mean_iou, 6) AS mean_iou, round(2e0 * hits / (2 * (SELECT count(*) FROM t)), 6) AS f1 FROM h"""),
    "vine_spacing": (vine_spacing, """
SELECT vineyard_id, round(CASE WHEN count(*) FILTER (q > 0.2 AND p BETWEEN 0.85 AND 1.95) >= 3 THEN median(p) FILTER (q > 0.2 AND p BETWEEN 0.85 AND 1.95) ELSE 1.2e0 END, 6) AS spacing
FROM (SELECT vineyard_id, (piece % 160) / 100e0 + 0.6e0 AS p, (piece % 83) / 100e0 AS q FROM row_pieces) GROUP BY 1"""),
    "demo_metrics": (demo_metrics, "SELECT 4 AS row_count, 40 AS canopy_count, 3 AS interrow_count, 139.2e0 AS canopy_area_m2, 225e0 AS interrow_area_m2, 720e0 AS extent_m2, 120e0 AS row_length_m"),
}
