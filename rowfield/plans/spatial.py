"""Registered queries: filters, spatial joins, set operations, ranking."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from rowfield.functions import geometry as G
from rowfield.operators import spatial as X
from rowfield.operators import targets as T
from rowfield.plans.common import scratch
from rowfield.sources import driver


def _strip_boxes(spark, sf_dir):
    return driver.interrows(spark, sf_dir).select("id", "vineyard_id", *[(F.col(a) / 100.0).alias(b) for a, b in (("x0", "xmin"), ("y0", "ymin"), ("x1", "xmax"), ("y1", "ymax"))])


def _box_distance():
    dx = F.greatest(F.col("r.xmin") - F.col("l.x"), F.col("l.x") - F.col("r.xmax"), F.lit(0.0))
    dy = F.greatest(F.col("r.ymin") - F.col("l.y"), F.col("l.y") - F.col("r.ymax"), F.lit(0.0))
    return F.round(F.hypot(dx, dy), 9)


def nearest_strip(spark, sf_dir):
    spots = driver.spots(spark, sf_dir).select("id", "x", "y")
    found = X.nearest_within(spots, _strip_boxes(spark, sf_dir), 10.0, _box_distance(), "id")
    return found.select("id", "nearest", F.round("distance", 6).alias("distance"))


def waste_off_rows(spark, sf_dir):
    """Waste that isn't within 0.6 m of a row line."""
    lines = driver.row_pieces(spark, sf_dir).select(F.col("x0").alias("xmin"), F.col("y0").alias("ymin"), (F.col("x0") + F.col("length_m")).alias("xmax"), F.col("y0").alias("ymax")).withColumn("n", F.lit(1))
    spots = driver.spots(spark, sf_dir).where("kind = 'waste'").select("id", "x", (F.col("y") + (F.col("id") % 5) * 0.3).alias("y"))
    boxed = spots.withColumns({"xmin": F.col("x"), "ymin": F.col("y"), "xmax": F.col("x"), "ymax": F.col("y")})
    # only each cell's interval of x matters: rows of one y are merged before the join
    merged = lines.groupBy("ymin", F.floor(F.col("xmin") / 64).alias("k")).agg(F.min("xmin").alias("xmin"), F.max("xmax").alias("xmax"), F.collect_set(F.struct("xmin", "xmax")).alias("spans")).select("xmin", "ymin", "xmax", F.col("ymin").alias("ymax"), "spans")
    near = X.overlapping(boxed, merged, 16.0, 0.6).where(F.exists("r.spans", lambda s: G.point_segment_distance(F.col("l.x"), F.col("l.y"), s["xmin"], F.col("r.ymin"), s["xmax"], F.col("r.ymin")) <= 0.6))
    return spots.join(near.select(F.col("l.id").alias("id")).distinct(), "id", "left_anti").select("id")


def neighbour_tiles(spark, sf_dir):
    tiles = driver.row_pieces(spark, sf_dir).select("tile", F.col("tile_row").cast("int").alias("tile_row"), F.col("tile_col").cast("int").alias("tile_col")).distinct()
    return X.neighbour_tiles(tiles)


def _rows(spark, sf_dir):
    """A line a block and offset."""
    p = driver.row_pieces(spark, sf_dir)
    return p.groupBy(F.col("vineyard_id").alias("block"), F.col("row_id").alias("row")).agg(F.round(F.min("x0"), 3).alias("xmin"), F.round(F.max(F.col("x0") + F.col("length_m") / 2), 3).alias("xmax"), F.max("y0").alias("y"))


def next_rows(spark, sf_dir):
    return X.next_rows(_rows(spark, sf_dir), 2.5)


def merged_waste(spark, sf_dir):
    """Waste boxes that meet when grown by 0.3 m, as one."""
    w = driver.spots(spark, sf_dir).where("kind = 'waste'").select("id", F.when(F.col("id") % 2 == 0, "vivid").otherwise("bright").alias("kind"), F.col("x").alias("xmin"), F.col("y").alias("ymin"), (F.col("x") + 0.4).alias("xmax"), (F.col("y") + 0.4).alias("ymax"), F.lit(0.16).alias("area"))
    # boxes of one place are one node; places meet by cells
    place = w.groupBy("xmin", "ymin", "xmax", "ymax").agg(F.min("id").alias("id"), F.min_by("kind", "id").alias("kind"), F.sum("area").alias("area"), F.count(F.lit(1)).alias("n"))
    pairs = X.overlapping(place, place, 2.0, 0.6).where("l.id < r.id").select(F.col("l.id").alias("a"), F.col("r.id").alias("b"))
    roots = X.components(place.select(F.col("id").alias("node")), pairs, scratch(spark, "waste"))
    groups = X.merged_boxes(place.withColumnRenamed("n", "many"), roots)
    return groups.select("root", "kind", F.round("xmin", 3).alias("xmin"), F.round("ymin", 3).alias("ymin"), F.round("xmax", 3).alias("xmax"), F.round("ymax", 3).alias("ymax"), F.round("area", 4).alias("area"), "members")


def context(spark, sf_dir):
    """Where a spot lies: in a strip, on a path (every tenth metre), or on open ground."""
    spots = driver.spots(spark, sf_dir).select("id", "x", "y")
    # strips are 2 m high and up to 50 m long: a place meets few different pieces, but many different strips
    near = X.nearest_within(spots, _strip_boxes(spark, sf_dir), 0.6, _box_distance(), "id", piece=2.5, folder=scratch(spark, "places"))
    path = F.abs(F.col("x") - F.rint(F.col("x") / 10) * 10) < 0.5
    return near.select("id", F.when(F.col("nearest") != "", F.concat(F.lit("strip "), "nearest")).when(path, "path").otherwise("open ground").alias("place"))


def in_scope(spark, sf_dir):
    """Targets strictly inside a concave drawn area, after the box prefilter that reaches the scan."""
    ring = F.array(*[G.point(F.lit(x), F.lit(y)) for x, y in ((50.0, 20.0), (400.0, 20.0), (400.0, 300.0), (225.0, 150.0), (50.0, 300.0))])
    s = driver.spots(spark, sf_dir).where(F.col("x").between(50.0, 400.0) & F.col("y").between(20.0, 300.0))
    return s.where(G.inside(F.col("x"), F.col("y"), ring)).select("id", "kind", "x", "y")


def waste_filter(spark, sf_dir):
    w = driver.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") / 10.0).alias("w"), (F.col("p_partkey") % 37 / 10.0).alias("h"), ((F.col("p_partkey") % 19) / 18.0).alias("fill"))
    area = F.round(F.col("w") * F.col("h") * F.col("fill"), 9)
    side, aspect = F.greatest("w", "h"), F.round(F.try_divide(F.greatest("w", "h"), F.least("w", "h")), 9)
    return w.where(area.between(0.06, 4) & (side <= 3) & (aspect <= 4) & (F.col("fill") >= 0.25)).select("id", F.round(area, 6).alias("area"))


def hysteresis(spark, sf_dir):
    """Weak runs of a signal that hold a strong sample."""
    from rowfield.operators import signals

    flags = driver.signals(spark, sf_dir).withColumn("on", F.col("v") > 0.05)
    runs = signals.islands(flags)
    seeds = driver.signals(spark, sf_dir).where("v > 0.25").select(F.col("id").alias("sid"), F.col("pos").alias("seed"))
    return runs.join(seeds, (runs["id"] == seeds["sid"]) & F.col("seed").between(F.col("start"), F.col("stop")), "left_semi")


def override_layers(spark, sf_dir):
    p = driver.row_pieces(spark, sf_dir).select("tile", "piece", "tile_row")
    fallback = p.withColumn("source", F.lit("fallback"))
    truth = p.where("tile_row % 3 = 0 AND piece % 2 = 0").withColumn("source", F.lit("truth"))
    uploaded = p.where("tile_row % 6 = 0 AND piece % 5 = 0").withColumn("source", F.lit("uploaded"))
    return X.override(fallback, truth, uploaded).groupBy("tile", "source").agg(F.count(F.lit(1)).alias("n"), F.sum("piece").alias("pieces"))


def first_valid(spark, sf_dir):
    e = driver.table(spark, sf_dir, "events")
    cells = e.select((F.col("event_id") % 40).alias("r"), (F.col("user_id") % 25).alias("c"), F.col("event_id").alias("path"), (F.col("event_type") != "view").alias("valid"))
    return X.first_valid(cells, ["r", "c"], "path").select("r", "c", "path")


def ordered_distinct(spark, sf_dir):
    """First occurrences in order: a row for each key with its least place."""
    return driver.row_pieces(spark, sf_dir).groupBy("vineyard_id", "row_structure").agg(F.min("piece").alias("first"))


def missing_tiles(spark, sf_dir):
    from rowfield.operators.stitch import missing_tiles as missing

    p = driver.row_pieces(spark, sf_dir)
    return missing(p.select("tile").distinct(), p.where("piece % 4 = 0").select("tile").distinct())


def top_targets(spark, sf_dir):
    from rowfield.functions import scalars as S

    s = driver.spots(spark, sf_dir)
    return T.top(s.select("id", F.round(S.inspector_weight(F.col("kind"), F.col("gap_m")), 6).alias("priority")))


def target_cap(spark, sf_dir):
    s = driver.spots(spark, sf_dir).groupBy(F.floor(F.col("x") / 100).cast("long").alias("scope")).agg(F.count(F.lit(1)).alias("n"))
    n = F.col("n")
    return s.select("scope", n.alias("targets"), (n <= 400).alias("routable"), F.when(n > 400, F.concat(n.cast("string"), F.lit(" targets, at most 400 can be routed"))).otherwise("").alias("message"))


def nearest_tiles(spark, sf_dir):
    """The 40 tiles in view that are nearest to its centre."""
    from rowfield.sources import files

    tiles = files.with_bounds(driver.row_pieces(spark, sf_dir).select("tile", "tile_row", "tile_col").distinct())
    view = (F.lit(100.0), F.lit(-700.0), F.lit(800.0), F.lit(-100.0))
    d = F.round(F.hypot((F.col("xmin") + F.col("xmax")) / 2 - 450, (F.col("ymin") + F.col("ymax")) / 2 + 400), 6)
    return tiles.where(G.boxes_overlap((F.col("xmin"), F.col("ymin"), F.col("xmax"), F.col("ymax")), view)).select("tile", d.alias("distance")).orderBy("distance", "tile").limit(40)


def largest_pieces(spark, sf_dir):
    return driver.row_pieces(spark, sf_dir).groupBy("row_id").agg(F.max_by("piece", F.struct("length_m", "piece")).alias("piece"))


def skipped_targets(spark, sf_dir):
    s = driver.spots(spark, sf_dir).select("id", "kind")
    return T.skipped(s, s.where("id % 3 <> 0")).select("id", "kind")


def skipped_message(spark, sf_dir):
    s = driver.spots(spark, sf_dir).select("id", "kind")
    return T.skipped_message(s, s.where("id % 50 <> 0"))


def tile_block_listing(spark, sf_dir):
    p = driver.row_pieces(spark, sf_dir)
    from rowfield.operators.stitch import tile_listing

    listed = tile_listing(p.select("tile").distinct(), p.where("piece % 3 = 0").select("tile", "vineyard_id"))
    return listed.select("tile", F.array_join("vineyard_ids", ",").alias("vineyard_ids"))


def tile_positions(spark, sf_dir):
    """Every row a tile with its place, size filters and sorts applied."""
    w = Window.partitionBy("tile").orderBy("vineyard_id", "row_id", "piece")
    return driver.row_pieces(spark, sf_dir).where("length_m >= 2.0").select("tile", F.row_number().over(w).alias("place"), "piece")


_DIST = "round(sqrt(pow(greatest(xmin - x, x - xmax, 0e0), 2) + pow(greatest(ymin - y, y - ymax, 0e0), 2)), 9)"
_BOXES = "b AS (SELECT id AS bid, x0 / 100e0 AS xmin, y0 / 100e0 AS ymin, x1 / 100e0 AS xmax, y1 / 100e0 AS ymax FROM interrows)"
_NEAREST = _BOXES + f", n AS (SELECT s.id, min({{'d': {_DIST}, 'bid': bid}}) AS best FROM spots s JOIN b ON x BETWEEN xmin - {{r}} AND xmax + {{r}} AND y BETWEEN ymin - {{r}} AND ymax + {{r}} WHERE {_DIST} <= {{r}} GROUP BY 1)"


def _nearest(radius: str) -> str:
    return _NEAREST.replace("{r}", radius)


_ROWS = "rws AS (SELECT vineyard_id AS block, row_id AS row_, round(min(x0), 3) AS xmin, round(max(x0 + length_m / 2), 3) AS xmax, max(y0) AS y FROM row_pieces GROUP BY 1, 2)"
QUERIES = {
    "nearest_strip": (nearest_strip, "WITH " + _nearest("10e0") + " SELECT s.id, coalesce(CAST(best.bid AS VARCHAR), '') AS nearest, round(best.d, 6) AS distance FROM spots s LEFT JOIN n ON s.id = n.id"),
    "waste_off_rows": (waste_off_rows, "WITH w AS (SELECT id, x, y + (id % 5) * 0.3e0 AS y FROM spots WHERE kind = 'waste') SELECT id FROM w WHERE NOT EXISTS (SELECT 1 FROM row_pieces p WHERE abs(w.y - y0) <= 0.6 AND w.x BETWEEN x0 - 0.6 AND x0 + length_m + 0.6 AND sqrt(pow(w.y - y0, 2) + pow(greatest(x0 - w.x, w.x - x0 - length_m, 0e0), 2)) <= 0.6)"),
    "neighbour_tiles": (neighbour_tiles, "WITH t AS (SELECT DISTINCT tile, tile_row, tile_col FROM row_pieces) SELECT a.tile, b.tile AS neighbour FROM t a JOIN t b ON greatest(abs(a.tile_row - b.tile_row), abs(a.tile_col - b.tile_col)) = 1"),
    "next_rows": (next_rows, "WITH " + _ROWS + ", p AS (SELECT a.block, a.row_, min({'dy': b.y - a.y, 'n': b.row_}) AS best FROM rws a JOIN rws b ON a.block = b.block AND b.y - a.y > 1.25 AND b.y - a.y < 4.0 AND least(a.xmax, b.xmax) - greatest(a.xmin, b.xmin) >= 2 GROUP BY 1, 2) SELECT block, row_ AS row, best.n AS next, best.dy AS dy FROM p"),
    "merged_waste": (merged_waste, None),
    "place_context": (context, "WITH " + _nearest("0.6e0") + " SELECT s.id, CASE WHEN best.bid IS NOT NULL THEN concat('strip ', CAST(best.bid AS VARCHAR)) WHEN abs(x - round_even(x / 10, 0) * 10) < 0.5 THEN 'path' ELSE 'open ground' END AS place FROM spots s LEFT JOIN n ON s.id = n.id"),
    "in_scope": (in_scope, "SELECT id, kind, x, y FROM spots WHERE x > 50 AND x < 400 AND y > 20 AND CASE WHEN x <= 225 THEN y < 300 - (x - 50) * 150e0 / 175 ELSE y < 150 + (x - 225) * 150e0 / 175 END"),
    "waste_filter": (waste_filter, "SELECT id, round(area, 6) AS area FROM (SELECT p_partkey AS id, p_size / 10e0 AS w, p_partkey % 37 / 10e0 AS h, (p_partkey % 19) / 18e0 AS fill, round(p_size / 10e0 * (p_partkey % 37 / 10e0) * ((p_partkey % 19) / 18e0), 9) AS area FROM part) WHERE area BETWEEN 0.06 AND 4 AND greatest(w, h) <= 3 AND least(w, h) > 0 AND round(greatest(w, h) / least(w, h), 9) <= 4 AND fill >= 0.25"),
    "hysteresis": (hysteresis, """
WITH f AS (SELECT id, pos, v, v > 0.05 AS o, row_number() OVER (PARTITION BY id ORDER BY pos) - row_number() OVER (PARTITION BY id, v > 0.05 ORDER BY pos) AS g FROM signals)
SELECT id, min(pos) AS start, max(pos) AS stop, count(*) AS n FROM f WHERE o GROUP BY id, g HAVING max(v) > 0.25"""),
    "override_layers": (override_layers, """
WITH a AS (SELECT tile, piece, 0 AS p, 'fallback' AS source FROM row_pieces UNION ALL SELECT tile, piece, 1, 'truth' FROM row_pieces WHERE tile_row % 3 = 0 AND piece % 2 = 0 UNION ALL SELECT tile, piece, 2, 'uploaded' FROM row_pieces WHERE tile_row % 6 = 0 AND piece % 5 = 0),
r AS (SELECT *, max(p) OVER (PARTITION BY tile) AS top FROM a) SELECT tile, source, count(*) AS n, CAST(sum(piece) AS BIGINT) AS pieces FROM r WHERE p = top GROUP BY 1, 2"""),
    "first_valid": (first_valid, "SELECT event_id % 40 AS r, user_id % 25 AS c, min(event_id) AS path FROM events WHERE event_type <> 'view' GROUP BY 1, 2"),
    "ordered_distinct": (ordered_distinct, "SELECT vineyard_id, row_structure, min(piece) AS first FROM row_pieces GROUP BY 1, 2"),
    "missing_tiles": (missing_tiles, "SELECT DISTINCT tile FROM row_pieces EXCEPT SELECT tile FROM row_pieces WHERE piece % 4 = 0"),
    "top_targets": (top_targets, "SELECT id, round(CASE WHEN kind = 'waste' THEN 3e0 ELSE 1 + least(coalesce(gap_m, 0e0), 30e0) / 10 END, 6) AS priority FROM spots ORDER BY priority DESC, id LIMIT 40"),
    "target_cap": (target_cap, "SELECT CAST(floor(x / 100) AS BIGINT) AS scope, count(*) AS targets, count(*) <= 400 AS routable, CASE WHEN count(*) > 400 THEN concat(CAST(count(*) AS VARCHAR), ' targets, at most 400 can be routed') ELSE '' END AS message FROM spots GROUP BY 1"),
    "nearest_tiles": (nearest_tiles, "SELECT tile, round(sqrt(pow(c * 51.2e0 + 25.6e0 - 450, 2) + pow(-r * 51.2e0 - 25.6e0 + 400, 2)), 6) AS distance FROM (SELECT DISTINCT tile, tile_row AS r, tile_col AS c FROM row_pieces) WHERE c * 51.2 < 800 AND c * 51.2 + 51.2 > 100 AND -r * 51.2 - 51.2 < -100 AND -r * 51.2 > -700 ORDER BY distance, tile LIMIT 40"),
    "largest_pieces": (largest_pieces, "SELECT row_id, (max({'l': length_m, 'p': piece})).p AS piece FROM row_pieces GROUP BY 1"),
    "skipped_targets": (skipped_targets, "SELECT id, kind FROM spots WHERE id % 3 = 0"),
    "skipped_message": (skipped_message, "WITH s AS (SELECT id, row_number() OVER (ORDER BY id) AS n FROM spots WHERE id % 50 = 0) SELECT count(*) AS n, concat(string_agg(CAST(id AS VARCHAR), ', ' ORDER BY id) FILTER (n <= 10), CASE WHEN count(*) > 10 THEN ', ...' ELSE '' END) AS ids FROM s"),
    "tile_block_listing": (tile_block_listing, "SELECT tile, coalesce(string_agg(DISTINCT vineyard_id, ',' ORDER BY vineyard_id) FILTER (piece % 3 = 0), '') AS vineyard_ids FROM row_pieces GROUP BY 1"),
    "tile_positions": (tile_positions, "SELECT tile, CAST(row_number() OVER (PARTITION BY tile ORDER BY vineyard_id, row_id, piece) AS INTEGER) AS place, piece FROM row_pieces WHERE length_m >= 2.0"),
}
