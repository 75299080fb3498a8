"""Registered queries: plantings that belong together, overlapping blocks, lanes and their turns, tracks, searches."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from rowfield.functions import geometry as G
from rowfield.operators import plantings as P
from rowfield.operators import routing as R
from rowfield.operators import spatial as X
from rowfield.plans.common import scratch
from rowfield.sources import driver, files


def _plantings(spark, sf_dir):
    """A box a tile, of a size by how many row pieces it has; regions are two by two tiles."""
    g = driver.row_pieces(spark, sf_dir).groupBy("tile_row", "tile_col").agg(F.count(F.lit(1)).alias("n"))
    x, y = F.round(F.col("tile_col") * 51.2, 4), F.round(F.col("tile_row") * 51.2, 4)
    return g.select(
        (F.col("tile_row") * 100 + F.col("tile_col")).cast("long").alias("id"),
        (F.floor(F.col("tile_row") / 2) * 100 + F.floor(F.col("tile_col") / 2)).cast("long").alias("region"),
        x.alias("xmin"), y.alias("ymin"), F.round(x + 44 + F.col("n") % 9, 4).alias("xmax"), F.round(y + 44 + F.col("n") % 7, 4).alias("ymax"),
    )


def _passages(spark):
    """Three tracks across the site."""
    return spark.createDataFrame([(202.0, 0.0, 204.6, 1100.0), (0.0, 201.0, 1100.0, 204.7), (610.0, 0.0, 612.0, 500.0)], "xmin double, ymin double, xmax double, ymax double")


def planting_links(spark, sf_dir):
    return P.planting_links(_plantings(spark, sf_dir), _passages(spark))


def merged_plantings(spark, sf_dir):
    b = _plantings(spark, sf_dir)
    return X.components(b.select(F.col("id").alias("node")), P.planting_links(b, _passages(spark)), scratch(spark, "plantings")).groupBy("root").agg(F.count(F.lit(1)).alias("blocks"))


def kept_blocks(spark, sf_dir):
    s = driver.interrows(spark, sf_dir)
    b = s.select("id", F.col("x0").cast("double").alias("xmin"), F.col("y0").cast("double").alias("ymin"), F.col("x1").cast("double").alias("xmax"), F.col("y1").cast("double").alias("ymax"), (F.col("x1") - F.col("x0")).alias("length"))
    return P.kept_blocks(b, scratch(spark, "kept")).select("id", "length")


def lane_lines(spark, sf_dir):
    """Strips turned about a corner by steps of 15 degrees."""
    s = driver.interrows(spark, sf_dir)
    w, h = (F.col("x1") - F.col("x0")) / 100.0, (F.col("y1") - F.col("y0")) / 100.0 - 0.1
    turned = lambda x, y: G.point(*G.rotated(x, y, (F.col("id") % 12) * 15.0))
    zero = F.lit(0.0)
    lane = s.select("id", P.lane_of(F.array(turned(zero, zero), turned(w, zero), turned(w, h), turned(zero, h))).alias("lane"))
    at = lambda i, c: F.round(F.col("lane")[i][c] + 1000, 4)
    return lane.select("id", at(0, "x").alias("ax"), at(0, "y").alias("ay"), at(1, "x").alias("bx"), at(1, "y").alias("by"))


def u_turns(spark, sf_dir):
    """Each block's lanes from south to north, every second one backwards."""
    s = driver.interrows(spark, sf_dir)
    n = F.row_number().over(Window.partitionBy("block").orderBy("y0", "x0", "id"))
    y = (F.col("y0") + F.col("y1")) / 200.0
    lane = F.array(G.point(F.col("x0") / 100.0, y), G.point(F.col("x1") / 100.0 + 2, y))
    t = P.u_turns(s.select("block", n.alias("n"), "id", lane.alias("lane")))
    at = lambda i, c: F.round(F.col("turn")[i][c], 4)
    return t.select("block", "n", "id", at(0, "x").alias("ax"), at(0, "y").alias("ay"), at(1, "x").alias("ex"), at(1, "y").alias("ey"))


def inner_points(spark, sf_dir):
    """Strips with a notch from above."""
    s = driver.interrows(spark, sf_dir).select("id", ((F.col("x1") - F.col("x0")) / 100.0).alias("w"), (F.col("id") % 7 / 10.0 + 0.2).alias("p"), (F.col("id") % 9 / 5.0 + 0.1).alias("d"))
    a, b, zero, top = F.col("w") * F.col("p") / 2, F.col("w") * F.col("p"), F.lit(0.0), F.lit(2.0)
    corners = [(zero, zero), (F.col("w"), zero), (F.col("w"), top), (b, top), (b, F.col("d")), (a, F.col("d")), (a, top), (zero, top)]
    p = s.select("id", G.inner_point(F.array(*[G.point(x, y) for x, y in corners])).alias("p"))
    return p.select("id", F.round("p.x", 6).alias("x"), F.round("p.y", 6).alias("y"))


def track_ahead(spark, sf_dir):
    p = driver.row_pieces(spark, sf_dir)
    n = F.row_number().over(Window.partitionBy("row_id").orderBy("piece"))
    points = p.select(F.col("row_id").alias("track"), "piece", n.alias("n"), (n * 5.0).alias("x"), (F.col("y0") + F.col("piece") % 3).alias("y"))
    return P.track_ahead(points, 5.0).select("piece", F.round("expected", 6).alias("expected"))


def row_search(spark, sf_dir):
    terms = F.array(*[F.lit(q) for q in ("", "Reg", "dis", "V01", "unassessable")])
    rows = driver.row_pieces(spark, sf_dir).groupBy("vineyard_id", "row_id", "row_structure").agg(F.count(F.lit(1)).alias("pieces"))
    # five terms, each against every row: a stated set of queries
    return P.row_search(rows.withColumn("q", F.explode(terms)), F.col("q")).select("q", "row_id", "row_structure", "pieces")


def log_page(spark, sf_dir):
    e = driver.table(spark, sf_dir, "events").select(F.col("user_id").alias("job"), F.col("event_id").alias("at"))
    return P.log_page(e, F.col("job") % 7).select("job", "line", "n", F.col("at").alias("event_id"))


def distinct_rows(spark, sf_dir):
    """Rows of up to 64 m that wave about lines 0.4 m apart, in blocks of a hundred."""
    v = driver.row_signals(spark, sf_dir).select(F.floor(F.col("id") / 100).alias("block"), "id", (F.col("id") % 7).alias("x0"), "signal")
    n = (F.size("signal") - F.col("id") % 20).cast("int")
    return P.distinct_rows(v.select("block", "id", "x0", F.transform(F.slice("signal", 1, n), lambda y: y + F.col("id") % 100 * 0.4).alias("ys")), 1.0).select("block", "id")


def path_lengths(spark, sf_dir):
    """A binary tree of stops on a plane, every fifth one off the ground that may be walked."""
    t = driver.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), F.col("p_size").cast("double").alias("y"))
    least = t.agg(F.min("node")).first()[0] or 0
    parent = F.when(F.col("node") <= least, F.col("node")).otherwise(F.greatest(F.floor(F.col("node") / 2).cast("long"), F.lit(least)))
    tree = t.select("node", parent.alias("parent"), (F.col("node") % 100).cast("double").alias("x"), "y", (F.col("node") % 5 != 0).alias("passable"))
    out = R.path_lengths(tree, scratch(spark, "lengths"))
    return out.select("node", F.round("length_m", 3).alias("length_m"), F.round("off_m", 3).alias("off_m"))


def padded_views(spark, sf_dir):
    """The map's view of each strip, 30 m wide at least, as latitude and longitude."""
    s = driver.interrows(spark, sf_dir)
    box = F.struct(*[(F.col(c) / 100.0).alias(n) for c, n in (("x0", "xmin"), ("y0", "ymin"), ("x1", "xmax"), ("y1", "ymax"))])
    b = s.select("id", G.padded_bounds(box, 30.0).alias("b"))
    c = b.select("id", G.lat_lng(F.array(G.point(F.col("b.xmin"), F.col("b.ymin")), G.point(F.col("b.xmax"), F.col("b.ymax")))).alias("c"))
    at = lambda i, j: F.round(F.col("c")[i][j], 6)
    return c.select("id", at(0, 0).alias("south"), at(0, 1).alias("west"), at(1, 0).alias("north"), at(1, 1).alias("east"))


def upload_checks(spark, sf_dir):
    p = driver.row_pieces(spark, sf_dir).select(
        F.floor(F.col("piece") / 40).alias("request"), "piece", (F.col("piece") * 7919 % 60 * 1048576).alias("bytes"), (F.col("piece") % 11 != 0).alias("readable"), (F.col("piece") % 13 != 0).alias("has_crs"),
        F.when(F.col("piece") % 17 != 0, F.concat(F.lit("tile"), F.when(F.col("piece") % 5 == 0, ".png").when(F.col("piece") % 3 == 0, ".TIFF").otherwise(".tif"))).alias("filename"),
    )
    return files.upload_checks(p).select("piece", "filename", "ok", "error")


_BOXES = """g AS (SELECT tile_row, tile_col, count(*) AS n FROM row_pieces GROUP BY 1, 2),
bx AS (SELECT tile_row * 100 + tile_col AS id, tile_row // 2 * 100 + tile_col // 2 AS region, round(tile_col * 51.2e0, 4) AS xmin, round(tile_row * 51.2e0, 4) AS ymin, round(round(tile_col * 51.2e0, 4) + 44 + n % 9, 4) AS xmax, round(round(tile_row * 51.2e0, 4) + 44 + n % 7, 4) AS ymax FROM g),
pa AS (SELECT * FROM (VALUES (202e0, 0e0, 204.6e0, 1100e0), (0e0, 201e0, 1100e0, 204.7e0), (610e0, 0e0, 612e0, 500e0)) AS t(xmin, ymin, xmax, ymax)),
pr AS (SELECT l.id AS a, r.id AS b, CASE WHEN r.xmin > l.xmax THEN l.xmax WHEN l.xmin > r.xmax THEN l.xmin ELSE (greatest(l.xmin, r.xmin) + least(l.xmax, r.xmax)) / 2 END AS x, CASE WHEN r.xmin > l.xmax THEN r.xmin WHEN l.xmin > r.xmax THEN r.xmax ELSE (greatest(l.xmin, r.xmin) + least(l.xmax, r.xmax)) / 2 END AS u,
 CASE WHEN r.ymin > l.ymax THEN l.ymax WHEN l.ymin > r.ymax THEN l.ymin ELSE (greatest(l.ymin, r.ymin) + least(l.ymax, r.ymax)) / 2 END AS y, CASE WHEN r.ymin > l.ymax THEN r.ymin WHEN l.ymin > r.ymax THEN r.ymax ELSE (greatest(l.ymin, r.ymin) + least(l.ymax, r.ymax)) / 2 END AS v FROM bx l JOIN bx r ON l.id < r.id AND l.region <> r.region),
ln AS (SELECT *, sqrt((u - x) * (u - x) + (v - y) * (v - y)) AS d FROM pr WHERE sqrt((u - x) * (u - x) + (v - y) * (v - y)) < 5),
ed AS (SELECT a, b FROM ln WHERE NOT EXISTS (SELECT 1 FROM pa WHERE CASE WHEN d <= 0.01e0 THEN sqrt(pow(greatest(0, pa.xmin - x, x - pa.xmax), 2) + pow(greatest(0, pa.ymin - y, y - pa.ymax), 2)) <= 0.5e0
 ELSE greatest(0e0, CASE WHEN u = x THEN CASE WHEN x BETWEEN pa.xmin AND pa.xmax THEN 0e0 ELSE 2e0 END ELSE least((pa.xmin - x) / (u - x), (pa.xmax - x) / (u - x)) END, CASE WHEN v = y THEN CASE WHEN y BETWEEN pa.ymin AND pa.ymax THEN 0e0 ELSE 2e0 END ELSE least((pa.ymin - y) / (v - y), (pa.ymax - y) / (v - y)) END)
  <= least(1e0, CASE WHEN u = x THEN CASE WHEN x BETWEEN pa.xmin AND pa.xmax THEN 1e0 ELSE -1e0 END ELSE greatest((pa.xmin - x) / (u - x), (pa.xmax - x) / (u - x)) END, CASE WHEN v = y THEN CASE WHEN y BETWEEN pa.ymin AND pa.ymax THEN 1e0 ELSE -1e0 END ELSE greatest((pa.ymin - y) / (v - y), (pa.ymax - y) / (v - y)) END) END))"""
QUERIES = {
    "planting_links": (planting_links, "WITH " + _BOXES + " SELECT a, b FROM ed"),
    "merged_plantings": (merged_plantings, "WITH RECURSIVE " + _BOXES + """, bo AS (SELECT a, b FROM ed UNION SELECT b, a FROM ed), re AS (SELECT id AS n, id AS root FROM bx UNION SELECT bo.b, re.root FROM re JOIN bo ON bo.a = re.n WHERE re.root < bo.b),
mi AS (SELECT n, min(root) AS root FROM re GROUP BY 1) SELECT root, count(*) AS blocks FROM mi GROUP BY 1"""),
    "kept_blocks": (kept_blocks, None),
    "lane_lines": (lane_lines, """
WITH s AS (SELECT id, (x1 - x0) / 100e0 AS w, (y1 - y0) / 100e0 - 0.1e0 AS h, radians((id % 12) * 15e0) AS t FROM interrows),
l AS (SELECT id, t, greatest(w, h) >= 1.6e0 AS ok, CASE WHEN w <= h THEN w / 2 ELSE w - 0.3e0 END AS ax, CASE WHEN w <= h THEN 0.3e0 ELSE h / 2 END AS ay, CASE WHEN w <= h THEN w / 2 ELSE 0.3e0 END AS bx, CASE WHEN w <= h THEN h - 0.3e0 ELSE h / 2 END AS by_ FROM s)
SELECT id, CASE WHEN ok THEN round(ax * cos(t) - ay * sin(t) + 1000, 4) END AS ax, CASE WHEN ok THEN round(ax * sin(t) + ay * cos(t) + 1000, 4) END AS ay, CASE WHEN ok THEN round(bx * cos(t) - by_ * sin(t) + 1000, 4) END AS bx, CASE WHEN ok THEN round(bx * sin(t) + by_ * cos(t) + 1000, 4) END AS "by" FROM l"""),
    "u_turns": (u_turns, """
WITH s AS (SELECT block, id, row_number() OVER (PARTITION BY block ORDER BY y0, x0, id) AS n, x0 / 100e0 AS x0, x1 / 100e0 + 2 AS x1, (y0 + y1) / 200e0 AS y FROM interrows),
t AS (SELECT *, CASE WHEN n % 2 = 1 THEN 1 ELSE -1 END AS s, lead(y) OVER w AS ny, lead(x0) OVER w AS nx0, lead(x1) OVER w AS nx1 FROM s WINDOW w AS (PARTITION BY block ORDER BY n))
SELECT block, n, id, round(CASE WHEN s = 1 THEN greatest(x1, nx1) + 1.5e0 ELSE least(x0, nx0) - 1.5e0 END, 4) AS ax, round(y, 4) AS ay, round(CASE WHEN s = 1 THEN greatest(x1, nx1) + 1.5e0 ELSE least(x0, nx0) - 1.5e0 END, 4) AS ex, round(ny, 4) AS ey FROM t WHERE ny IS NOT NULL"""),
    "inner_points": (inner_points, """
WITH s AS (SELECT id, (x1 - x0) / 100e0 AS w, id % 7 / 10e0 + 0.2e0 AS p, id % 9 / 5e0 + 0.1e0 AS d FROM interrows)
SELECT id, round(CASE WHEN d > 1 THEN w / 2 WHEN w - w * p > w * p / 2 THEN (w * p + w) / 2 ELSE w * p / 4 END, 6) AS x, round(CASE WHEN d > 1 THEN d / 2 ELSE (d + 2) / 2 END, 6) AS y FROM s"""),
    "track_ahead": (track_ahead, """
WITH p AS (SELECT row_id, piece, y0 + piece % 3 AS y FROM row_pieces)
SELECT piece, round(y + coalesce((y - lag(y, 2) OVER (PARTITION BY row_id ORDER BY piece)) / 10e0, 0) * 5, 6) AS expected FROM p"""),
    "row_search": (row_search, """
WITH r AS (SELECT vineyard_id, row_id, row_structure, count(*) AS pieces FROM row_pieces GROUP BY 1, 2, 3), t AS (SELECT unnest(['', 'Reg', 'dis', 'V01', 'unassessable']) AS q)
SELECT q, row_id, row_structure, pieces FROM r JOIN t ON q = '' OR row_id = lower(q) OR vineyard_id = lower(q) OR starts_with(row_structure, lower(q))"""),
    "log_page": (log_page, """
WITH l AS (SELECT user_id AS job, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS line, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT job, line, n, event_id FROM l WHERE line >= job % 7"""),
    "distinct_rows": (distinct_rows, None),
    "path_lengths": (path_lengths, """
WITH RECURSIVE p AS (SELECT p_partkey AS node, p_partkey % 100 AS x, p_size AS y, p_partkey % 5 <> 0 AS good, CASE WHEN p_partkey <= (SELECT min(p_partkey) FROM part) THEN p_partkey ELSE greatest(p_partkey // 2, (SELECT min(p_partkey) FROM part)) END AS parent FROM part),
s AS (SELECT p.node, p.parent, sqrt(pow(p.x - q.x, 2) + pow(p.y - q.y, 2)) AS w, p.good AND q.good AS good FROM p JOIN p q ON p.parent = q.node),
t AS (SELECT node, node AS up, 0e0 AS m, 0e0 AS off FROM s UNION ALL SELECT t.node, s.parent, m + w, off + CASE WHEN good THEN 0e0 ELSE w END FROM t JOIN s ON t.up = s.node WHERE s.parent <> s.node)
SELECT t.node, round(round(m, 6), 3) AS length_m, round(round(off, 6), 3) AS off_m FROM t JOIN s ON t.up = s.node WHERE s.parent = s.node"""),
    "padded_views": (padded_views, """
WITH b AS (SELECT id, x0 / 100e0 AS x0, y0 / 100e0 AS y0, x1 / 100e0 AS x1, y1 / 100e0 AS y1 FROM interrows)
SELECT id, round((y0 + y1) / 2 - greatest((y1 - y0) / 2, 15e0), 6) AS south, round((x0 + x1) / 2 - greatest((x1 - x0) / 2, 15e0), 6) AS west, round((y0 + y1) / 2 + greatest((y1 - y0) / 2, 15e0), 6) AS north, round((x0 + x1) / 2 + greatest((x1 - x0) / 2, 15e0), 6) AS east FROM b"""),
    "upload_checks": (upload_checks, """
WITH p AS (SELECT piece, count(*) OVER (PARTITION BY piece // 40) AS n, piece * 7919 % 60 AS mb, CASE WHEN piece % 17 = 0 THEN 'unnamed.tif' WHEN piece % 5 = 0 THEN 'tile.png' WHEN piece % 3 = 0 THEN 'tile.TIFF' ELSE 'tile.tif' END AS filename FROM row_pieces),
e AS (SELECT piece, filename, CASE WHEN n > 10 THEN 'Max 10 files per upload' WHEN filename LIKE '%.png' THEN 'Not a .tif/.tiff file' WHEN mb > 50 THEN 'Exceeds 50MB limit' WHEN piece % 11 = 0 THEN 'Not a valid GeoTIFF' WHEN piece % 13 = 0 THEN 'No CRS/geotransform in this file' END AS error FROM p)
SELECT piece, filename, error IS NULL AS ok, error FROM e"""),
}
