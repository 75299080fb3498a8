"""Registered queries: scalar functions, geometry and coordinate maps."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowfield.functions import geometry as G
from rowfield.functions import scalars as S
from rowfield.sources import driver, files


def colours(spark, sf_dir):
    p = driver.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 256).cast("double").alias("r"), (F.col("p_partkey") * 7 % 256).cast("double").alias("g"), (F.col("p_size") * 5 % 256).cast("double").alias("b"))
    rgb = (F.col("r"), F.col("g"), F.col("b"))
    return p.select("id", F.round(S.excess_green(*rgb), 6).alias("exg"), F.round(S.cive(*rgb), 6).alias("cive"))


def weights(spark, sf_dir):
    s = driver.spots(spark, sf_dir)
    area = (F.col("id") % 40) / 10.0
    vivid = F.when(F.col("id") % 2 == 0, "vivid").otherwise("bright")
    conf = S.row_confidence((F.col("id") % 101) / 100.0, (F.col("id") % 11) / 20.0, (F.col("id") % 5) / 10.0)
    return s.select("id", F.round(S.inspector_weight(F.col("kind"), F.col("gap_m")), 4).alias("weight"), F.round(S.waste_confidence(vivid, area), 4).alias("waste_confidence"), F.round(conf, 6).alias("row_confidence"), F.round(S.audit_priority(conf), 6).alias("audit"), F.round(S.walking_minutes(F.col("x") * 10), 6).alias("minutes"))


def turn_lengths(spark, sf_dir):
    p = driver.table(spark, sf_dir, "part").select((F.col("p_partkey") % 120 / 10.0).alias("d"), (F.col("p_size") % 7 / 2.0).alias("radius")).distinct()
    return p.select("d", "radius", F.round(S.turn_length(F.col("d"), F.col("radius")), 6).alias("metres"))


def directions(spark, sf_dir):
    s = driver.spots(spark, sf_dir).select("id", F.col("x").alias("x"), F.col("y").alias("y"))
    b = S.bearing(F.lit(250.0), F.lit(180.0), F.col("x"), F.col("y"))
    before = (F.col("id") % 72) * 5.0 + 2.5
    return s.withColumns({"bearing": b, "before": before}).select("id", F.round("bearing", 5).alias("bearing"), S.compass(F.col("bearing")).alias("compass"), S.turn(F.col("before"), F.round("bearing", 5)).alias("turn"), F.round(S.angle_between(F.col("before"), F.col("bearing"), 180.0), 5).alias("axis_angle"))


def coordinate_maps(spark, sf_dir):
    s = driver.spots(spark, sf_dir)
    size = files.TILE_M / files.TILE_PX
    px, py = (F.col("x") - F.floor(F.col("x") / files.TILE_M) * files.TILE_M) / size, F.col("y") / size
    rx, ry = G.rotated(F.col("x"), F.col("y"), F.lit(30.0))
    return s.select("id", F.round(px, 4).alias("px"), F.round(py, 4).alias("py"), F.round(rx, 6).alias("rx"), F.round(ry, 6).alias("ry"), S.grid_row(F.col("y"), 400.0, 0.5).alias("r"), S.grid_col(F.col("x"), -10.0, 0.5).alias("c"), S.utm_code(F.col("x") / 500 * 350 - 175, F.col("y") / 4 - 45).alias("epsg"))


def tile_names(spark, sf_dir):
    t = driver.row_pieces(spark, sf_dir).select("tile").distinct()
    bounds = files.with_bounds(t.withColumns({"tile_row": S.tile_row(F.col("tile")), "tile_col": S.tile_col(F.col("tile"))}))
    return bounds.select("tile", "tile_row", "tile_col", *[F.round(c, 3).alias(c) for c in ("xmin", "ymin", "xmax", "ymax")])


def parsed_points(spark, sf_dir):
    """Text of points to rings and back: closing, length, area, bounds."""
    c = driver.interrows(spark, sf_dir)
    text = F.concat_ws(";", *[F.concat_ws(",", F.col(a).cast("string"), F.col(b).cast("string")) for a, b in (("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"))])
    ring = G.closed(S.points_of(text))
    r = c.select("id", ring.alias("ring"))
    b = G.bounds(F.col("ring"))
    return r.select("id", F.size("ring").alias("points"), G.length(F.col("ring")).alias("perimeter"), G.area(F.col("ring")).alias("area"), b["xmin"].alias("xmin"), b["ymax"].alias("ymax"))


def polygon_measures(spark, sf_dir):
    """L-shaped rings: area, centroid, point tests, clipped line lengths."""
    c = driver.interrows(spark, sf_dir).select("id", (F.col("x0") / 100.0).alias("x"), (F.col("y0") / 100.0).alias("y"), ((F.col("x1") - F.col("x0")) / 100.0).alias("w"))
    x, y, w = F.col("x"), F.col("y"), F.col("w")
    ring = F.array(G.point(x, y), G.point(x + w, y), G.point(x + w, y + 1), G.point(x + 1, y + 1), G.point(x + 1, y + 3), G.point(x, y + 3), G.point(x, y))
    r = c.where("w > 1").withColumn("ring", ring)
    m, line = G.centroid(F.col("ring")), F.array(G.point(x - 1, y + 2), G.point(x + w + 1, y + 2))
    flat = F.array(G.point(x - 1, y + 0.5), G.point(x + w + 1, y + 0.5))
    return r.select("id", F.round(G.area(F.col("ring")), 6).alias("area"), F.round(m["x"], 6).alias("cx"), F.round(m["y"], 6).alias("cy"), G.inside(x + 0.5, y + 2, F.col("ring")).alias("in_arm"), G.inside(x + 1.5, y + 2, F.col("ring")).alias("in_notch"), G.inside(x, y + 1, F.col("ring")).alias("on_edge"), F.round(G.clipped_length(line, F.col("ring")), 6).alias("across_arm"), F.round(G.clipped_length(flat, F.col("ring")), 6).alias("across_foot"))


def box_overlaps(spark, sf_dir):
    """Clipping boxes to a scope: area left, touching cases."""
    c = driver.interrows(spark, sf_dir)
    scope = (F.lit(5000), F.lit(2000), F.lit(15000), F.lit(8000))
    box = (F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))
    ring = G.clip_to_box(G.box_ring(*box), *[v.cast("double") for v in scope])
    return c.select("id", (~G.boxes_disjoint(box, scope)).alias("touches"), G.boxes_overlap(box, scope).alias("overlaps"), G.box_intersection_area(box, scope).cast("long").alias("area"), F.coalesce(G.area(ring), F.lit(0.0)).cast("long").alias("clipped")).where("touches")


def line_points(spark, sf_dir):
    """Midpoints, points at a length and distances for bent lines."""
    p = driver.row_pieces(spark, sf_dir).select("piece", "x0", "y0", (F.floor(F.col("length_m") * 500) / 500.0).alias("length_m"))
    line = F.array(G.point(F.col("x0"), F.col("y0")), G.point(F.col("x0") + F.col("length_m"), F.col("y0")), G.point(F.col("x0") + F.col("length_m"), F.col("y0") + 4))
    q = p.withColumn("line", line)
    mid, at = G.midpoint(F.col("line")), G.at_length(F.col("line"), F.col("length_m") + 1)
    return q.select("piece", F.round(G.length(F.col("line")), 4).alias("metres"), F.round(mid["x"], 4).alias("mx"), F.round(mid["y"], 4).alias("my"), F.round(at["x"], 4).alias("ax"), F.round(at["y"], 4).alias("ay"), F.round(G.distance_to_line(F.col("x0") + 1, F.col("y0") + 3, F.col("line")), 4).alias("d"))


def messages(spark, sf_dir):
    from rowfield.operators.targets import check_text

    return driver.spots(spark, sf_dir).withColumn("gap_m", F.floor(F.col("gap_m") * 10) / 10).select("id", check_text().alias("text"))


def attributes(spark, sf_dir):
    """Attribute maps from JSON: built, filtered, read."""
    e = driver.table(spark, sf_dir, "events").select("event_id", "event_type", "user_id", "value")
    m = F.map_filter(F.create_map(F.lit("kind"), F.col("event_type"), F.lit("user"), F.col("user_id").cast("string"), F.lit("empty"), F.lit(None).cast("string")), lambda k, v: v.isNotNull())
    return e.select("event_id", F.size(m).alias("n"), F.get_json_object(F.to_json(m), "$.user").cast("long").alias("user"), m["kind"].alias("kind"))


def interpolated(spark, sf_dir):
    s = driver.row_signals(spark, sf_dir)
    xs = F.array(F.lit(0.0), F.lit(10.0), F.lit(30.0))
    ys = F.array(F.col("signal")[0], F.col("signal")[1], F.col("signal")[2])
    return s.select("id", *[F.round(G.resampled(xs, ys, F.lit(v)), 6).alias(n) for n, v in (("before", -1.0), ("early", 2.5), ("late", 25.0), ("after", 99.0))])


QUERIES = {
    "colour_indices": (colours, "SELECT id, round(CASE WHEN r + g + b > 0 THEN (2 * g - r - b) / (r + g + b) ELSE 0e0 END, 6) AS exg, round(-(0.441e0 * r - 0.811e0 * g + 0.385e0 * b + 18.787e0) / 255, 6) AS cive FROM (SELECT p_partkey AS id, CAST(p_partkey % 256 AS DOUBLE) AS r, CAST(p_partkey * 7 % 256 AS DOUBLE) AS g, CAST(p_size * 5 % 256 AS DOUBLE) AS b FROM part)"),
    "target_weights": (weights, """
WITH c AS (SELECT *, greatest(0e0, least(1e0, 0.35e0 + 0.65e0 * least(1e0, (id % 101) / 100e0 / 0.7e0) * (1 - (id % 11) / 20e0) * (1 - (id % 5) / 10e0))) AS conf FROM spots)
SELECT id, round(CASE WHEN kind = 'waste' THEN 3e0 ELSE 1 + least(coalesce(gap_m, 0e0), 30e0) / 10 END, 4) AS weight, round(least(0.95e0, CASE WHEN id % 2 = 0 THEN 0.6e0 ELSE 0.5e0 END + least((id % 40) / 10e0, 2e0) / 10), 4) AS waste_confidence,
round(conf, 6) AS row_confidence, round(1 + 2 * (1 - conf), 6) AS audit, round(x * 10 / 4000e0 * 60, 6) AS minutes FROM c"""),
    "turn_lengths": (turn_lengths, "SELECT d, radius, round(CASE WHEN radius <= 0 THEN d WHEN d >= 2 * radius THEN pi() * radius + d - 2 * radius ELSE pi() * radius + 3 * (2 * radius - d) END, 6) AS metres FROM (SELECT DISTINCT p_partkey % 120 / 10e0 AS d, p_size % 7 / 2e0 AS radius FROM part)"),
    "directions": (directions, """
WITH b AS (SELECT id, (id % 72) * 5e0 + 2.5e0 AS before, CASE WHEN degrees(atan2(x - 250e0, y - 180e0)) < 0 THEN degrees(atan2(x - 250e0, y - 180e0)) + 360 ELSE degrees(atan2(x - 250e0, y - 180e0)) END AS bearing FROM spots),
t AS (SELECT *, fmod(fmod(round(bearing, 5) - before + 180, 360) + 360, 360) - 180 AS d, fmod(fmod(before - bearing, 180) + 180, 180) AS a FROM b)
SELECT id, round(bearing, 5) AS bearing, ['north', 'north-east', 'east', 'south-east', 'south', 'south-west', 'west', 'north-west'][CAST(floor((bearing + 22.5e0) / 45) AS BIGINT) % 8 + 1] AS compass,
CASE WHEN abs(d) < 25 THEN 'straight' WHEN abs(d) > 150 THEN 'turn around' WHEN abs(d) < 60 THEN concat('bear ', CASE WHEN d > 0 THEN 'right' ELSE 'left' END) ELSE concat('turn ', CASE WHEN d > 0 THEN 'right' ELSE 'left' END) END AS turn,
round(least(a, 180 - a), 5) AS axis_angle FROM t"""),
    "coordinate_maps": (coordinate_maps, "SELECT id, round((x - floor(x / 51.2e0) * 51.2e0) / 0.025e0, 4) AS px, round(y / 0.025e0, 4) AS py, round(x * cos(radians(30e0)) - y * sin(radians(30e0)), 6) AS rx, round(x * sin(radians(30e0)) + y * cos(radians(30e0)), 6) AS ry, CAST(floor((400e0 - y) / 0.5e0) AS BIGINT) AS r, CAST(floor((x + 10e0) / 0.5e0) AS BIGINT) AS c, CAST((CASE WHEN y / 4 - 45 >= 0 THEN 32600 ELSE 32700 END) + floor((x / 500 * 350 - 175 + 180) / 6) + 1 AS INTEGER) AS epsg FROM spots"),
    "tile_names": (tile_names, "SELECT tile, r AS tile_row, c AS tile_col, round(c * 51.2e0, 3) AS xmin, round(0 - r * 51.2e0 - 51.2e0, 3) AS ymin, round(c * 51.2e0 + 51.2e0, 3) AS xmax, round(0 - r * 51.2e0, 3) AS ymax FROM (SELECT DISTINCT tile, CAST(substr(tile, 2, 3) AS INTEGER) AS r, CAST(substr(tile, 7, 3) AS INTEGER) AS c FROM row_pieces)"),
    "parsed_points": (parsed_points, "SELECT id, 5 AS points, CAST(2 * (x1 - x0 + y1 - y0) AS DOUBLE) AS perimeter, CAST((x1 - x0) * (y1 - y0) AS DOUBLE) AS area, CAST(x0 AS DOUBLE) AS xmin, CAST(y1 AS DOUBLE) AS ymax FROM interrows"),
    "polygon_measures": (polygon_measures, """
SELECT id, round(w + 2, 6) AS area, round((w * (x + w / 2) + 2 * (x + 0.5e0)) / (w + 2), 6) AS cx, round((w * (y + 0.5e0) + 2 * (y + 2)) / (w + 2), 6) AS cy, true AS in_arm, false AS in_notch, false AS on_edge, 1e0 AS across_arm, round(w, 6) AS across_foot
FROM (SELECT id, x0 / 100e0 AS x, y0 / 100e0 AS y, (x1 - x0) / 100e0 AS w FROM interrows) WHERE w > 1"""),
    "box_overlaps": (box_overlaps, """
SELECT id, true AS touches, x0 < 15000 AND 5000 < x1 AND y0 < 8000 AND 2000 < y1 AS overlaps, CAST(a AS BIGINT) AS area, CAST(a AS BIGINT) AS clipped
FROM (SELECT *, greatest(least(x1, 15000) - greatest(x0, 5000), 0) * greatest(least(y1, 8000) - greatest(y0, 2000), 0) AS a FROM interrows) WHERE NOT (x1 < 5000 OR 15000 < x0 OR y1 < 2000 OR 8000 < y0)"""),
    "line_points": (line_points, """
WITH p AS (SELECT piece, x0, y0, l, (l + 4) / 2 AS h FROM (SELECT piece, x0, y0, floor(length_m * 500) / 500e0 AS l FROM row_pieces))
SELECT piece, round(l + 4, 4) AS metres, round(CASE WHEN h <= l THEN x0 + h ELSE x0 + l END, 4) AS mx, round(CASE WHEN h <= l THEN y0 ELSE y0 + h - l END, 4) AS my, round(x0 + l, 4) AS ax, round(y0 + 1, 4) AS ay,
round(least(sqrt(pow(greatest(1 - l, 0), 2) + 9), abs(l - 1)), 4) AS d FROM p"""),
    "messages": (messages, "SELECT id, CASE WHEN kind = 'waste' THEN 'remove waste' ELSE concat(CAST(CAST(floor(gap_m * 10) AS BIGINT) // 10 AS VARCHAR), '.', CAST(CAST(floor(gap_m * 10) AS BIGINT) % 10 AS VARCHAR), ' m gap in row') END AS text FROM spots"),
    "attributes": (attributes, "SELECT event_id, 2 AS n, user_id AS user, event_type AS kind FROM events"),
    "interpolated": (interpolated, "SELECT vec_id AS id, round(a, 6) AS before, round(a + 0.25e0 * (b - a), 6) AS early, round(b + 0.75e0 * (c - b), 6) AS late, round(c, 6) AS after FROM (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b, CAST(embedding[3] AS DOUBLE) AS c FROM embeddings)"),
}
