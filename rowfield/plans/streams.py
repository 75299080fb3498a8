"""Registered queries: files as streams, and round trips through the sinks and sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowfield.functions import geometry as G
from rowfield.operators import measure as M
from rowfield.plans.common import scratch
from rowfield.sources import driver, files
from rowfield.streaming import tiles

_EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def stream_windows(spark, sf_dir):
    at = scratch(spark, "windows")
    events = tiles.arriving(spark, sf_dir, _EVENTS, "events.parquet")
    out = tiles.drained(tiles.event_windows(events), f"{at}/out", f"{at}/checkpoint")
    return out.select(F.unix_seconds("w.start").alias("start"), "event_type", "n", F.round("total", 2).alias("total"))


def stream_sessions(spark, sf_dir):
    at = scratch(spark, "sessions")
    events = tiles.arriving(spark, sf_dir, _EVENTS, "events.parquet")
    out = tiles.drained(tiles.sessions(events), f"{at}/out", f"{at}/checkpoint")
    return out.select("user_id", F.unix_seconds("w.start").alias("start"), "n")


def stream_tiles(spark, sf_dir):
    """Pieces come in three files, the last with newer versions of some tiles; the layer ends as if written at once."""
    at = scratch(spark, "tiles")
    p = driver.row_pieces(spark, sf_dir).select("piece", "vineyard_id", "row_id", "tile", "tile_row", "length_m")
    p.where("tile_row % 2 = 0").withColumn("version", F.lit(1)).coalesce(1).write.parquet(f"{at}/in/a.parquet")
    p.where("tile_row % 2 = 1").withColumn("version", F.lit(1)).coalesce(1).write.parquet(f"{at}/in/b.parquet")
    p.where("tile_row % 3 = 0").withColumns({"version": F.lit(2), "length_m": F.col("length_m") * 2}).coalesce(1).write.parquet(f"{at}/in/c.parquet")
    schema = "piece bigint, vineyard_id string, row_id string, tile string, tile_row bigint, length_m double, version int"
    for name in ("a", "b", "c"):  # each folder arrives on its own, so the order of versions is sure
        tiles.keep_tiles(tiles.arriving(spark, f"{at}/in/{name}.parquet", schema), f"{at}/layer", f"{at}/checkpoint-{name}").awaitTermination()
    return tiles.measured(spark.read.parquet(f"{at}/layer"))


def csv_round_trip(spark, sf_dir):
    at = scratch(spark, "csv")
    files.write_measurements(M.levels(driver.row_pieces(spark, sf_dir)), at)
    return files.read_measurements(spark, at)


def annotations_round_trip(spark, sf_dir):
    """Layers to annotation XML and back: counts and areas by tile."""
    at = scratch(spark, "xml")
    s = driver.interrows(spark, sf_dir)
    tile = driver.tile_name(F.col("id") % 6, F.col("block"))
    ring = G.box_ring(F.col("x0") / 100.0, F.col("y0") / 100.0, F.col("x1") / 100.0, F.col("y1") / 100.0)
    attributes = F.create_map(F.lit("vineyard_id"), F.col("vineyard_id"))
    base = s.select(tile.alias("tile"), ring.alias("ring"), attributes.alias("attributes"), F.col("id"))
    lines = base.where("id % 3 = 2").select("tile", F.slice("ring", 1, 2).alias("line"), "attributes")
    layers = {"canopy": base.where("id % 3 = 0"), "interrow": base.where("id % 3 = 1"), "row": lines, "waste": base.where("id % 5 = 0")}
    files.write_annotations(layers, at)
    found = files.read_annotations(spark, at)
    area = lambda k: found[k].select("tile", F.lit(k).alias("layer"), G.area(F.col("ring")).alias("v"), F.col("attributes")["vineyard_id"].alias("vineyard_id"))
    rows = found["row"].select("tile", F.lit("row").alias("layer"), G.length(F.col("line")).alias("v"), F.col("attributes")["vineyard_id"].alias("vineyard_id"))
    every = area("canopy").unionByName(area("interrow")).unionByName(area("waste")).unionByName(rows)
    return every.groupBy("tile", "layer").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("v"), 2).alias("total"), F.min("vineyard_id").alias("first"))


def geojson_layers(spark, sf_dir):
    """Feature collections by block, parsed again."""
    s = driver.interrows(spark, sf_dir)
    ring = G.box_ring(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))
    f = s.select("vineyard_id", files.feature("Polygon", F.array(files.coordinates(ring)), F.struct("id", "veg_frac")).alias("feature"))
    c = files.collections(f, "vineyard_id")
    kind = "struct<type:string,features:array<struct<geometry:struct<coordinates:array<array<array<double>>>>,properties:struct<id:bigint,veg_frac:double>>>>"
    back = c.select("vineyard_id", F.from_json("json", kind).alias("c")).select("vineyard_id", F.explode("c.features").alias("f"))
    corner = F.col("f.geometry.coordinates")[0]
    return back.select("vineyard_id", F.col("f.properties.id").alias("id"), corner[0][0].alias("x0"), corner[2][1].alias("y1"), F.size(corner).alias("points"))


QUERIES = {
    "stream_windows": (stream_windows, "SELECT CAST(floor(epoch(ts) / 21600) * 21600 AS BIGINT) AS start, event_type, count(*) AS n, round(round(sum(value), 3), 2) AS total FROM events GROUP BY 1, 2"),
    "stream_sessions": (stream_sessions, "WITH g AS (SELECT user_id, ts, CASE WHEN coalesce(epoch(ts) - epoch(lag(ts) OVER w) >= 1800, true) THEN 1 ELSE 0 END AS new_ FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(new_) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS start, count(*) AS n FROM s GROUP BY user_id, k"),
    "stream_tiles": (stream_tiles, """
SELECT CASE grouping(vineyard_id, row_id) WHEN 0 THEN 'row' WHEN 1 THEN 'block' ELSE 'total' END AS level, vineyard_id, row_id, round(sum(CASE WHEN tile_row % 3 = 0 THEN 2 * length_m ELSE length_m END), 2) AS row_length_m, count(*) AS pieces, count(DISTINCT row_id) AS row_count, count(DISTINCT vineyard_id) AS block_count
FROM row_pieces GROUP BY GROUPING SETS ((vineyard_id, row_id), (vineyard_id), ())"""),
    "csv_round_trip": (csv_round_trip, """
SELECT CASE grouping(vineyard_id, row_id) WHEN 0 THEN 'row' WHEN 1 THEN 'block' ELSE 'total' END AS level, vineyard_id, row_id, round(sum(length_m), 2) AS row_length_m, count(*) AS pieces, count(DISTINCT row_id) AS row_count, count(DISTINCT vineyard_id) AS block_count
FROM row_pieces GROUP BY GROUPING SETS ((vineyard_id, row_id), (vineyard_id), ())"""),
    "annotations_round_trip": (annotations_round_trip, """
WITH b AS (SELECT concat('r', lpad(CAST(id % 6 AS VARCHAR), 3, '0'), '_c', lpad(CAST(block AS VARCHAR), 3, '0')) AS tile, id, vineyard_id, (x1 - x0) / 100e0 AS w, (y1 - y0) / 100e0 AS h FROM interrows),
e AS (SELECT tile, 'canopy' AS layer, w * h AS v, vineyard_id FROM b WHERE id % 3 = 0 UNION ALL SELECT tile, 'interrow', w * h, vineyard_id FROM b WHERE id % 3 = 1 UNION ALL SELECT tile, 'row', w, vineyard_id FROM b WHERE id % 3 = 2 UNION ALL SELECT tile, 'waste', w * h, vineyard_id FROM b WHERE id % 5 = 0)
SELECT tile, layer, count(*) AS n, round(sum(v), 2) AS total, min(vineyard_id) AS first FROM e GROUP BY 1, 2"""),
    "geojson_layers": (geojson_layers, "SELECT vineyard_id, id, CAST(x0 AS DOUBLE) AS x0, CAST(y1 AS DOUBLE) AS y1, 5 AS points FROM interrows"),
}
