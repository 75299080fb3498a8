"""File sources and sinks of the survey: GeoJSON, annotation XML, tidy CSV, text; all by Spark's own readers and writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowfield.functions import geometry as G
from rowfield.functions import scalars as S

# The annotation format's labels and the tile size in pixels and metres.
LABELS = {"canopy": "vineyard", "interrow": "interrow_area", "row": "row", "waste": "waste"}
TILE_PX, TILE_M = 2048, 51.2

_ATTRIBUTE = "array<struct<_name:string,_VALUE:string>>"
_SHAPE = f"array<struct<_label:string,_points:string,attribute:{_ATTRIBUTE}>>"
_BOX = f"array<struct<_label:string,_xtl:double,_ytl:double,_xbr:double,_ybr:double,attribute:{_ATTRIBUTE}>>"
ANNOTATION = f"_id bigint, _name string, _width int, _height int, polygon {_SHAPE}, polyline {_SHAPE}, box {_BOX}"

_GEOJSON = "type string, features array<struct<type:string,properties:map<string,string>,geometry:struct<type:string,coordinates:string>>>"


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """Features of a collection: kind (of geometry), properties (map), coordinates (JSON text)."""
    found = spark.read.schema(_GEOJSON).option("multiLine", True).json(path)
    return found.select(F.explode("features").alias("f")).select(F.col("f.geometry.type").alias("kind"), F.col("f.properties").alias("properties"), F.col("f.geometry.coordinates").alias("coordinates"))


def ring_of(coordinates: Column) -> Column:
    """The outer ring of polygon coordinates in JSON."""
    return _pairs(F.from_json(coordinates, "array<array<array<double>>>")[0])


def line_of(coordinates: Column) -> Column:
    return _pairs(F.from_json(coordinates, "array<array<double>>"))


def _pairs(points: Column) -> Column:
    return F.transform(points, lambda p: G.point(p[0], p[1]))


def read_zones(spark: SparkSession, path: str) -> DataFrame:
    """zone ('passage' or 'forbidden', by the lower-cased property) and ring; other features are skipped."""
    f = read_features(spark, path).where("kind = 'Polygon'")
    return f.select(F.lower(F.col("properties")["type"]).alias("zone"), ring_of(F.col("coordinates")).alias("ring")).where(F.col("zone").isin("passage", "forbidden"))


def read_start(spark: SparkSession, path: str) -> DataFrame:
    f = read_features(spark, path).where("kind = 'Point'").limit(1)
    xy = F.from_json("coordinates", "array<double>")
    return f.select(xy[0].alias("x"), xy[1].alias("y"))


def feature(kind: str, coordinates: Column, properties: Column) -> Column:
    return F.struct(F.lit("Feature").alias("type"), F.struct(F.lit(kind).alias("type"), coordinates.alias("coordinates")).alias("geometry"), properties.alias("properties"))


def coordinates(points: Column) -> Column:
    return F.transform(points, lambda p: F.array(p["x"], p["y"]))


def collections(features: DataFrame, *by: str) -> DataFrame:
    """A FeatureCollection for each group of rows with a `feature` column, as JSON text."""
    one = F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.array_sort(F.collect_list("feature"), lambda a, b: F.when(F.to_json(a) < F.to_json(b), -1).when(F.to_json(a) > F.to_json(b), 1).otherwise(0)).alias("features")))
    return features.groupBy(*by).agg(one.alias("json"))


def write_geojson(features: DataFrame, path: str, layer: str = "layer") -> None:
    """One folder a layer, a feature a line (newline-delimited GeoJSON), so that layers of any size are written in parallel."""
    features.select(layer, F.to_json("feature").alias("value")).write.mode("overwrite").partitionBy(layer).text(path)


def read_annotations(spark: SparkSession, path: str, catalog: DataFrame | None = None) -> dict[str, DataFrame]:
    """Layers of annotation XML: canopy and interrow (ring), row (line), waste (box); attributes as a map. Tiles that the
    catalog doesn't list are skipped; an unfinished ring is closed."""
    image = spark.read.schema(ANNOTATION).option("rowTag", "image").option("attributePrefix", "_").option("valueTag", "_VALUE").format("xml").load(path)
    image = image.withColumn("tile", F.regexp_replace("_name", r"^.*/", ""))
    if catalog is not None:
        image = image.join(catalog.select("tile"), "tile", "left_semi")
    extra = F.map_from_entries(F.transform(F.coalesce("s.attribute", F.array().cast(_ATTRIBUTE)), lambda a: F.struct(a["_name"], a["_VALUE"]))).alias("attributes")
    polygon = image.select("tile", F.posexplode("polygon").alias("ord", "s"))
    ring = lambda label: polygon.where(F.col("s._label") == LABELS[label]).select("tile", "ord", G.closed(S.points_of(F.col("s._points"))).alias("ring"), extra)
    line = image.select("tile", F.posexplode("polyline").alias("ord", "s")).where(F.col("s._label") == LABELS["row"]).select("tile", "ord", S.points_of(F.col("s._points")).alias("line"), extra)
    box = image.select("tile", F.posexplode("box").alias("ord", "s")).where(F.col("s._label") == LABELS["waste"]).select("tile", "ord", G.box_ring(F.col("s._xtl"), F.col("s._ytl"), F.col("s._xbr"), F.col("s._ybr")).alias("ring"), extra)
    return {"canopy": ring("canopy"), "interrow": ring("interrow"), "row": line, "waste": box}


def write_annotations(layers: dict[str, DataFrame], path: str) -> None:
    """Layers (tile and ring or line in pixels, attributes) as annotation XML, one image element a tile."""

    def shapes(df: DataFrame, label: str, column: str) -> DataFrame:
        attributes = F.transform(F.map_entries("attributes"), lambda e: F.struct(e["key"].alias("_name"), e["value"].alias("_VALUE")))
        return df.select("tile", F.struct(F.lit(label).alias("_label"), S.points_text(F.col(column), 2).alias("_points"), attributes.alias("attribute")).alias("s"))

    polygon = shapes(layers["canopy"], LABELS["canopy"], "ring").unionByName(shapes(layers["interrow"], LABELS["interrow"], "ring"))
    line = shapes(layers["row"], LABELS["row"], "line")
    b = G.bounds(F.col("ring"))
    attributes = F.transform(F.map_entries("attributes"), lambda e: F.struct(e["key"].alias("_name"), e["value"].alias("_VALUE")))
    box = layers["waste"].select("tile", F.struct(F.lit(LABELS["waste"]).alias("_label"), b["xmin"].alias("_xtl"), b["ymin"].alias("_ytl"), b["xmax"].alias("_xbr"), b["ymax"].alias("_ybr"), attributes.alias("attribute")).alias("s"))
    gather = lambda df, name: df.groupBy("tile").agg(F.array_sort(F.collect_list("s")).alias(name))
    every = gather(polygon, "polygon").join(gather(line, "polyline"), "tile", "full").join(gather(box, "box"), "tile", "full")
    out = every.select(F.abs(F.hash("tile")).cast("long").alias("_id"), F.col("tile").alias("_name"), F.lit(TILE_PX).alias("_width"), F.lit(TILE_PX).alias("_height"), "polygon", "polyline", "box")
    out.write.mode("overwrite").format("xml").option("rootTag", "annotations").option("rowTag", "image").option("attributePrefix", "_").option("valueTag", "_VALUE").save(path)


def write_measurements(levels: DataFrame, path: str) -> None:
    """The tidy CSV: blocks in order, rows before their block's line, the total last. The lines are sorted by ranges."""
    rank = F.when(F.col("level") == "row", 0).when(F.col("level") == "block", 1).otherwise(2)
    levels.orderBy(F.col("vineyard_id").asc_nulls_last(), rank, "row_id").write.mode("overwrite").option("header", True).option("nullValue", "").csv(path)


def read_measurements(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).schema("level string, vineyard_id string, row_id string, row_length_m double, pieces bigint, row_count bigint, block_count bigint").csv(path)


def tile_catalog(spark: SparkSession, path: str) -> DataFrame:
    """tile, tile_row, tile_col, bytes and local bounds of tiles in a folder, from names and lengths alone; contents
    aren't read. Names that carry no grid place are left out."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tif*").option("recursiveFileLookup", True).load(path).select("path", "length")
    name = F.regexp_extract("path", r"([^/]+)\.tiff?$", 1)
    found = files.select(F.regexp_extract(name, r"(r\d{3}_c\d{3})$", 1).alias("tile"), F.col("length").alias("bytes")).where("tile <> ''")
    return with_bounds(found.withColumns({"tile_row": S.tile_row(F.col("tile")), "tile_col": S.tile_col(F.col("tile"))}))


def with_bounds(tiles: DataFrame, left: float = 0.0, top: float = 0.0) -> DataFrame:
    x, y = F.lit(left) + F.col("tile_col") * TILE_M, F.lit(top) - F.col("tile_row") * TILE_M
    return tiles.withColumns({"xmin": x, "ymax": y, "xmax": x + TILE_M, "ymin": y - TILE_M})


def pixel_to_local(ring: Column, xmin: Column, ymax: Column) -> Column:
    size = TILE_M / TILE_PX
    return G.affine(ring, F.lit(size), F.lit(0.0), xmin, F.lit(0.0), F.lit(-size), ymax)


def local_to_pixel(ring: Column, xmin: Column, ymax: Column) -> Column:
    """Pixels of a tile, to a tenth, without the ring's last point."""
    size = TILE_M / TILE_PX
    moved = F.transform(ring, lambda p: G.point(F.round((p["x"] - xmin) / size, 1), F.round((ymax - p["y"]) / size, 1)))
    return F.slice(moved, 1, F.greatest(F.size(moved) - 1, F.lit(0)))


def parameters(spark: SparkSession, path: str) -> dict[str, dict[str, float]]:
    """A parameter model: module names and their constants, a file of fixed small size."""
    row = spark.read.option("multiLine", True).json(path).select(F.to_json(F.struct("*")).alias("j")).first()
    import json

    return json.loads(row["j"])


def write_parameters(path: str, model: dict[str, dict[str, float]]) -> str:
    """The parameter model as a JSON file that `parameters` reads."""
    import json
    from pathlib import Path

    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(model, indent=2))
    return path


# What an upload may hold, and how its refusals are worded.
MAX_UPLOAD_FILES, MAX_UPLOAD_MB = 10, 50


def upload_checks(uploads: DataFrame) -> DataFrame:
    """uploads (request, filename, bytes, readable, has_crs): each file with ok and error. All files of a request with too
    many go; a null name is `unnamed.tif`."""
    from pyspark.sql import Window

    name = F.coalesce("filename", F.lit("unnamed.tif"))
    many = F.count(F.lit(1)).over(Window.partitionBy("request")) > MAX_UPLOAD_FILES
    error = (
        F.when(many, f"Max {MAX_UPLOAD_FILES} files per upload")
        .when(~F.lower(name).rlike(r"\.tiff?$"), "Not a .tif/.tiff file")
        .when(F.col("bytes") > MAX_UPLOAD_MB * 1024 * 1024, f"Exceeds {MAX_UPLOAD_MB}MB limit")
        .when(~F.coalesce("readable", F.lit(False)), "Not a valid GeoTIFF")
        .when(~F.coalesce("has_crs", F.lit(False)), "No CRS/geotransform in this file")
    )
    return uploads.withColumn("filename", name).withColumn("error", error).withColumn("ok", F.col("error").isNull())
