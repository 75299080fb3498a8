"""Site-wide ids from pieces on tiles: stitching, numbering of blocks and rows, detection state."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowfield.functions.scalars import angle_between
from rowfield.operators import spatial
from rowfield.operators.numbering import numbered, padded

# Distances and angles of the stitching rules.
BUFFER_M, ANGLE_DEG, OFFSET_SHARE, BAND_M = 1.5, 6.0, 0.4, 25.0


def stitch_edges(pieces: DataFrame) -> DataFrame:
    """a, b (a < b): block pieces (id, tile, angle, box) of different tiles whose boxes, each grown by the buffer, meet
    and whose axes differ by at most the angle or are unknown."""
    pairs = spatial.overlapping(pieces, pieces, spatial.usual_cell(pieces, 2 * BUFFER_M), 2 * BUFFER_M)
    alike = F.col("l.angle").isNull() | F.col("r.angle").isNull() | (angle_between(F.col("l.angle"), F.col("r.angle"), 180.0) <= ANGLE_DEG)
    return pairs.where((F.col("l.id") < F.col("r.id")) & (F.col("l.tile") != F.col("r.tile")) & alike).select(F.col("l.id").alias("a"), F.col("r.id").alias("b"))


def numbered_blocks(blocks: DataFrame, folder: str) -> DataFrame:
    """block ids V01, V02, ... from north to south in bands, west to east within a band; ids beyond V99 are longer."""
    placed = blocks.withColumn("_band", -F.rint(F.col("y") / BAND_M))
    ranged = numbered(placed, [F.asc("_band"), F.asc("x"), F.asc("id")], folder)
    return ranged.withColumn("vineyard_id", F.concat(F.lit("V"), padded(F.col("n"), 2))).drop("_band", "n")


def numbered_rows(pieces: DataFrame, spacing: str = "spacing") -> DataFrame:
    """Pieces (vineyard_id, offset, spacing) with row_no: a new row where the offset steps by more than a share of the
    spacing."""
    w = Window.partitionBy("vineyard_id").orderBy("offset", "piece")
    new = F.coalesce((F.col("offset") - F.lag("offset").over(w)) > OFFSET_SHARE * F.col(spacing), F.lit(True))
    return pieces.withColumn("_new", new.cast("int")).withColumn("row_no", F.sum("_new").over(w)).drop("_new")


def global_ids(features: DataFrame, vmap: DataFrame, rmap: DataFrame) -> DataFrame:
    """Local ids replaced by site-wide ones, '' where unknown. The maps have a row an id and tile."""
    out = features.join(vmap, ["tile", "local_block"], "left").join(rmap, ["tile", "local_row"], "left")
    return out.withColumns({"vineyard_id": F.coalesce("vineyard_id", F.lit("")), "row_id": F.coalesce("row_id", F.lit(""))})


def without_tiles(layer: DataFrame, deleted: DataFrame) -> DataFrame:
    return layer.join(deleted.select("tile"), "tile", "left_anti")


def replace_tiles(layer: DataFrame, path: str) -> None:
    """Write a layer by tile; only the partitions of its own tiles are replaced."""
    layer.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("tile").parquet(path)


def missing_tiles(wanted: DataFrame, catalog: DataFrame) -> DataFrame:
    return wanted.select("tile").exceptAll(catalog.select("tile"))


def tile_listing(catalog: DataFrame, canopies: DataFrame) -> DataFrame:
    """Every catalog tile with the sorted distinct block ids of its canopies."""
    ids = canopies.groupBy("tile").agg(F.sort_array(F.collect_set("vineyard_id")).alias("vineyard_ids"))
    return catalog.join(ids, "tile", "left").withColumn("vineyard_ids", F.coalesce("vineyard_ids", F.array().cast("array<string>")))
