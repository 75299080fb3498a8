"""Incremental tile arrival: detections come as files, changed tiles are replaced whole, measurements follow.

The reference surface has no event-time streaming; `event_windows` (watermark, tumbling windows) and `sessions` are an
addition over the events feed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rowfield.operators import measure, stitch


def arriving(spark: SparkSession, folder: str, schema: str, pattern: str = "*.parquet", files: int | None = None) -> DataFrame:
    """Rows of files as they come; `files` bounds a micro-batch."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(folder)


def latest(batch: DataFrame) -> DataFrame:
    """Of a tile that comes more than once in a batch, the rows of its newest version."""
    newest = batch.groupBy("tile").agg(F.max("version").alias("_newest"))
    return batch.join(newest, "tile").where("version = _newest").drop("_newest")


def keep_tiles(pieces: DataFrame, layer: str, checkpoint: str, then=None) -> StreamingQuery:
    """Replace the partitions of arriving tiles in `layer`, then call `then` with the whole layer. A batch that is run
    again after a failure replaces the same partitions by the same rows."""

    def batch(df: DataFrame, number: int) -> None:
        stitch.replace_tiles(latest(df), layer)
        if then is not None:
            then(df.sparkSession.read.parquet(layer), number)

    return pieces.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def measured(layer: DataFrame) -> DataFrame:
    return measure.levels(layer)


def event_windows(events: DataFrame, late: str = "1 hour", size: str = "6 hours") -> DataFrame:
    """Counts and sums by type in tumbling windows of event time; state older than the watermark goes."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 3).alias("total"))


def sessions(events: DataFrame, late: str = "1 hour", gap: str = "30 minutes") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))


def drained(df: DataFrame, path: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Run a bounded stream to its end. The last state replaces the table at `path` (complete), or rows are added."""
    spark = df.sparkSession

    def batch(part: DataFrame, number: int) -> None:
        part.write.mode("overwrite" if mode == "complete" else "append").parquet(path)

    query = df.writeStream.outputMode(mode).foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(path)
