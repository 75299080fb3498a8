"""Numbers over a whole table, in an order of its columns, without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def padded(number: Column, width: int) -> Column:
    """A number with leading zeros up to `width` digits; a longer one stays whole."""
    text = number.cast("string")
    return F.lpad(text, F.greatest(F.lit(width), F.length(text)), "0")


def numbered(rows: DataFrame, order: list[Column], folder: str, name: str = "n") -> DataFrame:
    """rows with `name`: 1, 2, ... in `order`, which must tell all rows apart.

    The rows are dealt out by ranges and written to `folder`, so that the sizes of the ranges and the rows in them are
    those of one sampling. Each range is numbered by itself, after the rows of the ranges before it. Nulls come as the
    order has them; an empty table gives an empty result; columns pass through but for `name`, `_range` and `_before`.
    """
    spark = rows.sparkSession
    dealt = rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
    dealt.write.mode("overwrite").parquet(folder)
    dealt = spark.read.schema(dealt.schema).parquet(folder)
    sizes = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_size"))
    # a row a task of the range exchange, whatever the number of rows
    before = sizes.select("_range", (F.sum("_size").over(Window.orderBy("_range")) - F.col("_size")).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return dealt.join(F.broadcast(before), "_range").withColumn(name, F.col("_before") + place).drop("_range", "_before")
