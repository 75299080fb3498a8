"""The survey layers, projected from the driver's star-schema tables.

The tables hold no geometry, so each layer is a fixed arithmetic image of one of them. LAYERS_SQL is the same
projection in ANSI SQL, as common table expressions, for the twins of the queries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowfield.operators.numbering import padded


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def block_name(nation: Column) -> Column:
    return F.concat(F.lit("V"), padded(nation + 1, 2))


def tile_name(row: Column, col: Column) -> Column:
    return F.concat(F.lit("r"), padded(row, 3), F.lit("_c"), padded(col, 3))


def structure(status: Column) -> Column:
    return F.when(status == "F", "regular").when(status == "O", "disrupted").otherwise("unassessable")


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vineyard_id, centre x and y (metres)."""
    n = table(spark, sf_dir, "nation")
    return n.select(block_name(F.col("n_nationkey")).alias("vineyard_id"), ((F.col("n_nationkey") % 5) * 120.0 + F.col("n_regionkey") * 7.0).alias("x"), (F.floor(F.col("n_nationkey") / 5) * 90.0 + F.col("n_regionkey") * 3.0).alias("y"))


def row_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """piece, vineyard_id, row_id, tile, tile_row, tile_col, x0, y0, length_m, row_structure, confidence. A piece is
    a horizontal line from (x0, y0)."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    vid = block_name(F.col("c_nationkey"))
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("piece"),
        vid.alias("vineyard_id"),
        F.concat(vid, F.lit("-R"), padded(F.col("o_custkey") % 40 + 1, 3)).alias("row_id"),
        tile_name(F.col("o_orderkey") % 18, F.col("o_custkey") % 20).alias("tile"),
        (F.col("o_orderkey") % 18).alias("tile_row"),
        (F.col("o_custkey") % 20).alias("tile_col"),
        ((F.col("o_orderkey") % 512) * 0.5).alias("x0"),
        ((F.col("o_custkey") % 40) * 2.5).alias("y0"),
        (F.col("o_totalprice") / 10000).alias("length_m"),
        structure(F.col("o_orderstatus")).alias("row_structure"),
        ((F.col("o_orderkey") % 71) / 100.0 + 0.3).alias("confidence"),
    )


def canopies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, block, vineyard_id and the box x0, y0, x1, y1 in whole centimetres, so that areas are exact."""
    i = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    x0, y0 = (F.col("l_partkey") % 512) * 50, (F.col("l_suppkey") % 40) * 250
    return i.join(s, F.col("l_suppkey") == F.col("s_suppkey")).select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"),
        F.col("s_nationkey").alias("block"),
        block_name(F.col("s_nationkey")).alias("vineyard_id"),
        x0.alias("x0"),
        y0.alias("y0"),
        (x0 + (F.col("l_quantity") * 5).cast("long")).alias("x1"),
        (y0 + 50 + F.round(F.col("l_discount") * 500).cast("long")).alias("y1"),
    )


def interrows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, block, vineyard_id, box in centimetres, veg_frac."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    x0, y0 = (F.col("p_partkey") % 512) * 50, (F.col("p_partkey") % 40) * 250
    return p.select(
        F.col("p_partkey").alias("id"),
        (F.col("p_partkey") % 25).cast("int").alias("block"),
        block_name(F.col("p_partkey") % 25).alias("vineyard_id"),
        x0.alias("x0"),
        y0.alias("y0"),
        (x0 + F.col("p_size") * 100).alias("x1"),
        (y0 + 200).alias("y1"),
        ((F.col("p_partkey") % 101) / 100.0).alias("veg_frac"),
    )


def spots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps and waste: id, kind, gap_m, x, y (metres), seen."""
    e = table(spark, sf_dir, "events").where(F.col("event_type").isin("error", "view"))
    return e.select(
        F.col("event_id").alias("id"),
        F.when(F.col("event_type") == "error", "inspection").otherwise("waste").alias("kind"),
        (F.col("value") / 10).alias("gap_m"),
        ((F.col("event_id") % 997) * 0.5).alias("x"),
        ((F.col("user_id") % 150) * 2.5).alias("y"),
        F.col("ts").alias("seen"),
    )


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, pos, v: occupancy profiles in long form."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.posexplode("embedding").alias("pos", "v")).withColumn("v", F.col("v").cast("double"))


def row_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, signal: the same profiles, an array a row."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("signal"))


LAYERS_SQL = """
blocks AS (SELECT concat('V', lpad(CAST(n_nationkey + 1 AS VARCHAR), 2, '0')) AS vineyard_id, (n_nationkey % 5) * 120e0 + n_regionkey * 7e0 AS x, (n_nationkey // 5) * 90e0 + n_regionkey * 3e0 AS y FROM nation),
row_pieces AS (SELECT o_orderkey AS piece, concat('V', lpad(CAST(c_nationkey + 1 AS VARCHAR), 2, '0')) AS vineyard_id,
  concat('V', lpad(CAST(c_nationkey + 1 AS VARCHAR), 2, '0'), '-R', lpad(CAST(o_custkey % 40 + 1 AS VARCHAR), 3, '0')) AS row_id,
  concat('r', lpad(CAST(o_orderkey % 18 AS VARCHAR), 3, '0'), '_c', lpad(CAST(o_custkey % 20 AS VARCHAR), 3, '0')) AS tile,
  o_orderkey % 18 AS tile_row, o_custkey % 20 AS tile_col, (o_orderkey % 512) * 0.5e0 AS x0, (o_custkey % 40) * 2.5e0 AS y0, o_totalprice / 10000 AS length_m,
  CASE o_orderstatus WHEN 'F' THEN 'regular' WHEN 'O' THEN 'disrupted' ELSE 'unassessable' END AS row_structure, (o_orderkey % 71) / 100e0 + 0.3e0 AS confidence
  FROM orders JOIN customer ON o_custkey = c_custkey),
canopies AS (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS id, s_nationkey AS block, concat('V', lpad(CAST(s_nationkey + 1 AS VARCHAR), 2, '0')) AS vineyard_id,
  (l_partkey % 512) * 50 AS x0, (l_suppkey % 40) * 250 AS y0, (l_partkey % 512) * 50 + CAST(trunc(l_quantity * 5) AS BIGINT) AS x1, (l_suppkey % 40) * 250 + 50 + CAST(round(l_discount * 500) AS BIGINT) AS y1
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
interrows AS (SELECT p_partkey AS id, CAST(p_partkey % 25 AS INTEGER) AS block, concat('V', lpad(CAST(p_partkey % 25 + 1 AS VARCHAR), 2, '0')) AS vineyard_id,
  (p_partkey % 512) * 50 AS x0, (p_partkey % 40) * 250 AS y0, (p_partkey % 512) * 50 + p_size * 100 AS x1, (p_partkey % 40) * 250 + 200 AS y1, (p_partkey % 101) / 100e0 AS veg_frac FROM part),
spots AS (SELECT event_id AS id, CASE WHEN event_type = 'error' THEN 'inspection' ELSE 'waste' END AS kind, value / 10 AS gap_m, (event_id % 997) * 0.5e0 AS x, (user_id % 150) * 2.5e0 AS y, ts AS seen
  FROM events WHERE event_type IN ('error', 'view')),
signals AS (SELECT vec_id AS id, CAST(p.pos - 1 AS INTEGER) AS pos, CAST(embedding[p.pos] AS DOUBLE) AS v FROM embeddings, (SELECT unnest(range(1, 65)) AS pos) AS p WHERE p.pos <= len(embedding))
"""

