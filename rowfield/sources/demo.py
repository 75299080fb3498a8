"""A small demonstration block with known measurements, built from its dimensions, and its walking network."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowfield.functions import geometry as G

# The block's dimensions in metres, its stops and its walking network.
WIDTH, HEIGHT, ROW_Y = 18.0, 40.0, (5.0, 35.0)
ROW_X = (3.0, 8.0, 13.0, 17.0)
CANOPY = {"across": 1.45, "along": 2.4, "step": 3.0, "first": 6.6, "per_row": 10}
STRIP_WIDTH = 2.5
WASTE_BOX = (14.4, 7.4, 15.6, 8.6)
NETWORK = "start bh_mid, bh0 bh_p1, bh_p1 bh_mid, bh_mid bh_p2, bh_p2 bh_p3, bh_p3 bh1, th0 th_p1, th_p1 th_p2, th_p2 th_p3, th_p3 th1, bh0 th0, bh1 th1, bh_p1 T01, T01 th_p1, bh_p2 T02, T02 th_p2, bh_p3 W01, W01 th_p3"
PLACES = {"start": (9, -5), "bh0": (0, 5), "bh_p1": (5.5, 5), "bh_mid": (9, 5), "bh_p2": (10.5, 5), "bh_p3": (15, 5), "bh1": (18, 5), "th0": (0, 35), "th_p1": (5.5, 35), "th_p2": (10.5, 35), "th_p3": (15, 35), "th1": (18, 35), "T01": (5.5, 20), "T02": (10.5, 30), "W01": (15, 8)}
STOPS = ("T01", "T02", "W01")


def rows(spark: SparkSession) -> DataFrame:
    xs = F.explode(F.array(*map(F.lit, ROW_X))).alias("x")
    return spark.range(1).select(xs).select("x", F.array(G.point(F.col("x"), F.lit(ROW_Y[0])), G.point(F.col("x"), F.lit(ROW_Y[1]))).alias("line"))


def canopies(spark: SparkSession) -> DataFrame:
    c = CANOPY
    at = rows(spark).select("x", F.explode(F.sequence(F.lit(0), F.lit(c["per_row"] - 1))).alias("k")).select("x", (F.col("k") * c["step"] + c["first"]).alias("y"))
    half_x, half_y = c["across"] / 2, c["along"] / 2
    return at.select(G.box_ring(F.col("x") - half_x, F.col("y") - half_y, F.col("x") + half_x, F.col("y") + half_y).alias("ring"))


def strips(spark: SparkSession) -> DataFrame:
    middles = F.explode(F.array(*[F.lit((a + b) / 2) for a, b in zip(ROW_X, ROW_X[1:], strict=False)])).alias("x")
    half = STRIP_WIDTH / 2
    return spark.range(1).select(middles).select(G.box_ring(F.col("x") - half, F.lit(ROW_Y[0]), F.col("x") + half, F.lit(ROW_Y[1])).alias("ring"))


def places(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in PLACES.items()], "place string, x double, y double")


def paths(spark: SparkSession) -> DataFrame:
    """a, b, metres, in both directions."""
    pairs = [tuple(p.split()) for p in NETWORK.split(", ")]
    one = spark.createDataFrame(pairs, "a string, b string")
    both = one.union(one.select("b", "a"))
    p = places(spark)
    a, b = p.select(F.col("place").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay")), p.select(F.col("place").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"))
    return both.join(F.broadcast(a), "a").join(F.broadcast(b), "b").select("a", "b", F.hypot(F.col("ax") - F.col("bx"), F.col("ay") - F.col("by")).alias("metres"))


def metrics(spark: SparkSession) -> DataFrame:
    count = F.count(F.lit(1))
    r = rows(spark).agg(count.alias("row_count"), F.round(F.sum(G.length(F.col("line"))), 4).alias("row_length_m"))
    c = canopies(spark).agg(count.alias("canopy_count"), F.round(F.sum(G.area(F.col("ring"))), 4).alias("canopy_area_m2"))
    s = strips(spark).agg(count.alias("interrow_count"), F.round(F.sum(G.area(F.col("ring"))), 4).alias("interrow_area_m2"))
    extent = G.area(G.box_ring(F.lit(0.0), F.lit(0.0), F.lit(WIDTH), F.lit(HEIGHT)))
    return r.join(c, F.lit(True), "left").join(s, F.lit(True), "left").select("row_count", "canopy_count", "interrow_count", "canopy_area_m2", "interrow_area_m2", extent.alias("extent_m2"), "row_length_m").withColumns({c: F.col(c).cast("int") for c in ("row_count", "canopy_count", "interrow_count")})


def stop_distances(spark: SparkSession, rounds: int = 15) -> DataFrame:
    """Shortest metres from the start and each stop to each other place, by relaxation over the (small) network."""
    p = paths(spark).withColumnRenamed("metres", "w")
    now = [(s, s, 0.0) for s in ("start", *STOPS)]
    for _ in range(rounds):
        df = spark.createDataFrame(now, "source string, place string, metres double")
        step = df.join(F.broadcast(p), F.col("place") == F.col("a")).select("source", F.col("b").alias("place"), (F.col("metres") + F.col("w")).alias("metres"))
        # a row for each of 4 sources and 15 places at most
        new = sorted(tuple(r) for r in df.union(step).groupBy("source", "place").agg(F.min("metres").alias("metres")).collect())
        if new == sorted(now):
            break
        now = new
    return spark.createDataFrame(now, "source string, place string, metres double")


def tour(spark: SparkSession) -> DataFrame:
    """The exact closed tour over the stops, and what it saves against separate trips."""
    import numpy as np

    from rowfield.operators.routing import exact_tour

    names = ["start", *STOPS]
    d = {(r["source"], r["place"]): r["metres"] for r in stop_distances(spark).collect()}
    order, metres = exact_tour(np.array([[d[a, b] for b in names] for a in names]))
    separate = 2 * sum(d["start", s] for s in STOPS)
    row = (",".join(names[i] for i in order[1:-1]), metres, separate, separate - metres, 100 * (separate - metres) / separate)
    return spark.createDataFrame([row], "stops string, tour_m double, separate_m double, saved_m double, reduction_pct double")
