"""One-dimensional signals along rows: thresholds, islands, smoothing, periods, peaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec


def along() -> WindowSpec:
    return Window.partitionBy("id").orderBy("pos")


def otsu(values: DataFrame, by: str, low: float = -0.2, high: float = 0.6, bins: int = 256) -> DataFrame:
    """`by`, threshold: the edge between bins with the greatest variance between classes; the mean of that bin's edges."""
    width = (high - low) / bins
    b = F.floor((F.col("v") - low) / width).cast("int")
    hist = values.where((F.col("v") >= low) & (F.col("v") < high)).groupBy(by, b.alias("bin")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    w = Window.partitionBy(by).orderBy("bin")
    every = Window.partitionBy(by)
    mid = low + (F.col("bin") + 0.5) * width
    run = hist.withColumns({"w0": F.sum("n").over(w), "m0": F.sum(F.col("n") * mid).over(w), "w": F.sum("n").over(every), "m": F.sum(F.col("n") * mid).over(every)})
    w1 = F.col("w") - F.col("w0")
    between = F.col("w0") * w1 * F.pow(F.col("m0") / F.col("w0") - (F.col("m") - F.col("m0")) / F.nullif(w1, F.lit(0.0)), F.lit(2.0))
    ranked = run.withColumn("between", F.round(F.coalesce(between, F.lit(0.0)), 6))
    best = ranked.groupBy(by).agg(F.max(F.struct("between", (-F.col("bin")).alias("b"))).alias("best"))
    return best.select(by, F.round(low + (-F.col("best.b") + 0.5) * width, 9).alias("threshold"))


def islands(flags: DataFrame) -> DataFrame:
    """id, start, stop, n: runs of positions with `on`, by the difference of two numberings."""
    n = F.row_number().over(along())
    k = F.row_number().over(Window.partitionBy("id", "on").orderBy("pos"))
    return flags.withColumn("g", n - k).where("on").groupBy("id", "g").agg(F.min("pos").alias("start"), F.max("pos").alias("stop"), F.count(F.lit(1)).alias("n")).drop("g")


def gap_totals(flags: DataFrame) -> DataFrame:
    """id, gaps, longest, total: runs of positions without `on`."""
    off = islands(flags.withColumn("on", ~F.col("on")))
    return flags.select("id").distinct().join(off.groupBy("id").agg(F.count(F.lit(1)).alias("gaps"), F.max("n").alias("longest"), F.sum("n").alias("total")), "id", "left").fillna(0)


def closing(flags: DataFrame, half: int) -> DataFrame:
    """Dilate, then erode, by `half` positions; beyond the ends counts as off, so borders erode."""
    near = along().rowsBetween(-half, half)
    v = flags.withColumn("d", F.max(F.col("on").cast("int")).over(near))
    whole = F.count(F.lit(1)).over(near) == 2 * half + 1
    return v.withColumn("closed", (F.min("d").over(near) == 1) & whole).drop("d")


def opening(flags: DataFrame, half: int) -> DataFrame:
    near = along().rowsBetween(-half, half)
    whole = F.count(F.lit(1)).over(near) == 2 * half + 1
    v = flags.withColumn("e", F.when((F.min(F.col("on").cast("int")).over(near) == 1) & whole, 1).otherwise(0))
    return v.withColumn("opened", F.max("e").over(near) == 1).drop("e")


def smoothed(values: DataFrame, half: int) -> DataFrame:
    """Rolling mean and median over 2 half + 1 positions, fewer at the ends."""
    near = along().rowsBetween(-half, half)
    middle = F.array_sort(F.collect_list("v").over(near))
    n = F.size("_near")
    lower, upper = F.get("_near", F.floor((n - 1) / 2).cast("int")), F.get("_near", F.floor(n / 2).cast("int"))
    return values.withColumns({"mean": F.avg("v").over(near), "_near": middle}).withColumn("median", (lower + upper) / 2).drop("_near")


def gaussian(signal: Column, sigma: float, reach: int) -> Column:
    """An array smoothed by a Gaussian kernel, mirrored at the ends."""
    n = F.size(signal)

    def at(i: Column) -> Column:
        folded = F.pmod(i, 2 * n)
        return F.get(signal, F.when(folded < n, folded).otherwise(2 * n - 1 - folded))

    from math import exp

    weights = [exp(-0.5 * (k / sigma) ** 2) for k in range(-reach, reach + 1)]
    total = sum(weights)
    return F.transform(signal, lambda _, i: sum((at(i + k - reach) * (w / total) for k, w in enumerate(weights)), F.lit(0.0)))


def autocorrelation(signals: DataFrame, low: int, high: int) -> DataFrame:
    """id, period, quality: the lag in [low, high) with the highest autocorrelation, and its share of that at lag 0."""
    s = signals.withColumn("m", F.aggregate("signal", F.lit(0.0), lambda a, x: a + x) / F.size("signal")).withColumn("c", F.transform("signal", lambda x: x - F.col("m")))
    n = F.size("c")
    ac = lambda k: F.aggregate(F.zip_with(F.slice("c", 1, n - k), F.slice("c", k + 1, n - k), lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    lags = F.transform(F.sequence(F.lit(low), F.lit(high - 1)), lambda k: F.struct(F.round(ac(k), 9).alias("ac"), (-k).alias("k")))
    best = s.withColumn("best", F.array_max(lags)).withColumn("zero", ac(F.lit(0)))
    return best.select("id", (-F.col("best.k")).alias("period"), F.round(F.try_divide(F.col("best.ac"), F.col("zero")), 6).alias("quality"))


def peaks(values: DataFrame, height: float) -> DataFrame:
    """id, pos, v, shift: strict local maxima of at least `height`, refined by a parabola."""
    from rowfield.functions.scalars import parabolic_peak

    v = values.withColumns({"before": F.lag("v").over(along()), "after": F.lead("v").over(along())})
    return v.where("v > before AND v > after").where(F.col("v") >= height).withColumn("shift", parabolic_peak(F.col("before"), F.col("v"), F.col("after"))).drop("before", "after")


def spaced_peaks(candidates: DataFrame, distance: int) -> DataFrame:
    """The peaks that remain when, taller first, those within `distance` of a taller kept one go. Kept in order within a
    signal by a fold over its own (bounded) peaks."""
    order = F.array_sort(F.collect_list(F.struct((-F.col("v")).alias("h"), "pos")))
    kept = F.aggregate(
        order,
        F.array().cast("array<int>"),
        lambda acc, p: F.when(F.exists(acc, lambda q: F.abs(q - p["pos"]) < distance), acc).otherwise(F.concat(acc, F.array(p["pos"].cast("int")))),
    )
    return candidates.groupBy("id").agg(F.array_sort(kept).alias("kept")).select("id", F.explode("kept").alias("pos"))


def direction_peaks(axes: DataFrame, by: str, bins: int = 18, share: float = 0.15) -> DataFrame:
    """`by`, bin, weight: circular local maxima of a weighted histogram of axes (angle_deg, weight) above a share of the
    highest."""
    b = F.floor(F.pmod(F.col("angle_deg"), F.lit(180.0)) / (180.0 / bins)).cast("int")
    sums = axes.groupBy(by, b.alias("bin")).agg(F.round(F.sum("weight"), 6).alias("weight"))
    full = sums.select(by).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1)))).join(sums, [by, "bin"], "left").fillna(0.0, ["weight"])
    w = Window.partitionBy(by).orderBy("bin")
    ends = Window.partitionBy(by).orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    near = full.withColumns({"l": F.coalesce(F.lag("weight").over(w), F.last("weight").over(ends)), "r": F.coalesce(F.lead("weight").over(w), F.first("weight").over(ends)), "top": F.max("weight").over(Window.partitionBy(by))})
    return near.where((F.col("weight") > F.col("l")) & (F.col("weight") >= F.col("r")) & (F.col("weight") > share * F.col("top"))).select(by, "bin", "weight")


def dominant_angle(angles: DataFrame, by: str, near: float = 5.0) -> DataFrame:
    """`by`, angle: the mode of a histogram of one degree, then the mean of the angles within `near` degrees of it."""
    mode = angles.groupBy(by, F.floor("angle_deg").alias("bin")).count().groupBy(by).agg(F.max_by("bin", F.struct("count", -F.col("bin"))).alias("mode"))
    return angles.join(mode, by).where(F.abs(F.col("angle_deg") - F.col("mode")) <= near).groupBy(by).agg(F.round(F.avg("angle_deg"), 6).alias("angle"))


def simple_pieces(runs: DataFrame, size: int = 48, least: int = 4) -> DataFrame:
    """Runs (id, start, stop) cut into equal pieces of about `size`; pieces shorter than `least` go."""
    n = F.col("stop") - F.col("start") + 1
    many = F.greatest(F.rint(n / size), F.lit(1.0)).cast("int")
    cut = runs.withColumns({"n": n, "many": many}).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("many") - 1)))
    at = lambda k: F.col("start") + F.floor(F.col("n") * k / F.col("many"))
    return cut.select("id", at(F.col("k")).alias("start"), (at(F.col("k") + 1) - 1).alias("stop")).where(F.col("stop") - F.col("start") + 1 >= least)
