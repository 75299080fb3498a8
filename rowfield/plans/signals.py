"""Registered queries: one-dimensional signals and windows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from rowfield.operators.numbering import padded
from rowfield.plans.common import scratch
from rowfield.operators import signals as Z
from rowfield.sources import driver


def _flags(spark, sf_dir):
    return driver.signals(spark, sf_dir).select("id", "pos", (F.col("v") > 0).alias("on"))


def otsu(spark, sf_dir):
    s = driver.signals(spark, sf_dir)
    return Z.otsu(s.select((F.col("id") % 20).alias("part"), "v"), "part")


def islands(spark, sf_dir):
    return Z.islands(_flags(spark, sf_dir))


def gap_totals(spark, sf_dir):
    return Z.gap_totals(_flags(spark, sf_dir))


def closing(spark, sf_dir):
    c = Z.closing(_flags(spark, sf_dir), 2)
    o = Z.opening(_flags(spark, sf_dir), 1)
    a = c.groupBy("id").agg(F.count_if("closed").alias("closed"), F.sum(F.when(F.col("closed"), F.col("pos")).otherwise(0)).alias("closed_at"))
    return a.join(o.groupBy("id").agg(F.count_if("opened").alias("opened")), "id")


def smoothing(spark, sf_dir):
    s = Z.smoothed(driver.signals(spark, sf_dir), 2)
    return s.select("id", "pos", F.round("mean", 6).alias("mean"), F.round("median", 6).alias("median"))


def gaussian(spark, sf_dir):
    s = driver.row_signals(spark, sf_dir).select("id", F.posexplode(Z.gaussian(F.col("signal"), 1.5, 3)).alias("pos", "v"))
    return s.select("id", "pos", F.round("v", 6).alias("v"))


def autocorrelation(spark, sf_dir):
    return Z.autocorrelation(driver.row_signals(spark, sf_dir), 4, 24)


def peaks(spark, sf_dir):
    p = Z.peaks(driver.signals(spark, sf_dir), 0.05)
    return p.select("id", "pos", F.round("v", 6).alias("v"), F.round("shift", 5).alias("shift"))


def spaced_peaks(spark, sf_dir):
    return Z.spaced_peaks(Z.peaks(driver.signals(spark, sf_dir), 0.05), 4)


def direction_peaks(spark, sf_dir):
    p = driver.row_pieces(spark, sf_dir).select("vineyard_id", ((F.col("piece") % 11) * 3.0 + (F.col("piece") % 3) * 61.0).alias("angle_deg"), F.round("length_m", 2).alias("weight"))
    return Z.direction_peaks(p, "vineyard_id")


def dominant_angle(spark, sf_dir):
    p = driver.row_pieces(spark, sf_dir).select("vineyard_id", ((F.col("piece") * F.col("piece") % 179) + (F.col("piece") % 10) / 10.0).alias("angle_deg"))
    return Z.dominant_angle(p, "vineyard_id")


def canopy_pieces(spark, sf_dir):
    runs = Z.islands(driver.signals(spark, sf_dir).withColumn("on", F.col("v") > -0.1))
    return Z.simple_pieces(runs, 6, 2)


def strip_bands(spark, sf_dir):
    """Rectangles between neighbouring bands that overlap in x."""
    s = driver.interrows(spark, sf_dir).groupBy("block", F.col("y0").alias("y")).agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    w = Window.partitionBy("block").orderBy("y")
    n = s.withColumns({"ny": F.lead("y").over(w), "n0": F.lead("x0").over(w), "n1": F.lead("x1").over(w)})
    left, right = F.greatest("x0", "n0"), F.least("x1", "n1")
    return n.where((right - left >= 20) & (F.col("ny") - F.col("y1") >= 5)).select("block", left.alias("left"), right.alias("right"), F.col("y1").alias("bottom"), F.col("ny").alias("top"))


def cumulative(spark, sf_dir):
    """Running metres and steps within a user's walk, and the heading carried over."""
    s = driver.spots(spark, sf_dir)
    w = Window.partitionBy("walk").orderBy("id")
    d = s.select((F.col("id") % 37).alias("walk"), "id", "x", "y").withColumn("step", F.coalesce(F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)), F.lit(0.0)))
    return d.select("walk", "id", F.round("step", 4).alias("step"), F.round(F.sum("step").over(w), 3).alias("walked"), F.round(2 * F.lag("x", 1, 0.0).over(w) - F.lag("x", 2, 0.0).over(w), 4).alias("ahead"))


def sessions(spark, sf_dir):
    """Offsets of a block's pieces fall into rows where they step by more than a share of the spacing."""
    from rowfield.operators.stitch import numbered_rows

    p = driver.row_pieces(spark, sf_dir).select("piece", "vineyard_id", (F.col("y0") + (F.col("piece") % 7) * 0.2).alias("offset"), F.lit(2.5).alias("spacing"))
    return numbered_rows(p).groupBy("vineyard_id", "row_no").agg(F.count(F.lit(1)).alias("pieces"), F.round(F.min("offset"), 4).alias("low"), F.round(F.max("offset"), 4).alias("high"))


def block_numbers(spark, sf_dir):
    from rowfield.operators.stitch import numbered_blocks

    b = driver.blocks(spark, sf_dir)
    return numbered_blocks(b.select(F.col("vineyard_id").alias("id"), "x", "y"), scratch(spark, "blocks")).select("id", "vineyard_id")


def row_numbers(spark, sf_dir):
    """Rows of a block by rising offset; ids with leading zeros."""
    r = driver.row_pieces(spark, sf_dir).groupBy("vineyard_id", "row_id").agg(F.min("y0").alias("offset"))
    n = F.row_number().over(Window.partitionBy("vineyard_id").orderBy("offset", "row_id"))
    return r.select("row_id", F.concat("vineyard_id", F.lit("-R"), padded(n, 3)).alias("number"))


def occupancy(spark, sf_dir):
    """Mean occupancy by place along the row, over bands of rows."""
    s = driver.signals(spark, sf_dir).groupBy((F.col("id") % 9).alias("band"), "pos").agg(F.round(F.avg((F.col("v") > 0).cast("double")), 6).alias("occupied"), F.round(F.avg("v"), 6).alias("mean"))
    return s


_F = "f AS (SELECT id, pos, v > 0 AS o FROM signals)"
_RUNS = "WITH f AS (SELECT id, pos, {c} AS o FROM signals), g AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pos) - row_number() OVER (PARTITION BY id, o ORDER BY pos) AS g FROM f), r AS (SELECT id, min(pos) AS start, max(pos) AS stop, count(*) AS n FROM g WHERE {w} GROUP BY id, g)"
_PEAKS = "p AS (SELECT id, pos, v, lag(v) OVER w AS b, lead(v) OVER w AS a FROM signals WINDOW w AS (PARTITION BY id ORDER BY pos)), k AS (SELECT * FROM p WHERE v > b AND v > a AND v >= 0.05)"
QUERIES = {
    "otsu_threshold": (otsu, """
WITH h AS (SELECT id % 20 AS part, CAST(floor((v + 0.2e0) / 0.003125e0) AS INTEGER) AS bin, CAST(count(*) AS DOUBLE) AS n FROM signals WHERE v >= -0.2 AND v < 0.6 GROUP BY 1, 2),
r AS (SELECT part, bin, sum(n) OVER w AS w0, sum(n * (-0.2e0 + (bin + 0.5e0) * 0.003125e0)) OVER w AS m0, sum(n) OVER (PARTITION BY part) AS w, sum(n * (-0.2e0 + (bin + 0.5e0) * 0.003125e0)) OVER (PARTITION BY part) AS m FROM h WINDOW w AS (PARTITION BY part ORDER BY bin)),
b AS (SELECT part, bin, round(coalesce(w0 * (w - w0) * pow(m0 / w0 - (m - m0) / nullif(w - w0, 0), 2), 0), 6) AS between_ FROM r)
SELECT part, round(-0.2e0 + (-(max({'b': between_, 'n': -bin})).n + 0.5e0) * 0.003125e0, 9) AS threshold FROM b GROUP BY 1"""),
    "signal_islands": (islands, _RUNS.format(c="v > 0", w="o") + " SELECT * FROM r"),
    "gap_totals": (gap_totals, _RUNS.format(c="v > 0", w="NOT o") + " SELECT s.id, count(r.n) AS gaps, coalesce(max(r.n), 0) AS longest, CAST(coalesce(sum(r.n), 0) AS BIGINT) AS total FROM (SELECT DISTINCT id FROM signals) s LEFT JOIN r ON s.id = r.id GROUP BY 1"),
    "signal_closing": (closing, f"""
WITH {_F}, d AS (SELECT id, pos, max(CAST(o AS INTEGER)) OVER w AS d, min(CAST(o AS INTEGER)) OVER x AS e, count(*) OVER x AS k FROM f WINDOW w AS (PARTITION BY id ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), x AS (PARTITION BY id ORDER BY pos ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)),
c AS (SELECT id, pos, min(d) OVER w = 1 AND count(*) OVER w = 5 AS closed, max(CASE WHEN e = 1 AND k = 3 THEN 1 ELSE 0 END) OVER x = 1 AS opened FROM d WINDOW w AS (PARTITION BY id ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), x AS (PARTITION BY id ORDER BY pos ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING))
SELECT id, count(*) FILTER (closed) AS closed, CAST(sum(CASE WHEN closed THEN pos ELSE 0 END) AS BIGINT) AS closed_at, count(*) FILTER (opened) AS opened FROM c GROUP BY 1"""),
    "signal_smoothing": (smoothing, "SELECT id, pos, round(avg(v) OVER w, 6) AS mean, round(median(v) OVER w, 6) AS median FROM signals WINDOW w AS (PARTITION BY id ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)"),
    "signal_gaussian": (gaussian, """
WITH k AS (SELECT k, exp(-0.5e0 * pow(k / 1.5e0, 2)) AS w FROM (SELECT unnest(range(-3, 4)) AS k)),
g AS (SELECT a.id, a.pos, w, CASE WHEN a.pos + k < 0 THEN -1 - (a.pos + k) WHEN a.pos + k > 63 THEN 127 - (a.pos + k) ELSE a.pos + k END AS q FROM signals a, k)
SELECT g.id, g.pos, round(sum(w * v) / sum(w), 6) AS v FROM g JOIN signals s ON s.id = g.id AND s.pos = g.q GROUP BY 1, 2"""),
    "autocorrelation": (autocorrelation, """
WITH c AS (SELECT id, pos, v - avg(v) OVER (PARTITION BY id) AS c FROM signals), l AS (SELECT a.id, b.pos - a.pos AS k, sum(a.c * b.c) AS ac FROM c a JOIN c b ON a.id = b.id AND (b.pos - a.pos = 0 OR b.pos - a.pos BETWEEN 4 AND 23) GROUP BY 1, 2),
b AS (SELECT id, max({'ac': round(ac, 9), 'k': -k}) FILTER (k > 0) AS best, max(ac) FILTER (k = 0) AS zero FROM l GROUP BY 1)
SELECT id, CAST(-best.k AS INTEGER) AS period, round(best.ac / nullif(zero, 0), 6) AS quality FROM b"""),
    "signal_peaks": (peaks, f"WITH {_PEAKS} SELECT id, pos, round(v, 6) AS v, round(CASE WHEN b - 2 * v + a <> 0 THEN greatest(-0.5e0, least(0.5e0, 0.5e0 * (b - a) / (b - 2 * v + a))) ELSE 0 END, 5) AS shift FROM k"),
    "spaced_peaks": (spaced_peaks, None),
    "direction_peaks": (direction_peaks, """
WITH h AS (SELECT vineyard_id, CAST(floor(fmod((piece % 11) * 3e0 + (piece % 3) * 61e0, 180) / 10) AS INTEGER) AS bin, round(sum(round(length_m, 2)), 6) AS weight FROM row_pieces GROUP BY 1, 2),
g AS (SELECT v.vineyard_id, CAST(b AS INTEGER) AS bin, coalesce(weight, 0) AS weight FROM (SELECT DISTINCT vineyard_id FROM h) v CROSS JOIN (SELECT unnest(range(18)) AS b) LEFT JOIN h ON h.vineyard_id = v.vineyard_id AND h.bin = b),
n AS (SELECT a.*, l.weight AS l, r.weight AS r, max(a.weight) OVER (PARTITION BY a.vineyard_id) AS top FROM g a JOIN g l ON a.vineyard_id = l.vineyard_id AND l.bin = (a.bin + 17) % 18 JOIN g r ON a.vineyard_id = r.vineyard_id AND r.bin = (a.bin + 1) % 18)
SELECT vineyard_id, bin, weight FROM n WHERE weight > l AND weight >= r AND weight > 0.15 * top"""),
    "dominant_angle": (dominant_angle, """
WITH a AS (SELECT vineyard_id, (piece * piece % 179) + (piece % 10) / 10e0 AS a FROM row_pieces), m AS (SELECT vineyard_id, floor(a) AS bin, count(*) AS n FROM a GROUP BY 1, 2), t AS (SELECT vineyard_id, -(max({'n': n, 'b': -bin})).b AS mode FROM m GROUP BY 1)
SELECT a.vineyard_id, round(avg(a), 6) AS angle FROM a JOIN t ON a.vineyard_id = t.vineyard_id WHERE abs(a - mode) <= 5 GROUP BY 1"""),
    "canopy_pieces": (canopy_pieces, _RUNS.format(c="v > -0.1", w="o") + """, m AS (SELECT id, start, stop - start + 1 AS n, CAST(greatest(round_even((stop - start + 1) / 6e0, 0), 1) AS BIGINT) AS many FROM r), p AS (SELECT id, start + n * k // many AS start, start + n * (k + 1) // many - 1 AS stop FROM m, (SELECT unnest(range(64)) AS k) WHERE k < many) SELECT id, start, stop FROM p WHERE stop - start + 1 >= 2"""),
    "strip_bands": (strip_bands, """
WITH s AS (SELECT block, y0 AS y, min(x0) AS x0, max(x1) AS x1, max(y1) AS y1 FROM interrows GROUP BY 1, 2), n AS (SELECT *, lead(y) OVER w AS ny, lead(x0) OVER w AS n0, lead(x1) OVER w AS n1 FROM s WINDOW w AS (PARTITION BY block ORDER BY y))
SELECT block, greatest(x0, n0) AS "left", least(x1, n1) AS "right", y1 AS bottom, ny AS top FROM n WHERE least(x1, n1) - greatest(x0, n0) >= 20 AND ny - y1 >= 5"""),
    "cumulative_metres": (cumulative, """
WITH s AS (SELECT id % 37 AS walk, id, coalesce(sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)), 0) AS step, 2 * lag(x, 1, 0e0) OVER w - lag(x, 2, 0e0) OVER w AS ahead FROM spots WINDOW w AS (PARTITION BY id % 37 ORDER BY id))
SELECT walk, id, round(step, 4) AS step, round(sum(step) OVER (PARTITION BY walk ORDER BY id), 3) AS walked, round(ahead, 4) AS ahead FROM s"""),
    "offset_sessions": (sessions, """
WITH o AS (SELECT piece, vineyard_id, y0 + (piece % 7) * 0.2e0 AS o FROM row_pieces), n AS (SELECT *, CASE WHEN coalesce(o - lag(o) OVER w > 0.4e0 * 2.5e0, true) THEN 1 ELSE 0 END AS new_ FROM o WINDOW w AS (PARTITION BY vineyard_id ORDER BY o, piece)),
r AS (SELECT *, CAST(sum(new_) OVER (PARTITION BY vineyard_id ORDER BY o, piece) AS BIGINT) AS row_no FROM n) SELECT vineyard_id, row_no, count(*) AS pieces, round(min(o), 4) AS low, round(max(o), 4) AS high FROM r GROUP BY 1, 2"""),
    "block_numbers": (block_numbers, "SELECT vineyard_id AS id, concat('V', lpad(n, CAST(greatest(2, length(n)) AS INTEGER), '0')) AS vineyard_id FROM (SELECT vineyard_id, CAST(row_number() OVER (ORDER BY -round_even(y / 25, 0), x, vineyard_id) AS VARCHAR) AS n FROM blocks)"),
    "row_numbers": (row_numbers, "SELECT row_id, concat(vineyard_id, '-R', lpad(n, CAST(greatest(3, length(n)) AS INTEGER), '0')) AS number FROM (SELECT *, CAST(row_number() OVER (PARTITION BY vineyard_id ORDER BY o, row_id) AS VARCHAR) AS n FROM (SELECT vineyard_id, row_id, min(y0) AS o FROM row_pieces GROUP BY 1, 2))"),
    "band_occupancy": (occupancy, "SELECT id % 9 AS band, pos, round(avg(CASE WHEN v > 0 THEN 1e0 ELSE 0e0 END), 6) AS occupied, round(avg(v), 6) AS mean FROM signals GROUP BY 1, 2"),
}
