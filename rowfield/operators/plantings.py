"""Plantings and lanes: which blocks belong together or lie over each other, centre lines of strips, turns between lanes,
where a track goes on, rows by a search term, lines of a log from an offset.

Defined cases: boxes and points with a null coordinate meet nothing and stay alone; ties go to the smaller id; empty
tables give empty results; ids are unique.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowfield.functions import geometry as G
from rowfield.operators import spatial

# Merging and overlap rules, lane trim, how far a turn swings past a lane's end.
MERGE_M, TOUCH_M, TOUCH_RADIUS_M, OVERLAP_SHARE = 5.0, 0.01, 0.5, 0.3
LANE_TRIM_M, TURN_OUT_M = 0.3, 1.2
# Pairs of blocks of a cell that are gone through as they are.
PAIRS = 2_000_000


def planting_links(blocks: DataFrame, passages: DataFrame, most: float = MERGE_M) -> DataFrame:
    """a, b (a < b): blocks (id, region, box) of different regions less than `most` apart whose shortest link meets no
    passage (box). Where sides face each other the link is in the middle of what they share; of touching blocks the
    ground within half a metre of it counts."""
    pairs = spatial.overlapping(blocks, blocks, spatial.usual_cell(blocks, most), most).where((F.col("l.id") < F.col("r.id")) & ~F.col("l.region").eqNullSafe(F.col("r.region")))
    ends = G.box_link(F.col("l"), F.col("r"))
    linked = pairs.select(F.col("l.id").alias("a"), F.col("r.id").alias("b"), ends.alias("k")).select("a", "b", "k.*")
    dx, dy = F.col("u") - F.col("x"), F.col("v") - F.col("y")
    linked = linked.withColumn("d", F.sqrt(dx * dx + dy * dy)).where(F.col("d") < most)
    linked = linked.withColumn("xmin", F.least("x", "u")).withColumn("xmax", F.greatest("x", "u")).withColumn("ymin", F.least("y", "v")).withColumn("ymax", F.greatest("y", "v"))
    near = spatial.overlapping(linked, passages, spatial.usual_cell(passages, most), TOUCH_RADIUS_M)
    p = F.col("r")
    gap = lambda at, low, high: F.greatest(F.lit(0.0), low - at, at - high)
    gx, gy = gap(F.col("l.x"), p["xmin"], p["xmax"]), gap(F.col("l.y"), p["ymin"], p["ymax"])
    touching = F.sqrt(gx * gx + gy * gy) <= TOUCH_RADIUS_M
    crossing = G.segment_meets_box(F.col("l.x"), F.col("l.y"), F.col("l.u"), F.col("l.v"), p)
    cut = near.where(F.when(F.col("l.d") > TOUCH_M, crossing).otherwise(touching)).select("l.a", "l.b").distinct()
    return linked.select("a", "b").join(cut, ["a", "b"], "left_anti")


def kept_blocks(blocks: DataFrame, folder: str, share: float = OVERLAP_SHARE, pairs: int = PAIRS, each: int = 8) -> DataFrame:
    """The blocks (id, length, box) that stay when, from the longest to the shortest, each one goes that shares more than
    `share` of the smaller area with one that stays.

    Of equal boxes that share enough of themselves only the first can stay. The others go in rounds, each of them written.
    While cells hold more than `pairs` pairs of blocks, and more than `each` a block, the blocks that are first in all of their
    cells stay, at most one a cell, and what they cover goes. Then of the overlaps still open, blocks without a longer
    partner stay and their partners go. A block is decided as soon as all longer partners are, so the result is that of
    going through them one by one.
    """
    spark = blocks.sparkSession
    kind = blocks.schema["id"].dataType.simpleString()
    box = ["xmin", "ymin", "xmax", "ymax"]
    size = spatial.usual_cells(blocks)
    area = lambda s: (F.col(f"{s}.xmax") - F.col(f"{s}.xmin")) * (F.col(f"{s}.ymax") - F.col(f"{s}.ymin"))
    side = lambda low, high: F.least(F.col(f"l.{high}"), F.col(f"r.{high}")) - F.greatest(F.col(f"l.{low}"), F.col(f"r.{low}"))
    much = side("xmin", "xmax") * side("ymin", "ymax") > share * F.least(area("l"), area("r"))
    # from the longest (NaN is more than any number) to the shortest, then by id; blocks without a length, id or corner meet nothing
    rank = F.struct((~F.isnan(F.col("length").cast("double"))).alias("a"), (-F.col("length")).alias("b"), F.col("id").alias("c"))
    whole = blocks.where(" AND ".join(f"{c} IS NOT NULL" for c in ["id", "length", *box])).select("id", *box, rank.alias("rank"))
    own = (F.col("xmax") - F.col("xmin")) * (F.col("ymax") - F.col("ymin")) * (1 - share)
    covers = (F.col("xmax") >= F.col("xmin")) & (F.col("ymax") >= F.col("ymin")) & (own > 0) & (own < float("inf"))  # not NaN
    firsts = whole.where(covers).groupBy(*box).agg(F.min("rank").alias("rank")).select(F.col("rank.c").alias("id"), *box, "rank")
    left = _written(firsts.unionByName(whole.where(~covers)), f"{folder}/left-0")
    _written(spark.createDataFrame([], f"id {kind}"), f"{folder}/stay")
    n = 0
    while True:
        cells = spatial.with_cells(left, size)
        counts = cells.groupBy("cx", "cy").agg(F.count(F.lit(1)).cast("double").alias("n")).agg(F.sum("n").alias("rows"), F.sum(F.expr("n * (n - 1) / 2")).alias("pairs")).first()
        if (counts["pairs"] or 0) <= max(pairs, each * (counts["rows"] or 0)):
            break
        # the first of each cell, and of these those that are first in all of their cells
        tops = cells.groupBy("cx", "cy").agg(F.min("rank").alias("top"))
        first = spatial.with_cells(left, size).join(tops, ["cx", "cy"]).groupBy("id").agg(F.bool_and(F.col("rank") == F.col("top")).alias("all")).where("all").select("id")
        stay = _written(left.join(first, "id", "left_semi"), f"{folder}/stay-{n}")
        stay.select("id").write.mode("append").parquet(f"{folder}/stay")
        rest = left.join(stay.select("id"), "id", "left_anti")
        gone = spatial.overlapping(stay, rest, size).where(much).select(F.col("r.id").alias("id")).distinct()
        n += 1
        left = _written(rest.join(gone, "id", "left_anti"), f"{folder}/left-{n}")
    met = spatial.overlapping(left, left, size).where((F.col("l.rank") < F.col("r.rank")) & much)
    open_ = _written(met.select(F.col("l.id").alias("hi"), F.col("r.id").alias("lo")), f"{folder}/open-0")
    _written(spark.createDataFrame([], f"id {kind}"), f"{folder}/gone")
    n = 0
    while not open_.isEmpty():
        tops = open_.select("hi").distinct().join(open_.select(F.col("lo").alias("hi")).distinct(), "hi", "left_anti")
        gone = _written(open_.join(tops, "hi", "left_semi").select(F.col("lo").alias("id")).distinct(), f"{folder}/gone-{n}")
        gone.write.mode("append").parquet(f"{folder}/gone")
        after = open_.join(gone.select(F.col("id").alias("lo")), "lo", "left_anti").join(gone.select(F.col("id").alias("hi")), "hi", "left_anti")
        n += 1
        open_ = _written(after.select("hi", "lo"), f"{folder}/open-{n}")
    read = lambda name: spark.read.schema(f"id {kind}").parquet(f"{folder}/{name}")
    stays = left.select("id").join(read("gone"), "id", "left_anti").unionByName(read("stay"))
    alone = blocks.where(" OR ".join(f"{c} IS NULL" for c in ["id", "length", *box]))
    return blocks.join(stays, "id", "left_semi").unionByName(alone)


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def lane_of(ring: Column) -> Column:
    """The centre line of a four-cornered strip in any direction, from its first short side to the other one, trimmed at
    both ends; null for a strip too short to walk."""

    def line(ring: Column) -> Column:
        span = lambda i, j: F.hypot(ring[j]["x"] - ring[i]["x"], ring[j]["y"] - ring[i]["y"])
        middle = lambda i, j: G.point((ring[i]["x"] + ring[j]["x"]) / 2, (ring[i]["y"] + ring[j]["y"]) / 2)
        return F.when(span(0, 1) <= span(1, 2), F.array(middle(0, 1), middle(2, 3))).otherwise(F.array(middle(1, 2), middle(3, 0)))

    def trimmed(axis: Column) -> Column:
        on = lambda share: G.point(axis[0]["x"] + share * (axis[1]["x"] - axis[0]["x"]), axis[0]["y"] + share * (axis[1]["y"] - axis[0]["y"]))
        long = F.hypot(axis[1]["x"] - axis[0]["x"], axis[1]["y"] - axis[0]["y"])
        cut = F.when(long >= 2 * LANE_TRIM_M + 1, LANE_TRIM_M / long)
        return G.named(cut, lambda t: F.when(t.isNotNull(), F.array(on(t), on(1 - t))))

    return G.named(G.named(ring, line), trimmed)


def u_turn(before: Column, after: Column) -> Column:
    """The two outer points of a turn from the end of one lane to the start of the next, on a line across the lanes."""
    out = TURN_OUT_M + LANE_TRIM_M

    def ahead(a: Column, b: Column) -> tuple[Column, Column]:
        size = F.greatest(F.hypot(b["x"] - a["x"], b["y"] - a["y"]), F.lit(1e-9))
        return (b["x"] - a["x"]) / size, (b["y"] - a["y"]) / size

    end, start = F.element_at(before, -1), after[0]
    dx, dy = ahead(F.element_at(before, -2), end)
    nx, ny = ahead(start, after[1])
    ax, ay, ex, ey = end["x"] + dx * out, end["y"] + dy * out, start["x"] - nx * out, start["y"] - ny * out
    along = lambda x, y: x * dx + y * dy
    far = F.greatest(along(ax, ay), along(ex, ey))
    pushed = lambda x, y: G.point(x + dx * (far - along(x, y)), y + dy * (far - along(x, y)))
    return F.array(pushed(ax, ay), pushed(ex, ey))


def u_turns(lanes: DataFrame) -> DataFrame:
    """lanes (block, n from 1, id, lane) in the order they are driven, every second one backwards: the turn after each but
    the last of its block."""
    driven = lanes.withColumn("lane", F.when(F.col("n") % 2 == 0, F.reverse("lane")).otherwise(F.col("lane")))
    w = Window.partitionBy("block").orderBy("n")
    turned = driven.withColumn("after", F.lead("lane").over(w)).where("after IS NOT NULL")
    return turned.select("block", "n", "id", u_turn(F.col("lane"), F.col("after")).alias("turn"))


def track_ahead(points: DataFrame, step: float) -> DataFrame:
    """points (track, n, x, y): where each track is expected `step` further on, in a line through its last point and the
    one two before it; with fewer than three points, beside the last."""
    w = Window.partitionBy("track").orderBy("n")
    xa, ya = F.lag("x", 2).over(w), F.lag("y", 2).over(w)
    slope = F.try_divide(F.col("y") - ya, F.col("x") - xa)
    return points.withColumn("expected", F.col("y") + F.coalesce(slope, F.lit(0.0)) * step)


def row_search(rows: DataFrame, term: Column) -> DataFrame:
    """Rows whose id or block is the lower-cased term, or whose structure starts with it; all for an empty one."""
    q = F.lower(F.coalesce(term, F.lit("")))
    return rows.where((q == "") | (F.col("row_id") == q) | (F.col("vineyard_id") == q) | F.startswith("row_structure", q))


def log_page(lines: DataFrame, since: Column) -> DataFrame:
    """lines (job, at, ...): those of each job from the offset `since` on, with their number (from 0) and how many there are."""
    w = Window.partitionBy("job")
    numbered = lines.withColumns({"line": F.row_number().over(w.orderBy("at")) - 1, "n": F.count(F.lit(1)).over(w)})
    return numbered.where(F.col("line") >= since)


#: Columns of a row of plants, and of those that stay: ys has an offset a metre from x0 on.
ROWS = "block long, id long, x0 long, ys array<double>"


def distinct_rows(rows: DataFrame, period: float) -> DataFrame:
    """rows (ROWS) without second tracks on one physical row: by block, from the least median offset on, a row goes (the
    shorter one) that shares over 30 % of its extent with one of the four kept last and lies within 0.45 of the period of
    it. The order matters, so a block's rows are gone through by one task; blocks are bounded by the land they cover."""

    def run(pdf):
        import numpy as np

        line = [(int(r.id), int(r.x0), np.asarray(r.ys, float)) for r in pdf.itertuples() if r.ys is not None and len(r.ys)]
        kept: list[tuple] = []
        for row in sorted(line, key=lambda r: (float(np.median(r[2])), r[0])):
            at = next((i for i in range(max(0, len(kept) - 4), len(kept)) if _alike(kept[i], row, period)), None)
            if at is None:
                kept.append(row)
            elif len(row[2]) > len(kept[at][2]):
                kept[at] = row
        return pdf[pdf["id"].isin([r[0] for r in kept])]

    return rows.select("block", "id", "x0", "ys").groupBy("block").applyInPandas(run, ROWS)


def _alike(a: tuple, b: tuple, period: float) -> bool:
    import numpy as np

    low, high = max(a[1], b[1]), min(a[1] + len(a[2]), b[1] + len(b[2])) - 1
    if high - low <= 0.3 * min(len(a[2]), len(b[2])):
        return False
    apart = np.abs(a[2][low - a[1] : high - a[1]] - b[2][low - b[1] : high - b[1]])
    return bool(np.median(apart) < 0.45 * period)
