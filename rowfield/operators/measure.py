"""Measurements: lengths, union areas, counts, at row, block and site level."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowfield.operators.spatial import usual_cell, with_cells


def row_lengths(pieces: DataFrame) -> DataFrame:
    """Metres a row: its pieces on all tiles, summed."""
    return pieces.groupBy("vineyard_id", "row_id").agg(F.sum("length_m").alias("length_m"), F.count(F.lit(1)).alias("pieces"))


def tile_row_lengths(pieces: DataFrame, duplicates: str = "sum") -> DataFrame:
    """Metres a row and tile. Rows with several pieces on a tile are summed, or, with "last", the last one counts."""
    if duplicates not in ("sum", "last"):
        raise ValueError(duplicates)
    metres = F.sum("length_m") if duplicates == "sum" else F.max_by("length_m", "piece")
    return pieces.groupBy("tile", "row_id").agg(metres.alias("length_m"))


def box_unions(boxes: DataFrame, by: str) -> DataFrame:
    """`by`, area: the area that the boxes x0, y0, x1, y1 (whole units) of a group cover together, exactly.

    Boxes are clipped to cells of about twice their usual extent, and cells are swept each by itself: slabs between
    neighbouring x edges meet the boxes that span them. So neither a group nor a wide box meets in one task as a whole,
    and the work grows with the boxes of a cell, not of a group. Boxes that are empty or lack a corner cover nothing.
    """
    boxes = boxes.where("x1 > x0 AND y1 > y0").select(by, "x0", "y0", "x1", "y1")
    usual = boxes.agg(F.percentile_approx(F.col("x1") - F.col("x0"), 0.9).alias("w"), F.percentile_approx(F.col("y1") - F.col("y0"), 0.9).alias("h")).first()
    cut = boxes
    for axis, extent in (("x", usual["w"]), ("y", usual["h"])):
        size, low, high = F.lit(2 * max(int(extent or 1), 1)), F.col(f"{axis}0"), F.col(f"{axis}1")
        cut = cut.withColumn(f"c{axis}", F.explode(F.sequence(F.floor(low / size), F.floor((high - 1) / size))))
        cut = cut.withColumns({f"{axis}0": F.greatest(low, F.col(f"c{axis}") * size), f"{axis}1": F.least(high, (F.col(f"c{axis}") + 1) * size)})
    cell = [by, "cx", "cy"]
    cut = cut.distinct().repartition(*cell)
    edges = cut.select(*cell, F.explode(F.array("x0", "x1")).alias("a")).distinct()
    slabs = edges.withColumn("b", F.lead("a").over(Window.partitionBy(*cell).orderBy("a"))).where("b IS NOT NULL")
    met = slabs.join(cut, cell).where("x0 <= a AND x1 >= b").select(*cell, "a", "b", "y0", "y1")
    before = F.max("y1").over(Window.partitionBy(*cell, "a").orderBy("y0", "y1").rowsBetween(Window.unboundedPreceding, -1))
    new = F.greatest(F.col("y1") - F.greatest(F.coalesce(before, F.col("y0")), F.col("y0")), F.lit(0))
    return met.withColumn("new", new).groupBy(by).agg(F.sum((F.col("b") - F.col("a")) * F.col("new")).alias("area"))


def levels(pieces: DataFrame) -> DataFrame:
    """The tidy table: row, block and total lines. Pieces are summed to rows once; blocks and the total are rolled up from
    the rows."""
    rows = pieces.groupBy("vineyard_id", "row_id").agg(F.sum("length_m").alias("m"), F.count(F.lit(1)).alias("n"))
    # a row id may be in several blocks; in the total it counts once
    ids = rows.groupBy("row_id").agg(F.count(F.lit(1)).alias("blocks")).where("row_id IS NOT NULL")
    one = lambda c: F.lit(c).cast("long")
    named = F.when(F.col("row_id").isNull(), 0).otherwise(1).cast("long")
    line = rows.select(F.lit("row").alias("level"), "vineyard_id", "row_id", "m", "n", named.alias("row_count"), F.when(F.col("vineyard_id").isNull(), one(0)).otherwise(one(1)).alias("block_count"))
    blocks = rows.groupBy("vineyard_id").agg(F.sum("m").alias("m"), F.sum("n").alias("n"), F.count("row_id").alias("row_count"))
    block = blocks.select(F.lit("block").alias("level"), "vineyard_id", F.lit(None).cast("string").alias("row_id"), "m", "n", "row_count", F.when(F.col("vineyard_id").isNull(), one(0)).otherwise(one(1)).alias("block_count"))
    zero = one(0)
    sums = blocks.select("m", "n", F.when(F.col("vineyard_id").isNull(), zero).otherwise(one(1)).alias("b"), zero.alias("r")).unionByName(ids.select(F.lit(None).cast("double").alias("m"), zero.alias("n"), zero.alias("b"), one(1).alias("r")))
    total = sums.agg(F.sum("m").alias("m"), *[F.coalesce(F.sum(c), zero).alias(name) for c, name in (("n", "n"), ("r", "row_count"), ("b", "block_count"))])
    total = total.select(F.lit("total").alias("level"), F.lit(None).cast("string").alias("vineyard_id"), F.lit(None).cast("string").alias("row_id"), "m", "n", "row_count", "block_count")
    every = line.unionByName(block).unionByName(total)
    return every.select("level", "vineyard_id", "row_id", F.round("m", 2).alias("row_length_m"), F.col("n").alias("pieces"), "row_count", "block_count")


def levels(pieces: DataFrame) -> DataFrame:
    """The tidy table: row, block and total lines in one pass of grouping sets."""
    grouped = pieces.groupingSets([["vineyard_id", "row_id"], ["vineyard_id"], []], "vineyard_id", "row_id").agg(
        F.grouping_id().alias("g"),
        F.round(F.sum("length_m"), 2).alias("row_length_m"),
        F.count(F.lit(1)).alias("pieces"),
        F.countDistinct("row_id").alias("row_count"),
        F.countDistinct("vineyard_id").alias("block_count"),
    )
    level = F.when(F.col("g") == 0, "row").when(F.col("g") == 1, "block").otherwise("total")
    return grouped.select(level.alias("level"), "vineyard_id", "row_id", "row_length_m", "pieces", "row_count", "block_count")


def block_table(pieces: DataFrame, canopy: DataFrame, strips: DataFrame) -> DataFrame:
    """Per block: rows, metres, canopies, their union area, strip union area (square metres from centimetres)."""
    rows = pieces.groupBy("vineyard_id").agg(F.countDistinct("row_id").alias("row_count"), F.sum("length_m").alias("row_length_m"))
    counts = canopy.groupBy("vineyard_id").agg(F.count(F.lit(1)).alias("canopy_count"))
    areas = lambda boxes, name: box_unions(boxes, "vineyard_id").select("vineyard_id", (F.col("area") / 10000).alias(name))
    ids = pieces.select("vineyard_id").union(canopy.select("vineyard_id")).union(strips.select("vineyard_id")).distinct()
    parts = [rows, counts, areas(canopy, "canopy_area_m2"), areas(strips, "interrow_area_m2")]
    for part in parts:
        ids = ids.join(part, "vineyard_id", "left")
    return ids.fillna(0)


def site_totals(blocks: DataFrame, profile: str = "backend") -> DataFrame:
    """One row. "backend": sums of the blocks' exact values, hectares to 6 places; "service": sums of values rounded a
    block at a time to 2 places, hectares to 5."""
    if profile not in ("backend", "service"):
        raise ValueError(profile)
    value = (lambda c: F.col(c)) if profile == "backend" else (lambda c: F.round(c, 2))
    places = 6 if profile == "backend" else 5
    return blocks.agg(
        F.count(F.lit(1)).alias("block_count"),
        F.sum("row_count").alias("row_count"),
        F.sum("canopy_count").alias("canopy_count"),
        # sums are first freed of the order in which they were added up
        *[F.round(F.round(F.sum(value(c)), 4), 2).alias(c) for c in ("row_length_m", "canopy_area_m2", "interrow_area_m2")],
        F.round(F.sum(value("interrow_area_m2")) / 10000, places).alias("interrow_area_ha"),
    )


def axial_directions(lines: DataFrame, by: str) -> DataFrame:
    """`by`, direction: the length-weighted mean axis (angle_deg, length_m) in [0, 180), by doubled angles."""
    a = F.radians(F.col("angle_deg") * 2)
    y, x = F.sum(F.col("length_m") * F.sin(a)), F.sum(F.col("length_m") * F.cos(a))
    return lines.groupBy(by).agg(F.pmod(F.degrees(F.atan2(y, x)) / 2, F.lit(180.0)).alias("direction"))


def row_attributes(pieces: DataFrame) -> DataFrame:
    """Per row: mean confidence (0.7 where unknown) and structure: disrupted before regular before unassessable."""
    has = lambda s: F.bool_or(F.col("row_structure") == s)
    merged = F.when(has("disrupted"), "disrupted").when(has("regular"), "regular").otherwise("unassessable")
    return pieces.groupBy("row_id").agg((F.floor(F.round(F.avg(F.coalesce("confidence", F.lit(0.7))), 6) * 1000 + 0.5) / 1000).alias("confidence"), merged.alias("row_structure"))


def spacings(offsets: DataFrame, by: str, default: float = 2.5) -> DataFrame:
    """`by`, spacing: the median step between neighbouring distinct offsets; the default for a single one."""
    step = F.col("offset") - F.lag("offset").over(Window.partitionBy(by).orderBy("offset"))
    return offsets.select(by, "offset").distinct().withColumn("step", step).groupBy(by).agg(F.coalesce(F.median("step"), F.lit(default)).alias("spacing"))


def extent(points: DataFrame, *by: str) -> DataFrame:
    return points.groupBy(*by).agg(F.min("x").alias("xmin"), F.min("y").alias("ymin"), F.max("x").alias("xmax"), F.max("y").alias("ymax"))


def comparison(single_trips: Column, tour: Column) -> dict[str, Column]:
    """A tour against separate trips from the start to each stop and back (`single_trips`: the sum of distances)."""
    separate = 2 * single_trips
    saved = separate - tour
    return {"separate_m": separate, "tour_m": tour, "saved_m": saved, "reduction_pct": F.coalesce(F.try_divide(100 * saved, separate), F.lit(0.0))}


#: Of a tile: the best of each side where both lie in it alone (hits, and their scores' sum), else a row for each.
_BEST = "side int, truth string, found string, score long, hits long"
#: Boxes whose pairs are tried at a time, and the units of a score.
_CHUNK, _UNITS = 64, 1_000_000_000


def match_scores(truth: DataFrame, found: DataFrame, truths: int, founds: int, folder: str, least: float = 0.5, tile: float | None = None) -> DataFrame:
    """Detection scores of boxes (name, box): each side is used once, best pairs first where mutual. Pairs share `least` of
    what they cover together (to nine places); ties go to the smaller name.

    Boxes go to the tiles that they touch. A tile tries its boxes row by row of tiles' tallest box, by classes of widths,
    and keeps the best partner of each box, not the pairs. Where both lie in one tile alone the pair is decided there; the
    few others' best are written to `folder` and compared over all tiles.
    """
    size = tile or 32 * usual_cell(truth, 0.0)

    def rows(boxes: DataFrame, side: int) -> DataFrame:
        box = boxes.where("xmax > xmin AND ymax > ymin").select("name", *[F.col(c).cast("double").alias(c) for c in ("xmin", "ymin", "xmax", "ymax")])
        alone = [F.floor(F.col(f"{a}min") / size) == F.floor(F.col(f"{a}max") / size) for a in "xy"]
        return with_cells(box, size).select("cx", "cy", F.lit(side).alias("side"), "name", "xmin", "ymin", "xmax", "ymax", (alone[0] & alone[1]).alias("alone"))

    def run(table):
        return _best_of_tile(table, least)

    rows(truth, 0).unionByName(rows(found, 1)).groupBy("cx", "cy").applyInArrow(run, _BEST).write.parquet(folder)
    best = truth.sparkSession.read.schema(_BEST).parquet(folder)
    of = lambda side, one, other: best.where(F.col("side") == side).groupBy(one).agg(F.min(F.struct((-F.col("score")).alias("s"), F.col(other).alias("n"))).alias("b")).select(one, F.col("b.n").alias(other), (-F.col("b.s")).alias("score"))
    apart = of(0, "truth", "found").join(of(1, "found", "truth").select("truth", "found"), ["truth", "found"]).select("score", F.lit(1).cast("long").alias("hits"))
    every = best.where("side = 2").select("score", "hits").unionByName(apart)
    n = every.agg(F.coalesce(F.sum("hits"), F.lit(0)).cast("long").alias("hits"), F.sum("score").alias("score"))
    f1 = F.lit(2.0) * F.col("hits") / F.lit(max(truths + founds, 1))
    return n.select("hits", F.round(F.try_divide(F.col("score") / F.lit(float(_UNITS)), F.col("hits")), 6).alias("mean_iou"), F.round(f1, 6).alias("f1"))


def _best_of_tile(table, least: float):
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    sides = []
    for side in (0, 1):
        part = table.filter(pc.equal(table["side"], side)).sort_by("name")
        sides.append((part["name"].combine_chunks(), np.column_stack([part[c].to_numpy() for c in ("xmin", "ymin", "xmax", "ymax")]), part["alone"].to_numpy()))
    (tn, t, ta), (fn, f, fa) = sides
    # a score and a partner in one number: the larger score, then the smaller place by name
    best = [np.zeros(len(t), np.int64), np.zeros(len(f), np.int64)]
    for i, j, score in _near_pairs(t, f, least):
        np.maximum.at(best[0], i, (score << 32) + ((1 << 32) - 1 - j))
        np.maximum.at(best[1], j, (score << 32) + ((1 << 32) - 1 - i))
    partner = [(1 << 32) - 1 - (b & ((1 << 32) - 1)) for b in best]
    i, j = np.flatnonzero(best[0]), np.flatnonzero(best[1])
    ti, fj = partner[0][i], partner[1][j]
    both = ta[i] & fa[ti]
    hit = both & (partner[1][ti] == i)
    ends = fa[j] & ta[fj]
    open_t, open_f = i[~both], j[~ends]
    columns = [
        np.concatenate([[2], np.zeros(len(open_t), int), np.ones(len(open_f), int)]).astype(np.int32),
        pa.concat_arrays([pa.array([None], tn.type), tn.take(pa.array(open_t)), tn.take(pa.array(partner[1][open_f]))]),
        pa.concat_arrays([pa.array([None], fn.type), fn.take(pa.array(partner[0][open_t])), fn.take(pa.array(open_f))]),
        np.concatenate([[int((best[0][i[hit]] >> 32).sum())], best[0][open_t] >> 32, best[1][open_f] >> 32]).astype(np.int64),
        np.concatenate([[int(hit.sum())], np.zeros(len(open_t) + len(open_f), int)]).astype(np.int64),
    ]
    return pa.table([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], names=["side", "truth", "found", "score", "hits"])


def _near_pairs(t, f, least: float):
    """(places in t, places in f, scores in units) of all pairs with a score of `least` or more. Such pairs' widths differ by
    1 / least at most, and their left edges by (1 - least) of the wider one."""
    import numpy as np

    if not len(t) or not len(f):
        return
    base, tall = 1.01 / least, max((t[:, 3] - t[:, 1]).max(), (f[:, 3] - f[:, 1]).max())

    def groups(box):
        kinds = np.floor(np.log(box[:, 2] - box[:, 0]) / np.log(base)).astype(np.int64), np.floor(box[:, 1] / tall).astype(np.int64)
        order = np.lexsort((box[:, 0], *kinds))
        kinds = np.column_stack(kinds)[order]
        cuts = [0, *(np.flatnonzero((kinds[1:] != kinds[:-1]).any(axis=1)) + 1).tolist(), len(box)]
        return {tuple(kinds[a].tolist()): order[a:b] for a, b in zip(cuts, cuts[1:], strict=False)}

    others = {k: (at, f[at], f[at, 0], (f[at, 2] - f[at, 0]) * (f[at, 3] - f[at, 1])) for k, at in groups(f).items()}
    for (kind, row), at in groups(t).items():
        near = [(others[k, r], (1.01 - least) * base ** (max(kind, k) + 1)) for k in (kind - 1, kind, kind + 1) for r in (row - 1, row, row + 1) if (k, r) in others]
        for n in range(0, len(at), _CHUNK):
            own = at[n : n + _CHUNK]
            x0, y0, x1, y1 = (c[:, None] for c in t[own].T)
            area = (x1 - x0) * (y1 - y0)
            for (places, box, left, areas), reach in near:
                a, b = np.searchsorted(left, [x0[0, 0] - reach, x0[-1, 0] + reach])
                if a == b:
                    continue
                u0, v0, u1, v1 = box[a:b].T
                wide, high = np.minimum(x1, u1) - np.maximum(x0, u0), np.minimum(y1, v1) - np.maximum(y0, v0)
                shared = np.maximum(wide, 0) * np.maximum(high, 0)
                score = shared / (area + areas[a:b] - shared)
                i, j = np.nonzero(score >= least - 1e-8)
                units = np.floor(score[i, j] * _UNITS + 0.5).astype(np.int64)
                enough = units >= round(least * _UNITS)
                yield own[i[enough]], places[a + j[enough]], units[enough]
