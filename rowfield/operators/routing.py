"""Routing: walk grids, shortest paths, tours, lane covers, turn-by-turn instructions.

Cells and edges are DataFrames. Searches are not relational: they run in numpy and heaps, one scope a task, through
applyInPandas, so that many scopes are planned side by side.
"""

from __future__ import annotations

import heapq
from itertools import permutations
from math import hypot, inf, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowfield.functions import scalars as S
from rowfield.operators.numbering import padded

EXACT_STOPS = 8
SIMPLIFY_M, SHORT_STEP_M = 1.5, 3.0


def raster_boxes(boxes: DataFrame, size: float) -> DataFrame:
    """scope, r, c: cells whose centres lie in a box (scope, x0, y0, x1, y1)."""
    low = lambda v: F.ceil(F.col(v) / size - 0.5).cast("long")
    high = lambda v: (F.ceil(F.col(v) / size - 0.5) - 1).cast("long")
    spans = boxes.select("scope", low("y0").alias("a"), high("y1").alias("b"), low("x0").alias("e"), high("x1").alias("f")).where("a <= b AND e <= f")
    return spans.select("scope", F.explode(F.sequence("a", "b")).alias("r"), "e", "f").select("scope", "r", F.explode(F.sequence("e", "f")).alias("c")).distinct()


def walkable(ground: list[DataFrame], blocked: list[DataFrame]) -> DataFrame:
    """Cells of any ground layer that no blocking layer has."""
    cells = ground[0]
    for g in ground[1:]:
        cells = cells.union(g)
    cells = cells.distinct()
    for b in blocked:
        cells = cells.join(b, ["scope", "r", "c"], "left_anti")
    return cells


def edges(cells: DataFrame, size: float, corners: bool = False) -> DataFrame:
    """scope, r, c, r2, c2, metres: undirected edges to four of eight neighbours. Without `corners`, a diagonal needs
    both cells beside it free."""
    offsets = [(0, 1), (1, 0), (1, 1), (1, -1)]
    step = F.array(*[F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc"), F.lit(size * sqrt(a * a + b * b)).alias("m")) for a, b in offsets])
    free = cells.select("scope", F.col("r").alias("r2"), F.col("c").alias("c2"))
    out = cells.withColumn("s", F.explode(step)).select("scope", "r", "c", (F.col("r") + F.col("s.dr")).alias("r2"), (F.col("c") + F.col("s.dc")).alias("c2"), F.col("s.m").alias("metres")).join(free, ["scope", "r2", "c2"])
    if not corners:
        diagonal = out.where("r <> r2 AND c <> c2")
        beside = lambda r, c: cells.select("scope", F.col("r").alias(r), F.col("c").alias(c))
        diagonal = diagonal.join(beside("r", "c2"), ["scope", "r", "c2"], "left_semi").join(beside("r2", "c"), ["scope", "r2", "c"], "left_semi")
        out = out.where("r = r2 OR c = c2").unionByName(diagonal)
    return out.select("scope", "r", "c", "r2", "c2", "metres")


def snap(points: DataFrame, cells: DataFrame, size: float, rings: int = 15) -> DataFrame:
    """Points (scope, id, x, y) on the nearest walkable cell centre within `rings` cells; null cells beyond."""
    reach = rings * size
    at = points.withColumns({"br": F.floor(F.col("y") / reach), "bc": F.floor(F.col("x") / reach)})
    near = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    spread = at.withColumn("n", F.explode(near)).withColumns({"br": F.col("br") + F.col("n.a"), "bc": F.col("bc") + F.col("n.b")}).drop("n")
    centres = cells.withColumns({"cx": (F.col("c") + 0.5) * size, "cy": (F.col("r") + 0.5) * size}).withColumns({"br": F.floor(F.col("cy") / reach), "bc": F.floor(F.col("cx") / reach)})
    d = F.hypot(F.col("x") - F.col("cx"), F.col("y") - F.col("cy"))
    best = spread.join(centres, ["scope", "br", "bc"]).where(d <= reach).groupBy("scope", "id").agg(F.min(F.struct(d.alias("d"), "r", "c")).alias("best"))
    return points.join(best, ["scope", "id"], "left").select(*points.columns, F.col("best.r").alias("r"), F.col("best.c").alias("c"), F.round("best.d", 6).alias("moved"))


def shortest(adjacent: dict, source, limit: float = inf) -> tuple[dict, dict]:
    """Dijkstra: (metres, predecessor) by node."""
    metres, before, queue = {source: 0.0}, {}, [(0.0, source)]
    while queue:
        d, n = heapq.heappop(queue)
        if d > metres[n]:
            continue
        for m, w in adjacent.get(n, ()):
            if d + w < metres.get(m, inf) and d + w <= limit:
                metres[m], before[m] = d + w, n
                heapq.heappush(queue, (d + w, m))
    return metres, before


def a_star(free: set[tuple[int, int]], start: tuple[int, int], goal: tuple[int, int], size: float) -> list[tuple[int, int]] | None:
    """Cells of a shortest eight-neighbour path, corners may be cut."""
    ahead = lambda n: size * hypot(n[0] - goal[0], n[1] - goal[1])
    metres, before, queue, done = {start: 0.0}, {}, [(ahead(start), start)], set()
    while queue:
        _, n = heapq.heappop(queue)
        if n == goal:
            path = [n]
            while path[-1] != start:
                path.append(before[path[-1]])
            return path[::-1]
        if n in done:
            continue
        done.add(n)
        for dr in (-1, 0, 1):
            for dc in (-1, 0, 1):
                m = n[0] + dr, n[1] + dc
                if m == n or m not in free:
                    continue
                d = metres[n] + size * hypot(dr, dc)
                if d < metres.get(m, inf):
                    metres[m], before[m] = d, n
                    heapq.heappush(queue, (d + ahead(m), m))
    return None


def exact_tour(d: np.ndarray) -> tuple[list[int], float]:
    """The shortest closed tour from 0 over all others; the first one in lexicographic order among equals."""
    best, length = list(range(1, len(d))), inf
    for order in permutations(range(1, len(d))):
        now = sum(d[a, b] for a, b in zip((0, *order), (*order, 0), strict=True))
        if now < length:
            best, length = list(order), now
    return [0, *best, 0], float(length if len(d) > 1 else 0.0)


def nearest_tour(d: np.ndarray) -> list[int]:
    left, tour = set(range(1, len(d))), [0]
    while left:
        tour.append(min(left, key=lambda j: (d[tour[-1], j], j)))
        left.remove(tour[-1])
    return [*tour, 0]


def tour_length(d: np.ndarray, tour: list[int]) -> float:
    return float(sum(d[a, b] for a, b in zip(tour, tour[1:], strict=False)))


def improved_tour(d: np.ndarray, tour: list[int], rounds: int = 100) -> list[int]:
    """2-opt and moves of one to three stops, until nothing gets shorter or the rounds are over."""
    tour, n = list(tour), len(tour)
    for _ in range(rounds):
        better = False
        for i in range(1, n - 2):
            for j in range(i + 1, n - 1):
                if d[tour[i - 1], tour[j]] + d[tour[i], tour[j + 1]] < d[tour[i - 1], tour[i]] + d[tour[j], tour[j + 1]] - 1e-9:
                    tour[i : j + 1] = tour[i : j + 1][::-1]
                    better = True
        for size in (1, 2, 3):
            for i in range(1, n - size):
                part, rest = tour[i : i + size], tour[:i] + tour[i + size :]
                saved = d[tour[i - 1], part[0]] + d[part[-1], tour[i + size]] - d[tour[i - 1], tour[i + size]]
                cost, at = min((d[a, part[0]] + d[part[-1], b] - d[a, b], k) for k, (a, b) in enumerate(zip(rest, rest[1:], strict=False), 1))
                if cost < saved - 1e-9:
                    tour = rest[:at] + part + rest[at:]
                    better = True
        if not better:
            break
    return tour


def plan_tour(d: np.ndarray) -> tuple[list[int], float]:
    """Exact for few stops, else nearest neighbour with improvement."""
    if len(d) - 1 <= EXACT_STOPS:
        return exact_tour(d)
    tour = improved_tour(d, nearest_tour(d))
    return tour, tour_length(d, tour)


def prize_tour(d: np.ndarray, prize: list[float], budget: float) -> tuple[list[int], float]:
    """A closed tour of at most `budget` metres with much prize: the best prize a metre is put in, then improved."""
    tour, left = [0, 0], set(range(1, len(d)))
    while True:
        best = None
        now = tour_length(d, tour)
        for s in sorted(left):
            cost, at = min((d[a, s] + d[s, b] - d[a, b], k) for k, (a, b) in enumerate(zip(tour, tour[1:], strict=False), 1))
            if now + cost <= budget + 1e-9 and (best is None or prize[s] / max(cost, 1e-9) > best[0]):
                best = prize[s] / max(cost, 1e-9), s, at
        if best is None:
            return tour, now
        tour.insert(best[2], best[1])
        left.remove(best[1])
        tour = improved_tour(d, tour)


def tours(stops: DataFrame) -> DataFrame:
    """stops: scope, ord (0 is the start), id, x, y. Per scope the planned closed tour over straight distances."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ord")
        xy = pdf[["x", "y"]].to_numpy()
        d = np.hypot(*(xy[:, None] - xy[None]).transpose(2, 0, 1))
        tour, length = plan_tour(d)
        separate = 2 * float(d[0].sum())
        ids = pdf["id"].tolist()
        saved = separate - length
        return pd.DataFrame({"scope": [pdf["scope"].iloc[0]], "stops": [[str(ids[i]) for i in tour[1:-1]]], "length_m": [round(length, 6)], "separate_m": [round(separate, 6)], "reduction_pct": [round(100 * saved / separate, 6) if separate else 0.0]})

    return stops.groupBy("scope").applyInPandas(run, "scope string, stops array<string>, length_m double, separate_m double, reduction_pct double")


def grid_routes(cells: DataFrame, stops: DataFrame, size: float) -> DataFrame:
    """Per scope: a closed walk over its walkable cells (scope, r, c) through snapped stops (scope, ord, id, r, c)."""

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        free = set(zip(left["r"].tolist(), left["c"].tolist(), strict=True))
        right = right.sort_values("ord")
        nodes = list(zip(right["r"].tolist(), right["c"].tolist(), strict=True))
        n = len(nodes)
        d, paths = np.zeros((n, n)), {}
        for i in range(n):
            for j in range(i + 1, n):
                path = a_star(free, nodes[i], nodes[j], size)
                paths[i, j] = path
                d[i, j] = d[j, i] = 1e9 if path is None else sum(size * hypot(a[0] - b[0], a[1] - b[1]) for a, b in zip(path, path[1:], strict=False))
        reach = [i for i in range(n) if i == 0 or d[0, i] < 1e9]
        sub = d[np.ix_(reach, reach)]
        tour, length = plan_tour(sub)
        ids = right["id"].tolist()
        return pd.DataFrame({"scope": [key[0]], "stops": [[str(ids[reach[i]]) for i in tour[1:-1]]], "length_m": [round(length, 6)], "unreachable": [n - len(reach)]})

    none = pd.DataFrame({"scope": [], "stops": [], "length_m": [], "unreachable": []}, dtype=object)  # a scope without stops
    # the sides may come from one table, so the second gets columns of its own
    again = cells.select(F.col("scope").alias("scope"), F.col("r").alias("r"), F.col("c").alias("c"))
    return stops.groupBy("scope").cogroup(again.groupBy("scope")).applyInPandas(lambda key, s, c: run(key, c, s) if len(s) else none, "scope string, stops array<string>, length_m double, unreachable long")


def distance_matrix(stops: DataFrame) -> DataFrame:
    """scope, a, b, metres between the stops of a scope; stops per scope are capped by planning, not here."""
    a = stops.select("scope", F.col("id").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"))
    b = stops.select("scope", F.col("id").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"))
    return a.join(b, "scope").where("a <> b").select("scope", "a", "b", F.round(F.hypot(F.col("ax") - F.col("bx"), F.col("ay") - F.col("by")), 6).alias("metres"))


def legs(points: DataFrame) -> DataFrame:
    """Points of walks (walk, ord, x, y) as legs: metres, heading, compass, turn and running metres."""
    w = Window.partitionBy("walk").orderBy("ord")
    step = points.withColumns({"px": F.lag("x").over(w), "py": F.lag("y").over(w)}).where("px IS NOT NULL")
    step = step.withColumns({"metres": F.hypot(F.col("x") - F.col("px"), F.col("y") - F.col("py")), "heading": S.bearing(F.col("px"), F.col("py"), F.col("x"), F.col("y"))})
    return step.select("walk", "ord", F.round("metres", 4).alias("metres"), F.round("heading", 6).alias("heading"), S.compass(F.col("heading")).alias("compass"), S.turn(F.lag("heading").over(w), F.col("heading")).alias("turn"), F.round(F.sum("metres").over(w), 3).alias("walked_m"))


def merged_steps(steps: DataFrame) -> DataFrame:
    """Steps of walks (walk, ord, metres, heading) folded: a short one, or one within 25 degrees of the step before it,
    joins that step, which keeps the heading of its longest part."""
    order = F.array_sort(F.collect_list(F.struct("ord", "metres", "heading")))
    kind = "array<struct<metres:double,heading:double,longest:double>>"
    one = lambda m, h, g: F.array(F.struct(m.alias("metres"), h.alias("heading"), g.alias("longest")))

    def fold(acc, s):
        last = F.element_at(acc, -1)
        joins = (F.size(acc) > 0) & ((s["metres"] < SHORT_STEP_M) | (S.angle_between(F.try_element_at(acc, F.lit(-1))["heading"], s["heading"]) < 25))
        longer = s["metres"] > last["longest"]
        both = one(last["metres"] + s["metres"], F.when(longer, s["heading"]).otherwise(last["heading"]), F.greatest(last["longest"], s["metres"]))
        return F.when(joins, F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), both)).otherwise(F.concat(acc, one(s["metres"], s["heading"], s["metres"])))

    folded = steps.groupBy("walk").agg(F.aggregate(order, F.array().cast(kind), fold).alias("steps"))
    return folded.select("walk", F.posexplode("steps").alias("step", "s")).select("walk", "step", F.round("s.metres", 3).alias("metres"), F.round("s.heading", 6).alias("heading"))


def instruction_text(steps: DataFrame) -> DataFrame:
    """One line a step: number, turn, compass direction and whole metres."""
    w = Window.partitionBy("walk").orderBy("step")
    way = S.turn(F.lag("heading").over(w), F.col("heading"))
    return steps.select("walk", "step", F.concat_ws(" ", F.concat((F.col("step") + 1).cast("string"), F.lit(".")), way, F.lit("and walk"), S.compass(F.col("heading")), F.format_string("%.0f m", F.col("metres"))).alias("line"))


def lane_cover(spans: DataFrame) -> DataFrame:
    """The fewest lanes that cover all rows of a block: spans (block, lane, first, last) of row numbers; each time, of the
    lanes that cover the first uncovered row, the one that reaches farthest. A fold over a block's own lanes."""
    order = F.array_sort(F.collect_list(F.struct("first", (-F.col("last")).alias("back"), "lane")))
    state = F.struct(F.lit(-1).cast("long").alias("done"), F.lit(-1).cast("long").alias("reach"), F.lit(None).cast("string").alias("best"), F.array().cast("array<string>").alias("kept"))

    def fold(acc, s):
        last = -s["back"]
        over = s["first"] > acc["done"] + 1  # the row after the covered ones is not in this lane: close the pick
        taken = F.when(over & acc["best"].isNotNull(), F.concat(acc["kept"], F.array(acc["best"]))).otherwise(acc["kept"])
        done = F.when(over & acc["best"].isNotNull(), acc["reach"]).otherwise(acc["done"])
        done = F.when(s["first"] > done + 1, s["first"] - 1).otherwise(done)  # rows that no lane covers
        fresh = over
        better = (last > done) & (fresh | (last > acc["reach"]))
        reach = F.when(better, last).otherwise(F.when(fresh, done).otherwise(acc["reach"]))
        best = F.when(better, s["lane"]).otherwise(F.when(fresh, F.lit(None).cast("string")).otherwise(acc["best"]))
        return F.struct(done.alias("done"), reach.alias("reach"), best.alias("best"), taken.alias("kept"))

    end = lambda acc: F.when(acc["best"].isNotNull(), F.concat(acc["kept"], F.array(acc["best"]))).otherwise(acc["kept"])
    return spans.groupBy("block").agg(F.aggregate(order, state, fold, end).alias("lanes"))


def serpentine(lanes: DataFrame) -> DataFrame:
    """Lanes (block, offset, lane, x0, x1) in walking order, every second one turned round."""
    n = F.row_number().over(Window.partitionBy("block").orderBy("offset", "lane"))
    odd = n % 2 == 0
    return lanes.withColumn("n", n).select("block", "n", F.concat(F.lit("L"), padded(F.col("n"), 2)).alias("lane_id"), "lane", F.when(odd, F.col("x1")).otherwise(F.col("x0")).alias("from_x"), F.when(odd, F.col("x0")).otherwise(F.col("x1")).alias("to_x"))


def cheapest_variants(costs: DataFrame) -> DataFrame:
    """Viterbi over stages: costs (walk, stage, c: array of arrays) from each variant of a stage to each of the next.
    Per walk the least total."""
    order = F.array_sort(F.collect_list(F.struct("stage", "c")))
    first = F.array(F.lit(0.0))

    def fold(acc, s):
        n = F.size(F.element_at(s["c"], 1))
        return F.transform(F.sequence(F.lit(0), n - 1), lambda j: F.array_min(F.transform(s["c"], lambda row, i: F.coalesce(F.get(acc, i), F.lit(0.0)) + F.get(row, j))))

    return costs.groupBy("walk").agg(F.aggregate(order, first, fold, F.array_min).alias("cost"))


def path_sums(tree: DataFrame, folder: str) -> DataFrame:
    """node, total: the sum of weights from each node to its tree's root, by pointer doubling (root's parent is itself).
    It ends when all pointers stand at roots, after about log2 of the longest path; a cycle that isn't a root is an error.
    Each round is a table in `folder`, the shared checkpoint folder."""
    spark = tree.sparkSession
    now = tree.select("node", F.col("parent").alias("p"), F.when(F.col("node") == F.col("parent"), 0.0).otherwise(F.col("w")).alias("total"))
    step, nodes = 0, tree.count()
    while True:
        if 1 << step > 2 * max(nodes, 1):
            raise ValueError("a path never ends at a root")
        up = now.select(F.col("node").alias("p"), F.col("p").alias("pp"), F.col("total").alias("t2"))
        moved = now.join(up, "p").select("node", F.col("pp").alias("p"), (F.col("total") + F.col("t2")).alias("total"), (F.col("p") != F.col("pp")).alias("moving"))
        moved.write.mode("overwrite").parquet(f"{folder}/{step}")
        moved = spark.read.schema(moved.schema).parquet(f"{folder}/{step}")
        now = moved.drop("moving")
        if not moved.where("moving").limit(1).count():
            break
        step += 1
    return now.select("node", F.round("total", 6).alias("total"))


def path_lengths(tree: DataFrame, folder: str) -> DataFrame:
    """tree (node, parent, x, y, passable; a root is its own parent): node, length_m and off_m, the metres of its path to
    the root and those of them that have an end off passable ground."""
    up = tree.select(F.col("node").alias("parent"), F.col("x").alias("u"), F.col("y").alias("v"), F.col("passable").alias("good"))
    steps = tree.join(up, "parent").withColumn("w", F.hypot(F.col("x") - F.col("u"), F.col("y") - F.col("v")))
    off = F.when(F.col("passable") & F.col("good"), 0.0).otherwise(F.col("w"))
    whole = path_sums(steps.select("node", "parent", "w"), f"{folder}/length").withColumnRenamed("total", "length_m")
    return whole.join(path_sums(steps.select("node", "parent", off.alias("w")), f"{folder}/off").withColumnRenamed("total", "off_m"), "node")
