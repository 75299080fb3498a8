"""Targets to visit: inspection gaps, waste, audit samples; ids, priorities, caps and checklists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowfield.functions import scalars as S
from rowfield.operators.numbering import numbered, padded

AUDIT_ROWS, TOP_TARGETS, LISTED = 2, 40, 10


def derived(pieces: DataFrame, waste: DataFrame) -> DataFrame:
    """Disrupted row pieces at their middles, and waste at its place. Ids carry the tile, so pieces of a row differ."""
    gaps = pieces.where("row_structure = 'disrupted'").select(F.concat(F.lit("gap-"), "row_id", F.lit("-"), "tile", F.lit("-"), F.col("piece").cast("string")).alias("id"), F.lit("inspection").alias("kind"), (F.col("x0") + F.col("length_m") / 2).alias("x"), F.col("y0").alias("y"), "vineyard_id", "row_id")
    rest = waste.select(F.concat(F.lit("waste-"), F.col("id").cast("string")).alias("id"), F.lit("waste").alias("kind"), "x", "y", F.lit("").alias("vineyard_id"), F.lit("").alias("row_id"))
    return gaps.unionByName(rest)


def audit_sample(rows: DataFrame) -> DataFrame:
    """Per block its least certain rows and the one in the middle by id (of blocks with more than two), each once."""
    by_confidence = F.row_number().over(Window.partitionBy("vineyard_id").orderBy("confidence", "row_id"))
    by_id = F.row_number().over(Window.partitionBy("vineyard_id").orderBy("row_id"))
    n = F.count(F.lit(1)).over(Window.partitionBy("vineyard_id"))
    marked = rows.withColumns({"c": by_confidence, "i": by_id, "n": n})
    least, middle = F.col("c") <= AUDIT_ROWS, (F.col("n") > 2) & (F.col("i") == F.floor(F.col("n") / 2) + 1)
    return marked.where(least | middle).select("vineyard_id", "row_id", F.when(least, "low confidence").otherwise("median sample").alias("reason"), F.round(S.audit_priority(F.col("confidence")), 3).alias("priority"))


def weakest(strips: DataFrame) -> DataFrame:
    """Per block the first strip with the lowest confidence."""
    return strips.groupBy("vineyard_id").agg(F.min_by("id", F.struct("confidence", "id")).alias("id"), F.min("confidence").alias("confidence"))


def running_ids(gaps: DataFrame, waste: DataFrame, scope: DataFrame) -> DataFrame:
    """gap-<row>-k counts over all tiles in scope; waste-<tile>-j restarts with each tile, before the scope applies."""
    k = F.row_number().over(Window.partitionBy("row_id").orderBy("tile", "piece"))
    j = F.row_number().over(Window.partitionBy("tile").orderBy("piece"))
    in_scope = lambda df: df.join(scope, "tile", "left_semi")
    a = in_scope(gaps).select(F.concat_ws("-", F.lit("gap"), "row_id", k.cast("string")).alias("id"), "tile", "piece")
    b = in_scope(waste.withColumn("j", j)).select(F.concat_ws("-", F.lit("waste"), "tile", F.col("j").cast("string")).alias("id"), "tile", "piece")
    return a.unionByName(b)


def sequence_ids(targets: DataFrame, letter: str, folder: str) -> DataFrame:
    """I0001, I0002, ... from north to south, west to east; ids beyond 9999 are longer. `folder` is in the shared folder."""
    ranged = numbered(targets, [F.desc("y"), F.asc("x"), F.asc("id")], folder)
    return ranged.withColumn("sequence_id", F.concat(F.lit(letter), padded(F.col("n"), 4))).drop("n")


def top(targets: DataFrame, most: int = TOP_TARGETS) -> DataFrame:
    """The targets of the highest priority; ties by id."""
    return targets.orderBy(F.desc("priority"), "id").limit(most)


def capped(targets: DataFrame, most: int) -> DataFrame:
    """One row: whether a route may be planned, and the message if there are too many targets."""
    n = F.count(F.lit(1))
    return targets.agg(n.alias("targets"), (n <= most).alias("routable"), F.when(n > most, F.concat(n.cast("string"), F.lit(f" targets, at most {most} can be routed"))).otherwise("").alias("message"))


def skipped(targets: DataFrame, visited: DataFrame) -> DataFrame:
    return targets.join(visited.select("id"), "id", "left_anti")


def skipped_message(targets: DataFrame, visited: DataFrame) -> DataFrame:
    """One row; only the first ids are gathered, by a top-k."""
    left = skipped(targets, visited)
    first = left.select("id").orderBy("id").limit(LISTED + 1).agg(F.array_sort(F.collect_list("id")).alias("ids"))
    return first.crossJoin(left.agg(F.count(F.lit(1)).alias("n"))).select("n", S.listed(F.col("ids"), LISTED).alias("ids"))


def check_text(kind: str = "kind", gap: str = "gap_m"):
    return F.when(F.col(kind) == "waste", "remove waste").otherwise(F.concat(F.format_string("%.1f", F.round(gap, 1)), F.lit(" m gap in row")))


def checklist(stops: DataFrame) -> DataFrame:
    """Stops of a tour (order, x, y, kind, gap_m) with cumulative metres, weight and what to check."""
    w = Window.partitionBy("tour").orderBy("order")
    step = F.coalesce(F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)), F.lit(0.0))
    return stops.withColumn("step", step).select("tour", "order", "id", "kind", F.round(S.inspector_weight(F.col("kind"), F.col("gap_m")), 2).alias("priority"), check_text().alias("what_to_check"), F.round(F.sum("step").over(w), 1).alias("cumulative_m"))


def co_located(targets: DataFrame, radius: float = 1.5) -> DataFrame:
    """Groups of targets around seeds: in order, a target joins the first seed within `radius`, else it is one. The fold
    runs per cell block of the ordered targets' own group column, which bounds it."""
    order = F.array_sort(F.collect_list(F.struct("ord", "id", "x", "y")))
    seeds = F.aggregate(
        order,
        F.array().cast("array<struct<id:bigint,x:double,y:double>>"),
        lambda acc, t: F.when(F.exists(acc, lambda s: F.hypot(s["x"] - t["x"], s["y"] - t["y"]) <= radius), acc).otherwise(F.concat(acc, F.array(F.struct(t["id"].alias("id"), t["x"].alias("x"), t["y"].alias("y"))))),
    )
    groups = targets.groupBy("block").agg(order.alias("all"), seeds.alias("seeds"))
    first = lambda t: F.get(F.filter(F.col("seeds"), lambda s: F.hypot(s["x"] - t["x"], s["y"] - t["y"]) <= radius), F.lit(0))["id"]
    return groups.select("block", F.explode(F.transform("all", lambda t: F.struct(t["id"].alias("id"), first(t).alias("seed")))).alias("g")).select("block", "g.id", "g.seed")
