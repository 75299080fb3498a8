"""Scalar formulas of the survey as column expressions: colours, weights, confidences, directions, messages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Thresholds of the domain.
DISRUPTED_GAP_M = 5.0
BARE_BELOW, VEGETATION_ABOVE, OCCLUDED_ABOVE = 0.25, 0.75, 0.5
WALK_KMH = 4.0
SECTORS = ["north", "north-east", "east", "south-east", "south", "south-west", "west", "north-west"]


def excess_green(r: Column, g: Column, b: Column) -> Column:
    total = r + g + b
    return F.when(total > 0, (2 * g - r - b) / total).otherwise(0.0)


def cive(r: Column, g: Column, b: Column) -> Column:
    return -(0.441 * r - 0.811 * g + 0.385 * b + 18.787) / 255


def turn_length(d: Column, radius: Column) -> Column:
    """Metres of a headland turn between lanes d apart."""
    pi = F.pi()
    return F.when(radius <= 0, d).when(d >= 2 * radius, pi * radius + d - 2 * radius).otherwise(pi * radius + 3 * (2 * radius - d))


def gap_priority(gap: Column) -> Column:
    return 1 + F.least(gap, F.lit(30.0)) / 10


def inspector_weight(kind: Column, gap: Column) -> Column:
    """Waste weighs 3; a gap by its length; one that isn't a number counts as 0."""
    return F.when(kind == "waste", F.lit(3.0)).otherwise(gap_priority(F.coalesce(gap.try_cast("double"), F.lit(0.0))))


def audit_priority(confidence: Column) -> Column:
    return 1 + 2 * (1 - confidence)


def row_confidence(coverage: Column, occlusion: Column, shadow: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.35 + 0.65 * F.least(F.lit(1.0), coverage / 0.7) * (1 - occlusion) * (1 - shadow)))


def interrow_confidence(veg: Column) -> Column:
    return F.least(F.lit(1.0), 0.55 + 2 * F.least(F.abs(veg - BARE_BELOW), F.abs(veg - VEGETATION_ABOVE)))


def waste_confidence(kind: Column, area: Column) -> Column:
    return F.least(F.lit(0.95), F.when(kind == "vivid", 0.6).otherwise(0.5) + F.least(area, F.lit(2.0)) / 10)


def cover(veg: Column, occluded: Column | float = 0.0) -> Column:
    occluded = F.lit(occluded) if not isinstance(occluded, Column) else occluded
    return F.when(occluded > OCCLUDED_ABOVE, "unassessable").when(veg < BARE_BELOW, "bare_soil").when(veg > VEGETATION_ABOVE, "vegetation").otherwise("mixed")


def row_structure(longest_gap: Column, coverage: Column) -> Column:
    return F.when(coverage < 0.25, "unassessable").when(longest_gap >= DISRUPTED_GAP_M, "disrupted").otherwise("regular")


def bearing(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Degrees clockwise from north."""
    return F.pmod(F.degrees(F.atan2(x1 - x0, y1 - y0)), F.lit(360.0))


def compass(degrees: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, SECTORS)), (F.pmod(F.floor((degrees + 22.5) / 45), F.lit(8)) + 1).cast("int"))


def angle_between(a: Column, b: Column, period: float = 360.0) -> Column:
    """The smaller angle between directions (period 360) or axes (period 180)."""
    d = F.pmod(a - b, F.lit(period))
    return F.least(d, period - d)


def turn(before: Column, now: Column) -> Column:
    d = F.pmod(now - before + 180, F.lit(360.0)) - 180
    size, side = F.abs(d), F.when(d > 0, "right").otherwise("left")
    return F.when(before.isNull() | (size < 25), "straight").when(size > 150, "turn around").when(size < 60, F.concat(F.lit("bear "), side)).otherwise(F.concat(F.lit("turn "), side))


def walking_minutes(metres: Column, kmh: float = WALK_KMH) -> Column:
    return metres / (kmh * 1000) * 60


def utm_code(lon: Column, lat: Column) -> Column:
    return (F.when(lat >= 0, 32600).otherwise(32700) + F.floor((lon + 180) / 6) + 1).cast("int")


def grid_row(y: Column, top: float, size: float) -> Column:
    return F.floor((F.lit(top) - y) / size)


def grid_col(x: Column, left: float, size: float) -> Column:
    return F.floor((x - left) / size)


def parabolic_peak(before: Column, at: Column, after: Column) -> Column:
    """The shift of a peak between samples, within half a sample."""
    bend = before - 2 * at + after
    return F.when(bend != 0, F.greatest(F.lit(-0.5), F.least(F.lit(0.5), 0.5 * (before - after) / bend))).otherwise(0.0)


def points_of(text: Column) -> Column:
    """`x,y;x,y` as points."""
    return F.transform(F.split(text, ";"), lambda p: F.struct(F.split(p, ",")[0].cast("double").alias("x"), F.split(p, ",")[1].cast("double").alias("y")))


def points_text(points: Column, digits: int = 1) -> Column:
    return F.array_join(F.transform(points, lambda p: F.concat_ws(",", F.format_string(f"%.{digits}f", p["x"]), F.format_string(f"%.{digits}f", p["y"]))), ";")


def tile_row(name: Column) -> Column:
    return F.regexp_extract(name, r"r(\d+)_c(\d+)", 1).cast("int")


def tile_col(name: Column) -> Column:
    return F.regexp_extract(name, r"r(\d+)_c(\d+)", 2).cast("int")


def listed(ids: Column, most: int = 10) -> Column:
    """The first ids, and dots where there are more."""
    return F.concat(F.array_join(F.slice(ids, 1, most), ", "), F.when(F.size(ids) > most, ", ...").otherwise(""))
