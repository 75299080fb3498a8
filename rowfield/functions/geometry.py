"""Planar geometry as column expressions over points, `array<struct<x: double, y: double>>`."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

POINTS = "array<struct<x:double,y:double>>"


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def box_ring(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """The closed ring of a box, counter-clockwise from its lower left corner."""
    return F.array(point(x0, y0), point(x1, y0), point(x1, y1), point(x0, y1), point(x0, y0))


def closed(ring: Column) -> Column:
    return F.when((F.size(ring) > 0) & (ring[0] != F.element_at(ring, -1)), F.concat(ring, F.slice(ring, 1, 1))).otherwise(ring)


def _steps(line: Column) -> Column:
    """(x, y, u, v) of each segment."""
    n = F.greatest(F.size(line) - 1, F.lit(0))
    return F.zip_with(F.slice(line, 1, n), F.slice(line, 2, n), lambda a, b: F.struct(a["x"].alias("x"), a["y"].alias("y"), b["x"].alias("u"), b["y"].alias("v")))


def named(value: Column, use) -> Column:
    """use(value), with the value worked out once however often it occurs in it."""
    return F.transform(F.array(value), use)[0]


def _total(parts: Column) -> Column:
    return F.aggregate(parts, F.lit(0.0), lambda acc, p: acc + p)


def length(line: Column) -> Column:
    return _total(F.transform(_steps(line), lambda s: F.hypot(s["u"] - s["x"], s["v"] - s["y"])))


def signed_area(ring: Column) -> Column:
    return _total(F.transform(_steps(closed(ring)), lambda s: s["x"] * s["v"] - s["u"] * s["y"])) / 2


def area(ring: Column) -> Column:
    return F.abs(signed_area(ring))


def centroid(ring: Column) -> Column:
    """Area-weighted; the first point of a ring without area."""
    ring, a = closed(ring), signed_area(ring)
    cross = lambda s: s["x"] * s["v"] - s["u"] * s["y"]
    cx = _total(F.transform(_steps(ring), lambda s: (s["x"] + s["u"]) * cross(s)))
    cy = _total(F.transform(_steps(ring), lambda s: (s["y"] + s["v"]) * cross(s)))
    return F.when(a != 0, point(cx / (6 * a), cy / (6 * a))).otherwise(ring[0])


def box_centroid(ring: Column) -> Column:
    """The mean of the first four points."""
    four = F.slice(ring, 1, 4)
    n = F.size(four)
    return point(_total(F.transform(four, lambda p: p["x"])) / n, _total(F.transform(four, lambda p: p["y"])) / n)


def bounds(line: Column) -> Column:
    pick = lambda name, f: f(F.transform(line, lambda p: p[name]))
    return F.struct(pick("x", F.array_min).alias("xmin"), pick("y", F.array_min).alias("ymin"), pick("x", F.array_max).alias("xmax"), pick("y", F.array_max).alias("ymax"))


def at_length(line: Column, where: Column) -> Column:
    """The point `where` metres along; clamped to both ends. A line without length gives its first point."""
    walked = F.aggregate(
        _steps(line),
        F.struct(F.lit(0.0).alias("d"), F.lit(None).cast("struct<x:double,y:double>").alias("p")),
        lambda acc, s: F.when(acc["p"].isNotNull(), acc).otherwise(_step_to(acc, s, where)),
    )
    end = F.when(where <= 0, line[0]).otherwise(F.element_at(line, -1))
    return F.coalesce(walked["p"], end)


def _step_to(acc: Column, s: Column, where: Column) -> Column:
    d = F.hypot(s["u"] - s["x"], s["v"] - s["y"])
    t = F.when(d > 0, (where - acc["d"]) / d).otherwise(0.0)
    here = point(s["x"] + t * (s["u"] - s["x"]), s["y"] + t * (s["v"] - s["y"]))
    reached = (where >= acc["d"]) & (where <= acc["d"] + d)
    return F.struct((acc["d"] + d).alias("d"), F.when(reached, here).alias("p"))


def midpoint(line: Column) -> Column:
    return at_length(line, length(line) / 2)


def point_segment_distance(x: Column, y: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    dx, dy = bx - ax, by - ay
    square = dx * dx + dy * dy
    t = F.when(square > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - ax) * dx + (y - ay) * dy) / square))).otherwise(0.0)
    return F.hypot(x - (ax + t * dx), y - (ay + t * dy))


def distance_to_line(x: Column, y: Column, line: Column) -> Column:
    return F.array_min(F.transform(_steps(line), lambda s: point_segment_distance(x, y, s["x"], s["y"], s["u"], s["v"])))


def in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Ray casting with the half-open edge rule."""
    crosses = lambda s: ((s["y"] > y) != (s["v"] > y)) & (x < (s["u"] - s["x"]) * (y - s["y"]) / F.when(s["v"] != s["y"], s["v"] - s["y"]).otherwise(1.0) + s["x"])
    return F.size(F.filter(_steps(closed(ring)), crosses)) % 2 == 1


def on_ring(x: Column, y: Column, ring: Column) -> Column:
    """By the exact cross product, within the segment's box."""
    between = lambda v, a, b: (v >= F.least(a, b)) & (v <= F.greatest(a, b))
    on = lambda s: ((s["u"] - s["x"]) * (y - s["y"]) == (s["v"] - s["y"]) * (x - s["x"])) & between(x, s["x"], s["u"]) & between(y, s["y"], s["v"])
    return F.exists(_steps(closed(ring)), on)


def inside(x: Column, y: Column, ring: Column) -> Column:
    """Strictly inside: a point on the boundary is out."""
    return in_ring(x, y, ring) & ~on_ring(x, y, ring)


def boxes_disjoint(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """(xmin, ymin, xmax, ymax) each; boxes that touch are not disjoint."""
    return (a[2] < b[0]) | (b[2] < a[0]) | (a[3] < b[1]) | (b[3] < a[1])


def boxes_overlap(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Boxes that only touch do not overlap."""
    return (a[0] < b[2]) & (b[0] < a[2]) & (a[1] < b[3]) & (b[1] < a[3])


def box_intersection_area(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    w = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    h = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    return F.when((w > 0) & (h > 0), w * h).otherwise(w * 0)


def clip_segment(x: Column, y: Column, u: Column, v: Column, ring: Column) -> Column:
    """The parts of a segment inside a ring that may be concave: cut at all crossings, keep parts whose middle is in.
    array<struct<a, b>> of fractions along the segment."""
    dx, dy = u - x, v - y

    def crossing(s: Column) -> Column:
        ex, ey = s["u"] - s["x"], s["v"] - s["y"]
        den = dx * ey - dy * ex
        t = F.try_divide((s["x"] - x) * ey - (s["y"] - y) * ex, den)
        w = F.try_divide((s["x"] - x) * dy - (s["y"] - y) * dx, den)
        return F.when((t > 0) & (t < 1) & (w >= 0) & (w <= 1), t)

    cuts = F.filter(F.transform(_steps(closed(ring)), crossing), lambda t: t.isNotNull())
    cuts = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0.0), F.lit(1.0)), cuts)))
    n = F.size(cuts) - 1
    parts = F.zip_with(F.slice(cuts, 1, n), F.slice(cuts, 2, n), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    return F.filter(parts, lambda p: in_ring(x + dx * (p["a"] + p["b"]) / 2, y + dy * (p["a"] + p["b"]) / 2, ring))


def clipped_length(line: Column, ring: Column) -> Column:
    return _total(F.transform(_steps(line), lambda s: F.hypot(s["u"] - s["x"], s["v"] - s["y"]) * _total(F.transform(clip_segment(s["x"], s["y"], s["u"], s["v"], ring), lambda p: p["b"] - p["a"]))))


def clip_to_box(ring: Column, xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    """A ring cut to a box, side by side (open result; empty where nothing is left). Concave rings may get bridges."""
    sides = [("x", xmin, 1), ("x", xmax, -1), ("y", ymin, 1), ("y", ymax, -1)]

    def cut(points: Column, side: tuple) -> Column:
        axis, at, sign = side
        other = "y" if axis == "x" else "x"
        ins = lambda v: (v - at) * sign >= 0
        far = {"x": "u", "y": "v"}

        def edge(s: Column) -> Column:
            t = (at - s[axis]) / F.when(s[far[axis]] != s[axis], s[far[axis]] - s[axis]).otherwise(1.0)
            o = s[other] + t * (s[far[other]] - s[other])
            hit, b = (point(at, o) if axis == "x" else point(o, at)), point(s["u"], s["v"])
            none = F.array().cast(POINTS)
            return F.when(ins(s[axis]) & ins(s[far[axis]]), F.array(b)).when(ins(s[axis]), F.array(hit)).when(ins(s[far[axis]]), F.array(hit, b)).otherwise(none)

        return F.flatten(F.transform(named(named(points, closed), _steps), edge))

    return reduce(lambda points, side: named(points, lambda p: cut(p, side)), sides, ring)


def translated(line: Column, dx: Column, dy: Column) -> Column:
    return F.transform(line, lambda p: point(p["x"] + dx, p["y"] + dy))


def affine(line: Column, a: Column, b: Column, c: Column, d: Column, e: Column, f: Column) -> Column:
    """x' = a x + b y + c, y' = d x + e y + f: pixels to world and back."""
    return F.transform(line, lambda p: point(a * p["x"] + b * p["y"] + c, d * p["x"] + e * p["y"] + f))


def rotated(x: Column, y: Column, degrees: Column) -> tuple[Column, Column]:
    t = F.radians(degrees)
    return x * F.cos(t) - y * F.sin(t), x * F.sin(t) + y * F.cos(t)


def resampled(xs: Column, ys: Column, at: Column) -> Column:
    """Linear interpolation of (xs, ys) at `at`; clamped to the ends."""
    pairs = F.zip_with(F.slice(F.arrays_zip(xs.alias("a"), ys.alias("b")), 1, F.size(xs) - 1), F.slice(F.arrays_zip(xs.alias("a"), ys.alias("b")), 2, F.size(xs) - 1), lambda p, q: F.struct(p["a"].alias("x"), p["b"].alias("y"), q["a"].alias("u"), q["b"].alias("v")))
    hit = F.filter(pairs, lambda s: (s["x"] <= at) & (at <= s["u"]))
    s = F.get(hit, F.lit(0))
    inner = s["y"] + F.when(s["u"] > s["x"], (at - s["x"]) / (s["u"] - s["x"])).otherwise(0.0) * (s["v"] - s["y"])
    return F.when(at <= xs[0], ys[0]).when(at >= F.element_at(xs, -1), F.element_at(ys, -1)).otherwise(inner)


def inner_point(ring: Column) -> Column:
    """A point inside a ring that may be concave: the middle of the widest span (the first of equal ones) on a scanline
    between the corners next to half height. The first point of a ring without area."""

    def scan(ys: Column) -> Column:
        half = (F.array_min(ys) + F.array_max(ys)) / 2
        return named(half, lambda h: (F.array_max(F.filter(ys, lambda y: y <= h)) + F.array_min(F.filter(ys, lambda y: y > h))) / 2)

    def hits(ring: Column, at: Column) -> Column:
        crossed = F.filter(_steps(ring), lambda s: (s["y"] > at) != (s["v"] > at))
        return F.array_sort(F.transform(crossed, lambda s: s["x"] + (at - s["y"]) * (s["u"] - s["x"]) / (s["v"] - s["y"])))

    def widest(xs: Column) -> Column:
        """Spans lie between hits 0 and 1, 2 and 3, ..."""
        spans = F.transform(xs, lambda x, k: F.when(k % 2 == 0, F.struct((F.get(xs, k + 1) - x).alias("w"), (-k).alias("k"), ((x + F.get(xs, k + 1)) / 2).alias("x"))))
        return F.array_max(F.filter(spans, lambda s: s.isNotNull()))["x"]

    def inside(ring: Column) -> Column:
        at = scan(F.transform(ring, lambda p: p["y"]))
        return named(at, lambda y: named(named(hits(ring, y), widest), lambda x: F.when(x.isNotNull(), point(x, y)).otherwise(ring[0])))

    return named(named(ring, closed), inside)


def box_link(a: Column, b: Column) -> Column:
    """The shortest link (x, y) to (u, v) from box a to box b; in the middle of what they share along an axis."""

    def ends(low: str, high: str) -> tuple[Column, Column]:
        shared = (F.greatest(a[low], b[low]) + F.least(a[high], b[high])) / 2
        here = F.when(b[low] > a[high], a[high]).when(a[low] > b[high], a[low]).otherwise(shared)
        there = F.when(b[low] > a[high], b[low]).when(a[low] > b[high], b[high]).otherwise(shared)
        return here, there

    (x, u), (y, v) = ends("xmin", "xmax"), ends("ymin", "ymax")
    return F.struct(x.alias("x"), y.alias("y"), u.alias("u"), v.alias("v"))


def segment_meets_box(x: Column, y: Column, u: Column, v: Column, box: Column) -> Column:
    """Whether a segment has a point in a box, its sides included."""

    def inside(at: Column, to: Column, low: Column, high: Column) -> tuple[Column, Column]:
        d = to - at
        t, s = F.try_divide(low - at, d), F.try_divide(high - at, d)
        still = (at >= low) & (at <= high)
        return F.when(d == 0, F.when(still, 0.0).otherwise(2.0)).otherwise(F.least(t, s)), F.when(d == 0, F.when(still, 1.0).otherwise(-1.0)).otherwise(F.greatest(t, s))

    (a, b), (c, d) = inside(x, u, box["xmin"], box["xmax"]), inside(y, v, box["ymin"], box["ymax"])
    return F.greatest(F.lit(0.0), a, c) <= F.least(F.lit(1.0), b, d)


def padded_bounds(box: Column, least: float) -> Column:
    """A box grown about its middle to at least `least` each way."""
    x, y = (box["xmin"] + box["xmax"]) / 2, (box["ymin"] + box["ymax"]) / 2
    w, h = F.greatest((box["xmax"] - box["xmin"]) / 2, F.lit(least / 2)), F.greatest((box["ymax"] - box["ymin"]) / 2, F.lit(least / 2))
    return F.struct((x - w).alias("xmin"), (y - h).alias("ymin"), (x + w).alias("xmax"), (y + h).alias("ymax"))


def lat_lng(line: Column) -> Column:
    """Points as (y, x) pairs, as maps take them."""
    return F.transform(line, lambda p: F.array(p["y"], p["x"]))
