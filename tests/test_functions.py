from math import hypot, pi

import pytest
from pyspark.sql import functions as F

from rowfield.functions import geometry as G
from rowfield.functions import scalars as S


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def line(*points):
    return F.array(*[G.point(F.lit(float(x)), F.lit(float(y))) for x, y in points])


def test_lengths_areas_and_centroids(spark):
    ell = line((0, 0), (4, 0), (4, 1), (1, 1), (1, 3), (0, 3))
    assert value(spark, G.area(ell)) == 6 and value(spark, G.length(line((0, 0), (3, 4), (3, 5)))) == 6
    c = value(spark, G.centroid(ell))
    assert (c["x"], c["y"]) == (pytest.approx((4 * 2 + 2 * 0.5) / 6), pytest.approx((4 * 0.5 + 2 * 2) / 6))
    assert value(spark, F.size(G.closed(ell))) == 7 and value(spark, F.size(G.closed(G.closed(ell)))) == 7
    assert value(spark, G.length(line((1, 1)))) == 0 and value(spark, F.size(G.closed(F.array().cast(G.POINTS)))) == 0


def test_midpoints(spark):
    m = value(spark, G.midpoint(line((0, 0), (2, 0), (2, 6))))
    assert (m["x"], m["y"]) == (2, 2)
    m = value(spark, G.midpoint(line((7, 8), (7, 8))))
    assert (m["x"], m["y"]) == (7, 8)  # a line without length: its first point


def test_points_in_rings(spark):
    ring = line((0, 0), (4, 0), (4, 4), (2, 1), (0, 4))
    inside = lambda x, y: value(spark, G.inside(F.lit(float(x)), F.lit(float(y)), ring))
    assert inside(1, 1) and not inside(2, 2) and not inside(0, 2) and not inside(5, 1)


def test_clipping_lines_to_concave_areas(spark):
    ring = line((0, 0), (6, 0), (6, 4), (4, 4), (4, 1), (2, 1), (2, 4), (0, 4))
    assert value(spark, G.clipped_length(line((-1, 2), (7, 2)), ring)) == pytest.approx(4)
    parts = value(spark, G.clip_segment(F.lit(-1.0), F.lit(2.0), F.lit(7.0), F.lit(2.0), ring))
    assert len(parts) == 2
    box = G.clip_to_box(line((0, 0), (10, 0), (10, 10), (0, 10)), F.lit(5.0), F.lit(-1.0), F.lit(20.0), F.lit(4.0))
    assert value(spark, G.area(box)) == 20


def test_boxes_that_touch(spark):
    box = lambda *v: tuple(F.lit(x) for x in v)
    a, b = box(0, 0, 2, 2), box(2, 0, 4, 2)
    assert not value(spark, G.boxes_disjoint(a, b)) and not value(spark, G.boxes_overlap(a, b))
    assert value(spark, G.box_intersection_area(box(0, 0, 2, 2), box(1, 1, 3, 3))) == 1


def test_turns_and_directions(spark):
    num = lambda f, *v: value(spark, f(*[F.lit(float(x)) for x in v]))
    assert num(S.turn_length, 2.5, 0) == 2.5
    assert num(S.turn_length, 5, 2) == pytest.approx(2 * pi + 1)
    assert num(S.turn_length, 3, 2) == pytest.approx(2 * pi + 3)
    assert num(S.turn, 350, 20) == "bear right" and num(S.turn, 10, 20) == "straight" and num(S.turn, 0, 200) == "turn around" and num(S.turn, 90, 0) == "turn left"
    assert value(spark, S.angle_between(F.lit(179.0), F.lit(2.0), 180.0)) == 3
    assert num(S.bearing, 0, 0, 1, 0) == 90 and num(S.compass, 359) == "north" and num(S.compass, 200) == "south"


def test_classes_at_their_limits(spark):
    cover = lambda v, o=0.0: value(spark, S.cover(F.lit(v), o))
    assert [cover(0.24), cover(0.25), cover(0.75), cover(0.76), cover(0.1, 0.6)] == ["bare_soil", "mixed", "mixed", "vegetation", "unassessable"]
    structure = lambda g, c=1.0: value(spark, S.row_structure(F.lit(g), F.lit(c)))
    assert [structure(4.99), structure(5.0), structure(9.0, 0.2)] == ["regular", "disrupted", "unassessable"]
    assert value(spark, S.inspector_weight(F.lit("inspection"), F.lit("not a number"))) == 1
    assert value(spark, S.inspector_weight(F.lit("inspection"), F.lit("5.25"))) == pytest.approx(1.525)
    assert value(spark, S.inspector_weight(F.lit("waste"), F.lit(None))) == 3
    assert value(spark, S.utm_code(F.lit(28.7), F.lit(47.1))) == 32635


def test_point_text_and_interpolation(spark):
    points = value(spark, S.points_of(F.lit("1,2;3.5,-4")))
    assert [(p["x"], p["y"]) for p in points] == [(1, 2), (3.5, -4)]
    assert value(spark, S.points_text(S.points_of(F.lit("1,2;3.55,-4")), 1)) == "1.0,2.0;3.6,-4.0"
    xs, ys = F.array(*map(F.lit, (0.0, 2.0, 4.0))), F.array(*map(F.lit, (1.0, 3.0, 0.0)))
    assert [value(spark, G.resampled(xs, ys, F.lit(v))) for v in (-1.0, 1.0, 3.0, 9.0)] == [1, 2, 1.5, 0]
    assert value(spark, G.distance_to_line(F.lit(1.0), F.lit(2.0), line((0, 0), (4, 0), (4, 4)))) == 2
    assert hypot(3, 4) == value(spark, F.hypot(F.lit(3.0), F.lit(4.0)))
    assert value(spark, S.listed(F.array(*[F.lit(str(i)) for i in range(12)]), 3)) == "0, 1, 2, ..."


def test_utm_to_degrees(spark):
    from rowfield.functions.projection import lon_lat

    # the central meridian, and a round trip through the forward series on a sphere-free identity: 500 km is the meridian
    lon, lat = lon_lat(F.lit(500000.0), F.lit(0.0), 35)
    assert (value(spark, lon), value(spark, lat)) == (27.0, 0.0)
    lon, lat = lon_lat(F.lit(500000.0), F.lit(4982950.4), 31)  # 45 degrees north on zone 31's meridian
    assert value(spark, lon) == pytest.approx(3.0) and value(spark, lat) == pytest.approx(45.0, abs=1e-6)
    lon, lat = lon_lat(F.lit(448251.898), F.lit(5411943.794), 31)  # a known point: 2.2945 E, 48.8582 N
    assert value(spark, lon) == pytest.approx(2.2945, abs=1e-4) and value(spark, lat) == pytest.approx(48.8582, abs=2e-4)
