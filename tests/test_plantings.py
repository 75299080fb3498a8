import numpy as np
from pyspark.sql import functions as F

from rowfield.functions import geometry as G
from rowfield.operators import plantings as P
from rowfield.operators import routing as R
from rowfield.plans.common import scratch
from rowfield.sources import files

BOX = "xmin double, ymin double, xmax double, ymax double"


def test_links_by_distance_region_and_passage(spark):
    blocks = [
        (1, 1, 0.0, 0.0, 10.0, 10.0),
        (2, 2, 14.0, 0.0, 20.0, 10.0),  # 4 m from 1
        (3, 2, 22.0, 0.0, 30.0, 10.0),  # 2 m from 2, same region
        (4, 3, 35.0, 0.0, 40.0, 10.0),  # exactly 5 m from 3
        (5, 4, 0.0, 13.0, 10.0, 20.0),  # 3 m above 1, a track between
        (6, 5, 12.0, 23.0, 20.0, 30.0),  # across a corner from 5
        (7, 6, 20.0, 30.0, 25.0, 40.0),  # touches 6 at a corner, a track 0.4 m away
        (8, 7, None, 0.0, 1.0, 1.0),
    ]
    passages = [(-5.0, 11.0, 5.0, 12.0), (2.0, 11.0, 8.0, 12.0), (20.4, 29.0, 21.0, 29.9)]
    df = spark.createDataFrame(blocks, f"id long, region long, {BOX}")
    tracks = spark.createDataFrame(passages, BOX)
    found = lambda b, p: sorted(tuple(r) for r in P.planting_links(b, p).collect())
    assert found(df, tracks) == [(1, 2), (5, 6)]
    assert found(df, tracks.limit(0)) == [(1, 2), (1, 5), (5, 6), (6, 7)]
    assert found(df.limit(0), tracks) == []


def test_kept_blocks_are_those_of_one_by_one(spark):
    r = np.random.default_rng(3)
    rows = []
    for i in range(150):
        x, y, w, h = (int(v) for v in (*r.integers(0, 60, 2), *r.integers(1, 20, 2)))
        rows.append((i, int(r.integers(1, 8)), float(x), float(y), float(x + w), float(y + h)))
    kept = []
    for b in sorted(rows, key=lambda b: (-b[1], b[0])):
        area = lambda k: (k[4] - k[2]) * (k[5] - k[3])
        side = lambda k, lo, hi: max(0.0, min(b[hi], k[hi]) - max(b[lo], k[lo]))  # noqa: E731, B023
        if not any(side(k, 2, 4) * side(k, 3, 5) > 0.3 * min(area(b), area(k)) for k in kept):
            kept.append(b)
    df = spark.createDataFrame(rows, f"id long, length long, {BOX}")
    got = sorted(x["id"] for x in P.kept_blocks(df, scratch(spark, "kept")).collect())
    assert got == sorted(b[0] for b in kept) and 0 < len(got) < len(rows)
    assert P.kept_blocks(df.limit(0), scratch(spark, "kept")).isEmpty()
    odd = spark.createDataFrame([(1, 5, None, 0.0, 1.0, 1.0), (2, 5, 0.0, 0.0, 0.0, 0.0)], f"id long, length long, {BOX}")
    assert P.kept_blocks(odd, scratch(spark, "kept")).count() == 2


def test_kept_blocks_of_many_copies(spark):
    r = np.random.default_rng(5)
    rows = []
    for _ in range(60):
        x, y, w, h = (int(v) for v in (*r.integers(0, 40, 2), *r.integers(1, 16, 2)))
        rows += [(0, int(r.integers(1, 6)), float(x), float(y), float(x + w), float(y + h)) for _ in range(int(r.integers(1, 12)))]
    rows += [(0, 9, 70.0, 70.0, 80.0, 71.0)] * 150 + [(0, 9, 70.0, 70.0, 70.0, 71.0)] * 3  # boxes without an area share nothing
    rows = [(i, *row[1:]) for i, row in enumerate(rows[i] for i in r.permutation(len(rows)))]
    kept = []
    for b in sorted(rows, key=lambda b: (-b[1], b[0])):
        area = lambda k: (k[4] - k[2]) * (k[5] - k[3])
        side = lambda k, lo, hi: max(0.0, min(b[hi], k[hi]) - max(b[lo], k[lo]))  # noqa: E731, B023
        if not any(side(k, 2, 4) * side(k, 3, 5) > 0.3 * min(area(b), area(k)) for k in kept):
            kept.append(b)
    df = spark.createDataFrame(rows, f"id long, length long, {BOX}")
    at = scratch(spark, "kept")
    assert sorted(x["id"] for x in P.kept_blocks(df, at).collect()) == sorted(b[0] for b in kept)
    assert spark.read.parquet(f"{at}/open-0").count() < 60 * 60 / 2
    at = scratch(spark, "kept")
    assert sorted(x["id"] for x in P.kept_blocks(df, at, pairs=0, each=0).collect()) == sorted(b[0] for b in kept)
    assert not spark.read.parquet(f"{at}/stay").isEmpty()


def test_lanes_and_turns(spark):
    ring = lambda *p: F.array(*[G.point(F.lit(float(x)), F.lit(float(y))) for x, y in p])
    at = lambda c: [(round(p["x"], 9), round(p["y"], 9)) for p in spark.range(1).select(c.alias("c")).first()["c"]]
    assert at(P.lane_of(ring((0, 0), (10, 0), (10, 2), (0, 2)))) == [(9.7, 1), (0.3, 1)]
    assert at(P.lane_of(ring((0, 0), (2, 0), (2, 10), (0, 10)))) == [(1, 0.3), (1, 9.7)]
    assert spark.range(1).select(P.lane_of(ring((0, 0), (1.5, 0), (1.5, 1), (0, 1))).alias("c")).first()["c"] is None
    assert at(P.u_turn(ring((0, 0), (10, 0)), ring((12, 3), (0, 3)))) == [(13.5, 0), (13.5, 3)]
    assert at(P.u_turn(ring((0, 0), (0, 10)), ring((3, 8), (3, 0)))) == [(0, 11.5), (3, 11.5)]


def test_inner_points_lie_inside(spark):
    shapes = [
        [(0, 0), (10, 0), (10, 10), (0, 10)],
        [(0, 0), (10, 0), (10, 10), (9, 10), (9, 1), (1, 1), (1, 10), (0, 10)],
        [(0, 0), (6, 3), (0, 6), (2, 3)],
        [(0, 0), (4, 0), (2, 7)],
    ]
    df = spark.createDataFrame([([tuple(map(float, p)) for p in s],) for s in shapes], f"ring {G.POINTS}")
    p = df.withColumn("p", G.inner_point(F.col("ring")))
    assert all(r["i"] for r in p.select(G.in_ring(F.col("p.x"), F.col("p.y"), F.col("ring")).alias("i")).collect())
    assert df.limit(1).select(G.inner_point(F.col("ring")).alias("p")).first()["p"] == (5.0, 5.0)
    flat = spark.createDataFrame([([(1.0, 2.0), (3.0, 2.0)],)], f"ring {G.POINTS}")
    assert flat.select(G.inner_point(F.col("ring")).alias("p")).first()["p"] == (1.0, 2.0)


def test_segments_and_boxes(spark):
    df = spark.createDataFrame([(0.0, 0.0, 4.0, 4.0, True), (0.0, 0.0, 0.9, 0.9, False), (2.0, 5.0, 2.0, 2.0, True), (5.0, 0.0, 5.0, 9.0, False), (0.0, 3.0, 1.0, 4.0, False), (2.0, 2.0, 2.0, 2.0, True)], "x double, y double, u double, v double, want boolean")
    box = F.struct(*[F.lit(v).alias(n) for n, v in (("xmin", 1.0), ("ymin", 1.0), ("xmax", 3.0), ("ymax", 3.0))])
    assert all(r["got"] == r["want"] for r in df.withColumn("got", G.segment_meets_box(*[F.col(c) for c in "xyuv"], box)).collect())


def test_tracks_searches_and_pages(spark):
    t = spark.createDataFrame([("a", 1, 0.0, 0.0), ("a", 2, 5.0, 1.0), ("a", 3, 10.0, 4.0), ("b", 1, 0.0, 7.0)], "track string, n int, x double, y double")
    assert [r["expected"] for r in P.track_ahead(t, 5.0).orderBy("track", "n").collect()] == [0.0, 1.0, 6.0, 7.0]
    rows = spark.createDataFrame([("v1-r1", "v1", "regular"), ("v1-r2", "v1", "disrupted"), ("v2-r1", "v2", None)], "row_id string, vineyard_id string, row_structure string")
    hits = lambda q: sorted(r["row_id"] for r in P.row_search(rows, F.lit(q)).collect())
    assert hits("") == hits(None) == ["v1-r1", "v1-r2", "v2-r1"]
    assert hits("V1") == ["v1-r1", "v1-r2"] and hits("v2-r1") == ["v2-r1"] and hits("DIS") == ["v1-r2"] and hits("gular") == []
    lines = spark.createDataFrame([("j", i, f"line {i}") for i in range(5)] + [("k", 9, "only")], "job string, at long, text string")
    page = P.log_page(lines, F.lit(3)).orderBy("job", "at").collect()
    assert [(r["job"], r["line"], r["n"], r["text"]) for r in page] == [("j", 3, 5, "line 3"), ("j", 4, 5, "line 4")]


def test_second_tracks_on_a_row_go(spark):
    line = lambda b, i, x, y, n: (b, i, x, [y] * n)
    rows = [
        line(1, 1, 0, 0.0, 20), line(1, 2, 0, 0.2, 30),  # the longer one stays
        line(1, 3, 0, 1.0, 20), line(1, 4, 50, 1.1, 20),  # no common extent
        line(1, 5, 15, 2.0, 20), line(1, 6, 30, 2.1, 20),  # 4 of 20 in common
        line(2, 7, 0, 0.0, 20), line(2, 8, 0, 0.1, 20),  # of equal ones the first
        (3, 9, 0, None),
    ]
    df = spark.createDataFrame(rows, P.ROWS)
    assert sorted(r["id"] for r in P.distinct_rows(df, 1.0).collect()) == [2, 3, 4, 5, 6, 7]
    assert P.distinct_rows(df.limit(0), 1.0).isEmpty()


def test_path_lengths_off_the_ground(spark):
    tree = spark.createDataFrame([(1, 1, 0.0, 0.0, True), (2, 1, 3.0, 4.0, True), (3, 2, 3.0, 6.0, False), (4, 3, 3.0, 7.0, True)], "node long, parent long, x double, y double, passable boolean")
    got = {r["node"]: (r["length_m"], r["off_m"]) for r in R.path_lengths(tree, scratch(spark, "lengths")).collect()}
    assert got == {1: (0.0, 0.0), 2: (5.0, 0.0), 3: (7.0, 2.0), 4: (8.0, 3.0)}


def test_uploads_and_parameters(spark, tmp_path):
    rows = [(1, None, 1, True, True), (1, "a.TIFF", 50 << 20, True, True), (1, "b.tif", (50 << 20) + 1, True, True), (1, "c.tif.png", 1, True, True), (1, "d.tif", 1, None, True), (1, "e.tif", 1, True, None)]
    checked = files.upload_checks(spark.createDataFrame(rows, "request int, filename string, bytes long, readable boolean, has_crs boolean"))
    assert {r["filename"]: r["ok"] for r in checked.collect()} == {"unnamed.tif": True, "a.TIFF": True, "b.tif": False, "c.tif.png": False, "d.tif": False, "e.tif": False}
    model = {"rows": {"P": 2.5}, "vines": {"gap": 1.0}}
    assert files.parameters(spark, files.write_parameters(str(tmp_path / "m" / "model.json"), model)) == model
