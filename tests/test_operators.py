import numpy as np
import pytest
from pyspark.sql import functions as F

from rowfield.operators import measure as M
from rowfield.operators import routing as R
from rowfield.operators import signals as Z
from rowfield.operators import spatial as X
from rowfield.operators import stitch as H
from rowfield.operators import targets as T
from rowfield.sources import demo, files


def test_union_of_overlapping_boxes(spark):
    df = spark.createDataFrame([("a", 0, 0, 2, 2), ("a", 1, 0, 3, 2), ("b", 0, 0, 5, 5), ("b", 0, 0, 5, 5), ("b", 7, 7, 7, 9)], "g string, x0 long, y0 long, x1 long, y1 long")
    assert {r["g"]: r["area"] for r in M.box_unions(df, "g").collect()} == {"a": 6, "b": 25}


def test_unions_against_cells(spark):
    r = np.random.default_rng(1)
    rows, want = [], {}
    for g in range(4):
        seen = np.zeros((60, 60), bool)
        for _ in range(40):
            x, y, w, h = (int(v) for v in r.integers(0, 25, 4))
            rows.append((g, x, y, x + w, y + h))
            seen[y : y + h, x : x + w] = True
        want[g] = int(seen.sum())
    df = spark.createDataFrame(rows, "g int, x0 long, y0 long, x1 long, y1 long")
    assert {r["g"]: r["area"] for r in M.box_unions(df, "g").collect()} == want


def test_row_pieces_add_up(spark):
    df = spark.createDataFrame([(1, "V01", "r", "t1", 30.0), (2, "V01", "r", "t2", 12.0), (3, "V01", "r", "t2", 5.0)], "piece long, vineyard_id string, row_id string, tile string, length_m double")
    assert [(r["length_m"], r["pieces"]) for r in M.row_lengths(df).collect()] == [(47.0, 3)]
    assert {r["tile"]: r["length_m"] for r in M.tile_row_lengths(df, "last").collect()} == {"t1": 30.0, "t2": 5.0}
    with pytest.raises(ValueError):
        M.tile_row_lengths(df, "first")


def test_demo_block(spark):
    m = demo.metrics(spark).first()
    assert (m["canopy_area_m2"], m["interrow_area_m2"], m["extent_m2"], m["row_length_m"], m["row_count"], m["canopy_count"]) == (139.2, 225.0, 720.0, 120.0, 4, 40)
    d = {(r["source"], r["place"]): r["metres"] for r in demo.stop_distances(spark).collect()}
    assert [d["start", "T01"], d["start", "T02"], d["start", "W01"], d["T01", "T02"], d["T02", "W01"], d["T01", "W01"]] == [28.5, 36.5, 19.0, 25.0, 32.5, 27.5]
    assert tuple(demo.tour(spark).first()) == ("T01,T02,W01", 105.0, 168.0, 63.0, 37.5)


def test_offsets_fall_into_rows(spark):
    df = spark.createDataFrame([(i, "V", o, 2.5) for i, o in enumerate((0.0, 0.9, 2.5, 5.0))], "piece int, vineyard_id string, offset double, spacing double")
    assert [r["row_no"] for r in H.numbered_rows(df).orderBy("piece").collect()] == [1, 1, 2, 3]


def test_stitching_by_axes(spark):
    box = lambda i, t, a, x: (i, t, a, x, 0.0, x + 10, 10.0)
    rows = [box(1, "a", 179.0, 0.0), box(2, "b", 2.0, 12.9), box(3, "c", 90.0, 25.0), box(4, "d", None, 37.9), box(5, "a", 0.0, 3.0), box(6, "e", 0.0, 60.0)]
    df = spark.createDataFrame(rows, "id int, tile string, angle double, xmin double, ymin double, xmax double, ymax double")
    assert {(r["a"], r["b"]) for r in H.stitch_edges(df).collect()} == {(1, 2), (2, 5), (3, 4)}


def test_components_of_chains_and_lone_nodes(spark, tmp_path):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 50), (100, 51)], "a long, b long")
    nodes = spark.createDataFrame([(i,) for i in [*range(41), 50, 51, 100, 7000]], "node long")
    got = {r["node"]: r["root"] for r in X.components(nodes, edges, f"file://{tmp_path}").collect()}
    assert got == {**dict.fromkeys(range(41), 0), 50: 50, 51: 50, 100: 50, 7000: 7000}


def test_closing_and_islands(spark):
    bits = "0110111000011100000001"
    df = spark.createDataFrame([(1, i, b == "1") for i, b in enumerate(bits)], "id int, pos int, on boolean")
    assert [(r["start"], r["n"]) for r in Z.islands(df).orderBy("start").collect()] == [(1, 2), (4, 3), (11, 3), (21, 1)]
    on = np.array([b == "1" for b in bits])
    pad = lambda v, k, f, e: np.array([f([v[j] if 0 <= j < len(v) else e for j in range(i - k, i + k + 1)]) for i in range(len(v))])
    want = pad(pad(on, 2, any, False), 2, all, False)
    assert [r["closed"] for r in Z.closing(df, 2).orderBy("pos").collect()] == want.tolist()
    want = pad(pad(on, 1, all, False), 1, any, False)
    assert [r["opened"] for r in Z.opening(df, 1).orderBy("pos").collect()] == want.tolist()
    g = Z.gap_totals(df).first()
    assert (g["gaps"], g["longest"], g["total"]) == (4, 7, 13)


def test_spaced_peaks_keep_the_taller(spark):
    df = spark.createDataFrame([(1, 3, 0.5), (1, 5, 0.9), (1, 8, 0.4), (1, 20, 0.1)], "id int, pos int, v double")
    assert [r["pos"] for r in Z.spaced_peaks(df, 4).orderBy("pos").collect()] == [5, 20]


def test_tours():
    r = np.random.default_rng(2)
    xy = r.random((8, 2)) * 100
    d = np.hypot(*(xy[:, None] - xy[None]).transpose(2, 0, 1))
    order, best = R.exact_tour(d)
    near = R.nearest_tour(d)
    better = R.improved_tour(d, near)
    assert best <= R.tour_length(d, better) + 1e-9 <= R.tour_length(d, near) + 2e-9
    assert sorted(order[1:-1]) == list(range(1, 8)) and better[0] == better[-1] == 0
    tour, length = R.prize_tour(d, [0, 1, 1, 1, 1, 1, 1, 1], best / 2)
    assert length <= best / 2 and len(set(tour)) == len(tour) - 1
    assert R.exact_tour(np.zeros((1, 1))) == ([0, 0], 0.0)


def test_a_star_goes_round_walls():
    free = {(r, c) for r in range(10) for c in range(10)} - {(r, 5) for r in range(9)}
    path = R.a_star(free, (0, 0), (0, 9), 1.0)
    adjacent = {n: [((n[0] + a, n[1] + b), float(np.hypot(a, b))) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a or b) and (n[0] + a, n[1] + b) in free] for n in free}
    metres, _ = R.shortest(adjacent, (0, 0))
    assert sum(np.hypot(a[0] - b[0], a[1] - b[1]) for a, b in zip(path, path[1:])) == pytest.approx(metres[0, 9])
    assert R.a_star(free - {(9, 5)}, (0, 0), (0, 9), 1.0) is None


def test_lane_cover_is_minimal(spark):
    rows = [("b", "x", 0, 3), ("b", "y", 2, 6), ("b", "z", 1, 4), ("b", "u", 5, 9), ("b", "v", 7, 9), ("b", "w", 12, 13)]
    got = R.lane_cover(spark.createDataFrame(rows, "block string, lane string, first long, last long")).first()
    assert got["lanes"] == ["x", "y", "v", "w"] or got["lanes"] == ["x", "y", "u", "w"]


def test_viterbi_and_merged_steps(spark):
    df = spark.createDataFrame([(1, 1, [[1.0, 9.0], [9.0, 9.0]]), (1, 2, [[5.0, 1.0], [0.0, 0.0]])], "walk int, stage int, c array<array<double>>")
    assert R.cheapest_variants(df).first()["cost"] == 2
    steps = spark.createDataFrame([(1, 1, 10.0, 0.0), (1, 2, 20.0, 10.0), (1, 3, 2.0, 90.0), (1, 4, 30.0, 90.0)], "walk int, ord int, metres double, heading double")
    assert [(r["metres"], r["heading"]) for r in R.merged_steps(steps).orderBy("step").collect()] == [(32.0, 10.0), (30.0, 90.0)]


def test_pointer_doubling(spark, tmp_path):
    tree = spark.createDataFrame([(0, 0, 9.0), (1, 0, 1.0), (2, 1, 2.0), (3, 2, 3.0), (4, 3, 4.0)], "node int, parent int, w double")
    assert {r["node"]: r["total"] for r in R.path_sums(tree, f"file://{tmp_path}").collect()} == {0: 0, 1: 1, 2: 3, 3: 6, 4: 10}


def test_targets(spark):
    rows = spark.createDataFrame([("V", f"r{i}", c) for i, c in enumerate((0.9, 0.2, 0.8, 0.3, 0.7))], "vineyard_id string, row_id string, confidence double")
    assert {(r["row_id"], r["reason"]) for r in T.audit_sample(rows).collect()} == {("r1", "low confidence"), ("r3", "low confidence"), ("r2", "median sample")}
    spots = spark.createDataFrame([(1, 1, 10, 0.0, 0.0), (1, 2, 11, 1.0, 0.0), (1, 3, 12, 2.2, 0.0)], "block int, ord int, id long, x double, y double")
    assert {r["id"]: r["seed"] for r in T.co_located(spots).collect()} == {10: 10, 11: 10, 12: 12}
    cap = T.capped(spots, 2).first()
    assert not cap["routable"] and cap["message"].startswith("3 targets")


def test_override_replaces_whole_tiles(spark):
    a = spark.createDataFrame([("t1", 1), ("t1", 2), ("t2", 3)], "tile string, v int")
    b = spark.createDataFrame([("t1", 9)], "tile string, v int")
    assert {(r["tile"], r["v"]) for r in X.override(a, b).collect()} == {("t1", 9), ("t2", 3)}


def test_annotation_files_skip_unknown_tiles(spark, tmp_path):
    (tmp_path / "a.xml").write_text("""<annotations><image id="1" name="dir/r001_c002" width="2048" height="2048"><polygon label="vineyard" points="0,0;4,0;4,2"><attribute name="row_id">R1</attribute></polygon><box label="waste" xtl="1" ytl="2" xbr="3" ybr="5"/></image><image id="2" name="other"><polyline label="row" points="0,0;3,4"/></image></annotations>""")
    found = files.read_annotations(spark, f"file://{tmp_path}/a.xml", spark.createDataFrame([("r001_c002",)], "tile string"))
    assert found["row"].count() == 0
    ring = found["canopy"].first()
    assert len(ring["ring"]) == 4 and ring["attributes"] == {"row_id": "R1"}
    assert found["waste"].select(F.size("ring").alias("n")).first()["n"] == 5
    all_rows = files.read_annotations(spark, f"file://{tmp_path}/a.xml")["row"]
    assert all_rows.count() == 1


def test_geojson_sources(spark, tmp_path):
    (tmp_path / "z.geojson").write_text('{"type":"FeatureCollection","features":[{"type":"Feature","properties":{"type":"Passage"},"geometry":{"type":"Polygon","coordinates":[[[0,0],[2,0],[2,2],[0,0]]]}},{"type":"Feature","properties":{"name":"x"},"geometry":{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,0]]]}},{"type":"Feature","properties":{},"geometry":{"type":"Point","coordinates":[5,6]}}]}')
    at = f"file://{tmp_path}/z.geojson"
    (zone,) = files.read_zones(spark, at).collect()
    assert zone["zone"] == "passage" and len(zone["ring"]) == 4
    assert tuple(files.read_start(spark, at).first()) == (5.0, 6.0)


def test_tile_catalog_reads_names_only(spark, tmp_path):
    for name in ("site_r001_c002.tif", "r010_c000.tiff", "notes.tif"):
        (tmp_path / name).write_bytes(b"x" * 5)
    got = {r["tile"]: (r["bytes"], r["tile_row"], r["tile_col"], r["xmin"]) for r in files.tile_catalog(spark, f"file://{tmp_path}").collect()}
    assert got == {"r001_c002": (5, 1, 2, 102.4), "r010_c000": (5, 10, 0, 0.0)}


def test_numbers_are_unique_and_in_order(spark, tmp_path):
    from rowfield.operators import stitch as H
    from rowfield.operators import targets as T

    n = 400_000
    df = spark.range(n).select("id", (F.col("id") * 7919 % 1000).cast("double").alias("x"), (F.col("id") * 104_729 % 977).cast("double").alias("y"))
    out = T.sequence_ids(df.repartition(7), "I", f"file://{tmp_path}/sequence").toPandas().sort_values(["y", "x", "id"], ascending=[False, True, True])
    assert out["sequence_id"].tolist() == [f"I{i:04d}" for i in range(1, n + 1)]
    blocks = spark.range(150).select("id", (F.col("id") % 5).cast("double").alias("x"), (F.col("id") * 10).cast("double").alias("y"))
    got = {r["id"]: r["vineyard_id"] for r in H.numbered_blocks(blocks, f"file://{tmp_path}/blocks").collect()}
    assert sorted(got.values()) == sorted(f"V{i:02d}" for i in range(1, 151))
    lanes = spark.range(120).select(F.lit(1).alias("block"), F.col("id").alias("offset"), F.col("id").alias("lane"), F.lit(0).alias("x0"), F.lit(9).alias("x1"))
    assert {r["lane_id"] for r in R.serpentine(lanes).collect()} == {f"L{i:02d}" for i in range(1, 121)}
    assert T.sequence_ids(df.limit(0), "I", f"file://{tmp_path}/none").count() == 0


def test_long_paths_end(spark, tmp_path):
    import pytest

    tree = spark.range(1000).select(F.col("id").alias("node"), F.greatest(F.col("id") - 1, F.lit(0)).alias("parent"), F.lit(1.0).alias("w"))
    assert {r["node"]: r["total"] for r in R.path_sums(tree, f"file://{tmp_path}/paths").collect()} == {i: i for i in range(1000)}
    with pytest.raises(ValueError):
        R.path_sums(spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (3, 1, 1.0)], "node long, parent long, w double"), f"file://{tmp_path}/cycle")


def test_copies_of_places_and_boxes_are_joined_once(spark, monkeypatch):
    made, join = [], X.overlapping
    monkeypatch.setattr(X, "overlapping", lambda *a: made.append(join(*a)) or made[-1])
    points = spark.createDataFrame([(i, 1.0, 5.0) for i in range(60)] + [(60, 40.0, 5.0), (61, None, 5.0), (62, 12.0, 5.0)], "id long, x double, y double")
    boxes = spark.createDataFrame([(i, 0.0, 0.0, 2.0, 2.0) for i in range(70, 10, -1)] + [(5, 9.0, 0.0, 11.0, 3.0), (4, 0.0, 8.0, 2.0, 9.0)], "id long, xmin double, ymin double, xmax double, ymax double")
    dy = F.greatest(F.col("r.ymin") - F.col("l.y"), F.col("l.y") - F.col("r.ymax"), F.lit(0.0))
    dx = F.greatest(F.col("r.xmin") - F.col("l.x"), F.col("l.x") - F.col("r.xmax"), F.lit(0.0))
    got = {r["id"]: (r["nearest"], r["distance"]) for r in X.nearest_within(points, boxes, 10.0, F.hypot(dx, dy), "id").collect()}
    assert got == {i: ("4", 3.0) for i in range(60)} | {60: ("", None), 61: ("", None), 62: ("5", 5**0.5)}
    assert made[0].count() <= 9


def test_scores_of_crowded_boxes(spark, tmp_path):
    r = np.random.default_rng(7)
    sides = [{f"{p}{i}": tuple(map(float, (x, y, x + w, y + h))) for i, (x, y, w, h) in enumerate(zip(*r.integers(0, 25, (2, 300)), *r.integers(1, 14, (2, 300)), strict=True))} for p in "tf"]
    area = lambda b: (b[2] - b[0]) * (b[3] - b[1])
    pairs = []
    for t, a in sides[0].items():
        for f, b in sides[1].items():
            both = max(min(a[2], b[2]) - max(a[0], b[0]), 0) * max(min(a[3], b[3]) - max(a[1], b[1]), 0)
            if round(both / (area(a) + area(b) - both), 9) >= 0.5:
                pairs.append((-round(both / (area(a) + area(b) - both), 9), t, f))
    best_t = {t: min((s, f) for s, u, f in pairs if u == t) for _, t, _ in pairs}
    best_f = {f: min((s, t) for s, t, g in pairs if g == f) for _, _, f in pairs}
    hits = [-s for t, (s, f) in best_t.items() if best_f[f][1] == t]
    frame = lambda d: spark.createDataFrame([(k, *b) for k, b in d.items()] + [("none", None, 0.0, 1.0, 1.0), ("flat", 0.0, 0.0, 0.0, 5.0)], "name string, xmin double, ymin double, xmax double, ymax double")
    for tile in (6.0, 17.0, None):
        got = M.match_scores(frame(sides[0]), frame(sides[1]), 300, 300, f"{tmp_path}/{tile}", tile=tile).first()
        assert (got["hits"], got["f1"]) == (len(hits), round(2 * len(hits) / 600, 6)) and abs(got["mean_iou"] - sum(hits) / len(hits)) < 2e-6
    assert spark.read.parquet(f"{tmp_path}/None").count() < len(hits) < len(pairs)
    empty = M.match_scores(frame({}).limit(0), frame({}).limit(0), 0, 0, f"{tmp_path}/empty").first()
    assert tuple(empty) == (0, None, 0.0)


def test_boxes_are_as_near_as_their_pieces(spark):
    r = np.random.default_rng(5)
    boxes = [(int(i), x, y, x + w, y + h) for i, (x, y, w, h) in enumerate(zip(*(r.integers(-60, 60, (2, 150)) / 4), *(r.integers(0, 60, (2, 150)) / 8), strict=True))]
    boxes += [(200, 1.0, 1.0, 0.5, 3.0), (201, None, 0.0, 1.0, 1.0), (202, 0.0, 0.0, None, 1.0), (203, 0.1, -0.3, 29.7, 0.1)]
    points = [(i, float(x), float(y)) for i, (x, y) in enumerate(zip(*(r.integers(-170, 170, (2, 200)) / 10), strict=True))]
    frame = spark.createDataFrame([tuple(map(lambda v: v if v is None else float(v), b[1:])) + (b[0],) for b in boxes], "xmin double, ymin double, xmax double, ymax double, id long")
    dy = F.greatest(F.col("r.ymin") - F.col("l.y"), F.col("l.y") - F.col("r.ymax"), F.lit(0.0))
    dx = F.greatest(F.col("r.xmin") - F.col("l.x"), F.col("l.x") - F.col("r.xmax"), F.lit(0.0))
    spots = spark.createDataFrame(points, "id long, x double, y double")
    found = lambda piece: sorted(tuple(r) for r in X.nearest_within(spots, frame, 0.7, F.hypot(dx, dy), "id", piece=piece).select("id", "nearest", "distance").collect())
    whole = found(None)
    assert sum(n != "" for _, n, _ in whole) > 50 and sum(n == "" for _, n, _ in whole) > 20
    assert found(1.3) == found(2.5) == whole
