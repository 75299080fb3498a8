"""Queries that hold the whole of their tables, against brute force."""

from rowfield.plans import measuring, spatial
from rowfield.sources import driver

SF = "/root/testdata/sf0.001"


def test_every_row_of_a_tile_has_its_place(spark):
    by_tile = {}
    for r in driver.row_pieces(spark, SF).collect():
        if r["length_m"] >= 2.0:
            by_tile.setdefault(r["tile"], []).append((r["vineyard_id"], r["row_id"], r["piece"]))
    want = sorted((t, n, x[2]) for t, rows in by_tile.items() for n, x in enumerate(sorted(rows), 1))
    assert max(n for _, n, _ in want) > 3
    assert sorted(tuple(r) for r in spatial.QUERIES["tile_positions"][0](spark, SF).collect()) == want


def test_all_boxes_are_scored(spark):
    boxes = {(r["block"], r["x0"], r["y0"], r["x1"], r["y1"]) for r in driver.canopies(spark, SF).collect() if r["x1"] > r["x0"]}
    near, best_t, best_f = {}, {}, {}
    for b in boxes:
        near.setdefault(b[0], []).append(b)
    for block in near.values():
        for t in block:
            for f in block:
                w, h = min(t[3], f[3] + 20) - max(t[1], f[1] + 20), min(t[4], f[4] + 10) - max(t[2], f[2] + 10)
                both = max(w, 0) * max(h, 0)
                iou = round(both / ((t[3] - t[1]) * (t[4] - t[2]) + (f[3] - f[1]) * (f[4] - f[2]) - both), 9)
                if iou >= 0.5:
                    tn, fn = "_".join(map(str, t)), "_".join(map(str, f))
                    best_t[tn] = min(best_t.get(tn, (0, "")), (-iou, fn))
                    best_f[fn] = min(best_f.get(fn, (0, "")), (-iou, tn))
    hits = [-i for t, (i, f) in best_t.items() if best_f[f][1] == t]
    got = measuring.QUERIES["detection_scores"][0](spark, SF).first()
    assert got["hits"] == len(hits) > 0
    assert abs(got["mean_iou"] - sum(hits) / len(hits)) < 1e-5 and got["f1"] == round(len(hits) / len(boxes), 6)


def test_walks_reach_the_whole_site(spark):
    from math import ceil, hypot, sqrt

    from rowfield.plans import routes

    spans = lambda a, b: range(ceil(a - 0.5), ceil(b - 0.5))
    ground, blocked = set(), set()
    for layer, out in ((driver.interrows, ground), (driver.canopies, blocked)):
        for s in layer(spark, SF).collect():
            out.update((s["block"], r, c) for r in spans(s["y0"] / 100, s["y1"] / 100) for c in spans(s["x0"] / 100, s["x1"] / 100))
    scopes = {s["block"] for s in driver.interrows(spark, SF).collect()}
    for s in scopes:
        ground.update((s, r, c) for r in range(100) for c in range(2))
        blocked.update((s, r, c) for r in range(10, 20) for c in range(20, 30))
    free = ground - blocked
    assert {tuple(r) for r in routes.walk_cells(spark, SF).collect()} == free and max(c for _, _, c in free) > 120
    steps = lambda s, r, c: [(a, b) for a, b in ((0, 1), (1, 0), (1, 1), (1, -1)) if (s, r + a, c + b) in free and (not a or not b or {(s, r + a, c), (s, r, c + b)} <= free)]
    want = {}
    for s, r, c in free:
        for a, b in steps(s, r, c):
            want.setdefault(s, []).append(sqrt(a * a + b * b))
    assert {r["scope"]: (r["edges"], r["metres"], r["diagonals"]) for r in routes.walk_edges(spark, SF).collect()} == {s: (len(m), round(sum(m), 4), sum(x > 1 for x in m)) for s, m in want.items()}
    got = {r["id"]: r for r in routes.snapped_targets(spark, SF).collect()}
    targets = driver.spots(spark, SF).where("kind = 'inspection'").collect()
    assert got.keys() == {t["id"] for t in targets} and max(t["x"] for t in targets) > 60
    for t in targets:
        d = [hypot(t["x"] - c - 0.5, t["y"] / 4 - r - 0.5) for s, r, c in free if s == t["id"] % 25]
        moved = got[t["id"]]["moved"]
        assert moved is None if min(d) > 15 else abs(moved - min(d)) < 1e-5


def test_pieces_are_stitched_across_tiles(spark):
    from rowfield.plans import routes

    edges = routes.stitch_edges(spark, SF).count()
    sizes = [r["pieces"] for r in routes.stitched_blocks(spark, SF).collect()]
    assert edges > 100 and sum(n > 1 for n in sizes) > 20 and max(sizes) > 5 and len(sizes) > 50


def test_copies_of_strips_add_no_pairs_to_places(spark, tmp_path, monkeypatch):
    from rowfield.operators import spatial as X

    made, join = [], X.overlapping
    monkeypatch.setattr(X, "overlapping", lambda *a: made.append(join(*a)) or made[-1])
    for name, copies in (("once", 1), ("often", 20)):
        part = spark.read.parquet(f"{SF}/part.parquet")
        # a shift by a multiple of the periods of all coordinates
        part.crossJoin(spark.range(copies)).selectExpr("p_partkey + 64000 * id AS p_partkey", "p_size").write.parquet(f"{tmp_path}/{name}/part.parquet")
        spark.read.parquet(f"{SF}/events.parquet").write.parquet(f"{tmp_path}/{name}/events.parquet")
    once, often = (sorted(tuple(r) for r in spatial.QUERIES["place_context"][0](spark, f"{tmp_path}/{name}").collect()) for name in ("once", "often"))
    assert once == often and any(p.startswith("strip") for _, p in once)
    assert made[0].count() == made[1].count()


def test_lengths_of_strips_add_few_pairs_to_places(spark, tmp_path, monkeypatch):
    from rowfield.operators import spatial as X

    made, join = [], X.overlapping
    monkeypatch.setattr(X, "overlapping", lambda *a: made.append(join(*a)) or made[-1])
    for name, copies in (("once", 1), ("often", 20)):
        part = spark.read.parquet(f"{SF}/part.parquet")
        # the same places, at 20 lengths each
        part.crossJoin(spark.range(copies)).selectExpr("p_partkey + 64000 * id AS p_partkey", "CAST(p_size + 2 * id AS INT) AS p_size").write.parquet(f"{tmp_path}/{name}/part.parquet")
        spark.read.parquet(f"{SF}/events.parquet").write.parquet(f"{tmp_path}/{name}/events.parquet")
        strips = [(r["id"], r["x0"] / 100, r["y0"] / 100, r["x1"] / 100, r["y1"] / 100) for r in driver.interrows(spark, f"{tmp_path}/{name}").collect()]
        near = lambda x, y: min(((round(d, 9), i) for i, a, b, c, e in strips if (d := (max(a - x, x - c, 0.0) ** 2 + max(b - y, y - e, 0.0) ** 2) ** 0.5) <= 0.6), default=None)  # noqa: B023, E731
        spots = [(r["id"], near(r["x"], r["y"]), abs(r["x"] - round(r["x"] / 10) * 10) < 0.5) for r in driver.spots(spark, SF).collect()]
        want = sorted((i, f"strip {n[1]}" if n else "path" if path else "open ground") for i, n, path in spots)
        for most in (X.MOST_BROADCAST, 0):
            monkeypatch.setattr(X, "MOST_BROADCAST", most)
            assert sorted(tuple(r) for r in spatial.QUERIES["place_context"][0](spark, f"{tmp_path}/{name}").collect()) == want
        monkeypatch.undo()
        monkeypatch.setattr(X, "overlapping", lambda *a: made.append(join(*a)) or made[-1])
    assert made[2].count() < 3 * made[0].count()
