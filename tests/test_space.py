"""Spatial operators against brute force, with boundary and degenerate cases."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from reachworks.operators import rollup as U
from reachworks.operators import spatial as K

SQUARE = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)]
ELL = [(20.0, 0.0), (60.0, 0.0), (60.0, 20.0), (40.0, 20.0), (40.0, 50.0), (20.0, 50.0)]


def polys(spark, rings):
    return spark.createDataFrame([(k, [{"x": x, "y": y} for x, y in r]) for k, r in rings.items()],
                                 "poly_id string, ring array<struct<x:double,y:double>>")


def inside(ring, x, y):
    odd = False
    for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
        if (ay > y) != (by > y) and x < ax + (y - ay) * (bx - ax) / (by - ay):
            odd = not odd
    return odd


@pytest.mark.parametrize("cell", [3.0, 1000.0])
def test_points_in_polygons(spark, cell):
    pts = [(i, float(x), float(y)) for i, (x, y) in enumerate((x, y) for x in range(-2, 64, 2) for y in range(-2, 54, 2))]
    got = {(r.point_id, r.poly_id) for r in K.pip_join(spark.createDataFrame(pts, "point_id int, x double, y double"),
                                                       polys(spark, {"sq": SQUARE, "ell": ELL}), cell=cell).select("point_id", "poly_id").collect()}
    assert got == {(i, n) for i, x, y in pts for n, r in (("sq", SQUARE), ("ell", ELL)) if inside(r, x, y)}


def test_a_shared_edge_gives_each_point_to_one_side(spark):
    right = [(10.0, 0.0), (20.0, 0.0), (20.0, 10.0), (10.0, 10.0)]
    pts = spark.createDataFrame([(i, 10.0, i + 0.0) for i in range(10)], "point_id int, x double, y double")
    assert K.pip_join(pts, polys(spark, {"l": SQUARE, "r": right}), cell=4.0).groupBy("point_id").count().where("count <> 1").count() == 0


def foot(x, y, s):
    _, _, x1, y1, x2, y2 = s
    d = (x2 - x1) ** 2 + (y2 - y1) ** 2
    u = 0.0 if d == 0 else min(max(((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / d, 0), 1)
    return math.hypot(x - x1 - u * (x2 - x1), y - y1 - u * (y2 - y1))


@pytest.fixture(scope="module")
def net(spark):
    rng = random.Random(8)
    segs = [(i % 7, i, *[rng.uniform(0, 1000) for _ in range(4)]) for i in range(25)]
    segs += [(7, 100, 500.0, 0.0, 500.0, 900.0), (7, 101, 0.0, 300.0, 900.0, 300.0), (8, 102, 50.0, 50.0, 50.0, 50.0)]
    pts = [(i, rng.uniform(-50, 1050), rng.uniform(-50, 1050)) for i in range(150)] + [(900, 5000.0, -4000.0), (901, 5000.0, -4000.0), (902, 500.0, 300.0)]
    return (segs, pts, spark.createDataFrame(segs, "line_id int, seg_no int, x1 double, y1 double, x2 double, y2 double"),
            spark.createDataFrame(pts, "point_id int, x double, y double"))


@pytest.mark.parametrize("steps", [1, 3])
def test_snap_against_all_pairs(net, steps):
    segs, pts, sd, pd_ = net
    got = {r.point_id: r for r in K.snap_points(pd_, sd, 40.0, steps=steps).collect()}
    want = {i: min(foot(x, y, s) for s in segs) for i, x, y in pts}
    assert set(got) == {i for i, d in want.items() if d <= 40.0}
    for i, r in got.items():
        assert r.snap_dist == pytest.approx(want[i], abs=1e-9)
        assert min(foot(r.snap_x, r.snap_y, s) for s in segs if s[0] == r.line_id) == pytest.approx(0, abs=1e-6)


def test_nearest_reaches_every_point(net):
    segs, pts, sd, pd_ = net
    got = {r.point_id: r.snap_dist for r in K.nearest(pd_, sd, start=10.0).collect()}
    assert got == pytest.approx({i: min(foot(x, y, s) for s in segs) for i, x, y in pts})


def test_buffer_caps(spark, net):
    _, pts, sd, pd_ = net
    assert {r[0] for r in K.within_distance(pd_, sd, 30.0).collect()} == {r.point_id for r in K.snap_points(pd_, sd, 30.0).collect()}
    line = spark.createDataFrame([(1, 1, 0.0, 0.0, 100.0, 0.0)], "line_id int, seg_no int, x1 double, y1 double, x2 double, y2 double")
    p = spark.createDataFrame([(1, 50.0, 9.0), (2, 108.0, 0.0), (3, 108.0, 8.0), (4, 111.0, 0.0), (5, 50.0, 11.0)], "point_id int, x double, y double")
    ids = lambda cap: {r[0] for r in K.within_distance(p, line, 10.0, cap=cap).collect()}
    assert ids("round") == {1, 2} and ids("flat") == {1} and ids("square") == {1, 2, 3}


@pytest.mark.parametrize("cell", [7.0, 500.0])
def test_clip_length(spark, cell):
    segs = [(1, 1, -5.0, 5.0, 70.0, 5.0), (2, 2, 30.0, -10.0, 30.0, 60.0), (3, 3, 50.0, 10.0, 30.0, 40.0), (4, 4, 2.0, 2.0, 8.0, 8.0),
            (5, 5, 0.0, 60.0, 70.0, 60.0), (6, 6, 0.0, 10.0, 10.0, 0.0), (7, 7, 45.0, 30.0, 55.0, 40.0)]
    sd = spark.createDataFrame(segs, "line_id int, seg_no int, x1 double, y1 double, x2 double, y2 double")
    pd_ = polys(spark, {"sq": SQUARE, "ell": ELL})
    got = {(r.line_id, r.poly_id): r.length for r in K.length_in_polygon(sd, pd_, ["line_id"], cell=cell).collect()}
    for sid, _, x1, y1, x2, y2 in segs:
        n = 20000
        ts = (np.arange(n) + 0.5) / n
        for name, ring in (("sq", SQUARE), ("ell", ELL)):
            part = sum(inside(ring, x1 + t * (x2 - x1), y1 + t * (y2 - y1)) for t in ts[::20]) / len(ts[::20]) * math.hypot(x2 - x1, y2 - y1)
            assert got.get((sid, name), 0.0) == pytest.approx(part, abs=0.2)
    met = {(r.line_id, r.poly_id) for r in K.clip_reaches(sd, pd_, "line_id", cell=cell).collect()}
    assert set(got) <= met and (5, "ell") not in met and (7, "ell") not in met
    best = {r.line_id: r.poly_id for r in K.largest_overlap(sd, pd_, "line_id", min_length=1.0, cell=cell).collect()}
    assert best[1] == "ell" and best[4] == "sq"


def test_area_and_hull(spark):
    a = {r.poly_id: r.area for r in K.polygon_area(polys(spark, {"sq": SQUARE, "ell": ELL}), ["poly_id"]).collect()}
    assert a["sq"] == pytest.approx(1e-4) and a["ell"] == pytest.approx(1400 / 1e6)
    rng = random.Random(1)
    pts = [("g" if i < 400 else "h", rng.gauss(0, 10), rng.gauss(0, 10)) for i in range(450)] + [("one", 1.0, 2.0), ("line", 0.0, 0.0), ("line", 1.0, 1.0), ("line", 2.0, 2.0)]
    hull = K.convex_hull(spark.createDataFrame(pts, "g string, x double, y double").repartition(6), "g", fan_in=3).orderBy("g", "seq").collect()
    ring = [(r.x, r.y) for r in hull if r.g == "g"]
    for g, x, y in pts:
        if g == "g":
            assert all((bx - ax) * (y - ay) - (by - ay) * (x - ax) >= -1e-9 for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]))
    assert set(ring) <= {(x, y) for _, x, y in pts}
    assert [(r.x, r.y) for r in hull if r.g == "one"] == [(1.0, 2.0)]
    assert [(r.x, r.y) for r in hull if r.g == "line"] == [(0.0, 0.0), (2.0, 2.0)]


def test_projection_known_point(spark):
    x, y = K.to_albers("lon", "lat")
    d = spark.createDataFrame([(-96.0, 23.0), (-96.0, 40.0), (-120.0, 45.0)], "lon double, lat double").select(x.alias("x"), y.alias("y")).collect()
    assert d[0].x == pytest.approx(0, abs=1e-6) and d[0].y == pytest.approx(0, abs=1e-6)
    assert d[1].x == pytest.approx(0, abs=1e-6) and 1.8e6 < d[1].y < 2.0e6
    assert d[2].x < -1.7e6 and 2.5e6 < d[2].y < 2.8e6


def test_empty_watersheds_keep_their_area(spark, net):
    _, _, sd, pd_ = net
    from pyspark.sql import functions as F
    rings = {"big": [(0.0, 0.0), (1000.0, 0.0), (1000.0, 1000.0), (0.0, 1000.0)], "void": [(9000.0, 9000.0), (9100.0, 9000.0), (9100.0, 9100.0)]}
    caps = pd_.withColumns({"cap": F.lit(2.0), "se": F.lit(0.5)})
    got = {r.poly_id: r for r in U.watershed_cap(polys(spark, rings), caps, sd.withColumnRenamed("line_id", "stream"), "stream").collect()}
    assert got["void"].area == pytest.approx(0.005) and got["void"].tot_cap is None and got["void"].n_pts is None
    lens = {r.stream: r.length for r in K.line_length(sd.withColumnRenamed("line_id", "stream"), ["stream"]).collect()}
    assert got["big"].tot_length == pytest.approx(sum(lens.values()))
    assert got["big"].tot_cap == pytest.approx(2.0 * sum(v for v in lens.values() if v))


def _crossings(poly, a, b):
    """Sorted places where the whole line through a and b meets the rings, by the half-open side rule."""
    d, out = b - a, []
    side = lambda p: d[0] * (p[1] - a[1]) - d[1] * (p[0] - a[0])
    for ring in poly:
        for p, q in zip(ring, ring[1:] + ring[:1]):
            p, q = np.array(p), np.array(q)
            sp, sq = side(p), side(q)
            if (sp >= 0) != (sq >= 0):
                x = p + sp / (sp - sq) * (q - p)
                out.append(float((x - a) @ d / (d @ d)))
    return sorted(out)


@pytest.mark.parametrize("cell", [3.0, 11.0, 500.0])
def test_clip_by_cell_against_whole_rings(spark, cell):
    """Stars of many vertices with a hole and an island in it, cut by long and short lines that pass many cells."""
    rng = np.random.default_rng(12)
    star = lambda n, r, x, y: [(x + r * (1 + 0.4 * (k % 2)) * np.cos(2 * np.pi * k / n), y + r * (1 + 0.4 * (k % 2)) * np.sin(2 * np.pi * k / n)) for k in range(n)]
    shapes = {"one": [star(40, 20.0, 30.0, 30.0), star(14, 9.0, 30.0, 30.0)[::-1], star(8, 3.0, 30.0, 30.0)], "two": [star(300, 15.0, 60.0, 45.0)], "far": [star(5, 4.0, -20.0, 90.0)]}
    ends = np.concatenate([rng.uniform(-10, 90, (60, 4)), (lambda p: np.hstack([p, p + rng.normal(scale=1.5, size=p.shape)]))(rng.uniform(10, 75, (60, 2)))])
    segs = spark.createDataFrame([(i, 1, *map(float, e)) for i, e in enumerate(ends)] + [(500, 1, 5.0, 5.0, 5.0, 5.0)],
                                 "line_id int, seg_no int, x1 double, y1 double, x2 double, y2 double")
    rows = [(n, [[(float(x), float(y)) for x, y in r] for r in rings]) for n, rings in shapes.items()]
    table = spark.createDataFrame(rows, "poly_id string, ring array<array<struct<x:double,y:double>>>")
    want, touched = {}, set()
    for i, e in enumerate(ends):
        for name, rings in shapes.items():
            t = _crossings(rings, e[:2], e[2:])
            spans = [(max(a, 0.0), min(b, 1.0)) for a, b in zip(t[::2], t[1::2]) if min(b, 1.0) > max(a, 0.0)]
            if spans:
                want[i, name] = spans
            if spans or any(0 <= x <= 1 for x in t):
                touched.add((i, name))
    got = {}
    for r in K.clip_segments(segs, table, cell=cell).orderBy("piece").collect():
        e = ends[r.line_id]
        place = lambda x, y: ((np.array([x, y]) - e[:2]) @ (e[2:] - e[:2])) / ((e[2:] - e[:2]) @ (e[2:] - e[:2]))
        got.setdefault((r.line_id, r.poly_id), []).append((place(r.x1, r.y1), place(r.x2, r.y2)))
    assert got.keys() == want.keys()
    for k, spans in want.items():
        assert np.array(got[k]) == pytest.approx(np.array(spans), abs=1e-9)
    assert {(r.line_id, r.poly_id) for r in K.clip_reaches(segs, table, "line_id", cell=cell).collect()} == touched
    twice = K.clip_segments(segs.unionByName(segs), table, cell=cell)
    assert twice.count() == 2 * sum(map(len, want.values()))


def test_a_cell_sees_its_own_edges_alone(spark):
    """A ring of four thousand vertices leaves a few edges to each cell and none to covered ones."""
    ring = [(100 * np.cos(2 * np.pi * k / 4000), 100 * np.sin(2 * np.pi * k / 4000)) for k in range(4000)]
    table = spark.createDataFrame([("disc", [(float(x), float(y)) for x, y in ring])], "poly_id string, ring array<struct<x:double,y:double>>")
    cells = K._polygon_cells(table, ["poly_id"], 10.0, "ring").select(F.size("__edges").alias("n"), "__odd").collect()
    assert max(r.n for r in cells) < 120 and sum(r.n == 0 and r["__odd"] for r in cells) > 200


def test_small_polygons_meet_only_what_passes_near(spark):
    """Many small plots in one large cell: candidates stay near the pairs, which are those of the plain test."""
    from reachworks.operators import joins as J
    rng = np.random.default_rng(4)
    rings = {f"p{i}": [(x, y), (x + 30.0, y + 1.5), (x + 25.0, y + 40.0), (x - 3.0, y + 30.0)] for i, (x, y) in enumerate(rng.uniform(0, 2000, (400, 2)).tolist())}
    pts = [(i, *map(float, p)) for i, p in enumerate(rng.uniform(0, 2000, (400, 2)))]
    ends = rng.uniform(0, 2000, (40, 4))
    table, pd_ = polys(spark, rings), spark.createDataFrame(pts, "point_id int, x double, y double")
    sd = spark.createDataFrame([(i, 1, *map(float, e)) for i, e in enumerate(ends)], "line_id int, seg_no int, x1 double, y1 double, x2 double, y2 double")
    met, old = [], J.spread_join
    def counted(left, right, on, task_pairs=None):
        met.append(left.join(right, on).count())
        return old(left, right, on, 50)  # hot cells are dealt over tasks
    K.spread_join, sent = counted, K._sent
    K._sent = lambda df, edges: df.select("*")
    try:
        got = {(r.point_id, r.poly_id) for r in K.pip_join(pd_, table).collect()}
        clip = {(r.line_id, r.poly_id) for r in K.clip_reaches(sd, table, "line_id").collect()}
        lens = {(r.line_id, r.poly_id): r.length for r in K.length_in_polygon(sd, table, ["line_id"]).collect()}
    finally:
        K.spread_join, K._sent = old, sent
    assert got == {(i, n) for i, x, y in pts for n, r in rings.items() if inside(r, x, y)}
    want = {}
    for i, e in enumerate(ends):
        for name, ring in rings.items():
            t = _crossings([ring], e[:2], e[2:])
            spans = [(max(a, 0.0), min(b, 1.0)) for a, b in zip(t[::2], t[1::2]) if min(b, 1.0) > max(a, 0.0)]
            if spans:
                want[i, name] = sum(b - a for a, b in spans) * math.hypot(*(e[2:] - e[:2]))
    assert clip == set(want) and lens == pytest.approx(want)
    assert max(met) < 400 * 40 / 3


def test_a_dense_net_is_searched_in_small_cells(spark):
    """Among many lines the first radius is small, results are those of all pairs and ties go to the lowest line."""
    rng = np.random.default_rng(6)
    segs = [(i % 9, i, *map(float, e)) for i, e in enumerate(rng.uniform(0, 1000, (150, 4)))]
    segs += [(20, 900, *segs[3][2:]), (1, 901, *segs[5][2:])]  # the same place twice
    pts = [(i, *map(float, p)) for i, p in enumerate(rng.uniform(-100, 1100, (600, 2)))]
    sd = spark.createDataFrame(segs, "line_id int, seg_no int, x1 double, y1 double, x2 double, y2 double")
    pd_ = spark.createDataFrame(pts, "point_id int, x double, y double")
    assert K._radii(pd_, sd, [], 500.0)[0] < 500.0 / 4
    want = {}
    for i, x, y in pts:
        d, line = min((round(foot(x, y, s), 9), s[0]) for s in segs)
        if d <= 60.0:
            want[i] = (d, line)
    got = {r.point_id: (round(r.snap_dist, 9), r.line_id) for r in K.snap_points(pd_, sd, 60.0).collect()}
    assert {i: v[1] for i, v in got.items()} == {i: v[1] for i, v in want.items()}
    assert {r[0] for r in K.within_distance(pd_, sd, 60.0).collect()} == set(want)


def test_roll_up_meets_one_row_a_reach(spark):
    """Capacities are summed per reach before they meet polygons, with the results of joining every row."""
    rng = np.random.default_rng(9)
    rings = {"a": [(0.0, 0.0), (50.0, 0.0), (50.0, 50.0), (0.0, 50.0)], "b": [(30.0, 30.0), (90.0, 30.0), (90.0, 90.0), (30.0, 90.0)]}
    ends = rng.uniform(0, 100, (20, 4))
    sd = spark.createDataFrame([(i, i, *map(float, e)) for i, e in enumerate(ends)], "reach_id int, seg_no int, x1 double, y1 double, x2 double, y2 double")
    rows = [(int(r), float(k + 1), float(k % 5), 0.5 if k % 3 else None, bool(k % 4), "xy"[k % 2]) for k, r in enumerate(rng.integers(0, 20, 300))]
    caps = spark.createDataFrame(rows, "reach_id int, length double, cap double, se double, in_domain boolean, species string")
    inside_ = {(r.reach_id, r.poly_id) for r in K.clip_reaches(sd, polys(spark, rings), "reach_id").collect()}
    got = {(r.poly_id, r.species): (r.n_rchs, r.tot_length, r.tot_cap) for r in U.rollup_all(polys(spark, rings), sd, caps, "reach_id", ["species"]).collect()}
    traps = {(r.poly_id, r.species): (r.n_rch, r.tot_length, r.cap) for r in U.trap_capacity(K.clip_reaches(sd, polys(spark, rings), "reach_id"), ["poly_id", "species"], caps=caps).collect()}
    for found, dom in ((got, True), (traps, False)):
        for p in rings:
            for s in "xy":
                mine = [r for r in rows if (r[0], p) in inside_ and r[5] == s and (r[4] or not dom)]
                assert found[p, s] == pytest.approx((len({r[0] for r in mine}), sum(r[1] for r in mine), sum(r[1] * r[2] for r in mine)))


def _shapes(spark):
    """Plots of every kind: convex, with a convex hole, with a hole across the edge, of a bent outline, one twice, one large."""
    rng = np.random.default_rng(12)
    rows = []
    for i, (x, y) in enumerate(rng.uniform(0, 900, (60, 2)).tolist()):
        plot = [(x, y), (x + 40.0, y + 1.5), (x + 35.0, y + 50.0), (x - 3.0, y + 40.0)]
        more = {0: [], 1: [[(x + 10, y + 10), (x + 12, y + 25), (x + 20, y + 12)]], 2: [[(x + 30, y + 10), (x + 60, y + 12), (x + 32, y + 30)]]}.get(i % 4)
        rings = [[*plot[:3], (x + 20.0, y + 10.0), plot[3]]] if more is None else [plot, *more]
        rows.append((f"p{i}", [[{"x": a, "y": b} for a, b in r] for r in rings]))
    rows += [rows[0], ("all", [[{"x": a, "y": b} for a, b in ((-10.0, -10.0), (990.0, -10.0), (990.0, 995.0), (-10.0, 995.0))]])]
    table = spark.createDataFrame(rows, "poly_id string, ring array<array<struct<x:double,y:double>>>")
    lines = [(int(i % 3) if i % 7 else None, i, *map(float, e)) for i, e in enumerate(rng.uniform(-50, 1000, (40, 4)))] + [(1, 40, 5.0, 5.0, 5.0, 5.0)]
    sd = spark.createDataFrame(lines, "stream int, seg_no int, x1 double, y1 double, x2 double, y2 double")
    pts = [(i, *map(float, p), float(i % 5) if i % 6 else None, 0.5 if i % 4 else None) for i, p in enumerate(rng.uniform(0, 950, (500, 2)))] + [(3, 400.0, 400.0, 9.0, 1.0)]
    return table, sd, spark.createDataFrame(pts, "point_id int, x double, y double, cap double, se double")


def _rounded(df):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.collect()), key=lambda r: [str(v) for v in r if not isinstance(v, float)])


def test_pairs_of_small_polygons_are_never_rows(spark, monkeypatch):
    """Lengths, sums and capacities of small polygons come out of the task that has them, as if cut into cells."""
    from reachworks.operators import passing
    table, sd, pts = _shapes(spark)
    caps = spark.createDataFrame([(i % 40, float(i % 9 + 1), None if i % 5 == 0 else float(i % 4), 0.1 * (i % 3), True, "a" if i % 2 else None) for i in range(120)],
                                 "seg_no int, length double, cap double, se double, in_domain boolean, species string")
    sums = lambda cell: U.rollup_all(table, sd, caps, "seg_no", ["species"], cell=cell)
    every = {
        "lengths": lambda cell: K.length_in_polygon(sd, table, ["stream"], cell=cell), "pairs": lambda cell: K.clip_reaches(sd, table, "stream", cell=cell),
        "sums": sums, "streams": lambda cell: U.watershed_cap(table, pts, sd, "stream", max_snap=20.0, by_stream=True, cell=cell).select(
            "poly_id", "stream", "is_total", "n_pts", "tot_length", "cap_per_m", "cap_per_m_se", "tot_cap", "tot_cap_se", "area")}
    monkeypatch.setattr(passing, "PAIRS", 7)
    monkeypatch.setattr(K, "TASK_TESTS", 300)  # cells are dealt over tasks
    cut = {k: _rounded(f(30.0)) for k, f in every.items()}
    met, old = [], K.spread_join
    def counted(left, right, on, task_pairs=None):
        if "__edges" in right.columns:
            met.append(right.where("__k is not null").count() if "__k" in right.columns else 0)
        return old(left, right, on, task_pairs)
    monkeypatch.setattr(K, "spread_join", counted)
    whole = {k: _rounded(f(300.0)) for k, f in every.items()}
    for k in every:
        assert len(whole[k]) == len(cut[k]) > 10
        for a, b in zip(whole[k], cut[k]):
            floats = [[v for v in r if isinstance(v, float)] for r in (a, b)]
            assert [v for v in a if not isinstance(v, float)] == [v for v in b if not isinstance(v, float)] and floats[0] == pytest.approx(floats[1], abs=2e-6)
    assert sum(met) <= 2  # the copies of one id
