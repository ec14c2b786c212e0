"""Gaps, ties, repeated rows and names that collide with labels."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from reachworks import session
from reachworks.operators import aggregates as A
from reachworks.operators import estimators as E
from reachworks.operators import forest as Q
from reachworks.operators import joins as J
from reachworks.operators import models as M
from reachworks.operators import rollup as U
from reachworks.operators import screening as C
from reachworks.operators import survey as G
from reachworks.operators import validation as W
from reachworks.operators.impute import impute_missing


def test_crosstab_shares_keep_null_and_total(spark):
    df = spark.createDataFrame([("Total", "x"), (None, "x"), ("a", "x"), ("a", "y")], "a string, b string")
    for margins in (True, False):
        got = {(r.a, r.b): r.share for r in A.crosstab(df, "a", "b", margins, "row").collect()}
        assert got == {("Total", "x"): 1.0, (None, "x"): 1.0, ("a", "x"): 0.5, ("a", "y"): 0.5}


def test_nearest_ignores_unknown_times(spark):
    left = spark.createDataFrame([(1, "k", 1.0), (2, "k", None)], "lid int, k string, t double")
    right = spark.createDataFrame([(7, "k", None), (8, "k", 5.0)], "rid int, k string, s double")
    assert [(r.lid, r.rid) for r in J.nearest_join(left, right, ["k"], "t", "s", "lid", "rid").collect()] == [(1, 8)]


def test_keep_max_ties_and_later_columns(spark):
    df = spark.createDataFrame([("a", 2, 1), ("a", 2, 3), ("a", 2, 3), ("a", 1, 9), ("b", 4, None), ("b", 4, 0), (None, 1, 1), ("c", None, 1)], "k string, x int, y int")
    assert sorted(map(tuple, A.keep_max(df, ["k"], ["x", "y"]).collect()), key=str) == sorted([("a", 2, 3), ("a", 2, 3), ("b", 4, 0), (None, 1, 1)], key=str)


def test_repeated_nests_count_once(spark):
    sites = spark.createDataFrame([(1, "r", 10.0, 4.0)], "site int, route string, m double, area double")
    nests = spark.createDataFrame([("r", "sp", 2000, 10.0, 1), ("r", "sp", 2000, 10.5, 1), ("r", "sp", 2000, 11.0, 2)], "route string, sp string, yr int, at double, nest int")
    row = E.redd_density(sites, nests, ["route"], "site", "m", "at", 500.0, "sp", "yr", "area", "nest").first()
    assert row.redds_per_km == 2.0


def test_earlier_estimates_stay(spark):
    df = spark.createDataFrame([("Single Pass", 5, None, None, None, 9.0, 1.0), ("Single Pass", 5, None, None, None, None, None), ("Depletion", 9, 4, 2, None, 30.0, 2.0), ("Depletion", 9, 4, None, None, 30.0, 2.0)],
                               "Method string, pass1 int, pass2 int, pass3 int, pass4 int, old double, old_se double").withColumns({"p": F.lit(None).cast("double"), "pSE": F.lit(None).cast("double")})
    got = E.flag_valid(E.estimate_abundance(df, earlier=("old", "old_se"))).collect()
    assert [(r.N, r.Nmethod, r.Valid) for r in got[:3]] == [(9.0, "Prev. Calc.", True), (None, None, False), (30.0, "Prev. Calc.", True)]
    assert got[3].Nmethod == "Seber"


def test_linear_models_use_complete_rows(spark):
    rng = np.random.default_rng(1)
    x, z, y = rng.normal(size=(3, 40))
    rows = [(float(a) if i % 5 else None, float(b) if i % 7 else None, float(c) if i % 11 else None, "s", 1.0) for i, (a, b, c) in enumerate(zip(x, z, y))]
    df = spark.createDataFrame(rows, "x double, z double, y double, st string, w double")
    full = [r for r in rows if None not in r]
    design = np.array([[1, r[0], r[1]] for r in full])
    want = np.linalg.lstsq(design, np.array([r[2] for r in full]), rcond=None)[0]
    cols, _ = G.design_array(["x", "z"], {}, intercept=True)
    fit = G.svy_lm(df, "y", cols, 3, "w")
    assert fit.first().coef == pytest.approx(want.tolist())
    inv, score = np.linalg.inv(design.T @ design), design * (np.array([r[2] for r in full]) - design @ want)[:, None]
    centred = score - score.mean(axis=0)
    meat = centred.T @ centred * len(full) / (len(full) - 1)
    got = np.array(G.design_vcov(df, fit, "y", cols, 3, "w", "st").first().vcov)
    assert got == pytest.approx(inv @ meat @ inv)
    models = {r.model: r for r in M.dredge(df, "y", ["x", "z"]).collect()}
    assert models["x+z"].coef["z"] == pytest.approx(want[2]) and set(models) == {"1", "x", "z", "x+z"}


def test_binomial_models_name_terms_and_have_a_null_model(spark):
    df = spark.createDataFrame([(g, c, 10, v) for g, c, v in [("u", 2, 0.0), ("u", 4, 1.0), ("v", 7, 0.0), ("v", 9, 1.0), ("v", 8, None)] * 6], "g string, c int, n int, v double")
    models = {r.model: r for r in M.dredge(df, "c", ["g", "v"], family="binomial", trials="n").collect()}
    assert set(models) == {"1", "g", "v", "g+v"} and models["1"].coef["(Intercept)"] == pytest.approx(np.log(22 / 18))
    p = {"u": 6 / 20, "v": 16 / 20}
    assert models["g"].coef["(Intercept)"] == pytest.approx(np.log(p["u"] / (1 - p["u"])), abs=1e-5) and set(models["g"].coef) == {"(Intercept)", "gv"}
    assert models["1"].loglik < models["g"].loglik and {r.term for r in M.averaged(M.dredge(df, "c", ["v"], family="binomial", trials="n")).collect()} == {"(Intercept)", "v"}


def test_group_functions_fail_alone_at_every_stage(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", -1.0), ("c", 5.0)], "k string, v double").repartition(3)

    def partial(pdf):
        if (pdf["v"] < 0).any():
            raise ValueError("negative")
        return pd.DataFrame({"k": [pdf["k"].iloc[0]], "v": [pdf["v"].sum()]})

    def finish(pdf):
        if pdf["v"].iloc[0] > 4:
            raise ValueError("large")
        return pd.DataFrame({"k": pdf["k"], "total": pdf["v"]})

    got = W.grouped_map(df, ["k"], partial, "k string, v double", finish, "k string, total double, status string, error string")
    assert {r.k: (r.total, r.status, r.error) for r in got.collect()} == {"a": (3.0, "ok", None), "b": (None, "failed", "ValueError: negative"), "c": (None, "failed", "ValueError: large")}


def test_short_metric_keeps_its_row(spark):
    df = spark.createDataFrame([(i, float(i) if i < 5 else None, float(i * i), float(i)) for i in range(60)], "id int, few double, many double, y double")
    got = {r.metric: r.mic for r in C.mic(df, ["few", "many"], "y", "id").collect()}
    assert got["few"] is None and got["many"] == pytest.approx(1.0)


def test_sixty_columns_correlate_in_one_small_plan(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(80, 60)) + 1e6
    x[:, 1] = x[:, 0] + rng.normal(size=80)
    x[rng.random((80, 60)) < 0.1] = np.nan
    rows = [[None if np.isnan(v) else float(v) for v in row] for row in x]
    df = spark.createDataFrame(rows, ", ".join(f"c{k} double" for k in range(60)))
    got = {(r.x, r.y): r.r for r in C.corr_long(df, df.columns).collect()}
    want = pd.DataFrame(x, columns=df.columns).corr()
    assert len(got) == 60 * 59 // 2 and all(r == pytest.approx(want.loc[a, b], abs=1e-8) for (a, b), r in got.items())


def test_curves_that_run_off_are_not_ok(spark):
    rows = [("good", s, 50 * s / (0.5 + 0.02 * s)) for s in range(1, 40)] + [("line", s, 3.0 * s) for s in range(1, 40)]
    df = spark.createDataFrame([(k, float(s), float(r)) for k, s, r in rows], "k string, s double, r double")
    got = {(r.k, r.form): r for r in W.fit_sr(df, "k", "s", "r").collect()}
    best = got["good", "BevertonHolt"]
    assert best.status == "ok" and best.b == pytest.approx(0.02 / 50, rel=1e-3)
    assert len(got) == 6 and {got["line", f].status for f in W.FORMS} == {"no density dependence"}
    assert got["line", "Hockey"].a == pytest.approx(3) and got["line", "Hockey"].est is None and got["line", "Ricker"].b == 0


def test_factor_grid_keeps_rows_and_columns(spark):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(i, float(a), float(b), float(a + b)) for i, (a, b) in enumerate(rng.random((120, 2)))], "id int, x1 double, x2 double, y double")
    model = Q.fit_forest(df, ["x1", "x2"], "y", ntree=3)
    leaves = Q.leaf_weights(model, df, "y")
    grid = Q.pdp_grid(df, ["x1", "x2"], 4, {"f": ["a", "b"]})
    imp = Q.relative_importance(spark, {"all": model}, {})
    out = Q.partial_dependence(model, leaves, grid, imp, offset=None)
    assert out.count() == 16 and {r.f for r in out.collect()} == {"a", "b"}


def test_median_imputation_fills_text_with_the_mode(spark):
    df = spark.createDataFrame([(1, 1.0, "b"), (2, None, "a"), (3, 3.0, "b"), (4, 5.0, None)], "id int, x double, t string")
    assert [(r.x, r.t) for r in impute_missing(df, ["x", "t"], "id").orderBy("id").collect()] == [(1.0, "b"), (3.0, "a"), (3.0, "b"), (5.0, "b")]


def test_streams_need_points_and_names(spark):
    ring = lambda x, y, n: [(x, y), (x + n, y), (x + n, y + n), (x, y + n)]
    polys = spark.createDataFrame([("here", ring(0.0, 0.0, 100.0)), ("empty", ring(200.0, 0.0, 100.0))], "poly_id string, ring array<struct<x: double, y: double>>")
    points = spark.createDataFrame([(1, 50.0, 52.0, 2.0, 0.1)], "point_id int, x double, y double, cap double, se double")
    lines = spark.createDataFrame([("A", 1, -10.0, 50.0, 400.0, 50.0)], "stream string, seg_no int, x1 double, y1 double, x2 double, y2 double")
    got = {(r.poly_id, r.stream): r for r in U.watershed_cap(polys, points, lines, "stream", by_stream=True).collect()}
    assert set(got) == {("here", "A"), ("here", "Total"), ("empty", "Total")} and got["empty", "Total"].tot_cap is None


def test_polygons_of_parts_and_holes(spark):
    from reachworks.operators import spatial as K

    def ring(x, y, n, hole=False):
        points = [(x, y), (x + n, y), (x + n, y + n), (x, y + n)]
        return points[::-1] if hole else points

    polys = spark.createDataFrame([("p", [ring(0.0, 0.0, 100.0), ring(40.0, 40.0, 20.0, True), ring(200.0, 0.0, 50.0)])], "poly_id string, ring array<array<struct<x: double, y: double>>>")
    assert K.polygon_area(polys, ["poly_id"]).first().area * 1e6 == pytest.approx(100 * 100 - 20 * 20 + 50 * 50)
    points = spark.createDataFrame([(1, 50.0, 50.5), (2, 10.0, 50.5), (3, 210.0, 10.0), (4, 150.0, 10.0)], "id int, x double, y double")
    assert sorted(r.id for r in K.pip_join(points, polys, cell=30.0).collect()) == [2, 3]
    lines = spark.createDataFrame([("A", 1, -10.0, 45.0, 400.0, 45.0)], "stream string, seg_no int, x1 double, y1 double, x2 double, y2 double")
    assert K.length_in_polygon(lines, polys, ["stream"], cell=70.0).first().length == pytest.approx(100 - 20 + 50)


def test_shared_folder_must_be_named_on_a_cluster():
    class Context:
        master = "spark://host:7077"

        @staticmethod
        def getCheckpointDir():
            return None

    class Conf:
        @staticmethod
        def get(key, default=None):
            return default

    class Session:
        sparkContext, conf = Context, Conf

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_folder(Session)


def test_rank_correlations_rank_a_column_once(spark):
    """Thirty columns, some with gaps and ties, against pairwise-complete ranks; the plan has no copy of the rows a pair."""
    rng = np.random.default_rng(14)
    x = np.round(rng.normal(size=(90, 30)), 1)
    x[:, 1] = -x[:, 0]
    x[rng.random((90, 30)) < 0.15] = np.nan
    x[:, 5:20] = np.nan_to_num(x[:, 5:20])
    rows = [[None if np.isnan(v) else float(v) for v in row] for row in x]
    df = spark.createDataFrame(rows, ", ".join(f"c{k} double" for k in range(30)))
    got = {(r.x, r.y): r.r for r in C.corr_long(df, df.columns, "spearman").collect()}
    want = pd.DataFrame(x, columns=df.columns).corr("spearman")
    assert len(got) == 30 * 29 // 2 and all(r == pytest.approx(want.loc[a, b], abs=1e-9) for (a, b), r in got.items())


def test_mic_does_not_depend_on_blocks(spark):
    """One block of ranks scores its grids at once; several send the counts of a grid, and results agree."""
    from reachworks.operators import screening as C
    df = spark.range(400).selectExpr("id", "cast(id % 37 as double) as x", "cast((id * id) % 101 as double) as y", "cast(if(id % 3 = 0, null, id % 50) as double) as z").repartition(7)
    want = {r.metric: r.mic for r in C.mic(df, ["x", "z"], "y", "id").collect()}
    got = {r.metric: r.mic for r in C.mic(df, ["x", "z"], "y", "id", block_ranks=90).collect()}
    assert got == pytest.approx(want) and all(0 < v < 1 for v in want.values())
