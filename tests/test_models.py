"""Estimators, forests, linear models, imputation and curve fits against brute force or invariants."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from reachworks.operators import estimators as E
from reachworks.operators import forest as Q
from reachworks.operators import impute as I
from reachworks.operators import models as M
from reachworks.operators import survey as G
from reachworks.operators import terms as T
from reachworks.operators import validation as W
from reachworks.operators.survey import levels


def test_depletion_check_value(spark):
    d = spark.createDataFrame([(38.0, 26.0, 12.0), (0.0, 0.0, 0.0), (None, 1.0, 1.0)], "a double, b double, c double")
    got = [r.e for r in d.select(E.removal_k(["a", "b", "c"]).alias("e")).collect()]
    assert got[0].N == 91 and got[0].p == pytest.approx(76 / 171)
    assert got[1].N == 0 and got[2].N is None


def test_depletion_search_finds_the_first_solution():
    rng = np.random.default_rng(4)
    for k in (3, 4):
        c = rng.integers(0, 40, (300, k)).astype(float)
        got = E.carle_strub(c)[:, 0]
        t, x = c.sum(axis=1), c @ np.arange(k - 1, -1, -1.0)
        for i in range(len(c)):
            n = t[i]
            while t[i] > 0 and E._excess(np.array([n]), t[i:i + 1], x[i:i + 1], k)[0] > 1:
                n += 1
            assert got[i] == n and got[i] >= t[i]


def test_two_pass_and_chapman(spark):
    d = spark.createDataFrame([(60.0, 20.0), (20.0, 20.0)], "a double, b double")
    got = [r.e for r in d.select(E.removal2("a", "b").alias("e")).collect()]
    assert got[0].N == 90 and got[0].p == pytest.approx(2 / 3) and got[1].N == 0 and got[1].SE is None
    e = spark.createDataFrame([(50.0, 40.0, 10.0)], "m double, n double, r double").select(E.chapman("m", "n", "r").alias("e")).first().e
    assert e.N == pytest.approx(51 * 41 / 11 - 1)
    assert e.SE == pytest.approx(np.sqrt(51 * 41 * 40 * 30 / (121 * 12)))


@pytest.fixture(scope="module")
def cov(spark):
    rng = np.random.default_rng(1)
    n = 400
    x1, x2 = rng.normal(size=n), rng.normal(size=n)
    y = np.exp(0.5 * x1 - 0.2 * x2 + rng.normal(scale=0.3, size=n))
    rows = [(i, float(a), float(b), float(c), "s" if i % 2 else "t", f"h{i % 9}", 1.0 + i % 3) for i, (a, b, c) in enumerate(zip(x1, x2, y))]
    return spark.createDataFrame(rows, "id int, x1 double, x2 double, y double, g string, h string, w double")


def test_forest_quantiles(cov):
    forest = Q.fit_qrf(cov, ["x1", "x2", "h"], "y", ntree=15, factors=["h"])[None]
    label = F.ln(F.col("y") + 0.005)
    leaves = Q.leaf_weights(forest, cov, label)
    total = leaves.groupBy("tree", "leaf").agg(F.sum("w").alias("s")).agg(F.min("s"), F.max("s")).first()
    assert total[0] == pytest.approx(1 / 15) and total[1] == pytest.approx(1 / 15)
    lo_y, hi_y = cov.agg(F.min("y"), F.max("y")).first()
    each = Q.reached(forest, cov).select("id", F.posexplode("__leaves").alias("tree", "leaf")).join(leaves, ["tree", "leaf"])
    last = None
    for q in (0.1, 0.5, 0.9):
        whole = {r.id: r.pred for r in Q.predict_quantile(forest, leaves, cov, q, "id").collect()}
        plain = {r.id: r.z - 0.005 for r in Q.weighted_quantile(each, ["id"], "y", "w", q).select("id", F.exp("q").alias("z")).collect()}
        assert len(whole) == 400 and whole == pytest.approx(plain)
        assert all(lo_y - 1e-9 <= v <= hi_y + 1e-9 for v in whole.values())
        assert last is None or all(whole[i] >= last[i] - 1e-12 for i in whole)
        last = whole
    # Chunks of few trees, chunks in parts and small blocks of rows give the same.
    for chunk_rows, cells in ((1500, 400), (90, 30)):
        assert {r.id: r.pred for r in Q.predict_quantile(forest, leaves, cov, 0.9, "id", chunk_rows=chunk_rows, block_cells=cells).collect()} == pytest.approx(last)


def test_few_large_leaves_are_searched_by_ranges(spark, monkeypatch):
    """No row is sent once a chunk with its masses: it goes to the range of its quantile, also where one value fills a third of the rows."""
    monkeypatch.setattr(Q, "_read_cuts", lambda *a: pytest.fail("masses of every chunk are sent"))
    ids = F.array(*[F.expr(f"int((id * {7 + k} + id div {3 + k}) % {5 + k})") for k in range(3)])
    rows = spark.range(900).select("id", ids.alias("ids"), F.when(F.col("id") % 3 == 0, 0.0).otherwise(F.col("id") * 7919 % 1013 / 1.0).alias("y"))
    leaves = Q.leaf_table(rows, "y", "ids")
    each = rows.select("id", F.posexplode("ids").alias("tree", "leaf")).join(leaves, ["tree", "leaf"])
    for q in (0.2, 0.9):
        plain = {r.id: r.q for r in Q.weighted_quantile(each, ["id"], "y", "w", q).collect()}
        assert {r.id: r.q for r in Q.quantile_of_leaves(leaves, rows, q, "id", "ids", chunk_rows=1000, block_cells=1200).collect()} == plain and len(plain) == 900


def test_rows_with_gaps_and_unknown_levels_stay(spark, cov):
    forest = Q.fit_forest(cov, ["x1", "h"], "y", ntree=5, factors=["h"])
    leaves = Q.leaf_weights(forest, cov, "y")
    score = spark.createDataFrame([(1, 0.1, "h1"), (2, None, "h1"), (3, 0.1, "new"), (4, 0.1, None)], "id int, x1 double, h string")
    for got in (Q.predict_quantile(forest, leaves, score, 0.5, "id", offset=None), Q.predict(forest, score).withColumnRenamed("prediction", "pred"),
                Q.tree_spread(forest, score, "id").withColumnRenamed("pred_cap", "pred")):
        found = {r.id: r.pred for r in got.collect()}
        assert sorted(found) == [1, 2, 3, 4] and found[1] is not None and {found[i] for i in (2, 3, 4)} == {None}


def test_trees_grow_to_their_leaf_size(spark):
    rows = spark.range(6000).select("id", (F.col("id") % 3000).cast("double").alias("x"), F.pow(F.lit(1.01), F.col("id") % 3000).alias("y"))
    forest = Q.fit_forest(rows, ["x"], "y", ntree=1)
    assert forest.model.trees[0].depth > 10 and forest.model.trees[0].numNodes > 31


def test_trees_do_not_depend_on_where_they_grow(spark):
    """Nodes of many rows are split from summed histograms, those below in one task; both ways give the same forest."""
    rng = np.random.default_rng(2)
    rows = [(i, float(a), int(b), f"h{c}", float(a * (b % 3) + c % 4 + e)) for i, (a, b, c, e) in enumerate(zip(rng.normal(size=900), rng.integers(0, 9, 900), rng.integers(0, 6, 900), rng.normal(size=900) / 5))]
    df = spark.createDataFrame(rows, "id int, x double, k int, h string, y double")
    one, split = (Q.fit_forest(df.repartition(n), ["x", "k", "h"], "y", ntree=3, factors=["h"], sub_rows=m) for n, m in ((2, 10**6), (5, 150)))
    assert len(one.model.first) == 3 < len(split.model.first) and one.model.trees == split.model.trees
    assert one.model.importance == pytest.approx(split.model.importance)
    a, b = ({r.id: r["__leaves"] for r in Q.reached(f, df).collect()} for f in (one, split))
    assert a == b and len(a) == 900
    values = [{(r.tree, r.leaf): r.value for r in Q.leaf_values(f).collect()} for f in (one, split)]
    assert values[0] == pytest.approx(values[1])


def test_a_tree_of_all_rows_holds_their_means(spark):
    rows = spark.range(300).select(F.col("id"), (F.col("id") % 20).cast("double").alias("x"), (F.col("id") % 20 * F.col("id") % 7 + F.col("id") % 20).cast("double").alias("y"))
    forest = Q.fit_forest(rows, ["x"], "y", ntree=1, sub_rows=100)
    found = Q.reached(forest, rows).groupBy(F.col("__leaves")[0].alias("leaf")).agg(F.avg("y").alias("m"), F.count("y").alias("n"), F.min("x").alias("x")).orderBy("x").collect()
    assert [r.leaf for r in found] == list(range(len(found))) and min(r.n for r in found) >= 5
    assert {r.leaf: r.value for r in Q.leaf_values(forest).collect()} == pytest.approx({r.leaf: r.m for r in found})


def test_factor_moves_the_partial_dependence(spark):
    rows = spark.range(600).select("id", (F.col("id") % 50).cast("double").alias("x"), F.when(F.col("id") % 2 == 0, "pool").otherwise("riffle").alias("f"))
    rows = rows.withColumn("y", F.col("x") / 50 + F.when(F.col("f") == "pool", 10.0).otherwise(1.0))
    forest = Q.fit_forest(rows, ["x", "f"], "y", ntree=8, factors=["f"])
    imp = Q.relative_importance(spark, {"all": forest}, {})
    assert {r.metric for r in imp.collect()} == {"x", "f"}
    grid = Q.pdp_grid(rows, ["x"], 5, forest.factors)
    for kind in ("mean", "quantile"):
        got = Q.partial_dependence(forest, Q.leaf_weights(forest, rows, "y"), grid, imp, kind, 0.5, offset=None).collect()
        mean = {f: np.mean([r.pred for r in got if r.f == f]) for f in ("pool", "riffle")}
        assert len(got) == 10 and mean["pool"] > mean["riffle"] + 3


def test_many_levels(spark):
    rows = spark.range(300 * 12).select((F.col("id") % 300).cast("string").alias("g"), F.col("id").alias("id"), (F.col("id") % 7).cast("double").alias("x")).withColumn("y", F.col("x") + 1)
    assert len(levels(rows, "g")) == 300
    seen = Q.fit_by(rows, "g", lambda part, lv: part.count())
    assert len(seen) == 300 and set(seen.values()) == {12}


def test_tree_spread(cov):
    forest = Q.fit_forest(cov, ["x1", "x2"], "y", ntree=10)
    got = Q.tree_spread(forest, cov, "id")
    lo, hi = cov.agg(F.min("y"), F.max("y")).first()
    row = got.agg(F.count("*"), F.min("pred_cap"), F.max("pred_cap"), F.min("pred_se")).first()
    assert row[0] == 400 and row[1] >= lo and row[2] <= hi and row[3] >= 0
    assert {r.id: r.pred_cap for r in got.collect()} == pytest.approx({r.id: r.prediction for r in Q.predict(forest, cov).collect()})
    split = {r.id: r.pred_se for r in Q.tree_spread(forest, cov, "id", chunk_rows=50, block_cells=100).collect()}
    assert split == pytest.approx({r.id: r.pred_se for r in got.collect()})


def test_weighted_least_squares_with_factor(cov):
    x, names = G.design_array(["x1", "x2"], {"g": ["s", "t"], "h": sorted({f"h{i}" for i in range(9)})})
    assert names[:4] == ["x1", "x2", "gs", "gt"] and "hh0" not in names and len(names) == 12
    d = cov.withColumn("ly", F.ln("y"))
    fit = G.svy_lm(d, "ly", x, len(names), "w")
    coef, inv = fit.first()
    pdf = d.select("ly", "w", x.alias("x")).toPandas()
    X, w, y = np.stack(pdf.x.to_numpy()), pdf.w.to_numpy(), pdf.ly.to_numpy()
    want = np.linalg.solve((X.T * w) @ X, (X.T * w) @ y)
    assert np.allclose(coef, want)
    e = w * (y - X @ want)
    assert np.abs(X.T @ e).max() < 1e-8
    strata = np.array([r.h for r in cov.select("h").collect()])
    vc = np.array([list(r) for r in G.design_vcov(d, fit, "ly", x, len(names), "w", "h").first().vcov])
    meat = np.zeros((len(names),) * 2)
    for s in set(strata):
        u = (X * e[:, None])[strata == s]
        u = u - u.mean(axis=0)
        meat += len(u) / (len(u) - 1) * u.T @ u
    A = np.linalg.inv((X.T * w) @ X)
    assert np.allclose(vc, A @ meat @ A)
    fit2 = G.design_vcov(d, fit, "ly", x, len(names), "w", "h")
    p = G.predict_lm(d, fit2, x).orderBy("id").select("fit", "fit_se", "pred_cap", "pred_se").first()
    assert p.fit == pytest.approx(float(X[0] @ want)) and p.fit_se == pytest.approx(float(np.sqrt(X[0] @ vc @ X[0])))
    assert p.pred_cap == pytest.approx(np.exp(p.fit) * (1 + p.fit_se ** 2 / 2)) and p.pred_se == pytest.approx(p.pred_cap * p.fit_se)


def test_fold_is_stable_and_covers(cov):
    k = G.kfold(cov, 5, "id")
    assert k.count() == 400 and {r.fold for r in k.select("fold").distinct().collect()} == set(range(5))
    assert sorted(map(tuple, k.select("id", "fold").collect())) == sorted(map(tuple, G.kfold(cov.repartition(3), 5, "id").select("id", "fold").collect()))


def test_training_moments_are_the_rest(cov):
    rows = G.kfold(cov, 4, "id").withColumn("z", F.col("x1") + 1e6)
    got = {r.fold: r for r in G.fold_models(rows, "y", F.array(F.lit(1.0), F.col("z"), F.col("x2")), 3).collect()}
    pdf = rows.toPandas()
    for fold in range(4):
        t = pdf[pdf.fold != fold]
        want = np.linalg.lstsq(np.column_stack([np.ones(len(t)), t.z - 1e6, t.x2]), t.y, rcond=None)[0]
        assert got[fold].n_train == len(t) and got[fold].coef[1:] == pytest.approx(want[1:].tolist(), rel=1e-6)
        assert got[fold].coef[0] + 1e6 * got[fold].coef[1] == pytest.approx(want[0], rel=1e-5)
    groups = {r.fold: r for r in G.fold_moments(G.leave_one_group_out(cov, "h"), {"n": F.count(F.lit(1))}).collect()}
    assert len(groups) == 9 and all(r.test_n + r.train_n == 400 for r in groups.values())


def test_matching_fills_categories(spark):
    rows = [(i, float(i), "low" if i < 50 else "high") for i in range(100)]
    d = spark.createDataFrame([(i, x, None if i % 10 == 3 else t) for i, x, t in rows], "id int, x double, t string")
    got = {r.id: r.t for r in I.impute_missing(d, ["x", "t"], "id", max_missing=2, method="pmm", draws=4).collect()}
    assert len(got) == 100 and {i: got[i] for i in range(3, 100, 10)} == {i: ("low" if i < 50 else "high") for i in range(3, 100, 10)}
    assert I.impute_missing(d.where("t is null"), ["x", "t"], "id", max_missing=2, method="pmm", draws=2).where("t is not null").count() == 0


def _gaps(cov):
    return cov.select("id", F.when(F.col("id") % 5 != 0, F.col("x1")).alias("x1"), F.when(F.col("id") % 7 != 0, F.col("x2")).alias("x2"),
                      F.when(F.col("id") % 35 != 0, F.col("y")).alias("y"), F.when(F.col("id") % 6 != 0, F.col("g")).alias("g"), "w")


def test_impute_methods(cov):
    d = _gaps(cov)
    for method, cols in (("median", ["x1", "x2", "y"]), ("pmm", ["x1", "x2", "y"]), ("rf", ["x1", "x2", "y", "g"])):
        got = I.impute_missing(d, cols, "id", max_missing=2, method=method, draws=1, ntree=5, max_iter=2)
        assert got.columns == d.columns
        pdf, raw = got.toPandas().set_index("id"), d.toPandas().set_index("id")
        assert pdf[cols].notna().all().all()
        missing = raw[cols].isna().sum(axis=1)
        assert set(pdf.index) == set(raw.index[missing <= 2])
        for c in ("x1", "x2", "y"):
            known = raw[c].dropna().index.intersection(pdf.index)
            assert (pdf.loc[known, c] == raw.loc[known, c]).all()
            if method == "pmm":
                assert set(pdf[c]) <= set(raw[c].dropna())


def test_binomial_model_recovers_rates(spark):
    rows = [(i, "a" if i % 2 else "b", 100.0, 30.0 if i % 2 else 60.0) for i in range(40)]
    d = spark.createDataFrame(rows, "id int, sp string, n double, c double")
    out = M.capture_prob(d, d, "c", "n", "sp").toPandas()
    assert np.allclose(out.p, np.where(out.sp == "a", 0.3, 0.6), atol=1e-6)
    assert np.allclose(out.pSE, np.sqrt(out.p * (1 - out.p) / 2000), rtol=1e-3)
    assert np.allclose(out.N, 100)


def test_all_subsets(cov):
    m = M.dredge(cov.withColumn("ly", F.ln("y")), "ly", ["x1", "x2", "w"], fixed=["x1"]).toPandas()
    assert len(m) == 4 and m.weight.sum() == pytest.approx(1) and m.delta.min() == 0
    assert m.loc[m.delta.idxmin(), "model"].startswith("x1+x2")
    avg = {r.term: r.estimate for r in M.averaged(M.dredge(cov.withColumn("ly", F.ln("y")), "ly", ["x1", "x2"])).collect()}
    assert avg["x1"] == pytest.approx(0.5, abs=0.06) and avg["x2"] == pytest.approx(-0.2, abs=0.06)


def test_terms_and_margins(spark):
    assert T.terms_of("b + a:b + a + b:a") == [("b",), ("a",), ("a", "b")] and T.up_to(["a", "b", "c"], 2) == ["a", "b", "c", "a:b", "a:c", "b:c"]
    names = {"+".join(map(T.label, m)) for m in T.sub_models(T.terms_of(T.up_to(["a", "b"], 2)))}
    assert names == {"", "a", "b", "a+b", "a+b+a:b"}
    d = spark.createDataFrame([(1.0, "u", "p"), (2.0, "v", "q"), (None, "w", "p"), (3.0, None, "q")], "x double, f string, g string")
    plan = T.design(d, T.up_to(["x", "f", "g"], 2))
    assert plan.names() == ["(Intercept)", "x", "fv", "fw", "gq", "x:fv", "x:fw", "x:gq", "fv:gq", "fw:gq"]
    got = [r.x for r in d.unionByName(spark.createDataFrame([(1.0, "new", "p")], d.schema)).select(plan.row().alias("x")).collect()]
    assert got == [[1, 1, 0, 0, 0, 0, 0, 0, 0, 0], [1, 2, 1, 0, 1, 2, 0, 2, 1, 0], None, None, None]


def test_interactions_against_least_squares(spark):
    rng = np.random.default_rng(8)
    rows = [(float(x) + 1e4, str(f), float(y)) for x, f, y in zip(rng.normal(size=90), rng.choice(["a", "b", "c"], 90), rng.normal(size=90))]
    rows = [(x, f, y + 0.5 * (x - 1e4) * (f == "b")) for x, f, y in rows]
    d = spark.createDataFrame(rows, "x double, f string, y double")
    fits = {m.name: m for m in M.fit_models(d, "y", T.up_to(["x", "f"], 2))}
    assert set(fits) == {"1", "x", "f", "x+f", "x+f+x:f"}
    dummy = np.array([[f == "b", f == "c"] for _, f, _ in rows], float)
    x, y = np.array([r[0] for r in rows]), np.array([r[2] for r in rows])
    design = np.column_stack([np.ones(90), x - 1e4, dummy, dummy * (x - 1e4)[:, None]])
    inv = np.linalg.inv(design.T @ design)
    b = inv @ design.T @ y
    rss = ((y - design @ b) ** 2).sum()
    got = fits["x+f+x:f"]
    assert got.coef[[1, 4, 5]] == pytest.approx(b[[1, 4, 5]], rel=1e-4) and got.parameters == 7
    assert np.sqrt(np.diag(got.cov))[[1, 4, 5]] == pytest.approx(np.sqrt(np.diag(inv) * rss / 84)[[1, 4, 5]], rel=1e-4)
    assert got.loglik == pytest.approx(-45 * (np.log(2 * np.pi * rss / 90) + 1), rel=1e-6)


def test_predictions_keep_every_row(spark):
    rng = np.random.default_rng(9)
    train = spark.createDataFrame([(i, float(rng.normal()), "ab"[i % 2], "t" if i % 3 else "u", 20.0, float(rng.integers(4, 16)), "S") for i in range(60)],
                                  "id int, x double, crew string, unit string, n double, c double, sp string")
    score = spark.createDataFrame([(1, 0.1, "a", "t", None, 5.0, "S"), (2, None, "a", "t", None, 5.0, "S"), (3, 0.1, "z", "t", None, 5.0, "S"), (4, 0.1, None, "t", None, 5.0, "S"),
                                   (5, 0.1, "b", "new", None, 5.0, "S"), (6, 0.1, "z", "new", None, 5.0, "S"), (7, 0.1, "b", None, None, 5.0, "S")], train.schema)
    p = {r.id: r.p for r in M.capture_prob(train, score, "c", "n", "x + crew").collect()}
    assert len(p) == 7 and {k for k, v in p.items() if v is not None} == {1, 5, 7}
    for share in (None, 0.95):
        got = {r.id: (r.route, r.Nhat, r.Nhat_se) for r in M.calibrate(train, score, "sp", "unit", "c", "n", "x + crew", "crew", average=share).collect()}
        assert len(got) == 7 and got[1][0] == "binomial" and got[5][0] == got[7][0] == got[6][0] == "linear"
        assert all(got[i][1] is not None and got[i][2] > 0 for i in (1, 5, 7)) and got[6][1] is None
    assert {got[i][1] for i in (2, 3, 4)} == {None} or share


def test_averaged_errors_and_confidence_set(spark):
    rng = np.random.default_rng(10)
    d = spark.createDataFrame([(float(a), float(b), float(a + rng.normal())) for a, b in rng.normal(size=(80, 2))], "a double, b double, y double")
    fits = M.fit_models(d, "y", ["a", "b"])
    kept = M.confidence_set(fits, 0.95)
    assert sum(w for _, w in kept) == pytest.approx(1) and all("a" in f.name for f, _ in kept) and M.confidence_set(fits, 0.0)[0][1] == 1
    table = M.model_table(d, fits)
    got = {r.term: r for r in M.averaged(table).collect()}
    rows = table.collect()
    mean = sum(r.weight * r.coef.get("b", 0.0) for r in rows)
    assert got["b"].estimate == pytest.approx(mean)
    assert got["b"].se == pytest.approx(np.sqrt(sum(r.weight * (r["var"].get("b", 0.0) + (r.coef.get("b", 0.0) - mean) ** 2) for r in rows)))


def _curve(form, a, b, s):
    return {"BevertonHolt": s / (a + b * s), "Ricker": a * s * np.exp(-b * s), "Hockey": b * (1 - np.exp(-a / b * s))}[form]


def test_spawner_recruit(spark):
    rng = np.random.default_rng(6)
    rows = [("one", float(s), float(s / (0.01 + 0.0005 * s) * np.exp(rng.normal(scale=0.1)))) for s in rng.integers(5, 400, 40)]
    rows += [("two", float(s), float(80 * s * np.exp(-0.004 * s) * np.exp(rng.normal(scale=0.1)))) for s in rng.integers(5, 600, 40)]
    rows += [("few", 10.0, 20.0), ("few", 30.0, 25.0)]
    d = spark.createDataFrame(rows, "pop string, s double, r double")
    got = {(r["pop"], r["form"]): r for r in W.fit_sr(d, "pop", "s", "r").collect()}
    assert got["few", "Ricker"].status == "failed" and got["few", "Ricker"].est is None
    for pop in ("one", "two"):
        s = np.array([x[1] for x in rows if x[0] == pop])
        r = np.array([x[2] for x in rows if x[0] == pop])
        for form in W.FORMS:
            f = got[pop, form]
            # no parameter pair of a fine grid around the fit does better
            for fa in np.linspace(0.8, 1.25, 19):
                for fb in np.linspace(0.8, 1.25, 19):
                    sse = ((np.log(r) - np.log(_curve(form, f.a * fa, f.b * fb, s))) ** 2).sum()
                    assert sse >= f.sse - 1e-6 * max(1.0, f.sse)
            assert f.se > 0 and f.cv == pytest.approx(f.se / f.est)
    assert got["one", "BevertonHolt"].est == pytest.approx(2000, rel=0.15)
    cap = spark.createDataFrame([("one", 0.0004)], "pop string, b double")
    fixed = W.fit_sr(d, "pop", "s", "r", fixed_b=cap).collect()
    assert len(fixed) == 1 and fixed[0].b == pytest.approx(0.0004) and fixed[0].est == pytest.approx(2500)


def test_partial_dependence_mean_and_quantile(spark, cov):
    forest = Q.fit_qrf(cov, ["x1", "x2"], "y", ntree=10)[None]
    leaves = Q.leaf_weights(forest, cov, F.ln(F.col("y") + 0.005))
    imp = Q.relative_importance(spark, {"all": forest}, {"x1": "First"})
    assert imp.agg(F.max("rel_imp")).first()[0] == 1.0
    grid = Q.pdp_grid(cov, ["x1", "x2"], 11)
    assert grid.count() == 22
    for kind in ("mean", "quantile"):
        rows = Q.partial_dependence(forest, leaves, grid, imp, kind).where("metric = 'x1'").orderBy("i").collect()
        assert len(rows) == 11 and rows[0].label == "First" and rows[-1].pred > rows[0].pred > 0


def test_a_failing_group_leaves_the_rest(spark):
    from reachworks.plans.queries_models import _FIT, _SUMS, _slope, _sums
    d = spark.createDataFrame([(k, float(x), 2.0 * x + k) for k in (1, 2) for x in range(50)] + [(3, 1.0, 1.0), (3, 1.0, 2.0)], "c_nationkey int, x double, y double")
    got = {r.c_nationkey: r for r in W.grouped_map(d.repartition(5), ["c_nationkey"], _sums, _SUMS, _slope, _FIT, fan_in=2).collect()}
    assert got[1].slope == pytest.approx(2) and got[2].intercept == pytest.approx(2) and got[3].status == "failed" and got[3].slope is None


def test_pmm_broadcasts_no_table_of_rows(spark, monkeypatch):
    """Rows exploded over the draws look small to the planner; only the coefficients of the draws are sent to every task."""
    sent, real = [], I.nearest_join
    def watched(need, donors, *a):
        sent.append(donors._jdf.queryExecution().optimizedPlan().toString())
        return real(need, donors, *a)
    monkeypatch.setattr(I, "nearest_join", watched)
    d = spark.range(60).select("id", F.when(F.col("id") % 5 != 0, F.col("id") * 2.0).alias("x"), (F.col("id") * 1.0).alias("y"))
    got = I.impute_missing(d, ["x", "y"], "id", max_missing=2, method="pmm", draws=2)
    assert got.where("x is null").isEmpty() and "strategy=broadcast" in sent[0]


def test_forest_queries_grow_all_their_trees(spark, tmp_path, monkeypatch):
    """fit_forest and rf_extrapolate ask for as many trees as the operators grow by themselves."""
    from reachworks.plans import catalog
    parts = [(i, f"Brand#{i % 3}", "T", i % 50 + 1, 900.0 + i % 90) for i in range(160)]
    spark.createDataFrame(parts, "p_partkey bigint, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    items = [(i % 160, float(i % 7 + 1), 100.0 + i * 13 % 997) for i in range(800)]
    spark.createDataFrame(items, "l_partkey bigint, l_quantity double, l_extendedprice double").write.parquet(f"{tmp_path}/lineitem.parquet")
    seen, real = [], Q.fit_forest
    def counted(df, covars, label, ntree=1000, *more, **kw):
        seen.append(ntree)
        return real(df, covars, label, 3, *more, **kw)
    monkeypatch.setattr(Q, "fit_forest", counted)
    for name in ("fit_forest", "rf_extrapolate"):
        assert catalog.QUERIES[name](spark, str(tmp_path)).count() > 100
    assert seen == [1000, 1000, 2000, 2000]


def test_spread_of_trees_needs_no_leaf_ids(spark, monkeypatch):
    """Mean and SD over the trees, worked out where a row's trees meet, are those of the leaves' values."""
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(i, float(a), float(a * 3 + b)) for i, (a, b) in enumerate(rng.normal(size=(300, 2)))] + [(900, None, 1.0)], "id int, x double, y double")
    forest = Q.fit_forest(df, ["x"], "y", ntree=7)
    slow = {r.id: (r.pred_cap, r.pred_se) for r in Q.tree_spread(forest, df, "id", chunk_rows=50).collect()}
    monkeypatch.setattr(Q, "spread_of_leaves", None)
    fast = {r.id: (r.pred_cap, r.pred_se) for r in Q.tree_spread(forest, df, "id").collect()}
    assert fast.pop(900) == slow.pop(900) == (None, None)
    assert {k: pytest.approx(v) for k, v in slow.items()} == fast
