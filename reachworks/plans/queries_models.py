"""Forests, imputation, calibration models, functions of a group, validation and scenario tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from reachworks.functions import scalars as S
from reachworks.operators import aggregates as A
from reachworks.operators import forest as Q
from reachworks.operators import frames as R
from reachworks.operators import joins as J
from reachworks.operators import models as M
from reachworks.operators import survey as G
from reachworks.operators import validation as W
from reachworks.operators.impute import impute_missing
from reachworks.operators.terms import up_to
from reachworks.plans import views as V
from reachworks.plans.registry import query, r4
from reachworks.session import freeze

COVARS = ["size", "price", "effort"]
FACTORS = ["p_brand"]
EVERY = [*COVARS, *FACTORS]
LABELS = {"size": "Site size", "price": "Unit cost", "effort": "Survey effort", "p_brand": "Channel type"}


# ---- forests -------------------------------------------------------------------------

def _train(t):
    """Parts with complete covariates, two species; written once, as fitting and scoring read it many times."""
    d = V.part_covariates(t).withColumn("species", F.when(F.col("p_partkey") % 2 == 0, "Chinook").otherwise("Steelhead"))
    return freeze(impute_missing(d, COVARS, "p_partkey", max_missing=1))


def _log_dens():
    return F.ln(F.col("dens") + 0.005)


def _one_forest(t, ntree=20):
    d = _train(t)
    return d, Q.fit_qrf(d, EVERY, "dens", ntree=ntree, factors=FACTORS)[None]


@query("fit_forest")
def _(t):
    d = _train(t)
    forests = Q.fit_qrf(d, EVERY, "dens", by="species", factors=FACTORS)
    return R.stack([Q.predict(m, d.where(F.col("species") == sp)).select("p_partkey", "species", "prediction") for sp, m in forests.items()], strict=True)


@query("leaf_table")
def _(t):
    d, m = _one_forest(t)
    return Q.leaf_weights(m, d, _log_dens())


@query("predict_quantile")
def _(t):
    d, m = _one_forest(t)
    return Q.predict_quantile(m, Q.leaf_weights(m, d, _log_dens()), d, 0.9, "p_partkey")


# Everything behind a row's leaf ids is exact: the same operators on ids that SQL knows too, eight trees of 5 to 12 leaves.
_IDS = [f"int((p_partkey * {7 + k} + p_partkey div {3 + k}) % {5 + k})" for k in range(8)]
_IDS_SQL = "ids AS (SELECT p_partkey, dens, unnest(range(0, 8)) AS tree FROM parts), rows_ AS (SELECT p_partkey, dens, tree, (p_partkey * (7 + tree) + p_partkey // (3 + tree)) % (5 + tree) AS leaf FROM ids)"


def _given(t):
    return V.part_covariates(t).select("p_partkey", F.round("dens", 2).alias("y"), F.array(*map(F.expr, _IDS)).alias("ids"))


_LEAVES_SQL = f"""WITH {V.PARTS_SQL}, {_IDS_SQL},
n AS (SELECT tree, leaf, round(dens, 2) AS y, count(*) AS n FROM rows_ GROUP BY 1, 2, 3), leaves AS (SELECT tree, leaf, y, n / (sum(n) OVER (PARTITION BY tree, leaf) * 8) AS w FROM n)"""


@query("leaf_table_of_ids", f"{_LEAVES_SQL} SELECT CAST(tree AS INTEGER) AS tree, CAST(leaf AS INTEGER) AS leaf, y, round(w, 10) AS w FROM leaves")
def _(t):
    return Q.leaf_table(_given(t), "y", "ids").withColumn("w", F.round("w", 10))


@query("predict_quantile_of_ids", f"""{_LEAVES_SQL},
m AS (SELECT p_partkey, y, sum(w) AS w FROM rows_ JOIN leaves USING (tree, leaf) GROUP BY 1, 2),
c AS (SELECT *, sum(w) OVER (PARTITION BY p_partkey ORDER BY y) AS cum, sum(w) OVER (PARTITION BY p_partkey) AS tot FROM m)
SELECT p_partkey, min(y) FILTER (WHERE cum >= 0.9 * tot - 1e-9) AS q FROM c GROUP BY 1""")
def _(t):
    d = _given(t)
    return Q.quantile_of_leaves(Q.leaf_table(d, "y", "ids"), d, 0.9, "p_partkey", "ids")


@query("tree_spread_of_ids", f"""{_LEAVES_SQL}, v AS (SELECT tree, leaf, sum(y * w) * 8 AS value FROM leaves GROUP BY 1, 2)
SELECT p_partkey, round(avg(value), 6) AS pred_cap, round(stddev_samp(value), 6) AS pred_se FROM rows_ JOIN v USING (tree, leaf) GROUP BY 1""")
def _(t):
    d = _given(t)
    values = Q.leaf_table(d, "y", "ids").groupBy("tree", "leaf").agg((F.sum(F.col("y") * F.col("w")) * 8).alias("value"))
    out = Q.spread_of_leaves(values, d, "p_partkey", "ids")
    return out.select("p_partkey", *[F.round(c, 6).alias(c) for c in ("pred_cap", "pred_se")])


@query("weighted_quantile", """
WITH m AS (SELECT l_returnflag, l_linestatus, l_extendedprice AS y, sum(l_quantity) AS w FROM lineitem GROUP BY 1, 2, 3),
c AS (SELECT *, sum(w) OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY y ROWS UNBOUNDED PRECEDING) AS cum, sum(w) OVER (PARTITION BY l_returnflag, l_linestatus) AS tot FROM m)
SELECT l_returnflag, l_linestatus, min(y) FILTER (WHERE cum >= 0.9 * tot) AS q FROM c GROUP BY 1, 2""")
def _(t):
    return Q.weighted_quantile(t.lineitem, ["l_returnflag", "l_linestatus"], "l_extendedprice", "l_quantity", 0.9)


@query("unit_to_site", """
WITH u AS (SELECT l_orderkey, 5 + l_orderkey % 7 AS len, 100 + l_orderkey % 11 AS area, sum(l_extendedprice / l_quantity / 1000 * l_quantity) AS a, sum(l_discount * l_quantity) AS b FROM lineitem GROUP BY 1, 2, 3)
SELECT l_orderkey, round(a, 6) AS chnk_tot, round(b, 6) AS sthd_tot, round(a / len, 8) AS chnk_per_m, round(a / area, 8) AS chnk_per_m2, round(b / len, 8) AS sthd_per_m, round(b / area, 8) AS sthd_per_m2 FROM u""")
def _(t):
    u = t.lineitem.select("l_orderkey", (F.lit(5) + F.col("l_orderkey") % 7).alias("len"), (F.lit(100) + F.col("l_orderkey") % 11).alias("area"),
                          "l_quantity", (F.col("l_extendedprice") / F.col("l_quantity") / 1000).alias("chnk"), F.col("l_discount").alias("sthd"))
    c = Q.unit_capacity(u, ["l_orderkey"], {"chnk": "chnk", "sthd": "sthd"}, "l_quantity", "len", "area")
    return c.select("l_orderkey", *[F.round(x, 6).alias(x) for x in ("chnk_tot", "sthd_tot")],
                    *[F.round(x, 8).alias(x) for x in ("chnk_per_m", "chnk_per_m2", "sthd_per_m", "sthd_per_m2")])


@query("relative_importance")
def _(t):
    forests = Q.fit_qrf(_train(t), EVERY, "dens", ntree=20, by="species", factors=FACTORS)
    return Q.relative_importance(t.spark, forests, LABELS)


@query("pdp_grid", f"""WITH {V.PARTS_SQL},
s AS (SELECT min(size) AS s0, median(size) AS sm, max(size) AS s1, min(price) AS p0, median(price) AS pm, max(price) AS p1, min(effort) AS e0, median(effort) AS em, max(effort) AS e1 FROM parts),
g AS (SELECT m AS metric, i, CASE m WHEN 'size' THEN s0 + i * (s1 - s0) / 199 WHEN 'price' THEN p0 + i * (p1 - p0) / 199 ELSE e0 + i * (e1 - e0) / 199 END AS value, s.* FROM s, (VALUES ('size'), ('price'), ('effort')) v(m), range(0, 200) r(i))
SELECT metric, CAST(i AS INTEGER) AS i, round(value, 6) AS value, round(CASE WHEN metric = 'size' THEN value ELSE sm END, 6) AS size, round(CASE WHEN metric = 'price' THEN value ELSE pm END, 6) AS price,
  round(CASE WHEN metric = 'effort' THEN value ELSE em END, 6) AS effort, l.p_type FROM g, (SELECT DISTINCT p_type FROM part) l""")
def _(t):
    d = V.part_covariates(t)
    g = Q.pdp_grid(d, COVARS, 200, {"p_type": G.levels(d, "p_type")})
    return g.select("metric", "i", "p_type", *[F.round(c, 6).alias(c) for c in ("value", *COVARS)])


@query("partial_dependence")
def _(t):
    d, m = _one_forest(t)
    imp = Q.relative_importance(t.spark, {"all": m}, LABELS)
    return Q.partial_dependence(m, Q.leaf_weights(m, d, _log_dens()), Q.pdp_grid(d, COVARS, 200, m.factors), imp)


@query("rug_table", f"""WITH {V.PARTS_SQL}
SELECT p_type AS "group", 'size' AS metric, 'Site size' AS label, size AS value FROM parts UNION ALL SELECT p_type, 'price', 'Unit cost', price FROM parts UNION ALL SELECT p_type, 'effort', 'Survey effort', effort FROM parts""")
def _(t):
    return Q.rug(V.part_covariates(t), COVARS, "p_type", LABELS)


@query("points_per_metric", """
WITH n AS (SELECT l_returnflag, count(*) AS n_sites FROM lineitem GROUP BY 1), m AS (SELECT l_returnflag, count(DISTINCT l_linenumber) AS n_mets FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1)
SELECT n.l_returnflag, n_sites, n_mets, round(n_sites / n_mets, 6) AS pts_per_met FROM n LEFT JOIN m ON n.l_returnflag = m.l_returnflag""")
def _(t):
    p = Q.pts_per_metric(t.lineitem, t.lineitem.where("l_linestatus = 'F'"), "l_returnflag", "l_linenumber")
    return p.withColumn("pts_per_met", F.round("pts_per_met", 6))


@query("rf_extrapolate")
def _(t):
    d = _train(t)
    return Q.rf_extrapolate(d, V.part_covariates(t).select("p_partkey", *EVERY), EVERY, "dens", "p_partkey", "species", factors=FACTORS)


# ---- imputation ----------------------------------------------------------------------

def _gappy(t):
    return t.lineitem.groupBy("l_partkey").agg(F.sum("l_quantity").alias("q"), F.sum("l_extendedprice").alias("p"), F.max("l_linenumber").alias("k")).select(
        "l_partkey", F.when(F.col("l_partkey") % 7 != 0, F.col("q")).alias("qty"), F.when(F.col("l_partkey") % 5 != 0, F.col("p")).alias("price"),
        F.when(F.col("l_partkey") % 3 != 0, F.col("k")).alias("lines"), F.when(F.col("l_partkey") % 4 != 0, F.col("q") / F.col("k")).alias("ratio"),
        F.when(F.col("l_partkey") % 6 != 0, F.when(F.col("k") > 6, "long").otherwise("short")).alias("kind"))


@query("impute_missing", """
WITH g AS (SELECT l_partkey, sum(l_quantity) AS q, sum(l_extendedprice) AS p, max(l_linenumber) AS k FROM lineitem GROUP BY 1),
d AS (SELECT l_partkey, CASE WHEN l_partkey % 7 <> 0 THEN q END AS qty, CASE WHEN l_partkey % 5 <> 0 THEN p END AS price, CASE WHEN l_partkey % 3 <> 0 THEN k END AS lines, CASE WHEN l_partkey % 4 <> 0 THEN q / k END AS ratio, CASE WHEN l_partkey % 6 <> 0 THEN CASE WHEN k > 6 THEN 'long' ELSE 'short' END END AS kind FROM g),
f AS (SELECT * FROM d WHERE (qty IS NULL)::INT + (price IS NULL)::INT + (lines IS NULL)::INT + (ratio IS NULL)::INT + (kind IS NULL)::INT <= 2),
mo AS (SELECT kind AS most FROM f WHERE kind IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, kind LIMIT 1), m AS (SELECT median(qty) AS a, median(price) AS b, median(lines) AS c, median(ratio) AS e FROM f)
SELECT l_partkey, round(coalesce(qty, a), 4) AS qty, round(coalesce(price, b), 4) AS price, coalesce(lines, CAST(round_even(c, 0) AS INTEGER)) AS lines, round(coalesce(ratio, e), 6) AS ratio, coalesce(kind, most) AS kind FROM f, m, mo""")
def _(t):
    i = impute_missing(_gappy(t), ["qty", "price", "lines", "ratio", "kind"], "l_partkey", max_missing=2)
    return i.select("l_partkey", r4("qty"), r4("price"), "lines", F.round("ratio", 6).alias("ratio"), "kind")


@query("impute_missing_pmm")
def _(t):
    return impute_missing(_gappy(t), ["qty", "price", "ratio", "kind"], "l_partkey", max_missing=2, method="pmm", draws=5)


@query("impute_missing_forest")
def _(t):
    return impute_missing(_gappy(t), ["qty", "price", "ratio"], "l_partkey", max_missing=2, method="rf", ntree=10, max_iter=2)


# ---- calibration models --------------------------------------------------------------

def _passes(t):
    p = V.depletion_passes(t).where("pass1 is not null and pass2 is not null")
    return p.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(
        "l_partkey", F.col("l_returnflag").alias("species"), "pass1", (F.col("pass1") + F.col("pass2")).alias("total"),
        (F.col("p_size") / 10.0).alias("width"), (F.col("pass1") / F.col("p_size")).alias("dens"), F.col("p_type").alias("crew"),
        F.when(F.col("p_partkey") % 4 == 0, "pool").when(F.col("p_partkey") % 4 == 1, "riffle").when(F.col("p_partkey") % 4 == 2, "run").otherwise("side").alias("tier"))


_PASSES_SQL = f"""{V.PASSES_SQL},
catches AS (SELECT l_partkey, l_returnflag AS species, pass1, pass1 + pass2 AS total, p_size / 10.0 AS width, p_type AS crew,
  CASE p_partkey % 4 WHEN 0 THEN 'pool' WHEN 1 THEN 'riffle' WHEN 2 THEN 'run' ELSE 'side' END AS tier FROM passes JOIN part ON l_partkey = p_partkey WHERE pass1 IS NOT NULL AND pass2 IS NOT NULL)"""


@query("capture_prob_model")
def _(t):
    d = _passes(t)
    train = A.centre(d.where("tier <> 'side'"), ["width", "dens"], d.where("tier <> 'side'"))
    score = A.centre(d.where("tier = 'side'"), ["width", "dens"], d.where("tier <> 'side'"))
    out = M.capture_prob(train, score, "pass1", "total", [*up_to(["species", "width_center", "dens_center"], 2), "crew"])
    return out.select("l_partkey", "species", "pass1", "p", "pSE", "N", "SE", "Nmethod")


# Two factors and their product fit every cell exactly, so SQL knows each probability.
@query("capture_prob_of_cells", f"""WITH {_PASSES_SQL}, c AS (SELECT species, crew, sum(pass1) AS c, sum(total) AS m FROM catches WHERE total > 0 AND pass1 BETWEEN 0 AND total AND tier <> 'side' GROUP BY 1, 2),
p AS (SELECT species, crew, c / m AS p, sqrt(c / m * (1 - c / m) / m) AS se FROM c)
SELECT l_partkey, s.species, round(pass1, 4) AS pass1, round(p, 5) AS p, round(se, 6) AS pse, round(coalesce(pass1 / p, CASE WHEN pass1 = 0 THEN 0 END), 2) AS n FROM catches s LEFT JOIN p ON p.species = s.species AND p.crew = s.crew""")
def _(t):
    d = _passes(t)
    out = M.capture_prob(d.where("tier <> 'side'"), d, "pass1", "total", up_to(["species", "crew"], 2))
    return out.select("l_partkey", "species", r4("pass1"), F.round("p", 5).alias("p"), F.round("pSE", 6).alias("pse"), F.round("N", 2).alias("n"))


@query("snorkel_calibration")
def _(t):
    d = _passes(t)
    return M.calibrate(d.where("tier <> 'side'"), d, "species", "tier", "pass1", "total", "tier + crew + pass1", "crew", average=0.95).select(
        "l_partkey", "species", "tier", "pass1", "phat", "phat_se", "Nhat", "Nhat_se", "route")


# Two terms and their product, each model solved in closed form: Cramer's rule on centred sums.
_OLS = """m AS (SELECT CAST(total AS DOUBLE) AS y, CAST(pass1 AS DOUBLE) AS a, width AS b, pass1 * width AS c FROM catches WHERE width IS NOT NULL),
mu AS (SELECT count(*) AS n, avg(y) AS y_, avg(a) AS a_, avg(b) AS b_, avg(c) AS c_ FROM m),
s AS (SELECT any_value(n) AS n, sum((y - y_) * (y - y_)) AS yy, sum((a - a_) * (a - a_)) AS aa, sum((b - b_) * (b - b_)) AS bb, sum((c - c_) * (c - c_)) AS cc, sum((a - a_) * (b - b_)) AS ab,
  sum((a - a_) * (c - c_)) AS ac, sum((b - b_) * (c - c_)) AS bc, sum((a - a_) * (y - y_)) AS ay, sum((b - b_) * (y - y_)) AS by_, sum((c - c_) * (y - y_)) AS cy FROM m, mu),
d AS (SELECT *, aa * bb - ab * ab AS d2, aa * (bb * cc - bc * bc) - ab * (ab * cc - bc * ac) + ac * (ab * bc - bb * ac) AS d3 FROM s),
fits AS (SELECT 'pass1' AS model, n, 3 AS df, yy - ay * ay / aa AS rss, ay / aa AS ca, CAST(NULL AS DOUBLE) AS cb, CAST(NULL AS DOUBLE) AS cc_, 1 / aa AS va FROM d
  UNION ALL SELECT 'pass1+width', n, 4, yy - (ay * (ay * bb - by_ * ab) + by_ * (by_ * aa - ay * ab)) / d2, (ay * bb - by_ * ab) / d2, (by_ * aa - ay * ab) / d2, NULL, bb / d2 FROM d
  UNION ALL SELECT 'pass1+width+pass1:width', n, 5, yy - ay * x - by_ * z - cy * w, x, z, w, (bb * cc - bc * bc) / d3 FROM (SELECT *, (ay * (bb * cc - bc * bc) - ab * (by_ * cc - bc * cy) + ac * (by_ * bc - bb * cy)) / d3 AS x,
    (aa * (by_ * cc - bc * cy) - ay * (ab * cc - bc * ac) + ac * (ab * cy - by_ * ac)) / d3 AS z, (aa * (bb * cy - by_ * bc) - ab * (ab * cy - by_ * ac) + ay * (ab * bc - bb * ac)) / d3 AS w FROM d)),
ll AS (SELECT *, -0.5 * n * (ln(2 * pi()) + ln(rss / n) + 1) AS loglik, va * rss / (n - df + 1) AS v FROM fits),
ic AS (SELECT *, -2 * loglik + 2 * df + 2.0 * df * (df + 1) / (n - df - 1) AS aicc FROM ll),
w AS (SELECT *, aicc - min(aicc) OVER () AS delta, exp(-0.5 * (aicc - min(aicc) OVER ())) / sum(exp(-0.5 * aicc + 0.5 * best)) OVER () AS weight FROM ic, (SELECT min(aicc) AS best FROM ic))"""


@query("model_average", f"""WITH {_PASSES_SQL}, {_OLS}
SELECT model, df, round(loglik, 3) AS loglik, round(delta, 3) AS delta, round(weight, 5) AS weight, round(ca, 6) AS pass1, round(sqrt(v), 6) AS pass1_se, round(cb, 5) AS width, round(cc_, 6) AS product FROM w""")
def _(t):
    m = M.dredge(_passes(t), "total", ["pass1", "width", "pass1:width"], fixed=["pass1"])
    return m.select("model", "df", F.round("loglik", 3).alias("loglik"), F.round("delta", 3).alias("delta"), F.round("weight", 5).alias("weight"), F.round(F.col("coef")["pass1"], 6).alias("pass1"),
                    F.round(F.sqrt(F.col("var")["pass1"]), 6).alias("pass1_se"), F.round(F.col("coef")["width"], 5).alias("width"), F.round(F.col("coef")["pass1:width"], 6).alias("product"))


@query("model_average_terms")
def _(t):
    return M.averaged(M.dredge(_passes(t), "total", [*up_to(["pass1", "width", "tier"], 2), "crew"], fixed=["pass1"]), 0.95)


# A saturated factor: every level's share is its own estimate, so likelihoods and variances are sums.
@query("model_average_binomial", f"""WITH {_PASSES_SQL},
d AS (SELECT tier, CAST(pass1 AS DOUBLE) AS c, CAST(total AS DOUBLE) AS m FROM catches WHERE total > 0 AND pass1 BETWEEN 0 AND total),
t AS (SELECT tier, sum(c) AS c, sum(m) AS m FROM d GROUP BY 1), g AS (SELECT count(*) AS n, sum(lgamma(m + 1) - lgamma(c + 1) - lgamma(m - c + 1)) AS k FROM d), o AS (SELECT sum(c) AS c, sum(m) AS m, count(*) AS levels FROM t),
ll AS (SELECT n, levels, k + o.c * ln(o.c / o.m) + (o.m - o.c) * ln(1 - o.c / o.m) AS l0, k + (SELECT sum(c * ln(c / m) + (m - c) * ln(1 - c / m)) FROM t) AS l1 FROM g, o),
ic AS (SELECT -2 * l0 + 2 + 4.0 / (n - 2) AS a0, -2 * l1 + 2 * levels + 2.0 * levels * (levels + 1) / (n - levels - 1) AS a1 FROM ll),
w AS (SELECT 1 / (1 + exp(-0.5 * (a0 - a1))) AS w1, 1 - 1 / (1 + exp(-0.5 * (a0 - a1))) AS w0 FROM ic),
b AS (SELECT ln(c / (m - c)) AS i, 1 / c + 1 / (m - c) AS v FROM t WHERE tier = (SELECT min(tier) FROM t)),
e AS (SELECT '(Intercept)' AS term, w0 * ln(o.c / (o.m - o.c)) + w1 * b.i AS estimate, w0, w1, ln(o.c / (o.m - o.c)) AS e0, b.i AS e1, 1 / o.c + 1 / (o.m - o.c) AS v0, b.v AS v1 FROM o, b, w
  UNION ALL SELECT 'tier' || tier, w1 * (ln(t.c / (t.m - t.c)) - b.i), w0, w1, 0, ln(t.c / (t.m - t.c)) - b.i, 0, 1 / t.c + 1 / (t.m - t.c) + b.v FROM t, b, w WHERE tier <> (SELECT min(tier) FROM t))
SELECT term, round(estimate, 5) AS estimate, round(sqrt(w0 * (v0 + pow(e0 - estimate, 2)) + w1 * (v1 + pow(e1 - estimate, 2))), 5) AS se FROM e""")
def _(t):
    out = M.averaged(M.dredge(_passes(t), "pass1", ["tier"], family="binomial", trials="total"))
    return out.select("term", F.round("estimate", 5).alias("estimate"), F.round("se", 5).alias("se"))


# ---- functions of a group ------------------------------------------------------------

def _sums(pdf: pd.DataFrame) -> pd.DataFrame:
    """Regression sums of any part of a nation's customers, raw or already summed."""
    if "sxx" not in pdf:
        x, y = pdf["x"].astype(float), pdf["y"].astype(float)
        pdf = pd.DataFrame({"c_nationkey": pdf["c_nationkey"], "n": 1.0, "sx": x, "sy": y, "sxx": x * x, "sxy": x * y})
    cols = ["n", "sx", "sy", "sxx", "sxy"]
    return pd.DataFrame([{"c_nationkey": pdf["c_nationkey"].iloc[0], **pdf[cols].sum().to_dict()}])


_SUMS = "c_nationkey int, n double, sx double, sy double, sxx double, sxy double"


def _slope(pdf: pd.DataFrame) -> pd.DataFrame:
    r = pdf.iloc[0]
    den = float(r.n * r.sxx - r.sx * r.sx)
    if den == 0:
        raise ValueError("no spread in x")
    b = float(r.n * r.sxy - r.sx * r.sy) / den
    return pd.DataFrame({"c_nationkey": [int(r.c_nationkey)], "slope": [b], "intercept": [float(r.sy - b * r.sx) / float(r.n)]})


_FIT = "c_nationkey int, slope double, intercept double, status string"


@query("grouped_map", """
SELECT c_nationkey, round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 4) AS intercept, 'ok' AS status
FROM (SELECT c_nationkey, CAST(c_custkey * 37 % 10000 AS DOUBLE) AS y, c_acctbal AS x FROM customer) GROUP BY 1""")
def _(t):
    g = W.grouped_map(V.points(t).select("c_nationkey", "x", "y"), ["c_nationkey"], _sums, _SUMS, _slope, _FIT)
    return g.select("c_nationkey", F.round("slope", 6).alias("slope"), r4("intercept"), "status")


@query("failure_isolation", """
SELECT c_nationkey, round(CASE WHEN c_nationkey % 4 <> 0 THEN regr_slope(y, x) END, 6) AS slope, CASE WHEN c_nationkey % 4 = 0 THEN 'failed' ELSE 'ok' END AS status
FROM (SELECT c_nationkey, CAST(c_custkey * 37 % 10000 AS DOUBLE) AS y, c_acctbal AS x FROM customer) GROUP BY 1""")
def _(t):
    d = V.points(t).select("c_nationkey", F.when(F.col("c_nationkey") % 4 == 0, F.lit(2.0)).otherwise(F.col("x")).alias("x"), "y")
    return W.grouped_map(d, ["c_nationkey"], _sums, _SUMS, _slope, _FIT).select("c_nationkey", F.round("slope", 6).alias("slope"), "status")


@query("two_input_map", """
WITH m AS (SELECT c_nationkey AS k, regr_slope(c_custkey * 37 % 10000, c_acctbal) AS b, regr_intercept(c_custkey * 37 % 10000, c_acctbal) AS a FROM customer GROUP BY 1)
SELECT s_suppkey, round(a + b * s_acctbal, 4) AS pred FROM supplier JOIN m ON k = s_nationkey""")
def _(t):
    fit = V.points(t).groupBy(F.col("c_nationkey").alias("s_nationkey")).agg(F.regr_slope("y", "x").alias("b"), F.regr_intercept("y", "x").alias("a"))
    return W.two_input_map(t.supplier, fit, ["s_nationkey"], {"pred": F.round(F.col("a") + F.col("b") * F.col("s_acctbal"), 4)}).select("s_suppkey", "pred")


# ---- spawners and recruits -----------------------------------------------------------

def _sr(t):
    return t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).groupBy(
        F.col("c_nationkey").alias("population"), F.year("o_orderdate").alias("brood")).agg(
        F.count_distinct("o_custkey").alias("spawners"), (F.sum("o_totalprice") / 1000).alias("parr"))


_SR = """sr AS (SELECT c_nationkey AS population, CAST(year(o_orderdate) AS INTEGER) AS brood, count(DISTINCT o_custkey) AS spawners, sum(o_totalprice) / 1000 AS parr
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
st AS (SELECT population, count(*) AS n_obs, max(parr) AS top, regr_slope(1 / parr, 1.0 / spawners) AS ba, regr_intercept(1 / parr, 1.0 / spawners) AS bb, exp(regr_intercept(ln(parr / spawners), spawners)) AS ra,
  -regr_slope(ln(parr / spawners), spawners) AS rb, sum(spawners * parr) / sum(spawners * spawners) AS ha FROM sr GROUP BY 1),
starts AS (SELECT population, n_obs, 'BevertonHolt' AS form, CASE WHEN ba > 0 THEN ba ELSE 0.002 END AS a, CASE WHEN bb > 0 THEN bb ELSE 1 / top END AS b FROM st
  UNION ALL SELECT population, n_obs, 'Ricker', ra, CASE WHEN rb > 0 THEN rb ELSE 1 / top END FROM st UNION ALL SELECT population, n_obs, 'Hockey', ha, top FROM st)"""


@query("spawner_recruit_starts", f"WITH {_SR} SELECT population, n_obs, form, round(a, 6) AS a, round(b, 6) AS b FROM starts")
def _(t):
    s = W.sr_starts(_sr(t), "population", "spawners", "parr")
    return s.select("population", "n_obs", "form", F.round("a", 6).alias("a"), F.round("b", 6).alias("b"))


# Customers of a nation that order in a month, and the suppliers they reach: these run out, so recruits level off.
def _broods(t):
    o = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return o.join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(
        F.col("c_nationkey").alias("population"), F.date_trunc("month", "o_orderdate").alias("brood")).agg(
        F.count_distinct("o_custkey").alias("spawners"), F.count_distinct("l_suppkey").cast("double").alias("parr"))


def _grid_sql(pinned: bool) -> str:
    """The same grid search: every step scores the points around the best one before."""
    y = """CASE form WHEN 'BevertonHolt' THEN lr - ln(s) + ln(1 + exp(u) * s) ELSE lr - CASE WHEN exp(u) * s < 0.01
        THEN u + ln(s) - exp(u) * s / 2 + pow(exp(u) * s, 2) / 24 - pow(exp(u) * s, 4) / 2880 ELSE ln(1 - exp(-exp(u) * s)) END END"""
    error = "sum(pow(y - (u - lb), 2))" if pinned else "sum(y * y) - sum(y) * sum(y) / count(*)"
    low, high, points, fine = W.GRID_LOW, W.GRID_HIGH, W.GRID_POINTS, W.FINE_POINTS
    steps = f"""base AS (SELECT d.population, count(*) AS n, max(s) AS top, min(s) AS low, regr_slope(lr - ln(s), s) AS slope, regr_sxx(lr - ln(s), s) AS sxx, regr_syy(lr - ln(s), s) AS syy,
    avg(s) AS ms, avg(lr - ln(s)) AS mq, avg(lr) AS mr, regr_syy(lr, s) AS syr, {"-ln(max(exp(lr)) * 1.5)" if pinned else "CAST(NULL AS DOUBLE)"} AS lb FROM d GROUP BY 1),
  p0 AS (SELECT population, form, lb, {low} - ln(top) + k * (({high} - {low} + ln(top) - ln(low)) / {points}) AS u, k, ({high} - {low} + ln(top) - ln(low)) / {points} AS step, 0 AS edge
    FROM base, (VALUES ('BevertonHolt'){"" if pinned else ", ('Hockey')"}) f(form), range({points + 1}) r(k) WHERE top > low)"""
    for i in range(W.REFINEMENTS + 1):
        edge = f"CASE WHEN min(k) FILTER (rk = 1) = 0 THEN -1 WHEN min(k) FILTER (rk = 1) = {points} THEN 1 ELSE 0 END" if i == 0 else "max(edge)"
        steps += f""",
  e{i} AS (SELECT population, form, lb, u, k, step, edge, {error} AS e FROM (SELECT p.*, {y} AS y FROM p{i} p JOIN d USING (population)) GROUP BY ALL),
  r{i} AS (SELECT *, row_number() OVER (PARTITION BY population, form ORDER BY e, k) AS rk, lag(e) OVER w AS e0, lead(e) OVER w AS e2 FROM e{i} WINDOW w AS (PARTITION BY population, form ORDER BY k)),
  b{i} AS (SELECT population, form, lb, {edge} AS edge, min(u) FILTER (rk = 1) AS u, max(step) AS step,
    coalesce(min(CASE WHEN e0 - 2 * e + e2 > 0 THEN greatest(least((e0 - e2) / (2 * (e0 - 2 * e + e2)), 1), -1) END) FILTER (rk = 1), 0) AS shift FROM r{i} GROUP BY 1, 2, 3),
  p{i + 1} AS (SELECT population, form, lb, u + k * (step / {fine}) AS u, k, step / {fine} AS step, edge FROM b{i}, range(-{fine}, {fine + 1}) r(k))"""
    z = "exp(u) * s"
    ja = f"CASE form WHEN 'BevertonHolt' THEN -1 / (1 + {z}) ELSE {z} * exp(-{z}) / (1 - exp(-{z})) END"
    return steps + f""",
  best AS (SELECT population, form, edge, u + shift * step AS u FROM b{W.REFINEMENTS}),
  jac AS (SELECT population, form, edge, u AS lc, {y} AS y, {ja} AS ja, CASE form WHEN 'BevertonHolt' THEN -{z} / (1 + {z}) ELSE 1 - {ja} END AS jb FROM best JOIN d USING (population)),
  cur AS (SELECT population, form, edge, lc, avg(y) AS y, sum(y * y) - sum(y) * avg(y) AS sse, sum(ja * ja) AS aa, sum(ja * jb) AS ab, sum(jb * jb) AS bb, sum(y) AS sy, sum(y * y) AS syy_c FROM jac GROUP BY ALL)"""


def _four(c):
    """Four significant digits."""
    return F.when(F.col(c).isNotNull(), F.format_string("%.3e", F.col(c))).cast("double")


_FIT_OUT = ", ".join(f"CAST(printf('%.3e', {c}) AS DOUBLE) AS {c}" for c in ("a", "b", "sse", "est", "se", "cv"))
_BROODS = """d AS (SELECT c_nationkey AS population, CAST(count(DISTINCT o_custkey) AS DOUBLE) AS s, ln(CAST(count(DISTINCT l_suppkey) AS DOUBLE)) AS lr
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey GROUP BY c_nationkey, date_trunc('month', o_orderdate))"""


@query("spawner_recruit_fit", f"""WITH {_BROODS}, {_grid_sql(False)},
x AS (SELECT b.*, f.form, c.* EXCLUDE (population, form, edge), CASE WHEN n <= 2 OR top <= low THEN 'failed' WHEN CASE f.form WHEN 'Ricker' THEN CASE WHEN slope * top >= -exp({W.GRID_LOW}) THEN -1 ELSE 0 END ELSE c.edge END < 0
    THEN 'no density dependence' WHEN f.form <> 'Ricker' AND c.edge > 0 THEN 'at capacity' ELSE 'ok' END AS status
  FROM base b CROSS JOIN (VALUES ('BevertonHolt'), ('Ricker'), ('Hockey')) f(form) LEFT JOIN cur c ON c.population = b.population AND c.form = f.form),
l AS (SELECT *, CASE status WHEN 'no density dependence' THEN CASE form WHEN 'BevertonHolt' THEN -mq ELSE mq END WHEN 'ok' THEN CASE form WHEN 'Ricker' THEN mq - slope * ms WHEN 'BevertonHolt' THEN -y ELSE y + lc END END AS la,
    CASE status WHEN 'at capacity' THEN CASE form WHEN 'BevertonHolt' THEN -mr ELSE mr END WHEN 'ok' THEN CASE form WHEN 'Ricker' THEN ln(-slope) WHEN 'BevertonHolt' THEN lc - y ELSE y END END AS lnb,
    CASE status WHEN 'no density dependence' THEN syy WHEN 'at capacity' THEN syr WHEN 'ok' THEN CASE form WHEN 'Ricker' THEN syy - slope * slope * sxx ELSE sse END END AS err FROM x),
v AS (SELECT population, form, n AS n_obs, status, CASE WHEN la IS NOT NULL THEN exp(la) WHEN status = 'at capacity' AND form = 'BevertonHolt' THEN 0 END AS a,
    CASE WHEN status = 'no density dependence' AND form <> 'Hockey' THEN 0 ELSE exp(lnb) END AS b, err AS sse,
    CASE WHEN status IN ('ok', 'at capacity') THEN CASE form WHEN 'Ricker' THEN exp(la - lnb - 1) WHEN 'BevertonHolt' THEN exp(-lnb) ELSE exp(lnb) END END AS est,
    CASE status WHEN 'at capacity' THEN err / (n - 1) / n WHEN 'ok' THEN err / (n - 2) * CASE form WHEN 'Ricker' THEN 1.0 / n + pow(ms - exp(-lnb), 2) / sxx ELSE aa / (aa * bb - ab * ab) END END AS lv FROM l),
o AS (SELECT *, est * sqrt(lv) AS se, sqrt(lv) AS cv FROM v)
SELECT population, form, n_obs, status, {_FIT_OUT} FROM o""")
def _(t):
    fit = W.fit_sr(_broods(t), "population", "spawners", "parr")
    return fit.select("population", "form", "n_obs", "status", *[_four(c).alias(c) for c in fit.columns[4:]])


@query("sr_fixed_capacity", f"""WITH {_BROODS}, {_grid_sql(True)},
x AS (SELECT b.*, c.* EXCLUDE (population, form, edge), CASE WHEN n <= 1 OR top <= low THEN 'failed' WHEN edge <> 0 THEN 'at capacity' ELSE 'ok' END AS status FROM base b LEFT JOIN cur c USING (population)),
o AS (SELECT population, 'BevertonHolt' AS form, n AS n_obs, status, CASE status WHEN 'ok' THEN exp(lb - lc) WHEN 'at capacity' THEN 0 END AS a, CASE WHEN status <> 'failed' THEN exp(lb) END AS b,
    CASE status WHEN 'ok' THEN syy_c - 2 * (lc - lb) * sy + n * pow(lc - lb, 2) WHEN 'at capacity' THEN syr + n * pow(mr + lb, 2) END AS sse, CASE WHEN status <> 'failed' THEN exp(-lb) END AS est,
    CASE WHEN status <> 'failed' THEN 0.0 END AS se, CASE WHEN status <> 'failed' THEN 0.0 END AS cv FROM x)
SELECT population, form, n_obs, status, {_FIT_OUT} FROM o""")
def _(t):
    d = _broods(t)
    cap = d.groupBy("population").agg((1 / (F.max("parr") * 1.5)).alias("b"))
    fit = W.fit_sr(d, "population", "spawners", "parr", fixed_b=cap)
    return fit.select("population", "form", "n_obs", "status", *[_four(c).alias(c) for c in fit.columns[4:]])


@query("sr_curve", f"""WITH {_SR}, top AS (SELECT population, max(spawners) AS m FROM sr GROUP BY 1),
g AS (SELECT s.*, unnest(generate_series(1, m)) AS spawners FROM starts s JOIN top t ON t.population = s.population)
SELECT population, form, spawners, round(CASE form WHEN 'BevertonHolt' THEN spawners / (a + b * spawners) WHEN 'Ricker' THEN a * spawners * exp(-b * spawners) ELSE b * (1 - exp(-a / b * spawners)) END, 4) AS parr FROM g""")
def _(t):
    d = _sr(t)
    c = W.sr_curve(W.sr_starts(d, "population", "spawners", "parr"), d.groupBy("population").agg(F.max("spawners").alias("top")), "population", "top")
    return c.select("population", "form", "spawners", r4("parr"))


# ---- comparisons ---------------------------------------------------------------------

@query("ci_containment", """
WITH e AS (SELECT o_custkey, o_orderpriority AS form, avg(o_totalprice) AS est, 20000.0 + o_custkey % 100 * 500 AS se FROM orders GROUP BY 1, 2),
x AS (SELECT o_custkey, form, est, CASE WHEN est - 1.959963984540054 * se <= 0 THEN 1 ELSE est - 1.959963984540054 * se END AS lwr, CASE WHEN est + 1.959963984540054 * se > 400000 THEN 400000 ELSE est + 1.959963984540054 * se END AS upr FROM e),
r AS (SELECT o_custkey, est AS re, lwr AS rl, upr AS ru FROM x WHERE form = '5-LOW'), j AS (SELECT x.*, est BETWEEN rl AND ru AS a, re BETWEEN lwr AND upr AS b, lwr <= ru AND upr >= rl AS c FROM x JOIN r ON r.o_custkey = x.o_custkey WHERE form <> '5-LOW')
SELECT form, count(DISTINCT o_custkey) AS n_pops, round(sum(a::INT) / count(DISTINCT o_custkey), 6) AS perc_in_ref_ci, round(sum(b::INT) / count(DISTINCT o_custkey), 6) AS perc_ref_in_ci,
  round(sum(c::INT) / count(DISTINCT o_custkey), 6) AS perc_overlap_ci FROM j GROUP BY 1""")
def _(t):
    e = t.orders.groupBy("o_custkey", F.col("o_orderpriority").alias("form")).agg(F.avg("o_totalprice").alias("est")).withColumn(
        "se", F.lit(20000.0) + F.col("o_custkey") % 100 * 500)
    _rows, s = W.ci_compare(e.where("form <> '5-LOW'"), e.where("form = '5-LOW'"), "o_custkey", "form", "est", "se", cap=400000.0)
    return s.select("form", "n_pops", *[F.round(c, 6).alias(c) for c in s.columns[2:]])


@query("outlier_cap", """
WITH q AS (SELECT quantile_cont(l_quantity / (1 + l_linenumber), 0.99) AS t FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, round(CASE WHEN l_extendedprice / 4000 > t THEN t ELSE l_extendedprice / 4000 END, 9) AS cap, CASE WHEN l_extendedprice / 4000 <= t THEN l_tax END AS se FROM lineitem, q""")
def _(t):
    d = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_extendedprice") / 4000).alias("cap"), F.col("l_tax").alias("se"))
    ref = t.lineitem.select((F.col("l_quantity") / (F.col("l_linenumber") + 1)).alias("dens"))
    return W.cap_at(d, "cap", "se", ref, "dens").withColumn("cap", F.round("cap", 9))


@query("point_vs_reach", f"""WITH {V.REACHES_SQL},
m AS (SELECT stream, CASE WHEN lifestage < '3' THEN 'point' ELSE 'reach' END AS method, sum(length) AS len, sum(length * cap) AS cap, sqrt(sum(pow(length * se, 2))) AS se FROM reaches GROUP BY 1, 2),
w AS (SELECT stream, max(len) FILTER (WHERE method = 'point') AS lp, max(len) FILTER (WHERE method = 'reach') AS lr, max(cap) FILTER (WHERE method = 'point') AS cp, max(cap) FILTER (WHERE method = 'reach') AS cr,
  max(se) FILTER (WHERE method = 'point') AS sp, max(se) FILTER (WHERE method = 'reach') AS sr FROM m GROUP BY 1), d AS (SELECT stream, cp / lp * lr AS cap_point, cr AS cap_reach, cr - cp / lp * lr AS diff, sqrt(sr * sr + sp * sp) AS e FROM w WHERE cp IS NOT NULL AND cr IS NOT NULL)
SELECT stream, round(cap_point, 4) AS cap_point, round(cap_reach, 6) AS cap_reach, round(diff, 4) AS cap_diff, round(diff / cap_point, 6) AS cap_rel_diff, round(e, 4) AS cap_diff_se,
  diff - 1.959963984540054 * e < 0 AND diff + 1.959963984540054 * e > 0 AS incl_zero FROM d""")
def _(t):
    d = V.reaches(t).withColumn("method", F.when(F.col("lifestage") < "3", "point").otherwise("reach"))
    m = d.groupBy("stream", "method").agg(F.sum("length").alias("len"), F.sum(F.col("length") * F.col("cap")).alias("cap"), A.rss(F.col("length") * F.col("se")).alias("se"))
    r = W.method_diff(m, ["stream"], "method", "len", "cap", "se")
    return r.select("stream", r4("cap_point"), F.round("cap_reach", 6).alias("cap_reach"), r4("cap_diff"), F.round("cap_rel_diff", 6).alias("cap_rel_diff"), r4("cap_diff_se"), "incl_zero")


# Life-cycle parameters per species.
PARAMS = {"F": (0.5, 1.0, 5400.0, 0.11, 0.28), "O": (0.6, 1.2, 4900.0, 0.05, 0.25)}
_NAMES = ("prop_fem", "redd_per_fem", "fecund", "egg_to_parr", "parr_to_presmolt")


def _params(t):
    return t.spark.createDataFrame([(sp, n, v) for sp, vs in PARAMS.items() for n, v in zip(_NAMES, vs)], "species string, parameter string, value double")


def _goals(t):
    d = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    # Two species have parameters: one status is the first, all others are the second.
    return d.groupBy(F.col("c_nationkey").alias("watershed"), F.when(F.col("o_orderstatus") == "F", "F").otherwise("O").alias("species")).agg(
        (F.count(F.lit(1)) / 2.0).alias("mean"), F.count_distinct("o_custkey").cast("double").alias("max"), (F.count(F.lit(1)) * 1.25).alias("mat"))


def _life_sql() -> str:
    vals = ", ".join(f"('{sp}', {', '.join(map(str, v))})" for sp, v in PARAMS.items())
    return f"""par(species, fem, rpf, fec, etp, ptp) AS (VALUES {vals}),
goals AS (SELECT c_nationkey AS watershed, CASE WHEN o_orderstatus = 'F' THEN 'F' ELSE 'O' END AS species, count(*) / 2.0 AS mean, CAST(count(DISTINCT o_custkey) AS DOUBLE) AS max, count(*) * 1.25 AS mat FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
gl AS (SELECT watershed, species, 'mean' AS scenario, CAST(mean AS DOUBLE) AS e FROM goals UNION ALL SELECT watershed, species, 'max', max FROM goals UNION ALL SELECT watershed, species, 'mat', mat FROM goals),
lc AS (SELECT watershed, gl.species, scenario, e, e * fem * rpf AS r, e * fem * rpf * fec AS g, e * fem * rpf * fec * etp AS p, e * fem * rpf * fec * etp * ptp AS s FROM gl JOIN par USING (species)),
life AS (SELECT watershed, species, scenario, 'escapement' AS lifestage, e AS abundance FROM lc UNION ALL SELECT watershed, species, scenario, 'redds', r FROM lc UNION ALL SELECT watershed, species, scenario, 'eggs', g FROM lc
  UNION ALL SELECT watershed, species, scenario, 'parr', p FROM lc UNION ALL SELECT watershed, species, scenario, 'presmolts', s FROM lc)"""


_LIFE = _life_sql()


@query("lifecycle_cascade", f"WITH {_LIFE} SELECT watershed, species, scenario, lifestage, round(abundance, 4) AS abundance FROM life")
def _(t):
    c = W.lifecycle(_goals(t), _params(t), ["watershed"], "species", ["mean", "max", "mat"])
    return c.withColumn("abundance", F.round("abundance", 4))


@query("capacity_vs_goal", f"""WITH {_LIFE},
cap AS (SELECT c_nationkey AS watershed, l_linestatus AS species, 'capacity' AS scenario, CASE WHEN l_linenumber <= 3 THEN 'redds' ELSE 'parr' END AS lifestage, sum(l_quantity) AS abundance FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3, 4),
b AS (SELECT * FROM cap UNION ALL SELECT watershed, species, scenario, lifestage, abundance FROM life WHERE lifestage IN ('redds', 'parr')), k AS (SELECT DISTINCT watershed, species, lifestage FROM b)
SELECT k.watershed, k.species, k.lifestage, s AS scenario, round(max(abundance), 4) AS abundance FROM k JOIN (VALUES ('capacity'), ('mean'), ('max'), ('mat')) v(s) ON true
LEFT JOIN b ON b.watershed = k.watershed AND b.species = k.species AND b.lifestage = k.lifestage AND b.scenario = s GROUP BY 1, 2, 3, 4""")
def _(t):
    d = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    cap = d.groupBy(F.col("c_nationkey").alias("watershed"), F.col("l_linestatus").alias("species"), F.when(F.col("l_linenumber") <= 3, "redds").otherwise("parr").alias("lifestage")).agg(
        F.sum("l_quantity").alias("abundance")).withColumn("scenario", F.lit("capacity"))
    goals = W.lifecycle(_goals(t), _params(t), ["watershed"], "species", ["mean", "max", "mat"]).where("lifestage in ('redds', 'parr')")
    c = W.capacity_vs_goal(cap, goals, ["watershed", "species", "lifestage"], ["capacity", "mean", "max", "mat"])
    return c.withColumn("abundance", F.round("abundance", 4))


@query("brood_backcast", """
WITH tr AS (SELECT c_nationkey AS pop, CAST(year(o_orderdate) AS INTEGER) AS brood, CASE o_orderstatus WHEN 'F' THEN 'Parr' WHEN 'O' THEN 'Presmolt' ELSE 'Smolt' END AS stage, CASE WHEN c_nationkey % 6 <> 5 THEN sum(o_totalprice) / 1000 END AS est
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3, o_orderstatus),
sv AS (SELECT pop, brood, stage, 0.2 + (pop + brood) % 5 / 10.0 AS rate FROM tr WHERE stage <> 'Parr' AND brood % 2 = 0), av AS (SELECT pop, stage, avg(rate) AS r FROM sv GROUP BY 1, 2)
SELECT tr.pop, tr.brood, round(sum(coalesce(est, 0) / CASE WHEN tr.stage = 'Parr' THEN 1 ELSE coalesce(rate, r) END), 7) AS parr FROM tr LEFT JOIN sv ON sv.pop = tr.pop AND sv.brood = tr.brood AND sv.stage = tr.stage
LEFT JOIN av ON av.pop = tr.pop AND av.stage = tr.stage GROUP BY 1, 2""")
def _(t):
    d = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    tr = d.groupBy(F.col("c_nationkey").alias("pop"), F.year("o_orderdate").alias("brood"), S.recode("o_orderstatus", {"F": "Parr", "O": "Presmolt", "P": "Smolt"}).alias("stage")).agg(
        (F.sum("o_totalprice") / 1000).alias("est")).withColumn("est", F.when(F.col("pop") % 6 != 5, F.col("est")))
    sv = tr.where("stage <> 'Parr' and brood % 2 = 0").select("pop", "brood", "stage", (F.lit(0.2) + (F.col("pop") + F.col("brood")) % 5 / 10.0).alias("rate"))
    return W.backcast(tr, sv, "pop", "brood", "stage", "est", "rate").withColumn("parr", F.round("parr", 7))


@query("total_migrants", """
WITH m AS (SELECT l_partkey, CASE WHEN l_partkey % 3 = 0 THEN sum(l_quantity) END AS tot, CASE WHEN l_partkey % 4 <> 0 THEN sum(l_quantity) FILTER (WHERE l_linenumber <= 3) END AS fall, sum(l_quantity) FILTER (WHERE l_linenumber > 3) AS spring FROM lineitem GROUP BY 1)
SELECT l_partkey, CASE WHEN tot IS NOT NULL THEN tot WHEN fall IS NULL THEN spring END AS total_migrants, round(CASE WHEN fall IS NULL THEN spring / 0.32 ELSE fall + spring / 0.32 END, 4) AS parr FROM m""")
def _(t):
    k, q, n = F.col("l_partkey"), F.col("l_quantity"), F.col("l_linenumber")
    m = t.lineitem.groupBy("l_partkey").agg(F.sum(q).alias("tot"), A.agg_if(F.sum, q, n <= 3).alias("fall"), A.agg_if(F.sum, q, n > 3).alias("spring"))
    m = m.withColumns({"tot": F.when(k % 3 == 0, F.col("tot")), "fall": F.when(k % 4 != 0, F.col("fall"))})
    return W.parr_est(m, "tot", "fall", "spring").select("l_partkey", "total_migrants", r4("parr"))


@query("source_priority_union", """
WITH a AS (SELECT o_custkey, CAST(year(o_orderdate) AS INTEGER) AS yr, round(sum(o_totalprice), 4) AS parr FROM orders WHERE o_orderstatus = 'F' GROUP BY 1, 2), b AS (SELECT o_custkey, CAST(year(o_orderdate) AS INTEGER) AS yr, round(sum(o_totalprice), 4) AS parr FROM orders GROUP BY 1, 2)
SELECT o_custkey, yr, parr, true AS estimated FROM a UNION ALL SELECT o_custkey, yr, parr, false FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.o_custkey = b.o_custkey AND a.yr = b.yr)""")
def _(t):
    def src(d, flag):
        return d.groupBy("o_custkey", F.year("o_orderdate").alias("yr")).agg(F.round(F.sum("o_totalprice"), 4).alias("parr")).withColumn("estimated", F.lit(flag))
    return J.prefer(src(t.orders.where("o_orderstatus = 'F'"), True), src(t.orders, False), ["o_custkey", "yr"])


@query("prev_version_clip", f"""WITH {V.REACHES_SQL} SELECT reach_id, stream, round(cap, 10) AS cap FROM reaches WHERE regexp_matches(watershed, '^A') AND regexp_matches(stream, '_1[0-9]*$')""")
def _(t):
    return W.subset_population(V.reaches(t), {"watershed": "^A", "stream": "_1[0-9]*$"}).select("reach_id", "stream", F.round("cap", 10).alias("cap"))


@query("population_rollup", f"""WITH {V.REACHES_SQL},
p AS (SELECT watershed, stream, CASE WHEN species = 'F' THEN 'points' ELSE 'reaches' END AS m, sum(length) AS l, count(DISTINCT reach_id) AS n, sum(length * cap) AS c, sqrt(sum(pow(length * se, 2))) AS s FROM reaches WHERE in_domain GROUP BY 1, 2, 3)
SELECT a.watershed, a.stream, a.l AS length_points, a.n AS n_ids_points, round(a.c, 6) AS cap_tot_points, round(a.s, 4) AS cap_tot_se_points, b.l AS length_reaches, b.n AS n_ids_reaches, round(b.c, 6) AS cap_tot_reaches, round(b.s, 4) AS cap_tot_se_reaches,
  round(a.c / a.l, 6) AS cap_dens_points, round(b.c / b.l, 6) AS cap_dens_reaches, round((b.c - a.c) / a.c, 6) AS rel_diff, round(corr(a.c, b.c) OVER (PARTITION BY a.watershed), 6) AS corr
FROM p a JOIN p b ON a.watershed = b.watershed AND a.stream = b.stream AND a.m = 'points' AND b.m = 'reaches'""")
def _(t):
    d = V.reaches(t).where("in_domain").withColumns({"c": F.col("length") * F.col("cap"), "s": F.col("length") * F.col("se")})
    r = W.population_rollup({"points": d.where("species = 'F'"), "reaches": d.where("species = 'O'")}, ["watershed", "stream"], "length", "c", "s", "reach_id")
    r = J.with_group_stats(r.where("cap_tot_points > 0 and cap_tot_reaches > 0"), ["watershed"], {"corr": F.corr("cap_tot_points", "cap_tot_reaches")})
    dp = {"cap_tot_se_points": 4, "cap_tot_se_reaches": 4}
    return r.select("watershed", "stream", *[c if c.startswith(("n_", "length")) else F.round(c, dp.get(c, 6)).alias(c) for c in r.columns[2:]])
