"""Survey-weighted extrapolation: strata, weights, linear models with design-based errors, folds."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from reachworks.functions.scalars import Z975, unite
from reachworks.operators.aggregates import quantiles
from reachworks.operators.joins import natural_join, with_group_stats

VECTOR = ArrayType(DoubleType())
MATRIX = ArrayType(VECTOR)


# ---- strata and weights --------------------------------------------------------------

def site_strata(sites: DataFrame, attrs: DataFrame, site: str, group: str, stratum: str,
                rules: Sequence[tuple[Column, Column]], strip: str) -> DataFrame:
    """Stratum label per site: group-specific rules first, else the attribute table's stratum.

    Text matching ``strip`` is removed; sites without a stratum drop out.
    """
    base = natural_join(sites.select(site, group).distinct(), attrs.select(site, stratum), "left", [site])
    label = F.col(stratum)
    for cond, value in reversed(list(rules)):
        label = F.when(cond, value).otherwise(label)
    out = base.withColumn("strata", F.regexp_replace(label, strip, ""))
    return out.where("strata is not null").select(site, group, unite(group, "strata").alias("strata"))


def strata_length(frame: DataFrame, keys: Sequence[str], length: str, extra: DataFrame | None = None) -> DataFrame:
    """Frame length (km) per stratum, plus strata known only by a stated length."""
    out = frame.groupBy(*keys).agg((F.sum(length) / 1000).alias("tot_length_km"))
    return out if extra is None else out.unionByName(extra.select(*keys, "tot_length_km"))


def strata_table(sites: DataFrame, lengths: DataFrame, keys: Sequence[str], site: str) -> DataFrame:
    counts = sites.groupBy(*keys).agg(F.count_distinct(site).alias("n_sites"))
    both = natural_join(counts, lengths, "full", keys)
    return both.withColumn("n_sites", F.coalesce("n_sites", F.lit(0))).withColumn(
        "site_weight", F.try_divide("tot_length_km", "n_sites"))


def design_weights(sites: DataFrame, strata: DataFrame, keys: Sequence[str], within: Sequence[str],
                   length: str) -> DataFrame:
    """Stratum weight per site, own length where there is none, normalised within ``within``."""
    w = natural_join(sites, strata.select(*keys, "site_weight"), "left", keys).withColumn(
        "site_weight", F.coalesce("site_weight", F.col(length) / 1000))
    return with_group_stats(w, within, {"sum_weights": F.sum("site_weight")}).withColumn(
        "adj_weight", F.try_divide("site_weight", "sum_weights"))


def frame_coverage(strata: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Share of the frame length lying in strata without a site."""
    empty = F.coalesce(F.sum(F.when(F.col("n_sites") == 0, F.col("tot_length_km"))), F.lit(0.0))
    return strata.groupBy(*keys).agg(
        F.coalesce(F.sum("tot_length_km"), F.lit(0.0)).alias("tot_length_km"), empty.alias("missing_length"),
        F.coalesce(F.try_divide(empty, F.sum("tot_length_km")), F.lit(0.0)).alias("perc_missing"))


# ---- linear models -------------------------------------------------------------------

def levels(df: DataFrame, col: str) -> list:
    """Sorted levels of a categorical covariate: as many as the columns or models that are asked for, whatever the rows."""
    got = [r[0] for r in df.select(col).where(F.col(col).isNotNull()).distinct().collect()]
    return sorted(got)


def design_array(num: Sequence[str], cat: Mapping[str, Sequence], intercept: bool = False
                 ) -> tuple[Column, list[str]]:
    """Model row as an array column.  Without an intercept the first factor keeps all its levels,
    later factors drop their first."""
    terms, names = [], []
    if intercept:
        terms.append(F.lit(1.0))
        names.append("(Intercept)")
    for c in num:
        terms.append(F.col(c).cast("double"))
        names.append(c)
    full = not intercept
    for c, lv in cat.items():
        for level in (lv if full else lv[1:]):
            terms.append((F.col(c) == F.lit(level)).cast("double"))
            names.append(f"{c}{level}")
        full = False
    return F.array(*terms), names


def _upper(k: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(k) for j in range(i, k)]


def _square(flat: np.ndarray, k: int) -> np.ndarray:
    m = np.zeros((k, k))
    for v, (i, j) in zip(flat, _upper(k)):
        m[i, j] = m[j, i] = v
    return m


@F.pandas_udf(StructType([StructField("coef", VECTOR), StructField("inv", MATRIX)]))
def _solve(xtx: pd.Series, xty: pd.Series) -> pd.DataFrame:
    rows = []
    for a, b in zip(xtx, xty):
        k = len(b)
        inv = np.linalg.pinv(_square(np.asarray(a, dtype=float), k), hermitian=True)
        rows.append({"coef": (inv @ np.asarray(b, dtype=float)).tolist(), "inv": inv.tolist()})
    return pd.DataFrame(rows, columns=["coef", "inv"])


@F.pandas_udf(MATRIX)
def _sandwich(inv: pd.Series, meat: pd.Series) -> pd.Series:
    out = []
    for a, m in zip(inv, meat):
        a = np.array([list(r) for r in a], dtype=float)
        out.append((a @ _square(np.asarray(m, dtype=float), len(a)) @ a).tolist())
    return pd.Series(out)


def complete(rows: DataFrame, k: int) -> DataFrame:
    """Rows without a gap in the ``k`` places of ``__x``, in ``__y`` or ``__w``: tests of columns, no walk over arrays."""
    known = F.col("__y").isNotNull() & F.col("__w").isNotNull()
    for i in range(k):
        known = known & F.col("__x")[i].isNotNull()
    return rows.where(known)


def svy_lm(df: DataFrame, y: str, x: Column, k: int, w: str, by: Sequence[str] = ()) -> DataFrame:
    """Weighted least squares for every ``by`` group from one pass of cross-product sums.

    Only k*(k+1)/2 numbers per group leave the map side; the small solves run on the group table.
    Rows with a gap in the response, the weight or any covariate are left out whole.
    Returns ``by, coef, inv`` with ``inv`` the inverse of X'WX.
    """
    data = complete(df.select(*by, x.alias("__x"), F.col(y).alias("__y"), F.col(w).alias("__w")), k)
    xi = lambda i: F.col("__x")[i]
    xtx = F.array(*[F.sum(F.col("__w") * xi(i) * xi(j)) for i, j in _upper(k)])
    xty = F.array(*[F.sum(F.col("__w") * xi(i) * F.col("__y")) for i in range(k)])
    mom = data.groupBy(*by).agg(xtx.alias("xtx"), xty.alias("xty"))
    return mom.withColumn("s", _solve("xtx", "xty")).select(*by, "s.coef", "s.inv")


def dot(a: Column, b: Column, k: int | None = None) -> Column:
    """Inner product; with the length known, plain arithmetic that is compiled."""
    if k:
        return sum((a[i] * b[i] for i in range(1, k)), a[0] * b[0])
    return F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)


def design_vcov(df: DataFrame, fit: DataFrame, y: str, x: Column, k: int, w: str, strata: str,
                by: Sequence[str] = (), lonely: str = "certainty") -> DataFrame:
    """Sandwich covariance with stratified scores.

    Strata with one unit add nothing ('certainty') or are centred at the grand mean ('adjust').
    Rows with a gap are left out, as in the fit.  Adds ``vcov`` to the fit table.
    """
    rows = complete(df.select(*by, strata, x.alias("__x"), F.col(y).alias("__y"), F.col(w).alias("__w")), k)
    if by:
        f = fit.select(*[F.col(b).alias(f"__f_{b}") for b in by], "coef")
        rows = rows.join(f, [rows[b].eqNullSafe(f[f"__f_{b}"]) for b in by])
    else:
        rows = rows.withColumn("coef", fit.select("coef").scalar())
    resid = F.col("__y") - dot(F.col("__x"), F.col("coef"), k)
    u = rows.withColumn("__e", F.col("__w") * resid)
    s = lambda i: F.col("__x")[i] * F.col("__e")
    per = u.groupBy(*by, strata).agg(
        F.count(F.lit(1)).alias("n"), F.array(*[F.sum(s(i)) for i in range(k)]).alias("s1"),
        F.array(*[F.sum(s(i) * s(j)) for i, j in _upper(k)]).alias("s2"))
    if lonely == "adjust":
        per = with_group_stats(per, by, {
            "__g": F.array(*[F.sum(F.col("s1")[i]) / F.sum("n") for i in range(k)])})
    parts = []
    for p, (i, j) in enumerate(_upper(k)):
        a, b, ab = F.col("s1")[i], F.col("s1")[j], F.col("s2")[p]
        spread = (ab - a * b / F.col("n")) * F.col("n") / F.when(F.col("n") > 1, F.col("n") - 1)
        alone = F.lit(0.0) if lonely == "certainty" else (a - F.col("__g")[i]) * (b - F.col("__g")[j])
        parts.append(F.sum(F.when(F.col("n") > 1, spread).otherwise(alone)))
    meat = per.groupBy(*by).agg(F.array(*parts).alias("meat"))
    # Without groups both sides are a single row.
    one = lambda d: d.withColumn("__one", F.lit(1))
    both = natural_join(fit, meat, "inner", by) if by else one(fit).join(one(meat), "__one").drop("__one")
    return both.withColumn("vcov", _sandwich("inv", "meat")).drop("meat")


def root(variance: Column | str) -> Column:
    """Square root of a variance that rounding may have pushed below zero; NULL where the variance is unknown."""
    v = F.col(variance) if isinstance(variance, str) else variance
    return F.when(v.isNotNull(), F.sqrt(F.greatest(v, F.lit(0.0))))


def predict_lm(df: DataFrame, fit: DataFrame, x: Column, by: Sequence[str] = (), log: bool = True) -> DataFrame:
    """Fitted value and SE per row; log responses are retransformed."""
    f = fit.select(*by, "coef", "vcov")
    rows = natural_join(df.withColumn("__x", x), f, "inner", by) if by else df.withColumn("__x", x).withColumns(
        {"coef": fit.select("coef").scalar(), "vcov": fit.select("vcov").scalar()})
    vx = F.transform(F.col("vcov"), lambda r: dot(r, F.col("__x")))
    var = dot(vx, F.col("__x"))
    out = rows.withColumns({"fit": dot(F.col("coef"), F.col("__x")), "fit_se": root(var)})
    if log:
        cap, se = retransform("fit", "fit_se")
        out = out.withColumns({"pred_cap": cap, "pred_se": se})
    return out.drop("__x", "coef", "vcov")


def retransform(f: str | Column, se: str | Column) -> tuple[Column, Column]:
    """Log-scale fit and SE to the natural scale, second-order corrected."""
    f, se = (F.col(c) if isinstance(c, str) else c for c in (f, se))
    cap = F.exp(f) * (1 + se * se / 2)
    return cap, cap * se


def seen_levels(score: DataFrame, train: DataFrame, col: str) -> DataFrame:
    """Only rows whose factor level was present in training."""
    return natural_join(score, train.select(col).where(F.col(col).isNotNull()).distinct(), "left_semi", [col])


def assign_by_bridge(reach: DataFrame, bridge: DataFrame, key: str, target: str) -> DataFrame:
    """Attach a group through the distinct pairs of a bridge table."""
    return natural_join(reach, bridge.select(key, target).distinct(), "left", [key])


def reach_table(preds: DataFrame, ids: Sequence[str], species: str, kind: str, levels_: Sequence[tuple[str, str]],
                value: str, se: str) -> DataFrame:
    """One row per reach with ``{species}_{kind}`` and ``{species}_{kind}_se`` columns."""
    cells = []
    for sp, kd in levels_:
        here = (F.col(species) == sp) & (F.col(kind) == kd)
        cells += [F.max(F.when(here, F.col(value))).alias(f"{sp}_{kd}"),
                  F.max(F.when(here, F.col(se))).alias(f"{sp}_{kd}_se")]
    return preds.groupBy(*ids).agg(*cells)


def covariate_coverage(df: DataFrame, key: str, by: Sequence[str], metrics: Sequence[str], ref: DataFrame) -> DataFrame:
    """Per metric and group: keys in and out of the reference range and how far the range is exceeded."""
    bounds = ref.agg(F.struct(*[f(m).cast("double").alias(f"{n}_{m}") for m in metrics
                                for n, f in (("lo", F.min), ("hi", F.max))]).alias("s")).scalar()
    long = df.select(key, *by, F.inline(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"),
                 bounds[f"lo_{m}"].alias("lo"), bounds[f"hi_{m}"].alias("hi")) for m in metrics]))).where("value is not null")
    inside = (F.col("value") >= F.col("lo")) & (F.col("value") <= F.col("hi"))
    # Two-step distinct: one row per key first, so no task holds a whole group of keys.
    per_key = long.groupBy("metric", *by, "lo", "hi", key).agg(
        F.max(inside.cast("int")).alias("any_in"), F.max((~inside).cast("int")).alias("any_out"),
        F.max("value").alias("mx"), F.min("value").alias("mn"))
    g = per_key.groupBy("metric", *by, "lo", "hi").agg(
        F.count(F.lit(1)).alias("n"), F.sum("any_in").alias("n_in"), F.sum("any_out").alias("n_out"),
        F.max("mx").alias("max_val"), F.min("mn").alias("min_val"))
    return g.select(
        "metric", *by, "n", "n_in", "n_out", (F.col("n_in") / F.col("n")).alias("pct_in"),
        F.when(F.col("max_val") > F.col("hi"), F.try_divide(F.col("max_val") - F.col("hi"), F.col("hi"))).alias("pct_max_over"),
        F.when(F.col("min_val") < F.col("lo"), F.try_divide(F.col("min_val") - F.col("lo"), F.col("lo"))).alias("pct_min_under"))


# ---- cross-validation ----------------------------------------------------------------

def fold_of(key: str | Column, k: int, seed: int = 8) -> Column:
    """Fold number from the key alone: the same on every run and every retry."""
    key = F.col(key) if isinstance(key, str) else key
    digest = F.substring(F.md5(F.concat(key.cast("string"), F.lit(f"-{seed}"))), 1, 8)
    return (F.conv(digest, 16, 10).cast("bigint") % k).cast("int")


def kfold(df: DataFrame, k: int, key: str, seed: int = 8) -> DataFrame:
    """Every row with the one fold that tests it; it trains all others."""
    return df.withColumn("fold", fold_of(key, k, seed))


def leave_one_group_out(df: DataFrame, group: str) -> DataFrame:
    """One fold per group: its rows test, all others train."""
    return df.withColumn("fold", F.col(group))


def fold_moments(folded: DataFrame, aggs: Mapping[str, Column], by: Sequence[str] = ()) -> DataFrame:
    """(by, fold, test_*, train_*): sums over each fold's rows and over all rows but its own.

    Training sums are the total less the fold's own, so no row is read or sent for more than its own fold.
    """
    own = folded.where(F.col("fold").isNotNull()).groupBy(*by, "fold").agg(*[c.alias(f"test_{n}") for n, c in aggs.items()])
    total = own.groupBy(*by).agg(*[F.sum(f"test_{n}").alias(f"__{n}") for n in aggs])
    both = natural_join(own, total, "inner", by) if by else own.crossJoin(total)  # a single row
    return both.withColumns({f"train_{n}": F.col(f"__{n}") - F.col(f"test_{n}") for n in aggs}).drop(*[f"__{n}" for n in aggs])


def fold_models(folded: DataFrame, y: str, x: Column, k: int, by: Sequence[str] = ()) -> DataFrame:
    """(by, fold, n_train, coef): least squares on the training rows of every fold, all from one pass.

    ``x`` is a model row of ``k`` columns as an array; rows with a gap are left out.  Columns are
    centred on their mean over all rows first, so that subtracting sums loses no digits.
    """
    rows = folded.select(*by, "fold", F.concat(x, F.array(F.col(y).cast("double"))).alias("__v")).where("__v is not null").where(
        ~F.exists("__v", lambda v: v.isNull()))
    mean = rows.agg(F.array(*[F.avg(F.col("__v")[i]) for i in range(k + 1)]).alias("m")).first()["m"] or [0.0] * (k + 1)
    # A column that never changes is the intercept and stays as it is.
    flat = rows.agg(F.array(*[F.max(F.col("__v")[i]) == F.min(F.col("__v")[i]) for i in range(k + 1)]).alias("c")).first()["c"]
    shift = [0.0 if c or v is None else float(v) for v, c in zip(mean, flat)]
    at = [F.col("__v")[i] - F.lit(shift[i]) for i in range(k + 1)]
    sums = {"n": F.count(F.lit(1))} | {f"s{i}_{j}": F.sum(at[i] * at[j]) for i, j in _upper(k + 1)}
    per = fold_moments(rows, sums, by)
    xtx, xty = F.array(*[F.col(f"train_s{i}_{j}") for i, j in _upper(k)]), F.array(*[F.col(f"train_s{i}_{k}") for i in range(k)])
    solved = per.select(*by, "fold", F.col("train_n").alias("n_train"), _solve(xtx, xty)["coef"].alias("__c"))
    base = next((i for i in range(k) if flat[i]), None) if flat else None
    if base is None:
        return solved.select(*by, "fold", "n_train", F.col("__c").alias("coef"))
    # Slopes are as fitted; the intercept goes back to uncentred columns.
    back = F.lit(shift[k])
    for i in range(k):
        back = back - F.col("__c")[i] * F.lit(shift[i])
    unit = float(mean[base])
    return solved.select(*by, "fold", "n_train", F.array(*[F.col("__c")[i] + back / F.lit(unit) if i == base else F.col("__c")[i] for i in range(k)]).alias("coef"))


def cv_stats(preds: DataFrame, keys: Sequence[str], fold: str, obs: str, pred: str, se: str) -> DataFrame:
    """Accuracy statistics per fold, then their mean over folds."""
    err = F.col(obs) - F.col(pred)
    rel = F.try_divide(err, F.col(obs))
    half = F.col(se) * F.lit(Z975)
    inside = ((F.col(obs) <= F.col(pred) + half) & (F.col(obs) >= F.col(pred) - half)).cast("double")
    g = [*keys, fold]
    rows = preds.withColumn("__cv", F.try_divide(se, pred))
    base = rows.groupBy(*g).agg(
        F.avg(obs).alias("avg_obs"), F.avg(err).alias("bias"), F.avg(F.abs(err)).alias("abs_bias"),
        F.avg(rel).alias("rel_bias"), F.avg(F.abs(rel)).alias("rel_abs_bias"),
        (F.coalesce(F.sum(inside), F.lit(0.0)) / F.count(F.lit(1))).alias("cover95"), F.sqrt(F.avg(err * err)).alias("rmse"))
    q = quantiles(rows, g, obs, {"__q1": 0.25, "__q3": 0.75})
    m1, m2 = quantiles(rows, g, se, {"median_se": 0.5}), quantiles(rows, g, "__cv", {"median_cv": 0.5})
    per = base
    for part in (q, m1, m2):
        per = natural_join(per, part, "left", g)
    per = per.withColumns({"cv_rmse": F.try_divide("rmse", "avg_obs"),
                           "nrmse": F.try_divide(F.col("rmse"), F.col("__q3") - F.col("__q1"))})
    names = ["avg_obs", "median_se", "median_cv", "bias", "abs_bias", "rel_bias", "rel_abs_bias", "cover95",
             "rmse", "cv_rmse", "nrmse"]
    return per.groupBy(*keys).agg(*[F.avg(n).alias(n) for n in names])
