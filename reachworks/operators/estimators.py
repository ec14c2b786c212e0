"""Abundance estimators from depletion, mark-recapture and ratio surveys.

Closed forms are column expressions.  The k-pass depletion estimate needs a search and runs
as one vectorised Arrow function.  Sources: Seber (1982) two-pass removal; Carle and Strub
(1978) weighted maximum likelihood; Zippin (1958) large-sample errors; Chapman (1951);
Robson and Regier (1964) sample-size rule.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from reachworks.functions.scalars import Z975
from reachworks.operators.aggregates import n_rows
from reachworks.operators.joins import band_count, natural_join

ESTIMATE = StructType([StructField(f, DoubleType()) for f in ("N", "SE", "p", "pSE")])
# Fixed labels.
SEBER, CARLE_STRUB, CHAPMAN, RATIO, PREVIOUS = "Seber", "Carle Strub", "Chapman", "Ratio Est.", "Prev. Calc."


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _estimate(n: Column, se: Column, p: Column, pse: Column) -> Column:
    return F.struct(n.cast("double").alias("N"), se.cast("double").alias("SE"),
                    p.cast("double").alias("p"), pse.cast("double").alias("pSE"))


def removal2(c1: str | Column, c2: str | Column) -> Column:
    """Two-pass removal; no decline between passes gives N = 0 and no errors."""
    a, b = _c(c1).cast("double"), _c(c2).cast("double")
    ok = a > b
    d = F.when(ok, a - b)
    return _estimate(
        F.when(ok, a * a / d).when(a.isNotNull() & b.isNotNull(), F.lit(0.0)),
        a * b * F.sqrt(a + b) / (d * d), d / a,
        F.when(ok, F.sqrt(b * (a + b) / (a * a * a))))


def _excess(n: np.ndarray, t: np.ndarray, x: np.ndarray, k: int) -> np.ndarray:
    """Carle-Strub ratio with the flat prior; the estimate is the first n where it is <= 1."""
    out = (n + 1.0) / (n - t + 1.0)
    for i in range(1, k + 1):
        out *= (k * n - x - t + 1.0 + k - i) / (k * n - x + 2.0 + k - i)
    return out


def carle_strub(catches: np.ndarray) -> np.ndarray:
    """Rows of k-pass catches to rows of (N, SE, p, SE of p); doubling, then bisection on N."""
    k = catches.shape[1]
    t = catches.sum(axis=1)
    x = catches @ np.arange(k - 1, -1, -1, dtype=float)
    lo = t.copy()
    hi = np.maximum(2.0 * t, 1.0)
    high = _excess(hi, t, x, k) > 1.0
    while high.any():
        lo = np.where(high, hi, lo)
        hi = np.where(high, hi * 2.0, hi)
        high = _excess(hi, t, x, k) > 1.0
    first = _excess(t, t, x, k) <= 1.0
    hi = np.where(first, t, hi)
    while (hi - lo > 1.0).any():
        mid = np.floor((lo + hi) / 2.0)
        over = _excess(mid, t, x, k) > 1.0
        open_ = hi - lo > 1.0
        lo = np.where(open_ & over, mid, lo)
        hi = np.where(open_ & ~over, mid, hi)
    n = hi
    with np.errstate(divide="ignore", invalid="ignore"):
        p = t / (k * n - x)
        q = 1.0 - p
        qk = q ** k
        se = np.sqrt(n * (1.0 - qk) * qk / ((1.0 - qk) ** 2 - (p * k) ** 2 * q ** (k - 1)))
        pse = np.sqrt((q * p) ** 2 * (1.0 - qk) / (n * (q * (1.0 - qk) ** 2 - (p * k) ** 2 * qk)))
    se = np.where(q == 0.0, 0.0, se)
    pse = np.where(q == 0.0, 0.0, pse)
    none = t <= 0
    out = np.column_stack([np.where(none, 0.0, n), se, p, pse])
    out[none, 1:] = np.nan
    return out


@F.pandas_udf(ESTIMATE)
def _removal_k(passes: pd.Series) -> pd.DataFrame:
    out = np.full((len(passes), 4), np.nan)
    sizes = passes.map(lambda a: 0 if a is None or any(v is None or v != v for v in a) else len(a)).to_numpy()
    for k in np.unique(sizes):
        if k >= 2:
            at = sizes == k
            out[at] = carle_strub(np.array(passes[at].tolist(), dtype=float))
    return pd.DataFrame(out, columns=["N", "SE", "p", "pSE"])


def removal_k(passes: Sequence[str | Column]) -> Column:
    """Carle-Strub estimate from three or more passes; a missing pass gives NULLs."""
    got = [_c(p).cast("double") for p in passes]
    known = got[0].isNotNull()
    for g in got[1:]:
        known = known & g.isNotNull()
    return no_nan(_removal_k(F.when(known, F.array(*got))))


def no_nan(est: Column) -> Column:
    clean = lambda f: F.when(~F.isnan(est[f]), est[f])
    return F.struct(*[clean(f).alias(f) for f in ("N", "SE", "p", "pSE")])


def chapman(marked: str | Column, caught: str | Column, recaptured: str | Column) -> Column:
    m_, n_, r_ = (_c(c).cast("double") for c in (marked, caught, recaptured))
    n = (m_ + 1) * (n_ + 1) / (r_ + 1) - 1
    var = (m_ + 1) * (n_ + 1) * (m_ - r_) * (n_ - r_) / ((r_ + 1) * (r_ + 1) * (r_ + 2))
    se = F.when(var >= 0, F.sqrt(var))
    return _estimate(n, se, F.try_divide(m_, n), F.try_divide(m_ * se, n * n))


def ratio_est(catch: str | Column, p: str | Column, pse: str | Column) -> Column:
    """Catch over capture probability; nothing caught and no probability means none there."""
    c, p_, s_ = _c(catch).cast("double"), _c(p).cast("double"), _c(pse).cast("double")
    n = F.coalesce(F.try_divide(c, p_), F.when((c == 0) & p_.isNull(), F.lit(0.0)))
    return _estimate(n, F.try_divide(c * s_, p_ * p_), p_, s_)


def estimate_abundance(df: DataFrame, method: str = "Method",
                       passes: Sequence[str] = ("pass1", "pass2", "pass3", "pass4"),
                       p: str = "p", pse: str = "pSE", earlier: tuple[str, str] | None = None) -> DataFrame:
    """Pick the estimator by survey method and available passes, in one projection.

    Adds N, SE, p, pSE and Nmethod.  Methods without an estimator keep their given p and no N.  ``earlier`` names the
    columns of an abundance calculated before and its SE: single-pass surveys, and depletions of three or four passes,
    that have one keep it, labelled as such.
    """
    p1, p2, p3, p4 = (F.col(c) for c in passes)
    m = F.col(method)
    depl = m == "Depletion"
    two, four = depl & p3.isNull(), depl & p3.isNotNull() & (F.coalesce(p4, F.lit(0)) > 0)
    three = depl & p3.isNotNull() & (F.coalesce(p4, F.lit(0)) <= 0)
    mr, cont = m == "Mark Recapture", m == "Continuous"
    # One Arrow call serves both pass counts; other rows send NULL.
    arrays = F.when(four, F.array(p1, p2, p3, p4)).when(three, F.array(p1, p2, p3)).cast("array<double>")
    kept = _estimate(F.lit(None), F.lit(None), F.col(p), F.col(pse))
    est = (F.when(two, removal2(p1, p2)).when(three | four, no_nan(F.col("__k")))
           .when(mr, chapman(p1, p2, p3)).when(cont, ratio_est(p1, p, pse)).otherwise(kept))
    label = (F.when(two, SEBER).when(three | four, CARLE_STRUB).when(mr, CHAPMAN).when(cont, RATIO))
    if earlier is not None:
        old = F.col(earlier[0]).isNotNull() & ((m == "Single Pass") | three | four)
        est = F.when(old, _estimate(F.col(earlier[0]).cast("double"), F.col(earlier[1]).cast("double"), F.col(p), F.col(pse))).otherwise(est)
        label = F.when(old, PREVIOUS).otherwise(label)
    out = df.withColumn("__k", _removal_k(arrays)).withColumn("__e", est).withColumn("Nmethod", label)
    return out.withColumns({f: F.col(f"__e.{f}") for f in ("N", "SE", "p", "pSE")}).drop("__k", "__e")


def flag_valid(df: DataFrame, method: str = "Method", m: str = "pass1", n: str = "pass2", r: str = "pass3",
               est: str = "N", nmethod: str = "Nmethod") -> DataFrame:
    """Mark-recapture needs M*n/4 > N or at least 7 recaptures; an unknown test is not valid."""
    rule = (F.col(m) * F.col(n) / 4 > F.col(est)) | (F.col(r) >= 7)
    # Survey methods.
    valid = (F.when(F.col(method) == "Mark Recapture", rule)
             .when(F.col(method).isin("Continuous", "CU Depletion", "Depletion", "Snorkel"), F.lit(True))
             .when(F.col(method) == "Single Pass", F.col(nmethod) == PREVIOUS))
    return df.withColumn("Valid", F.coalesce(valid, F.lit(False)))


def ci_overlap(df: DataFrame, keys: Sequence[str], obs: str, obs_se: str, pred: str, pred_se: str) -> DataFrame:
    """Share of observed and predicted intervals that overlap, bias and RMSE per group."""
    z = F.lit(Z975)
    lo_o, hi_o = F.col(obs) - z * F.col(obs_se), F.col(obs) + z * F.col(obs_se)
    lo_p, hi_p = F.col(pred) - z * F.col(pred_se), F.col(pred) + z * F.col(pred_se)
    err = F.col(obs) - F.col(pred)
    hit = ((lo_o < hi_p) & (hi_o > lo_p)).cast("bigint")
    return df.groupBy(*keys).agg(
        n_rows().alias("n_pred"), F.coalesce(F.sum(hit), F.lit(0)).alias("n_overlap"),
        (F.coalesce(F.sum(hit), F.lit(0)) / n_rows()).alias("share_overlap"),
        F.avg(err).alias("bias"), F.sqrt(F.avg(err * err)).alias("rmse"))


def redd_density(sites: DataFrame, redds: DataFrame, on: Sequence[str], site: str, lcol: str, rcol: str,
                 buffer: float, species: str, year: str, area: str, nest: str | None = None) -> DataFrame:
    """Distinct nests within the buffer per site, species and year; best year (latest on ties); per km and per area."""
    counts = band_count(sites, redds, on, site, lcol, rcol, buffer, [species, year], "n_redds", nest)
    # The year settles ties, so the best year is one maximum.
    yearly = counts.groupBy(site, species, year).agg(F.sum("n_redds").alias("n_redds"))
    best = yearly.groupBy(site, species).agg(F.max(F.struct("n_redds", year)).alias("b")).select(site, species, "b.*")
    per_km = F.col("n_redds") / (2 * buffer / 1000.0)
    return natural_join(best, sites.select(site, area), "left", [site]).select(
        site, species, F.col(year).alias("max_year"), per_km.alias("redds_per_km"),
        F.try_divide(per_km, F.col(area)).alias("redds_per_m2"))
