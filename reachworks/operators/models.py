"""Calibration models: capture probability, snorkel correction, all-subsets averaging."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reachworks.operators.estimators import ratio_est
from reachworks.operators.forest import fit_by
from reachworks.operators.joins import anti, natural_join
from reachworks.operators.survey import _square, _upper, dot, root
from reachworks.operators.terms import Design, Term, design, label, sub_models, terms_of
from reachworks.session import freeze

# Steps of a binomial fit; one that has not settled by then is refused rather than used.
STEPS = 100
# Share of the weight that an averaged set of models holds.
CONFIDENCE = 0.95


@dataclass(frozen=True)
class Fit:
    """A fitted model: its design, coefficients and their covariance, intercept first, and how well it does."""

    design: Design
    coef: np.ndarray
    cov: np.ndarray
    loglik: float
    rows: int
    parameters: int

    @property
    def aicc(self) -> float:
        p = self.parameters
        return -2 * self.loglik + 2 * p + 2 * p * (p + 1) / max(self.rows - p - 1, 1)

    @property
    def name(self) -> str:
        return "+".join(map(label, self.design.terms)) or "1"


def _counted(train: DataFrame, caught: str, trials: str) -> DataFrame:
    c, n = F.col(caught).cast("double"), F.col(trials).cast("double")
    return train.where((n > 0) & (c >= 0) & (c <= n)).withColumns({"__share": c / n, "__n": n})


def binomial_fit(train: DataFrame, caught: str, trials: str, terms) -> Fit:
    """Logistic regression of caught out of trials on rows without a gap; text columns are factors."""
    plan = terms if isinstance(terms, Design) else design(_counted(train, caught, trials), terms)
    # Fitting reads the rows once per step, so the joins behind them run only once.
    data = freeze(_counted(train, caught, trials).withColumn("__x", plan.row()).where("__x is not null").select("__x", "__share", "__n"))
    c, m = F.col("__share") * F.col("__n"), F.col("__n")
    if len(plan.names()) > 1:
        ready = data.withColumn("__features", array_to_vector(F.slice("__x", 2, len(plan.names()) - 1)))
        model = GeneralizedLinearRegression(family="binomial", link="logit", weightCol="__n", featuresCol="__features", labelCol="__share",
                                            maxIter=STEPS, regParam=0.0).fit(ready)
        if model.summary.numIterations >= STEPS:
            raise ValueError(f"{'+'.join(map(label, plan.terms))}: not settled after {STEPS} steps")
        coef = np.array([model.intercept, *model.coefficients])
    else:
        share = data.agg(F.try_divide(F.sum(c), F.sum(m))).first()[0]
        inside = min(max(0.5 if share is None else share, 1e-15), 1 - 1e-15)
        coef = np.array([np.log(inside / (1 - inside))])
    k = len(coef)
    eta = dot(F.array(*map(F.lit, coef.tolist())), F.col("__x"))
    p = F.greatest(F.least(1 / (1 + F.exp(-eta)), F.lit(1 - 1e-15)), F.lit(1e-15))
    log_choose = _log_gamma(m + 1) - _log_gamma(c + 1) - _log_gamma(m - c + 1)
    w = data.withColumn("__w", m * p * (1 - p))
    one = w.agg(F.count(F.lit(1)).alias("rows"), F.sum(log_choose + c * F.ln(p) + (m - c) * F.ln(1 - p)).alias("loglik"), *[
        F.sum(F.col("__w") * F.col("__x")[i] * F.col("__x")[j]).alias(f"x{i}_{j}") for i, j in _upper(k)]).first()
    cov, _ = _inverse(_square(np.array([v or 0.0 for v in one[2:]], dtype=float), k))
    return Fit(plan, coef, cov, float(one["loglik"] or 0.0), one["rows"], k)


def _log_gamma(v: Column) -> Column:
    """Stirling's series from 10 on, smaller arguments raised by steps."""
    shift = F.when(v < 10, F.lit(10.0)).otherwise(F.lit(0.0))
    z = v + shift
    series = (z - 0.5) * F.ln(z) - z + 0.5 * float(np.log(2 * np.pi)) + 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * z * z * z * z * z)
    steps = sum((F.ln(v + i) for i in range(1, 10)), F.ln(v))
    return series - F.when(v < 10, steps).otherwise(F.lit(0.0))


def _inverse(m: np.ndarray) -> tuple[np.ndarray, int]:
    """Inverse and rank of cross-products, columns brought to one scale first; columns that others give count for nothing."""
    scale = np.sqrt(np.where(np.diag(m) > 0, np.diag(m), 1.0))
    values, vectors = np.linalg.eigh(m / np.outer(scale, scale)) if len(m) else (np.zeros(0), np.zeros((0, 0)))
    keep = values > 1e-12 * max(values.max(initial=0.0), 1e-300)
    half = vectors[:, keep] / np.sqrt(values[keep])
    return (half @ half.T) / np.outer(scale, scale), int(keep.sum())


def linear_fits(train: DataFrame, y: str, models: Sequence[Sequence[Term]], plan: Design) -> list[Fit]:
    """Least squares for many sets of a design's terms from one pass of centred cross-products."""
    columns = plan.columns()
    x = F.array(*[c for _, _, c in columns], F.col(y).cast("double"))
    data = freeze(train.select(F.when(plan.row().isNotNull(), x).alias("x")).where(F.col("x").isNotNull() & ~F.exists("x", lambda v: v.isNull())))
    k = len(columns) + 1
    mean = np.array([v or 0.0 for v in data.agg(*[F.avg(F.col("x")[i]) for i in range(k)]).first()])
    off = [F.col("x")[i] - F.lit(float(mean[i])) for i in range(k)]
    one = data.agg(F.count(F.lit(1)).alias("n"), *[F.sum(off[i] * off[j]).alias(f"m{p}") for p, (i, j) in enumerate(_upper(k))]).first()
    n, m = one["n"], _square(np.array([v or 0.0 for v in one[1:]], dtype=float), k)
    out = []
    for terms in models:
        at = [i for i, (_, term, _) in enumerate(columns) if term in terms]
        inv, rank = _inverse(m[np.ix_(at, at)])
        slope = inv @ m[at, k - 1]
        rss = max(float(m[k - 1, k - 1] - slope @ m[at, k - 1]), 0.0)
        s2 = rss / max(n - rank - 1, 1)
        # The intercept belongs to means: its row and column of the covariance follow from the slopes'.
        cross = -inv @ mean[at]
        cov = s2 * np.block([[np.array([[1 / max(n, 1) + mean[at] @ inv @ mean[at]]]), cross[None, :]], [cross[:, None], inv]])
        coef = np.concatenate([[mean[k - 1] - slope @ mean[at]], slope])
        loglik = -0.5 * n * (np.log(2 * np.pi) + np.log(max(rss, 1e-300) / max(n, 1)) + 1)
        out.append(Fit(Design(tuple(terms), plan.levels), coef, cov, float(loglik), n, rank + 2))
    return out


def _weights(fits: Sequence[Fit]) -> tuple[np.ndarray, np.ndarray]:
    """(distance from the best AICc, Akaike weight) of every model."""
    delta = np.array([f.aicc for f in fits]) - min(f.aicc for f in fits)
    raw = np.exp(-0.5 * delta)
    return delta, raw / raw.sum()


def fit_models(train: DataFrame, y: str, terms, fixed=(), family: str = "gaussian", trials: str | None = None) -> list[Fit]:
    """Every sub-model that keeps the fixed terms and the margins of its interactions, all on the same rows."""
    rows = _counted(train, y, trials) if family == "binomial" else train.where(F.col(y).isNotNull())
    plan = terms if isinstance(terms, Design) else design(rows, terms)
    whole = freeze(rows.where(plan.row().isNotNull()))
    models = sub_models(plan.terms, terms_of(fixed))
    if family == "gaussian":
        return linear_fits(whole, y, models, plan)
    return [binomial_fit(whole, y, trials, Design(tuple(m), plan.levels)) for m in models]


def dredge(train: DataFrame, y: str, terms, fixed=(), family: str = "gaussian", trials: str | None = None) -> DataFrame:
    """All sub-models with AICc, delta, weight, coefficients and their variances by name; one row per model."""
    return model_table(train, fit_models(train, y, terms, fixed, family, trials))


def model_table(train: DataFrame, fits: Sequence[Fit]) -> DataFrame:
    delta, weight = _weights(fits)
    rows = [(f.name, f.parameters, f.loglik, float(f.aicc), float(d), float(w), dict(zip(f.design.names(), map(float, f.coef))),
             dict(zip(f.design.names(), map(float, np.diag(f.cov))))) for f, d, w in zip(fits, delta, weight)]
    return train.sparkSession.createDataFrame(rows, "model string, df int, loglik double, aicc double, delta double, weight double, "
                                              "coef map<string,double>, var map<string,double>")


def confidence_set(fits: Sequence[Fit], share: float = CONFIDENCE) -> list[tuple[Fit, float]]:
    """The best models while their running weight stays below ``share``, the very best in any case, weighted anew."""
    _, weight = _weights(fits)
    order = sorted(range(len(fits)), key=lambda i: (-weight[i], fits[i].name))
    upto = np.cumsum(weight[order])
    kept = [i for i, total in zip(order, upto) if total < share] or order[:1]
    return [(fits[i], float(weight[i] / weight[kept].sum())) for i in kept]


def averaged(models: DataFrame, share: float | None = None) -> DataFrame:
    """Weighted coefficients over models with their unconditional error, a term absent from a model counting as zero.

    ``share`` limits the average to the confidence set of that weight.
    """
    rows = models.collect()  # one row a model
    best = sorted(rows, key=lambda r: (-r["weight"], r["model"]))
    if share is not None:
        upto = np.cumsum([r["weight"] for r in best])
        best = [r for r, total in zip(best, upto) if total < share] or best[:1]
    weight = np.array([r["weight"] for r in best])
    weight = weight / weight.sum()
    names = list(dict.fromkeys(n for r in best for n in r["coef"]))
    coef = np.array([[r["coef"].get(n, 0.0) for n in names] for r in best])
    var = np.array([[r["var"].get(n, 0.0) for n in names] for r in best])
    mean = weight @ coef
    se = np.sqrt(weight @ (var + (coef - mean) ** 2))
    return models.sparkSession.createDataFrame([(n, float(m), float(s)) for n, m, s in zip(names, mean, se)], "term string, estimate double, se double")


# ---- predictions ---------------------------------------------------------------------

def _linear(fit: Fit) -> tuple[Column, Column]:
    """Linear predictor and its variance; NULL where the model row is unknown."""
    x = fit.design.row()
    eta = dot(F.array(*map(F.lit, fit.coef.tolist())), x)
    vx = F.array(*[dot(F.array(*map(F.lit, line)), x) for line in fit.cov.tolist()])
    return F.when(x.isNotNull(), eta), F.when(x.isNotNull(), dot(vx, x))


def mixed_predictor(models: Sequence[tuple[Fit, float]]) -> tuple[Column, Column]:
    """Weighted linear predictor of some models and its variance, spread between the models included."""
    each = [(w, *_linear(f)) for f, w in models]
    eta = sum((F.lit(w) * e for w, e, _ in each[1:]), F.lit(each[0][0]) * each[0][1])
    spread = [F.lit(w) * (v + (e - eta) * (e - eta)) for w, e, v in each]
    return eta, sum(spread[1:], spread[0])


def binomial_predict(models: Fit | Sequence[tuple[Fit, float]], score: DataFrame, p: str = "p", pse: str = "pSE") -> DataFrame:
    """Every row with its probability and delta-method error; NULL where a covariate is missing or a level unknown."""
    eta, var = mixed_predictor([(models, 1.0)] if isinstance(models, Fit) else models)
    rows = score.withColumns({"__eta": eta, "__var": var})
    q = 1 / (1 + F.exp(-F.col("__eta")))
    return rows.withColumns({p: q, pse: q * (1 - q) * root("__var")}).drop("__eta", "__var")


def capture_prob(train: DataFrame, score: DataFrame, caught: str, trials: str, terms) -> DataFrame:
    """Model the first-pass catch, then expand catches without a valid estimate by the predicted probability.

    Every scoring row comes back; one whose probability is unknown has no estimate, unless nothing was caught.
    """
    out = binomial_predict(binomial_fit(train, caught, trials, terms), score)
    out = out.withColumn("__e", ratio_est(caught, "p", "pSE"))
    return out.withColumns({"N": F.col("__e.N"), "SE": F.col("__e.SE"), "Nmethod": F.lit("Cap. Prob. Model")}).drop("__e")


def calibrate(train: DataFrame, score: DataFrame, species: str, unit: str, count: str, n: str, terms, crew: str,
              average: float | None = None) -> DataFrame:
    """Snorkel counts to abundance, per species; every scoring row of a calibrated species comes back.

    Unit types seen in calibration use the binomial model, or with ``average`` all its sub-models that make up that share
    of the weight; unseen ones a line through the origin with a slope per crew.  Where the model row is unknown, or the
    crew of an unseen unit was never calibrated, the estimates are NULL.
    """
    # A line through the origin for each species and crew needs three sums: crews never meet in one row.
    xx, xy, yy = (F.sum(F.col(a).cast("double") * F.col(b)) for a, b in ((count, count), (count, n), (n, n)))
    lines = train.where(F.col(count).isNotNull() & F.col(n).isNotNull()).groupBy(species, crew).agg(
        xx.alias("xx"), xy.alias("xy"), yy.alias("yy"), F.count(F.lit(1)).alias("rows"))
    lines = lines.withColumns({"slope": F.coalesce(F.try_divide("xy", "xx"), F.lit(0.0)), "inv": F.coalesce(F.try_divide(F.lit(1.0), F.col("xx")), F.lit(0.0))})
    spread = lines.groupBy(species).agg((F.sum(F.col("yy") - F.col("slope") * F.col("xy")) / F.greatest(
        F.sum("rows") - F.count(F.lit(1)), F.lit(1))).alias("s2"))
    lines = natural_join(lines, spread, "inner", [species]).select(species, crew, F.col("slope").alias("__slope"), F.col("inv").alias("__inv"), "s2")
    cols = [*score.columns, "phat", "phat_se", "Nhat", "Nhat_se"]

    def fit(part: DataFrame, _) -> Sequence[tuple[Fit, float]]:
        if average is None:
            return [(binomial_fit(part, count, n, terms), 1.0)]
        return confidence_set(fit_models(part, count, terms, family="binomial", trials=n), average)

    parts = []
    for sp, models in fit_by(train, species, fit).items():
        t, s = train.where(F.col(species) == F.lit(sp)), score.where(F.col(species) == F.lit(sp))
        known = t.where(F.col(unit).isNotNull()).select(unit).distinct()
        a = binomial_predict(models, natural_join(s, known, "left_semi", [unit]), "phat", "phat_se")
        a = a.withColumns({"Nhat": F.try_divide(count, "phat"), "Nhat_se": F.try_divide(F.col(count) * F.col("phat_se"), F.col("phat") * F.col("phat"))})
        b = natural_join(anti(s, known, [unit]), lines.where(F.col(species) == F.lit(sp)).drop(species), "left", [crew])
        b = b.withColumns({"Nhat": F.col(count) * F.col("__slope"), "Nhat_se": F.abs(F.col(count)) * root(F.col("__inv") * F.col("s2"))})
        b = b.withColumns({"phat": F.try_divide(count, "Nhat"), "phat_se": F.try_divide(F.col(count) * F.col("Nhat_se"), F.col("Nhat") * F.col("Nhat"))})
        parts.append(a.select(*cols).withColumn("route", F.lit("binomial")).unionByName(b.select(*cols).withColumn("route", F.lit("linear"))))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
