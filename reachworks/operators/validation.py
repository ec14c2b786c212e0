"""Spawner-recruit curves, interval comparisons, scenario tables and population roll-ups."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reachworks.functions.scalars import Z975
from reachworks.operators import aggregates as A
from reachworks.operators.frames import explode_seq
from reachworks.operators.joins import natural_join
from reachworks.operators.survey import root
from reachworks.session import freeze

FORMS = ("BevertonHolt", "Ricker", "Hockey")
# Grid of the ratio c of a curve's two parameters, on the log scale of c times the largest spawner count.
GRID_LOW, GRID_HIGH, GRID_POINTS, FINE_POINTS, REFINEMENTS = -9.0, 9.0, 64, 64, 1


def sr_starts(data: DataFrame, key: str, s: str, r: str) -> DataFrame:
    """Linearised starting values per population and form; negative ones fall back to fixed starts."""
    d = data.where((F.col(s) > 0) & (F.col(r) > 0))
    inv_r, inv_s = 1 / F.col(r), 1 / F.col(s)
    top = F.max(r)
    bh_a, bh_b = F.regr_slope(inv_r, inv_s), F.regr_intercept(inv_r, inv_s)
    log_ratio = F.ln(F.col(r) / F.col(s))
    ric_a, ric_b = F.exp(F.regr_intercept(log_ratio, F.col(s))), -F.regr_slope(log_ratio, F.col(s))
    hoc_a = F.sum(F.col(s) * F.col(r)) / F.sum(F.col(s) * F.col(s))
    rows = F.array(
        F.struct(F.lit(FORMS[0]).alias("form"), F.when(bh_a > 0, bh_a).otherwise(F.lit(2e-3)).alias("a"),
                 F.when(bh_b > 0, bh_b).otherwise(1 / top).alias("b")),
        F.struct(F.lit(FORMS[1]).alias("form"), ric_a.alias("a"), F.when(ric_b > 0, ric_b).otherwise(1 / top).alias("b")),
        F.struct(F.lit(FORMS[2]).alias("form"), hoc_a.alias("a"), top.cast("double").alias("b")))
    return d.groupBy(key).agg(F.count(F.lit(1)).alias("n_obs"), rows.alias("f")).select(key, "n_obs", F.inline("f"))


def recruits(form: Column, a: Column, b: Column, s: Column) -> Column:
    """Predicted recruits of each curve."""
    return (F.when(form == FORMS[0], s / (a + b * s)).when(form == FORMS[1], a * s * F.exp(-b * s))
            .when(form == FORMS[2], b * (1 - F.exp(-a / b * s))))


def _level(c: Column) -> Column:
    """What the other parameter's logarithm must explain once c is known, row by row.

    Beverton-Holt: ln(r / s) + ln(1 + c s) = -ln a with c = b / a.  Hockey: ln r - ln(1 - exp(-c s)) = ln b with c = a / b.
    """
    z = c * F.col("__s")
    shrink = F.when(z < 0.01, F.ln(z) - z / 2 + z * z / 24 - z * z * z * z / 2880).otherwise(F.ln(1 - F.exp(-z)))
    return F.when(F.col("form") == FORMS[0], F.col("__lr") - F.ln("__s") + F.log1p(z)).otherwise(F.col("__lr") - shrink)


def _scored(d: DataFrame, par: DataFrame, key: str, points: Column) -> DataFrame:
    """Squared error of every grid point of every population and form in one aggregate, best point and vertex.

    Given c the other parameter is a mean, so each point needs the sum of the levels and of their squares.
    """
    rows = natural_join(d, par, "inner", [key]).withColumn("__k", F.explode(points))
    u = F.col("u") + F.col("__k") * F.col("step")
    y = _level(F.exp(u))
    state = ["form", "u", "step", "edge", "lb"]
    off = y - (u - F.col("lb"))
    sums = rows.groupBy(key, *state, "__k").agg(F.sum(y).alias("y"), F.sum(y * y).alias("yy"), F.sum(off * off).alias("off"), F.count(F.lit(1)).alias("n"))
    sse = F.when(F.col("lb").isNull(), F.col("yy") - F.col("y") * F.col("y") / F.col("n")).otherwise(F.col("off"))
    line = sums.groupBy(key, *state).agg(F.array_sort(F.collect_list(F.struct("__k", sse.alias("e")))).alias("g"))
    best = F.array_position(F.col("g.e"), F.array_min("g.e")).cast("int") - 1
    at = lambda i: F.get(F.col("g.e"), F.col("i") + i)
    bend = at(-1) - 2 * at(0) + at(1)
    shift = F.when(bend > 0, F.greatest(F.least((at(-1) - at(1)) / (2 * bend), F.lit(1.0)), F.lit(-1.0)))
    return line.withColumn("i", best).select(
        key, "form", "lb", "step", "edge", (F.col("u") + F.get("g.__k", F.col("i")) * F.col("step")).alias("u"),
        F.coalesce(shift, F.lit(0.0)).alias("shift"), "i")


def fit_sr(data: DataFrame, key: str, s: str, r: str, fixed_b: DataFrame | None = None) -> DataFrame:
    """Capacity per population and curve on the log scale, with SE, CV and a status.

    Ricker is a straight line there.  Beverton-Holt and hockey curves are fitted over their one nonlinear parameter: a
    grid over all its values, then a finer one around the best point, each scored for all populations in one aggregate.
    ``fixed_b`` (key, b) pins the Beverton-Holt capacity and leaves only its slope to fit.

    Status ``no density dependence``: the straight line fits best, so there is a slope and no capacity.
    ``at capacity``: recruits do not follow spawners at all, so there is a capacity and no slope.  ``failed``: too few
    observations, or all of one spawner count.  Rows without positive spawners and recruits are left out.
    """
    d = freeze(data.select(key, F.col(s).cast("double").alias("__s"), F.ln(F.col(r).cast("double")).alias("__lr")).where(
        (F.col("__s") > 0) & F.col("__lr").isNotNull()))
    ratio = F.col("__lr") - F.ln("__s")
    base = d.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_obs"), F.max("__s").alias("top"), F.min("__s").alias("low"), F.regr_slope(ratio, F.col("__s")).alias("slope"),
        F.regr_sxx(ratio, F.col("__s")).alias("sxx"), F.regr_syy(ratio, F.col("__s")).alias("syy"), F.avg("__s").alias("mean_s"),
        F.avg(ratio).alias("mean_ratio"), F.avg("__lr").alias("mean_r"), F.regr_syy(F.col("__lr"), F.col("__s")).alias("syy_r"))
    base, forms = base.withColumn("lb", F.lit(None).cast("double")), [FORMS[0], FORMS[2]]
    if fixed_b is not None:
        base, forms = natural_join(base.drop("lb"), fixed_b.select(key, F.ln("b").alias("lb")), "inner", [key]), forms[:1]
    start = GRID_LOW - F.ln("top")
    span = GRID_HIGH - GRID_LOW + F.ln("top") - F.ln("low")
    par = base.where("top > low").select(key, "lb", F.explode(F.array(*map(F.lit, forms))).alias("form"), start.alias("u"),
                                         (span / GRID_POINTS).alias("step"), F.lit(0).alias("edge"))
    par = _scored(d, par, key, F.sequence(F.lit(0), F.lit(GRID_POINTS)))
    par = par.withColumn("edge", F.when(F.col("i") == 0, -1).when(F.col("i") == GRID_POINTS, 1).otherwise(0))
    around = F.sequence(F.lit(-FINE_POINTS), F.lit(FINE_POINTS))
    for _ in range(REFINEMENTS):
        par = _scored(d, par.drop("i", "shift").withColumn("step", F.col("step") / FINE_POINTS), key, around)
    par = par.select(key, "form", "edge", (F.col("u") + F.col("shift") * F.col("step")).alias("lc"))
    # Errors of the two logarithms at the solution.
    z = F.exp("lc") * F.col("__s")
    g = F.when(z < 1e-12, F.lit(1.0)).otherwise(z * F.exp(-z) / (1 - F.exp(-z)))
    ja = F.when(F.col("form") == FORMS[0], -1 / (1 + z)).otherwise(g)
    jb = F.when(F.col("form") == FORMS[0], -z / (1 + z)).otherwise(1 - g)
    y = _level(F.exp("lc"))
    curves = natural_join(d, par, "inner", [key]).groupBy(key, "form", "edge", "lc").agg(
        F.avg(y).alias("y"), (F.sum(y * y) - F.sum(y) * F.avg(y)).alias("sse"), F.sum(ja * ja).alias("aa"), F.sum(ja * jb).alias("ab"), F.sum(jb * jb).alias("bb"),
        F.sum(y).alias("sy"), F.sum(y * y).alias("syy_c"))
    full = base.withColumn("form", F.explode(F.array(*map(F.lit, FORMS if fixed_b is None else forms))))
    # The two sides meet on two plain columns; a population without any pair of spawner counts has no curve.
    rows = natural_join(full, curves, "left", [key, "form"])
    form, pinned = F.col("form"), F.col("lb").isNotNull()
    n_par = F.when(pinned, 1).otherwise(2)
    ricker, holt = form == FORMS[1], form == FORMS[0]
    edge = F.when(ricker, F.when(F.col("slope") * F.col("top") >= -math.exp(GRID_LOW), -1).otherwise(0)).otherwise(F.col("edge"))
    known = (F.col("n_obs") > n_par) & (F.col("top") > F.col("low"))
    status = (F.when(~known | edge.isNull(), "failed").when((edge < 0) & ~pinned, "no density dependence").when(edge != 0, "at capacity").otherwise("ok"))
    rows = rows.withColumn("status", status)
    ok, line, flat = (F.col("status") == x for x in ("ok", "no density dependence", "at capacity"))
    # Logarithms of a and b.
    la = F.when(line, F.when(holt, -F.col("mean_ratio")).otherwise(F.col("mean_ratio"))).when(ok, F.when(
        ricker, F.col("mean_ratio") - F.col("slope") * F.col("mean_s")).when(pinned, F.col("lb") - F.col("lc")).when(
        holt, -F.col("y")).otherwise(F.col("y") + F.col("lc")))
    lb = F.when(pinned, F.col("lb")).when(flat, F.when(holt, -F.col("mean_r")).otherwise(F.col("mean_r"))).when(ok, F.when(
        ricker, F.ln(-F.col("slope"))).when(holt, F.col("lc") - F.col("y")).otherwise(F.col("y")))
    pinned_sse = F.col("syy_c") - 2 * (F.col("lc") - F.col("lb")) * F.col("sy") + F.col("n_obs") * F.pow(F.col("lc") - F.col("lb"), F.lit(2))
    sse = (F.when(line, F.col("syy")).when(ok & pinned, pinned_sse).when(flat, F.col("syy_r") + F.when(
        pinned, F.col("n_obs") * F.pow(F.col("mean_r") + F.col("lb"), F.lit(2))).otherwise(0.0))
        .when(ok, F.when(ricker, F.col("syy") - F.col("slope") * F.col("slope") * F.col("sxx")).otherwise(F.col("sse"))))
    rows = rows.withColumns({"__la": la, "__lb": lb, "__sse": F.greatest(sse, F.lit(0.0)) + F.when(sse.isNull(), F.lit(None).cast("double")).otherwise(0.0)})
    s2 = F.try_divide(F.col("__sse"), F.col("n_obs") - F.when(pinned | flat, 1).otherwise(2))
    b = F.exp("__lb")
    est = F.when(ok | flat | pinned, F.when(ricker, F.exp(F.col("__la") - F.col("__lb") - 1)).when(holt, 1 / b).otherwise(b))
    det = F.col("aa") * F.col("bb") - F.col("ab") * F.col("ab")
    log_var = (F.when(pinned, F.lit(0.0)).when(flat, s2 / F.col("n_obs")).when(
        ricker, s2 * (1 / F.col("n_obs") + F.try_divide(F.pow(F.col("mean_s") - 1 / b, F.lit(2)), F.col("sxx"))))
        .otherwise(s2 * F.try_divide(F.col("aa"), det)))
    a_out = F.when(line | ok, F.exp("__la")).when(flat & holt, F.lit(0.0))
    b_out = F.when(line & ~(form == FORMS[2]), F.lit(0.0)).when(ok | flat, b)
    found = F.col("status") != "failed"
    out = rows.withColumns({"__est": F.when(found, est), "__se": F.when(found, est * root(log_var))})
    return out.select(key, "form", "n_obs", "status", a_out.alias("a"), b_out.alias("b"), F.when(found, F.col("__sse")).alias("sse"),
                      F.col("__est").alias("est"), F.col("__se").alias("se"), F.try_divide("__se", "__est").alias("cv"))


def sr_curve(params: DataFrame, top: DataFrame, key: str, s: str) -> DataFrame:
    """Predicted curve for 1..max spawners of each population and form."""
    grid = explode_seq(natural_join(params, top, "inner", [key]), s, "spawners")
    return grid.select(key, "form", "spawners", recruits(F.col("form"), F.col("a"), F.col("b"), F.col("spawners").cast("double")).alias("parr"))


def ci_compare(estimates: DataFrame, reference: DataFrame, key: str, form: str, est: str, se: str,
               floor: float = 1.0, cap: float = 1.3e6) -> tuple[DataFrame, DataFrame]:
    """Which estimates lie in the other's interval: rows, and shares per form."""
    def ends(d):
        lo, hi = F.col(est) - F.lit(Z975) * F.col(se), F.col(est) + F.lit(Z975) * F.col(se)
        return d.withColumns({"lwr": F.when(lo <= 0, F.lit(floor)).otherwise(lo), "upr": F.when(hi > cap, F.lit(cap)).otherwise(hi)})
    ref = ends(reference).select(key, F.col(est).alias("ref_est"), F.col("lwr").alias("ref_lwr"), F.col("upr").alias("ref_upr"))
    rows = natural_join(ends(estimates.where(F.col(est).isNotNull())), ref, "inner", [key]).withColumns({
        "in_ref_ci": F.col(est).between(F.col("ref_lwr"), F.col("ref_upr")),
        "ref_in_ci": F.col("ref_est").between(F.col("lwr"), F.col("upr")),
        "overlap_ci": (F.col("lwr") <= F.col("ref_upr")) & (F.col("upr") >= F.col("ref_lwr"))})
    n = F.count_distinct(key)
    shares = rows.groupBy(form).agg(n.alias("n_pops"), *[
        (A.sum0(F.col(c).cast("double")) / n).alias(f"perc_{c}") for c in ("in_ref_ci", "ref_in_ci", "overlap_ci")])
    return rows, shares


def cap_at(df: DataFrame, col: str, se: str, ref: DataFrame, ref_col: str, q: float = 0.99) -> DataFrame:
    """Predictions above the reference quantile shrink to it and lose their SE."""
    top = A.quantiles(ref, [], ref_col, {"t": q}).scalar()
    over = F.col(col) > top
    return df.withColumns({se: F.when(~over, F.col(se)), col: F.when(over, top).otherwise(F.col(col))})


def method_diff(df: DataFrame, keys: Sequence[str], method: str, length: str, cap: str, se: str,
                point: str = "point", reach: str = "reach") -> DataFrame:
    """Point capacity rescaled to the reach length, difference, pooled SE, and whether it includes zero."""
    pick = lambda m, c: F.max(F.when(F.col(method) == m, F.col(c)))
    w = df.groupBy(*keys).agg(
        pick(point, length).alias("length_point"), pick(reach, length).alias("length_reach"), pick(point, cap).alias("cap_point"),
        pick(reach, cap).alias("cap_reach"), pick(point, se).alias("se_point"), pick(reach, se).alias("se_reach")).where(
        "cap_point is not null and cap_reach is not null")
    w = w.withColumn("cap_point", F.try_divide("cap_point", "length_point") * F.col("length_reach"))
    diff = F.col("cap_reach") - F.col("cap_point")
    err = F.sqrt(F.pow("se_reach", F.lit(2.0)) + F.pow("se_point", F.lit(2.0)))
    return w.withColumns({"cap_diff": diff, "cap_rel_diff": F.try_divide(diff, "cap_point"), "cap_diff_se": err,
                          "incl_zero": (diff - F.lit(Z975) * err < 0) & (diff + F.lit(Z975) * err > 0)})


def lifecycle(goals: DataFrame, params: DataFrame, ids: Sequence[str], species: str, scenarios: Sequence[str]) -> DataFrame:
    """Escapement goals carried through redds, eggs, parr and presmolts by species parameters; long output."""
    names = ["prop_fem", "redd_per_fem", "fecund", "egg_to_parr", "parr_to_presmolt"]
    wide = params.groupBy(species).agg(*[F.max(F.when(F.col("parameter") == n, F.col("value"))).alias(n) for n in names])
    long = goals.unpivot([*ids, species], list(scenarios), "scenario", "escapement")
    d = natural_join(long, wide, "inner", [species]).withColumn("redds", F.col("escapement") * F.col("prop_fem") * F.col("redd_per_fem"))
    d = d.withColumn("eggs", F.col("redds") * F.col("fecund")).withColumn("parr", F.col("eggs") * F.col("egg_to_parr"))
    d = d.withColumn("presmolts", F.col("parr") * F.col("parr_to_presmolt"))
    return d.unpivot([*ids, species, "scenario"], ["escapement", "redds", "eggs", "parr", "presmolts"], "lifestage", "abundance")


def capacity_vs_goal(cap: DataFrame, goals: DataFrame, keys: Sequence[str], scenarios: Sequence[str],
                     label: str = "scenario", value: str = "abundance") -> DataFrame:
    """Capacities beside goals: every scenario for every key, missing ones NULL."""
    both = cap.select(*keys, label, value).unionByName(goals.select(*keys, label, value))
    wide = both.groupBy(*keys).agg(*[F.max(F.when(F.col(label) == s, F.col(value))).alias(s) for s in scenarios])
    return wide.unpivot(list(keys), list(scenarios), label, value)


def backcast(trap: DataFrame, surv: DataFrame, pop: str, year: str, stage: str, est: str, rate: str,
             certain: str = "Parr") -> DataFrame:
    """Parr per brood year: estimates over survival, the population's average where a year has none."""
    avg = surv.groupBy(pop, stage).agg(F.avg(rate).alias("__avg"))
    d = natural_join(natural_join(trap, surv.select(pop, year, stage, rate), "left", [pop, year, stage]), avg, "left", [pop, stage])
    alive = F.when(F.col(stage) == certain, F.lit(1.0)).otherwise(F.coalesce(F.col(rate), F.col("__avg")))
    return d.groupBy(pop, year).agg(F.sum(F.try_divide(F.coalesce(F.col(est), F.lit(0.0)), alive)).alias("parr"))


def parr_est(df: DataFrame, total: str, fall: str, spring: str, overwinter: float = 0.32) -> DataFrame:
    """Total migrants where given or derivable, and summer parr from fall and spring migrants."""
    t, f, s = F.col(total), F.col(fall), F.col(spring)
    return df.withColumns({
        "total_migrants": F.when(t.isNotNull(), t).when(f.isNull(), s),
        "parr": F.when(f.isNull(), s / overwinter).otherwise(f + s / overwinter)})


def subset_population(df: DataFrame, rules: Mapping[str, str]) -> DataFrame:
    """Rows whose named columns match their pattern."""
    cond = F.lit(True)
    for col, rx in rules.items():
        cond = cond & F.col(col).rlike(rx)
    return df.where(cond)


def population_rollup(sources: Mapping[str, DataFrame], keys: Sequence[str], length: str, cap: str, se: str,
                      rid: str) -> DataFrame:
    """Totals per population from each method, aligned, with densities and the relative difference."""
    parts = []
    for name, d in sources.items():
        per = d.groupBy(*keys, rid).agg(F.sum(length).alias("__l"), F.sum(cap).alias("__c"),
                                        F.sum(F.pow(F.col(se), F.lit(2.0))).alias("__v"))
        parts.append(per.groupBy(*keys).agg(
            A.sum0("__l").alias("length"), F.count(F.lit(1)).alias("n_ids"), A.sum0("__c").alias("cap_tot"),
            F.sqrt(A.sum0("__v")).alias("cap_tot_se")).withColumn("method", F.lit(name)))
    long = parts[0]
    for p in parts[1:]:
        long = long.unionByName(p)
    cells = []
    for name in sources:
        at = lambda c, name=name: F.max(F.when(F.col("method") == name, F.col(c)))
        cells += [at(c).alias(f"{c}_{name}") for c in ("length", "n_ids", "cap_tot", "cap_tot_se")]
    wide = long.groupBy(*keys).agg(*cells)
    for name in sources:
        wide = wide.withColumn(f"cap_dens_{name}", F.try_divide(f"cap_tot_{name}", f"length_{name}"))
    first, second = list(sources)[:2]
    return wide.withColumn("rel_diff", F.try_divide(F.col(f"cap_tot_{second}") - F.col(f"cap_tot_{first}"), F.col(f"cap_tot_{first}")))


# ---- functions of a group ------------------------------------------------------------

def grouped_map(df: DataFrame, keys: Sequence[str], partial: Callable[[pd.DataFrame], pd.DataFrame], mid_schema: str,
                finish: Callable[[pd.DataFrame], pd.DataFrame], schema: str, fan_in: int = 64) -> DataFrame:
    """An arbitrary function per group for functions that combine: ``partial`` shrinks any part of a
    group to a few rows of ``mid_schema`` (keys included) and accepts its own output again.

    Parts shrink inside their input partition, then in ``fan_in`` sets per group, so ``finish`` never
    sees more than a few rows however large the group is.  A group for which either function raises
    gives status ``failed``, NULLs and the first message in ``error`` while the others go on;
    ``schema`` has ``status string`` and may have ``error string``.
    """
    keys = list(keys)
    names = [f.split()[0].strip("`") for f in schema.split(",")]
    mids = [f.split()[0].strip("`") for f in mid_schema.split(",")]

    def guarded(g: pd.DataFrame) -> pd.DataFrame:
        """A part made smaller, or one row that says why it could not be."""
        if "__error" in g:
            bad = g[g["__error"].notna()]
            if len(bad):
                return bad.head(1)
            g = g.drop(columns="__error")
        try:
            return partial(g)[mids].assign(__error=None)
        except Exception as e:  # noqa: BLE001 - a failing group must not fail the job
            row = {n: g[n].iloc[0] if n in keys else None for n in mids}
            return pd.DataFrame([row | {"__error": f"{type(e).__name__}: {e}"}])

    def shrink(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for _, g in pdf.groupby(keys, sort=False, dropna=False):
                yield guarded(g)

    def attempt(pdf: pd.DataFrame) -> pd.DataFrame:
        small = guarded(pdf)
        error = small["__error"].iloc[0] if len(small) else None
        if error is None:
            try:
                return finish(small.drop(columns="__error")).assign(status="ok", error=None)[names]
            except Exception as e:  # noqa: BLE001
                error = f"{type(e).__name__}: {e}"
        row = {n: pdf[n].iloc[0] if n in keys else None for n in names}
        return pd.DataFrame([row | {"status": "failed", "error": error}])[names]

    mid = f"{mid_schema}, __error string"
    first = df.mapInPandas(shrink, mid).withColumn("__part", F.pmod(
        F.spark_partition_id(), F.lit(fan_in)).cast("int"))
    second = first.groupBy(*keys, "__part").applyInPandas(lambda p: guarded(p.drop(columns="__part")), mid)
    return second.groupBy(*keys).applyInPandas(attempt, schema)


def two_input_map(df: DataFrame, table: DataFrame, keys: Sequence[str], outputs: Mapping[str, Column]) -> DataFrame:
    """A function of each row and of its group's row in a second table, such as a fitted model; groups without one drop out.

    ``outputs`` are columns over both sides.  The second table is small per group, never gathered: it is joined on the keys.
    """
    return natural_join(df, table, "inner", list(keys)).select(*df.columns, *[c.alias(n) for n, c in outputs.items()])
