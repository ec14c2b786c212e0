"""Grouped aggregation, profiles, windows-as-filters and ranking."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reachworks.operators.joins import natural_join, with_group_stats
from reachworks.operators.ordered import exact_quantiles, running


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


# ---- aggregate expressions -----------------------------------------------------------

def n_rows() -> Column:
    return F.count(F.lit(1))


def n_distinct(col: str | Column, count_null: bool = True) -> Column:
    """Distinct values; a missing value counts as one unless told otherwise."""
    d = F.count_distinct(_c(col))
    return d + F.coalesce(F.max(_c(col).isNull().cast("int")), F.lit(0)) if count_null else d


def sum0(col: str | Column) -> Column:
    """Sum that is 0 when nothing was there."""
    return F.coalesce(F.sum(_c(col)), F.lit(0.0))


def wmean(x: str | Column, w: str | Column) -> Column:
    return F.try_divide(F.sum(_c(x) * _c(w)), F.sum(F.when(_c(x).isNotNull(), _c(w))))


def rss(se: str | Column) -> Column:
    """Combined standard error: root of the summed squares, missing ones skipped."""
    return F.sqrt(sum0(_c(se) * _c(se)))


def agg_if(fn: Callable[[Column], Column], x: str | Column, cond: Column) -> Column:
    return fn(F.when(cond, _c(x)))


# ---- grouped tables ------------------------------------------------------------------

def agg_cols(df: DataFrame, keys: Sequence[str], cols: Sequence[str],
             fns: Mapping[str, Callable[[str], Column]]) -> DataFrame:
    """Several functions over many columns, named ``col_fn``."""
    return df.groupBy(*keys).agg(*[fn(c).alias(f"{c}_{name}") for c in cols for name, fn in fns.items()])


def quantiles(df: DataFrame, keys: Sequence[str], col: str, ps: Mapping[str, float],
              group_rows: int | None = None) -> DataFrame:
    """Exact interpolated quantiles, one named column each."""
    q = exact_quantiles(df, keys, col, list(ps.values()), group_rows)
    return q.select(*keys, *[F.col("q")[i].alias(n) for i, n in enumerate(ps)])


def agg_with_medians(df: DataFrame, keys: Sequence[str], aggs: Mapping[str, Column],
                     medians: Mapping[str, str]) -> DataFrame:
    """Ordinary aggregates plus exact medians ``{out: column}``."""
    out = df.groupBy(*keys).agg(*[c.alias(n) for n, c in aggs.items()])
    for name, col in medians.items():
        out = natural_join(out, quantiles(df, keys, col, {name: 0.5}), "left", keys)
    return out


def arg_max(df: DataFrame, keys: Sequence[str], by: str, tie: str, cols: Sequence[str]) -> DataFrame:
    """Columns at each group's maximum; the lowest ``tie`` value wins among equals.

    A per-group limit runs before the shuffle, so a hot group ships few rows.
    """
    return first_per_group(df, keys, [F.col(by).desc_nulls_last(), F.col(tie)]).select(*keys, by, *cols)


def crosstab(df: DataFrame, a: str, b: str, margins: bool = True, pct: str | None = None) -> DataFrame:
    """Contingency counts, totals labelled ``Total``; ``pct`` adds row or column shares."""
    label = lambda c: F.when(F.grouping(c) == 1, F.lit("Total")).otherwise(F.col(c).cast("string"))
    g = df.cube(a, b) if margins else df.groupBy(a, b)
    if margins:
        out = g.agg(label(a).alias("__a"), label(b).alias("__b"), n_rows().alias("n"), (F.grouping(a) + F.grouping(b) == 0).alias("__inner")).select(
            F.col("__a").alias(a), F.col("__b").alias(b), "n", "__inner")
    else:
        out = g.agg(n_rows().alias("n"))
    if pct is None:
        return out.drop("__inner")
    key = {"row": a, "col": b}[pct]
    # A category may be NULL or itself called "Total"; only margins are left out.
    inner = out.where("__inner").drop("__inner") if margins else out
    return with_group_stats(inner, [key], {"__t": F.sum("n")}).select(
        a, b, "n", (F.col("n") / F.col("__t")).alias("share"))


def site_average(df: DataFrame, keys: Sequence[str], medians: Mapping[str, str],
                 attrs: Sequence[str]) -> DataFrame:
    """Median of varying metrics and the constant attributes of each site.

    An attribute that varies within a site comes back NULL with ``conflicts`` counting it.
    """
    aggs: dict[str, Column] = {}
    for a in attrs:
        same = F.min(a).eqNullSafe(F.max(a))
        aggs[a] = F.when(same, F.max(a))
    # count_distinct > 1 only when min and max differ
    aggs["conflicts"] = sum(((F.min(a) != F.max(a)).cast("bigint") for a in attrs), F.lit(0).cast("bigint"))
    aggs["conflicts"] = F.coalesce(aggs["conflicts"], F.lit(0).cast("bigint"))
    return agg_with_medians(df, keys, aggs, medians)


def profile(df: DataFrame, cols: Sequence[str], category: Mapping[str, str] | None = None) -> DataFrame:
    """Per metric: variance, CV, missing and non-zero shares - one pass, one row per metric."""
    one = df.agg(*[F.struct(
        F.lit(c).alias("metric"), F.var_samp(c).alias("var"),
        F.try_divide(F.stddev_samp(c), F.abs(F.avg(c))).alias("cv"),
        F.count(c).alias("non_na"), (n_rows() - F.count(c)).alias("is_na"),
        F.round((n_rows() - F.count(c)) / n_rows(), 3).alias("perc_na"),
        F.count(F.when(F.col(c) != 0, 1)).alias("non_0"),
        (F.count(F.when(F.col(c) != 0, 1)) / n_rows()).alias("perc_non0")).alias(c) for c in cols])
    return one.select(F.inline(F.array(*cols)))


def screen_metrics(prof: DataFrame, max_na: float = 0.5, min_non0: int = 100,
                   drop: str = "(Area|Vol)$", names: Sequence[str] = ()) -> DataFrame:
    """Enough data, enough non-zeros, and not a size metric."""
    return prof.where((F.col("perc_na") < max_na) & (F.col("non_0") > min_non0)
                      & ~F.col("metric").rlike(drop) & ~F.col("metric").isin(list(names)))


def null_fraction(df: DataFrame) -> DataFrame:
    one = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in df.columns])
    return one.unpivot([], df.columns, "column_name", "null_share")


def two_stage(df: DataFrame, inner: Sequence[str], outer: Sequence[str], inner_aggs: Mapping[str, Column],
              outer_aggs: Mapping[str, Column]) -> DataFrame:
    first = df.groupBy(*inner).agg(*[c.alias(n) for n, c in inner_aggs.items()])
    return first.groupBy(*outer).agg(*[c.alias(n) for n, c in outer_aggs.items()])


def with_total(df: DataFrame, key: str, aggs: Mapping[str, Column], total: str = "Total") -> DataFrame:
    """Per-group rows and a Total row computed over all rows; ``is_total`` sorts it last."""
    g = F.grouping(key)
    out = df.rollup(key).agg(g.cast("int").alias("is_total"), *[c.alias(n) for n, c in aggs.items()])
    return out.withColumn(key, F.when(F.col("is_total") == 1, F.lit(total)).otherwise(F.col(key)))


# ---- window-style operators ----------------------------------------------------------

def share(df: DataFrame, keys: Sequence[str], x: str, out: str) -> DataFrame:
    return with_group_stats(df, keys, {"__t": F.sum(x)}).withColumn(
        out, F.try_divide(F.col(x), F.col("__t"))).drop("__t")


def keep_max(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Rows equal to the group maximum, all ties kept; later columns settle ties in turn.

    The maximum is a map-side combined aggregate joined back, so a group of nothing but ties is not gathered in one task.
    """
    marks = [F.struct(F.col(c).isNotNull(), c) for c in cols]
    known = df.where(F.col(cols[0]).isNotNull()).withColumn("__m", F.struct(*marks))
    return with_group_stats(known, keys, {"__top": F.max("__m")}).where(F.col("__m").eqNullSafe(F.col("__top"))).drop("__m", "__top")


def first_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    return top_n(df, keys, order, 1)


def latest(df: DataFrame, keys: Sequence[str], ts: str) -> DataFrame:
    return keep_max(df, keys, [ts])


def top_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], n: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= n).drop("__rn")


def standardise(df: DataFrame, cols: Sequence[str], ref: DataFrame, suffix: str = "_z") -> DataFrame:
    """z-scores with the reference table's mean and sd, as one scalar row: no shuffle of ``df``."""
    s = ref.agg(F.struct(*[f(c).alias(f"{n}_{c}") for c in cols
                           for n, f in (("m", F.avg), ("s", F.stddev_samp))]).alias("s")).scalar()
    return df.withColumns({f"{c}{suffix}": F.try_divide(F.col(c) - s[f"m_{c}"], s[f"s_{c}"]) for c in cols})


def centre(df: DataFrame, cols: Sequence[str], ref: DataFrame, suffix: str = "_center") -> DataFrame:
    s = ref.agg(F.struct(*[F.avg(c).alias(c) for c in cols]).alias("s")).scalar()
    return df.withColumns({f"{c}{suffix}": F.col(c) - s[c] for c in cols})


def dedupe(df: DataFrame, key: Sequence[str], crew: str, policy: Mapping[str, str], n: str, ts: str,
           tie: str) -> DataFrame:
    """Among rows sharing a key, a crew's policy picks survivors; other crews keep all rows.

    ``highest``: one row with the highest estimate.  ``highest_latest``: the highest, latest survey.
    """
    ruled = F.coalesce(F.col(crew).isin(*policy), F.lit(False))
    by_date = [c for c, rule in policy.items() if rule == "highest_latest"]
    best = df.where(ruled).withColumn("__latest", F.when(F.col(crew).isin(by_date), F.col(ts)))
    w = Window.partitionBy(*key, crew).orderBy(
        F.col(n).desc_nulls_last(), F.col("__latest").desc_nulls_last(), F.col(tie))
    best = best.withColumn("__rn", F.row_number().over(w)).where("__rn <= 1").drop("__rn", "__latest")
    return df.where(~ruled).unionByName(best.select(*df.columns))


def cumulative_cut(df: DataFrame, weight: str, p: float, tie: Sequence[str], keys: Sequence[str] = (),
                   out: str = "cum_weight", group_rows: int | None = None) -> DataFrame:
    """Rows, heaviest first, whose running weight stays below ``p``."""
    ordered = df.withColumn("__neg", -F.col(weight))
    ran = running(ordered, keys, ["__neg", *tie], {out: ("sum", F.col(weight))}, group_rows=group_rows)
    return ran.where(F.col(out) < p).drop("__neg")


def range_flags(df: DataFrame, metric: str, value: str, ref: DataFrame) -> DataFrame:
    """In-range and in-IQR flags of a long (metric, value) table against a reference table."""
    bounds = quantiles(ref, [metric], value, {"min_ref": 0.0, "lower_quant": 0.25, "upper_quant": 0.75, "max_ref": 1.0})
    v = F.col(value)
    return natural_join(df, bounds, "left", [metric]).withColumns({
        "in_range": (v >= F.col("min_ref")) & (v <= F.col("max_ref")),
        "in_iqr": (v >= F.col("lower_quant")) & (v <= F.col("upper_quant"))})


def rank_categories(df: DataFrame, cat: str, stat: Column, out: str = "rank") -> DataFrame:
    """Order categories by an aggregate, highest first; equal values share a rank."""
    stats = df.groupBy(cat).agg(stat.alias("stat"))
    levels = stats.groupBy("stat").agg(n_rows().alias("__n")).withColumn("__neg", -F.col("stat"))
    ranks = running(levels, [], ["__neg"], {out: ("sum", F.lit(1).cast("bigint"))})
    return natural_join(stats, ranks.select("stat", out), "inner", ["stat"])
