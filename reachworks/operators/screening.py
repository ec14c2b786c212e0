"""Correlation and association screens over covariates."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reachworks.operators.aggregates import top_n
from reachworks.operators.joins import natural_join, with_group_stats
from reachworks.operators.ordered import group_sizes, running
from reachworks.session import freeze

# Ranks of one column that a task counts into its grids (16 bytes each), and of one packed row.
BLOCK_RANKS = 8_000_000
PIECE_RANKS = 250_000
# Ranks times grids of one task, and the most tasks that a block of ranks is sent to.
TASK_COUNTS = 1e9
MOST_TASKS = 256


def _pairs(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Long (x, y, xv, yv), pairwise complete: pairs of columns, not pairs of rows."""
    items = [F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.col(a).cast("double").alias("xv"),
                      F.col(b).cast("double").alias("yv")) for a, b in pairs]
    return df.select(F.inline(F.array(*items))).where("xv is not null and yv is not null")


def _cells(long: DataFrame) -> DataFrame:
    """Counts of equal value pairs, written once: the rank scans read them several times."""
    return freeze(long.groupBy("x", "y", "xv", "yv").agg(F.count(F.lit(1)).alias("n")))


def _spearman(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Correlations of mean ranks over the rows where both are known.

    A column's ranks depend on its partner only through the rows where that is missing, so a column is ranked once for
    all complete partners and once for each incomplete one, never once a pair.  The ranks of a row then meet again and
    are multiplied in blocks.
    """
    cols = list(dict.fromkeys(c for pair in pairs for c in pair))
    data = freeze(df.select(*[F.col(c).cast("double").alias(f"c{k}") for k, c in enumerate(cols)]).withColumn("__row", F.monotonically_increasing_id()))
    rows, *known = data.agg(F.count(F.lit(1)), *[F.count(f"c{k}") for k in range(len(cols))]).first()
    gaps = {k for k in range(len(cols)) if known[k] < rows}
    place = {c: k for k, c in enumerate(cols)}
    # (column, incomplete partner or none), numbered; a column alone knows of its own gaps.
    ask = lambda a, b: (a, b if b in gaps else -1)
    sides = [(ask(place[a], place[b]), ask(place[b], place[a])) for a, b in pairs]
    number = {key: i for i, key in enumerate(dict.fromkeys(k for side in sides for k in side))}
    left, right = (np.array([number[s[i]] for s in sides], dtype=np.int64) for i in (0, 1))
    value = lambda a, b: F.col(f"c{a}") if b < 0 else F.when(F.col(f"c{b}").isNotNull(), F.col(f"c{a}"))
    long = data.select("__row", F.inline(F.array(*[F.struct(F.lit(i).alias("s"), value(*key).alias("v")) for key, i in number.items()]))).where("v is not null")
    counts = freeze(long.groupBy("s", "v").agg(F.count(F.lit(1)).alias("n")))
    ran = running(counts, ["s"], ["v"], {"__cum": ("sum", F.col("n"))})
    middle = counts.groupBy("s").agg(((F.sum("n") + 1) / 2.0).alias("mid"))
    ranks = ran.join(middle, "s").select(F.col("s").alias("__s"), F.col("v").alias("__v"), (F.col("__cum") - (F.col("n") - 1) / 2.0 - F.col("mid")).alias("r"))
    ranked = long.join(ranks, (F.col("s") == F.col("__s")) & (F.col("v") == F.col("__v"))).groupBy("__row").agg(F.collect_list("s").alias("s"), F.collect_list("r").alias("r"))
    width = len(number)

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((6, len(left)))
        for pdf in batches:
            for at in range(0, len(pdf), 512):
                part = pdf.iloc[at:at + 512]
                x = np.full((len(part), width), np.nan)
                for i, (s, r) in enumerate(zip(part["s"], part["r"])):
                    x[i, s] = r
                a, b = x[:, left], x[:, right]
                ok = ~(np.isnan(a) | np.isnan(b))
                a, b = np.where(ok, a, 0.0), np.where(ok, b, 0.0)
                for t, m in zip(total, (ok, a, b, a * a, b * b, a * b)):
                    t += m.sum(axis=0)
        yield pd.DataFrame({"p": np.arange(len(left)), **dict(zip(_SUMS, total))})

    return _from_sums(ranked.select("s", "r").mapInPandas(products, "p bigint, " + ", ".join(f"{c} double" for c in _SUMS)), pairs)


_SUMS = ("n", "sx", "sy", "sxx", "syy", "sxy")


def _from_sums(parts: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Correlations (x, y, r) from the partial sums of pairs numbered in ``p``; pairs without a row are left out."""
    got = parts.groupBy("p").agg(*[F.sum(c).alias(c) for c in _SUMS]).where("n > 0")
    n, sx, sy, sxx, syy, sxy = (F.col(c) for c in _SUMS)
    spread = lambda s, ss: F.greatest(ss - s * s / n, F.lit(0.0))
    r = F.try_divide(sxy - sx * sy / n, F.sqrt(spread(sx, sxx) * spread(sy, syy)))
    label = F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y")) for a, b in pairs])
    return got.select(F.element_at(label, F.col("p").cast("int") + 1).alias("l"), r.alias("r")).select("l.x", "l.y", "r")


def _kendall(long: DataFrame) -> DataFrame:
    """tau-b by counting inversions level by level over the bits of the x rank.

    Two rows with different x ranks part company at exactly one bit.  At that level they share
    the higher bits, so it is enough to know, per (level, shared prefix) and in order of y, how
    many rows came so far from the low side: work grows with n log n, never with pairs of rows.
    """
    cells = _cells(long)
    xs = cells.groupBy("x", "y", "xv").agg(F.sum("n").alias("nx"))
    dense = running(xs, ["x", "y"], ["xv"], {"rx": ("sum", F.lit(1).cast("bigint"))})
    size = dense.groupBy("x", "y").agg(
        F.max("rx").alias("m"), F.sum("nx").alias("n"), F.sum(F.col("nx").cast("double") * (F.col("nx") - 1) / 2).alias("tx"))
    ty = cells.groupBy("x", "y", "yv").agg(F.sum("n").alias("ny")).groupBy("x", "y").agg(
        F.sum(F.col("ny").cast("double") * (F.col("ny") - 1) / 2).alias("ty"))
    keyed = cells.join(dense.select("x", "y", "xv", "rx"), ["x", "y", "xv"]).join(size.select("x", "y", "m"), ["x", "y"])
    levels = F.sequence(F.lit(0), F.length(F.bin("m")) - 1)
    bits = keyed.select("x", "y", "yv", "n", "rx", F.explode(levels).alias("lv")).select(
        "x", "y", "lv", F.expr("shiftright(rx, lv + 1)").alias("prefix"), "yv",
        F.when(F.expr("shiftright(rx, lv) % 2") == 0, F.col("n")).otherwise(0).alias("lo"),
        F.when(F.expr("shiftright(rx, lv) % 2") == 1, F.col("n")).otherwise(0).alias("hi"))
    g = ["x", "y", "lv", "prefix"]
    at = bits.groupBy(*g, "yv").agg(F.sum("lo").alias("lo"), F.sum("hi").alias("hi"))
    ran = running(at, g, ["yv"], {"below": ("sum", F.col("lo"))})
    totals = at.groupBy(*g).agg(F.sum("lo").alias("all_lo"))
    # Pair counts pass the range of integers long before rows do.
    hi = F.col("hi").cast("double")
    c = F.sum(hi * (F.col("below") - F.col("lo")))
    d = F.sum(hi * (F.col("all_lo") - F.col("below")))
    score = ran.join(totals, g).groupBy("x", "y").agg((c - d).cast("double").alias("s"))
    n0 = F.col("n").cast("double") * (F.col("n") - 1) / 2.0
    return score.join(size, ["x", "y"]).join(ty, ["x", "y"]).select(
        "x", "y", F.try_divide(F.col("s"), F.sqrt((n0 - F.col("tx")) * (n0 - F.col("ty")))).alias("r"))


def _pearson(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Correlations over the rows where both are known, from one pass of cross-products.

    A task multiplies blocks of rows and ships a few sums per pair, so the plan stays as small for a hundred columns as
    for three.  Columns are shifted by their means first, which keeps the sums accurate.
    """
    cols = list(dict.fromkeys(c for pair in pairs for c in pair))
    place = {c: k for k, c in enumerate(cols)}
    left, right = (np.array([place[p[k]] for p in pairs], dtype=np.int64) for k in (0, 1))
    mean = df.agg(*[F.avg(F.col(c).cast("double")).alias(f"m{k}") for k, c in enumerate(cols)]).first()

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        k = len(cols)
        total = [np.zeros((k, k)) for _ in range(4)]
        for pdf in batches:
            x = pdf.to_numpy(dtype=float)
            known = (~np.isnan(x)).astype(float)
            x = np.nan_to_num(x)
            for t, m in zip(total, (known.T @ known, x.T @ known, (x * x).T @ known, x.T @ x)):
                t += m
        n, one, two, both = total
        yield pd.DataFrame({"p": np.arange(len(left)), "n": n[left, right], "sx": one[left, right], "sy": one[right, left],
                            "sxx": two[left, right], "syy": two[right, left], "sxy": both[left, right]})

    shifted = df.select(*[(F.col(c).cast("double") - F.lit(mean[k])).alias(f"c{k}") for k, c in enumerate(cols)])
    names = ("n", "sx", "sy", "sxx", "syy", "sxy")
    got = shifted.mapInPandas(sums, "p bigint, " + ", ".join(f"{c} double" for c in names)).groupBy("p").agg(*[F.sum(c).alias(c) for c in names])
    n, sx, sy, sxx, syy, sxy = (F.col(c) for c in names)
    spread = lambda s, ss: F.greatest(ss - s * s / n, F.lit(0.0))
    r = F.try_divide(sxy - sx * sy / n, F.sqrt(spread(sx, sxx) * spread(sy, syy)))
    label = F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y")) for a, b in pairs])
    return got.select(F.element_at(label, F.col("p").cast("int") + 1).alias("l"), r.alias("r")).select("l.x", "l.y", "r")


def corr_long(df: DataFrame, cols: Sequence[str], method: str = "pearson",
              min_abs: float | None = None, pairs: Sequence[tuple[str, str]] | None = None) -> DataFrame:
    """Pairwise-complete correlations, one row per column pair (lower triangle)."""
    pairs = list(pairs) if pairs is not None else list(combinations(cols, 2))
    if method == "pearson":
        out = _pearson(df, pairs)
    else:
        out = _spearman(df, pairs) if method == "spearman" else _kendall(_pairs(df, pairs))
    return out if min_abs is None else out.where(F.abs("r") > min_abs)


def corr_by_category(df: DataFrame, category: Mapping[str, str], method: str = "spearman") -> DataFrame:
    """Correlations between metrics of the same category, all categories in one plan."""
    pairs = [(a, b) for a, b in combinations(category, 2) if category[a] == category[b]]
    label = F.create_map(*[F.lit(v) for kv in category.items() for v in kv])
    return corr_long(df, list(category), method, pairs=pairs).withColumn("category", label[F.col("x")])


def collinear(df: DataFrame, category: Mapping[str, str], limit: float = 0.7,
              method: str = "spearman") -> DataFrame:
    return corr_by_category(df, category, method).where(F.abs("r") > limit)


def mic(df: DataFrame, covars: Sequence[str], response: str, tie: str, alpha: float = 0.6, block_ranks: int = BLOCK_RANKS) -> DataFrame:
    """Maximal information coefficient over equal-frequency grids with a*b <= n**alpha cells.

    Ranks come from one ordered scan per axis; every grid is then a function of the two ranks.
    A task has one block of ranks and a share of the grids.  A metric of one block is scored where it is counted; of
    longer ones the counts of a grid meet, a row for each block.
    """
    long = df.select(tie, F.inline(F.array(*[
        F.struct(F.lit(k).alias("metric"), F.col(c).cast("double").alias("xv"), F.col(response).cast("double").alias("yv"))
        for k, c in enumerate(covars)]))).where("xv is not null and yv is not null")
    long = freeze(long)
    size = group_sizes(long, ["metric"])
    rx = running(long, ["metric"], ["xv", tie], {"rx": ("sum", F.lit(1).cast("bigint"))}, size=size)
    ry = freeze(running(rx, ["metric"], ["yv", tie], {"ry": ("sum", F.lit(1).cast("bigint"))}, size=size))
    ranked = with_group_stats(ry, ["metric"], {"n": F.count(F.lit(1))}).withColumn(
        "cells", F.floor(F.pow(F.col("n").cast("double"), F.lit(alpha))).cast("int"))

    piece = min(PIECE_RANKS, block_ranks)
    tasks = F.least(F.ceil(F.col("n") * F.col("cells") * F.ln("cells") / TASK_COUNTS), F.lit(MOST_TASKS)).cast("int")
    packed = ranked.where("cells >= 4").select("metric", "n", "cells", "rx", "ry", F.expr(f"int((rx - 1) div {piece})").alias("piece")).groupBy("metric", "n", "cells", "piece").applyInArrow(
        _pack_ranks, "metric int, n bigint, cells int, piece int, rx binary, ry binary")
    block = {"block": F.expr(f"int(piece div {max(1, block_ranks // piece)})"), "one": F.col("n") <= max(1, block_ranks // piece) * piece, "tasks": tasks}
    shared = packed.withColumns(block).withColumn("task", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)))
    # Few bytes and much work: tasks are not to be merged by size.
    keys, parts = ("metric", "block", "task"), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = freeze(shared.repartition(parts, *keys).groupBy(*keys).applyInArrow(_count_cells, "metric int, n bigint, a int, b int, counts binary, mic double"))
    merged = counts.where("counts is not null").groupBy("metric", "a", "b").applyInPandas(_merge_grid, "metric int, mic double")
    best = counts.where("counts is null").select("metric", "mic").unionByName(merged).groupBy("metric").agg(F.max("mic").alias("mic"))
    # A metric too short for any grid keeps its row, with NULL.
    names = F.array(*[F.struct(F.lit(k).alias("metric"), F.lit(c).alias("name")) for k, c in enumerate(covars)])
    every = df.sparkSession.range(1).select(F.inline(names))
    return every.join(best, "metric", "left").select(F.col("name").alias("metric"), "mic")


def _bin_sizes(n: int, parts: int) -> np.ndarray:
    """Rows of the bins of ntile: the first n % parts hold one more."""
    return n // parts + (np.arange(parts) < n % parts)


def _bins(sorted_ranks: np.ndarray, n: int, parts: int) -> np.ndarray:
    """Zero-based ntile of one-based ranks in ascending order."""
    first = np.cumsum(_bin_sizes(n, parts)) + 1
    ends = np.searchsorted(sorted_ranks, first, "left")
    return np.repeat(np.arange(parts), np.diff(ends, prepend=0))


def _pack_ranks(table: pa.Table) -> pa.Table:
    packed = {c: pa.array([table.column(c).to_numpy().astype(np.int64).tobytes()], pa.binary()) for c in ("rx", "ry")}
    return pa.table({**{c: table.column(c)[:1] for c in ("metric", "n", "cells", "piece")}, **packed})


def _score(counts: np.ndarray, n: int, a: int, b: int) -> float:
    """Information of one grid over its highest possible value."""
    c = counts.reshape(a, b).astype(float)
    some = c > 0
    ratio = c * n / np.outer(_bin_sizes(n, a), _bin_sizes(n, b))
    return float((c[some] / n * np.log(ratio[some])).sum() / np.log(min(a, b)))


def _count_cells(table: pa.Table) -> pa.Table:
    """Counts of this block's ranks in this task's grids, or the best score where the block is all there is."""
    metric, n, cells, one, task, tasks = (table.column(c)[0].as_py() for c in ("metric", "n", "cells", "one", "task", "tasks"))
    rx, ry = (np.frombuffer(b"".join(table.column(c).to_pylist()), np.int64) for c in ("rx", "ry"))
    by_x, by_y = np.argsort(rx), np.argsort(ry)
    rx, at = rx[by_x], np.empty(len(by_x), np.int64)
    at[by_x] = np.arange(len(by_x))
    at, ry = at[by_y], ry[by_y]
    grids = sum(cells // a - 1 for a in range(2, cells // 2 + 1))
    low, high, seen, best, out = grids * task // tasks, grids * (task + 1) // tasks, 0, 0.0, []
    for a in range(2, cells // 2 + 1):
        here = range(max(low - seen, 0) + 2, min(high - seen, cells // a - 1) + 2)
        seen += cells // a - 1
        left = _bins(rx, n, a)[at] if here else None
        for b in here:
            counts = np.bincount(left * b + _bins(ry, n, b), minlength=a * b)
            if one:
                best = max(best, _score(counts, n, a, b))
            else:
                out.append((a, b, counts.astype(np.int64).tobytes()))
    rows = [(None, None, None)] if one else out
    kinds = {"a": pa.int32(), "b": pa.int32(), "counts": pa.binary()}
    return pa.table({"metric": pa.array([metric] * len(rows), pa.int32()), "n": pa.array([n] * len(rows), pa.int64()),
                     **{c: pa.array([r[i] for r in rows], t) for i, (c, t) in enumerate(kinds.items())}, "mic": pa.array([best if one else None] * len(rows), pa.float64())})


def _merge_grid(pdf: pd.DataFrame) -> pd.DataFrame:
    """Score of one grid, the counts of all blocks added up."""
    metric, n, a, b = (int(pdf[c].iloc[0]) for c in ("metric", "n", "a", "b"))
    total = np.zeros(a * b, np.int64)
    for raw in pdf["counts"]:
        total += np.frombuffer(raw, np.int64)
    return pd.DataFrame({"metric": [metric], "mic": [_score(total, n, a, b)]})


def select_metrics(scores: DataFrame, prof: DataFrame, category: Mapping[str, str], n: int = 5) -> DataFrame:
    """Screened metrics ranked within category by association strength."""
    label = F.create_map(*[F.lit(v) for kv in category.items() for v in kv])
    both = natural_join(scores, prof, "inner", ["metric"]).withColumn(
        "category", F.coalesce(label[F.col("metric")], F.lit("Other")))
    return top_n(both, ["category"], [F.col("mic").desc(), F.col("metric")], n)
