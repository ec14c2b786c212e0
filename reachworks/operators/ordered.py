"""Ordered scans over groups of any size.

A plain window puts a whole group in one task.  That is fine for ordinary groups and is
what we plan when the largest group is known to be small.  Beyond ``GROUP_ROWS`` rows the
input is range-partitioned on (keys, order), so a hot group spreads over many partitions;
each partition scans its own rows and at most one group per partition needs a carried
value from the partitions before it, which keeps the carry table no longer than the
number of partitions.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reachworks.session import freeze

GROUP_ROWS = 2_000_000
PARTITION_ROWS = 2_000_000
_PID = "__pid"
_FNS = {"sum": F.sum, "max": F.max, "min": F.min}


class Sizes(NamedTuple):
    largest: int
    rows: int


def group_sizes(df: DataFrame, keys: Sequence[str]) -> Sizes:
    """Rows of the biggest group and of the table (two numbers come back to the driver)."""
    if not keys:
        n = df.count()
        return Sizes(n, n)
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    top, rows = sizes.agg(F.max("n"), F.sum("n")).first()
    return Sizes(top or 0, rows or 0)


def _ordering(order: Sequence[str], descending: bool) -> list[Column]:
    return [F.col(c).desc() if descending else F.col(c).asc() for c in order]


def _ranged(df: DataFrame, keys: Sequence[str], order: Sequence[str], rows: int) -> DataFrame:
    """Partitions follow the row count, so each stays small however long the table is."""
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // PARTITION_ROWS))
    return freeze(df.repartitionByRange(n, *keys, *order).withColumn(_PID, F.spark_partition_id()))


def _spanning(ranged: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Groups that cross a partition edge: each partition adds at most its first and last group."""
    if not keys:
        return ranged
    ends = ranged.groupBy(_PID).agg(
        F.min(F.struct(*keys)).alias("a"), F.max(F.struct(*keys)).alias("b")
    )
    edge = (
        ends.select(_PID, F.explode(F.array_distinct(F.array("a", "b"))).alias("k"))
        .groupBy("k").agg(F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select(*[F.col(f"k.{c}").alias(f"__s_{c}") for c in keys])
    )
    on = [ranged[c].eqNullSafe(edge[f"__s_{c}"]) for c in keys]
    return ranged.join(F.broadcast(edge), on, "left_semi")


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    outs: dict[str, tuple[str, str | Column]],
    descending: bool = False,
    group_rows: int | None = None,
    size: Sizes | None = None,
) -> DataFrame:
    """Running sum/max/min per group, ``outs = {name: (fn, column)}``.

    ``order`` must be a total order within a group (add a tie-break column, or aggregate
    equal values first).  ``size`` gives the group sizes where they are known already.
    """
    limit = GROUP_ROWS if group_rows is None else group_rows
    keys, order = list(keys), list(order)
    sort = _ordering(order, descending)
    to_here = (Window.unboundedPreceding, Window.currentRow)
    exprs = {name: (fn, F.col(c) if isinstance(c, str) else c) for name, (fn, c) in outs.items()}
    size = size or group_sizes(df, keys)
    if size.largest <= limit:
        w = Window.partitionBy(*keys).orderBy(*sort).rowsBetween(*to_here)
        return df.withColumns({n: _FNS[fn](c).over(w) for n, (fn, c) in exprs.items()})

    base = df.withColumns({f"__in_{n}": c for n, (_, c) in exprs.items()})
    ranged = _ranged(base, keys, order, size.rows)
    w = Window.partitionBy(_PID, *keys).orderBy(*sort).rowsBetween(*to_here)
    local = ranged.withColumns({n: _FNS[fn](f"__in_{n}").over(w) for n, (fn, _) in exprs.items()})
    totals = _spanning(ranged, keys).groupBy(_PID, *keys).agg(
        *[_FNS[fn](f"__in_{n}").alias(f"__t_{n}") for n, (fn, _) in exprs.items()]
    )
    pid_sort = F.col(_PID).desc() if descending else F.col(_PID).asc()
    before = Window.partitionBy(*keys).orderBy(pid_sort).rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(
        F.col(_PID).alias("__c_pid"),
        *[F.col(k).alias(f"__c_{k}") for k in keys],
        *[_FNS[fn](f"__t_{n}").over(before).alias(f"__c_out_{n}") for n, (fn, _) in exprs.items()],
    )
    on = [local[_PID] == carry["__c_pid"]] + [local[k].eqNullSafe(carry[f"__c_{k}"]) for k in keys]
    joined = local.join(F.broadcast(carry), on, "left")

    def merged(name: str, fn: str) -> Column:
        here, carried = F.col(name), F.col(f"__c_out_{name}")
        if fn == "sum":
            return F.when(here.isNull(), carried).when(carried.isNull(), here).otherwise(here + carried)
        pick = (carried > here) if fn == "max" else (carried < here)
        return F.when(here.isNull(), carried).when(pick, carried).otherwise(here)

    done = joined.withColumns({n: merged(n, fn) for n, (fn, _) in exprs.items()})
    return done.select(*df.columns, *exprs)


def row_numbers(df: DataFrame, order: Sequence[str], out: str = "row_num",
                keys: Sequence[str] = (), group_rows: int | None = None) -> DataFrame:
    """1, 2, 3 ... in a total order, per group or over the whole table."""
    return running(df, keys, order, {out: ("sum", F.lit(1).cast("bigint"))}, group_rows=group_rows)


def next_in_group(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                  outs: dict[str, str], group_rows: int | None = None) -> DataFrame:
    """``lead`` by one row within a group of any size; ``outs = {name: column}``."""
    limit = GROUP_ROWS if group_rows is None else group_rows
    keys, order = list(keys), list(order)
    sort = _ordering(order, False)
    size = group_sizes(df, keys)
    if size.largest <= limit:
        w = Window.partitionBy(*keys).orderBy(*sort)
        return df.withColumns({n: F.lead(c).over(w) for n, c in outs.items()})
    ranged = _ranged(df, keys, order, size.rows)
    w = Window.partitionBy(_PID, *keys).orderBy(*sort)
    payload = F.struct(*[F.col(c).alias(n) for n, c in outs.items()])
    local = ranged.withColumn("__lead", F.lead(payload).over(w))
    firsts = _spanning(ranged, keys).groupBy(_PID, *keys).agg(
        F.min(F.struct(*order, payload.alias("__p"))).alias("__f")
    )
    after = Window.partitionBy(*keys).orderBy(F.col(_PID).asc())
    carry = firsts.select(
        F.col(_PID).alias("__c_pid"), *[F.col(k).alias(f"__c_{k}") for k in keys],
        F.lead("__f.__p").over(after).alias("__c_next"),
    )
    on = [local[_PID] == carry["__c_pid"]] + [local[k].eqNullSafe(carry[f"__c_{k}"]) for k in keys]
    nxt = F.coalesce("__lead", "__c_next")
    return local.join(F.broadcast(carry), on, "left").select(
        *df.columns, *[nxt[n].alias(n) for n in outs]
    )


def exact_quantiles(df: DataFrame, keys: Sequence[str], col: str, ps: Sequence[float],
                    group_rows: int | None = None) -> DataFrame:
    """Interpolated (type-7) quantiles per group: columns ``keys + [q]`` with ``q`` an array.

    Ordinary groups use the built-in ``percentile``.  Larger ones go through value counts
    and a running count, then read off the two order statistics around each position.
    """
    limit = GROUP_ROWS if group_rows is None else group_rows
    keys = list(keys)
    data = df.where(F.col(col).isNotNull()).select(*keys, F.col(col).cast("double").alias("__v"))
    if group_sizes(data, keys).largest <= limit:
        arr = F.percentile("__v", F.array(*[F.lit(float(p)) for p in ps]))
        return (data.groupBy(*keys) if keys else data.groupBy()).agg(arr.alias("q"))
    counts = data.groupBy(*keys, "__v").agg(F.count(F.lit(1)).alias("__n"))
    ran = running(counts, keys, ["__v"], {"__cum": ("sum", F.col("__n"))}, group_rows=limit)
    totals = counts.groupBy(*keys).agg(F.sum("__n").alias("__tot"))
    if keys:
        t = totals.select(*[F.col(k).alias(f"__k_{k}") for k in keys], "__tot")
        ran = ran.join(t, [ran[k].eqNullSafe(t[f"__k_{k}"]) for k in keys])
    else:
        ran = ran.withColumn("__tot", totals.select("__tot").scalar())
    aggs = []
    for i, p in enumerate(ps):
        pos = (F.col("__tot") - 1) * F.lit(float(p))
        lo, hi = F.floor(pos), F.ceil(pos)
        first = F.col("__cum") - F.col("__n")
        at_lo = F.max(F.when((first <= lo) & (lo < F.col("__cum")), F.col("__v")))
        at_hi = F.max(F.when((first <= hi) & (hi < F.col("__cum")), F.col("__v")))
        frac = F.max(pos - lo)
        aggs.append((at_lo + (at_hi - at_lo) * frac).alias(f"__q{i}"))
    out = ran.groupBy(*keys).agg(*aggs)
    return out.select(*keys, F.array(*[f"__q{i}" for i in range(len(ps))]).alias("q"))
