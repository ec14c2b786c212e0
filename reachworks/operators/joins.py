"""Joins with dplyr-style key rules: shared names by default, missing matches missing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reachworks.operators.ordered import group_sizes, running
from reachworks.session import freeze

# A group this large is spread over SALTS tasks.  At most rows/HOT_ROWS keys can qualify,
# so the list of hot keys stays broadcastable.
HOT_ROWS = 5_000_000
SALTS = 64
# Pairs of one task in joins that make far more rows than they read.
TASK_PAIRS = 4_000_000


def shared(left: DataFrame, right: DataFrame) -> list[str]:
    return [c for c in left.columns if c in right.columns]


def natural_join(left: DataFrame, right: DataFrame, how: str = "inner",
                 keys: Sequence[str] | None = None) -> DataFrame:
    """Equi-join on all shared names (or ``keys``), NULL keys matching NULL keys."""
    keys = list(keys) if keys is not None else shared(left, right)
    r = right.select(*[F.col(c).alias(f"__r_{c}") if c in keys else F.col(c) for c in right.columns])
    cond = [left[k].eqNullSafe(r[f"__r_{k}"]) for k in keys]
    joined = left.join(r, cond, how)
    if how in ("left_semi", "left_anti"):
        return joined
    if how in ("full", "outer", "right"):
        joined = joined.withColumns({k: F.coalesce(F.col(k), F.col(f"__r_{k}")) for k in keys})
    return joined.drop(*[f"__r_{k}" for k in keys])


def anti(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    return natural_join(left, right.select(*keys).distinct(), "left_anti", keys)


def exists_flag(left: DataFrame, right: DataFrame, key: str, out: str) -> DataFrame:
    """TRUE/FALSE (never NULL): is the key present in ``right``?"""
    known = right.select(key).distinct().withColumn(out, F.lit(True))
    return natural_join(left, known, "left", [key]).withColumn(out, F.coalesce(out, F.lit(False)))


def with_group_stats(df: DataFrame, keys: Sequence[str], aggs: dict[str, Column],
                     hot_rows: int | None = None) -> DataFrame:
    """Grouped mutate: aggregate once (map-side combined), join the result back to every row.

    Hot keys are salted on the row side and replicated on the one-row-per-group side.
    """
    keys = list(keys)
    hot_rows = HOT_ROWS if hot_rows is None else hot_rows
    cols = [c.alias(n) for n, c in aggs.items()]
    if not keys:
        one = df.agg(F.struct(*cols).alias("s")).scalar()
        return df.withColumns({n: one[n] for n in aggs})
    stats = df.groupBy(*keys).agg(*cols, F.count(F.lit(1)).alias("__n"))
    hot = stats.where(F.col("__n") >= hot_rows).select(
        *[F.col(k).alias(f"__h_{k}") for k in keys], F.lit(True).alias("__hot"))
    salt = F.pmod(F.xxhash64(*df.columns, F.spark_partition_id()), F.lit(SALTS)).cast("int")
    rows = df.join(F.broadcast(hot), [df[k].eqNullSafe(hot[f"__h_{k}"]) for k in keys], "left")
    rows = rows.withColumn("__salt", F.when(F.col("__hot"), salt).otherwise(F.lit(0))).drop(
        "__hot", *[f"__h_{k}" for k in keys])
    salts = F.when(F.col("__n") >= hot_rows, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    spread = stats.select(
        *[F.col(k).alias(f"__g_{k}") for k in keys], *aggs, F.explode(salts).alias("__g_salt"))
    on = [rows[k].eqNullSafe(spread[f"__g_{k}"]) for k in keys] + [rows["__salt"] == spread["__g_salt"]]
    return rows.join(spread, on).select(*[c for c in df.columns if c not in aggs], *aggs)


def spread_join(left: DataFrame, right: DataFrame, on: Sequence[str], task_pairs: int | None = None) -> DataFrame:
    """Equi-join whose pairs outnumber its rows: there are as many tasks as the counted pairs need, whatever the bytes
    read, and a key with many pairs is dealt over several tasks by rows of the left side.

    At most pairs/``task_pairs`` keys are dealt, so their list stays broadcastable.  Neither side is: rows that were
    exploded from few bytes look small to the planner.
    """
    right = right.hint("shuffle_merge")
    on, limit = list(on), TASK_PAIRS if task_pairs is None else task_pairs
    n, m = (d.groupBy(*on).agg(F.count(F.lit(1)).alias(c)) for d, c in ((left, "__n"), (right, "__m")))
    pairs = n.join(m.hint("shuffle_merge"), on).withColumn("__p", F.col("__n").cast("double") * F.col("__m"))
    hot = freeze(pairs.withColumn("__parts", F.least(F.ceil(F.col("__p") / limit), F.col("__n")).cast("int")).select(*on, "__p", "__parts"))
    total, dealt = hot.agg(F.coalesce(F.sum("__p"), F.lit(0.0)), F.max("__parts")).first()
    spark = left.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism, int(total // limit) + 1)
    if total <= limit:
        return left.join(right, on)
    if (dealt or 0) <= 1:
        return left.repartition(tasks, *on).join(right.repartition(tasks, *on).hint("shuffle_merge"), on)
    many = F.broadcast(hot.where("__parts > 1").select(*on, "__parts"))
    part = F.coalesce(F.pmod(F.xxhash64(*left.columns, F.spark_partition_id()), F.col("__parts")), F.lit(0)).cast("int")
    l = left.join(many, on, "left").withColumn("__part", part).drop("__parts")
    r = right.join(many, on, "left").withColumn("__part", F.explode(F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1))).drop("__parts")
    return l.repartition(tasks, *on, "__part").join(r.repartition(tasks, *on, "__part").hint("shuffle_merge"), [*on, "__part"]).drop("__part")


def band_join(left: DataFrame, right: DataFrame, on: Sequence[str], lcol: str, rcol: str,
              width: float) -> DataFrame:
    """Same ``on`` keys and ``|lcol - rcol| <= width``: bucket equi-join, then the exact test.

    The measure columns need different names; skewed buckets are split by AQE.
    """
    bucket = lambda c: F.floor(F.col(c) / F.lit(float(width)))
    l = left.withColumn("__b", bucket(lcol))
    r = right.withColumn("__b", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)),
                                                      lambda d: bucket(rcol) + d)))
    return spread_join(l, r, [*on, "__b"]).where(F.abs(F.col(lcol) - F.col(rcol)) <= width).drop("__b")


def band_count(sites: DataFrame, events: DataFrame, on: Sequence[str], site_id: str, lcol: str,
               rcol: str, width: float, by: Sequence[str], out: str, event_id: str | None = None) -> DataFrame:
    """Events within ``width`` of each site, per ``by`` group, without building the pairs.

    With ``event_id`` an event recorded more than once counts once per route and group, at its first place.

    Each site asks two questions of the running event count along the route: how many at or
    below ``m + width`` and how many below ``m - width``.  Groups with no event are left out.
    """
    on, by = list(on), list(by)
    if event_id is not None:
        events = events.groupBy(*on, *by, event_id).agg(F.min(rcol).alias(rcol))
    groups = events.select(*on, *by).distinct()
    probes = sites.select(*on, site_id, F.col(lcol).alias("__m")).join(groups, on)
    asks = probes.select(
        *on, *by, site_id,
        F.explode(F.array(
            F.struct((F.col("__m") - F.lit(width)).alias("pos"), F.lit(0).alias("side"), F.lit(-1).alias("sign")),
            F.struct((F.col("__m") + F.lit(width)).alias("pos"), F.lit(2).alias("side"), F.lit(1).alias("sign")),
        )).alias("q"),
    ).select(*on, *by, site_id, "q.pos", "q.side", "q.sign", F.lit(0).cast("bigint").alias("n"))
    marks = events.groupBy(*on, *by, F.col(rcol).cast("double").alias("pos")).agg(
        F.count(F.lit(1)).alias("n")
    ).select(*on, *by, F.lit(None).cast(sites.schema[site_id].dataType).alias(site_id),
             "pos", F.lit(1).alias("side"), F.lit(0).alias("sign"), "n")
    ran = running(asks.unionByName(marks), [*on, *by], ["pos", "side", site_id], {"__c": ("sum", F.col("n"))})
    return (
        ran.where(F.col("side") != 1)
        .groupBy(*on, *by, site_id)
        .agg(F.sum(F.col("sign") * F.col("__c")).alias(out))
        .where(F.col(out) > 0)
    )


def nearest_join(left: DataFrame, right: DataFrame, keys: Sequence[str], lt: str, rt: str,
                 lid: str, rid: str, group_rows: int | None = None) -> DataFrame:
    """For each left row the right row of the same key nearest in ``rt`` (a time or a number);
    earlier, then lower id, on ties.

    One ordered pass over both sides, so a key with many rows on each side never makes pairs.
    Left rows whose key has no right row are dropped, and so are rows of unknown time on either side.
    """
    keys = list(keys)
    left, right = left.where(F.col(lt).isNotNull()), right.where(F.col(rt).isNotNull())
    carried = [c for c in right.columns if c not in keys]
    # Copies of one right instant collapse to its lowest id before the scan, which carries the instant alone.
    r1 = right.groupBy(*keys, F.col(rt).alias("__t")).agg(
        F.min(F.struct(rid, *[c for c in carried if c != rid])).alias("__r"))
    r = right.select(*keys, F.col(rt).alias("__t")).distinct().select(
        *keys, "__t", F.lit(0).alias("__side"), F.lit(None).cast(left.schema[lid].dataType).alias("__id"), F.col("__t").alias("__p"))
    l = left.select(*keys, F.col(lt).alias("__t"), F.lit(1).alias("__side"), F.col(lid).alias("__id"),
                    F.lit(None).cast(r.schema["__p"].dataType).alias("__p"),
                    F.struct(*left.columns).alias("__l"))
    both = l.unionByName(r.withColumn("__l", F.lit(None).cast(l.schema["__l"].dataType)))
    order = ["__t", "__side", "__id"]
    size = group_sizes(left.select(*keys).unionByName(right.select(*keys)), keys)
    fwd = running(both, keys, order, {"__prev": ("max", F.col("__p"))}, group_rows=group_rows, size=size)
    bwd = running(fwd, keys, order, {"__next": ("min", F.col("__p"))}, descending=True, group_rows=group_rows, size=size)
    t, p, n = F.col(f"__l.{lt}"), F.col("__prev"), F.col("__next")
    timed = left.schema[lt].dataType.simpleString().startswith(("timestamp", "date"))
    num = lambda c: (c.cast("timestamp") if timed else c).cast("double")
    gap = lambda a, b: F.abs(num(a) - num(b))
    best = F.when(n.isNull(), p).when(p.isNull(), n).when(
        gap(p, t) <= gap(n, t), p).otherwise(n)
    picked = bwd.where("__side = 1").select("__l", best.alias("__best")).where(F.col("__best").isNotNull())
    # The row behind the instant comes by an equi-join, spread by time even where a key is hot.  Both sides are as long
    # as the input, whatever sizes are guessed for them, so neither is broadcast.
    rows = r1.select(*[F.col(k).alias(f"__k_{k}") for k in keys], "__t", "__r").hint("shuffle_merge")
    on = [F.col(f"__l.{k}").eqNullSafe(F.col(f"__k_{k}")) for k in keys]
    return picked.join(rows, [*on, F.col("__best") == F.col("__t")]).select("__l.*", *[F.col(f"__r.{c}").alias(c) for c in carried])


def tolerance_join(left: DataFrame, lookup: DataFrame, keys: Sequence[str], lt: str, rt: str,
                   value: str, days: int = 7) -> DataFrame:
    """Left join a lookup and blank its value where the two dates lie more than ``days`` apart."""
    joined = natural_join(left, lookup, "left", keys)
    return joined.withColumn(value, F.when(F.abs(day_gap(F.col(lt), F.col(rt))) <= days, F.col(value)))


def day_gap(a: Column, b: Column) -> Column:
    """Whole days between two timestamps, truncated toward zero."""
    secs = a.cast("timestamp").cast("double") - b.cast("timestamp").cast("double")
    return (secs / 86400).cast("int")


def cross(df: DataFrame, name: str, values: Sequence) -> DataFrame:
    """Every row once per literal value."""
    return df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))


def expand_where(df: DataFrame, col: str, marker: str, values: Sequence[str]) -> DataFrame:
    """Rows carrying ``marker`` stand for every value; other rows pass through."""
    every = F.array(*[F.lit(v) for v in values])
    return df.withColumn(col, F.explode(F.when(F.col(col) == marker, every).otherwise(F.array(col))))


def upsert(base: DataFrame, updates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Updated rows replace their originals; everything else stays."""
    return anti(base, updates, keys).unionByName(updates.select(*base.columns))


def backfill(df: DataFrame, key: str, col: str, how: str = "max") -> DataFrame:
    """Fill a missing value from the other rows of the same entity (``max`` or ``avg``)."""
    fn = {"max": F.max, "avg": F.avg}[how]
    return with_group_stats(df, [key], {"__fill": fn(col)}).withColumn(
        col, F.coalesce(F.col(col), F.col("__fill"))).drop("__fill")


def fill_from(df: DataFrame, col: str, sources: Sequence[tuple[DataFrame, Sequence[str], str]]) -> DataFrame:
    """Fill ``col`` from a prioritised list of (table, keys, value column)."""
    names = []
    for i, (src, keys, value) in enumerate(sources):
        name = f"__src{i}"
        df = natural_join(df, src.select(*keys, F.col(value).alias(name)), "left", keys)
        names.append(name)
    return df.withColumn(col, F.coalesce(col, *names)).drop(*names)


def reconcile(a: DataFrame, b: DataFrame, keys: Sequence[str], cols: Sequence[str],
              tags: tuple[str, str] = ("a", "b")) -> DataFrame:
    """Stack two sources long, pivot by source, keep the disagreements (NULL-aware)."""
    long = [d.select(*keys, *cols).unpivot(list(keys), list(cols), "field", tag) for d, tag in zip((a, b), tags)]
    both = long[0].unionByName(long[1], allowMissingColumns=True)
    wide = both.groupBy(*keys, "field").agg(*[F.max(t).alias(t) for t in tags])
    return wide.where(~F.col(tags[0]).eqNullSafe(F.col(tags[1])))


def pick_first(df: DataFrame, options: Sequence[tuple[str, str, str | None]],
               label: str = "model", value: str = "response", se: str = "SE") -> DataFrame:
    """First available estimate wins; keeps which one it was and its SE (0 for a direct estimate)."""
    lab, val, err = F.lit(None).cast("string"), F.lit(None).cast("double"), F.lit(None).cast("double")
    for name, v, s in reversed(options):
        here = F.col(v).isNotNull()
        lab = F.when(here, F.lit(name)).otherwise(lab)
        val = F.when(here, F.col(v)).otherwise(val)
        err = F.when(here, F.col(s) if s else F.lit(0.0)).otherwise(err)
    return df.withColumns({label: lab, value: val, se: err})


def scenario_lookup(visits: DataFrame, wide: DataFrame, key: str, year: str, prefix: str,
                    out: str) -> DataFrame:
    """Match a year-suffixed scenario column to the visit year."""
    cols = [c for c in wide.columns if c.startswith(prefix)]
    long = (
        wide.select(key, *cols).unpivot([key], cols, "scenario", out)
        .withColumn(year, F.right("scenario", F.lit(4)).try_cast("int"))
        .where(F.col(year).isNotNull())
        .select(key, year, out)
    )
    return natural_join(visits, long, "left", [key, year])


def prefer(first: DataFrame, fallback: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Preferred rows, then fallback rows whose key the preferred source lacks."""
    return first.unionByName(anti(fallback, first, keys), allowMissingColumns=True)
