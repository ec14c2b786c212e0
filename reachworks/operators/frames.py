"""Column-set helpers, filters and reshaping."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from reachworks.functions.scalars import count_nulls, unite
from reachworks.operators.joins import anti, natural_join, with_group_stats
from reachworks.operators.ordered import row_numbers


# ---- columns -------------------------------------------------------------------------

def select_cols(df: DataFrame, include: Sequence[str] = (".*",), exclude: Sequence[str] = (),
                last: Sequence[str] = ()) -> DataFrame:
    """Choose columns by regex, ``a:b`` range or name; absent names are ignored; ``last`` goes to the end."""
    def expand(rules: Sequence[str]) -> list[str]:
        out: list[str] = []
        for rule in rules:
            if ":" in rule:
                a, b = rule.split(":")
                i, j = df.columns.index(a), df.columns.index(b)
                names = df.columns[i:j + 1]
            else:
                names = [c for c in df.columns if re.fullmatch(rule, c)]
            out += [n for n in names if n not in out]
        return out

    dropped = set(expand(exclude))
    kept = [c for c in expand(include) if c not in dropped]
    return df.select(*[c for c in kept if c not in last], *[c for c in last if c in kept])


def rename_cols(df: DataFrame, rule: Mapping[str, str] | Callable[[str], str]) -> DataFrame:
    mapping = dict(rule) if isinstance(rule, Mapping) else {c: rule(c) for c in df.columns}
    return df.withColumnsRenamed(mapping)


def map_cols(df: DataFrame, cols: Sequence[str], fn: Callable[[Column], Column], name: str = "{}") -> DataFrame:
    return df.withColumns({name.format(c): fn(F.col(c)) for c in cols})


def conform(df: DataFrame, schema: StructType) -> DataFrame:
    """Exactly the schema's columns, in order; absent ones as typed NULLs."""
    return df.select(*[
        (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def with_row_id(df: DataFrame, order: Sequence[str], out: str = "row_num") -> DataFrame:
    return row_numbers(df, order, out)


# ---- filters -------------------------------------------------------------------------

def filter_like(df: DataFrame, col: str, regex: str, ignore_case: bool = False) -> DataFrame:
    return df.where(F.col(col).rlike(("(?i)" if ignore_case else "") + regex))


def clip_to_domain(df: DataFrame, domain: DataFrame, key: str, exempt: Column, keep: Column) -> DataFrame:
    """Exempt rows always stay; the rest need their key in the domain or ``keep`` to hold."""
    known = domain.select(key).distinct().withColumn("__in", F.lit(True))
    return natural_join(df, known, "left", [key]).where(exempt | F.col("__in").isNotNull() | keep).drop("__in")


def filter_max_missing(df: DataFrame, cols: Sequence[str], k: int = 3) -> DataFrame:
    return df.where(count_nulls(cols) <= k)


def out_of_range(df: DataFrame, key: str, metrics: Sequence[str], ref: DataFrame) -> DataFrame:
    """Distinct keys with any metric outside the reference range; no unpivot, one range row."""
    stats = ref.agg(F.struct(*[f(m).alias(f"{n}_{m}") for m in metrics for n, f in (("lo", F.min), ("hi", F.max))])
                    .alias("s")).scalar()
    outside = reduce(lambda a, b: a | b, [
        F.coalesce((F.col(m) < stats[f"lo_{m}"]) | (F.col(m) > stats[f"hi_{m}"]), F.lit(False)) for m in metrics])
    return df.where(outside).select(key).distinct()


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key occurs more than once."""
    return with_group_stats(df, keys, {"__copies": F.count(F.lit(1))}).where("__copies > 1").drop("__copies")


# ---- stacking and sets ---------------------------------------------------------------

def stack(frames: Sequence[DataFrame], strict: bool = False) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=not strict), frames)


def keys_union(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).union(b.select(key)).distinct()


def key_diff(a: DataFrame, b: DataFrame, key: str, tags: tuple[str, str] = ("a", "b")) -> DataFrame:
    """Keys only in one of two tables, tagged with the table that has them."""
    left, right = a.select(key).distinct(), b.select(key).distinct()
    return anti(left, right, [key]).withColumn("only_in", F.lit(tags[0])).unionByName(
        anti(right, left, [key]).withColumn("only_in", F.lit(tags[1])))


# ---- reshaping -----------------------------------------------------------------------

def pivot(df: DataFrame, ids: Sequence[str], name: str, levels: Sequence, vals: Mapping[str, Callable],
          fmt: str = "{level}_{val}", fill=None) -> DataFrame:
    """Long to wide over a stated level list: one map-side combined aggregate per cell."""
    cells = []
    for level in levels:
        for val, fn in vals.items():
            cell = fn(F.when(F.col(name) == F.lit(level), F.col(val)))
            cell = F.coalesce(cell, F.lit(fill)) if fill is not None else cell
            cells.append(cell.alias(fmt.format(level=level, val=val)))
    return df.groupBy(*ids).agg(*cells)


def split_headers(df: DataFrame, ids: Sequence[str], cols: Sequence[str], species: Callable[[Column], Column],
                  passes: Mapping[str, str], fn: Callable = F.sum) -> DataFrame:
    """Unpivot columns whose names hold (species, pass) and pivot again by pass.

    ``passes`` maps a header regex to the output column.
    """
    long = df.unpivot(list(ids), list(cols), "header", "fish").withColumn("species", species(F.col("header")))
    cells = [fn(F.when(F.col("header").rlike(rx), F.col("fish"))).alias(out) for rx, out in passes.items()]
    return long.groupBy(*ids, "species").agg(*cells)


def wide_by(df: DataFrame, ids: Sequence[str], dims: Sequence[str], levels: Sequence[tuple],
            vals: Mapping[str, Callable]) -> DataFrame:
    """One row per id, one column per (dims level x value)."""
    keyed = df.withColumn("__k", unite(*dims))
    names = ["_".join(str(p) for p in lv) for lv in levels]
    return pivot(keyed, ids, "__k", names, vals, "{level}_{val}")


def explode_seq(df: DataFrame, n: str, out: str) -> DataFrame:
    """Rows 1..n for each input row."""
    return df.where(F.col(n) >= 1).withColumn(out, F.explode(F.sequence(F.lit(1).cast("bigint"), F.col(n).cast("bigint"))))


def nest(df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk_rows: int = 10_000) -> DataFrame:
    """Collapse groups to list columns of at most ``chunk_rows`` rows each.

    A large group becomes several chunks, so no array grows with the data.
    """
    keys = list(keys)
    cols = [c for c in df.columns if c not in keys]
    numbered = row_numbers(df, order, "__rn", keys)
    return (
        numbered.withColumn("chunk", F.floor((F.col("__rn") - 1) / chunk_rows))
        .groupBy(*keys, "chunk").agg(F.collect_list(F.struct(*cols)).alias("data"))
    )


def unnest(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.select(*keys, F.inline("data"))
