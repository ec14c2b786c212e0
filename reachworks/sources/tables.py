"""Readers, writers and named snapshots."""

from __future__ import annotations

import os
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from reachworks.operators.ordered import next_in_group


def read_table(spark: SparkSession, path: str, fmt: str = "parquet", schema: StructType | str | None = None,
               table: str | None = None, **options: str) -> DataFrame:
    """Scan Parquet, ORC, CSV (header, ``NA`` is NULL) or a JDBC table; filters reach the source."""
    reader = spark.read.options(**options)
    if fmt == "jdbc":
        return reader.format("jdbc").option("url", path).option("dbtable", table).load()
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True).option("nullValue", "NA")
        return reader.csv(path) if schema is not None else reader.option("inferSchema", True).csv(path)
    return reader.format(fmt).load(path)


def read_many(sources: Mapping[str, DataFrame], id_col: str) -> DataFrame:
    """Stack inputs with differing columns, tagging each row with its source."""
    parts = [df.withColumn(id_col, F.lit(tag)) for tag, df in sources.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = (),
                mode: str = "overwrite") -> None:
    """Write a result; ``partition_by`` gives one folder per value.

    Rows of one folder are brought together in parts of an advised size, so folders hold few files and a
    hot value is still written by many tasks.
    """
    if partition_by:
        df = df.hint("rebalance", *partition_by)
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer.option("header", True).option("nullValue", "NA").csv(path)
    else:
        writer.format(fmt).save(path)


def save_table(df: DataFrame, folder: str, name: str, mode: str = "overwrite") -> None:
    write_table(df, os.path.join(folder, name), mode=mode)


def load_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(folder, name))


def lines_to_segments(df: DataFrame, id_col: str, pts: str) -> DataFrame:
    """One row per straight segment from an ARRAY<STRUCT<x, y>> line column (extra ordinates dropped)."""
    p = F.col(pts)
    seg = F.transform(F.sequence(F.lit(1), F.size(p) - 1), lambda i: F.struct(
        i.alias("seg_no"),
        F.element_at(p, i)["x"].alias("x1"), F.element_at(p, i)["y"].alias("y1"),
        F.element_at(p, i + 1)["x"].alias("x2"), F.element_at(p, i + 1)["y"].alias("y2")))
    keep = [c for c in df.columns if c != pts]
    return df.where(F.size(p) > 1).select(*keep, F.inline(seg))


def vertices_to_segments(df: DataFrame, keys: Sequence[str], seq: str, x: str, y: str) -> DataFrame:
    """The same table from one row per vertex, for lines too long to hold in one array."""
    nxt = next_in_group(df.select(*keys, seq, x, y), keys, [seq], {"x2": x, "y2": y})
    return nxt.where("x2 is not null").select(
        *keys, F.col(seq).alias("seg_no"), F.col(x).alias("x1"), F.col(y).alias("y1"), "x2", "y2")
