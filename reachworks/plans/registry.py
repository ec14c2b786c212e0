"""Registered queries and the SQL each one is compared with."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reachworks.session import shared_folder, tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


class Tables:
    """Lazy access to the Parquet tables of one folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def scratch(self, name: str) -> str:
        """A fresh folder beside the cluster's checkpoints, readable by every executor."""
        return f"{shared_folder(self.spark)}/{name}-{uuid.uuid4().hex}"


def query(slug: str, sql: str | None = None):
    def add(fn: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            # Day counts between zoneless timestamps must not see daylight-saving shifts.
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(Tables(tune(spark), folder))

        QUERIES[slug] = run
        if sql is not None:
            ORACLE[slug] = sql
        return fn
    return add


def r4(name: str, out: str | None = None):
    return F.round(name, 4).alias(out or name)
