"""Registered text queries beside their SQL."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import oracle  # noqa: E402

from reachworks.llm import queries  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"create view {table} as select * from '{FOLDER}/{table}.parquet'")
    assert oracle.compare(spark, con, FOLDER, queries.QUERIES[name], queries.ORACLE[name]) is None
