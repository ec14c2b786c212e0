"""Scans over hot groups give the same rows as plain windows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from reachworks.operators import joins as J
from reachworks.operators import ordered as O
from reachworks.operators import screening as C
from reachworks.operators.aggregates import cumulative_cut
from reachworks.operators.forest import weighted_quantile
from reachworks.operators.frames import nest, unnest


@pytest.fixture(scope="module")
def rows(spark):
    """One key holds most rows, some keys hold one, one key is NULL."""
    rng = random.Random(7)
    data = []
    for i in range(600):
        k = "hot" if i < 400 else (None if i < 420 else f"k{i % 40}")
        data.append((k, rng.randint(0, 60), i, rng.choice([None, rng.random()])))
    return spark.createDataFrame(data, "k string, o int, id int, v double")


def both(fn):
    plain = sorted(map(tuple, fn(None).collect()), key=repr)
    split = sorted(map(tuple, fn(1).collect()), key=repr)
    return plain, split


def same(a, b):
    assert len(a) == len(b)
    for x, y in zip(a, b):
        for p, q in zip(x, y):
            assert p == q or (isinstance(p, float) and p == pytest.approx(q))


@pytest.mark.parametrize("keys", [["k"], []])
@pytest.mark.parametrize("down", [False, True])
def test_running(rows, keys, down):
    outs = {"s": ("sum", F.col("o")), "m": ("max", F.when(F.col("id") % 5 == 0, F.struct("o", "id"))), "n": ("min", F.col("v"))}
    same(*both(lambda g: O.running(rows, keys, ["o", "id"], outs, descending=down, group_rows=g)))


def test_row_numbers_cover_the_table(rows):
    got = [r.row_num for r in O.row_numbers(rows, ["o", "id"], group_rows=1).orderBy("o", "id").collect()]
    assert got == list(range(1, 601))


@pytest.mark.parametrize("keys", [["k"], []])
def test_next_in_group(rows, keys):
    same(*both(lambda g: O.next_in_group(rows, keys, ["o", "id"], {"nid": "id", "no": "o"}, group_rows=g)))


@pytest.mark.parametrize("keys", [["k"], []])
def test_quantiles(rows, keys):
    ps = [0.0, 0.25, 0.5, 0.9, 1.0]
    a, b = both(lambda g: O.exact_quantiles(rows, keys, "v", ps, group_rows=g).select(*keys, *[F.col("q")[i] for i in range(5)]))
    same(a, b)
    if not keys:
        vals = [r.v for r in rows.where("v is not null").collect()]
        assert list(a[0]) == pytest.approx(list(np.quantile(vals, ps)))


def test_cumulative_cut(rows):
    w = rows.where("v is not null").withColumn("w", F.col("v") / 100)
    same(*both(lambda g: cumulative_cut(w, "w", 0.5, ["id"], group_rows=g)))


def test_weighted_quantile(rows):
    same(*both(lambda g: weighted_quantile(rows.where("k is not null"), ["k"], "o", "id", 0.7, group_rows=g)))


def test_nest_keeps_every_row_in_bounded_arrays(rows):
    n = nest(rows, ["k"], ["id"], chunk_rows=50)
    assert n.agg(F.max(F.size("data"))).first()[0] <= 50
    assert sorted(map(repr, map(tuple, unnest(n, ["k"]).select("k", "o", "id", "v").collect()))) == sorted(map(repr, map(tuple, rows.collect())))


def test_group_stats_salts_hot_keys(rows):
    aggs = {"s": F.sum("o"), "c": F.count(F.lit(1))}
    same(*both(lambda g: J.with_group_stats(rows, ["k"], aggs, hot_rows=50 if g else None)))


def test_nearest_join_against_pairs(spark):
    rng = random.Random(3)
    l = [("a" if i < 60 else "b", rng.randint(0, 300), i) for i in range(90)]
    r = [("a" if i < 40 else "c", rng.randint(0, 300), i) for i in range(60)]
    ld = spark.createDataFrame(l, "k string, lt int, lid int")
    rd = spark.createDataFrame(r, "k string, rt int, rid int")
    want = {}
    for k, t, i in l:
        near = sorted((abs(t2 - t), t2, j) for k2, t2, j in r if k2 == k)
        if near:
            want[i] = near[0][2]
    for g in (None, 1):
        got = {x.lid: x.rid for x in J.nearest_join(ld, rd, ["k"], "lt", "rt", "lid", "rid", group_rows=g).collect()}
        assert got == want


def test_band_count_against_pairs(spark, monkeypatch):
    rng = random.Random(5)
    s = [(i, i % 3, float(rng.randint(0, 2000))) for i in range(30)]
    e = [(i % 3, float(rng.randint(0, 2000)), i % 2) for i in range(300)]
    e += [(0, 500.0, 0)] * 5
    sd = spark.createDataFrame(s, "site int, route int, m double")
    ed = spark.createDataFrame(e, "route int, em double, yr int")
    want = {}
    for i, r, m in s:
        for r2, m2, y in e:
            if r == r2 and abs(m - m2) <= 250:
                want[i, y] = want.get((i, y), 0) + 1
    for limit in (2_000_000, 1):
        monkeypatch.setattr(O, "GROUP_ROWS", limit)
        got = {(x.site, x.yr): x.n for x in J.band_count(sd, ed, ["route"], "site", "m", "em", 250.0, ["yr"], "n").collect()}
        assert got == want


def _tau_b(x, y):
    s = n1 = n2 = 0
    for i in range(len(x)):
        for j in range(i):
            a, b = np.sign(x[i] - x[j]), np.sign(y[i] - y[j])
            s += a * b
            n1 += a * a
            n2 += b * b
    return s / np.sqrt(n1 * n2)


@pytest.mark.parametrize("limit", [2_000_000, 1])
def test_kendall_with_ties(spark, monkeypatch, limit):
    rng = np.random.default_rng(2)
    x = rng.integers(0, 13, 150)
    y = x // 2 + rng.integers(0, 7, 150)
    monkeypatch.setattr(O, "GROUP_ROWS", limit)
    df = spark.createDataFrame(list(zip(map(int, x), map(int, y))), "x int, y int")
    assert C.corr_long(df, ["x", "y"], "kendall").first().r == pytest.approx(_tau_b(x, y))
