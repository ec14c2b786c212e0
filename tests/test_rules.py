"""Missing-value and ordering rules on small literal frames."""

from pyspark.sql import functions as F

from reachworks.functions import scalars as S
from reachworks.operators import aggregates as A
from reachworks.operators import frames as R
from reachworks.operators import joins as J
from reachworks.operators.estimators import flag_valid


def one(df):
    return df.first()[0]


def test_natural_join_uses_shared_names_and_null_matches_null(spark):
    a = spark.createDataFrame([(1, None, "x"), (2, "s", "y")], "k int, season string, v string")
    b = spark.createDataFrame([(1, None, 10.0), (3, "s", 20.0)], "k int, season string, w double")
    assert J.natural_join(a, b).count() == 1
    assert J.natural_join(a, b, "left").count() == 2
    full = J.natural_join(a, b, "full")
    assert sorted(full.columns) == ["k", "season", "v", "w"] and full.count() == 3
    assert J.anti(a, b, ["k", "season"]).first().k == 2


def test_if_else_is_three_valued(spark):
    d = spark.createDataFrame([(1,), (5,), (None,)], "x int")
    got = [r[0] for r in d.select(S.if_else(F.col("x") > 3, F.lit("hi"), F.lit("lo"))).collect()]
    assert got == ["lo", "hi", None]


def test_classify_blanks_unknown(spark):
    d = spark.createDataFrame([(1,), (None,)], "x int")
    assert [r[0] for r in d.select(S.classify([(F.col("x") > 3, "hi")], "lo")).collect()] == ["lo", None]


def test_membership_is_never_null(spark):
    d = spark.createDataFrame([("a",), (None,)], "x string")
    assert [r[0] for r in d.select(S.is_in("x", ["a"])).collect()] == [True, False]


def test_empty_sums_and_distinct_nulls(spark):
    d = spark.createDataFrame([(None, "a"), (None, None)], "x double, g string")
    assert one(d.agg(A.sum0("x"))) == 0.0
    assert one(d.agg(F.avg("x"))) is None
    assert one(d.agg(A.n_distinct("g"))) == 2
    assert one(d.agg(A.n_distinct("g", count_null=False))) == 1


def test_division_by_zero_is_null(spark):
    d = spark.createDataFrame([(1.0, 0.0)], "n double, l double")
    assert one(d.select(S.density("n", "l"))) is None


def test_paste_shows_na(spark):
    d = spark.createDataFrame([("a", None)], "x string, y string")
    assert one(d.select(S.unite("x", "y"))) == "a_NA"


def test_rounding_half_to_even(spark):
    d = spark.createDataFrame([(50.0, 100.0), (2.5, 100.0), (None, 50.0)], "n double, pct double")
    assert [r[0] for r in d.select(S.expand_by_fraction("n", "pct")).collect()] == [50.0, 2.0, 0.0]


def test_keep_max_keeps_ties_and_second_rule(spark):
    d = spark.createDataFrame([("a", 3, 1), ("a", 3, 2), ("a", 1, 9), ("b", None, 1)], "k string, n int, yr int")
    assert A.keep_max(d, ["k"], ["n"]).count() == 2
    assert [r.yr for r in A.keep_max(d, ["k"], ["n", "yr"]).collect()] == [2]


def test_day_gap_truncates_toward_zero(spark):
    d = spark.sql("select timestamp'2020-01-02 12:00:00' a, timestamp'2020-01-01 00:00:00' b")
    assert d.select(J.day_gap(F.col("a"), F.col("b")), J.day_gap(F.col("b"), F.col("a"))).first()[:] == (1, -1)


def test_safe_cast_and_split(spark):
    d = spark.createDataFrame([("abc",)], "x string")
    assert d.select(F.col("x").try_cast("double"), F.split_part("x", F.lit("-"), F.lit(2))).first()[:] == (None, "")


def test_upsert_conforms_and_replaces(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([("z", 2, 9.0)], "v string, k int, extra double")
    assert sorted(map(tuple, J.upsert(base, new, ["k"]).collect())) == [(1, "a"), (2, "z")]


def test_stack_strict_and_loose(spark):
    a = spark.createDataFrame([(1,)], "x int")
    b = spark.createDataFrame([(1, 2)], "x int, y int")
    assert R.stack([a, b]).columns == ["x", "y"]
    try:
        R.stack([a, b], strict=True).collect()
        raise AssertionError("strict stacking accepted different columns")
    except Exception as e:  # noqa: BLE001
        assert "AssertionError" not in type(e).__name__


def test_exempt_rows_and_unknown_predicates(spark):
    d = spark.createDataFrame([("A", 1, 0.0), ("B", 1, 0.0), ("B", 2, 0.0), ("B", 3, 2.0), ("B", 4, None)], "sp string, site int, dens double")
    dom = spark.createDataFrame([(1,)], "site int")
    kept = R.clip_to_domain(d, dom, "site", F.col("sp") == "A", F.col("dens") > 0)
    assert sorted((r.sp, r.site) for r in kept.collect()) == [("A", 1), ("B", 1), ("B", 3)]


def test_validity_rule(spark):
    d = spark.createDataFrame([
        ("Mark Recapture", 10.0, 10.0, 2.0, 20.0, "Chapman"), ("Mark Recapture", 4.0, 4.0, 1.0, 20.0, "Chapman"), ("Mark Recapture", 9.0, 9.0, 7.0, 999.0, None),
        ("Mark Recapture", None, 4.0, 1.0, 20.0, None), ("Depletion", 1.0, 1.0, None, 1.0, None), ("Single Pass", 1.0, None, None, None, None),
        ("Single Pass", 1.0, None, None, 5.0, "Prev. Calc.")], "Method string, pass1 double, pass2 double, pass3 double, N double, Nmethod string")
    assert [r.Valid for r in flag_valid(d).collect()] == [True, False, True, False, True, False, True]


def test_tolerance_blanks_far_values(spark):
    l = spark.sql("select 1 k, timestamp'2020-01-10' t union all select 2, timestamp'2020-01-10'")
    r = spark.sql("select 1 k, timestamp'2020-01-04' u, 5.0D v union all select 2, timestamp'2020-01-01', 6.0D")
    assert {x.k: x.v for x in J.tolerance_join(l, r, ["k"], "t", "u", "v", 7).collect()} == {1: 5.0, 2: None}


def test_total_row_sorts_last(spark):
    d = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "k string, x double")
    rows = A.with_total(d, "k", {"s": F.sum("x")}).orderBy("is_total", "k").collect()
    assert [(r.k, r.s) for r in rows] == [("a", 1.0), ("b", 2.0), ("Total", 3.0)]


def test_crosstab_shares(spark):
    d = spark.createDataFrame([("a", "x"), ("a", "x"), ("a", "y"), ("b", "x")], "g string, h string")
    rows = {(r.g, r.h): (r.n, r.share) for r in A.crosstab(d, "g", "h", pct="row").collect()}
    assert rows["a", "x"] == (2, 2 / 3) and rows["b", "x"] == (1, 1.0) and len(rows) == 3
    totals = {(r.g, r.h): r.n for r in A.crosstab(d, "g", "h").collect()}
    assert totals["Total", "Total"] == 4 and totals["Total", "x"] == 3 and totals["a", "Total"] == 3
    assert A.crosstab(d, "g", "h", margins=False).count() == 3


def test_pick_first_keeps_provenance(spark):
    d = spark.createDataFrame([(1.0, 2.0, 0.1, 3.0, 0.2), (None, 2.0, 0.1, 3.0, 0.2), (None, None, None, 3.0, 0.2), (None,) * 5],
                              "q double, a double, sa double, b double, sb double")
    got = [(r.model, r.response, r.SE) for r in J.pick_first(d, [("direct", "q", None), ("near", "a", "sa"), ("far", "b", "sb")]).collect()]
    assert got == [("direct", 1.0, 0.0), ("near", 2.0, 0.1), ("far", 3.0, 0.2), (None, None, None)]


def test_constant_attributes_and_conflicts(spark):
    d = spark.createDataFrame([(1, 2.0, "x", None), (1, 4.0, None, "p"), (2, 5.0, "x", "p"), (2, 7.0, "y", "p")], "s int, m double, a string, b string")
    got = {r.s: (r.m, r.a, r.b, r.conflicts) for r in A.site_average(d, ["s"], {"m": "m"}, ["a", "b"]).collect()}
    assert got == {1: (3.0, "x", "p", 0), 2: (6.0, None, "p", 1)}


def test_dedupe_policies(spark):
    rows = [("k", "A", 3.0, 1, 1), ("k", "A", 3.0, 2, 2), ("k", "A", 1.0, 3, 3), ("k", "B", 3.0, 1, 4), ("k", "B", 3.0, 2, 5), ("k", "C", 1.0, 1, 6), ("k", "C", 2.0, 1, 7), ("k", None, 2.0, 1, 8)]
    d = spark.createDataFrame(rows, "key string, crew string, n double, ts int, id int")
    got = A.dedupe(d, ["key"], "crew", {"A": "highest", "B": "highest_latest"}, "n", "ts", "id")
    assert sorted(r.id for r in got.collect()) == [1, 5, 6, 7, 8]


def test_levels_are_not_capped(spark):
    from reachworks.operators.survey import levels
    assert levels(spark.createDataFrame([("b",), ("a",), (None,)], "x string"), "x") == ["a", "b"]
    assert levels(spark.range(500), "id") == list(range(500))


def test_fill_in_source_order(spark):
    base = spark.createDataFrame([(1, 9.0), (2, None), (3, None)], "k int, v double")
    a = spark.createDataFrame([(2, 5.0)], "k int, w double")
    b = spark.createDataFrame([(2, 7.0), (3, 8.0)], "k int, z double")
    assert {r.k: r.v for r in J.fill_from(base, "v", [(a, ["k"], "w"), (b, ["k"], "z")]).collect()} == {1: 9.0, 2: 5.0, 3: 8.0}


def test_unknown_variance_has_no_error(spark):
    from reachworks.operators.survey import root
    rows = spark.createDataFrame([(1, None), (2, -1e-18), (3, 4.0)], "id int, v double").select("id", root("v").alias("se")).collect()
    assert dict(map(tuple, rows)) == {1: None, 2: 0.0, 3: 2.0}
