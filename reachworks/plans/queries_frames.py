"""Sources, projections, filters, sets, reshaping and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from reachworks.functions import scalars as S
from reachworks.operators import aggregates as A
from reachworks.operators import frames as R
from reachworks.operators import joins as J
from reachworks.plans import views as V
from reachworks.plans.registry import query, r4
from reachworks.sources import tables as IO


# ---- sources and sinks ---------------------------------------------------------------

@query("read_csv", """
SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS c_acctbal FROM customer""")
def _(t):
    path = t.scratch("csv")
    IO.write_table(t.customer.select("c_custkey", "c_name", "c_nationkey",
                                     F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("c_acctbal")), path, "csv")
    return IO.read_table(t.spark, path, "csv", "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double")


@query("multi_source_union", """
SELECT 'customer' AS source, c_custkey AS id, c_acctbal AS balance, c_mktsegment AS segment FROM customer
UNION ALL SELECT 'supplier', s_suppkey, s_acctbal, NULL FROM supplier""")
def _(t):
    c = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    s = t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"))
    return IO.read_many({"customer": c, "supplier": s}, "source")


@query("jdbc_scan", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000")
def _(t):
    return IO.read_table(t.spark, f"{t.folder}/orders.parquet").where(
        "o_orderstatus = 'F' and o_totalprice > 100000").select("o_orderkey", "o_custkey", "o_totalprice")


@query("snapshot_table", """
SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 4) AS total FROM orders GROUP BY 1""")
def _(t):
    folder = t.scratch("snap")
    IO.save_table(t.orders.groupBy("o_custkey").agg(A.n_rows().alias("n"), F.round(F.sum("o_totalprice"), 4).alias("total")),
                  folder, "visits")
    return IO.load_table(t.spark, folder, "visits")


@query("write_csv", """
SELECT o_orderpriority, o_orderstatus, count(*) AS n, round(avg(o_totalprice), 4) AS mean_price FROM orders GROUP BY 1, 2""")
def _(t):
    path = t.scratch("out")
    IO.write_table(t.orders.groupBy("o_orderpriority", "o_orderstatus").agg(
        A.n_rows().alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean_price")), path, "csv")
    return IO.read_table(t.spark, path, "csv", "o_orderpriority string, o_orderstatus string, n bigint, mean_price double")


@query("partitioned_append", f"""WITH {V.REACHES_SQL}
SELECT watershed, count(*) AS n, round(sum(length), 4) AS length, round(sum(cap), 4) AS cap FROM reaches GROUP BY 1""")
def _(t):
    path = t.scratch("parts")
    rows = V.reaches(t).select("reach_id", "length", "cap", "watershed")
    for chunk in (0, 1):
        IO.write_table(rows.where(F.pmod(F.xxhash64("reach_id"), F.lit(2)) == chunk), path, partition_by=["watershed"], mode="append")
    return t.spark.read.parquet(path).groupBy("watershed").agg(
        A.n_rows().alias("n"), F.round(F.sum("length"), 4).alias("length"), F.round(F.sum("cap"), 4).alias("cap"))


@query("geometry_table", """
WITH v AS (SELECT c_custkey AS line_id, c_acctbal AS x, CAST(c_custkey * 37 % 10000 AS DOUBLE) AS y FROM customer),
p AS (SELECT line_id, 1 AS i, x, y FROM v UNION ALL SELECT line_id, 2, x + 120.5, y + 30 FROM v
      UNION ALL SELECT line_id, 3, x + 200, y - 45.25 FROM v)
SELECT a.line_id, a.i AS seg_no, round(a.x, 4) AS x1, round(a.y, 4) AS y1, round(b.x, 4) AS x2, round(b.y, 4) AS y2
FROM p a JOIN p b ON a.line_id = b.line_id AND b.i = a.i + 1""")
def _(t):
    x, y = F.col("x"), F.col("y")
    pt = lambda a, b: F.struct(a.alias("x"), b.alias("y"), F.lit(0.0).alias("z"))
    lines = V.points(t).select(F.col("point_id").alias("line_id"), F.array(
        pt(x, y), pt(x + 120.5, y + 30), pt(x + 200, y - 45.25)).alias("pts"))
    s = IO.lines_to_segments(lines, "line_id", "pts")
    return s.select("line_id", "seg_no", *[r4(c) for c in ("x1", "y1", "x2", "y2")])


# ---- projections ---------------------------------------------------------------------

@query("select_by_rule", "SELECT l_orderkey, l_quantity, l_extendedprice, l_discount, l_returnflag, l_linestatus, l_partkey FROM lineitem")
def _(t):
    return R.select_cols(t.lineitem, ["l_orderkey", "l_partkey", "l_quantity:l_tax", ".*(flag|status)$", "absent"],
                         exclude=["l_tax"], last=["l_partkey"])


@query("rename", "SELECT p_partkey AS partkey, p_name AS name, p_brand AS brand, p_type AS type, p_size AS size, p_retailprice AS retailprice FROM part")
def _(t):
    return R.rename_cols(t.part, lambda c: c.removeprefix("p_"))


@query("derive", """
SELECT l_orderkey, l_linenumber, round(l_extendedprice / l_quantity, 8) AS unit_price,
  round(l_extendedprice / l_quantity * (1 - l_discount), 10) AS net FROM lineitem""")
def _(t):
    d = t.lineitem.withColumn("unit_price", F.col("l_extendedprice") / F.col("l_quantity")).withColumn(
        "net", F.col("unit_price") * (1 - F.col("l_discount")))
    return d.select("l_orderkey", "l_linenumber", F.round("unit_price", 8).alias("unit_price"), F.round("net", 10).alias("net"))


@query("derive_many", """
SELECT l_orderkey, l_linenumber, round(100 - l_discount * 100, 4) AS l_discount_pct, round(100 - l_tax * 100, 4) AS l_tax_pct FROM lineitem""")
def _(t):
    d = R.map_cols(t.lineitem, ["l_discount", "l_tax"], lambda c: F.round(100 - c * 100, 4), "{}_pct")
    return d.select("l_orderkey", "l_linenumber", "l_discount_pct", "l_tax_pct")


@query("recode", """
SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'urgent' WHEN '4-NOT SPECIFIED' THEN 'none' ELSE o_orderpriority END AS priority FROM orders""")
def _(t):
    return t.orders.select("o_orderkey", S.recode("o_orderpriority", {"1-URGENT": "urgent", "4-NOT SPECIFIED": "none"}).alias("priority"))


@query("case_chain", """
WITH d AS (SELECT p_partkey, p_name, CASE WHEN p_partkey % 7 <> 0 THEN p_size END AS size FROM part)
SELECT p_partkey, CASE WHEN size IS NULL THEN NULL WHEN size > 40 THEN 'large' WHEN size > 20 THEN 'medium' ELSE 'small' END AS size_class,
  CASE WHEN regexp_matches(p_name, 'widget$') THEN 'widget' WHEN regexp_matches(p_name, '^(cold|red)') THEN 'tinted' ELSE 'other' END AS kind FROM d""")
def _(t):
    d = t.part.withColumn("size", F.when(F.col("p_partkey") % 7 != 0, F.col("p_size")))
    return d.select(
        "p_partkey", S.classify([(F.col("size") > 40, "large"), (F.col("size") > 20, "medium")], "small").alias("size_class"),
        S.classify([(F.col("p_name").rlike("widget$"), "widget"), (F.col("p_name").rlike("^(cold|red)"), "tinted")], "other").alias("kind"))


@query("sentinel_to_null", """
SELECT l_orderkey, l_linenumber, nullif(l_discount, 0) AS discount, CASE WHEN l_quantity <= 45 THEN l_quantity END AS quantity,
  nullif(l_returnflag, 'N') AS flag FROM lineitem""")
def _(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", S.null_if("l_discount", F.col("l_discount") == 0).alias("discount"),
                             S.null_if("l_quantity", F.col("l_quantity") > 45).alias("quantity"),
                             F.nullif("l_returnflag", F.lit("N")).alias("flag"))


@query("coalesce_fill", """
SELECT c_custkey, coalesce(CASE WHEN c_custkey % 3 = 0 THEN c_acctbal END, o.total, s.bal) AS value FROM customer
LEFT JOIN (SELECT o_custkey, round(max(o_totalprice), 4) AS total FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) o ON o_custkey = c_custkey
LEFT JOIN (SELECT s_nationkey, max(s_acctbal) AS bal FROM supplier GROUP BY 1) s ON s_nationkey = c_nationkey""")
def _(t):
    base = t.customer.select("c_custkey", "c_nationkey", F.when(F.col("c_custkey") % 3 == 0, F.col("c_acctbal")).alias("value"))
    o = t.orders.where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.round(F.max("o_totalprice"), 4).alias("total"))
    s = t.supplier.groupBy(F.col("s_nationkey").alias("c_nationkey")).agg(F.max("s_acctbal").alias("bal"))
    return J.fill_from(base, "value", [(o, ["c_custkey"], "total"), (s, ["c_nationkey"], "bal")]).select("c_custkey", "value")


@query("composite_key", """
SELECT o_orderkey, coalesce(CAST(o_custkey AS VARCHAR), 'NA') || '_' || coalesce(nullif(o_orderstatus, 'P'), 'NA') || '_' || CAST(year(o_orderdate) AS VARCHAR) AS key FROM orders""")
def _(t):
    return t.orders.select("o_orderkey", S.unite("o_custkey", F.nullif("o_orderstatus", F.lit("P")), F.year("o_orderdate")).alias("key"))


@query("row_id", "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS row_num FROM orders")
def _(t):
    return R.with_row_id(t.orders.select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"]).select("o_orderkey", "row_num")


@query("null_profile_row", f"""WITH {V.PARTS_SQL}
SELECT p_partkey, CAST((size IS NULL)::INT + (price IS NULL)::INT AS BIGINT) AS n_na FROM parts""")
def _(t):
    return V.part_covariates(t).select("p_partkey", S.count_nulls(["size", "price"]).cast("bigint").alias("n_na"))


@query("normalise_by_length", """
SELECT l_orderkey, l_linenumber, round(l_extendedprice / l_quantity * 100, 4) AS price_100m, round(100 - 100 * l_discount, 4) AS retained,
  round(l_tax / nullif(l_discount, 0) * 100, 4) AS tax_100m FROM lineitem""")
def _(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", F.round(S.per_100m("l_extendedprice", "l_quantity"), 4).alias("price_100m"),
                             F.round(100 - 100 * F.col("l_discount"), 4).alias("retained"),
                             F.round(S.per_100m("l_tax", "l_discount"), 4).alias("tax_100m"))


@query("density_convert", """
SELECT l_orderkey, l_linenumber, round(l_quantity / nullif(p_size - 1, 0), 4) AS per_m,
  round(l_quantity / nullif(p_size - 1, 0) * (p_size - 1) / nullif(p_retailprice, 0), 6) AS per_m2
FROM lineitem JOIN part ON l_partkey = p_partkey""")
def _(t):
    d = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).withColumn("len", (F.col("p_size") - 1).cast("double"))
    d = d.withColumn("per_m", S.density("l_quantity", "len"))
    return d.select("l_orderkey", "l_linenumber", F.round("per_m", 4).alias("per_m"), F.round(S.per_m2("per_m", "len", "p_retailprice"), 6).alias("per_m2"))


@query("explicit_missing", """
SELECT l_orderkey, l_linenumber, coalesce(nullif(l_returnflag, 'R'), '(Missing)') AS flag,
  CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END AS sort_last FROM lineitem""")
def _(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", S.explicit_missing(F.nullif("l_returnflag", F.lit("R"))).alias("flag"),
                             S.last_rank("l_returnflag", "A").alias("sort_last"))


@query("add_constant_cols", "SELECT s_suppkey, s_acctbal, CAST(NULL AS DOUBLE) AS se, CAST(NULL AS VARCHAR) AS method FROM supplier")
def _(t):
    schema = T.StructType([T.StructField("s_suppkey", T.LongType()), T.StructField("s_acctbal", T.DoubleType()),
                           T.StructField("se", T.DoubleType()), T.StructField("method", T.StringType())])
    return R.conform(t.supplier, schema)


# ---- filters -------------------------------------------------------------------------

@query("predicate_filter", """
SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem
WHERE NOT (l_returnflag = 'A' AND l_linestatus = 'F') AND l_quantity BETWEEN 10 AND 30 AND l_linenumber IN (1, 3, 5) AND nullif(l_tax, 0) IS NOT NULL""")
def _(t):
    return t.lineitem.where(
        ~((F.col("l_returnflag") == "A") & (F.col("l_linestatus") == "F")) & F.col("l_quantity").between(10, 30)
        & S.is_in("l_linenumber", [1, 3, 5]) & F.nullif("l_tax", F.lit(0.0)).isNotNull()).select("l_orderkey", "l_linenumber", "l_quantity")


@query("regex_filter", "SELECT p_partkey, p_name, p_brand FROM part WHERE regexp_matches(p_name, '(?i)^(RED|cold)') AND regexp_matches(p_brand, '#1[0-9]$')")
def _(t):
    return R.filter_like(R.filter_like(t.part, "p_name", "^(RED|cold)", ignore_case=True), "p_brand", "#1[0-9]$").select("p_partkey", "p_name", "p_brand")


@query("domain_clip", """
SELECT l_orderkey, l_linenumber, l_returnflag, l_quantity FROM lineitem
WHERE l_returnflag = 'A' OR l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 25) OR l_quantity > 48""")
def _(t):
    dom = t.part.where("p_size > 25").select(F.col("p_partkey").alias("l_partkey"))
    return R.clip_to_domain(t.lineitem, dom, "l_partkey", F.col("l_returnflag") == "A", F.col("l_quantity") > 48).select(
        "l_orderkey", "l_linenumber", "l_returnflag", "l_quantity")


@query("drop_missing", f"WITH {V.PARTS_SQL} SELECT p_partkey, size, round(price, 4) AS price FROM parts WHERE size IS NOT NULL AND price IS NOT NULL")
def _(t):
    return V.part_covariates(t).na.drop(subset=["size", "price"]).select("p_partkey", "size", r4("price"))


@query("max_missing_filter", """
WITH d AS (SELECT l_orderkey, l_linenumber, nullif(l_discount, 0) AS a, nullif(l_tax, 0) AS b, CASE WHEN l_quantity > 10 THEN l_quantity END AS c FROM lineitem)
SELECT * FROM d WHERE (a IS NULL)::INT + (b IS NULL)::INT + (c IS NULL)::INT <= 1""")
def _(t):
    d = t.lineitem.select("l_orderkey", "l_linenumber", F.nullif("l_discount", F.lit(0.0)).alias("a"), F.nullif("l_tax", F.lit(0.0)).alias("b"),
                          F.when(F.col("l_quantity") > 10, F.col("l_quantity")).alias("c"))
    return R.filter_max_missing(d, ["a", "b", "c"], 1)


@query("out_of_range_keys", """
WITH r AS (SELECT min(l_quantity) AS q0, max(l_quantity) AS q1, min(l_extendedprice) AS p0, max(l_extendedprice) AS p1 FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'O' AND l_tax = 0.01)
SELECT DISTINCT l_orderkey FROM lineitem, r WHERE l_quantity < q0 OR l_quantity > q1 OR l_extendedprice < p0 OR l_extendedprice > p1""")
def _(t):
    ref = t.lineitem.where("l_returnflag = 'R' and l_linestatus = 'O' and l_tax = 0.01")
    return R.out_of_range(t.lineitem, "l_orderkey", ["l_quantity", "l_extendedprice"], ref)


@query("duplicate_rows", """
SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem
QUALIFY count(*) OVER (PARTITION BY l_orderkey, l_linenumber) > 1""")
def _(t):
    return R.duplicates(t.lineitem, ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")


_PROFILE_SQL = """m AS (
  SELECT 'disc' AS metric, nullif(l_discount, 0) AS v FROM lineitem UNION ALL SELECT 'taxArea', l_tax FROM lineitem
  UNION ALL SELECT 'qty', l_quantity FROM lineitem UNION ALL SELECT 'rare', CASE WHEN l_quantity > 40 THEN l_quantity END FROM lineitem),
prof AS (SELECT metric, round(var_samp(v), 4) AS "var", round(stddev_samp(v) / abs(avg(v)), 4) AS cv, count(v) AS non_na,
  count(*) - count(v) AS is_na, round((count(*) - count(v)) / count(*), 3) AS perc_na, count(CASE WHEN v <> 0 THEN 1 END) AS non_0,
  round(count(CASE WHEN v <> 0 THEN 1 END) / count(*), 4) AS perc_non0 FROM m GROUP BY 1)"""


def _metrics(t):
    return t.lineitem.select(F.nullif("l_discount", F.lit(0.0)).alias("disc"), F.col("l_tax").alias("taxArea"),
                             F.col("l_quantity").alias("qty"), F.when(F.col("l_quantity") > 40, F.col("l_quantity")).alias("rare"))


def _prof(t):
    p = A.profile(_metrics(t), ["disc", "taxArea", "qty", "rare"])
    return p.withColumns({c: F.round(c, 4) for c in ("var", "cv", "perc_non0")})


@query("quality_screen", f"WITH {_PROFILE_SQL} SELECT metric, perc_na, non_0 FROM prof WHERE perc_na < 0.5 AND non_0 > 100 AND NOT regexp_matches(metric, '(Area|Vol)$')")
def _(t):
    return A.screen_metrics(_prof(t)).select("metric", "perc_na", "non_0")


@query("metric_profile", f"WITH {_PROFILE_SQL} SELECT * FROM prof")
def _(t):
    return _prof(t)


# ---- sets and reshaping --------------------------------------------------------------

@query("union_by_name", """
SELECT c_custkey AS id, c_acctbal AS balance, c_mktsegment AS segment, NULL AS supplier_name FROM customer
UNION ALL SELECT s_suppkey, s_acctbal, NULL, s_name FROM supplier""")
def _(t):
    return R.stack([
        t.customer.select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment")),
        t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"), F.col("s_name").alias("supplier_name"))])


@query("union_strict", "SELECT c_custkey AS id, c_acctbal AS balance FROM customer UNION ALL SELECT s_suppkey, s_acctbal FROM supplier")
def _(t):
    return R.stack([t.customer.select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance")),
                    t.supplier.select(F.col("s_acctbal").alias("balance"), F.col("s_suppkey").alias("id"))], strict=True)


@query("distinct", "SELECT DISTINCT l_returnflag, l_linestatus, l_tax FROM lineitem")
def _(t):
    return t.lineitem.select("l_returnflag", "l_linestatus", "l_tax").distinct()


@query("key_union", "SELECT c_nationkey AS nation FROM customer WHERE c_acctbal < -900 UNION SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
def _(t):
    return R.keys_union(t.customer.where("c_acctbal < -900").withColumnRenamed("c_nationkey", "nation"),
                        t.supplier.where("s_acctbal > 5000").withColumnRenamed("s_nationkey", "nation"), "nation")


@query("key_difference", """
SELECT k, 'customer' AS only_in FROM (SELECT c_custkey AS k FROM customer WHERE c_acctbal > 0 EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')
UNION ALL SELECT k, 'orders' FROM (SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT c_custkey FROM customer WHERE c_acctbal > 0)""")
def _(t):
    a = t.customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("k"))
    b = t.orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k"))
    return R.key_diff(a, b, "k", ("customer", "orders"))


@query("unpivot", """
SELECT l_orderkey, l_linenumber, 'l_discount' AS metric, l_discount AS value FROM lineitem
UNION ALL SELECT l_orderkey, l_linenumber, 'l_tax', l_tax FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, 'l_quantity', l_quantity FROM lineitem""")
def _(t):
    return t.lineitem.unpivot(["l_orderkey", "l_linenumber"], ["l_discount", "l_tax", "l_quantity"], "metric", "value")


@query("pivot", """
SELECT l_partkey, coalesce(sum(l_quantity) FILTER (WHERE l_linestatus = 'F'), 0) AS F_l_quantity, coalesce(round(max(l_extendedprice) FILTER (WHERE l_linestatus = 'F'), 4), 0) AS F_l_extendedprice,
  coalesce(sum(l_quantity) FILTER (WHERE l_linestatus = 'O'), 0) AS O_l_quantity, coalesce(round(max(l_extendedprice) FILTER (WHERE l_linestatus = 'O'), 4), 0) AS O_l_extendedprice
FROM lineitem GROUP BY 1""")
def _(t):
    return R.pivot(t.lineitem, ["l_partkey"], "l_linestatus", ["F", "O"],
                   {"l_quantity": F.sum, "l_extendedprice": lambda c: F.round(F.max(c), 4)}, fill=0.0)


_FLAGS = {"A": "Chinook", "N": "Sthd", "R": "Coho"}
_PASSES = {"M": "pass1", "C": "pass2", "R": "pass3", "S": "pass4", "T": "pass5", "U": "pass6", "V": "pass7"}


@query("compound_header_split", f"""
WITH w AS (SELECT l_partkey, CASE l_returnflag {' '.join(f"WHEN '{f}' THEN '{s}'" for f, s in _FLAGS.items())} END AS species, l_linenumber AS pass, sum(l_quantity) AS fish
  FROM lineitem GROUP BY 1, 2, 3),
k AS (SELECT p.l_partkey, s.species FROM (SELECT DISTINCT l_partkey FROM lineitem) p, (VALUES {', '.join(f"('{s}')" for s in _FLAGS.values())}) s(species))
SELECT k.l_partkey, k.species, {', '.join(f"sum(fish) FILTER (WHERE pass = {i}) AS {p}" for i, p in enumerate(_PASSES.values(), 1))}
FROM k LEFT JOIN w ON w.l_partkey = k.l_partkey AND w.species = k.species GROUP BY 1, 2""")
def _(t):
    cells = {f"{sp} {p}": F.sum(F.when((F.col("l_returnflag") == flag) & (F.col("l_linenumber") == i), F.col("l_quantity")))
             for flag, sp in _FLAGS.items() for i, p in enumerate(_PASSES, 1)}
    wide = t.lineitem.groupBy("l_partkey").agg(*[c.alias(n) for n, c in cells.items()])
    return R.split_headers(wide, ["l_partkey"], list(cells), lambda h: F.split_part(h, F.lit(" "), F.lit(1)),
                           {f"{p}$": name for p, name in _PASSES.items()})


_STAGES = [(a, b) for a in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW") for b in "FOP"]


@query("wide_summary_by_lifestage", f"""WITH {V.REACHES_SQL}
SELECT stream, {', '.join(f"round(sum(length * cap) FILTER (WHERE lifestage = '{a}' AND species = '{b}'), 4) AS \"{a}_{b}_tot\"" for a, b in _STAGES)} FROM reaches GROUP BY 1""")
def _(t):
    d = V.reaches(t).withColumn("tot", F.col("length") * F.col("cap"))
    return R.wide_by(d, ["stream"], ["lifestage", "species"], _STAGES,
                     {"tot": lambda c: F.round(F.sum(c), 4)})


@query("explode_sequence", """
WITH s AS (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1)
SELECT c_nationkey, n, unnest(generate_series(1, n)) AS spawners FROM s""")
def _(t):
    return R.explode_seq(t.customer.groupBy("c_nationkey").agg(A.n_rows().alias("n")), "n", "spawners")


@query("nest_unnest", "SELECT c_nationkey, c_custkey, c_acctbal FROM customer")
def _(t):
    n = R.nest(t.customer.select("c_nationkey", "c_custkey", "c_acctbal"), ["c_nationkey"], ["c_custkey"])
    return R.unnest(n, ["c_nationkey"])


# ---- scalar functions ----------------------------------------------------------------

@query("str_slice", "SELECT c_custkey, substr(c_name, 1, 8) AS head, right(c_name, 4) AS tail, substr(c_name, 10, 3) AS mid FROM customer")
def _(t):
    return t.customer.select("c_custkey", F.substring("c_name", 1, 8).alias("head"), F.right("c_name", F.lit(4)).alias("tail"),
                             F.substring("c_name", 10, 3).alias("mid"))


@query("str_split_nth", "SELECT p_partkey, split_part(p_name, ' ', 2) AS noun, split_part(p_brand, '#', 3) AS absent FROM part")
def _(t):
    return t.part.select("p_partkey", F.split_part("p_name", F.lit(" "), F.lit(2)).alias("noun"),
                         F.split_part("p_brand", F.lit("#"), F.lit(3)).alias("absent"))


@query("str_remove_replace", """
SELECT p_partkey, regexp_replace(p_brand, '[0-9]$', '') AS stem, regexp_replace(p_name, '^red ', 'crimson ') AS name,
  regexp_replace(p_brand, '[0-9]', '', 'g') AS letters FROM part""")
def _(t):
    return t.part.select("p_partkey", F.regexp_replace("p_brand", "[0-9]$", "").alias("stem"), F.regexp_replace("p_name", "^red ", "crimson ").alias("name"),
                         F.regexp_replace("p_brand", "[0-9]", "").alias("letters"))


@query("str_extract_detect", """
SELECT o_orderkey, regexp_extract(o_orderpriority, '[A-Z]+') AS word, regexp_matches(o_orderpriority, '^[12]') AS high FROM orders""")
def _(t):
    return t.orders.select("o_orderkey", F.regexp_extract("o_orderpriority", "[A-Z]+", 0).alias("word"), F.col("o_orderpriority").rlike("^[12]").alias("high"))


@query("case_trim", """
SELECT c_custkey, upper(c_name) AS up, lower(c_mktsegment) AS low, upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) AS title,
  trim('  ' || c_name || ' ') AS trimmed FROM customer""")
def _(t):
    return t.customer.select("c_custkey", F.upper("c_name").alias("up"), F.lower("c_mktsegment").alias("low"), F.initcap("c_mktsegment").alias("title"),
                             F.trim(F.concat(F.lit("  "), "c_name", F.lit(" "))).alias("trimmed"))


@query("concat", """
SELECT l_orderkey, l_linenumber, coalesce(nullif(l_returnflag, 'N'), 'NA') || ' ' || l_linestatus AS pasted, l_returnflag || l_linestatus AS glued FROM lineitem""")
def _(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", S.unite(F.nullif("l_returnflag", F.lit("N")), "l_linestatus", sep=" ").alias("pasted"),
                             S.unite("l_returnflag", "l_linestatus", sep="").alias("glued"))


@query("date_parse", """
WITH d AS (SELECT o_orderkey, strftime(o_orderdate, '%m/%d/%Y') AS mdy, strftime(o_orderdate, '%Y-%m-%d') AS ymd,
  CASE WHEN o_orderkey % 5 = 0 THEN 'n/a' ELSE strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS ts FROM orders)
SELECT o_orderkey, CAST(strptime(mdy, '%m/%d/%Y')::DATE AS VARCHAR) AS d1, CAST(strptime(ymd, '%Y-%m-%d')::DATE AS VARCHAR) AS d2,
  CAST(try_strptime(ts, '%Y-%m-%d %H:%M:%S')::DATE AS VARCHAR) AS d3 FROM d""")
def _(t):
    d = t.orders.select("o_orderkey", F.date_format("o_orderdate", "MM/dd/yyyy").alias("mdy"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("ymd"),
                        F.when(F.col("o_orderkey") % 5 == 0, F.lit("n/a")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).alias("ts"))
    return d.select("o_orderkey", S.parse_date("mdy", "MM/dd/yyyy").cast("string").alias("d1"), S.parse_date("ymd", "yyyy-MM-dd").cast("string").alias("d2"),
                    S.parse_date("ts", "yyyy-MM-dd HH:mm:ss").cast("string").alias("d3"))


@query("date_parts", """
SELECT event_id, CAST(year(ts) AS INTEGER) AS y, CAST(month(ts) AS INTEGER) AS m, CAST(day(ts) AS INTEGER) AS d, CAST(hour(ts) AS INTEGER) AS h,
  strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS floor_day FROM events""")
def _(t):
    return t.events.select("event_id", F.year("ts").alias("y"), F.month("ts").alias("m"), F.dayofmonth("ts").alias("d"), F.hour("ts").alias("h"),
                           F.date_format(F.date_trunc("DAY", "ts"), "yyyy-MM-dd HH:mm:ss").alias("floor_day"))


@query("season_year", """
SELECT o_orderkey, CASE WHEN month(o_orderdate) > 7 THEN CAST(year(o_orderdate) AS VARCHAR) || '-' || CAST(year(o_orderdate) + 1 AS VARCHAR)
  ELSE CAST(year(o_orderdate) - 1 AS VARCHAR) || '-' || CAST(year(o_orderdate) AS VARCHAR) END AS season FROM orders""")
def _(t):
    return t.orders.select("o_orderkey", S.season_year("o_orderdate").alias("season"))


@query("date_diff", """
SELECT l_orderkey, l_linenumber, CAST(abs(trunc(epoch(l_shipdate - o_orderdate) / 86400)) AS INTEGER) AS days
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def _(t):
    d = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return d.select("l_orderkey", "l_linenumber", F.abs(J.day_gap(F.col("l_shipdate"), F.col("o_orderdate"))).alias("days"))


@query("date_repair", """
SELECT o_orderkey, CAST(CASE WHEN year(o_orderdate) = 2000 AND NOT (month(o_orderdate) = 2 AND day(o_orderdate) = 29) THEN make_date(2001, month(o_orderdate), day(o_orderdate))
  ELSE o_orderdate::DATE END AS VARCHAR) AS fixed FROM orders""")
def _(t):
    d = F.col("o_orderdate")
    wrong = (F.year(d) == 2000) & ~((F.month(d) == 2) & (F.dayofmonth(d) == 29))
    return t.orders.select("o_orderkey", F.when(wrong, S.replace_year(d, 2001)).otherwise(d.cast("date")).cast("string").alias("fixed"))


@query("math", """
SELECT l_orderkey, l_linenumber, round(ln(l_quantity + 0.005), 4) AS lg, round(exp(l_discount), 4) AS ex, round(sqrt(l_extendedprice), 4) AS sq,
  round(pow(l_quantity, 2), 4) AS pw, abs(l_quantity - 25) AS ab, floor(l_extendedprice) AS fl, round_even(l_quantity / 2, 0) AS he FROM lineitem""")
def _(t):
    q = F.col("l_quantity")
    return t.lineitem.select("l_orderkey", "l_linenumber", F.round(F.ln(q + 0.005), 4).alias("lg"), F.round(F.exp("l_discount"), 4).alias("ex"),
                             F.round(F.sqrt("l_extendedprice"), 4).alias("sq"), F.round(F.pow(q, F.lit(2)), 4).alias("pw"), F.abs(q - 25).alias("ab"),
                             F.floor("l_extendedprice").cast("double").alias("fl"), F.bround(q / 2, 0).alias("he"))


@query("normal_ci", """
SELECT l_orderkey, l_linenumber, round(greatest(l_quantity - 1.959963984540054 * l_quantity * l_discount * 10, 0), 4) AS lwr,
  round(least(l_quantity + 1.959963984540054 * l_quantity * l_discount * 10, 100), 4) AS upr FROM lineitem""")
def _(t):
    lo, hi = S.normal_ci("l_quantity", F.col("l_quantity") * F.col("l_discount") * 10, floor=0, cap=100)
    return t.lineitem.select("l_orderkey", "l_linenumber", F.round(lo, 4).alias("lwr"), F.round(hi, 4).alias("upr"))


@query("safe_cast", """
SELECT p_partkey, TRY_CAST(split_part(p_brand, '#', 2) AS DOUBLE) AS num, TRY_CAST(split_part(p_name, ' ', 1) AS DOUBLE) AS bad FROM part""")
def _(t):
    return t.part.select("p_partkey", F.split_part("p_brand", F.lit("#"), F.lit(2)).try_cast("double").alias("num"),
                         F.split_part("p_name", F.lit(" "), F.lit(1)).try_cast("double").alias("bad"))


@query("unit_convert", "SELECT l_orderkey, l_linenumber, round(l_quantity * 0.028316846592, 6) AS cms FROM lineitem")
def _(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", F.round(S.cfs_to_cms("l_quantity"), 6).alias("cms"))


@query("expand_by_fraction", """
SELECT l_orderkey, l_linenumber, coalesce(round_even(CASE WHEN l_linenumber <> 3 THEN l_quantity END / nullif(p_size * 2 / 100, 0), 0), 0) AS expanded
FROM lineitem JOIN part ON l_partkey = p_partkey""")
def _(t):
    d = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    return d.select("l_orderkey", "l_linenumber", S.expand_by_fraction(
        F.when(F.col("l_linenumber") != 3, F.col("l_quantity")), F.col("p_size") * 2).alias("expanded"))


@query("format_estimate", """
WITH e AS (SELECT o_custkey, sum(o_totalprice) AS est, CASE WHEN count(*) > 1 THEN stddev_samp(o_totalprice) / avg(o_totalprice) END AS cv FROM orders GROUP BY 1)
SELECT o_custkey, format('{:,}', CAST(round_even(est, 0) AS BIGINT)) || ' (' || coalesce(printf('%.2f', round_even(cv, 2)), 'NA') || ')' AS label FROM e""")
def _(t):
    e = t.orders.groupBy("o_custkey").agg(F.sum("o_totalprice").alias("est"), F.try_divide(F.stddev_samp("o_totalprice"), F.avg("o_totalprice")).alias("cv"))
    return e.select("o_custkey", S.format_estimate("est", "cv").alias("label"))


@query("sort", "SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders ORDER BY o_orderpriority, abs(o_totalprice - 200000) DESC, o_orderkey")
def _(t):
    return t.orders.select("o_orderkey", "o_orderpriority", "o_totalprice").orderBy(
        "o_orderpriority", F.abs(F.col("o_totalprice") - 200000).desc(), "o_orderkey")


@query("limit_n", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def _(t):
    return t.orders.select("o_orderkey", "o_totalprice").orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(20)
