"""Joins, aggregates, windows and ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from reachworks.operators import aggregates as A
from reachworks.operators import frames as R
from reachworks.operators import joins as J
from reachworks.operators import screening as C
from reachworks.plans import views as V
from reachworks.plans.registry import query, r4


def _visits(t):
    return t.orders.select(F.col("o_orderkey").alias("visit"), F.col("o_custkey").alias("site"), F.year("o_orderdate").alias("year"),
                           F.nullif("o_orderstatus", F.lit("P")).alias("season"), F.col("o_totalprice").alias("metric"), "o_orderdate")


_VISITS = """visits AS (SELECT o_orderkey AS visit, o_custkey AS site, CAST(year(o_orderdate) AS INTEGER) AS year, nullif(o_orderstatus, 'P') AS season,
  o_totalprice AS metric, o_orderdate FROM orders)"""


# ---- joins ---------------------------------------------------------------------------

@query("inner_join", f"""WITH {_VISITS},
s AS (SELECT year, season, round(avg(metric), 6) AS mean_metric FROM visits GROUP BY 1, 2)
SELECT v.visit, v.year, v.season, s.mean_metric FROM visits v JOIN s ON v.year = s.year AND v.season IS NOT DISTINCT FROM s.season""")
def _(t):
    v = _visits(t)
    s = v.groupBy("year", "season").agg(F.round(F.avg("metric"), 6).alias("mean_metric"))
    return J.natural_join(v.select("visit", "year", "season"), s, "inner")


@query("left_join", """
SELECT c_custkey, c_nationkey, n_name, s.top FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_regionkey < 3
LEFT JOIN (SELECT s_nationkey, max(s_acctbal) AS top FROM supplier WHERE s_acctbal > 4000 GROUP BY 1) s ON s_nationkey = c_nationkey""")
def _(t):
    n = t.nation.where("n_regionkey < 3").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    s = t.supplier.where("s_acctbal > 4000").groupBy(F.col("s_nationkey").alias("c_nationkey")).agg(F.max("s_acctbal").alias("top"))
    return J.natural_join(J.natural_join(t.customer.select("c_custkey", "c_nationkey"), n, "left"), s, "left")


@query("full_join", """
WITH a AS (SELECT o_custkey AS site, count(*) AS n_f FROM orders WHERE o_orderstatus = 'F' GROUP BY 1),
b AS (SELECT o_custkey AS site, count(*) AS n_o FROM orders WHERE o_orderstatus = 'O' GROUP BY 1)
SELECT coalesce(a.site, b.site) AS site, coalesce(n_f, 0) AS n_f, coalesce(n_o, 0) AS n_o FROM a FULL JOIN b ON a.site = b.site""")
def _(t):
    def side(s, n):
        return t.orders.where(F.col("o_orderstatus") == s).groupBy(F.col("o_custkey").alias("site")).agg(A.n_rows().alias(n))
    return J.natural_join(side("F", "n_f"), side("O", "n_o"), "full").na.fill(0, ["n_f", "n_o"])


@query("anti_join", f"""WITH {_VISITS}
SELECT visit, site, year, season FROM visits v WHERE NOT EXISTS (SELECT 1 FROM visits w WHERE w.metric > 450000 AND w.site = v.site AND w.season IS NOT DISTINCT FROM v.season)""")
def _(t):
    v = _visits(t)
    return J.anti(v.select("visit", "site", "year", "season"), v.where("metric > 450000"), ["site", "season"])


@query("semi_membership", """
SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000) AS big FROM customer""")
def _(t):
    big = t.orders.where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return J.exists_flag(t.customer.select("c_custkey"), big, "c_custkey", "big")


@query("band_join", """
SELECT s_suppkey, c_custkey, s_nationkey AS route, s_acctbal, c_acctbal FROM supplier JOIN customer ON s_nationkey = c_nationkey
WHERE abs(s_acctbal - c_acctbal) <= 500""")
def _(t):
    s = t.supplier.select("s_suppkey", F.col("s_nationkey").alias("route"), "s_acctbal")
    c = t.customer.select("c_custkey", F.col("c_nationkey").alias("route"), "c_acctbal")
    return J.band_join(s, c, ["route"], "s_acctbal", "c_acctbal", 500.0)


@query("nearest_in_time", """
WITH p AS (SELECT event_id AS pid, user_id, ts AS pts FROM events WHERE event_type = 'purchase' AND event_id % 11 <> 0),
v AS (SELECT event_id AS vid, user_id, ts AS vts, value FROM events WHERE event_type = 'view' AND event_id % 11 <> 0)
SELECT pid, p.user_id, vid, value, CAST(abs(trunc(epoch(vts - pts) / 86400)) AS INTEGER) AS days FROM p JOIN v ON p.user_id = v.user_id
QUALIFY row_number() OVER (PARTITION BY pid ORDER BY abs(epoch_us(vts) - epoch_us(pts)), vts, vid) = 1""")
def _(t):
    ts = F.when(F.col("event_id") % 11 != 0, F.col("ts"))  # some times are unknown
    p = t.events.where("event_type = 'purchase'").select(F.col("event_id").alias("pid"), "user_id", ts.alias("pts"))
    v = t.events.where("event_type = 'view'").select(F.col("event_id").alias("vid"), "user_id", ts.alias("vts"), "value")
    j = J.nearest_join(p, v, ["user_id"], "pts", "vts", "pid", "vid")
    return j.select("pid", "user_id", "vid", "value", F.abs(J.day_gap(F.col("vts"), F.col("pts"))).alias("days"))


@query("tolerance_join", """
WITH p AS (SELECT event_id AS pid, user_id, ts AS pts FROM events WHERE event_type = 'purchase'),
v AS (SELECT user_id, ts AS vts, value FROM events WHERE event_type = 'view' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) = 1)
SELECT pid, p.user_id, CASE WHEN abs(trunc(epoch(pts - vts) / 86400)) <= 7 THEN value END AS value FROM p LEFT JOIN v ON p.user_id = v.user_id""")
def _(t):
    p = t.events.where("event_type = 'purchase'").select(F.col("event_id").alias("pid"), "user_id", F.col("ts").alias("pts"))
    v = A.first_per_group(t.events.where("event_type = 'view'"), ["user_id"], [F.col("ts").desc(), "event_id"]).select(
        "user_id", F.col("ts").alias("vts"), "value")
    return J.tolerance_join(p, v, ["user_id"], "pts", "vts", "value", 7).select("pid", "user_id", "value")


@query("cross_join", """
SELECT l_orderkey, l_linenumber, sp AS species FROM lineitem, (VALUES ('A'), ('N'), ('R')) v(sp) WHERE l_returnflag = 'R' OR l_returnflag = sp""")
def _(t):
    d = t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("species"))
    return J.expand_where(d, "species", "R", ["A", "N", "R"])


@query("upsert", """
SELECT c_custkey, c_acctbal, c_mktsegment FROM customer WHERE c_acctbal >= 0
UNION ALL SELECT c_custkey, 0.0, 'CORRECTED' FROM customer WHERE c_acctbal < 0""")
def _(t):
    base = t.customer.select("c_custkey", "c_acctbal", "c_mktsegment")
    fix = base.where("c_acctbal < 0").withColumns({"c_acctbal": F.lit(0.0), "c_mktsegment": F.lit("CORRECTED")})
    return J.upsert(base, fix, ["c_custkey"])


@query("self_backfill", """
SELECT o_orderkey, o_custkey, round(coalesce(CASE WHEN o_orderkey % 4 <> 0 THEN o_totalprice END,
  avg(CASE WHEN o_orderkey % 4 <> 0 THEN o_totalprice END) OVER (PARTITION BY o_custkey)), 6) AS metric FROM orders""")
def _(t):
    d = t.orders.select("o_orderkey", "o_custkey", F.when(F.col("o_orderkey") % 4 != 0, F.col("o_totalprice")).alias("metric"))
    return J.backfill(d, "o_custkey", "metric", "avg").select("o_orderkey", "o_custkey", F.round("metric", 6).alias("metric"))


@query("source_reconcile", """
WITH a AS (SELECT o_orderkey, o_totalprice AS price, CAST(o_custkey AS DOUBLE) AS cust FROM orders WHERE o_orderkey % 9 <> 0),
b AS (SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 3 THEN NULL ELSE o_totalprice END AS price, CAST(CASE WHEN o_orderkey % 11 = 0 THEN o_custkey + 1 ELSE o_custkey END AS DOUBLE) AS cust FROM orders),
l AS (SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, a.price AS pa, b.price AS pb, a.cust AS ca, b.cust AS cb FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey)
SELECT o_orderkey, 'price' AS field, pa AS a, pb AS b FROM l WHERE pa IS DISTINCT FROM pb
UNION ALL SELECT o_orderkey, 'cust', ca, cb FROM l WHERE ca IS DISTINCT FROM cb""")
def _(t):
    o = t.orders.select("o_orderkey", F.col("o_totalprice").alias("price"), F.col("o_custkey").cast("double").alias("cust"))
    b = o.withColumns({"price": F.when(F.col("o_orderkey") % 10 != 3, F.col("price")),
                       "cust": F.when(F.col("o_orderkey") % 11 == 0, F.col("cust") + 1).otherwise(F.col("cust"))})
    return J.reconcile(o.where("o_orderkey % 9 <> 0"), b, ["o_orderkey"], ["price", "cust"])


@query("fallback_precedence", """
WITH e AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 3 = 0 THEN l_quantity END AS direct,
  CASE WHEN l_orderkey % 3 = 1 THEN l_extendedprice / 1000 END AS model_a, l_discount AS se_a, l_extendedprice / 2000 AS model_b, l_tax AS se_b FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN direct IS NOT NULL THEN 'direct' WHEN model_a IS NOT NULL THEN 'watershed' ELSE 'global' END AS model,
  coalesce(direct, model_a, model_b) AS response, CASE WHEN direct IS NOT NULL THEN 0 WHEN model_a IS NOT NULL THEN se_a ELSE se_b END AS "SE" FROM e""")
def _(t):
    k = F.col("l_orderkey") % 3
    e = t.lineitem.select("l_orderkey", "l_linenumber", F.when(k == 0, F.col("l_quantity")).alias("direct"),
                          F.when(k == 1, F.col("l_extendedprice") / 1000).alias("model_a"), F.col("l_discount").alias("se_a"),
                          (F.col("l_extendedprice") / 2000).alias("model_b"), F.col("l_tax").alias("se_b"))
    return J.pick_first(e, [("direct", "direct", None), ("watershed", "model_a", "se_a"), ("global", "model_b", "se_b")]).select(
        "l_orderkey", "l_linenumber", "model", "response", "SE")


@query("scenario_lookup", """
WITH w AS (SELECT o_custkey AS site, CAST(year(o_orderdate) AS INTEGER) AS year, round(avg(o_totalprice), 4) AS temp FROM orders GROUP BY 1, 2)
SELECT o_orderkey, o_custkey AS site, CAST(year(o_orderdate) AS INTEGER) AS year, temp FROM orders LEFT JOIN w ON w.site = o_custkey AND w.year = year(o_orderdate)""")
def _(t):
    o = t.orders.select("o_orderkey", F.col("o_custkey").alias("site"), F.year("o_orderdate").alias("year"), "o_totalprice")
    wide = R.pivot(o, ["site"], "year", list(range(1990, 2011)), {"o_totalprice": lambda c: F.round(F.avg(c), 4)}, "S_{level}")
    return J.scenario_lookup(o.select("o_orderkey", "site", "year"), wide, "site", "year", "S_", "temp")


# ---- aggregates ----------------------------------------------------------------------

@query("group_agg", f"""WITH {V.PARTS_SQL}
SELECT p_type, count(*) AS n, count(DISTINCT size) + max((size IS NULL)::INT) AS n_size, round(sum(coalesce(price, 0)), 4) AS sum_price, round(avg(size), 4) AS mean_size,
  round(median(price), 4) AS med_price, min(size) AS min_size, max(size) AS max_size, round(stddev_samp(price), 4) AS sd_price, round(var_samp(size), 4) AS var_size
FROM parts GROUP BY 1""")
def _(t):
    return A.agg_with_medians(V.part_covariates(t), ["p_type"], {
        "n": A.n_rows(), "n_size": A.n_distinct("size"), "sum_price": F.round(A.sum0("price"), 4), "mean_size": F.round(F.avg("size"), 4),
        "min_size": F.min("size"), "max_size": F.max("size"), "sd_price": F.round(F.stddev_samp("price"), 4),
        "var_size": F.round(F.var_samp("size"), 4)}, {"med_price": "price"}).withColumn("med_price", F.round("med_price", 4))


@query("multi_col_agg", """
SELECT l_returnflag, l_linestatus, round(avg(l_quantity), 4) AS l_quantity_mean, max(l_quantity) AS l_quantity_max, round(avg(l_discount), 4) AS l_discount_mean,
  max(l_discount) AS l_discount_max, round(avg(l_tax), 4) AS l_tax_mean, max(l_tax) AS l_tax_max FROM lineitem GROUP BY 1, 2""")
def _(t):
    return A.agg_cols(t.lineitem, ["l_returnflag", "l_linestatus"], ["l_quantity", "l_discount", "l_tax"],
                      {"mean": lambda c: F.round(F.avg(c), 4), "max": F.max})


@query("conditional_agg", """
SELECT l_partkey, coalesce(sum(l_quantity) FILTER (WHERE l_linenumber = 1), 0) AS marked, coalesce(sum(l_quantity) FILTER (WHERE l_linenumber = 2), 0) AS caught,
  count(DISTINCT l_orderkey) FILTER (WHERE l_returnflag = 'R') AS n_r, round(avg((l_discount > 0.05)::INT), 4) AS share_disc FROM lineitem GROUP BY 1""")
def _(t):
    return t.lineitem.groupBy("l_partkey").agg(
        A.agg_if(A.sum0, "l_quantity", F.col("l_linenumber") == 1).alias("marked"), A.agg_if(A.sum0, "l_quantity", F.col("l_linenumber") == 2).alias("caught"),
        A.agg_if(F.count_distinct, "l_orderkey", F.col("l_returnflag") == "R").alias("n_r"),
        F.round(F.avg((F.col("l_discount") > 0.05).cast("int")), 4).alias("share_disc"))


@query("quantile_agg", """
SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.25), 4) AS p25, round(quantile_cont(l_extendedprice, 0.75), 4) AS p75, round(quantile_cont(l_extendedprice, 0.95), 4) AS p95,
  round(quantile_cont(l_extendedprice, 0.99), 4) AS p99, round(quantile_cont(l_extendedprice, 1), 4) AS p100 FROM lineitem GROUP BY 1""")
def _(t):
    q = A.quantiles(t.lineitem, ["l_returnflag"], "l_extendedprice", {"p25": 0.25, "p75": 0.75, "p95": 0.95, "p99": 0.99, "p100": 1.0})
    return q.select("l_returnflag", *[r4(c) for c in q.columns[1:]])


@query("weighted_mean", f"""WITH {V.PARTS_SQL}
SELECT p_brand, round(sum(size * dens) / sum(CASE WHEN size IS NOT NULL THEN dens END), 4) AS wm FROM parts GROUP BY 1""")
def _(t):
    return V.part_covariates(t).groupBy("p_brand").agg(F.round(A.wmean("size", "dens"), 4).alias("wm"))


@query("rss_se", f"WITH {V.REACHES_SQL} SELECT stream, round(sqrt(sum(pow(length * se, 2))), 4) AS se FROM reaches GROUP BY 1")
def _(t):
    return V.reaches(t).groupBy("stream").agg(F.round(A.rss(F.col("length") * F.col("se")), 4).alias("se"))


@query("arg_max_agg", """
SELECT l_orderkey, l_extendedprice, l_partkey, l_suppkey FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) = 1""")
def _(t):
    return A.arg_max(t.lineitem, ["l_orderkey"], "l_extendedprice", "l_linenumber", ["l_partkey", "l_suppkey"])


@query("crosstab_margins", """
SELECT coalesce(l_returnflag, 'Total') AS l_returnflag, coalesce(CAST(l_linenumber AS VARCHAR), 'Total') AS l_linenumber, count(*) AS n FROM lineitem GROUP BY CUBE (1, 2)""".replace(
    "CUBE (1, 2)", "CUBE (lineitem.l_returnflag, lineitem.l_linenumber)"))
def _(t):
    return A.crosstab(t.lineitem, "l_returnflag", "l_linenumber")


@query("stable_attr_collapse", """
SELECT l_partkey, round(median(l_quantity), 4) AS quantity, round(median(l_extendedprice), 4) AS price, max(p_brand) AS p_brand,
  CASE WHEN count(DISTINCT l_returnflag) = 1 THEN max(l_returnflag) END AS l_returnflag, CAST((count(DISTINCT l_returnflag) > 1)::INT AS BIGINT) AS conflicts
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1""")
def _(t):
    d = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    s = A.site_average(d, ["l_partkey"], {"quantity": "l_quantity", "price": "l_extendedprice"}, ["p_brand", "l_returnflag"])
    return s.withColumns({"quantity": F.round("quantity", 4), "price": F.round("price", 4)})


@query("table_null_fraction", """
WITH d AS (SELECT nullif(l_discount, 0) AS disc, nullif(l_tax, 0) AS tax, nullif(l_returnflag, 'N') AS flag FROM lineitem)
SELECT 'disc' AS column_name, round(avg((disc IS NULL)::INT), 6) AS null_share FROM d UNION ALL SELECT 'tax', round(avg((tax IS NULL)::INT), 6) FROM d
UNION ALL SELECT 'flag', round(avg((flag IS NULL)::INT), 6) FROM d""")
def _(t):
    d = t.lineitem.select(F.nullif("l_discount", F.lit(0.0)).alias("disc"), F.nullif("l_tax", F.lit(0.0)).alias("tax"), F.nullif("l_returnflag", F.lit("N")).alias("flag"))
    return A.null_fraction(d).withColumn("null_share", F.round("null_share", 6))


@query("two_stage_agg", """
SELECT o_custkey, round(avg(tot), 6) AS mean_tot, count(*) AS n_visits FROM (SELECT o_custkey, l_orderkey, sum(l_quantity * l_extendedprice) AS tot
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2) GROUP BY 1""")
def _(t):
    d = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return A.two_stage(d, ["o_custkey", "l_orderkey"], ["o_custkey"], {"tot": F.sum(F.col("l_quantity") * F.col("l_extendedprice"))},
                       {"mean_tot": F.round(F.avg("tot"), 6), "n_visits": A.n_rows()})


_CORR_COLS = ["size", "price", "dens"]
_CORR_SQL = f"""WITH {V.PARTS_SQL},
prs AS (SELECT 'size' AS x, 'price' AS y, p_partkey AS k, size AS xv, price AS yv FROM parts WHERE size IS NOT NULL AND price IS NOT NULL
  UNION ALL SELECT 'size', 'dens', p_partkey, size, dens FROM parts WHERE size IS NOT NULL
  UNION ALL SELECT 'price', 'dens', p_partkey, price, dens FROM parts WHERE price IS NOT NULL),
rnk AS (SELECT x, y, rank() OVER (PARTITION BY x, y ORDER BY xv) + (count(*) OVER (PARTITION BY x, y, xv) - 1) / 2.0 AS rx,
  rank() OVER (PARTITION BY x, y ORDER BY yv) + (count(*) OVER (PARTITION BY x, y, yv) - 1) / 2.0 AS ry FROM prs),
spear AS (SELECT x, y, corr(rx, ry) AS r FROM rnk GROUP BY 1, 2),
pear AS (SELECT x, y, corr(xv, yv) AS r FROM prs GROUP BY 1, 2),
kend AS (SELECT a.x, a.y, sum(sign(a.xv - b.xv) * sign(a.yv - b.yv)) / sqrt(CAST(sum(abs(sign(a.xv - b.xv))) AS DOUBLE) * CAST(sum(abs(sign(a.yv - b.yv))) AS DOUBLE)) AS r
  FROM prs a JOIN prs b ON a.x = b.x AND a.y = b.y AND a.k < b.k GROUP BY 1, 2)"""


@query("correlation_matrix", _CORR_SQL + """
SELECT 'pearson' AS method, x, y, round(r, 6) AS r FROM pear UNION ALL SELECT 'spearman', x, y, round(r, 6) FROM spear UNION ALL SELECT 'kendall', x, y, round(r, 6) FROM kend""")
def _(t):
    d = V.part_covariates(t)
    return R.stack([C.corr_long(d, _CORR_COLS, m).select(F.lit(m).alias("method"), "x", "y", F.round("r", 6).alias("r"))
                    for m in ("pearson", "spearman", "kendall")])


_CATS = {"size": "form", "dens": "price", "price": "price", "effort": "form"}


@query("per_category_corr", f"""WITH {V.PARTS_SQL},
prs AS (SELECT 'dens' AS x, 'price' AS y, dens AS xv, price AS yv FROM parts WHERE price IS NOT NULL UNION ALL SELECT 'size', 'effort', size, effort FROM parts WHERE size IS NOT NULL),
rnk AS (SELECT x, y, rank() OVER (PARTITION BY x, y ORDER BY xv) + (count(*) OVER (PARTITION BY x, y, xv) - 1) / 2.0 AS rx,
  rank() OVER (PARTITION BY x, y ORDER BY yv) + (count(*) OVER (PARTITION BY x, y, yv) - 1) / 2.0 AS ry FROM prs)
SELECT x, y, round(corr(rx, ry), 6) AS r, CASE x WHEN 'dens' THEN 'price' ELSE 'form' END AS category FROM rnk GROUP BY 1, 2""")
def _(t):
    return C.corr_by_category(V.part_covariates(t), _CATS).withColumn("r", F.round("r", 6))


@query("grand_total_row", f"""WITH {V.REACHES_SQL}
SELECT CASE WHEN grouping(stream) = 1 THEN 'Total' ELSE stream END AS stream, CAST(grouping(stream) AS INTEGER) AS is_total, round(sum(length), 4) AS tot_length,
  round(sum(cap * length) / sum(length), 4) AS cap_per_m FROM reaches GROUP BY ROLLUP (reaches.stream)""")
def _(t):
    return A.with_total(V.reaches(t), "stream", {"tot_length": F.round(F.sum("length"), 4), "cap_per_m": F.round(A.wmean("cap", "length"), 4)})


# ---- windows and ranking -------------------------------------------------------------

@query("group_share", """
SELECT o_orderkey, o_custkey, round(o_totalprice / sum(o_totalprice) OVER (PARTITION BY o_custkey), 6) AS share FROM orders""")
def _(t):
    return A.share(t.orders, ["o_custkey"], "o_totalprice", "share").select("o_orderkey", "o_custkey", F.round("share", 6).alias("share"))


@query("keep_group_max", """
SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_discount FROM lineitem
QUALIFY rank() OVER (PARTITION BY l_partkey ORDER BY l_quantity DESC, l_discount DESC) = 1""")
def _(t):
    return A.keep_max(t.lineitem, ["l_partkey"], ["l_quantity", "l_discount"]).select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_discount")


@query("first_per_group", """
SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1""")
def _(t):
    return A.first_per_group(t.orders, ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_totalprice")


@query("latest_per_key", """
SELECT o_custkey, o_orderpriority, o_orderkey FROM orders QUALIFY o_orderdate = max(o_orderdate) OVER (PARTITION BY o_custkey, o_orderpriority)""")
def _(t):
    return A.latest(t.orders, ["o_custkey", "o_orderpriority"], "o_orderdate").select("o_custkey", "o_orderpriority", "o_orderkey")


@query("top_n_per_group", """
SELECT p_brand, p_partkey, p_retailprice FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) <= 5""")
def _(t):
    return A.top_n(t.part, ["p_brand"], [F.col("p_retailprice").desc(), F.col("p_partkey")], 5).select("p_brand", "p_partkey", "p_retailprice")


@query("centre_scale", f"""WITH {V.PARTS_SQL},
s AS (SELECT avg(size) AS ms, stddev_samp(size) AS ss, avg(price) AS mp, stddev_samp(price) AS sp FROM parts WHERE p_type = 'ECONOMY')
SELECT p_partkey, round((size - ms) / ss, 6) AS size_z, round((price - mp) / sp, 6) AS price_z, round(size - ms, 6) AS size_center FROM parts, s""")
def _(t):
    d = V.part_covariates(t)
    ref = d.where("p_type = 'ECONOMY'")
    z = A.centre(A.standardise(d, ["size", "price"], ref), ["size"], ref)
    return z.select("p_partkey", *[F.round(c, 6).alias(c) for c in ("size_z", "price_z", "size_center")])


@query("dedupe_policy", """
WITH d AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_linestatus, l_quantity, l_shipdate, l_extendedprice, l_returnflag AS crew FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_linestatus, crew ORDER BY l_quantity DESC,
    CASE WHEN crew = 'R' THEN l_shipdate END DESC, l_extendedprice) AS rn FROM d WHERE crew IN ('A', 'R'))
SELECT l_orderkey, l_linenumber, l_partkey, crew, l_quantity FROM d WHERE crew = 'N' UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, crew, l_quantity FROM r WHERE rn = 1""")
def _(t):
    d = t.lineitem.withColumnRenamed("l_returnflag", "crew")
    return A.dedupe(d, ["l_partkey", "l_linestatus"], "crew", {"A": "highest", "R": "highest_latest"}, "l_quantity", "l_shipdate", "l_extendedprice").select(
        "l_orderkey", "l_linenumber", "l_partkey", "crew", "l_quantity")


@query("cumulative_weight", """
WITH w AS (SELECT o_orderkey, o_totalprice / sum(o_totalprice) OVER () AS weight FROM orders),
c AS (SELECT *, sum(weight) OVER (ORDER BY weight DESC, o_orderkey ROWS UNBOUNDED PRECEDING) AS cum FROM w)
SELECT o_orderkey, round(weight, 8) AS weight, round(cum, 6) AS cum_weight FROM c WHERE cum < 0.95""")
def _(t):
    w = A.share(t.orders.select("o_orderkey", "o_totalprice"), [], "o_totalprice", "weight")
    return A.cumulative_cut(w, "weight", 0.95, ["o_orderkey"]).select("o_orderkey", F.round("weight", 8).alias("weight"), F.round("cum_weight", 6).alias("cum_weight"))


@query("group_range_flag", f"""WITH {V.PARTS_SQL},
l AS (SELECT p_partkey, p_type, 'size' AS metric, size AS value FROM parts UNION ALL SELECT p_partkey, p_type, 'price', price FROM parts),
b AS (SELECT metric, min(value) AS lo, max(value) AS hi, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM l WHERE p_type = 'ECONOMY' GROUP BY 1)
SELECT p_partkey, l.metric, value, value BETWEEN lo AND hi AS in_range, value BETWEEN q1 AND q3 AS in_iqr FROM l JOIN b ON l.metric = b.metric WHERE value IS NOT NULL""")
def _(t):
    long = V.part_covariates(t).unpivot(["p_partkey", "p_type"], ["size", "price"], "metric", "value").where("value is not null")
    return A.range_flags(long, "metric", "value", long.where("p_type = 'ECONOMY'")).select("p_partkey", "metric", "value", "in_range", "in_iqr")


@query("order_by_statistic", """
WITH s AS (SELECT p_brand, round(avg(l_quantity), 4) AS stat FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)
SELECT p_brand, stat, dense_rank() OVER (ORDER BY stat DESC) AS rank FROM s""")
def _(t):
    d = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    return A.rank_categories(d, "p_brand", F.round(F.avg("l_quantity"), 4))
