"""Abundance estimators, covariate screens and survey-weighted extrapolation."""

from __future__ import annotations

from pyspark.sql import functions as F

from reachworks.functions import scalars as S
from reachworks.operators import aggregates as A
from reachworks.operators import estimators as E
from reachworks.operators import frames as R
from reachworks.operators import joins as J
from reachworks.operators import screening as C
from reachworks.operators import survey as G
from reachworks.plans import views as V
from reachworks.plans.registry import query, r4

# ---- abundance -----------------------------------------------------------------------

_REMOVAL2 = """CASE WHEN pass1 > pass2 THEN pass1 * pass1 / (pass1 - pass2) ELSE 0 END AS n,
  CASE WHEN pass1 > pass2 THEN pass1 * pass2 * sqrt(pass1 + pass2) / pow(pass1 - pass2, 2) END AS se, CASE WHEN pass1 > pass2 THEN (pass1 - pass2) / pass1 END AS p,
  CASE WHEN pass1 > pass2 THEN sqrt(pass2 * (pass1 + pass2) / pow(pass1, 3)) END AS pse"""


def _four(d, keys):
    return d.select(*keys, F.round("e.N", 4).alias("n"), F.round("e.SE", 4).alias("se"), F.round("e.p", 6).alias("p"), F.round("e.pSE", 6).alias("pse"))


_R4 = "round(n, 4) AS n, round(se, 4) AS se, round(p, 6) AS p, round(pse, 6) AS pse"


@query("depletion_2pass", f"WITH {V.PASSES_SQL}, e AS (SELECT l_partkey, l_returnflag, {_REMOVAL2} FROM passes WHERE pass1 IS NOT NULL AND pass2 IS NOT NULL) SELECT l_partkey, l_returnflag, {_R4} FROM e")
def _(t):
    d = V.depletion_passes(t).where("pass1 is not null and pass2 is not null")
    return _four(d.withColumn("e", E.removal2("pass1", "pass2")), ["l_partkey", "l_returnflag"])


def _carle_strub_sql(name: str, src: str, passes: list[str]) -> str:
    """Doubling then bisection as a recursive query: the same search, whole table, no upper bound on N."""
    k = len(passes)
    t, x = " + ".join(passes), " + ".join(f"{k - i} * {p}" for i, p in enumerate(passes, 1))

    def over(n):
        prod = " * ".join(f"(({k} * {n} - x - t + 1 + {k - i}) / ({k} * {n} - x + 2 + {k - i}))" for i in range(1, k + 1))
        return f"(({n} + 1) / ({n} - t + 1) * {prod} > 1)"
    return f"""{name}_s AS (SELECT l_partkey, l_returnflag, CAST({t} AS DOUBLE) AS t, CAST({x} AS DOUBLE) AS x FROM {src}),
{name}_b AS (SELECT l_partkey, l_returnflag, t, x, t AS lo, greatest(2 * t, 1) AS hi, 0 AS step, {over('t')} AS open, {over('greatest(2 * t, 1)')} AS grow FROM {name}_s
  UNION ALL SELECT l_partkey, l_returnflag, t, x,
    CASE WHEN grow THEN hi WHEN {over('floor((lo + hi) / 2)')} THEN floor((lo + hi) / 2) ELSE lo END,
    CASE WHEN grow THEN 2 * hi WHEN {over('floor((lo + hi) / 2)')} THEN hi ELSE floor((lo + hi) / 2) END, step + 1, open,
    grow AND {over('(2 * hi)')} FROM {name}_b WHERE open AND (grow OR hi - lo > 1)),
{name}_n AS (SELECT l_partkey, l_returnflag, t, x, CASE WHEN open THEN hi ELSE t END AS n FROM {name}_b WHERE NOT open OR (NOT grow AND hi - lo <= 1)),
{name}_p AS (SELECT *, t / ({k} * n - x) AS p, 1 - t / ({k} * n - x) AS q FROM {name}_n),
{name} AS (SELECT l_partkey, l_returnflag, n, p,
  CASE WHEN q = 0 THEN 0 ELSE (CASE WHEN pow(1 - pow(q, {k}), 2) - pow(p * {k}, 2) * pow(q, {k - 1}) > 0 THEN sqrt(n * (1 - pow(q, {k})) * pow(q, {k}) / (pow(1 - pow(q, {k}), 2) - pow(p * {k}, 2) * pow(q, {k - 1}))) END) END AS se,
  CASE WHEN q = 0 THEN 0 ELSE (CASE WHEN q * pow(1 - pow(q, {k}), 2) - pow(p * {k}, 2) * pow(q, {k}) > 0 THEN sqrt(pow(q * p, 2) * (1 - pow(q, {k})) / (n * (q * pow(1 - pow(q, {k}), 2) - pow(p * {k}, 2) * pow(q, {k})))) END) END AS pse
  FROM {name}_p)"""


@query("depletion_kpass", f"""WITH RECURSIVE {V.PASSES_SQL}, three AS (SELECT * FROM passes WHERE pass1 + pass2 + pass3 IS NOT NULL), {_carle_strub_sql('cs', 'three', ['pass1', 'pass2', 'pass3'])}
SELECT l_partkey, l_returnflag, round(n, 4) AS n, round(se, 2) AS se, round(p, 6) AS p, round(pse, 4) AS pse FROM cs""")
def _(t):
    d = V.depletion_passes(t).withColumn("e", E.removal_k(["pass1", "pass2", "pass3"])).where("e.N is not null")
    return d.select("l_partkey", "l_returnflag", F.round("e.N", 4).alias("n"), F.round("e.SE", 2).alias("se"), F.round("e.p", 6).alias("p"), F.round("e.pSE", 4).alias("pse"))


_MR = "mr AS (SELECT l_partkey, l_returnflag, pass1 AS m, pass2 AS n, least(pass3, pass1, pass2) AS r FROM passes WHERE pass1 IS NOT NULL AND pass2 IS NOT NULL AND pass3 IS NOT NULL)"
_CHAP = """(m + 1) * (n + 1) / (r + 1) - 1 AS nn, sqrt((m + 1) * (n + 1) * (m - r) * (n - r) / (pow(r + 1, 2) * (r + 2))) AS se"""


def _marks(t):
    d = V.depletion_passes(t).where("pass1 is not null and pass2 is not null and pass3 is not null")
    return d.withColumn("r", F.least("pass3", "pass1", "pass2"))


@query("mark_recapture", f"""WITH {V.PASSES_SQL}, {_MR}, c AS (SELECT *, {_CHAP} FROM mr)
SELECT l_partkey, l_returnflag, round(nn, 4) AS n, round(se, 4) AS se, round(m / nn, 6) AS p, round(m * se / (nn * nn), 6) AS pse FROM c""")
def _(t):
    return _four(_marks(t).withColumn("e", E.chapman("pass1", "pass2", "r")), ["l_partkey", "l_returnflag"])


@query("ratio_estimator", """
WITH d AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 2 THEN 0 ELSE l_quantity END AS c, CASE WHEN l_linenumber <> 2 OR l_discount > 0.05 THEN nullif(l_discount, 0) END AS p, l_tax AS pse FROM lineitem)
SELECT l_orderkey, l_linenumber, round(coalesce(c / p, CASE WHEN c = 0 AND p IS NULL THEN 0 END), 4) AS n, round(c * pse / (p * p), 4) AS se, round(p, 6) AS p, round(pse, 6) AS pse FROM d""")
def _(t):
    d = t.lineitem.select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") == 2, 0.0).otherwise(F.col("l_quantity")).alias("c"),
                          F.when((F.col("l_linenumber") != 2) | (F.col("l_discount") > 0.05), F.nullif("l_discount", F.lit(0.0))).alias("p"), F.col("l_tax").alias("pse"))
    return _four(d.withColumn("e", E.ratio_est("c", "p", "pse")), ["l_orderkey", "l_linenumber"])


_METHODS = {0: "Depletion", 1: "Mark Recapture", 2: "Single Pass", 3: "Continuous"}


def _surveys(t):
    """Surveys by part and flag with their passes, method and (for continuous ones) a capture probability."""
    d = V.depletion_passes(t).where("pass1 is not null and pass2 is not null")
    m = F.col("l_partkey") % 4
    old = F.when(F.col("l_partkey") % 3 == 0, F.col("pass1") * 3.0)
    return d.select("l_partkey", "l_returnflag", "pass1", "pass2", old.alias("N_old"), F.when(old.isNotNull(), 1.5).alias("SE_old"),
                    F.when(m == 1, F.least("pass3", "pass1", "pass2")).otherwise(F.col("pass3")).alias("pass3"),
                    F.when(m == 0, F.col("pass4")).alias("pass4"),
                    F.when(m == 3, F.nullif((F.col("l_partkey") % 5) / 10.0, F.lit(0.0))).alias("p"), F.when(m == 3, F.lit(0.05)).alias("pSE"),
                    S.classify([(m == k, v) for k, v in _METHODS.items()]).alias("Method"))


_SURVEYS = f"""{V.PASSES_SQL}, surveys AS (SELECT l_partkey, l_returnflag, pass1, pass2, CASE WHEN l_partkey % 4 = 1 THEN CASE WHEN pass3 IS NULL THEN least(pass1, pass2) ELSE least(pass3, pass1, pass2) END ELSE pass3 END AS pass3,
  CASE WHEN l_partkey % 4 = 0 THEN pass4 END AS pass4, CASE WHEN l_partkey % 4 = 3 THEN nullif(l_partkey % 5 / 10.0, 0) END AS p0, CASE WHEN l_partkey % 4 = 3 THEN 0.05 END AS pse0,
  CASE l_partkey % 4 WHEN 0 THEN 'Depletion' WHEN 1 THEN 'Mark Recapture' WHEN 2 THEN 'Single Pass' ELSE 'Continuous' END AS method, CASE WHEN l_partkey % 3 = 0 THEN pass1 * 3.0 END AS nold FROM passes WHERE pass1 IS NOT NULL AND pass2 IS NOT NULL),
d2 AS (SELECT l_partkey, l_returnflag, {_REMOVAL2} FROM surveys WHERE method = 'Depletion' AND pass3 IS NULL),
s3 AS (SELECT * FROM surveys WHERE method = 'Depletion' AND pass3 IS NOT NULL AND coalesce(pass4, 0) <= 0 AND nold IS NULL), s4 AS (SELECT * FROM surveys WHERE method = 'Depletion' AND pass3 IS NOT NULL AND pass4 > 0 AND nold IS NULL),
{_carle_strub_sql('c3', 's3', ['pass1', 'pass2', 'pass3'])}, {_carle_strub_sql('c4', 's4', ['pass1', 'pass2', 'pass3', 'pass4'])},
mr AS (SELECT l_partkey, l_returnflag, pass1 AS m, pass2 AS n, pass3 AS r FROM surveys WHERE method = 'Mark Recapture'),
ch AS (SELECT *, {_CHAP} FROM mr),
est AS (SELECT l_partkey, l_returnflag, n, se, p, pse, 'Seber' AS nmethod FROM d2 UNION ALL SELECT l_partkey, l_returnflag, n, se, p, pse, 'Carle Strub' FROM c3
  UNION ALL SELECT l_partkey, l_returnflag, n, se, p, pse, 'Carle Strub' FROM c4 UNION ALL SELECT l_partkey, l_returnflag, nn, se, m / nn, m * se / (nn * nn), 'Chapman' FROM ch
  UNION ALL SELECT l_partkey, l_returnflag, pass1 / p0, pass1 * pse0 / (p0 * p0), p0, pse0, 'Ratio Est.' FROM surveys WHERE method = 'Continuous'
  UNION ALL SELECT l_partkey, l_returnflag, NULL, NULL, p0, pse0, NULL FROM surveys WHERE method = 'Single Pass' AND nold IS NULL
  UNION ALL SELECT l_partkey, l_returnflag, nold, 1.5, p0, pse0, 'Prev. Calc.' FROM surveys WHERE nold IS NOT NULL AND (method = 'Single Pass' OR method = 'Depletion' AND pass3 IS NOT NULL))"""


@query("estimator_dispatch", f"""WITH RECURSIVE {_SURVEYS}
SELECT l_partkey, l_returnflag, nmethod, round(n, 4) AS n, round(se, 2) AS se, round(p, 6) AS p, round(pse, 4) AS pse FROM est""")
def _(t):
    e = E.estimate_abundance(_surveys(t), earlier=("N_old", "SE_old"))
    return e.select("l_partkey", "l_returnflag", F.col("Nmethod").alias("nmethod"), F.round("N", 4).alias("n"), F.round("SE", 2).alias("se"),
                    F.round("p", 6).alias("p"), F.round("pSE", 4).alias("pse"))


_VALID = """v AS (SELECT s.*, e.n, e.nmethod, coalesce(CASE WHEN method = 'Mark Recapture' THEN pass1 * pass2 / 4 > e.n OR pass3 >= 7
  WHEN method IN ('Continuous', 'Depletion') THEN true WHEN method = 'Single Pass' THEN nmethod = 'Prev. Calc.' END, false) AS valid FROM surveys s JOIN est e USING (l_partkey, l_returnflag))"""


@query("validity_rule", f"WITH RECURSIVE {_SURVEYS}, {_VALID} SELECT l_partkey, l_returnflag, method, valid FROM v")
def _(t):
    return E.flag_valid(E.estimate_abundance(_surveys(t), earlier=("N_old", "SE_old"))).select("l_partkey", "l_returnflag", F.col("Method").alias("method"), F.col("Valid").alias("valid"))


@query("business_validity", f"WITH RECURSIVE {_SURVEYS}, {_VALID} SELECT l_partkey, l_returnflag, round(n, 4) AS n FROM v WHERE valid")
def _(t):
    return E.flag_valid(E.estimate_abundance(_surveys(t), earlier=("N_old", "SE_old"))).where("Valid").select("l_partkey", "l_returnflag", F.round("N", 4).alias("n"))


@query("overlap_check", """
WITH d AS (SELECT l_returnflag, l_linestatus, l_quantity AS obs, l_quantity * l_discount AS ose, l_extendedprice / 2000 AS pred, l_extendedprice * l_tax / 2000 AS pse FROM lineitem),
x AS (SELECT *, (obs - 1.959963984540054 * ose < pred + 1.959963984540054 * pse AND obs + 1.959963984540054 * ose > pred - 1.959963984540054 * pse)::INT AS hit FROM d)
SELECT l_returnflag, l_linestatus, count(*) AS n_pred, CAST(sum(hit) AS BIGINT) AS n_overlap, round(sum(hit) / count(*), 6) AS share_overlap, round(avg(obs - pred), 6) AS bias,
  round(sqrt(avg(pow(obs - pred, 2))), 6) AS rmse FROM x GROUP BY 1, 2""")
def _(t):
    d = t.lineitem.select("l_returnflag", "l_linestatus", F.col("l_quantity").alias("obs"), (F.col("l_quantity") * F.col("l_discount")).alias("ose"),
                          (F.col("l_extendedprice") / 2000).alias("pred"), (F.col("l_extendedprice") * F.col("l_tax") / 2000).alias("pse"))
    o = E.ci_overlap(d, ["l_returnflag", "l_linestatus"], "obs", "ose", "pred", "pse")
    return o.withColumns({c: F.round(c, 6) for c in ("share_overlap", "bias", "rmse")})


@query("redd_density", """
WITH c AS (SELECT s_suppkey, o_orderstatus AS species, CAST(year(o_orderdate) AS INTEGER) AS yr, count(DISTINCT o_orderkey) AS n FROM supplier JOIN customer ON s_nationkey = c_nationkey
  AND abs(s_acctbal - c_acctbal) <= 500 JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2, 3),
b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY s_suppkey, species ORDER BY n DESC, yr DESC) = 1)
SELECT b.s_suppkey, species, yr AS max_year, round(n / 1.0, 4) AS redds_per_km, round(n / (100.0 + b.s_suppkey % 50), 6) AS redds_per_m2 FROM b""")
def _(t):
    sites = t.supplier.select("s_suppkey", F.col("s_nationkey").alias("route"), "s_acctbal", (F.lit(100.0) + F.col("s_suppkey") % 50).alias("area"))
    redds = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(
        "o_orderkey", F.col("c_nationkey").alias("route"), "c_acctbal", F.col("o_orderstatus").alias("species"), F.year("o_orderdate").alias("yr"))
    redds = redds.unionByName(redds.where("o_orderkey % 3 = 0"))  # some nests were recorded twice
    d = E.redd_density(sites, redds, ["route"], "s_suppkey", "s_acctbal", "c_acctbal", 500.0, "species", "yr", "area", "o_orderkey")
    return d.select("s_suppkey", "species", "max_year", F.round("redds_per_km", 4).alias("redds_per_km"), F.round("redds_per_m2", 6).alias("redds_per_m2"))


# ---- screening -----------------------------------------------------------------------

_MIC_SQL = f"""{V.PARTS_SQL},
ml AS (SELECT 'size' AS metric, p_partkey AS k, size AS x, ln(dens + 0.005) AS y FROM parts WHERE size IS NOT NULL UNION ALL SELECT 'price', p_partkey, price, ln(dens + 0.005) FROM parts WHERE price IS NOT NULL
  UNION ALL SELECT 'effort', p_partkey, effort, ln(dens + 0.005) FROM parts),
mr AS (SELECT metric, row_number() OVER (PARTITION BY metric ORDER BY x, k) - 1 AS rx, row_number() OVER (PARTITION BY metric ORDER BY y, k) - 1 AS ry, count(*) OVER (PARTITION BY metric) AS n FROM ml),
mg AS (SELECT metric, n, a, b, CASE WHEN rx < (n % a) * (n // a + 1) THEN rx // (n // a + 1) ELSE n % a + (rx - (n % a) * (n // a + 1)) // (n // a) END AS i,
    CASE WHEN ry < (n % b) * (n // b + 1) THEN ry // (n // b + 1) ELSE n % b + (ry - (n % b) * (n // b + 1)) // (n // b) END AS j
  FROM mr JOIN (SELECT m, a, unnest(range(2, cells // a + 1)) AS b FROM (SELECT m, cells, unnest(range(2, cells // 2 + 1)) AS a
    FROM (SELECT metric AS m, CAST(floor(pow(max(n), 0.6)) AS BIGINT) AS cells FROM mr GROUP BY 1))) ON m = metric),
mc AS (SELECT metric, n, a, b, i, j, count(*) AS c FROM mg GROUP BY 1, 2, 3, 4, 5, 6),
mi AS (SELECT metric, a, b, sum(c / n * ln(c * n / (CAST(n // a + (i < n % a)::INT AS DOUBLE) * (n // b + (j < n % b)::INT)))) / ln(least(a, b)) AS s FROM mc GROUP BY 1, 2, 3),
mics AS (SELECT metric, max(s) AS mic FROM mi GROUP BY 1)"""


def _mic(t):
    d = V.part_covariates(t).withColumn("y", F.ln(F.col("dens") + 0.005))
    return C.mic(d, ["size", "price", "effort"], "y", "p_partkey")


@query("mic_screen", f"""WITH {_MIC_SQL},
prof AS (SELECT 'size' AS metric, var_samp(size) AS var, stddev_samp(size) / abs(avg(size)) AS cv, count(*) - count(size) AS is_na, count(CASE WHEN size <> 0 THEN 1 END) AS non_0 FROM parts
  UNION ALL SELECT 'price', var_samp(price), stddev_samp(price) / abs(avg(price)), count(*) - count(price), count(CASE WHEN price <> 0 THEN 1 END) FROM parts
  UNION ALL SELECT 'effort', var_samp(effort), stddev_samp(effort) / abs(avg(effort)), count(*) - count(effort), count(CASE WHEN effort <> 0 THEN 1 END) FROM parts)
SELECT metric, round(mic, 6) AS mic, round(var, 4) AS var, round(cv, 6) AS cv, is_na, non_0 FROM mics JOIN prof USING (metric)""")
def _(t):
    prof = A.profile(V.part_covariates(t), ["size", "price", "effort"])
    return J.natural_join(_mic(t), prof, "inner", ["metric"]).select(
        "metric", F.round("mic", 6).alias("mic"), r4("var"), F.round("cv", 6).alias("cv"), "is_na", "non_0")


@query("rank_in_category", f"""WITH {_MIC_SQL},
prof AS (SELECT 'size' AS metric, count(*) - count(size) AS na, count(CASE WHEN size <> 0 THEN 1 END) AS nz, count(*) AS n FROM parts UNION ALL SELECT 'price', count(*) - count(price), count(CASE WHEN price <> 0 THEN 1 END), count(*) FROM parts
  UNION ALL SELECT 'effort', count(*) - count(effort), count(CASE WHEN effort <> 0 THEN 1 END), count(*) FROM parts)
SELECT CASE WHEN metric = 'price' THEN 'money' ELSE 'form' END AS category, metric, round(mic, 6) AS mic FROM mics JOIN prof USING (metric) WHERE round(na / n, 3) < 0.5 AND nz > 100
QUALIFY row_number() OVER (PARTITION BY CASE WHEN metric = 'price' THEN 'money' ELSE 'form' END ORDER BY mic DESC, metric) <= 1""")
def _(t):
    prof = A.screen_metrics(A.profile(V.part_covariates(t), ["size", "price", "effort"]))
    s = C.select_metrics(_mic(t), prof, {"size": "form", "effort": "form", "price": "money"}, 1)
    return s.select("category", "metric", F.round("mic", 6).alias("mic"))


@query("collinear_pairs", """
WITH d AS (SELECT l_partkey AS k, sum(l_quantity) AS qty, count(*) AS n_lines, avg(l_discount) AS disc, sum(l_extendedprice) AS price FROM lineitem GROUP BY 1),
prs AS (SELECT 'qty' AS x, 'n_lines' AS y, qty AS xv, CAST(n_lines AS DOUBLE) AS yv FROM d UNION ALL SELECT 'qty', 'price', qty, price FROM d UNION ALL SELECT 'n_lines', 'price', n_lines, price FROM d),
rnk AS (SELECT x, y, rank() OVER (PARTITION BY x, y ORDER BY xv) + (count(*) OVER (PARTITION BY x, y, xv) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY x, y ORDER BY yv) + (count(*) OVER (PARTITION BY x, y, yv) - 1) / 2.0 AS ry FROM prs)
SELECT x, y, round(corr(rx, ry), 6) AS r, 'volume' AS category FROM rnk GROUP BY 1, 2 HAVING abs(corr(rx, ry)) > 0.7""")
def _(t):
    d = t.lineitem.groupBy("l_partkey").agg(F.sum("l_quantity").alias("qty"), A.n_rows().alias("n_lines"), F.avg("l_discount").alias("disc"), F.sum("l_extendedprice").alias("price"))
    return C.collinear(d, {"qty": "volume", "n_lines": "volume", "disc": "rate", "price": "volume"}).withColumn("r", F.round("r", 6))


# ---- strata and weights --------------------------------------------------------------

def _frame(t):
    return t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderstatus").alias("species"), F.col("c_nationkey").alias("watershed"), F.col("c_mktsegment").alias("stratum"), F.col("o_totalprice").alias("length"), "c_custkey")


_FRAME = "frame AS (SELECT o_orderstatus AS species, c_nationkey AS watershed, c_mktsegment AS stratum, o_totalprice AS length, c_custkey FROM orders JOIN customer ON o_custkey = c_custkey)"
_EXTRA = "extra AS (SELECT 'P' AS species, n_nationkey AS watershed, 'EXTRA' AS stratum, 12.0 AS km FROM nation)"
_STRATA = f"""{_FRAME}, {_EXTRA}, lens AS (SELECT species, watershed, stratum, sum(length) / 1000 AS km FROM frame GROUP BY 1, 2, 3 UNION ALL SELECT * FROM extra),
sites AS (SELECT species, watershed, stratum, count(DISTINCT c_custkey) AS n_sites FROM frame WHERE c_custkey % 3 = 0 GROUP BY 1, 2, 3),
tab AS (SELECT coalesce(l.species, s.species) AS species, coalesce(l.watershed, s.watershed) AS watershed, coalesce(l.stratum, s.stratum) AS stratum, coalesce(n_sites, 0) AS n_sites, km,
  CASE WHEN n_sites > 0 THEN km / n_sites END AS site_weight FROM lens l FULL JOIN sites s ON l.species = s.species AND l.watershed = s.watershed AND l.stratum = s.stratum)"""


def _lengths(t):
    extra = t.nation.select(F.lit("P").alias("species"), F.col("n_nationkey").alias("watershed"), F.lit("EXTRA").alias("stratum"), F.lit(12.0).alias("tot_length_km"))
    return G.strata_length(_frame(t), ["species", "watershed", "stratum"], "length", extra)


def _strata(t):
    return G.strata_table(_frame(t).where("c_custkey % 3 = 0"), _lengths(t), ["species", "watershed", "stratum"], "c_custkey")


@query("site_strata", """
WITH s AS (SELECT c_custkey, CAST(c_nationkey AS VARCHAR) AS watershed, CASE WHEN c_nationkey = 3 THEN right(c_name, 2) WHEN c_nationkey = 7 AND regexp_matches(c_name, '1$') THEN 'IMW_' || right(c_name, 3)
  ELSE nullif(c_mktsegment, 'FURNITURE') END AS strata FROM customer)
SELECT c_custkey, watershed, watershed || '_' || regexp_replace(strata, '[0-9]$', '') AS strata FROM s WHERE strata IS NOT NULL""")
def _(t):
    c = t.customer.withColumn("watershed", F.col("c_nationkey").cast("string"))
    attrs = c.select("c_custkey", F.nullif("c_mktsegment", F.lit("FURNITURE")).alias("segment"))
    code = F.lpad(F.col("c_custkey").cast("string"), 9, "0")
    rules = [(F.col("watershed") == "3", F.right(code, F.lit(2))),
             ((F.col("watershed") == "7") & code.rlike("1$"), F.concat(F.lit("IMW_"), F.right(code, F.lit(3))))]
    return G.site_strata(c, attrs, "c_custkey", "watershed", "segment", rules, "[0-9]$")


@query("strata_length", f"WITH {_FRAME}, {_EXTRA} SELECT species, watershed, stratum, round(sum(length) / 1000, 6) AS tot_length_km FROM frame GROUP BY 1, 2, 3 UNION ALL SELECT * FROM extra")
def _(t):
    return _lengths(t).withColumn("tot_length_km", F.round("tot_length_km", 6))


@query("design_weights", f"""WITH {_STRATA},
site AS (SELECT DISTINCT species, watershed, CASE WHEN c_custkey % 6 = 0 THEN stratum END AS stratum, c_custkey, CAST(c_custkey % 90 + 10 AS DOUBLE) AS len FROM frame WHERE c_custkey % 3 = 0),
w AS (SELECT s.*, coalesce(t.site_weight, len / 1000) AS wt FROM site s LEFT JOIN tab t ON t.species = s.species AND t.watershed = s.watershed AND t.stratum = s.stratum)
SELECT species, watershed, c_custkey, round(wt, 9) AS site_weight, round(wt / sum(wt) OVER (PARTITION BY species, watershed), 8) AS adj_weight FROM w""")
def _(t):
    sites = _frame(t).where("c_custkey % 3 = 0").select("species", "watershed", F.when(F.col("c_custkey") % 6 == 0, F.col("stratum")).alias("stratum"), "c_custkey",
                                                         (F.col("c_custkey") % 90 + 10).cast("double").alias("len")).distinct()
    w = G.design_weights(sites, _strata(t), ["species", "watershed", "stratum"], ["species", "watershed"], "len")
    return w.select("species", "watershed", "c_custkey", F.round("site_weight", 9).alias("site_weight"), F.round("adj_weight", 8).alias("adj_weight"))


@query("frame_coverage", f"""WITH {_STRATA}
SELECT species, watershed, round(coalesce(sum(km), 0), 6) AS tot_length_km, round(coalesce(sum(CASE WHEN n_sites = 0 THEN km END), 0), 6) AS missing_length,
  round(coalesce(coalesce(sum(CASE WHEN n_sites = 0 THEN km END), 0) / sum(km), 0), 6) AS perc_missing FROM tab GROUP BY 1, 2""")
def _(t):
    c = G.frame_coverage(_strata(t), ["species", "watershed"])
    return c.withColumns({x: F.round(x, 6) for x in ("tot_length_km", "missing_length", "perc_missing")})


# ---- linear models -------------------------------------------------------------------

def _lm_data(t):
    """Orders as sites: log price on standardised covariates, strata by nation, weights by priority."""
    d = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(
        "o_orderkey", F.col("o_orderstatus").alias("species"), F.col("c_nationkey").alias("watershed"),
        F.ln("o_totalprice").alias("y"), F.when(F.col("o_orderkey") % 7 != 0, F.col("c_acctbal") / 1000).alias("x1"),
        F.when(F.col("o_orderkey") % 11 != 0, (F.col("o_orderkey") % 97) / 10.0).alias("x2"),
        (F.substring("o_orderpriority", 1, 1).cast("double") / 10).alias("w"), "c_mktsegment", "o_orderpriority")
    return d


_LM = """lm AS (SELECT o_orderkey, o_orderstatus AS species, c_nationkey AS watershed, ln(o_totalprice) AS y, CASE WHEN o_orderkey % 7 <> 0 THEN c_acctbal / 1000 END AS x1, CASE WHEN o_orderkey % 11 <> 0 THEN (o_orderkey % 97) / 10.0 END AS x2,
  CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) / 10 AS w FROM orders JOIN customer ON o_custkey = c_custkey),
mom AS (SELECT species, sum(w * x1 * x1) AS a, sum(w * x1 * x2) AS b, sum(w * x2 * x2) AS d, sum(w * x1 * y) AS p, sum(w * x2 * y) AS q FROM lm WHERE x1 IS NOT NULL AND x2 IS NOT NULL GROUP BY 1),
cf AS (SELECT species, (d * p - b * q) / (a * d - b * b) AS b1, (a * q - b * p) / (a * d - b * b) AS b2, a, b, d FROM mom)"""


@query("weighted_glm", f"WITH {_LM} SELECT species, round(b1, 6) AS b1, round(b2, 6) AS b2 FROM cf")
def _(t):
    x, _names = G.design_array(["x1", "x2"], {})
    fit = G.svy_lm(_lm_data(t), "y", x, 2, "w", ["species"])
    return fit.select("species", F.round(F.col("coef")[0], 6).alias("b1"), F.round(F.col("coef")[1], 6).alias("b2"))


_VC = f"""{_LM}, m1 AS (SELECT species, sum(w * x2 * x2) AS a, sum(w * x2 * y) / sum(w * x2 * x2) AS b FROM lm GROUP BY 1),
u AS (SELECT lm.species, CASE WHEN o_orderkey % 1000 = 0 THEN o_orderkey ELSE watershed END AS st, w * x2 * (y - b * x2) AS u FROM lm JOIN m1 ON m1.species = lm.species WHERE x2 IS NOT NULL),
h AS (SELECT species, st, count(*) AS n, sum(u) AS s1, sum(u * u) AS s2 FROM u GROUP BY 1, 2),
g AS (SELECT *, sum(s1) OVER (PARTITION BY species) / sum(n) OVER (PARTITION BY species) AS gm FROM h),
v AS (SELECT species, sum(CASE WHEN n > 1 THEN n / (n - 1) * (s2 - s1 * s1 / n) ELSE 0 END) AS certain, sum(CASE WHEN n > 1 THEN n / (n - 1) * (s2 - s1 * s1 / n) ELSE pow(s1 - gm, 2) END) AS adjust FROM g GROUP BY 1)"""


@query("design_variance", f"WITH {_VC} SELECT v.species, round(b, 6) AS b, round(sqrt(certain) / a, 8) AS se_certainty, round(sqrt(adjust) / a, 8) AS se_adjust FROM v JOIN m1 ON m1.species = v.species")
def _(t):
    d = _lm_data(t).withColumn("st", F.when(F.col("o_orderkey") % 1000 == 0, F.col("o_orderkey")).otherwise(F.col("watershed").cast("bigint")))
    x, _names = G.design_array(["x2"], {})
    fit = G.svy_lm(d, "y", x, 1, "w", ["species"])
    se = lambda how: G.design_vcov(d, fit, "y", x, 1, "w", "st", ["species"], how)
    a = se("certainty").select("species", F.round(F.col("coef")[0], 6).alias("b"), F.round(F.sqrt(F.col("vcov")[0][0]), 8).alias("se_certainty"))
    return J.natural_join(a, se("adjust").select("species", F.round(F.sqrt(F.col("vcov")[0][0]), 8).alias("se_adjust")), "inner", ["species"])


@query("lognormal_predict", f"""WITH {_VC}
SELECT o_orderkey, round(b * x2, 6) AS log_fit, round(x2 * sqrt(certain) / a, 8) AS log_se, round(exp(b * x2) * (1 + pow(x2 * sqrt(certain) / a, 2) / 2), 4) AS pred_cap
FROM lm JOIN v ON v.species = lm.species JOIN m1 ON m1.species = lm.species""")
def _(t):
    d = _lm_data(t).withColumn("st", F.when(F.col("o_orderkey") % 1000 == 0, F.col("o_orderkey")).otherwise(F.col("watershed").cast("bigint")))
    x, _names = G.design_array(["x2"], {})
    fit = G.design_vcov(d, G.svy_lm(d, "y", x, 1, "w", ["species"]), "y", x, 1, "w", "st", ["species"])
    p = G.predict_lm(d, fit, x, ["species"])
    return p.select("o_orderkey", F.round("fit", 6).alias("log_fit"), F.round("fit_se", 8).alias("log_se"), F.round("pred_cap", 4).alias("pred_cap"))


@query("extrapolation_model")
def _(t):
    """Covariates, a factor and a watershed effect together, predicted for every order."""
    d = _lm_data(t)
    x, names = G.design_array(["x1", "x2"], {"o_orderpriority": G.levels(d, "o_orderpriority"), "c_mktsegment": G.levels(d, "c_mktsegment")})
    fit = G.design_vcov(d, G.svy_lm(d, "y", x, len(names), "w", ["species"]), "y", x, len(names), "w", "watershed", ["species"])
    return G.predict_lm(d, fit, x, ["species"]).select("o_orderkey", "species", "fit", "fit_se", "pred_cap", "pred_se")


@query("level_guard", """SELECT s_suppkey, s_nationkey FROM supplier WHERE s_nationkey IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9900)""")
def _(t):
    train = t.customer.where("c_acctbal > 9900").withColumnRenamed("c_nationkey", "s_nationkey")
    return G.seen_levels(t.supplier, train, "s_nationkey").select("s_suppkey", "s_nationkey")


@query("watershed_of_reach", """SELECT l_orderkey, l_linenumber, l_suppkey, w FROM lineitem LEFT JOIN (SELECT s_suppkey, max(s_nationkey) AS w FROM supplier WHERE s_acctbal > 0 GROUP BY 1) ON s_suppkey = l_suppkey""")
def _(t):
    bridge = t.supplier.where("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("w"))
    return G.assign_by_bridge(t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey"), bridge, "l_suppkey", "w")


@query("reach_prediction_table", """
WITH p AS (SELECT l_suppkey AS reach_id, CASE l_linestatus WHEN 'F' THEN 'chnk' ELSE 'sthd' END AS species, CASE WHEN l_linenumber <= 3 THEN 'per_m' ELSE 'per_m2' END AS kind, round(avg(l_quantity), 6) AS response,
  round(stddev_samp(l_quantity), 6) AS se FROM lineitem GROUP BY 1, 2, 3)
SELECT reach_id, max(response) FILTER (WHERE species = 'chnk' AND kind = 'per_m') AS chnk_per_m, max(se) FILTER (WHERE species = 'chnk' AND kind = 'per_m') AS chnk_per_m_se,
  max(response) FILTER (WHERE species = 'chnk' AND kind = 'per_m2') AS chnk_per_m2, max(se) FILTER (WHERE species = 'chnk' AND kind = 'per_m2') AS chnk_per_m2_se,
  max(response) FILTER (WHERE species = 'sthd' AND kind = 'per_m') AS sthd_per_m, max(se) FILTER (WHERE species = 'sthd' AND kind = 'per_m') AS sthd_per_m_se,
  max(response) FILTER (WHERE species = 'sthd' AND kind = 'per_m2') AS sthd_per_m2, max(se) FILTER (WHERE species = 'sthd' AND kind = 'per_m2') AS sthd_per_m2_se FROM p GROUP BY 1""")
def _(t):
    p = t.lineitem.groupBy(F.col("l_suppkey").alias("reach_id"), S.recode("l_linestatus", {"F": "chnk", "O": "sthd"}).alias("species"),
                           F.when(F.col("l_linenumber") <= 3, "per_m").otherwise("per_m2").alias("kind")).agg(
        F.round(F.avg("l_quantity"), 6).alias("response"), F.round(F.stddev_samp("l_quantity"), 6).alias("SE"))
    return G.reach_table(p, ["reach_id"], "species", "kind", [(s, k) for s in ("chnk", "sthd") for k in ("per_m", "per_m2")], "response", "SE")


@query("covariate_coverage", """
WITH l AS (SELECT l_orderkey, l_suppkey, l_returnflag AS huc, 'l_quantity' AS metric, l_quantity AS v FROM lineitem UNION ALL SELECT l_orderkey, l_suppkey, l_returnflag, 'l_extendedprice', l_extendedprice FROM lineitem),
b AS (SELECT metric, min(v) AS lo, max(v) AS hi FROM l WHERE l_suppkey % 50 = 0 AND v > 5 GROUP BY 1),
k AS (SELECT l.metric, huc, lo, hi, l_orderkey, max((v BETWEEN lo AND hi)::INT) AS i, max((NOT v BETWEEN lo AND hi)::INT) AS o, max(v) AS mx, min(v) AS mn FROM l JOIN b ON b.metric = l.metric GROUP BY 1, 2, 3, 4, 5)
SELECT metric, huc, count(*) AS n, CAST(sum(i) AS BIGINT) AS n_in, CAST(sum(o) AS BIGINT) AS n_out, round(sum(i) / count(*), 6) AS pct_in, round(CASE WHEN max(mx) > max(hi) THEN (max(mx) - max(hi)) / max(hi) END, 6) AS pct_max_over,
  round(CASE WHEN min(mn) < min(lo) THEN (min(mn) - min(lo)) / min(lo) END, 6) AS pct_min_under FROM k GROUP BY 1, 2""")
def _(t):
    d = t.lineitem.withColumnRenamed("l_returnflag", "huc")
    ref = d.where("l_suppkey % 50 = 0").select(*[F.when(F.col(c) > 5, F.col(c)).alias(c) for c in ("l_quantity", "l_extendedprice")])
    c = G.covariate_coverage(d, "l_orderkey", ["huc"], ["l_quantity", "l_extendedprice"], ref)
    return c.withColumns({x: F.round(x, 6) for x in ("pct_in", "pct_max_over", "pct_min_under")})


# ---- folds and comparisons -----------------------------------------------------------

_FOLD = "CAST(CAST('0x' || substr(md5(CAST(o_orderkey AS VARCHAR) || '-8'), 1, 8) AS BIGINT) % 10 AS INTEGER)"


def _both_parts(m, *keys):
    """One row for the test and one for the training rows of a fold."""
    part = lambda name: F.struct(F.lit(name).alias("part"), F.col(f"{name}_n").alias("n"), F.round(F.col(f"{name}_p") / F.col(f"{name}_n"), 4).alias("mean_price"))
    return m.select(*keys, F.inline(F.array(part("test"), part("train")))).where("n > 0")


def _price(t):
    return {"n": A.n_rows(), "p": F.sum("o_totalprice")}


@query("kfold_split", f"""WITH o AS (SELECT o_orderkey, o_orderstatus, o_totalprice, {_FOLD} AS own FROM orders)
SELECT o_orderstatus, CAST(f AS INTEGER) AS fold, CASE WHEN own = f THEN 'test' ELSE 'train' END AS part, count(*) AS n, round(avg(o_totalprice), 4) AS mean_price FROM o, range(0, 10) r(f) GROUP BY 1, 2, 3""")
def _(t):
    return _both_parts(G.fold_moments(G.kfold(t.orders, 10, "o_orderkey"), _price(t), ["o_orderstatus"]), "o_orderstatus", "fold")


@query("leave_group_out", """
SELECT f.p AS fold, CASE WHEN o_orderpriority = f.p THEN 'test' ELSE 'train' END AS part, count(*) AS n, round(avg(o_totalprice), 4) AS mean_price
FROM orders, (SELECT DISTINCT o_orderpriority AS p FROM orders) f GROUP BY 1, 2""")
def _(t):
    return _both_parts(G.fold_moments(G.leave_one_group_out(t.orders, "o_orderpriority"), _price(t)), "fold")


@query("fold_models", f"""WITH o AS (SELECT o_orderstatus, ln(o_totalprice) AS y, c_acctbal / 1000 AS x, {_FOLD} AS own FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT o_orderstatus, CAST(f AS INTEGER) AS fold, count(*) AS n_train, round(regr_intercept(y, x), 6) AS intercept, round(regr_slope(y, x), 6) AS slope FROM o, range(0, 10) r(f) WHERE own <> f GROUP BY 1, 2""")
def _(t):
    d = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "o_orderstatus", F.ln("o_totalprice").alias("y"), (F.col("c_acctbal") / 1000).alias("x"))
    x, names = G.design_array(["x"], {}, intercept=True)
    m = G.fold_models(G.kfold(d, 10, "o_orderkey"), "y", x, len(names), ["o_orderstatus"])
    return m.select("o_orderstatus", "fold", "n_train", F.round(F.col("coef")[0], 6).alias("intercept"), F.round(F.col("coef")[1], 6).alias("slope"))


@query("cv_stats", f"""
WITH p AS (SELECT o_orderstatus AS species, {_FOLD} AS fold, o_totalprice AS obs, o_totalprice * (0.9 + (o_orderkey % 7) / 30.0) AS pred, 1000.0 + o_orderkey % 5000 AS se FROM orders),
f AS (SELECT species, fold, avg(obs) AS avg_obs, median(se) AS median_se, median(se / pred) AS median_cv, avg(obs - pred) AS bias, avg(abs(obs - pred)) AS abs_bias, avg((obs - pred) / obs) AS rel_bias, avg(abs((obs - pred) / obs)) AS rel_abs_bias,
  avg((obs <= pred + 1.959963984540054 * se AND obs >= pred - 1.959963984540054 * se)::INT) AS cover95, sqrt(avg(pow(obs - pred, 2))) AS rmse, sqrt(avg(pow(obs - pred, 2))) / avg(obs) AS cv_rmse,
  sqrt(avg(pow(obs - pred, 2))) / (quantile_cont(obs, 0.75) - quantile_cont(obs, 0.25)) AS nrmse FROM p GROUP BY 1, 2)
SELECT species, round(avg(avg_obs), 4) AS avg_obs, round(avg(median_se), 4) AS median_se, round(avg(median_cv), 6) AS median_cv, round(avg(bias), 4) AS bias, round(avg(abs_bias), 4) AS abs_bias, round(avg(rel_bias), 6) AS rel_bias,
  round(avg(rel_abs_bias), 6) AS rel_abs_bias, round(avg(cover95), 6) AS cover95, round(avg(rmse), 4) AS rmse, round(avg(cv_rmse), 6) AS cv_rmse, round(avg(nrmse), 6) AS nrmse FROM f GROUP BY 1""")
def _(t):
    p = t.orders.select(F.col("o_orderstatus").alias("species"), G.fold_of("o_orderkey", 10).alias("fold"), F.col("o_totalprice").alias("obs"),
                        (F.col("o_totalprice") * (F.lit(0.9) + (F.col("o_orderkey") % 7) / 30.0)).alias("pred"), (F.lit(1000.0) + F.col("o_orderkey") % 5000).alias("se"))
    s = G.cv_stats(p, ["species"], "fold", "obs", "pred", "se")
    six = ("median_cv", "rel_bias", "rel_abs_bias", "cover95", "cv_rmse", "nrmse")
    return s.select("species", *[F.round(c, 6 if c in six else 4).alias(c) for c in s.columns[1:]])


@query("model_comparison", """
WITH w AS (SELECT l_partkey AS k, avg(l_quantity) AS lm, avg(l_extendedprice / 1000) AS rf, median(l_quantity) AS survey FROM lineitem GROUP BY 1),
prs AS (SELECT 'lm' AS x, 'rf' AS y, lm AS xv, rf AS yv FROM w UNION ALL SELECT 'lm', 'survey', lm, survey FROM w UNION ALL SELECT 'rf', 'survey', rf, survey FROM w),
rnk AS (SELECT x, y, rank() OVER (PARTITION BY x, y ORDER BY xv) + (count(*) OVER (PARTITION BY x, y, xv) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY x, y ORDER BY yv) + (count(*) OVER (PARTITION BY x, y, yv) - 1) / 2.0 AS ry FROM prs)
SELECT 'pearson' AS method, x, y, round(corr(xv, yv), 6) AS r FROM prs GROUP BY 2, 3 UNION ALL SELECT 'spearman', x, y, round(corr(rx, ry), 6) FROM rnk GROUP BY 2, 3""")
def _(t):
    q = t.lineitem
    preds = {"lm": q.groupBy("l_partkey").agg(F.avg("l_quantity").alias("pred")), "rf": q.groupBy("l_partkey").agg(F.avg(F.col("l_extendedprice") / 1000).alias("pred")),
             "survey": A.quantiles(q, ["l_partkey"], "l_quantity", {"pred": 0.5})}
    long = R.stack([d.withColumn("model", F.lit(m)) for m, d in preds.items()])
    wide = R.pivot(long, ["l_partkey"], "model", list(preds), {"pred": F.max}, "{level}")
    return R.stack([C.corr_long(wide, list(preds), m).select(F.lit(m).alias("method"), "x", "y", F.round("r", 6).alias("r")) for m in ("pearson", "spearman")])
