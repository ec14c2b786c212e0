"""Spatial operators and watershed roll-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from reachworks.functions import scalars as S
from reachworks.operators import joins as J
from reachworks.operators import rollup as U
from reachworks.operators import spatial as K
from reachworks.plans import views as V
from reachworks.operators.spatial import ALBERS_LAT0, ALBERS_LAT1, ALBERS_LAT2, ALBERS_LON0, GRS80_A, GRS80_F
from reachworks.plans.registry import query, r4


def _albers_sql() -> str:
    e2 = GRS80_F * (2 - GRS80_F)
    q = lambda s: f"((1 - {e2}) * (({s}) / (1 - {e2} * ({s}) * ({s})) - ln((1 - sqrt({e2}) * ({s})) / (1 + sqrt({e2}) * ({s}))) / (2 * sqrt({e2}))))"
    m2 = lambda d: f"(pow(cos(radians({d})), 2) / (1 - {e2} * pow(sin(radians({d})), 2)))"
    q1, q2, q0 = (q(f"sin(radians({d}))") for d in (ALBERS_LAT1, ALBERS_LAT2, ALBERS_LAT0))
    return f"""WITH k AS (SELECT ({m2(ALBERS_LAT1)} - {m2(ALBERS_LAT2)}) / ({q2} - {q1}) AS n),
    k2 AS (SELECT n, {m2(ALBERS_LAT1)} + n * {q1} AS c, {q0} AS q0 FROM k),
    p AS (SELECT c_custkey, -125 + (c_custkey % 1500) / 100.0 AS lon, 42 + c_nationkey / 3.0 AS lat FROM customer),
    r AS (SELECT c_custkey, n, CAST(lon AS DOUBLE) AS lon, {GRS80_A} * sqrt(c - n * {q('sin(radians(lat))')}) / n AS rho, {GRS80_A} * sqrt(c - n * q0) / n AS rho0 FROM p, k2)
    SELECT c_custkey, round(rho * sin(n * radians(lon - {ALBERS_LON0})), 3) AS x, round(rho0 - rho * cos(n * radians(lon - {ALBERS_LON0})), 3) AS y FROM r"""


@query("project_albers", _albers_sql())
def _(t):
    p = t.customer.select("c_custkey", (F.lit(-125.0) + (F.col("c_custkey") % 1500) / 100.0).alias("lon"),
                          (F.lit(42.0) + F.col("c_nationkey") / 3.0).alias("lat"))
    x, y = K.to_albers("lon", "lat")
    return p.select("c_custkey", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


@query("segment_length", f"WITH {V.SEGMENTS_SQL} SELECT line_id, round(sum(sqrt(pow(x2 - x1, 2) + pow(y2 - y1, 2))), 4) AS length FROM segs GROUP BY 1")
def _(t):
    return K.line_length(V.segments(t), ["line_id"]).withColumn("length", F.round("length", 4))


PIP_SQL = f"""{V.POINTS_SQL}, {V.EDGES_SQL},
pip AS (SELECT point_id, x, y, c_nationkey, c_mktsegment, poly_id FROM points, edges
  GROUP BY 1, 2, 3, 4, 5, 6 HAVING sum(CASE WHEN (ay > y) <> (by_ > y) AND x < ax + (y - ay) * (bx - ax) / (by_ - ay) THEN 1 ELSE 0 END) % 2 = 1)"""


@query("point_in_polygon", f"WITH {PIP_SQL} SELECT point_id, poly_id FROM pip")
def _(t):
    return K.pip_join(V.points(t), V.polygons(t)).select("point_id", "poly_id")


SNAP_SQL = f"""{V.POINTS_SQL}, {V.SEGMENTS_SQL},
proj AS (SELECT point_id, x, y, line_id, seg_no, x1, y1, x2, y2,
  least(greatest(((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / (pow(x2 - x1, 2) + pow(y2 - y1, 2)), 0), 1) AS u FROM points, segs),
dist AS (SELECT *, x1 + u * (x2 - x1) AS px, y1 + u * (y2 - y1) AS py, sqrt(pow(x - x1 - u * (x2 - x1), 2) + pow(y - y1 - u * (y2 - y1), 2)) AS d FROM proj),
near AS (SELECT * FROM dist QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY d, line_id, seg_no) = 1)"""


@query("within_distance", f"WITH {SNAP_SQL} SELECT point_id FROM near WHERE d <= 200")
def _(t):
    return K.within_distance(V.points(t), V.segments(t), 200.0)


@query("snap_to_line", f"""WITH {SNAP_SQL}
SELECT point_id, line_id, round(d, 4) AS snap_dist, round(px, 4) AS snap_x, round(py, 4) AS snap_y FROM near WHERE d <= 500""")
def _(t):
    s = K.snap_points(V.points(t), V.segments(t), 500.0)
    return s.select("point_id", "line_id", r4("snap_dist"), r4("snap_x"), r4("snap_y"))


@query("nearest_reach", f"WITH {SNAP_SQL} SELECT point_id, line_id, round(d, 4) AS snap_dist FROM near")
def _(t):
    return K.nearest(V.points(t), V.segments(t)).select("point_id", "line_id", r4("snap_dist"))


@query("snap_quality", f"""WITH {SNAP_SQL},
j AS (SELECT near.point_id, near.line_id, d, CASE WHEN near.point_id % 5 = 0 THEN '(Missing)' ELSE p.n_name END AS pname, l.n_name AS lname
  FROM near JOIN customer ON c_custkey = near.point_id JOIN nation p ON p.n_nationkey = c_nationkey JOIN nation l ON l.n_nationkey = near.line_id WHERE d <= 500),
i AS (SELECT point_id, line_id, d, CASE WHEN pname <> lname AND pname <> '(Missing)' THEN 'Mismatch StreamName' WHEN pname = lname AND d > 100 THEN 'Large Snap Distance'
  WHEN pname = '(Missing)' AND d > 100 THEN 'Missing StreamName' END AS issue FROM j)
SELECT point_id, CASE WHEN issue IS NULL THEN CAST(line_id AS BIGINT) ELSE CAST(-1 AS BIGINT) END AS line_id, coalesce(issue, 'ok') AS issue FROM i
WHERE issue IS NULL OR issue <> 'Missing StreamName'""")
def _(t):
    names = t.nation.select(F.col("n_nationkey").alias("line_id"), F.col("n_name").alias("lname"))
    p = V.points(t).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        "point_id", F.when(F.col("point_id") % 5 == 0, "(Missing)").otherwise(F.col("n_name")).alias("pname"))
    s = K.snap_points(V.points(t), V.segments(t), 500.0).select("point_id", "line_id", "snap_dist").join(names, "line_id").join(p, "point_id")
    s = s.withColumn("issue", F.lit("ok")).withColumn("line_id", F.col("line_id").cast("bigint"))
    issues = K.snap_issues(s, "pname", "lname", "snap_dist")
    # Reviewed corrections: mismatches and far points move to reach -1, unnamed ones are dropped.
    fixed = issues.where("issue <> 'Missing StreamName'").withColumn("line_id", F.lit(-1).cast("bigint"))
    return J.anti(s, issues, ["point_id"]).unionByName(fixed.select(*s.columns)).select("point_id", "line_id", "issue")


CLIP_SQL = f"""{V.SEGMENTS_SQL}, {V.EDGES_SQL},
sides AS (SELECT line_id, seg_no, x1, y1, x2, y2, poly_id, ax, ay, bx, by_, (x2 - x1) * (ay - y1) - (y2 - y1) * (ax - x1) AS sa,
  (x2 - x1) * (by_ - y1) - (y2 - y1) * (bx - x1) AS sb FROM segs, edges),
hits AS (SELECT *, ((ax + sa / (sa - sb) * (bx - ax) - x1) * (x2 - x1) + (ay + sa / (sa - sb) * (by_ - ay) - y1) * (y2 - y1)) / (pow(x2 - x1, 2) + pow(y2 - y1, 2)) AS t
  FROM sides WHERE (sa >= 0) <> (sb >= 0)),
ord AS (SELECT *, row_number() OVER (PARTITION BY line_id, seg_no, poly_id ORDER BY t) AS rn FROM hits),
spans AS (SELECT a.line_id, a.seg_no, a.poly_id, a.rn, a.x1 + t0 * (a.x2 - a.x1) AS x1, a.y1 + t0 * (a.y2 - a.y1) AS y1, a.x1 + t1 * (a.x2 - a.x1) AS x2, a.y1 + t1 * (a.y2 - a.y1) AS y2
  FROM (SELECT o.*, least(greatest(o.t, 0), 1) AS t0, least(greatest(n.t, 0), 1) AS t1 FROM ord o JOIN ord n USING (line_id, seg_no, poly_id) WHERE n.rn = o.rn + 1 AND o.rn % 2 = 1) a WHERE t1 > t0),
clen AS (SELECT poly_id, line_id, sum(sqrt(pow(x2 - x1, 2) + pow(y2 - y1, 2))) AS length FROM spans GROUP BY 1, 2)"""


def _seg_ids(t):
    return V.segments(t).withColumn("reach_id", F.col("seg_no"))


@query("clip_reaches", f"""WITH {CLIP_SQL}
SELECT seg_no AS reach_id, poly_id FROM hits GROUP BY 1, 2 HAVING sum((t > 0)::INT) % 2 = 1 OR bool_or(t BETWEEN 0 AND 1)""")
def _(t):
    return K.clip_reaches(_seg_ids(t), V.polygons(t), "reach_id")


@query("clip_line_length", f"WITH {CLIP_SQL} SELECT poly_id, line_id, round(length, 4) AS length FROM clen")
def _(t):
    return K.length_in_polygon(V.segments(t), V.polygons(t), ["line_id"]).withColumn("length", F.round("length", 4))


@query("largest_overlap", f"""WITH {CLIP_SQL}
SELECT line_id, poly_id, round(length, 4) AS length FROM clen QUALIFY row_number() OVER (PARTITION BY line_id ORDER BY length DESC, poly_id) = 1 AND length >= 100""")
def _(t):
    return K.largest_overlap(V.segments(t), V.polygons(t), "line_id").withColumn("length", F.round("length", 4))


# A point is a corner iff the others leave a gap of more than half a turn around it; corners are then ordered by their direction from the first.
@query("group_hull", f"""WITH {V.POINTS_SQL}, p AS (SELECT DISTINCT c_nationkey, x, y FROM points),
a AS (SELECT p.c_nationkey, p.x, p.y, atan2(o.y - p.y, o.x - p.x) AS d FROM p JOIN p o ON o.c_nationkey = p.c_nationkey AND (o.x <> p.x OR o.y <> p.y)),
g AS (SELECT *, coalesce(lead(d) OVER w, min(d) OVER (PARTITION BY c_nationkey, x, y) + 2 * pi()) - d AS gap FROM a WINDOW w AS (PARTITION BY c_nationkey, x, y ORDER BY d)),
v AS (SELECT c_nationkey, x, y FROM g GROUP BY 1, 2, 3 HAVING max(gap) > pi() + 1e-12),
f AS (SELECT *, first_value(x) OVER w AS fx, first_value(y) OVER w AS fy FROM v WINDOW w AS (PARTITION BY c_nationkey ORDER BY x, y))
SELECT c_nationkey, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY CASE WHEN x = fx AND y = fy THEN -10 ELSE atan2(y - fy, x - fx) END) AS INTEGER) AS seq, x, y FROM f""")
def _(t):
    return K.convex_hull(V.points(t), "c_nationkey")


@query("polygon_set_membership", f"""WITH {PIP_SQL}
SELECT point_id FROM points WHERE point_id IN (SELECT point_id FROM pip) AND point_id NOT IN (SELECT point_id FROM pip WHERE poly_id = 'ell')""")
def _(t):
    polys = V.polygons(t)
    return K.member(V.points(t), "point_id", [polys], [polys.where("poly_id = 'ell'")]).select("point_id")


@query("flowline_filter", f"""WITH {CLIP_SQL}
SELECT seg_no AS reach_id, poly_id FROM hits WHERE line_id % 6 <= 3 AND poly_id = 'triangle' GROUP BY 1, 2 HAVING sum((t > 0)::INT) % 2 = 1 OR bool_or(t BETWEEN 0 AND 1)""")
def _(t):
    s = _seg_ids(t).withColumn("strm_order", F.col("line_id") % 6)
    return K.flowlines(s, "strm_order", 3, V.polygons(t).where("poly_id = 'triangle'"), "reach_id")


@query("polygon_area", """
SELECT c_custkey AS poly_id, round(abs((100 + c_custkey % 50) * (80 + c_custkey % 30)) / 2.0 / 1e6, 8) AS area FROM customer""")
def _(t):
    return K.polygon_area(V.parcels(t), ["poly_id"]).withColumn("area", F.round("area", 8))


# ---- roll-ups ------------------------------------------------------------------------

def _cap_points(t):
    d = t.orders.groupBy("o_custkey").agg((F.avg("o_totalprice") / 100000).alias("cap"), (F.stddev_samp("o_totalprice") / 1000000).alias("se"))
    return V.points(t).join(d, F.col("point_id") == F.col("o_custkey")).drop("o_custkey")


def _streams(t):
    return V.segments(t).withColumnRenamed("line_id", "stream")


V1_SQL = f"""{PIP_SQL}, {CLIP_SQL.replace(', ' + V.EDGES_SQL, '')},
dens AS (SELECT o_custkey, avg(o_totalprice) / 100000 AS cap, stddev_samp(o_totalprice) / 1000000 AS se FROM orders GROUP BY 1),
cpts AS (SELECT pip.*, cap, se FROM pip JOIN dens ON point_id = o_custkey),
proj AS (SELECT p.point_id, p.poly_id, s.line_id, cap, se, s.seg_no, s.rn, x, y, x1, y1, x2, y2,
  least(greatest(((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / (pow(x2 - x1, 2) + pow(y2 - y1, 2)), 0), 1) AS u FROM cpts p JOIN spans s ON p.poly_id = s.poly_id),
snapped AS (SELECT point_id, poly_id, line_id, cap, se, sqrt(pow(x - x1 - u * (x2 - x1), 2) + pow(y - y1 - u * (y2 - y1), 2)) AS d FROM proj
  QUALIFY row_number() OVER (PARTITION BY poly_id, point_id ORDER BY sqrt(pow(x - x1 - u * (x2 - x1), 2) + pow(y - y1 - u * (y2 - y1), 2)), line_id) = 1),
per AS (SELECT poly_id, line_id, count(DISTINCT point_id) AS n_pts, avg(cap) AS cap_per_m, avg(se) AS cap_per_m_se FROM snapped WHERE d <= 500 GROUP BY 1, 2),
strm AS (SELECT c.poly_id, c.line_id, coalesce(n_pts, 0) AS n_pts, cap_per_m, cap_per_m_se, length AS tot_length, cap_per_m * length AS tot_cap, cap_per_m_se * length AS tot_cap_se
  FROM clen c LEFT JOIN per p ON c.poly_id = p.poly_id AND c.line_id = p.line_id),
areas AS (SELECT poly_id, abs(sum(ax * by_ - bx * ay)) / 2 / 1e6 AS area FROM edges GROUP BY 1),
tot AS (SELECT poly_id, sum(n_pts) AS n_pts, sum(tot_length) AS tot_length, coalesce(sum(tot_cap), 0) AS tot_cap, sqrt(coalesce(sum(pow(tot_cap_se, 2)), 0)) AS tot_cap_se FROM strm
  WHERE poly_id IN (SELECT poly_id FROM cpts) GROUP BY 1)"""

_NUM = ("area", "n_pts", "tot_length", "tot_cap", "tot_cap_se")


@query("watershed_cap_points", f"""WITH {V1_SQL}
SELECT poly_id, CAST(line_id AS VARCHAR) AS stream, 0 AS is_total, CAST(n_pts AS BIGINT) AS n_pts, round(tot_length, 4) AS tot_length, round(cap_per_m, 4) AS cap_per_m,
  round(cap_per_m_se, 4) AS cap_per_m_se, round(tot_cap, 4) AS tot_cap, round(tot_cap_se, 4) AS tot_cap_se, CAST(NULL AS DOUBLE) AS area FROM strm WHERE poly_id IN (SELECT poly_id FROM cpts)
UNION ALL SELECT a.poly_id, 'Total', 1, CAST(t.n_pts AS BIGINT), round(t.tot_length, 4), round(m.cap_per_m, 4), round(m.cap_per_m_se, 4), round(t.tot_cap, 4), round(t.tot_cap_se, 4), round(area, 4)
FROM areas a LEFT JOIN tot t ON t.poly_id = a.poly_id LEFT JOIN (SELECT poly_id, sum(cap_per_m * tot_length) / sum(CASE WHEN cap_per_m IS NOT NULL THEN tot_length END) AS cap_per_m,
  sum(cap_per_m_se * tot_length) / sum(CASE WHEN cap_per_m_se IS NOT NULL THEN tot_length END) AS cap_per_m_se FROM strm GROUP BY 1) m ON m.poly_id = a.poly_id""")
def _(t):
    polys, pts = V.polygons(t), _cap_points(t)
    rows = U.watershed_cap(polys, pts, _streams(t), "stream", by_stream=True)
    return rows.select("poly_id", "stream", "is_total", "n_pts", *[r4(c) for c in (
        "tot_length", "cap_per_m", "cap_per_m_se", "tot_cap", "tot_cap_se", "area")])


@query("watershed_cap_reaches", f"""WITH {V.REACHES_SQL},
d AS (SELECT * REPLACE (CASE WHEN reach_id % 13 <> 0 THEN cap END AS cap) FROM reaches WHERE in_domain)
SELECT watershed, stream, 0 AS is_total, count(DISTINCT reach_id) AS n_rchs, round(sum(length), 4) AS tot_length, round(sum(length * cap), 6) AS tot_cap,
  round(sqrt(sum(pow(length * se, 2))), 4) AS tot_cap_se, count(DISTINCT CASE WHEN cap IS NULL THEN reach_id END) AS n_unknown FROM d GROUP BY 1, 2
UNION ALL SELECT watershed, 'Total', 1, count(DISTINCT reach_id), round(sum(length), 4), round(sum(length * cap), 6), round(sqrt(sum(pow(length * se, 2))), 4), count(DISTINCT CASE WHEN cap IS NULL THEN reach_id END) FROM d GROUP BY 1""")
def _(t):
    reaches = V.reaches(t).withColumn("cap", F.when(F.col("reach_id") % 13 != 0, F.col("cap")))
    w = U.watershed_cap_reaches(reaches, ["watershed"], "stream")
    return w.select("watershed", "stream", "is_total", "n_rchs", r4("tot_length"), F.round("tot_cap", 6).alias("tot_cap"), r4("tot_cap_se"), "n_unknown").orderBy(
        "watershed", "is_total", "stream")


def _with_empty(t):
    """The polygons and one per nation far off the network, so that some have nothing inside."""
    pt = lambda dx, dy: F.struct((F.lit(50000.0) + F.col("n_nationkey") * 100 + dx).alias("x"), F.lit(50000.0 + dy).alias("y"))
    far = t.nation.select(F.col("n_name").alias("poly_id"), F.array(F.array(pt(0, 0), pt(90, 0), pt(90, 90))).alias("ring"))
    return V.polygons(t).unionByName(far)


@query("empty_watershed", f"""WITH {V1_SQL}
SELECT a.poly_id, round(area, 6) AS area, CAST(n_pts AS BIGINT) AS n_pts, round(tot_length, 4) AS tot_length, round(tot_cap, 4) AS tot_cap, round(tot_cap_se, 4) AS tot_cap_se
FROM (SELECT * FROM areas UNION ALL SELECT n_name, 90 * 90 / 2.0 / 1e6 FROM nation) a LEFT JOIN tot t ON t.poly_id = a.poly_id""")
def _(t):
    polys, pts = _with_empty(t), _cap_points(t)
    tot = U.watershed_cap(polys, pts, _streams(t), "stream")
    return tot.select("poly_id", F.round("area", 6).alias("area"), "n_pts", r4("tot_length"), r4("tot_cap"), r4("tot_cap_se"))


def _supplier_caps(t):
    """Line items as capacities of the reach their supplier starts, by species and lifestage."""
    return t.lineitem.select(F.col("l_suppkey").alias("reach_id"), F.col("l_quantity").alias("length"),
                             (F.col("l_extendedprice") / F.col("l_quantity") / 1000).alias("cap"),
                             (F.col("l_extendedprice") / F.col("l_quantity") / 1000 * F.col("l_discount")).alias("se"),
                             (F.col("l_returnflag") != "R").alias("in_domain"), F.col("l_linestatus").alias("species"),
                             F.col("l_returnflag").alias("lifestage"))


_CAPS_SQL = """caps AS (SELECT l_suppkey AS reach_id, l_quantity AS length, l_extendedprice / l_quantity / 1000 AS cap, l_extendedprice / l_quantity / 1000 * l_discount AS se,
  l_returnflag <> 'R' AS in_domain, l_linestatus AS species, l_returnflag AS lifestage FROM lineitem),
inside AS (SELECT seg_no AS reach_id, poly_id FROM hits GROUP BY 1, 2 HAVING sum((t > 0)::INT) % 2 = 1 OR bool_or(t BETWEEN 0 AND 1))"""


@query("multi_watershed_rollup", f"""WITH {CLIP_SQL}, {_CAPS_SQL}
SELECT poly_id, species, lifestage, count(DISTINCT reach_id) AS n_rchs, round(sum(length), 4) AS tot_length, round(sum(length * cap), 6) AS tot_cap,
  round(sqrt(sum(pow(length * se, 2))), 4) AS tot_cap_se FROM inside JOIN caps USING (reach_id) WHERE in_domain GROUP BY 1, 2, 3""")
def _(t):
    r = U.rollup_all(V.polygons(t), _seg_ids(t), _supplier_caps(t), "reach_id", ["species", "lifestage"])
    return r.select("poly_id", "species", "lifestage", "n_rchs", r4("tot_length"), F.round("tot_cap", 6).alias("tot_cap"), r4("tot_cap_se"))


@query("trap_capacity", f"""WITH {CLIP_SQL}, {_CAPS_SQL},
x AS (SELECT CASE poly_id WHEN 'ell' THEN 'Ell River' ELSE poly_id END AS trap, species, count(DISTINCT reach_id) AS n_rch, sum(length) AS tot_length, sum(length * cap) AS cap,
  avg(CASE WHEN se <> 0 THEN se END) * sum(length) AS cap_se FROM inside JOIN caps USING (reach_id) GROUP BY 1, 2)
SELECT trap, species, n_rch, round(tot_length, 4) AS tot_length, round(cap, 4) AS cap, round(cap_se, 2) AS cap_se, round(cap_se / cap, 6) AS cap_cv FROM x""")
def _(t):
    caps = _supplier_caps(t).withColumn("se", S.null_if("se", F.col("se") == 0))
    inside = K.clip_reaches(_seg_ids(t), V.polygons(t), "reach_id").withColumn("trap", S.recode("poly_id", {"ell": "Ell River"}))
    out = U.trap_capacity(inside, ["trap", "species"], caps=caps)
    return out.select("trap", "species", "n_rch", r4("tot_length"), r4("cap"), F.round("cap_se", 2).alias("cap_se"), F.round("cap_cv", 6).alias("cap_cv"))
