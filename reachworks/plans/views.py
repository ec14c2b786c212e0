"""Domain views over the star-schema tables: visits, surveys, passes, reaches, points, streams, polygons.

Each view has an SQL twin so that a query and its check start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reachworks.operators.frames import pivot
from reachworks.sources.tables import vertices_to_segments


def depletion_passes(t) -> DataFrame:
    """Catch per (part, flag) and pass; parts stand for site visits, flags for species."""
    return pivot(t.lineitem.where("l_linenumber <= 4"), ["l_partkey", "l_returnflag"], "l_linenumber", [1, 2, 3, 4],
                 {"l_quantity": F.sum}, "pass{level}")


PASSES_SQL = """passes AS (
  SELECT l_partkey, l_returnflag,
    sum(l_quantity) FILTER (WHERE l_linenumber = 1) AS pass1, sum(l_quantity) FILTER (WHERE l_linenumber = 2) AS pass2,
    sum(l_quantity) FILTER (WHERE l_linenumber = 3) AS pass3, sum(l_quantity) FILTER (WHERE l_linenumber = 4) AS pass4
  FROM lineitem WHERE l_linenumber <= 4 GROUP BY 1, 2)"""


def part_covariates(t) -> DataFrame:
    """Parts with injected gaps as covariates and mean unit price as the response."""
    resp = t.lineitem.groupBy("l_partkey").agg(F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("dens"),
                                               F.sum("l_quantity").alias("effort"))
    p = t.part.select(
        "p_partkey", "p_brand", "p_type",
        F.when(F.col("p_partkey") % 7 != 0, F.col("p_size")).cast("double").alias("size"),
        F.when(F.col("p_partkey") % 11 != 0, F.col("p_retailprice")).alias("price"))
    return p.join(resp, p.p_partkey == resp.l_partkey).drop("l_partkey")


PARTS_SQL = """parts AS (
  SELECT p_partkey, p_brand, p_type,
    CAST(CASE WHEN p_partkey % 7 <> 0 THEN p_size END AS DOUBLE) AS size,
    CASE WHEN p_partkey % 11 <> 0 THEN p_retailprice END AS price, dens, effort
  FROM part JOIN (SELECT l_partkey, avg(l_extendedprice / l_quantity) AS dens, sum(l_quantity) AS effort
                  FROM lineitem GROUP BY 1) r ON l_partkey = p_partkey)"""


def reaches(t) -> DataFrame:
    """Line items as stream reaches with density, its error, length and their place in the hierarchy."""
    return (
        t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("reach_id"), F.col("l_quantity").alias("length"),
            (F.col("l_extendedprice") / F.col("l_quantity") / 1000).alias("cap"),
            (F.col("l_extendedprice") / F.col("l_quantity") / 1000 * F.col("l_discount")).alias("se"),
            (F.col("l_returnflag") != "R").alias("in_domain"), F.col("n_name").alias("stream"),
            F.col("r_name").alias("watershed"), F.col("l_linestatus").alias("species"),
            F.col("o_orderpriority").alias("lifestage"))
    )


REACHES_SQL = """reaches AS (
  SELECT l_orderkey * 10 + l_linenumber AS reach_id, l_quantity AS length, l_extendedprice / l_quantity / 1000 AS cap,
    l_extendedprice / l_quantity / 1000 * l_discount AS se, l_returnflag <> 'R' AS in_domain, n_name AS stream,
    r_name AS watershed, l_linestatus AS species, o_orderpriority AS lifestage
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def points(t) -> DataFrame:
    return t.customer.select(
        F.col("c_custkey").alias("point_id"), F.col("c_acctbal").alias("x"),
        (F.col("c_custkey") * 37 % 10000).cast("double").alias("y"), "c_nationkey", "c_mktsegment")


POINTS_SQL = """points AS (
  SELECT c_custkey AS point_id, c_acctbal AS x, CAST(c_custkey * 37 % 10000 AS DOUBLE) AS y, c_nationkey, c_mktsegment
  FROM customer)"""


def segments(t) -> DataFrame:
    """Suppliers of a nation, in key order, are the vertices of its stream."""
    v = t.supplier.select(F.col("s_nationkey").alias("line_id"), "s_suppkey", F.col("s_acctbal").alias("x"),
                          (F.col("s_suppkey") * 91 % 10000).cast("double").alias("y"))
    return vertices_to_segments(v, ["line_id"], "s_suppkey", "x", "y")


SEGMENTS_SQL = """verts AS (
  SELECT s_nationkey AS line_id, s_suppkey, s_acctbal AS x, CAST(s_suppkey * 91 % 10000 AS DOUBLE) AS y FROM supplier),
segs AS (
  SELECT * FROM (SELECT line_id, s_suppkey AS seg_no, x AS x1, y AS y1,
    lead(x) OVER (PARTITION BY line_id ORDER BY s_suppkey) AS x2,
    lead(y) OVER (PARTITION BY line_id ORDER BY s_suppkey) AS y2 FROM verts) WHERE x2 IS NOT NULL)"""

# A square, a triangle and an L-shape over [-1000, 10000]^2.
RINGS = {
    "ell": [(1000.5, 5000.5), (8000.5, 5000.5), (8000.5, 6500.5), (3500.5, 6500.5), (3500.5, 9500.5), (1000.5, 9500.5)],
    "square": [(0.5, 0.5), (4000.5, 0.5), (4000.5, 4000.5), (0.5, 4000.5)],
    "triangle": [(5000.5, 500.5), (9500.5, 500.5), (7000.5, 4500.5)],
}


# A plot of land around every customer, every third with a pond; x, y and k stand for its place and key.
_PLOT = [("x - 60.25", "y - 40.25"), ("x + 100.25 + k % 50", "y - 30.25"), ("x + 80.25", "y + 90.25 + k % 30"), ("x - 50.25", "y + 70.25")]
_POND = [("x + 10.25", "y + 10.25"), ("x + 30.25", "y + 40.25"), ("x + 40.25", "y + 12.25")]
# A lake district, one ring with an island of another polygon's land cut out.
SHIELD = [[(2000.5, 1500.5), (9000.5, 1000.5), (9500.5, 9000.5), (6000.5, 7000.5), (2500.5, 9500.5)], [(4000.5, 3000.5), (4500.5, 6000.5), (7000.5, 5500.5), (6500.5, 2500.5)]]


def polygons(t) -> DataFrame:
    """Rings of parts and holes: the fixed shapes, one with a hole, and a plot for every customer."""
    points = lambda ring: [{"x": x, "y": y} for x, y in ring]
    rows = [(name, [points(ring)]) for name, ring in RINGS.items()] + [("shield", [points(r) for r in SHIELD])]
    fixed = t.spark.createDataFrame(rows, "poly_id string, ring array<array<struct<x:double,y:double>>>")
    at = t.customer.select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("x"), (F.col("c_custkey") * 37 % 10000).cast("double").alias("y"))
    shape = lambda ring: F.array(*[F.struct(F.expr(x).alias("x"), F.expr(y).alias("y")) for x, y in ring])
    rings = F.when(F.col("k") % 3 == 0, F.array(shape(_PLOT), shape(_POND))).otherwise(F.array(shape(_PLOT)))
    return fixed.unionByName(at.select(F.concat(F.lit("plot "), F.col("k")).alias("poly_id"), rings.alias("ring")))


def _edges_sql() -> str:
    rows = []
    for name, rings in {**{n: [r] for n, r in RINGS.items()}, "shield": SHIELD}.items():
        for i, (a, b) in enumerate(pair for ring in rings for pair in zip(ring, ring[1:] + ring[:1])):
            rows.append(f"('{name}', {i}, CAST({a[0]} AS DOUBLE), CAST({a[1]} AS DOUBLE), "
                        f"CAST({b[0]} AS DOUBLE), CAST({b[1]} AS DOUBLE))")
    parts = ["SELECT * FROM (VALUES " + ", ".join(rows) + ")"]
    for ring, only in ((_PLOT, ""), (_POND, " WHERE k % 3 = 0")):
        parts += [f"SELECT 'plot ' || k, {i}, {a[0]}, {a[1]}, {b[0]}, {b[1]} FROM plots{only}" for i, (a, b) in enumerate(zip(ring, ring[1:] + ring[:1]))]
    return ("plots AS (SELECT c_custkey AS k, c_acctbal AS x, CAST(c_custkey * 37 % 10000 AS DOUBLE) AS y FROM customer), "
            "edges(poly_id, e, ax, ay, bx, by_) AS (" + " UNION ALL ".join(parts) + ")")


EDGES_SQL = _edges_sql()


def parcels(t) -> DataFrame:
    """A triangle around every customer, as (id, vertex array)."""
    x, y, k = F.col("c_acctbal"), (F.col("c_custkey") * 37 % 10000).cast("double"), F.col("c_custkey")
    pt = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    return t.customer.select(F.col("c_custkey").alias("poly_id"), F.array(
        pt(x, y), pt(x + 100.0 + k % 50, y), pt(x + 10.0, y + 80.0 + k % 30)).alias("ring"))
