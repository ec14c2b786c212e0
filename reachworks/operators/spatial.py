"""Planar joins on segment and polygon tables through grid-cell keys.

Points are (x, y) columns, lines a segment table (line id, seg_no, x1, y1, x2, y2), polygons one
row with a vertex array.  Every join is an equi-join on cells followed by the exact test; a cell
holding far more points than others is split by the adaptive skew join.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reachworks.operators import passing
from reachworks.operators.joins import anti, natural_join, spread_join
from reachworks.session import freeze

# GRS80 ellipsoid and the conterminous-US equal-area parameters (EPSG:5070).
GRS80_A = 6378137.0
GRS80_F = 1 / 298.257222101
ALBERS_LAT1, ALBERS_LAT2, ALBERS_LAT0, ALBERS_LON0 = 29.5, 45.5, 23.0, -96.0

# Largest polygon table sent to every executor.
EDGE_LIMIT = 500_000
# Cells are halved this often at most for small polygons, and a search radius is quartered.
DEEPEST = 12
# Cells a row of either side may come to when small polygons ask for small cells.
CELLS_A_ROW = 64
# Lines and points times polygons that one task compares as arrays, and the same where it returns the pairs.
TASK_TESTS = 50_000_000
TASK_RETURNS = 8_000_000


def to_albers(lon: str | Column, lat: str | Column) -> tuple[Column, Column]:
    """Degrees to equal-area metres (Snyder 1987, ellipsoidal forward equations)."""
    e2 = GRS80_F * (2 - GRS80_F)
    e = math.sqrt(e2)

    def q(sin_, ln):
        return (1 - e2) * (sin_ / (1 - e2 * sin_ * sin_) - ln((1 - e * sin_) / (1 + e * sin_)) / (2 * e))

    def m(phi: float) -> float:
        return math.cos(phi) / math.sqrt(1 - e2 * math.sin(phi) ** 2)

    p1, p2, p0 = (math.radians(v) for v in (ALBERS_LAT1, ALBERS_LAT2, ALBERS_LAT0))
    q1, q2, q0 = (q(math.sin(p), math.log) for p in (p1, p2, p0))
    n = (m(p1) ** 2 - m(p2) ** 2) / (q2 - q1)
    c = m(p1) ** 2 + n * q1
    rho0 = GRS80_A * math.sqrt(c - n * q0) / n
    lon, lat = (F.col(v) if isinstance(v, str) else v for v in (lon, lat))
    rho = F.lit(GRS80_A) * F.sqrt(F.lit(c) - F.lit(n) * q(F.sin(F.radians(lat)), F.ln)) / n
    theta = F.lit(n) * F.radians(lon - F.lit(ALBERS_LON0))
    return rho * F.sin(theta), F.lit(rho0) - rho * F.cos(theta)


# ---- lines and rings -----------------------------------------------------------------

def seg_length() -> Column:
    return F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))


def line_length(segs: DataFrame, ids: Sequence[str]) -> DataFrame:
    return segs.groupBy(*ids).agg(F.sum(seg_length()).alias("length"))


def ring_edges(ring: str | Column) -> Column:
    """Closed ring as an array of edges (ax, ay, bx, by)."""
    r = F.col(ring) if isinstance(ring, str) else ring
    n = F.size(r)
    at = lambda i: F.element_at(r, i)
    return F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(
        at(i)["x"].alias("ax"), at(i)["y"].alias("ay"),
        at(i % n + 1)["x"].alias("bx"), at(i % n + 1)["y"].alias("by")))


def _nested(polys: DataFrame, ring: str) -> bool:
    """Whether the column holds several rings: parts and holes, told apart by even and odd crossings."""
    return polys.schema[ring].dataType.simpleString().startswith("array<array")


def polygon_edges(polys: DataFrame, ring: str = "ring") -> Column:
    """All edges of a polygon of one ring, or of an array of rings, each closed by itself."""
    return F.flatten(F.transform(F.col(ring), lambda r: ring_edges(r))) if _nested(polys, ring) else ring_edges(ring)


def polygon_area(polys: DataFrame, ids: Sequence[str], ring: str = "ring") -> DataFrame:
    """Area in square kilometres for coordinates in metres; holes run the other way round than their part."""
    twice = F.aggregate(polygon_edges(polys, ring), F.lit(0.0), lambda s, e: s + e["ax"] * e["by"] - e["bx"] * e["ay"])
    return polys.select(*ids, (F.abs(twice) / 2 / 1e6).alias("area"))


def _with_box(polys: DataFrame, ring: str = "ring") -> DataFrame:
    points = F.flatten(ring) if _nested(polys, ring) else F.col(ring)
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return polys.withColumns({"__edges": polygon_edges(polys, ring), "px0": F.array_min(xs), "px1": F.array_max(xs),
                              "py0": F.array_min(ys), "py1": F.array_max(ys)})


def _number(v: float | Column) -> Column:
    return v if isinstance(v, Column) else F.lit(float(v))


def _cell(c: str | Column, size: float | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.floor(c / _number(size))


def _box_cells(df: DataFrame, x0, x1, y0, y1, size: float | Column) -> DataFrame:
    return df.withColumn("cx", F.explode(F.sequence(_cell(x0, size), _cell(x1, size)))).withColumn(
        "cy", F.explode(F.sequence(_cell(y0, size), _cell(y1, size))))


def _sent(df: DataFrame, edges: str) -> DataFrame:
    """Broadcast a polygon table whose counted rows and edges stay under EDGE_LIMIT (some 25 MB);
    a larger one is left to a shuffled join."""
    rows, n = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size(edges)), F.lit(0))).first()
    return F.broadcast(df) if rows <= EDGE_LIMIT and n <= EDGE_LIMIT else df


# ---- points and polygons -------------------------------------------------------------

def _halvings(cell: float) -> Column:
    """How often ``cell`` is halved for a box and still as long as its longer side."""
    side = F.greatest(F.col("px1") - F.col("px0"), F.col("py1") - F.col("py0"))
    return F.least(F.greatest(F.floor(F.log2(F.lit(float(cell)) / side)), F.lit(0)), F.lit(DEEPEST)).cast("int")


def _size(cell: float) -> Column:
    return F.lit(float(cell)) / F.pow(F.lit(2.0), F.col("__k"))


def _per_level(df: DataFrame, levels: Sequence[int]) -> DataFrame:
    """Every row once for each size of cell in use, at most ``DEEPEST`` and one."""
    return df.withColumn("__k", F.explode(F.array(*[F.lit(k) for k in levels])) if levels else F.lit(0))


def pip_join(points: DataFrame, polys: DataFrame, attrs: Sequence[str] = ("poly_id",), cell: float = 2000.0,
             ring: str = "ring") -> DataFrame:
    """Points inside polygons with the polygon's attributes; boundary ties follow the half-open rule.

    Each polygon cell carries only the edges a ray leaving that cell toward +x can meet.  Cells are halved for small
    polygons until they are about as large as these, so that a point meets few that lie elsewhere.
    """
    # A polygon without extent holds no point.
    boxed = _with_box(polys.select(*attrs, ring), ring).where("px1 > px0 and py1 > py0").withColumn("__k", _halvings(cell))
    levels = sorted(r[0] for r in boxed.select("__k").distinct().collect())
    size = _size(cell)
    cells = _box_cells(boxed, "px0", "px1", "py0", "py1", size)
    near = F.filter("__edges", lambda e: (F.greatest(e["ay"], e["by"]) >= F.col("cy") * size)
                    & (F.least(e["ay"], e["by"]) <= (F.col("cy") + 1) * size)
                    & (F.greatest(e["ax"], e["bx"]) >= F.col("cx") * size))
    cells = cells.select(*attrs, "__k", "cx", "cy", "px0", "px1", "py0", "py1", near.alias("__near"))
    pts = _per_level(points, levels).withColumns({"cx": _cell("x", size), "cy": _cell("y", size)})
    crossed = F.filter("__near", lambda e: ((e["ay"] > F.col("y")) != (e["by"] > F.col("y")))
                       & (F.col("x") < e["ax"] + (F.col("y") - e["ay"]) * (e["bx"] - e["ax"]) / (e["by"] - e["ay"])))
    sent, on = _sent(cells, "__near"), ["__k", "cx", "cy"]
    met = pts.join(sent, on) if sent is not cells else spread_join(pts, cells, on)
    joined = met.where(F.col("x").between(F.col("px0"), F.col("px1")) & F.col("y").between(F.col("py0"), F.col("py1")))
    return joined.where(F.size(crossed) % 2 == 1).select(*points.columns, *attrs)


def member(points: DataFrame, pid: str, all_of: Sequence[DataFrame], none_of: Sequence[DataFrame] = (),
           cell: float = 2000.0) -> DataFrame:
    """Points inside some polygon of every ``all_of`` table and of no ``none_of`` table."""
    out = points
    for polys in all_of:
        out = natural_join(out, pip_join(points, polys, cell=cell).select(pid).distinct(), "left_semi", [pid])
    for polys in none_of:
        out = anti(out, pip_join(points, polys, cell=cell), [pid])
    return out


# ---- points and lines ----------------------------------------------------------------

def _segment_cells(segs: DataFrame, size: float | Column, margin: float | Column) -> DataFrame:
    """Cells within ``margin`` of each segment, column by column along it."""
    s, d = _number(size), _number(margin)
    xlo, xhi = F.least("x1", "x2"), F.greatest("x1", "x2")
    cols = segs.withColumn("cx", F.explode(F.sequence(_cell(xlo - d, size), _cell(xhi + d, size))))
    clamp = lambda v: F.least(F.greatest(v, xlo), xhi)
    y_at = lambda v: F.col("y1") + (F.col("y2") - F.col("y1")) * (v - F.col("x1")) / (F.col("x2") - F.col("x1"))
    upright = F.col("x1") == F.col("x2")
    a = F.when(upright, F.col("y1")).otherwise(y_at(clamp(F.col("cx") * s - d)))
    b = F.when(upright, F.col("y2")).otherwise(y_at(clamp((F.col("cx") + 1) * s + d)))
    # A hair wider than the margin so that rounding in y_at never loses a cell.
    pad = d + s * 1e-9
    return cols.withColumn("cy", F.explode(F.sequence(_cell(F.least(a, b) - pad, size), _cell(F.greatest(a, b) + pad, size))))


def _foot() -> tuple[Column, Column, Column]:
    """Position along the segment, then the nearest point on it, for joined (x, y) and segment rows."""
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    along = F.try_divide((F.col("x") - F.col("x1")) * dx + (F.col("y") - F.col("y1")) * dy, dx * dx + dy * dy)
    u = F.least(F.greatest(F.coalesce(along, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    return along, F.col("x1") + u * dx, F.col("y1") + u * dy


def _snap_once(points: DataFrame, segs: DataFrame, pid: str, line: str, radius: float, keys: Sequence[str]) -> DataFrame:
    """Nearest segment within ``radius``: exact for every point that finds one.

    The least distance is a plain minimum, kept in a hash table; then only what lies at that distance is compared by
    line and segment, so candidates are never sorted.
    """
    size = radius * 2
    cells = _segment_cells(segs.select(*keys, line, "seg_no", "x1", "y1", "x2", "y2"), size, radius)
    pts = points.select(*keys, pid, "x", "y").withColumns({"cx": _cell("x", size), "cy": _cell("y", size)})
    _, px, py = _foot()
    dist = F.hypot(F.col("x") - px, F.col("y") - py)
    on = [*keys, "cx", "cy"]
    least = spread_join(pts, cells, on).withColumn("__d", dist).where(F.col("__d") <= radius).groupBy(*keys, pid).agg(F.min("__d").alias("__least"))
    ends = spread_join(natural_join(pts, freeze(least).hint("shuffle_merge"), "inner", [*keys, pid]), cells, on).withColumn("snap_dist", dist).where("snap_dist = __least")
    best = F.min(F.struct("snap_dist", line, "seg_no", "snap_x", "snap_y")).alias("b")
    return ends.withColumns({"snap_x": px, "snap_y": py}).groupBy(*keys, pid).agg(best).select(*keys, pid, "b.*")


def _radii(points: DataFrame, segs: DataFrame, keys: Sequence[str], max_dist: float) -> list[float]:
    """Search radii up to ``max_dist``, each four times the one before; the first is the one at which evenly spread
    points and lines would make the fewest cells and pairs."""
    box = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), ((F.max("x") - F.min("x")) * (F.max("y") - F.min("y"))).alias("area"))
    way = segs.groupBy(*keys).agg(F.count(F.lit(1)).alias("m"), F.sum(F.abs(F.col("x2") - F.col("x1")) + F.abs(F.col("y2") - F.col("y1"))).alias("way"))
    both = natural_join(box, way, "inner", keys) if keys else box.crossJoin(way)
    every = [max_dist / 4**j for j in range(DEEPEST + 1)]

    def cost(r: float) -> Column:
        cells = F.col("m") * 9 + F.col("way") * 2 / r
        pairs = F.col("n") * F.least((F.col("m") * 16 * r * r + F.col("way") * 4 * r) / F.greatest("area", F.lit(16.0 * r * r)), F.col("m"))
        return F.sum(cells * 2 + pairs * 2)

    costs = both.agg(*[cost(r).alias(f"c{j}") for j, r in enumerate(every)]).first()
    first = min(range(len(every)), key=lambda j: (costs[j] if costs[j] is not None else 0.0, j))
    return every[first::-1]


def snap_points(points: DataFrame, segs: DataFrame, max_dist: float, pid: str = "point_id", line: str = "line_id",
                keys: Sequence[str] = (), steps: int | None = None) -> DataFrame:
    """Nearest line within ``max_dist`` per point: distance, line, segment and snapped position.

    The search radius grows fourfold per step and only points still unmatched move on, so a dense
    neighbourhood is settled with small cells and few candidates.  Without ``steps`` the first radius follows from how
    dense points and lines are.
    """
    keys = list(keys)
    radii = [max_dist / 4**k for k in range(steps - 1, -1, -1)] if steps else _radii(points, segs, keys, max_dist)
    todo, done = points.select(*keys, pid, "x", "y"), []
    for step, radius in enumerate(radii):
        hit = _snap_once(todo, segs, pid, line, radius, keys)
        if step < len(radii) - 1:
            hit = freeze(hit)
            found = hit.select(*keys, pid).distinct().hint("shuffle_merge")
            todo = freeze(natural_join(todo, found, "left_anti", [*keys, pid]))
        done.append(hit)
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def nearest(points: DataFrame, segs: DataFrame, pid: str = "point_id", line: str = "line_id",
            start: float = 250.0) -> DataFrame:
    """Nearest line for every point, however far.

    Points within ``start`` of a line are matched directly; the others walk down a grid hierarchy.
    Points at one place are searched once.
    """
    places = freeze(points.where("x is not null and y is not null").groupBy("x", "y").agg(F.min(pid).alias(pid)))
    near = freeze(snap_points(places, segs, start, pid, line))
    far = anti(places, near, [pid])
    found = near if far.isEmpty() else near.unionByName(_descend(far, segs, pid, line, start))
    found = places.select("x", "y", F.col(pid).alias("__rep")).join(found.withColumnRenamed(pid, "__rep").hint("shuffle_merge"), ["__rep"]).drop("__rep")
    return points.select(pid, "x", "y").join(found.hint("shuffle_merge"), ["x", "y"]).drop("x", "y")


def _descend(points: DataFrame, segs: DataFrame, pid: str, line: str, cell: float) -> DataFrame:
    """Nearest line through nested cells, each level four times finer than the one above.

    An occupied cell holds a line, so the line is no farther than the cell's far corner; cells whose
    near corner lies beyond the best such bound drop out.  A point keeps a handful of cells per
    level and meets only the lines of its last cells.
    """
    fine = freeze(_segment_cells(segs.select(line, "seg_no", "x1", "y1", "x2", "y2"), cell, 0.0))
    span = fine.agg(F.min("cx"), F.max("cx"), F.min("cy"), F.max("cy")).first()
    if span[0] is None:
        return _snap_once(points, segs, pid, line, cell, [])
    top = 0
    while any(b // 4**top - a // 4**top > 1 for a, b in ((span[0], span[1]), (span[2], span[3]))):
        top += 1

    def occupied(level: int) -> DataFrame:
        at = lambda c: F.floor(F.col(c) / 4**level)
        cells = fine.select(at("cx").alias("cx"), at("cy").alias("cy")).distinct()
        return F.broadcast(cells) if level == top or cells.limit(EDGE_LIMIT + 1).count() <= EDGE_LIMIT else cells

    # At most two by two cells at the top.
    cand = points.select(pid, "x", "y").withColumn("__one", F.lit(1)).join(
        occupied(top).withColumn("__one", F.lit(1)), "__one").drop("__one")
    for level in range(top - 1, -1, -1):
        child = occupied(level).withColumns({"ux": F.floor(F.col("cx") / 4), "uy": F.floor(F.col("cy") / 4)})
        cand = cand.withColumnsRenamed({"cx": "ux", "cy": "uy"}).join(child, ["ux", "uy"]).drop("ux", "uy")
        size = F.lit(float(cell * 4**level))
        low = {c: F.col(f"c{c}") * size for c in "xy"}
        gap = {c: F.greatest(low[c] - F.col(c), F.col(c) - low[c] - size, F.lit(0.0)) for c in "xy"}
        far = {c: F.greatest(F.abs(low[c] - F.col(c)), F.abs(low[c] + size - F.col(c))) for c in "xy"}
        cand = cand.withColumns({"__near": F.hypot(gap["x"], gap["y"]),
                                 "__bound": F.min(F.hypot(far["x"], far["y"])).over(Window.partitionBy(pid))})
        # A little slack covers rounding at cell edges.
        cand = cand.where(F.col("__near") <= F.col("__bound") + size * 1e-6).drop("__near", "__bound")
    _, px, py = _foot()
    hit = cand.join(fine, ["cx", "cy"]).withColumns({"snap_x": px, "snap_y": py}).withColumn(
        "snap_dist", F.hypot(F.col("x") - F.col("snap_x"), F.col("y") - F.col("snap_y")))
    best = F.min(F.struct("snap_dist", line, "seg_no", "snap_x", "snap_y")).alias("b")
    return hit.groupBy(pid).agg(best).select(pid, "b.*")


def within_distance(points: DataFrame, segs: DataFrame, d: float, pid: str = "point_id", cap: str = "round") -> DataFrame:
    """Ids of points inside the buffer of any line: round, flat or square ends.

    With round ends every point of a cell whose diagonal is shorter than ``d`` lies inside where a line passes the
    cell; only points of other cells are compared with lines.
    """
    reach = d * math.sqrt(2) if cap == "square" else d
    size = reach * 2
    cells = _segment_cells(segs.select("x1", "y1", "x2", "y2"), size, reach)
    pts, sure = points.select(pid, "x", "y"), None
    if cap == "round" and d > 0:
        small = d / math.sqrt(2) * 0.999
        passed = _segment_cells(segs.select("x1", "y1", "x2", "y2"), small, 0.0).select("cx", "cy").distinct()
        marked = freeze(pts.withColumns({"cx": _cell("x", small), "cy": _cell("y", small)}).join(
            passed.withColumn("__sure", F.lit(True)).hint("shuffle_merge"), ["cx", "cy"], "left").select(pid, "x", "y", "__sure"))
        sure, pts = marked.where("__sure").select(pid), marked.where("__sure is null").drop("__sure")
    pts = pts.withColumns({"cx": _cell("x", size), "cy": _cell("y", size)})
    along, px, py = _foot()
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    length = F.hypot(dx, dy)
    off = F.abs(F.try_divide((F.col("x") - F.col("x1")) * dy - (F.col("y") - F.col("y1")) * dx, length))
    over = {"flat": F.lit(0.0), "square": F.try_divide(F.lit(float(d)), length)}
    if cap == "round":
        test = F.hypot(F.col("x") - px, F.col("y") - py) <= d
    else:
        test = (off <= d) & (along >= -over[cap]) & (along <= 1 + over[cap])
    met = spread_join(pts, cells, ["cx", "cy"]).where(test).select(pid)
    return (met if sure is None else met.unionByName(sure)).distinct()


def snap_issues(df: DataFrame, name: str, line_name: str, dist: str, max_dist: float = 100.0,
                missing: str = "(Missing)") -> DataFrame:
    """Snapped points that need review, with the reason."""
    n, g, d = F.col(name), F.col(line_name), F.col(dist)
    # Fixed labels.
    issue = (F.when((n != g) & (n != missing), "Mismatch StreamName")
             .when((n == g) & (d > max_dist), "Large Snap Distance")
             .when((n == missing) & (d > max_dist), "Missing StreamName"))
    return df.withColumn("issue", issue).where("issue is not null")


# ---- lines and polygons --------------------------------------------------------------

# Where the clipping grid begins, as a share of a cell: no corner falls on a vertex with few decimals.
_ORIGIN_X, _ORIGIN_Y = 0.3718281828, 0.6180339887


def _polygon_cells(polys: DataFrame, attrs: Sequence[str], cell: float, ring: str) -> DataFrame:
    """(attrs, cx, cy, __edges, __odd, box): the cells that a polygon touches or covers.

    A cell has the edges that pass it and one bit, whether its lower left corner lies inside; a covered
    cell has the bit alone.  The bit is the parity of the edges that the bottom line meets further left,
    a running count over the cells of a line, so no cell ever sees the edges of others.
    """
    return _cells_of(_with_box(polys.select(*attrs, ring), ring), attrs, cell)


def _cells_of(boxed: DataFrame, attrs: Sequence[str], cell: float) -> DataFrame:
    size, ox, oy = F.lit(float(cell)), F.lit(cell * _ORIGIN_X), F.lit(cell * _ORIGIN_Y)
    attrs = list(attrs)
    box = F.struct("px0", "px1", "py0", "py1").alias("box")
    edges = boxed.select(*attrs, F.explode("__edges").alias("e"))
    no_edge, no_box, none = (F.lit(None).cast(t) for t in (edges.schema["e"].dataType, boxed.select(box).schema["box"].dataType, "bigint"))
    covered = _box_cells(boxed.select(*attrs, box, *[(F.col(c) - o).alias(c) for c, o in (("px0", ox), ("px1", ox), ("py0", oy), ("py1", oy))]),
                         "px0", "px1", "py0", "py1", cell).select(*attrs, "cx", "cy", no_edge.alias("e"), "box", none.alias("n"))
    moved = edges.select(*attrs, "e", (F.col("e.ax") - ox).alias("x1"), (F.col("e.ay") - oy).alias("y1"), (F.col("e.bx") - ox).alias("x2"), (F.col("e.by") - oy).alias("y2"))
    passed = _segment_cells(moved, cell, 0.0).select(*attrs, "cx", "cy", "e", no_box.alias("box"), none.alias("n"))
    low, high = F.ceil(F.least("y1", "y2") / size), F.ceil(F.greatest("y1", "y2") / size) - 1
    rows = moved.where(low <= high).withColumn("cy", F.explode(F.sequence(low, high)))
    x = F.col("x1") + (F.col("cy") * size - F.col("y1")) / (F.col("y2") - F.col("y1")) * (F.col("x2") - F.col("x1"))
    met = rows.select(*attrs, F.floor(x / size).alias("cx"), "cy", no_edge.alias("e"), no_box.alias("box"), F.lit(1).cast("bigint").alias("n"))
    cells = covered.unionByName(passed).unionByName(met).groupBy(*attrs, "cx", "cy").agg(
        F.collect_list("e").alias("__edges"), F.max("box").alias("box"), F.coalesce(F.sum("n"), F.lit(0)).alias("__n"))
    left = Window.partitionBy(*attrs, "cy").orderBy("cx").rowsBetween(Window.unboundedPreceding, -1)
    odd = F.coalesce(F.sum("__n").over(left), F.lit(0)) % 2 == 1
    return cells.withColumn("__odd", odd).where((F.size("__edges") > 0) | F.col("__odd")).drop("__n")


def _segment_parts(segs: DataFrame, cell: float) -> DataFrame:
    """Each segment cut where it leaves a cell: (columns, cx, cy, __a, __b), positions along the segment."""
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")

    def borders(a: str, d: Column, share: float) -> Column:
        size, o = F.lit(float(cell)), F.lit(cell * share)
        b = F.col(a) + d
        low, high = F.floor((F.least(F.col(a), b) - o) / size) + 1, F.floor((F.greatest(F.col(a), b) - o) / size)
        at = F.transform(F.sequence(low, high), lambda k: (o + k * size - F.col(a)) / d)
        return F.when((low <= high) & (d != 0), F.filter(at, lambda t: (t > 0) & (t < 1))).otherwise(F.array().cast("array<double>"))

    cuts = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0.0), F.lit(1.0)), borders("x1", dx, _ORIGIN_X), borders("y1", dy, _ORIGIN_Y))))
    rows = segs.where((dx != 0) | (dy != 0)).withColumn("__cuts", cuts)
    part = F.explode(F.transform(F.slice("__cuts", 1, F.size("__cuts") - 1), lambda t, i: F.struct(t.alias("a"), F.get("__cuts", i + 1).alias("b"))))
    rows = rows.withColumn("__p", part).drop("__cuts").withColumns({"__a": F.col("__p.a"), "__b": F.col("__p.b")}).drop("__p")
    mid = (F.col("__a") + F.col("__b")) / 2
    return rows.withColumns({"cx": F.floor((F.col("x1") + mid * dx - cell * _ORIGIN_X) / F.lit(float(cell))),
                             "cy": F.floor((F.col("y1") + mid * dy - cell * _ORIGIN_Y) / F.lit(float(cell)))})


def _hits(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Positions at which the line from (x0, y0) to (x1, y1) meets the cell's edges (half-open side rule)."""
    dx, dy = x1 - x0, y1 - y0
    side = lambda ex, ey: dx * (ey - y0) - dy * (ex - x0)

    def position(e):
        sa, sb = side(e["ax"], e["ay"]), side(e["bx"], e["by"])
        u = sa / (sa - sb)
        qx, qy = e["ax"] + u * (e["bx"] - e["ax"]), e["ay"] + u * (e["by"] - e["ay"])
        return ((qx - x0) * dx + (qy - y0) * dy) / (dx * dx + dy * dy)

    return F.transform(F.filter("__edges", lambda e: (side(e["ax"], e["ay"]) >= 0) != (side(e["bx"], e["by"]) >= 0)), position)


def _clipped_by_cell(segs: DataFrame, boxed: DataFrame, attrs: Sequence[str], cell: float) -> DataFrame:
    """Parts of segments in the cells of polygons, with ``__t``, where they meet edges, and ``__s``, their spans inside.

    A part meets only the edges of its own cell.  Whether it begins inside follows from the cell's corner and the
    edges between the corner and its first point.
    """
    parts = _segment_parts(segs, cell)
    at = lambda t: (F.col("x1") + F.col(t) * (F.col("x2") - F.col("x1")), F.col("y1") + F.col(t) * (F.col("y2") - F.col("y1")))
    (ax, ay), (bx, by) = at("__a"), at("__b")
    met = spread_join(parts, _cells_of(boxed, attrs, cell), ["cx", "cy"]).where(
        (F.least(ax, bx) <= F.col("box.px1")) & (F.greatest(ax, bx) >= F.col("box.px0")) & (F.least(ay, by) <= F.col("box.py1")) & (F.greatest(ay, by) >= F.col("box.py0")))
    corner = [(F.col(c) + share) * F.lit(float(cell)) for c, share in (("cx", _ORIGIN_X), ("cy", _ORIGIN_Y))]
    own = F.filter(_hits(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")), lambda t: (t >= F.col("__a")) & (t < F.col("__b")))
    before = F.size(F.filter(_hits(*corner, ax, ay), lambda t: (t >= 0) & (t < 1)))
    inside = (before + F.col("__odd").cast("int")) % 2 == 1
    met = met.withColumns({"__t": F.array_sort(own), "__in": inside})
    ends = F.concat(F.when(F.col("__in"), F.array("__a")).otherwise(F.array().cast("array<double>")), F.col("__t"))
    met = met.withColumn("__ends", ends).withColumn("__ends", F.when(F.size("__ends") % 2 == 1, F.concat("__ends", F.array("__b"))).otherwise(F.col("__ends")))
    spans = F.transform(F.filter(F.col("__ends"), lambda t, i: i % 2 == 0), lambda t, i: F.struct(t.alias("t0"), F.get("__ends", i * 2 + 1).alias("t1")))
    return met.withColumn("__s", F.filter(spans, lambda s: s["t1"] > s["t0"])).select(*segs.columns, *attrs, "__t", "__s")


def _whole(boxed: DataFrame, attrs: Sequence[str], cell: float) -> DataFrame:
    """A row for each polygon, rows of equal attributes together, and how often ``cell`` is halved for it."""
    whole = boxed.groupBy(*attrs).agg(F.flatten(F.collect_list("__edges")).alias("__edges"), *[F.first(c).alias(c) for c in ("px0", "px1", "py0", "py1")])
    return freeze(whole.where("px1 > px0 or py1 > py0").withColumn("__k", _halvings(cell)))


def _deepest(lines: DataFrame, polygons: int, cell: float) -> int:
    """So deep that the cells of all segments stay in proportion to the rows, however small a polygon may be."""
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    n, way = lines.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.abs(dx) + F.abs(dy)), F.lit(0.0))).first()
    return max((k for k in range(DEEPEST + 1) if way * 2**k / cell <= CELLS_A_ROW * (n + polygons)), default=0)


def _clipped_whole(segs: DataFrame, boxed: DataFrame, attrs: Sequence[str], cell: float) -> DataFrame:
    """The same for polygons no longer than a cell: each with every segment that passes its box, once.

    The cells are those of the polygons' middles, halved until they are about as large as the polygons, and a segment
    lies in all cells within half a cell of it.
    """
    attrs, whole = list(attrs), _whole(boxed, attrs, cell)
    level = {r[0]: r[1] for r in whole.groupBy("__k").count().collect()}
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    lines = segs.where((dx != 0) | (dy != 0))
    deepest = _deepest(lines, sum(level.values()), cell)
    size = _size(cell)
    whole = whole.withColumn("__k", F.least("__k", F.lit(deepest))).withColumns(
        {"cx": _cell((F.col("px0") + F.col("px1")) / 2, size), "cy": _cell((F.col("py0") + F.col("py1")) / 2, size)})
    passing_ = _segment_cells(_per_level(lines, sorted({min(k, deepest) for k in level})), size, size * 0.500001)
    # The line passes the box, with some room for rounding.
    across = (F.col("px1") - F.col("px0")) / 2 * F.abs(dy) + (F.col("py1") - F.col("py0")) / 2 * F.abs(dx)
    aside = F.abs(dx * ((F.col("py0") + F.col("py1")) / 2 - F.col("y1")) - dy * ((F.col("px0") + F.col("px1")) / 2 - F.col("x1")))
    met = spread_join(passing_, whole, ["__k", "cx", "cy"]).where(
        (F.least("x1", "x2") <= F.col("px1")) & (F.greatest("x1", "x2") >= F.col("px0")) & (F.least("y1", "y2") <= F.col("py1")) & (F.greatest("y1", "y2") >= F.col("py0"))
        & (aside <= across * 1.000001))
    # Exploded, so that filters on what follows do not work the hits out again.
    met = met.select(*segs.columns, *attrs, F.explode(F.array(F.sort_array(_hits(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))))).alias("__h"))
    # The first place at or behind the start says whether anything lies on the segment, the number before it whether that is inside.
    met = met.where((F.size("__h") > 0) & (F.element_at("__h", -1) >= 0) & (F.get("__h", F.lit(0)) < 1))
    inside = F.transform(F.filter("__h", lambda t, i: i % 2 == 0), lambda t, i: F.struct(
        F.greatest(t, F.lit(0.0)).alias("t0"), F.least(F.get("__h", i * 2 + 1), F.lit(1.0)).alias("t1")))
    return met.select(*segs.columns, *attrs, F.filter("__h", lambda t: (t >= 0) & (t < 1)).alias("__t"), F.filter(inside, lambda s: s["t1"] > s["t0"]).alias("__s"))


def _met_whole(segs: DataFrame, boxed: DataFrame, attrs: Sequence[str], cell: float, run: Callable, schema: T.StructType,
               points: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """What ``run`` (of ``passing``) returns of polygons no longer than a cell, all lines near them and, if given, all points.

    A polygon lies in the cell of its middle, with cells twice as large as the polygons, and a line in all cells from which a polygon may
    reach it.  The polygons of a cell are dealt over as many tasks as its counted pairs need.
    """
    attrs, on, most = list(attrs), ["__k", "cx", "cy"], TASK_TESTS if most is None else most
    whole = _whole(boxed, attrs, cell)
    lines = segs.where("x1 <> x2 or y1 <> y2")
    level = {r[0]: r[1] for r in whole.groupBy("__k").count().collect()}
    deepest = max(_deepest(lines, sum(level.values()), cell) - 1, 0)
    up = lambda k: min(max(k - 1, 0), deepest)
    levels = sorted({up(k) for k in level})
    size = _size(cell)
    # Polygons of level 0 may be as long as a cell, all others are at most half as long.
    reach = size * F.when(F.col("__k") == 0, 0.500001).otherwise(0.250001)
    whole = whole.withColumn("__k", F.least(F.greatest(F.col("__k") - 1, F.lit(0)), F.lit(deepest))).withColumns(
        {"cx": _cell((F.col("px0") + F.col("px1")) / 2, size), "cy": _cell((F.col("py0") + F.col("py1")) / 2, size)})
    left = _segment_cells(_per_level(lines, levels), size, reach)
    if points is not None:
        placed = _per_level(points.where("x is not null and y is not null"), levels)
        placed = _box_cells(placed, F.col("x") - reach, F.col("x") + reach, F.col("y") - reach, F.col("y") + reach, size)
        left = left.withColumn("__point", F.lit(False)).unionByName(placed.withColumn("__point", F.lit(True)), allowMissingColumns=True)
    n, m = (d.groupBy(*on).agg(F.count(F.lit(1)).cast("double").alias(c)) for d, c in ((left, "__n"), (whole, "__m")))
    tests = F.col("__n") * F.col("__m")
    dealt = freeze(n.join(m, on).select(*on, tests.alias("__p"), F.least(F.ceil(tests / most), F.col("__m")).cast("int").alias("__parts")))
    total = dealt.agg(F.coalesce(F.sum("__p"), F.lit(0.0))).first()[0]
    spark, keys, parts = segs.sparkSession, [*on, "__part"], dealt.select(*on, "__parts")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism, int(total // most) + 1)
    left = left.join(parts, on).withColumn("__part", F.explode(F.sequence(F.lit(0), F.col("__parts") - 1))).drop("__parts")
    right = whole.join(parts, on).withColumn("__part", F.pmod(F.xxhash64(*attrs, "px0", "py0"), F.col("__parts")).cast("int")).drop("__parts")
    return left.repartition(tasks, *keys).groupBy(*keys).cogroup(right.repartition(tasks, *keys).groupBy(*keys)).applyInArrow(run, schema)


def _fields(df: DataFrame, columns: Sequence[str], more: str = "") -> T.StructType:
    """The types of some columns and of more, all of which may be missing."""
    out = T.StructType([T.StructField(c, df.schema[c].dataType) for c in columns])
    return T.StructType([*out.fields, *T.StructType.fromDDL(more).fields]) if more else out


def by_size(polys: DataFrame, attrs: Sequence[str], cell: float, ring: str = "ring") -> tuple[DataFrame, DataFrame]:
    """Polygons with edges and box, those no longer than a cell and the others; rows of equal attributes are one polygon."""
    attrs, sides = list(attrs), ("px0", "px1", "py0", "py1")
    each = _with_box(polys.select(*attrs, ring), ring)
    box = each.groupBy(*attrs).agg(*[(F.min if c.endswith("0") else F.max)(c).alias(c) for c in sides])
    boxed = natural_join(each.drop(*sides), box.hint("shuffle_merge"), "inner", attrs)
    boxed = freeze(boxed.drop(ring))
    small = (F.col("px1") - F.col("px0") <= cell) & (F.col("py1") - F.col("py0") <= cell)
    return boxed.where(small), boxed.where(~small)


def _clipped(segs: DataFrame, polys: DataFrame, attrs: Sequence[str], cell: float, ring: str) -> DataFrame:
    """Segments and polygons that meet, with ``__t``, where they meet edges, and ``__s``, spans inside.

    Polygons longer than a cell are cut into cells, which hold a few edges each; smaller ones are met whole.
    """
    small, large = by_size(polys, attrs, cell, ring)
    cut = _clipped_by_cell(segs, large, attrs, cell)
    return cut if small.isEmpty() else cut.unionByName(_clipped_whole(segs, small, attrs, cell))


def _along(df: DataFrame, rest: Sequence[Column | str]) -> DataFrame:
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    t0, t1 = F.col("__s.t0"), F.col("__s.t1")
    return df.select(*rest, (F.col("x1") + t0 * dx).alias("x1"), (F.col("y1") + t0 * dy).alias("y1"),
                     (F.col("x1") + t1 * dx).alias("x2"), (F.col("y1") + t1 * dy).alias("y2"))


def clip_segments(segs: DataFrame, polys: DataFrame, attrs: Sequence[str] = ("poly_id",), cell: float = 2000.0,
                  ring: str = "ring") -> DataFrame:
    """The pieces of each segment inside each polygon, as a segment table with ``piece`` numbers.

    Spans of neighbouring cells that meet are one piece; equal segments keep a piece each.
    """
    rest = [c for c in segs.columns if c not in ("x1", "y1", "x2", "y2")]
    each = _clipped(segs, polys, attrs, cell, ring).drop("__t").withColumn("__s", F.explode("__s"))
    whole = each.groupBy(*segs.columns, *attrs).agg(F.collect_list("__s").alias("__all"))
    one = whole.withColumn("__once", F.array_distinct("__all"))
    starts, stops = (F.array_sort(F.array_except(F.transform("__once", lambda s: s[a]), F.transform("__once", lambda s: s[b]))) for a, b in (("t0", "t1"), ("t1", "t0")))
    spans = F.zip_with(starts, stops, lambda a, b: F.named_struct(F.lit("t0"), a, F.lit("t1"), b))
    copies = F.explode(F.array_repeat(F.lit(0), (F.size("__all") / F.size("__once")).cast("int")))
    pieces = one.select(*segs.columns, *attrs, copies.alias("__copy"), spans.alias("__spans")).select("*", F.posexplode("__spans").alias("__i", "__s"))
    return _along(pieces, [*rest, *attrs, (F.col("__i") + 1).alias("piece")])


def length_in_polygon(segs: DataFrame, polys: DataFrame, by: Sequence[str], attrs: Sequence[str] = ("poly_id",),
                      cell: float = 2000.0, ring: str = "ring") -> DataFrame:
    """Length of lines inside each polygon; the spans of every cell of a large one are added up where they lie, those of a small
    one in the task that has it."""
    attrs, by, ends = list(attrs), list(by), ("x1", "y1", "x2", "y2")
    lines = freeze(segs.select(*by, *[c for c in ends if c not in by]))
    small, large = by_size(polys, attrs, cell, ring)
    spans = _clipped_by_cell(lines, large, attrs, cell).withColumn("__s", F.explode("__s"))
    whole = _met_whole(lines, small, attrs, cell, passing.lengths(attrs, by), T.StructType([*_fields(polys, attrs).fields, *_fields(segs, by, "length double").fields]))
    return line_length(_along(spans, [*attrs, *by]), [*attrs, *by]).unionByName(whole)


def clip_reaches(segs: DataFrame, polys: DataFrame, rid: str, attrs: Sequence[str] = ("poly_id",),
                 cell: float = 2000.0, ring: str = "ring") -> DataFrame:
    """(reach, polygon) pairs that intersect; reach attributes are left as they are."""
    attrs, lines = list(attrs), freeze(segs.select(rid, "x1", "y1", "x2", "y2"))
    small, large = by_size(polys, attrs, cell, ring)
    whole = _met_whole(lines, small, attrs, cell, passing.pairs(attrs, rid), T.StructType([*_fields(segs, [rid]).fields, *_fields(polys, attrs).fields]), most=TASK_RETURNS)
    return _met_large(lines, large, rid, attrs, cell).unionByName(whole)


def _met_large(lines: DataFrame, large: DataFrame, rid: str, attrs: Sequence[str], cell: float) -> DataFrame:
    """The pairs of polygons longer than a cell."""
    cut = _clipped_by_cell(lines, large, attrs, cell)
    return cut.where((F.size("__t") > 0) | (F.size("__s") > 0)).select(rid, *attrs).distinct()


def reach_sums(segs: DataFrame, polys: DataFrame, rid: str, per: DataFrame, dims: Sequence[str], names: Sequence[str],
               attrs: Sequence[str] = ("poly_id",), cell: float = 2000.0, ring: str = "ring") -> DataFrame:
    """(attrs, dims, __reaches, names): how many rows of ``per`` (rid, dims, names) the reaches of ``clip_reaches`` have, and their sums.

    Reaches of small polygons are added up where the polygon is, so pairs are never rows.
    """
    attrs, dims, names = list(attrs), list(dims), list(names)
    lines = freeze(segs.select(rid, "x1", "y1", "x2", "y2"))
    per = freeze(per.select(rid, *dims, *[F.col(c).cast("double").alias(c) for c in names]))
    small, large = by_size(polys, attrs, cell, ring)
    pairs = _met_large(lines, large, rid, attrs, cell)
    sent = F.broadcast(per) if per.count() <= EDGE_LIMIT else per
    out = natural_join(pairs.repartition(*attrs), sent, "inner", [rid]).groupBy(*attrs, *dims).agg(F.count(F.lit(1)).alias("__reaches"), *[F.sum(c).alias(c) for c in names])
    own = per.groupBy(rid).agg(F.collect_list(F.struct(*dims, *names)).alias("__per"))
    schema = T.StructType([*_fields(polys, attrs).fields, *_fields(per, dims, "__reaches bigint, " + ", ".join(f"`{c}` double" for c in names)).fields])
    return out.unionByName(_met_whole(natural_join(lines, own, "inner", [rid]), small, attrs, cell, passing.sums(attrs, rid, dims, names), schema))


def stream_caps_whole(points: DataFrame, streams: DataFrame, small: DataFrame, attrs: Sequence[str], stream: str, site: str, cap: str, se: str,
                      max_snap: float, cell: float) -> DataFrame:
    """Lines clipped to small polygons and the points inside snapped to them: length, points and mean densities of every stream of a
    polygon, and whether the polygon has points; nothing but these leaves the task that has the polygon."""
    pts = points.select("x", "y", F.col(site).alias("__site"), F.col(cap).cast("double").alias("__cap"), F.col(se).cast("double").alias("__se"))
    schema = T.StructType([*_fields(small, attrs).fields, *_fields(
        streams, [stream], "tot_length double, n_pts bigint, cap_per_m double, cap_per_m_se double, __met boolean").fields])
    return _met_whole(streams.select(stream, "seg_no", "x1", "y1", "x2", "y2"), small, attrs, cell, passing.capacities(attrs, stream, max_snap), schema, pts)


def largest_overlap(segs: DataFrame, polys: DataFrame, line: str, attr: str = "poly_id", min_length: float = 100.0,
                    cell: float = 2000.0) -> DataFrame:
    """Polygon sharing the greatest length with each line; ties go to the lowest polygon id."""
    each = length_in_polygon(segs, polys, [line], [attr], cell)
    best = each.groupBy(line).agg(F.min(F.struct((-F.col("length")).alias("neg"), attr)).alias("b"))
    return best.select(line, F.col(f"b.{attr}").alias(attr), (-F.col("b.neg")).alias("length")).where(
        F.col("length") >= min_length)


def flowlines(segs: DataFrame, order: str, max_order: int, polys: DataFrame, rid: str, cell: float = 2000.0) -> DataFrame:
    """Lines up to a stream order that meet a polygon; the polygons' common box filters the scan first."""
    box = _with_box(polys).agg(F.min("px0"), F.max("px1"), F.min("py0"), F.max("py1")).first()
    near = segs.where((F.col(order) <= max_order) & (F.greatest("x1", "x2") >= box[0]) & (F.least("x1", "x2") <= box[1])
                      & (F.greatest("y1", "y2") >= box[2]) & (F.least("y1", "y2") <= box[3]))
    return clip_reaches(near, polys, rid, cell=cell)


# ---- hulls ---------------------------------------------------------------------------

def _hull(xy: np.ndarray) -> np.ndarray:
    """Convex hull by the monotone chain, counter-clockwise from the lowest-left vertex."""
    pts = np.unique(xy, axis=0)
    if len(pts) < 3:
        return pts

    def chain(seq):
        out: list[np.ndarray] = []
        for p in seq:
            while len(out) > 1 and ((out[-1][0] - out[-2][0]) * (p[1] - out[-2][1])
                                    - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0])) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(chain(pts) + chain(pts[::-1]))


def convex_hull(points: DataFrame, group: str, fan_in: int = 64) -> DataFrame:
    """Hull vertices per group: (group, seq, x, y).

    Hulls of parts replace their points: first within each input partition, then within ``fan_in``
    partial sets per group, so the last step sees only hull vertices.
    """
    kind = points.schema[group].dataType.simpleString()
    part_schema = f"`{group}` {kind}, x double, y double, part int"
    flush = 200_000

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}

        def emit():
            for g, xy in held.items():
                yield pd.DataFrame({group: g, "x": xy[:, 0], "y": xy[:, 1], "part": 0})

        number = 0
        for pdf in batches:
            for g, rows in pdf.groupby(group, sort=False):
                xy = rows[["x", "y"]].to_numpy(dtype=float)
                held[g] = _hull(np.vstack([held[g], xy]) if g in held else xy)
            if sum(len(v) for v in held.values()) > flush:
                for out in emit():
                    yield out.assign(part=number % fan_in)
                    number += 1
                held.clear()
        for out in emit():
            yield out.assign(part=number % fan_in)
            number += 1

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        xy = _hull(pdf[["x", "y"]].to_numpy(dtype=float))
        return pd.DataFrame({group: pdf[group].iloc[0], "x": xy[:, 0], "y": xy[:, 1], "part": 0})

    def final(pdf: pd.DataFrame) -> pd.DataFrame:
        xy = _hull(pdf[["x", "y"]].to_numpy(dtype=float))
        return pd.DataFrame({group: pdf[group].iloc[0], "seq": np.arange(1, len(xy) + 1), "x": xy[:, 0], "y": xy[:, 1]})

    data = points.select(group, "x", "y").where(f"`{group}` is not null and x is not null and y is not null")
    # Spread a group's partial hulls by the partition that made them.
    first = data.mapInPandas(local, part_schema).withColumn(
        "part", F.pmod(F.col("part") + F.spark_partition_id(), F.lit(fan_in)).cast("int"))
    second = first.groupBy(group, "part").applyInPandas(merge, part_schema)
    return second.groupBy(group).applyInPandas(final, f"`{group}` {kind}, seq int, x double, y double")
