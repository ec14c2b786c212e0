"""Quantile regression forests: leaf tables, weighted quantiles, partial dependence.

A forest's leaves are kept as a table (tree, leaf, y, weight).  A scoring row collects the leaf it
reaches in every tree; its conditional distribution is the weighted mix of those leaves
(Meinshausen 2006).  Rows and leaves meet in blocks: a block of rows and a chunk of trees are one
task, which looks every leaf up in sorted arrays, so neither side is bounded by a task or the driver
and no row is ever multiplied by the responses of its leaves.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reachworks.operators.ordered import exact_quantiles, running
from reachworks.operators.survey import levels
from reachworks.operators.trees import SUB_ROWS, Trees, grow
from reachworks.session import freeze

# Leaf entries of one chunk of trees (24 bytes each) and leaf ids of one block of rows (4 bytes each) in a task.
CHUNK_ROWS = 1_000_000
BLOCK_CELLS = 8_000_000
BLOCK_ROWS = 2_000  # fewer rows are not worth a core
# Deepest trees; leaf size ends growth long before on most data.
MAX_DEPTH = 30
# Places at which the mass of a distribution is read in one round when its leaves lie in several chunks.
CUTS = 16
# Ranges of ranks that the entries of one chunk are cut into.
RANGES = 8
# Fits of different levels that are under way at once.
AT_ONCE = 8
# Rounding room when a cumulative share meets the quantile exactly.
SLACK = 1e-9


@dataclass(frozen=True)
class Forest:
    """A fitted forest, its covariates in order and the levels of those that are factors."""

    model: Trees
    covars: tuple[str, ...]
    factors: Mapping[str, tuple] = field(default_factory=dict)

    @property
    def trees(self) -> int:
        return self.model.plan.ntree


def assemble(df: DataFrame, covars: Sequence[str], factors: Mapping[str, Sequence] | None = None) -> DataFrame:
    """Feature vectors; ``__complete`` says where no covariate is missing and every level is known.

    Levels become their place in the list, marked as nominal, so trees split them by subsets.
    """
    factors = factors or {}
    known, inputs = F.lit(True), {}
    for c in covars:
        if c in factors:
            place = F.array_position(F.array(*[F.lit(v) for v in factors[c]]), F.col(c)).cast("double") - 1
            value = F.when(place >= 0, place)
            meta = {"ml_attr": {"type": "nominal", "vals": [str(v) for v in factors[c]], "name": c}}
        else:
            value, meta = F.col(c).cast("double"), {}
        known = known & value.isNotNull()
        inputs[f"__x_{c}"] = F.coalesce(value, F.lit(0.0)).alias(f"__x_{c}", metadata=meta)
    out = df.select("*", known.alias("__complete"), *inputs.values())
    return VectorAssembler(inputCols=list(inputs), outputCol="__features").transform(out).drop(*inputs)


def fit_forest(df: DataFrame, covars: Sequence[str], label: str | Column, ntree: int = 1000, seed: int = 3,
               max_depth: int = MAX_DEPTH, min_leaf: int = 5, factors: Sequence[str] | Mapping[str, Sequence] = (),
               sub_rows: int = SUB_ROWS) -> Forest:
    """Grown until a leaf would fall below ``min_leaf`` rows; rows with a gap are left out.

    ``factors`` names the covariates that are categories; their levels are those of the training
    rows (or as given), and there are as many bins as the longest list of levels.  A node of up to
    ``sub_rows`` in-bag rows is grown to its leaves by one task.
    """
    label = F.col(label) if isinstance(label, str) else label
    known = dict(factors) if isinstance(factors, Mapping) else {c: tuple(levels(df, c)) for c in factors}
    train = assemble(df.withColumn("__label", label).where("__label is not null"), covars, known).where("__complete")
    rows = train.select(vector_to_array("__features").alias("x"), F.col("__label").cast("double").alias("y"))
    kinds = [len(known[c]) if c in known else None for c in covars]
    return Forest(grow(rows, kinds, ntree, seed, max_depth, min_leaf, sub_rows), tuple(covars), {c: tuple(v) for c, v in known.items()})


def fit_by(df: DataFrame, by: str, fit: Callable) -> dict:
    """A fit for each level of ``by``, some of them under way at the same time; there are as many fits as levels."""
    found = levels(df, by)
    with ThreadPoolExecutor(AT_ONCE) as pool:
        return dict(zip(found, pool.map(lambda lv: fit(df.where(F.col(by) == F.lit(lv)), lv), found)))


def fit_qrf(df: DataFrame, covars: Sequence[str], y: str, offset: float = 0.005, ntree: int = 1000,
            by: str | None = None, **kw) -> dict:
    """One forest per level of ``by`` on log(y + offset); rows without a finite log are left out."""
    label = F.ln(F.when(F.col(y) + F.lit(offset) > 0, F.col(y) + F.lit(offset)))
    if by is None:
        return {None: fit_forest(df, covars, label, ntree, **kw)}
    return fit_by(df, by, lambda part, _: fit_forest(part, covars, label, ntree, **kw))


def _scored(forest: Forest, df: DataFrame, what: str, out: str) -> DataFrame:
    """The rows with what the forest says of them; NULL where a covariate is missing or a level unknown."""
    rows = assemble(df, forest.covars, forest.factors).withColumn("__vector", vector_to_array("__features")).drop("__features")
    held = freeze(rows.withColumn("__row", F.monotonically_increasing_id()))
    found = forest.model.reached(held.where("__complete").select("__row", F.col("__vector").alias("x")), what)
    found = found.select(F.col("__row").alias("__at"), F.col(what).alias("__found"))
    return held.join(found, F.col("__row") == F.col("__at"), "left").withColumn(out, F.col("__found")).select(*dict.fromkeys([*df.columns, out]))


def reached(forest: Forest, df: DataFrame) -> DataFrame:
    """The rows with the leaf they reach in every tree; NULL where a covariate is missing or a level unknown."""
    return _scored(forest, df, "leaves", "__leaves")


def predict(forest: Forest, df: DataFrame, out: str = "prediction") -> DataFrame:
    """Every row with the forest's mean; NULL where a covariate is missing or a level unknown."""
    return _scored(forest, df, "mean", out)


def leaf_weights(forest: Forest, train: DataFrame, label: str | Column) -> DataFrame:
    """(tree, leaf, y, w): training responses per leaf, copies merged; weights sum to 1 over a row's leaves."""
    label = F.col(label) if isinstance(label, str) else label
    return leaf_table(reached(forest, train.withColumn("y", label)), "y", "__leaves")


def leaf_table(rows: DataFrame, y: str, ids: str) -> DataFrame:
    """The same from rows that carry their leaf ids in an array, one for each tree."""
    seen = rows.where(F.col(y).isNotNull() & F.col(ids).isNotNull())
    each = seen.select(F.col(y).alias("y"), F.size(ids).alias("trees"), F.posexplode(ids).alias("tree", "leaf"))
    counts = each.groupBy("tree", "leaf", "y", "trees").agg(F.count(F.lit(1)).alias("n"))
    sizes = counts.groupBy("tree", "leaf").agg(F.sum("n").alias("size"))
    return counts.join(sizes, ["tree", "leaf"]).select("tree", "leaf", "y", (F.col("n") / (F.col("size") * F.col("trees"))).alias("w"))


def weighted_quantile(df: DataFrame, keys: Sequence[str], y: str, w: str, q: float, out: str = "q",
                      group_rows: int | None = None) -> DataFrame:
    """Smallest y whose cumulative weight share reaches q; equal values merge before the scan."""
    keys = list(keys)
    merged = df.groupBy(*keys, y).agg(F.sum(w).alias("__w"))
    ran = running(merged, keys, [y], {"__cum": ("sum", F.col("__w"))}, group_rows=group_rows)
    total = merged.groupBy(*keys).agg(F.sum("__w").alias("__tot"))
    both = ran.join(total, keys)
    reached_ = F.col("__cum") >= F.col("__tot") * F.lit(q - SLACK)
    return both.groupBy(*keys).agg(F.min(F.when(reached_, F.col(y))).alias(out))


# ---- rows and leaves in blocks -------------------------------------------------------

@dataclass(frozen=True)
class _Layout:
    """Trees of a chunk, chunks, parts of a chunk whose leaves are too many, blocks of rows."""

    per: int
    chunks: int
    parts: int
    blocks: int

    @property
    def single(self) -> bool:
        return self.chunks * self.parts == 1


def _layout(rows: DataFrame, table: DataFrame, chunk_rows: int, block_cells: int) -> _Layout:
    top, total, most = table.groupBy("tree").agg(F.count(F.lit(1)).alias("n")).agg(F.max("tree"), F.sum("n"), F.max("n")).first()
    trees = (-1 if top is None else top) + 1
    per = max(1, min(trees, chunk_rows * trees // max(1, total or 0)))
    n, cores = rows.count(), rows.sparkSession.sparkContext.defaultParallelism
    blocks = max(-(-n // max(1, block_cells // per)), min(cores, n // BLOCK_ROWS), 1)
    return _Layout(per, max(1, -(-trees // per)), max(1, -(-(most or 0) // chunk_rows)), blocks)


def _pack(table: pa.Table) -> pa.Table:
    """One chunk's leaves as arrays sorted by (tree, leaf, value)."""
    cell = table.column("tree").to_numpy().astype(np.int64) << 32 | table.column("leaf").to_numpy().astype(np.int64)
    value, weight = table.column("value").to_numpy().astype(np.float64), table.column("weight").to_numpy().astype(np.float64)
    order = np.lexsort((value, cell))
    packed = {"cells": cell[order], "values": value[order], "weights": weight[order]}
    return pa.table({"chunk": table.column("chunk")[:1], "part": table.column("part")[:1], **{k: pa.array([v.tobytes()], pa.binary()) for k, v in packed.items()}})


def _packed(table: DataFrame, lay: _Layout) -> DataFrame:
    """(chunk, part, block, cells, values, weights): each chunk once for every block of rows."""
    part = F.pmod(F.xxhash64("leaf", "value"), F.lit(lay.parts)).cast("int")
    rows = table.select(F.expr(f"int(tree div {lay.per})").alias("chunk"), part.alias("part"), "tree", "leaf", "value", "weight")
    one = rows.groupBy("chunk", "part").applyInArrow(_pack, "chunk int, part int, cells binary, values binary, weights binary")
    return one.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(lay.blocks - 1))))


def _blocks(rows: DataFrame, lay: _Layout, rid: str, *more: str) -> DataFrame:
    """(rid, block, chunk, part, ids): the leaf ids of a row for every chunk of trees."""
    chunk = F.explode(F.sequence(F.lit(0), F.lit(lay.chunks - 1))).alias("chunk")
    each = rows.where("__leaves is not null").select(rid, *more, "__leaves", F.pmod(F.xxhash64(rid), F.lit(lay.blocks)).cast("int").alias("block"), chunk)
    each = each.select(rid, *more, "block", "chunk", F.slice("__leaves", F.col("chunk") * lay.per + 1, F.lit(lay.per)).alias("ids"))
    return each.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(lay.parts - 1))))


def _met(left: pa.Table, right: pa.Table, per: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first and last entry of every row's leaves, values, weights) of one block and chunk."""
    if not right.num_rows:
        empty = np.zeros((left.num_rows, 0), np.int64)
        return empty, empty, np.zeros(0), np.zeros(0)
    cells, values, weights = (np.frombuffer(right.column(c)[0].as_py(), t) for c, t in (("cells", np.int64), ("values", np.float64), ("weights", np.float64)))
    column = left.column("ids").combine_chunks()
    ids = column.flatten().to_numpy(False).astype(np.int64).reshape(left.num_rows, -1)
    tree = int(right.column("chunk")[0].as_py()) * per + np.arange(ids.shape[1])
    asked = tree << 32 | ids
    return np.searchsorted(cells, asked, "left"), np.searchsorted(cells, asked, "right"), values, weights


def _mass(first: np.ndarray, last: np.ndarray, values: np.ndarray, upto: np.ndarray, ceiling: np.ndarray) -> np.ndarray:
    """Weight of each row's leaves at or below its ceiling; values are whole ranks, sorted within a leaf."""
    lo, hi = first.copy(), last.copy()
    top = np.broadcast_to(ceiling[:, None], lo.shape)
    while (lo < hi).any():
        mid = (lo + hi) >> 1
        open_ = lo < hi
        below = open_ & (values[np.minimum(mid, len(values) - 1)] <= top)
        lo, hi = np.where(below, mid + 1, lo), np.where(open_ & ~below, mid, hi)
    return (upto[lo] - upto[first]).sum(axis=1)


def _search(per: int, rid: str, ranks: int, q: float, within: bool = False) -> Callable:
    """Bisection on the rank of y, for rows whose leaves are all in one chunk; ``within`` a range whose ends, mass below and total the rows carry."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        first, last, values, weights = _met(left, right, per)
        upto = np.concatenate([[0.0], np.cumsum(weights)])
        if within:
            lo, hi, below, total = (left.column(c).to_numpy() for c in ("__lo", "__hi", "__below", "__total"))
        else:
            lo, hi, below = np.zeros(left.num_rows, np.int64), np.full(left.num_rows, ranks - 1), 0.0
            total = _mass(first, last, values, upto, hi)
        goal = (q - SLACK) * total - below
        while (lo < hi).any():
            mid = (lo + hi) >> 1
            enough = _mass(first, last, values, upto, mid) >= goal
            lo, hi = np.where(enough, lo, np.minimum(mid + 1, hi)), np.where(enough, mid, hi)
        return pa.table({rid: left.column(rid), "__rank": pa.array(hi), "__total": pa.array(total), "__below": pa.array(_mass(first, last, values, upto, hi - 1))})
    return run


def _by_range(held: DataFrame, table: DataFrame, known: DataFrame, rid: str, q: float, ranges: int, lay: _Layout, block_cells: int) -> DataFrame:
    """(rid, rank): the range of each row's quantile from masses of whole ranges, then its rank from that range's entries alone."""
    kind, keys = dict(held.dtypes)[rid], ["block", "chunk", "part"]
    found_as = f"{rid} {kind}, __rank bigint, __total double, __below double"
    cells = freeze(table.groupBy("tree", "leaf", F.col("range").alias("value")).agg(F.sum("weight").alias("weight")))
    rough = _blocks(held, lay, rid).groupBy(*keys).cogroup(_packed(cells, lay).groupBy(*keys)).applyInArrow(_search(lay.per, rid, ranges, q), found_as)
    rough = rough.where("__total > 0").select(F.col(rid).alias("__key"), F.col("__rank").alias("range"), "__total", "__below")
    spans = known.groupBy("range").agg(F.min("value").alias("__lo"), F.max("value").alias("__hi"))
    rows = freeze(held.join(rough, F.col(rid).eqNullSafe(F.col("__key"))).drop("__key").join(spans, "range"))
    # Rows of one range are dealt to as many blocks as they need; its entries go there and nowhere else.
    each = max(1, min(block_cells // lay.per, max(BLOCK_ROWS, rows.count() // rows.sparkSession.sparkContext.defaultParallelism)))
    dealt = rows.where("__lo < __hi").groupBy("range").agg(F.ceil(F.count(F.lit(1)) / each).cast("int").alias("blocks"))
    entries = table.join(dealt, "range").select(F.col("range").cast("int").alias("chunk"), F.lit(0).alias("part"), "tree", "leaf", "value", "weight", "blocks")
    one = entries.drop("blocks").groupBy("chunk", "part").applyInArrow(_pack, "chunk int, part int, cells binary, values binary, weights binary")
    sent = one.join(dealt, F.col("chunk") == F.col("range")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("range", "blocks")
    asked = rows.join(dealt, "range").select(rid, "__lo", "__hi", "__below", "__total", F.col("__leaves").alias("ids"), F.col("range").cast("int").alias("chunk"),
                                             F.lit(0).alias("part"), F.pmod(F.xxhash64(rid), F.col("blocks")).cast("int").alias("block"))
    asked = asked.where("__lo < __hi")
    fine = asked.groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInArrow(_search(0, rid, 0, q, within=True), found_as)
    return fine.select(rid, "__rank").unionByName(rows.where("__lo = __hi").select(rid, F.col("__hi").alias("__rank")))


def _read_cuts(per: int, rid: str) -> Callable:
    """Mass at evenly placed ranks of each row's open range, and its total, over one chunk."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        first, last, values, weights = _met(left, right, per)
        upto = np.concatenate([[0.0], np.cumsum(weights)])
        lo, hi = (left.column(c).to_numpy() for c in ("__lo", "__hi"))
        cuts = {f"__c{k}": pa.array(_mass(first, last, values, upto, lo + (hi - lo + 1) * (k + 1) // CUTS - 1)) for k in range(CUTS)}
        every = _mass(first, last, values, upto, np.full(left.num_rows, np.iinfo(np.int64).max >> 1))
        return pa.table({rid: left.column(rid), "__all": pa.array(every), **cuts})
    return run


def quantile_of_leaves(leaves: DataFrame, rows: DataFrame, q: float, rid: str, ids: str = "__leaves", out: str = "q",
                       chunk_rows: int = CHUNK_ROWS, block_cells: int = BLOCK_CELLS) -> DataFrame:
    """(rid, quantile) of rows that carry their leaf ids in an array; ``leaves`` as from ``leaf_table``.

    ``rid`` must tell the rows apart.  Rows without ids, or none of whose leaves is known, have no quantile.
    """
    leaves = freeze(leaves)
    # Ranges of ranks with about as many entries each; a rank of more is a range of its own.
    size, n, upto = max(1, chunk_rows // RANGES), F.col("n"), F.col("__e")
    order = running(leaves.groupBy("y").agg(F.count(F.lit(1)).alias("n")), [], ["y"], {"__n": ("sum", F.lit(1).cast("bigint")), "__e": ("sum", F.col("n"))})
    known = freeze(order.select(F.col("y").alias("__y"), (F.col("__n") - 1).alias("value"), (F.floor((upto - n) / size) * 2 + (n >= size).cast("int")).alias("range")))
    ranks, ranges = known.agg(F.count(F.lit(1)), F.coalesce(F.max("range"), F.lit(0)) + 1).first()
    table = leaves.join(known, F.col("y") == F.col("__y")).select("tree", "leaf", "value", "range", F.col("w").alias("weight"))
    held = freeze(rows.select(rid, F.col(ids).alias("__leaves")))
    lay = _layout(held, leaves, chunk_rows, block_cells)
    kind = dict(held.dtypes)[rid]
    packed, keys = _packed(table, lay), ["block", "chunk", "part"]
    if lay.single:
        found = _blocks(held, lay, rid).groupBy(*keys).cogroup(packed.groupBy(*keys)).applyInArrow(
            _search(lay.per, rid, ranks, q), f"{rid} {kind}, __rank bigint, __total double, __below double").where("__total > 0")
    elif leaves.select("tree", "leaf").distinct().count() * ranges <= chunk_rows:
        trees = leaves.agg(F.max("tree")).first()[0] + 1
        cells = max(1, block_cells // 4)
        n_rows, cores = held.count(), held.sparkSession.sparkContext.defaultParallelism
        one = _Layout(trees, 1, 1, max(-(-n_rows // max(1, cells // trees)), min(cores, n_rows // BLOCK_ROWS), 1))
        found = _by_range(held, table, known, rid, q, ranges, one, cells)
    else:
        packed = freeze(packed)
        state = held.withColumns({"__lo": F.lit(0).cast("bigint"), "__hi": F.lit(ranks - 1).cast("bigint")})
        span = ranks
        while span > 1:
            masses = _blocks(state, lay, rid, "__lo", "__hi").groupBy(*keys).cogroup(packed.groupBy(*keys)).applyInArrow(
                _read_cuts(lay.per, rid), f"{rid} {kind}, __all double, " + ", ".join(f"__c{k} double" for k in range(CUTS)))
            sums = masses.groupBy(F.col(rid).alias("__key")).agg(F.sum("__all").alias("__all"), *[F.sum(f"__c{k}").alias(f"__c{k}") for k in range(CUTS)])
            goal = F.col("__all") * F.lit(q - SLACK)
            step = F.coalesce(*[F.when(F.col(f"__c{k}") >= goal, F.lit(k)) for k in range(CUTS - 1)], F.lit(CUTS - 1))
            joined = state.join(sums, state[rid].eqNullSafe(sums["__key"]), "left").withColumn("__k", step)
            bound = lambda k: F.col("__lo") + F.expr(f"(__hi - __lo + 1) * (__k + {k}) div {CUTS}")
            state = freeze(joined.select(rid, F.when(F.col("__all") > 0, F.col("__leaves")).alias("__leaves"), bound(0).alias("__lo"),
                                         F.greatest(bound(1) - 1, bound(0)).alias("__hi")))
            span = -(-span // CUTS)
        found = state.where("__leaves is not null").select(rid, F.col("__hi").alias("__rank"))
    named = found.join(known, F.col("__rank") == F.col("value")).select(F.col(rid).alias("__key"), F.col("__y").alias(out))
    return held.select(rid).join(named, F.col(rid).eqNullSafe(F.col("__key")), "left").select(rid, out)


def predict_quantile(forest: Forest, leaves: DataFrame, df: DataFrame, q: float, rid: str, out: str = "pred",
                     offset: float | None = 0.005, **limits) -> DataFrame:
    """Conditional quantile of every row, NULL where it cannot be scored; with an offset the log scale is undone."""
    scored = quantile_of_leaves(leaves, reached(forest, df), q, rid, out="__q", **limits)
    value = F.col("__q") if offset is None else F.exp("__q") - F.lit(offset)
    return scored.select(rid, value.alias(out))


def leaf_values(forest: Forest) -> DataFrame:
    """(tree, leaf, value): each leaf's own prediction; a leaf's number is its place among a tree's leaves, from the left."""
    return forest.model.leaf_values()


def _moments(per: int, rid: str) -> Callable:
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        first, last, values, _ = _met(left, right, per)
        known = last > first
        each = np.where(known, values[np.minimum(first, max(len(values) - 1, 0))] if len(values) else 0.0, 0.0)
        n = known.sum(axis=1)
        mean = each.sum(axis=1) / np.maximum(n, 1)
        spread = (np.where(known, each - mean[:, None], 0.0) ** 2).sum(axis=1)
        return pa.table({rid: left.column(rid), "__n": pa.array(n), "__m": pa.array(mean), "__s": pa.array(spread)})
    return run


def spread_of_leaves(values: DataFrame, rows: DataFrame, rid: str, ids: str = "__leaves", chunk_rows: int = CHUNK_ROWS,
                     block_cells: int = BLOCK_CELLS) -> DataFrame:
    """(rid, pred_cap, pred_se): mean and SD over the trees of the values (tree, leaf, value) of a row's leaves."""
    table = freeze(values.select("tree", "leaf", F.col("value").cast("double").alias("value"), F.lit(0.0).alias("weight")))
    held = freeze(rows.select(rid, F.col(ids).alias("__leaves")))
    lay, keys = _layout(held, table, chunk_rows, block_cells), ["block", "chunk", "part"]
    kind = dict(held.dtypes)[rid]
    parts = _blocks(held, lay, rid).groupBy(*keys).cogroup(_packed(table, lay).groupBy(*keys)).applyInArrow(
        _moments(lay.per, rid), f"{rid} {kind}, __n bigint, __m double, __s double")
    n, m = F.col("__n"), F.col("__m")
    sums = parts.groupBy(F.col(rid).alias("__key")).agg(F.sum("__n").alias("n"), F.sum(n * m).alias("t"), F.sum(n * m * m).alias("tt"), F.sum("__s").alias("s"), F.count(F.lit(1)).alias("k"))
    between = F.when(F.col("k") > 1, F.greatest(F.col("tt") - F.col("t") * F.col("t") / F.col("n"), F.lit(0.0))).otherwise(0.0)
    se = F.when(F.col("n") > 1, F.sqrt((F.col("s") + between) / (F.col("n") - 1)))
    out = sums.select("__key", F.try_divide("t", "n").alias("pred_cap"), se.alias("pred_se"))
    return held.select(rid).join(out, F.col(rid).eqNullSafe(F.col("__key")), "left").select(rid, "pred_cap", "pred_se")


def tree_spread(forest: Forest, score: DataFrame, rid: str, **limits) -> DataFrame:
    """Mean and SD of the trees' own predictions: the forest's prediction and its error per row, NULL where it has none.

    Both are worked out where a row's trees come together; only with ``limits`` the leaf ids travel and meet a table of values.
    """
    if not limits:
        return _scored(forest, score, "spread", "__spread").select(rid, F.col("__spread.mean").alias("pred_cap"), F.col("__spread.sd").alias("pred_se"))
    return spread_of_leaves(leaf_values(forest), reached(forest, score), rid, **limits)


def rf_extrapolate(train: DataFrame, score: DataFrame, covars: Sequence[str], y: str, rid: str, by: str,
                   ntree: int = 2000, seed: int = 3, factors: Sequence[str] = (), **kw) -> DataFrame:
    """Raw-scale forests per level of ``by``, scored at every row with complete covariates of known levels."""
    forests = fit_by(train, by, lambda part, _: fit_forest(part, covars, F.col(y), ntree, seed, factors=factors, **kw))
    parts = [tree_spread(forest, score, rid).where("pred_cap is not null").withColumn(by, F.lit(lv)) for lv, forest in forests.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def relative_importance(spark: SparkSession, forests: Mapping, labels: Mapping[str, str], by: str = "species") -> DataFrame:
    """Importance over the largest importance, labelled; one row per model and covariate."""
    rows = []
    for lv, forest in forests.items():
        imp = forest.model.importance
        top = float(imp.max()) or 1.0
        rows += [(str(lv), c, labels.get(c, c), float(v) / top) for c, v in zip(forest.covars, imp)]
    return spark.createDataFrame(rows, f"{by} string, metric string, label string, rel_imp double")


def pdp_grid(df: DataFrame, covars: Sequence[str], n_pts: int = 200, factors: Mapping[str, Sequence] | None = None) -> DataFrame:
    """For each covariate an even grid over its range, the others at their median, crossed with factor levels."""
    long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("v")) for c in covars])))
    stats = exact_quantiles(long, ["metric"], "v", [0.0, 0.5, 1.0])
    one = stats.agg(*[F.max(F.when(F.col("metric") == c, F.col("q"))).alias(f"__{c}") for c in covars])
    i = F.explode(F.sequence(F.lit(0), F.lit(n_pts - 1)))
    grid = one.withColumn("metric", F.explode(F.array(*[F.lit(c) for c in covars]))).withColumn("i", i)
    value = F.lit(None).cast("double")
    at = lambda c: F.col(f"__{c}")[0] + F.col("i") * (F.col(f"__{c}")[2] - F.col(f"__{c}")[0]) / (n_pts - 1)
    for c in covars:
        value = F.when(F.col("metric") == c, at(c)).otherwise(value)
    out = grid.withColumn("value", value).select("metric", "i", "value", *[
        F.when(F.col("metric") == c, F.col("value")).otherwise(F.col(f"__{c}")[1]).alias(c) for c in covars])
    for name, lv in (factors or {}).items():
        out = out.withColumn(name, F.explode(F.array(*[F.lit(v) for v in lv])))
    return out


def partial_dependence(forest: Forest, leaves: DataFrame, grid: DataFrame, importance: DataFrame, kind: str = "quantile",
                       q: float = 0.9, offset: float | None = 0.005) -> DataFrame:
    """Score the grid at a quantile or the mean, undo the log, attach label and importance; one row per grid row, factors kept."""
    rows = freeze(grid.withColumn("__id", F.to_json(F.struct(*grid.columns), {"ignoreNullFields": "false"})))
    kept = [c for c in grid.columns if c not in ("metric", "i", "value") and (c in forest.factors or c not in forest.covars)]
    if kind == "quantile":
        pred = predict_quantile(forest, leaves, rows, q, "__id", "pred", offset)
    else:
        value = F.col("__mean") if offset is None else F.exp("__mean") - F.lit(offset)
        pred = predict(forest, rows, "__mean").select("__id", value.alias("pred"))
    return rows.join(pred, "__id").join(importance.select("metric", "label", "rel_imp"), "metric").select(
        "metric", "label", "rel_imp", "i", "value", *kept, "pred")


def rug(df: DataFrame, covars: Sequence[str], group: str, labels: Mapping[str, str]) -> DataFrame:
    """Observed covariate values, long, with labels."""
    return df.select(F.col(group).alias("group"), F.inline(F.array(*[
        F.struct(F.lit(c).alias("metric"), F.lit(labels.get(c, c)).alias("label"), F.col(c).cast("double").alias("value"))
        for c in covars])))


def pts_per_metric(df: DataFrame, selected: DataFrame, by: str, metric: str) -> DataFrame:
    n = df.groupBy(by).agg(F.count(F.lit(1)).alias("n_sites"))
    m = selected.groupBy(by).agg(F.count_distinct(metric).alias("n_mets"))
    return n.join(m, by, "left").withColumn("pts_per_met", F.try_divide("n_sites", "n_mets"))


def unit_capacity(units: DataFrame, site_keys: Sequence[str], preds: Mapping[str, str], area: str, site_length: str,
                  site_area: str) -> DataFrame:
    """Predicted density times unit area, summed to the site, per metre and per square metre."""
    sums = units.groupBy(*site_keys, site_length, site_area).agg(*[
        F.coalesce(F.sum(F.col(p) * F.col(area)), F.lit(0.0)).alias(f"{n}_tot") for n, p in preds.items()])
    out = {}
    for n in preds:
        out[f"{n}_per_m"] = F.try_divide(f"{n}_tot", site_length)
        out[f"{n}_per_m2"] = F.try_divide(f"{n}_tot", site_area)
    return sums.withColumns(out)
