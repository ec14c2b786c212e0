"""Connected components by contraction, in Spark alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reachworks.session import freeze


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every end of the edges (a, b): component is the smallest id reachable.

    Every round each node takes its smallest neighbour, if smaller than itself, as parent, jumps to its parent's
    parent, and the edges are rewritten between parents. Parents only ever get smaller, so the smallest node of a
    component stays to the last, and each round at least halves the nodes that still have edges.
    """
    edges = freeze(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())
    steps: list[DataFrame] = []
    while not edges.isEmpty():
        ends = edges.select(F.col("a").alias("id"), F.col("b").alias("other")).unionByName(edges.select(F.col("b").alias("id"), F.col("a").alias("other")))
        parent = freeze(ends.groupBy("id").agg(F.least("id", F.min("other")).alias("component")))
        up = parent.select(F.col("id").alias("component"), F.col("component").alias("top"))
        step = freeze(parent.join(up, "component").select("id", F.col("top").alias("component")))
        steps.append(step)
        a = step.select(F.col("id").alias("a"), F.col("component").alias("pa"))
        b = step.select(F.col("id").alias("b"), F.col("component").alias("pb"))
        edges = freeze(edges.join(a, "a").join(b, "b").where("pa <> pb")
                       .select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct())
    if not steps:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    out = steps[0]
    for step in steps[1:]:
        later = step.select(F.col("id").alias("component"), F.col("component").alias("top"))
        out = freeze(out.join(later, "component", "left").select("id", F.coalesce("top", "component").alias("component")))
    return out
