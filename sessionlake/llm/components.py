"""Connected components by rounds of hooking and pointer jumping.

Every round each node hooks onto the smallest neighbour below it, the hooks
are followed to their roots by doubling, and the edges are rewritten between
roots. The number of roots with edges at least halves a round, so the rounds
grow with the logarithm of the largest component. All steps are aggregates
and joins on nodes; no list of neighbours is ever collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns a, b; one integer or string type).

    ``root`` is the smallest node of the component. Loops, repeated and
    reversed edges are fine; rows with a null end are left out.
    """
    edges = edges.filter("a is not null and b is not null and a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = materialize(edges, "cc-edges")
    labels = None
    while not edges.isEmpty():
        hooks = edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
        tops = edges.select(F.col("b").alias("node")).distinct().join(hooks.select("node"), "node", "left_anti")
        step = materialize(hooks.unionByName(tops.select("node", F.col("node").alias("root"))), "cc-hooks")
        while True:
            above = step.select(F.col("node").alias("root"), F.col("root").alias("above"))
            jumped = materialize(step.join(above, "root").select("node", F.col("above").alias("root"), (F.col("above") != F.col("root")).alias("moved")), "cc-jump")
            step = jumped.select("node", "root")
            if jumped.filter("moved").isEmpty():
                break
        to = step.select(F.col("node").alias("root"), F.col("root").alias("top"))
        if labels is None:
            labels = step
        else:
            labels = materialize(labels.join(to, "root", "left").select("node", F.coalesce("top", "root").alias("root")), "cc-labels")
        ends = edges.join(step.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a").join(step.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b")
        edges = materialize(ends.filter("ra != rb").select(F.greatest("ra", "rb").alias("a"), F.least("ra", "rb").alias("b")).distinct(), "cc-edges")
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return labels
