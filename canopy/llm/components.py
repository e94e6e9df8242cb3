"""Connected components of a graph given as edges: each node follows its least neighbour to a root, and the roots are the next, smaller graph's nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopy.llm.common import stage


def flat(follows: DataFrame) -> DataFrame:
    """node, label: the root that node reaches by follows(node, label), a written table in which labels are less than their nodes. Each round halves the way."""
    while True:
        after = follows.select(F.col("label").alias("_n"), "node").join(follows.select(F.col("node").alias("_n"), F.col("label").alias("_l")), "_n", "left")
        after = stage(after.select("node", F.coalesce("_l", "_n").alias("label"), F.col("_l").isNotNull().alias("moved")), "roots")
        follows = after.select("node", "label")
        if after.filter("moved").isEmpty():
            return follows


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """node, label (the component's least node) for each node of edges(a, b). Loops and repeated edges are allowed; no edges give no rows.

    An edge is kept once, from its greater end to its lesser, and goes as soon as its ends have one root, so that all rounds
    together join little more than the edges. Two rounds at least halve the nodes that still have edges: a root whose
    neighbours don't all follow it is next to a lesser one afterwards. Each round's tables are written to the shared folder;
    the driver sees one bit a round. A node with very many edges meets them in joins that adaptive execution splits and in
    sums that are combined before the shuffle.
    """
    ends = lambda a, b: (F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi"))
    left = stage(edges.select(*ends("a", "b")).distinct(), "edges")
    labels = stage(left.select(F.explode(F.array("lo", "hi")).alias("node")).distinct().withColumn("label", F.col("node")), "labels")
    left = left.filter("lo < hi")
    while not left.isEmpty():
        if not rounds:
            raise RuntimeError("components did not settle in the rounds allowed")
        rounds -= 1
        roots = flat(stage(left.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("label")), "follows"))
        to = lambda x: roots.select(F.col("node").alias(x), F.col("label").alias(f"{x}_root"))  # noqa: E731, B023
        met = left.join(to("hi"), "hi").join(to("lo"), "lo", "left").select(F.coalesce("lo_root", "lo").alias("a"), F.col("hi_root").alias("b"))
        left = stage(met.filter("a <> b").select(*ends("a", "b")).distinct(), "edges")
        labels = stage(labels.join(to("label"), "label", "left").select("node", F.coalesce("label_root", "label").alias("label")), "labels")
    return labels
