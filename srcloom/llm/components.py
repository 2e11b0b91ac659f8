"""Connected components of links, by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcloom.session import written

MOST_ROUNDS = 200


def components(links: DataFrame, label: str = "label") -> DataFrame:
    """(a, b) links to (node, label): the least node each can reach, itself included.

    Every round a node takes the least label among its neighbours and itself, combined on the map side, and then
    the label of that label. Each round is written to the shared folder, which cuts the lineage. The number
    of rounds follows the logarithm of the longest path; no group of links meets in one task.
    """
    both = written(
        links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(),
        "links",
    )
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias(label)), "labels")
    for _ in range(MOST_ROUNDS):
        near = both.join(labels, both.a == labels.node).groupBy(F.col("b").alias("node")).agg(F.min(label).alias("_near"))
        moved = labels.join(near, "node").select("node", F.col(label).alias("_old"), F.least(label, "_near").alias("_new"))
        to = labels.select(F.col("node").alias("_new"), F.col(label).alias("_far"))
        jumped = written(moved.join(to, "_new").select("node", "_old", F.least("_new", "_far").alias(label)), "labels")
        labels = jumped.select("node", label)
        if jumped.where(F.col(label) < F.col("_old")).isEmpty():
            return labels
    raise RuntimeError(f"components did not settle within {MOST_ROUNDS} rounds")
