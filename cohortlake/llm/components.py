"""Connected components of links, with labels that jump along themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlake.session import materialise


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``component`` (the smallest node reachable) for every node of a link.

    ``links`` has columns ``a`` and ``b`` of one ordered type; nulls link with nothing. Each
    round takes the smallest label around a node, then the label of that label, so a chain
    of n nodes needs about log n rounds. Rounds are written, never collected; what reaches
    the driver is one count per round.
    """
    given = links.filter("a is not null and b is not null and a != b").select("a", "b")
    both = materialise(given.union(given.select(F.col("b"), F.col("a"))).distinct())
    labels = materialise(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select(
        "node", F.least("node", "b").alias("label")))
    while True:
        around = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(
            F.min("label").alias("near"))
        nearer = labels.join(around, "node").select(
            "node", F.col("label").alias("before"), F.least("label", "near").alias("label"))
        target = labels.select(F.col("node").alias("label"), F.col("label").alias("onward"))
        jumped = materialise(nearer.join(target, "label").select(
            "node", "before", F.least("label", "onward").alias("label")))
        moved = jumped.filter("label != before").limit(1).count()
        labels = jumped.select("node", "label")
        if not moved:
            return labels.select("node", F.col("label").alias("component"))
