"""Connected components of a link table, by rounds of minimum propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import written


def connected_components(links: DataFrame, most_rounds: int = 64) -> DataFrame:
    """(node, component) for every node of ``links(a, b)``; component is the least node reachable.

    A round gives each node the least label among its neighbours and itself, then replaces the label
    by its own label. Labels only fall, and the loop ends when none does, so the result is exact; the
    pointer step makes the rounds few. Every round is written to the shared folder. Links stay in
    Spark; the driver sees one count a round.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b").distinct()
    both = written(both, "links")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("component")), "labels")
    for _ in range(most_rounds):
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        low = labels.join(near, "node", "left").select("node", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        up = labels.select(F.col("node").alias("component"), F.col("component").alias("up"))
        after = written(low.join(up, "component", "left").select("node", "old", F.least("component", "up").alias("component")), "labels")
        changed = after.where("component < old").limit(1).count()
        labels = after.select("node", "component")
        if not changed:
            return labels
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
