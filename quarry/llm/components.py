"""Connected components of a link table, by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.tables import written


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of links(a, b); component is the smallest node reachable.

    Each round takes the smallest label among a node and its neighbours, then the label of that
    label, so chains shorten by half or more. Rounds are written tables; only a count reaches the
    driver. A node without links is not in links and keeps its own id: callers coalesce.
    """
    both = written(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels")
    for _ in range(most_rounds):
        near = (
            both.join(labels, F.col("b") == F.col("node"))
            .groupBy("a")
            .agg(F.min("component").alias("_near"))
        )
        lower = labels.join(near, F.col("node") == F.col("a")).select(
            "node", F.least("component", "_near").alias("component"), F.col("component").alias("_was")
        )
        jump = labels.select(F.col("node").alias("_at"), F.col("component").alias("_to"))
        labels_next = written(
            lower.join(jump, F.col("component") == F.col("_at"), "left").select(
                "node", F.least("component", F.coalesce("_to", "component")).alias("component"), "_was"
            ),
            "labels",
        )
        changed = not labels_next.where("component <> _was").isEmpty()
        labels = labels_next.drop("_was")
        if not changed:
            return labels
    raise RuntimeError("components did not settle")
