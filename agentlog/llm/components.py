"""Connected components of a link table, by distributed label passing."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from agentlog.llm.common import store


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of `links` (a, b: long): root is the smallest node it is
    connected to.

    Each round every node takes the smallest label among itself and its neighbours, then
    the label of its label, so labels travel doubling distances. Rounds are stored, which
    cuts the lineage. Nodes of any degree are reduced by partial aggregation.
    """
    both = store(
        links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).filter("a <> b").distinct(),
        "edges",
    )
    labels = store(
        both.groupBy(F.col("a").alias("node")).agg(F.least("a", F.min("b")).alias("root")), "labels"
    )
    while True:
        near = (
            both.join(labels, F.col("b") == F.col("node"))
            .groupBy("a").agg(F.min("root").alias("near"))
        )
        lower = labels.join(near, F.col("node") == F.col("a")).select(
            "node", F.col("root").alias("old"), F.least("root", "near").alias("root")
        )
        jump = labels.select(F.col("node").alias("via"), F.col("root").alias("far"))
        moved = store(
            lower.join(jump, F.col("root") == F.col("via"), "left").select(
                "node", "old", F.least("root", "far").alias("root")
            ),
            "labels",
        )
        labels = moved.select("node", "root")
        if moved.filter("root <> old").isEmpty():
            return labels
