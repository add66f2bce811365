"""Connected components of link tables of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from agentlog.session import cut_lineage


def components(links: DataFrame, within: Sequence[str] = ()) -> DataFrame:
    """(within..., node, root) for every node of `links` (within..., a, b), where root is the
    smallest node connected to it among the links of equal `within`.

    So several graphs over the same nodes are settled in the same rounds. In a round every
    node, and the node its label names, takes the smallest label of a label among its
    neighbours'; whole trees of labels hook onto each other at once, so rounds are few even
    in long chains. A node of any degree is reduced by partial aggregation. Labels are
    checkpointed each round.
    """
    keys = list(within)
    back = links.select(*keys, F.col("b").alias("a"), F.col("a").alias("b"))
    both = cut_lineage(links.select(*keys, "a", "b").union(back).where("a <> b").distinct())
    start = both.groupBy(*keys, F.col("a").alias("node")).agg(F.min("b").alias("__b"))
    labels = start.select(*keys, "node", F.least("node", "__b").alias("root"))
    labels = cut_lineage(_with_far(labels, keys))
    while True:
        theirs = labels.select(*keys, F.col("node").alias("b"), F.col("far").alias("__near"))
        near = both.join(theirs, [*keys, "b"]).groupBy(*keys, F.col("a").alias("node")).agg(
            F.min("__near").alias("__near")
        )
        mine = labels.join(near, [*keys, "node"])
        hooked = mine.groupBy(*keys, F.col("root").alias("node")).agg(F.min("__near").alias("__hook"))
        lower = mine.join(hooked, [*keys, "node"], "left").select(
            *keys, "node", F.col("far").alias("__old"), F.least("far", "__near", "__hook").alias("root")
        )
        moved = cut_lineage(_with_far(lower, keys))
        labels = moved.drop("__old")
        if moved.where("far <> __old").isEmpty():
            return labels.drop("far")


def _with_far(labels: DataFrame, keys: list[str]) -> DataFrame:
    """Labels with `far`, the label of the label."""
    of = labels.select(*keys, F.col("node").alias("root"), F.col("root").alias("far"))
    return labels.join(of, [*keys, "root"])
