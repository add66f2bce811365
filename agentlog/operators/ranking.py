"""Ranks inside groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from agentlog.operators.joins import broadcast_checked
from agentlog.session import cut_lineage
from agentlog.sources.raw import with_row_index


def rank_within(
    df: DataFrame, group: Sequence[str], order: Sequence[str], out: str = "rank",
    size: str | None = None,
) -> DataFrame:
    """0-based rank of every row in its group (and the group's size), without a window
    over the group.

    The sort is range partitioned by group and order together, so a large group spans
    many tasks; ranks are dense row numbers minus the first one of the group. The sorted
    rows are checkpointed because their numbers must not change between passes.
    """
    ordered = cut_lineage(df.orderBy(*group, *order))
    numbered = with_row_index(ordered, "__idx")
    groups = numbered.groupBy(*group).agg(
        F.min("__idx").alias("__start"), F.count(F.lit(1)).alias(size or "__size")
    )
    return (
        numbered.join(broadcast_checked(groups), list(group))
        .withColumn(out, F.col("__idx") - F.col("__start"))
        .drop("__idx", "__start", "__size")
    )
