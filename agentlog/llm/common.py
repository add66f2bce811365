"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from agentlog.session import shared_folder

#: White space of the word contracts: space and the control characters from tab to return.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def store(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and read it back.

    Later passes see the very same rows, read only the columns they need, and survive the
    loss of the executors that computed them.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def words(text: Column) -> Column:
    """Words of a text: maximal runs without the white space above."""
    return F.array_remove(F.split(text, SPACE), "")


def word_count(text: Column) -> Column:
    """Number of words, without building them: one per change from space to word."""
    return F.size(words(text)).cast("long")


def let(value: Column, body) -> Column:
    """`body(value)` with `value` computed once per row, however often `body` names it."""
    return F.transform(F.array(value), body)[0]


def fresh(df: DataFrame, name: str) -> str:
    """A column name that `df` does not have yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def running_totals(
    df: DataFrame, order: Sequence[str], totals: dict[str, str], group: Sequence[str] = (),
) -> DataFrame:
    """Add, for each `out: value` of `totals`, the sum of `value` over all rows before this
    one in its group.

    `df` must hold each combination of `group` and `order` once. Rows are range partitioned
    by group and order together, so a group of any size spans many tasks; the totals of the
    ranges (few numbers per range) give each range its start. The ranges are stored first
    because their borders must be the same in both passes.
    """
    keys = [*group, *order]
    part = "__range"
    ranged = store(
        df.repartitionByRange(*keys).withColumn(part, F.spark_partition_id()), "ranges"
    )
    before = Window.partitionBy(*group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy(*group, part).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, -1
    )
    per_range = ranged.groupBy(*group, part).agg(
        *[F.sum(value).alias(f"__sum_{out}") for out, value in totals.items()]
    )
    starts = per_range.select(
        *[F.col(g).alias(f"__of_{g}") for g in group], F.col(part).alias("__of_range"),
        *[F.coalesce(F.sum(f"__sum_{out}").over(before), F.lit(0)).alias(f"__start_{out}") for out in totals],
    )
    same = F.col(part) == F.col("__of_range")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"__of_{g}"))
    within = ranged.select(
        "*", *[F.coalesce(F.sum(value).over(inside), F.lit(0)).alias(f"__in_{out}") for out, value in totals.items()]
    )
    return within.join(starts, same).select(
        *df.columns, *[(F.col(f"__start_{out}") + F.col(f"__in_{out}")).alias(out) for out in totals]
    )
