"""Keyed row selection and table maintenance.

Rows of one key are reduced by aggregates, never by a window over the key: the map side
folds copies first, so a key that holds a third of all rows does not land in one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from agentlog.functions.taxonomy import filled
from agentlog.schemas import KEYS

_ROW = "__row"


def _pick(df: DataFrame, keys: Sequence[str], order: Sequence[str], aggregate) -> DataFrame:
    rest = [c for c in df.columns if c not in keys and c not in order]
    row = F.struct(*[F.col(c) for c in [*order, *rest]])
    picked = df.groupBy(*keys).agg(aggregate(row).alias(_ROW))
    return picked.select(*keys, f"{_ROW}.*").select(*df.columns)


def first_per(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row of each key; ties fall to the smallest remaining columns."""
    return _pick(df, keys, order, F.min)


def last_per(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Last row of each key; ties fall to the largest remaining columns."""
    return _pick(df, keys, order, F.max)


def dedup_texts(
    df: DataFrame, text: str = "query_text", order: Sequence[str] = ("timestamp", "request_id")
) -> DataFrame:
    """One row per exact text, the first one."""
    return first_per(df, [text], order)


def dedup_keys(
    df: DataFrame, keys: Sequence[str], order: Sequence[str] = ("timestamp",)
) -> DataFrame:
    """One row per key, the last one."""
    return last_per(df, keys, order)


def argmax_count(df: DataFrame, group: Sequence[str], key: str) -> DataFrame:
    """Most frequent `key` of each group, ties by name."""
    counts = df.groupBy(*group, key).agg(F.count(F.lit(1)).alias("__n"))
    best = F.min(F.struct((-F.col("__n")).alias("__n"), F.col(key).alias(key))).alias("__best")
    return counts.groupBy(*group).agg(best).select(*group, F.col(f"__best.{key}").alias(key))


def union_ids(a: DataFrame, b: DataFrame, col: str = "scenario_id") -> DataFrame:
    """Distinct ids of either side."""
    return a.select(col).union(b.select(col)).distinct()


def append_new(
    new: DataFrame,
    existing: DataFrame,
    keys: Sequence[str],
    order: Sequence[str] = ("timestamp",),
) -> DataFrame:
    """Rows to append: keys not stored yet, first occurrence in the batch."""
    return not_stored(first_per(new, keys, order), existing, keys)


def not_stored(fresh: DataFrame, existing: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key is not in the stored table.

    The stored side is first cut to the keys at hand: with a batch small enough to be
    broadcast, the large table is scanned for its key columns but not shuffled.
    """
    keys = list(keys)
    known = existing.select(*keys).join(fresh.select(*keys), keys, "left_semi")
    return fresh.join(known, keys, "left_anti")


def upsert(
    target: DataFrame,
    updates: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    now: datetime | Column,
) -> DataFrame:
    """New content of a table after an upsert; the last update of a key wins.

    The target is only probed with semi and anti joins, so a batch that is small enough
    to be broadcast leaves the target unshuffled.
    """
    keys = list(keys)
    stamp = now if isinstance(now, Column) else F.lit(now)
    stamp = stamp.cast("timestamp")
    fresh = last_per(updates, keys, order)
    touched = fresh.select(*keys)
    created = target.select(*keys, F.col("created_at").alias("__created")).join(
        touched, keys, "left_semi"
    )
    rows = (
        fresh.drop("created_at", "updated_at")
        .join(created, keys, "left")
        .withColumn("created_at", F.coalesce("__created", stamp))
        .withColumn("updated_at", stamp)
        .drop("__created")
    )
    return target.join(touched, keys, "left_anti").unionByName(rows, allowMissingColumns=True)


def delete_keys(df: DataFrame, keys: DataFrame, on: Sequence[str] = ("request_id",)) -> DataFrame:
    """Rows whose key is not listed."""
    return df.join(keys.select(*on), list(on), "left_anti")


def lookup(df: DataFrame, keys: DataFrame, on: Sequence[str] = ("request_id",)) -> DataFrame:
    """Rows whose key is listed; many point look-ups in one pass (F8)."""
    return df.join(keys.select(*on), list(on), "left_semi")


def update_scenarios(
    assignments: DataFrame, new: DataFrame, now: datetime | Column, order: Sequence[str],
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Overwrite scenario and outlier flag of the listed keys only.

    Of several updates of a key the last in `order` counts, whatever its values; rows
    without a request id are left out. Ids repeat between sources, so both are the key.
    """
    stamp = (now if isinstance(now, Column) else F.lit(now)).cast("timestamp")
    by = [f"__order_{i}" for i in range(len(order))]
    change = new.where(filled(F.col("request_id"), "") != "").select(
        *keys,
        F.col("scenario_id").alias("__sid"),
        F.coalesce("is_outlier", F.lit(False)).alias("__out"),
        F.lit(True).alias("__hit"),
        *[F.col(c).alias(name) for c, name in zip(order, by)],
    )
    change = last_per(change, keys, by).drop(*by)
    hit = F.coalesce("__hit", F.lit(False))
    return (
        assignments.join(change, list(keys), "left")
        .withColumn("scenario_id", F.when(hit, F.col("__sid")).otherwise(F.col("scenario_id")))
        .withColumn("is_outlier", F.when(hit, F.col("__out")).otherwise(F.col("is_outlier")))
        .withColumn("updated_at", F.when(hit, stamp).otherwise(F.col("updated_at")))
        .select(*assignments.columns)
    )


COUNTERS = ("accepted", "classified", "assigned", "rejected", "duplicates")


def merge_counters(counters: DataFrame, delta: DataFrame) -> DataFrame:
    """Add per-source counts; a blank source counts as `_unknown`."""
    cols = ["source_id", *COUNTERS]
    both = counters.select(*cols).unionByName(delta.select(*cols))
    return both.groupBy(filled(F.col("source_id"), "_unknown").alias("source_id")).agg(
        *[F.sum(F.coalesce(c, F.lit(0))).cast("bigint").alias(c) for c in COUNTERS]
    )


def replace_clusters(old: DataFrame, new: DataFrame) -> DataFrame:
    """Clusters of recomputed task types are replaced, the others kept (U4)."""
    types = new.select("task_type").distinct()
    return old.join(types, "task_type", "left_anti").unionByName(new, allowMissingColumns=True)


def add_source_counts(sources: DataFrame, delta: DataFrame) -> DataFrame:
    """Add the counts of live batches to their sources."""
    cols = ("records_total", "records_valid", "records_rejected")
    sums = delta.groupBy("source_id").agg(*[F.sum(c).alias(f"__{c}") for c in cols])
    out = sources.join(sums, "source_id", "left")
    for c in cols:
        out = out.withColumn(c, F.col(c) + F.coalesce(F.col(f"__{c}"), F.lit(0)))
    return out.select(*sources.columns)


def resume_sources(sources: DataFrame, resumed: DataFrame) -> DataFrame:
    """Failed sources that are sent again count as ingesting."""
    marked = sources.join(
        resumed.select("source_id").distinct().withColumn("__hit", F.lit(True)), "source_id", "left"
    )
    failed = F.col("__hit").isNotNull() & (F.col("status") == "failed")
    return marked.withColumn(
        "status", F.when(failed, F.lit("ingesting")).otherwise(F.col("status"))
    ).select(*sources.columns)


def mark_recomputed(sources: DataFrame) -> DataFrame:
    """After a recompute every source but the failed ones is done."""
    return sources.withColumn(
        "status", F.when(F.col("status") != "failed", F.lit("recomputed")).otherwise(F.col("status"))
    )


def ensure_live_sources(sources: DataFrame, wanted: DataFrame, now: datetime | Column) -> DataFrame:
    """Add the rolling live source of each wanted name unless it exists.

    `wanted` has source_id and name; the oldest id of a name is used.
    """
    stamp = (now if isinstance(now, Column) else F.lit(now)).cast("timestamp")
    live = sources.where(F.col("origin") == "live")
    fresh = (
        first_per(wanted.select("source_id", "name"), ["name"], ["source_id"])
        .join(live.select("name"), "name", "left_anti")
        .select(
            "source_id",
            "name",
            F.lit("live").alias("origin"),
            F.lit("classified").alias("status"),
            *[F.lit(0).cast("bigint").alias(c) for c in ("records_total", "records_valid", "records_rejected")],
            stamp.alias("created_at"),
        )
    )
    return sources.unionByName(fresh, allowMissingColumns=True)


def changed_since(assignments: DataFrame, since: datetime | str) -> DataFrame:
    """Assignments updated after a moment, for an incremental re-sync."""
    return assignments.where(F.col("updated_at") > F.lit(since).cast("timestamp"))


def duplicate_keys(df: DataFrame, keys: Sequence[str] = ("source_id", "request_id")) -> DataFrame:
    """Keys that occur more than once (Q9)."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
