"""Filters and the record-assignment view every report starts from.

No join hint is given for data whose size is unknown: Catalyst and AQE broadcast by
measured size and split skewed partitions. Whole-table figures come in as scalar
subqueries, which always hold exactly one row.
"""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, functions as F

from agentlog.config import Filters
from agentlog.functions.records import USER_FAILURE_STATUSES
from agentlog.functions.taxonomy import filled
from agentlog.functions.text import strip


def parse_bound(value: str | None, end: bool = False) -> datetime | None:
    """ISO date or date-time of a filter as UTC; a bare end date means its last moment.

    Raises ValueError on anything else.
    """
    if value is None or not value.strip():
        return None
    raw = value.strip()
    if not re.match(r"^\d{4}-\d{2}-\d{2}", raw):
        raise ValueError(f"expected an ISO 8601 date or date-time, got {value!r}")
    moment = datetime.fromisoformat(raw.replace("Z", "+00:00"))
    if moment.tzinfo is None:
        moment = moment.replace(tzinfo=timezone.utc)
    if end and len(raw) == 10:
        moment += timedelta(days=1) - timedelta(microseconds=1)
    return moment.astimezone(timezone.utc)


def _literal(moment: datetime) -> Column:
    return F.lit(moment.strftime("%Y-%m-%d %H:%M:%S.%f+00:00")).cast("timestamp")


def apply_filters(df: DataFrame, filters: Filters) -> DataFrame:
    """Source, inclusive time range, class, scenario and failure predicates."""
    if filters.source_id:
        df = df.where(F.col("source_id") == filters.source_id)
    start, stop = parse_bound(filters.from_), parse_bound(filters.to, end=True)
    if start is not None:
        df = df.where(F.col("timestamp") >= _literal(start))
    if stop is not None:
        df = df.where(F.col("timestamp") <= _literal(stop))
    if filters.task_type:
        df = df.where(F.col("task_type") == filters.task_type)
    if filters.scenario_id:
        df = df.where(F.col("scenario_id") == filters.scenario_id)
    if filters.only_failures:
        df = df.where(
            F.coalesce("has_failure_signals", F.lit(False))
            | F.coalesce(F.col("status").isin(*USER_FAILURE_STATUSES), F.lit(False))
        )
    return df


_ASSIGNED = (
    "task_type", "classification_confidence", "scenario_id", "scenario_name", "is_outlier",
    "has_failure_signals",
)


def joined(records: DataFrame, assignments: DataFrame) -> DataFrame:
    """Records with their assignment, if any (J1). All rows: nothing here needs a cap."""
    keys = ["source_id", "request_id"]
    cols = [c for c in _ASSIGNED if c in assignments.columns]
    return records.join(assignments.select(*keys, *cols), keys, "left")


def with_scenario_name(assignments: DataFrame, clusters: DataFrame) -> DataFrame:
    """Assignments with the current name of their scenario."""
    names = clusters.select("scenario_id", F.col("name").alias("scenario_name"))
    return assignments.drop("scenario_name").join(names, "scenario_id", "left")


def recompute_input(assignments: DataFrame, vectors: DataFrame, dim: int) -> DataFrame:
    """Assignments with their vector; a missing one is all zeros and flagged.

    Joined by source and request when the vectors name their source: ids repeat between
    sources.
    """
    zeros = F.array_repeat(F.lit(0.0).cast("float"), dim)
    keys = [k for k in ("source_id", "request_id") if k in vectors.columns and k in assignments.columns]
    return (
        assignments.join(vectors.select(*keys, "embedding"), keys, "left")
        .withColumn("has_vector", F.col("embedding").isNotNull())
        .withColumn("embedding", F.coalesce("embedding", zeros))
    )


def unassigned(records: DataFrame, assignments: DataFrame) -> DataFrame:
    """Stored records that have no assignment yet."""
    keys = ["source_id", "request_id"]
    return records.join(assignments.select(*keys), keys, "left_anti")


def named_scenarios(scenarios: DataFrame, n: int = 10) -> DataFrame:
    """The largest scenarios that carry a name."""
    named = scenarios.where(strip(filled(F.col("name"), "")) != "")
    return named.orderBy(F.desc("count"), "scenario_id").limit(n)


def pending_sources(progress: DataFrame) -> DataFrame:
    """Sources whose records are not all classified."""
    return progress.where(~F.col("done"))


def broadcast_checked(df: DataFrame, max_rows: int = 100_000) -> DataFrame:
    """Broadcast hint only for a table found to have at most `max_rows` rows.

    Used on sides whose size Catalyst cannot know before it runs, such as one row per
    class; a larger table is left to an ordinary join.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def share(df: DataFrame, col: str, out: str = "percentage") -> DataFrame:
    """Share of a column's total in percent, one digit."""
    from agentlog.functions.numeric import percent

    total = df.agg(F.sum(col)).scalar()
    return df.withColumn(out, percent(F.col(col), total))


def count_rows(df: DataFrame, filters: Filters = Filters()) -> DataFrame:
    """Number of rows behind a filter."""
    return apply_filters(df, filters).agg(F.count(F.lit(1)).alias("total"))
