"""Paged lists of logs, assignments and clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from agentlog.config import Filters
from agentlog.functions.records import USER_FAILURE_STATUSES
from agentlog.functions.taxonomy import label
from agentlog.operators.joins import apply_filters, with_scenario_name


def log_items(joined: DataFrame) -> DataFrame:
    """Rows as the log list shows them (O2).

    A label only where a class was assigned; a failing record without assignment counts
    as failing.
    """
    unassigned_failure = F.col("task_type").isNull() & F.coalesce(
        F.col("status").isin(*USER_FAILURE_STATUSES), F.lit(False)
    )
    return joined.select(
        "request_id",
        "query_text",
        "task_type",
        F.when(F.coalesce(F.col("task_type"), F.lit("")) != "", label(F.col("task_type"))).alias("label"),
        "classification_confidence",
        "scenario_id",
        "scenario_name",
        F.coalesce("is_outlier", F.lit(False)).alias("is_outlier"),
        (unassigned_failure | F.coalesce("has_failure_signals", F.lit(False))).alias("has_failure_signals"),
        "timestamp",
    )


def logs_page(joined: DataFrame, filters: Filters, limit: int, offset: int = 0) -> DataFrame:
    """One page in time order; each partition keeps only limit + offset rows (O1)."""
    kept = apply_filters(joined, filters)
    page = kept.orderBy(F.asc_nulls_last("timestamp"), "request_id").offset(offset).limit(limit)
    return log_items(page)


def assignments_page(
    assignments: DataFrame, clusters: DataFrame, filters: Filters, limit: int, offset: int = 0
) -> DataFrame:
    """One page, newest first, with scenario names joined to the page only (O3)."""
    kept = apply_filters(assignments, filters)
    page = kept.orderBy(F.desc("timestamp"), "request_id").offset(offset).limit(limit)
    return with_scenario_name(page, clusters)


def list_clusters(clusters: DataFrame) -> DataFrame:
    """Scenarios, largest first."""
    return clusters.orderBy(F.desc("records_count"), "scenario_id")
