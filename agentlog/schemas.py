"""Explicit schemas: no source is ever inferred."""

from __future__ import annotations

from pyspark.sql import types as T

S, L, D, B, TS = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType(), T.TimestampType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields.items()])


RAW_TEXT_FIELDS = (
    "request_id", "user_query", "query_text", "timestamp", "status", "response_status",
    "error_code", "total_tokens", "simulated_context_tokens", "estimated_manual_time_minutes",
    "manual_time_minutes", "manual_time", "estimated_manual_time", "model", "model_name",
    "agent_id", "category", "gold_category", "style", "agent_steps", "user_id", "user_name",
    "department", "source_id",
)

# `metadata` and `tools_used` stay text at the source: both are free-form JSON there.
RAW = T.StructType(
    [T.StructField(name, S, True) for name in RAW_TEXT_FIELDS]
    + [T.StructField("tools_used", S, True), T.StructField("metadata", S, True)]
)

RECORDS = _struct(
    source_id=S, request_id=S, query_text=S, gold_category=S, style=S, user_id=S, user_name=S,
    department=S, tokens=L, manual_time_minutes=D, tools_used=T.ArrayType(S), status=S,
    timestamp=TS,
)

ASSIGNMENTS = _struct(
    source_id=S, request_id=S, task_type=S, classification_confidence=D, scenario_id=S,
    scenario_name=S, is_outlier=B, has_failure_signals=B, failure_signals=T.ArrayType(S),
    timestamp=TS, query_text=S, created_at=TS, updated_at=TS,
)

CLUSTERS = _struct(
    scenario_id=S, task_type=S, name=S, summary=S, user_goal=S, pain_points=T.ArrayType(S),
    automation_potential=S, records_count=L, statistical_reliability=S,
    centroid=T.ArrayType(D), updated_at=TS,
)

SOURCES = _struct(
    source_id=S, name=S, origin=S, status=S, records_total=L, records_valid=L,
    records_rejected=L, created_at=TS,
)

COUNTERS = _struct(
    source_id=S, accepted=L, classified=L, assigned=L, rejected=L, duplicates=L,
)

RECOMPUTE_RUNS = _struct(
    job_id=S, status=S, clusters_created=L, scenarios_named=L, logs_at_completion=L,
    created_at=TS, started_at=TS, completed_at=TS, error=S,
)

VECTORS = _struct(
    request_id=S, task_type=S, scenario_id=S, source_id=S, query_text=S,
    embedding=T.ArrayType(T.FloatType()), is_outlier=B,
)

CENTROIDS = _struct(scenario_id=S, task_type=S, centroid=T.ArrayType(D), count=L)

KEYS = ("source_id", "request_id")
