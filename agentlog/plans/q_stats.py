"""Statistics read-model, filters and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from agentlog.config import Filters
from agentlog.operators import joins, stats
from agentlog.plans.q_roi import label_sql, pct, r
from agentlog.plans.registry import query

A = ("fx_assignments",)
AC = ("fx_assignments", "fx_clusters")
J = ("joined",)


def _ts(c: str = "timestamp"):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


def _ts_sql(c: str = "timestamp", out: str | None = None) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S') AS {out or c}"


# --- filters ----------------------------------------------------------------------

WEEK = Filters(source_id="src_1", from_="2024-01-05", to="2024-01-12")
WEEK_SQL = "source_id = 'src_1' AND timestamp >= TIMESTAMP '2024-01-05 00:00:00' AND timestamp < TIMESTAMP '2024-01-13 00:00:00'"


@query("F1_source_filter", "SELECT request_id FROM fx_records WHERE source_id = 'src_1'", ("fx_records",))
def _(fx):
    return joins.apply_filters(fx.records, Filters(source_id="src_1")).select("request_id")


@query("F2_time_range", f"SELECT request_id, {_ts_sql()} FROM fx_records WHERE {WEEK_SQL}", ("fx_records",))
def _(fx):
    return joins.apply_filters(fx.records, WEEK).select("request_id", _ts())


@query(
    "F3_class_and_scenario",
    "SELECT request_id, status FROM joined WHERE task_type = 'code_help' AND scenario_id = 'code_help:cluster_1'",
    J,
)
def _(fx):
    f = Filters(task_type="code_help", scenario_id="code_help:cluster_1")
    return joins.apply_filters(fx.joined, f).select("request_id", "status")


@query(
    "F4_only_failures",
    "SELECT request_id, status FROM joined WHERE coalesce(has_failure_signals, false) OR status IN ('error_tool', 'hallucination_loop', 'error')",
    J,
)
def _(fx):
    return joins.apply_filters(fx.joined, Filters(only_failures=True)).select("request_id", "status")


@query(
    "A21_count_rows",
    f"SELECT count(*) AS total FROM fx_assignments WHERE {WEEK_SQL}",
    A,
)
def _(fx):
    return joins.count_rows(fx.assignments, WEEK)


# --- joins ------------------------------------------------------------------------


@query(
    "J1_joined",
    "SELECT source_id, request_id, status, tokens, task_type, scenario_id, is_outlier, has_failure_signals FROM joined",
    J,
)
def _(fx):
    return fx.joined.select(
        "source_id", "request_id", "status", "tokens", "task_type", "scenario_id", "is_outlier", "has_failure_signals"
    )


@query(
    "J2_with_scenario_name",
    "SELECT request_id, a.scenario_id, c.name AS scenario_name FROM fx_assignments a LEFT JOIN fx_clusters c USING (scenario_id)",
    AC,
)
def _(fx):
    return joins.with_scenario_name(fx.assignments, fx.clusters).select("request_id", "scenario_id", "scenario_name")


COUNTS = """, counts AS (SELECT scenario_id, count(*) AS count FROM fx_assignments WHERE NOT is_outlier AND coalesce(scenario_id, '') <> '' GROUP BY scenario_id),
 known AS (SELECT * FROM counts WHERE scenario_id IN (SELECT scenario_id FROM fx_clusters))
"""


@query("J4_known_scenarios", COUNTS + "SELECT scenario_id, count FROM known", AC)
def _(fx):
    return stats.known_scenario_counts(fx.assignments, fx.clusters)


@query(
    "J7_label_lookup",
    f"SELECT task_type, {label_sql('task_type')} AS label, count(*) AS n FROM joined GROUP BY ALL",
    J,
)
def _(fx):
    return fx.joined.groupBy("task_type").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "label", stats.label(F.col("task_type"))
    )


@query(
    "O7_row_cap",
    "SELECT source_id, request_id FROM joined",
    J,
)
def _(fx):
    return joins.joined(fx.records, fx.assignments).select("source_id", "request_id")


# --- aggregates -------------------------------------------------------------------


@query(
    "A1_totals",
    COUNTS + f"""SELECT count(*) AS records_total, (SELECT count(*) FROM known) AS scenarios_count, count(CASE WHEN coalesce(task_type, 'unknown') = 'unknown' THEN 1 END) AS unknown_count,
 {pct('count(CASE WHEN is_outlier THEN 1 END)', 'count(*)', 4)} AS outliers_percentage FROM fx_assignments""",
    AC,
)
def _(fx):
    return stats.totals(fx.assignments, fx.clusters)


def topn_sql(counts: str, key: str, n: int) -> str:
    """Top-n with tail and protected `unknown` over a relation (key, count)."""
    return f""", rk AS (SELECT {key}, count, row_number() OVER (ORDER BY count DESC, {key}) AS rank FROM {counts} WHERE {key} <> 'unknown'),
 merged AS (SELECT {key}, sum(count)::BIGINT AS count, min(rank) AS rank FROM (SELECT CASE WHEN rank > {n} THEN 'other' ELSE {key} END AS {key}, count, least(rank, {n} + 1) AS rank FROM rk) GROUP BY 1),
 topn AS (SELECT * FROM merged UNION ALL SELECT {key}, count, {n} + 1 + row_number() OVER (ORDER BY count DESC) FROM {counts} WHERE {key} = 'unknown')
"""


TASKS = ", tc AS (SELECT coalesce(nullif(task_type, ''), 'unknown') AS task_type, count(*) AS count FROM fx_assignments GROUP BY 1)"


@query("A2_task_distribution", TASKS + topn_sql("tc", "task_type", 7) + "SELECT * FROM topn", A)
def _(fx):
    return stats.task_distribution(fx.assignments)


@query("W4_topn_other", TASKS + topn_sql("tc", "task_type", 3) + "SELECT * FROM topn", A)
def _(fx):
    return stats.task_distribution(fx.assignments, n=3)


TRENDS = f""", b AS (SELECT min(timestamp) AS lo, max(timestamp) AS hi, count(timestamp) AS n FROM fx_assignments),
 m AS (SELECT CASE WHEN n >= 2 THEN make_timestamp(epoch_us(lo) + (epoch_us(hi) - epoch_us(lo)) // 2) END AS mid FROM b),
 h AS (SELECT coalesce(nullif(scenario_id, ''), 'unknown') AS scenario_id, count(CASE WHEN timestamp <= mid THEN 1 END) AS p, count(CASE WHEN timestamp > mid THEN 1 END) AS c FROM fx_assignments, m WHERE NOT is_outlier AND timestamp IS NOT NULL GROUP BY 1),
 g AS (SELECT *, (c - p)::DOUBLE / nullif(p, 0)::DOUBLE * 100 AS growth, (p + c < 20 OR p < 5) AS unsure FROM h),
 tr AS (SELECT scenario_id, CASE WHEN p = 0 AND c > 0 THEN 'new' WHEN p = 0 OR unsure THEN 'insufficient_data' WHEN growth > 15 THEN 'up' WHEN growth < -15 THEN 'down' ELSE 'stable' END AS trend,
  CASE WHEN p > 0 AND NOT unsure THEN {r('growth', 2)} END AS growth_rate_percent FROM g)
"""


@query("A8_scenario_trends", TRENDS + "SELECT * FROM tr", A)
def _(fx):
    return stats.scenario_trends(fx.assignments)


@query(
    "A3_top_scenarios",
    TRENDS + COUNTS + """, rk AS (SELECT scenario_id, count, row_number() OVER (ORDER BY count DESC, scenario_id) AS rank FROM known WHERE scenario_id <> 'other'),
 x AS (SELECT CASE WHEN rank > 9 THEN 'other' ELSE scenario_id END AS scenario_id, count, least(rank, 10) AS rank FROM rk UNION ALL SELECT scenario_id, count, 10 FROM known WHERE scenario_id = 'other'),
 y AS (SELECT scenario_id, sum(count)::BIGINT AS count, min(rank) AS rank FROM x GROUP BY 1)
SELECT y.scenario_id, y.count, y.rank, CASE WHEN y.scenario_id = 'other' THEN NULL ELSE c.task_type END AS task_type, CASE WHEN y.scenario_id = 'other' THEN 'Other' ELSE c.name END AS name,
 CASE WHEN y.scenario_id = 'other' THEN NULL ELSE trend END AS trend, CASE WHEN y.scenario_id = 'other' THEN NULL ELSE growth_rate_percent END AS growth_rate_percent
FROM y LEFT JOIN fx_clusters c USING (scenario_id) LEFT JOIN tr USING (scenario_id)""",
    AC,
)
def _(fx):
    top = stats.top_scenarios(fx.assignments, fx.clusters, stats.scenario_trends(fx.assignments))
    return top.select("scenario_id", "count", "rank", "task_type", "name", "trend", "growth_rate_percent")


@query(
    "A4_dynamics",
    "SELECT strftime(timestamp, '%Y-%m-%d') AS date, count(*) AS count FROM fx_assignments GROUP BY 1",
    A,
)
def _(fx):
    return stats.dynamics(fx.assignments)


@query(
    "A5_outliers",
    f"SELECT count(CASE WHEN is_outlier THEN 1 END) AS total_outliers_count, {pct('count(CASE WHEN is_outlier THEN 1 END)', 'count(*)', 4)} AS outlier_percentage FROM fx_assignments",
    A,
)
def _(fx):
    return stats.outliers(fx.assignments)


SIGNALS = """, s0 AS (SELECT *, CASE WHEN k % 4 = 0 THEN ['retry', 'slow'] ELSE [] END AS listed,
  list_filter([CASE WHEN lower(response_status) IN ('error', 'failed', 'failure', 'timeout') THEN 'response_status:' || lower(response_status) END,
   nullif(trim(error_code), ''), CASE WHEN user_feedback < 0 THEN 'user_feedback:negative' END, CASE WHEN retry_count > 0 THEN 'retry' END], lambda x: x IS NOT NULL) AS own FROM fx_signals),
 s1 AS (SELECT *, list_concat(own, list_filter(listed, lambda x: NOT list_contains(own, x))) AS sg FROM s0),
 s2 AS (SELECT *, CASE WHEN has_failure_signals AND len(sg) = 0 THEN ['failure'] ELSE sg END AS signals FROM s1)
"""
S = ("fx_signals",)


@query(
    "A6_failure_summary",
    SIGNALS + f"""SELECT 'available' AS status, count(CASE WHEN len(signals) > 0 THEN 1 END) AS total_requests_with_failure_signals,
 {pct('count(CASE WHEN len(signals) > 0 THEN 1 END)', 'count(*)', 2)} AS failure_signal_percentage FROM s2""",
    S,
)
def _(fx):
    return stats.failure_summary(fx.signals)


@query(
    "A6_failure_top_signals",
    SIGNALS + "SELECT signal, count(*) AS count FROM (SELECT unnest(signals) AS signal FROM s2) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
    S,
)
def _(fx):
    return stats.failure_top_signals(fx.signals)


@query(
    "A6_failures_of_stored_rows",
    f"SELECT 'available' AS status, count(CASE WHEN has_failure_signals THEN 1 END) AS total_requests_with_failure_signals, {pct('count(CASE WHEN has_failure_signals THEN 1 END)', 'count(*)', 2)} AS failure_signal_percentage FROM fx_assignments",
    A,
)
def _(fx):
    return stats.failure_summary(fx.assignments)


@query(
    "A19_success_rate",
    SIGNALS + f"SELECT greatest(0.0::DOUBLE, 100.0::DOUBLE - {pct('count(CASE WHEN len(signals) > 0 THEN 1 END)', 'count(*)', 2)}) AS success_rate FROM s2",
    S,
)
def _(fx):
    return stats.dashboard_success_rate(stats.failure_summary(fx.signals))


@query(
    "A7_half_period",
    "SELECT epoch_us(min(timestamp)) AS lo, epoch_us(min(timestamp)) + (epoch_us(max(timestamp)) - epoch_us(min(timestamp))) // 2 AS mid, epoch_us(max(timestamp)) AS hi FROM fx_assignments",
    A,
)
def _(fx):
    h = stats.half_period(fx.assignments)
    return h.select(F.unix_micros("start").alias("lo"), F.unix_micros("mid").alias("mid"), F.unix_micros("end").alias("hi"))


EXAMPLES = """, ex AS (SELECT scenario_id, string_agg(query_text, '|' ORDER BY rn) AS examples FROM (SELECT scenario_id, query_text, row_number() OVER (PARTITION BY scenario_id ORDER BY timestamp, request_id) AS rn
 FROM fx_assignments WHERE NOT is_outlier AND coalesce(scenario_id, '') <> '') WHERE rn <= 5 GROUP BY scenario_id)
"""


@query("A10_scenario_examples", EXAMPLES + "SELECT * FROM ex", A)
def _(fx):
    return stats.scenario_examples(fx.assignments).withColumn("examples", F.array_join("examples", "|"))


LIST_SQL = """SELECT c.scenario_id, c.task_type, c.name, coalesce(count, 0) AS count, CASE WHEN coalesce(count, 0) > 0 THEN count ELSE c.records_count END AS records_count,
 trend, growth_rate_percent, examples, c.statistical_reliability FROM fx_clusters c LEFT JOIN counts USING (scenario_id) LEFT JOIN tr USING (scenario_id) LEFT JOIN ex USING (scenario_id)"""
_LIST = [
    "scenario_id", "task_type", "name", "count", "records_count", "trend", "growth_rate_percent", "examples",
    "statistical_reliability",
]


def _flat(df):
    return df.withColumn("examples", F.array_join("examples", "|")).select(*_LIST)


@query("A9_scenarios_list", TRENDS + COUNTS + EXAMPLES + LIST_SQL, AC)
def _(fx):
    return _flat(stats.scenarios_list(fx.assignments, fx.clusters))


@query(
    "J3_zero_count_scenarios",
    COUNTS + "SELECT c.scenario_id, coalesce(count, 0) AS count FROM fx_clusters c LEFT JOIN counts USING (scenario_id) WHERE coalesce(count, 0) = 0",
    AC,
)
def _(fx):
    return stats.scenarios_list(fx.assignments, fx.clusters).where("count = 0").select("scenario_id", "count")


@query("F5_hide_empty_scenarios", TRENDS + COUNTS + EXAMPLES + LIST_SQL + " WHERE coalesce(count, 0) > 0", AC)
def _(fx):
    return _flat(stats.scenarios_list(fx.assignments, fx.clusters, hide_empty=True))


@query(
    "F6_named_scenarios",
    COUNTS + """SELECT c.scenario_id, c.name, coalesce(count, 0) AS count FROM fx_clusters c LEFT JOIN counts USING (scenario_id)
 WHERE trim(coalesce(c.name, '')) <> '' ORDER BY 3 DESC, 1 LIMIT 10""",
    AC,
)
def _(fx):
    listed = stats.scenarios_list(fx.assignments, fx.clusters)
    return joins.named_scenarios(listed).select("scenario_id", "name", "count")


@query(
    "A20_scenario_detail",
    TRENDS + COUNTS + EXAMPLES + f"SELECT * REPLACE (coalesce(trend, 'insufficient_data') AS trend) FROM ({LIST_SQL}) WHERE scenario_id = 'code_help:cluster_1'",
    AC,
)
def _(fx):
    return _flat(stats.scenario_detail(fx.assignments, fx.clusters, "code_help:cluster_1"))


@query(
    "A20_unused_scenario_detail",
    "SELECT scenario_id, 0::BIGINT AS count, 'insufficient_data' AS trend FROM fx_clusters WHERE scenario_id = 'other:cluster_9'",
    AC,
)
def _(fx):
    return stats.scenario_detail(fx.assignments, fx.clusters, "other:cluster_9").select("scenario_id", "count", "trend")


@query(
    "A11_with_share",
    TASKS + topn_sql("tc", "task_type", 7) + f"SELECT task_type, {label_sql('task_type')} AS label, count, {pct('count', '(SELECT sum(count) FROM topn)')} AS percentage FROM topn",
    A,
)
def _(fx):
    return stats.with_share(stats.task_distribution(fx.assignments)).drop("rank")


@query(
    "W5_share",
    f"SELECT department, count(*) AS count, {pct('count(*)', '(SELECT count(*) FROM fx_records)')} AS percentage FROM fx_records GROUP BY department",
    ("fx_records",),
)
def _(fx):
    return joins.share(fx.records.groupBy("department").agg(F.count(F.lit(1)).alias("count")), "count")


@query(
    "A13_legacy_totals",
    f"SELECT count(*) AS total_logs, count(CASE WHEN is_outlier THEN 1 END) AS outliers, {r('count(CASE WHEN has_failure_signals THEN 1 END)::DOUBLE / count(*)::DOUBLE', 6)} AS failure_rate FROM fx_assignments",
    A,
)
def _(fx):
    return stats.legacy_totals(fx.assignments)


@query("A13_legacy_by_task", TASKS + "SELECT * FROM tc", A)
def _(fx):
    return stats.legacy_by_task(fx.assignments)


@query(
    "A13_legacy_by_scenario",
    ", s AS (SELECT coalesce(nullif(scenario_id, ''), 'unknown') AS scenario_id, count(*) AS count FROM fx_assignments GROUP BY 1) SELECT s.scenario_id, s.count, c.name FROM s LEFT JOIN fx_clusters c USING (scenario_id)",
    AC,
)
def _(fx):
    return stats.legacy_by_scenario(fx.assignments, fx.clusters)


@query(
    "U1_union_ids",
    "SELECT scenario_id FROM fx_assignments UNION SELECT scenario_id FROM fx_clusters",
    AC,
)
def _(fx):
    from agentlog.operators.keyed import union_ids

    return union_ids(fx.assignments, fx.clusters)


# --- progress ---------------------------------------------------------------------

CC = ", cc AS (SELECT source_id, count(*) AS classified FROM fx_assignments WHERE task_type IS NOT NULL GROUP BY 1)"
SRC = ("fx_sources", "fx_assignments")
PROG = CC + f""", p0 AS (SELECT s.source_id, name, status, records_valid AS total, CASE WHEN status = 'recomputed' THEN records_valid ELSE coalesce(classified, 0) END AS seen FROM fx_sources s LEFT JOIN cc USING (source_id)),
 prog AS (SELECT source_id, name, status, total, CASE WHEN total > 0 THEN least(seen, total) ELSE seen END AS classified, {pct('least(seen, total)', 'total')} AS percent, total > 0 AND seen >= total AS done FROM p0)
"""


def _progress(fx):
    return stats.source_progress(fx.sources, stats.classified_counts(fx.assignments))


@query("A14_classified_counts", CC + "SELECT * FROM cc", A)
def _(fx):
    return stats.classified_counts(fx.assignments)


@query("A15_source_progress", PROG + "SELECT * FROM prog", SRC)
def _(fx):
    return _progress(fx)


@query("F7_pending_sources", PROG + "SELECT source_id, percent FROM prog WHERE NOT done", SRC)
def _(fx):
    return joins.pending_sources(_progress(fx)).select("source_id", "percent")


FRESH = """, lr AS (SELECT completed_at, logs_at_completion FROM fx_runs WHERE status = 'completed' AND completed_at IS NOT NULL ORDER BY completed_at DESC, logs_at_completion DESC LIMIT 1),
 fr AS (SELECT (SELECT completed_at FROM lr) AS last_at, greatest(0, (SELECT count(*) FROM fx_assignments) - (SELECT logs_at_completion FROM lr)) AS since)
"""


@query(
    "A17_freshness",
    FRESH + f"SELECT {_ts_sql('last_at', 'last_recompute_at')}, since AS logs_since_last_recompute, since > 0 AS recompute_pending, false AS recompute_running FROM fr",
    ("fx_assignments", "fx_runs"),
)
def _(fx):
    f = stats.freshness(fx.assignments, fx.runs)
    return f.withColumn("last_recompute_at", _ts("last_recompute_at"))


@query(
    "O6_latest_run",
    FRESH + f"SELECT {_ts_sql('completed_at', 'last_recompute_at')} FROM lr",
    ("fx_assignments", "fx_runs"),
)
def _(fx):
    return stats.freshness(fx.assignments, fx.runs).select(_ts("last_recompute_at"))


@query(
    "A16_processing_status",
    PROG + FRESH + f"""SELECT bool_or(NOT done AND status <> 'recomputed') AS indexing, sum(total)::BIGINT AS total_valid, sum(classified)::BIGINT AS total_classified,
 {pct('sum(classified)', 'sum(total)')} AS percent, (SELECT since FROM fr) AS logs_since_last_recompute, (SELECT since > 0 FROM fr) AS recompute_pending, false AS recompute_running FROM prog""",
    ("fx_sources", "fx_assignments", "fx_runs"),
)
def _(fx):
    return stats.processing_status(_progress(fx), stats.freshness(fx.assignments, fx.runs))


@query(
    "O5_list_sources",
    CC + f""", k AS (SELECT s.*, CASE WHEN classified > 0 THEN classified WHEN status IN ('classified', 'recomputed') THEN records_valid ELSE 0 END AS known FROM fx_sources s LEFT JOIN cc USING (source_id))
SELECT source_id, name, origin, status, records_valid, known AS records_classified, CASE WHEN records_valid > 0 THEN {r('least(100.0::DOUBLE, known::DOUBLE / records_valid::DOUBLE * 100.0::DOUBLE)', 1)} ELSE 0.0 END AS classification_percentage FROM k""",
    SRC,
)
def _(fx):
    listed = stats.list_sources(fx.sources, stats.classified_counts(fx.assignments))
    return listed.select(
        "source_id", "name", "origin", "status", "records_valid", "records_classified", "classification_percentage"
    )


@query("A12_dashboard")
def _(fx):
    from agentlog.plans.bundles import dashboard, flatten

    return flatten(dashboard(fx.assignments, fx.clusters, Filters(source_id="src_1")))
