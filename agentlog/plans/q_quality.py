"""Evaluation and contract checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from agentlog.functions.taxonomy import CORE_TYPES
from agentlog.operators import quality
from agentlog.plans.fixtures import EVAL_CTE
from agentlog.plans.q_normalize import num_sql
from agentlog.plans.q_roi import pct, r
from agentlog.plans.registry import query

J = ("joined",)
EV = f", {EVAL_CTE}"
_CLASSES = ", ".join(f"('{t}')" for t in CORE_TYPES)
PER_CLASS = EV + f""", cls AS (SELECT * FROM (VALUES {_CLASSES}) v(task_type)),
 cm AS (SELECT gold, predicted, count(*) AS count FROM ev WHERE gold IS NOT NULL GROUP BY ALL),
 pc AS (SELECT task_type, coalesce((SELECT sum(count) FROM cm WHERE gold = task_type), 0)::BIGINT AS support, coalesce((SELECT sum(count) FROM cm WHERE predicted = task_type), 0)::BIGINT AS predicted,
  coalesce((SELECT sum(count) FROM cm WHERE gold = task_type AND predicted = task_type), 0)::BIGINT AS tp FROM cls),
 pm AS (SELECT task_type, support, coalesce(tp::DOUBLE / nullif(predicted::DOUBLE, 0), 0) AS precision, coalesce(tp::DOUBLE / nullif(support::DOUBLE, 0), 0) AS recall,
  coalesce((tp * 2)::DOUBLE / nullif((support + predicted)::DOUBLE, 0), 0) AS f1 FROM pc)
"""


@query(
    "Q1_gold_label",
    """, m AS (SELECT row_idx, coalesce(coalesce(nullif(metadata::JSON->>'$.gold_category', ''), metadata::JSON->>'$.category'), coalesce(nullif(gold_category, ''), category)) AS g FROM fx_raw)
SELECT row_idx, nullif(trim(g), '') AS gold FROM m""",
    ("fx_raw",),
)
def _(fx):
    return quality.gold_label(fx.raw).select("row_idx", "gold")


@query(
    "Q2_classification_metrics",
    PER_CLASS + f"""SELECT count(*) AS n, count(gold) AS n_with_gold, {r("count(CASE WHEN gold = predicted THEN 1 END)::DOUBLE / count(gold)::DOUBLE", 6)} AS accuracy,
 {r("(SELECT sum(f1::DECIMAL(20,12))::DOUBLE / count(*) FROM pm WHERE support > 0)", 6)} AS macro_f1, {r("count(CASE WHEN predicted = 'unknown' THEN 1 END)::DOUBLE / count(*)::DOUBLE", 6)} AS unknown_rate FROM ev""",
    J,
)
def _(fx):
    return quality.classification_metrics(fx.evaluation)


@query("Q3_per_class_metrics", PER_CLASS + "SELECT * FROM pm", J)
def _(fx):
    return quality.per_class_metrics(fx.evaluation)


@query("Q3_confusion", PER_CLASS + "SELECT * FROM cm", J)
def _(fx):
    return quality.confusion(fx.evaluation)


@query(
    "Q4_threshold_sweep",
    EV + f""", th AS (SELECT unnest([0.3, 0.5, 0.6])::DOUBLE AS threshold), x AS (SELECT threshold, gold, CASE WHEN confidence >= threshold THEN predicted ELSE 'unknown' END AS p FROM ev, th)
SELECT threshold, count(CASE WHEN p = 'unknown' THEN 1 END) AS unknown_count, {pct("count(CASE WHEN p = 'unknown' THEN 1 END)", 'count(*)')} AS unknown_percent, {r("count(CASE WHEN gold = p THEN 1 END)::DOUBLE / count(gold)::DOUBLE", 6)} AS accuracy,
 {r("count(CASE WHEN gold = p THEN 1 END)::DOUBLE / nullif(count(CASE WHEN gold IS NOT NULL AND p <> 'unknown' THEN 1 END), 0)::DOUBLE", 6)} AS accuracy_known FROM x GROUP BY threshold""",
    J,
)
def _(fx):
    return quality.threshold_sweep(fx.evaluation)


@query(
    "Q5_confidence_report",
    EV + f"""SELECT min(confidence) AS min_confidence, {r("sum(confidence::DECIMAL(18,8))::DOUBLE / count(confidence)", 6)} AS mean_confidence, max(confidence) AS max_confidence,
 count(CASE WHEN predicted = 'unknown' THEN 1 END) AS unknown_count FROM ev""",
    J,
)
def _(fx):
    return quality.confidence_report(fx.evaluation)


@query("Q5_prediction_distribution", EV + "SELECT predicted, count(*) AS count FROM ev GROUP BY 1", J)
def _(fx):
    return quality.prediction_distribution(fx.evaluation)


@query(
    "Q5_top_confusions",
    PER_CLASS + "SELECT gold, predicted, count, row_number() OVER (PARTITION BY gold ORDER BY count DESC, predicted) AS rank FROM cm QUALIFY rank <= 4",
    J,
)
def _(fx):
    return quality.top_confusions(fx.evaluation)


def _neg(c: str) -> str:
    return f"({c} IS NOT NULL AND coalesce(({num_sql(c)}) < 0, true))"


_CORE = ", ".join(f"'{t}'" for t in CORE_TYPES)


def _violations(key: str, view: str, checks: dict[str, str]) -> str:
    items = ", ".join(f"CASE WHEN {cond} THEN '{name}' END" for name, cond in checks.items())
    return f"SELECT {key}, violation FROM (SELECT {key}, unnest([{items}]) AS violation FROM {view}) WHERE violation IS NOT NULL"


@query(
    "Q6_upload_violations",
    _violations(
        "row_idx",
        "fx_raw",
        {
            "query_missing": "user_query IS NULL AND query_text IS NULL",
            "user_query_empty": "user_query = ''",
            "query_text_empty": "query_text = ''",
            "request_id_empty": "request_id = ''",
            "status_unknown": "status NOT IN ('success', 'error_tool', 'hallucination_loop')",
            "category_unknown": f"category NOT IN ({_CORE})",
            "tokens_invalid": _neg("simulated_context_tokens"),
            "manual_minutes_invalid": _neg("estimated_manual_time_minutes"),
            "agent_steps_invalid": _neg("agent_steps"),
        },
    ),
    ("fx_raw",),
)
def _(fx):
    return quality.upload_violations(fx.raw)


@query(
    "Q7_log_violations",
    ", lg AS (SELECT CASE WHEN k % 7 = 0 THEN '' ELSE request_id END AS request_id, query_text, timestamp, user_feedback * 2 AS user_feedback, retry_count FROM fx_signals) "
    + _violations(
        "request_id",
        "lg",
        {
            "request_id_missing": "coalesce(request_id, '') = ''",
            "query_text_missing": "coalesce(query_text, '') = ''",
            "timestamp_missing": "timestamp IS NULL",
            "feedback_out_of_range": "user_feedback NOT BETWEEN -1 AND 1",
            "retry_negative": "retry_count < 0",
        },
    ),
    ("fx_signals",),
)
def _(fx):
    rid = F.when(F.col("k") % 7 == 0, F.lit("")).otherwise(F.col("request_id"))
    logs = fx.signals.withColumn("request_id", rid).withColumn("user_feedback", F.col("user_feedback") * 2)
    return quality.log_violations(logs)


@query("Q8_statistics_violations")
def _(fx):
    from agentlog.plans.bundles import dashboard

    return quality.statistics_violations(dashboard(fx.assignments, fx.clusters))


@query(
    "Q8_broken_bundle",
    """, t AS (SELECT task_type, count(*) - 20 AS count FROM fx_assignments GROUP BY 1),
 s AS (SELECT scenario_id, count(*) - 4 AS count FROM fx_assignments GROUP BY 1)
SELECT 'section' AS section, 'missing:dynamics' AS violation
UNION ALL SELECT 'tasks_distribution', 'missing:task_type'
UNION ALL SELECT 'totals', 'negative:records_total' WHERE (SELECT count(*) FROM fx_assignments) > 0
UNION ALL SELECT 'tasks_distribution', 'negative:count' FROM t WHERE count < 0
UNION ALL SELECT 'top_scenarios', 'negative:count' FROM s WHERE count < 0
UNION ALL SELECT 'top_scenarios', 'trend_unknown' FROM s WHERE count % 2 <> 0
UNION ALL SELECT 'top_scenarios', 'reliability_unknown' FROM s WHERE count % 3 <> 0""",
    ("fx_assignments",),
)
def _(fx):
    def counts(key, less):
        return fx.assignments.groupBy(key).agg((F.count(F.lit(1)) - less).alias("count"))

    bundle = {
        "totals": fx.assignments.agg((-F.count(F.lit(1))).alias("records_total")),
        "tasks_distribution": counts("task_type", 20).withColumnRenamed("task_type", "kind"),
        "top_scenarios": counts("scenario_id", 4)
        .withColumn("trend", F.when(F.col("count") % 2 == 0, "up").otherwise("sideways"))
        .withColumn("statistical_reliability", F.when(F.col("count") % 3 == 0, "low").otherwise("unsure")),
    }
    return quality.statistics_violations(bundle)
