"""Users, models, ranking patterns and paging."""

from __future__ import annotations

from pyspark.sql import functions as F

from agentlog.config import Filters
from agentlog.operators import keyed, pages, users
from agentlog.plans.q_roi import label_sql, pct, r, saved_sql
from agentlog.plans.q_stats import WEEK, WEEK_SQL, _ts, _ts_sql
from agentlog.plans.registry import query

J = ("joined",)
CAT = "coalesce(nullif(task_type, ''), nullif(gold_category, ''), 'unknown')"
LABELS = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in users.PERSONA_LABELS.items())
ADVICE = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in users.PERSONA_ADVICE.items())

PROFILES = f""", u0 AS (SELECT *, coalesce(nullif(user_id, ''), nullif(user_name, ''), 'Anonymous') AS uid, {CAT} AS category, {saved_sql(CAT)} AS saved FROM joined),
 prof AS (SELECT uid AS user_id, coalesce(nullif(arg_min(user_name, (timestamp, request_id)), ''), uid) AS user_name, coalesce(first(department ORDER BY timestamp, request_id), 'Общий') AS department,
  count(*) AS total_queries, count(DISTINCT timestamp::DATE) AS active_days, max(timestamp::DATE) AS last_day, count(DISTINCT category) AS categories,
  count(CASE WHEN category = 'code_help' THEN 1 END) AS code_queries, count(CASE WHEN category IN ('data_analysis', 'information_search') THEN 1 END) AS data_queries,
  count(CASE WHEN coalesce(has_failure_signals, false) OR coalesce(status IN ('error', 'error_tool', 'hallucination_loop'), false) THEN 1 END) AS failures,
  count(CASE WHEN coalesce(is_outlier, false) THEN 1 END) AS outliers, sum(saved)::DOUBLE AS saved_minutes FROM u0 GROUP BY uid),
 med AS (SELECT quantile_cont(total_queries, 0.5)::DOUBLE AS median_queries FROM prof),
 pers AS (SELECT prof.*, CASE WHEN code_queries::DOUBLE / total_queries >= 0.35::DOUBLE THEN 'code_craftsman' WHEN data_queries::DOUBLE / total_queries >= 0.35::DOUBLE THEN 'analyst'
  WHEN categories >= 5 AND total_queries >= median_queries THEN 'super_user' WHEN total_queries < greatest(5.0::DOUBLE, median_queries * 0.5::DOUBLE) THEN 'casual' ELSE 'generalist' END AS persona FROM prof, med),
 fru AS (SELECT *, {r('failures::DOUBLE / total_queries::DOUBLE * 100.0::DOUBLE * 0.6::DOUBLE + outliers::DOUBLE / total_queries::DOUBLE * 100.0::DOUBLE * 0.4::DOUBLE', 1)} AS frustration_index FROM pers),
 uc AS (SELECT uid, category, count(*) AS n FROM u0 GROUP BY ALL),
 ucat AS (SELECT uid AS user_id, category AS top_task_type FROM (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY n DESC, category) AS rn FROM uc) WHERE rn = 1),
 us AS (SELECT fru.*, {label_sql('top_task_type')} AS top_category, top_task_type, {r('saved_minutes / 60.0::DOUBLE', 1)} AS saved_hours,
  CASE persona {LABELS} END AS persona_label, frustration_index > 15 OR (persona = 'casual' AND total_queries < 5) AS needs_guidance FROM fru JOIN ucat USING (user_id))
"""


def _users(fx):
    return users.users_table(fx.joined)


@query(
    "P1_user_profiles",
    PROFILES + "SELECT user_id, user_name, department, total_queries, active_days, strftime(last_day, '%Y-%m-%d') AS last_day, categories, code_queries, data_queries, failures, outliers, saved_minutes FROM prof",
    J,
)
def _(fx):
    p = users.user_profiles(fx.joined)
    return p.withColumn("last_day", F.date_format("last_day", "yyyy-MM-dd")).withColumn(
        "saved_minutes", F.col("saved_minutes").cast("double")
    ).drop("top_task_type")


@query("P2_cohort_median", PROFILES + "SELECT median_queries FROM med", J)
def _(fx):
    return users.cohort_median(users.user_profiles(fx.joined))


@query("P3_personas", PROFILES + f"SELECT user_id, persona, CASE persona {LABELS} END AS persona_label FROM pers", J)
def _(fx):
    return users.with_persona(users.user_profiles(fx.joined)).select("user_id", "persona", "persona_label")


@query("P4_frustration", PROFILES + "SELECT user_id, frustration_index FROM fru", J)
def _(fx):
    return users.with_frustration(users.user_profiles(fx.joined)).select("user_id", "frustration_index")


@query(
    "P5_guidance",
    PROFILES + f"""SELECT user_id, needs_guidance, CASE WHEN frustration_index > 20 THEN 'Высокий процент повторов в «' || top_category || '». Рекомендуется предоставить готовый шаблон промпта.'
 ELSE CASE persona {ADVICE} END END AS recommendation FROM us""",
    J,
)
def _(fx):
    return _users(fx).select("user_id", "needs_guidance", "recommendation")


@query("P6_user_top_category", PROFILES + f"SELECT user_id, top_task_type, {label_sql('top_task_type')} AS top_category FROM ucat", J)
def _(fx):
    return users.user_top_category(fx.joined)


@query(
    "P7_active_users",
    PROFILES + "SELECT count(CASE WHEN last_day >= (SELECT max(last_day) FROM prof) - 7 THEN 1 END) AS active_users FROM prof",
    J,
)
def _(fx):
    return users.active_users(users.user_profiles(fx.joined))


@query(
    "P8_department_users",
    PROFILES + f"""SELECT department, count(*) AS users_count, sum(total_queries)::BIGINT AS total_queries, {r('sum(saved_hours::DECIMAL(18,1))', 1)} AS avg_saved_hours,
 {r('sum(frustration_index::DECIMAL(18,1))::DOUBLE / count(*)', 1)} AS frustration_index FROM us GROUP BY department""",
    J,
)
def _(fx):
    return users.department_users(_users(fx))


@query(
    "P9_persona_distribution",
    PROFILES + f"SELECT persona, CASE persona {LABELS} END AS label, count(*) AS count, {pct('count(*)', '(SELECT count(*) FROM us)')} AS percentage FROM us GROUP BY persona",
    J,
)
def _(fx):
    return users.persona_distribution(_users(fx))


@query(
    "P10_users_summary",
    PROFILES + f"""SELECT count(*) AS total_users, count(CASE WHEN last_day >= (SELECT max(last_day) FROM us) - 7 THEN 1 END) AS active_users, 7::BIGINT AS active_window_days,
 {r('sum(frustration_index::DECIMAL(18,1))::DOUBLE / count(*)', 1)} AS avg_frustration_index FROM us""",
    J,
)
def _(fx):
    return users.users_summary(_users(fx))


@query(
    "P11_saved_minutes",
    f"SELECT request_id, ({saved_sql(CAT)})::DOUBLE AS saved_minutes FROM joined",
    J,
)
def _(fx):
    saved = users.saved_minutes(
        F.col("status"), F.col("manual_time_minutes"), users._category(), F.col("tokens")
    )
    return fx.joined.select("request_id", saved.cast("double").alias("saved_minutes"))


MODELS = f""", mr AS (SELECT *, trim(substring(list_filter(tools, lambda x: starts_with(x, 'model:') AND trim(substring(x, 7)) <> '')[1], 7)) AS model_id, {CAT} AS category FROM joined),
 mo AS (SELECT * FROM mr WHERE model_id IS NOT NULL),
 mc AS (SELECT model_id, category, row_number() OVER (PARTITION BY model_id ORDER BY count(*) DESC, category) AS rn FROM mo GROUP BY model_id, category)
"""


@query("P12_model_id", MODELS + "SELECT request_id, model_id FROM mr", J)
def _(fx):
    return fx.joined.select("request_id", users.model_id(F.col("tools_used")).alias("model_id"))


@query(
    "P13_model_analytics",
    MODELS + f"""SELECT model_id, count(*) AS total_queries, {pct('count(*)', '(SELECT count(*) FROM mo)')} AS share_percentage, sum(coalesce(tokens, 0))::BIGINT AS total_tokens,
 {pct("count(CASE WHEN coalesce(has_failure_signals, false) OR coalesce(status IN ('error', 'error_tool'), false) THEN 1 END)", 'count(*)')} AS failure_rate_percent,
 {label_sql('any_value(top)')} AS top_task_type FROM mo JOIN (SELECT model_id, category AS top FROM mc WHERE rn = 1) USING (model_id) GROUP BY model_id""",
    J,
)
def _(fx):
    return users.model_analytics(fx.joined)


@query(
    "P14_model_summary",
    MODELS + "SELECT 'available' AS status, count(DISTINCT model_id) AS total_models_detected, count(*) AS total_queries_with_model, sum(tokens)::BIGINT AS total_tokens FROM mo",
    J,
)
def _(fx):
    return users.model_summary(fx.joined)


@query(
    "P15_users_totals",
    PROFILES + f"SELECT sum(total_queries)::BIGINT AS total_queries, {r('sum(saved_hours::DECIMAL(18,1))', 1)} AS saved_hours FROM us",
    J,
)
def _(fx):
    return users.users_totals(_users(fx))


# --- ranking patterns -------------------------------------------------------------

R = ("fx_records",)


@query(
    "W1_first_per_user",
    "SELECT user_id, request_id FROM fx_records QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY timestamp, request_id) = 1",
    R,
)
def _(fx):
    rows = fx.records.select("user_id", "timestamp", "request_id")
    return keyed.first_per(rows, ["user_id"], ["timestamp", "request_id"]).select("user_id", "request_id")


@query(
    "W2_last_per_user",
    "SELECT user_id, request_id FROM fx_records QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY timestamp DESC, request_id DESC) = 1",
    R,
)
def _(fx):
    rows = fx.records.select("user_id", "timestamp", "request_id")
    return keyed.last_per(rows, ["user_id"], ["timestamp", "request_id"]).select("user_id", "request_id")


@query(
    "W3_argmax_count",
    """, c AS (SELECT department, style, count(*) AS n FROM fx_records GROUP BY ALL)
SELECT department, style FROM c QUALIFY row_number() OVER (PARTITION BY department ORDER BY n DESC, style NULLS FIRST) = 1""",
    R,
)
def _(fx):
    return keyed.argmax_count(fx.records, ["department"], "style")


# --- pages ------------------------------------------------------------------------

ITEMS = f"""request_id, query_text, task_type, CASE WHEN coalesce(task_type, '') <> '' THEN {label_sql('task_type')} END AS label, classification_confidence, scenario_id, scenario_name,
 coalesce(is_outlier, false) AS is_outlier, (task_type IS NULL AND coalesce(status IN ('error', 'error_tool', 'hallucination_loop'), false)) OR coalesce(has_failure_signals, false) AS has_failure_signals, {_ts_sql()}"""


@query("O2_log_items", f"SELECT {ITEMS} FROM joined", J)
def _(fx):
    return pages.log_items(fx.joined).withColumn("timestamp", _ts())


@query(
    "O1_logs_page",
    f", p AS (SELECT * FROM joined WHERE {WEEK_SQL} ORDER BY timestamp, request_id LIMIT 50 OFFSET 20) SELECT {ITEMS} FROM p",
    J,
)
def _(fx):
    return pages.logs_page(fx.joined, WEEK, 50, 20).withColumn("timestamp", _ts())


@query(
    "O3_assignments_page",
    """, p AS (SELECT * EXCLUDE (scenario_name) FROM fx_assignments ORDER BY timestamp DESC, request_id LIMIT 100 OFFSET 30)
SELECT request_id, p.scenario_id, c.name AS scenario_name, is_outlier FROM p LEFT JOIN fx_clusters c USING (scenario_id)""",
    ("fx_assignments", "fx_clusters"),
)
def _(fx):
    page = pages.assignments_page(fx.assignments, fx.clusters, Filters(), 100, 30)
    return page.select("request_id", "scenario_id", "scenario_name", "is_outlier")


@query("O4_list_clusters", "SELECT scenario_id, records_count FROM fx_clusters", ("fx_clusters",))
def _(fx):
    return pages.list_clusters(fx.clusters).select("scenario_id", "records_count")
