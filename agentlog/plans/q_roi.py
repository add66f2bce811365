"""ROI queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from agentlog.config import MANUAL_MINUTES, MANUAL_MINUTES_TOOLS, RoiConfig
from agentlog.functions.taxonomy import TASK_LABELS
from agentlog.operators import roi
from agentlog.plans.registry import query

CFG = RoiConfig()
RATE, PRICE = repr(CFG.hourly_rate), repr(CFG.price_per_1k)


def r(x: str, n: int) -> str:
    """The rounding rule in SQL."""
    return f"(sign(({x})::DOUBLE) * floor(abs(({x})::DOUBLE) * 1e{n} + 0.5) / 1e{n})"


def pct(a: str, b: str, n: int = 1) -> str:
    return f"coalesce({r(f'({a})::DOUBLE / nullif(({b})::DOUBLE, 0) * 100', n)}, 0.0::DOUBLE)"


def label_sql(x: str) -> str:
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in TASK_LABELS.items())
    return f"CASE coalesce(nullif({x}, ''), 'unknown') {cases} ELSE '{TASK_LABELS['other']}' END"


def minutes_sql(key: str, table: dict[str, float] = MANUAL_MINUTES, default: float = 15.0) -> str:
    cases = " ".join(f"WHEN '{k}' THEN {v}" for k, v in table.items())
    return f"CAST(CASE {key} {cases} ELSE {default} END AS DECIMAL(18,4))"


SUCCESS = "coalesce(lower(trim(status)) IN ('success', 'ok', 'completed'), false)"
COEFF = "(CASE WHEN coalesce(tokens, 0) <= 4000 THEN 0.3 WHEN coalesce(tokens, 0) >= 30000 THEN 2.0 ELSE 1.0 END)::DECIMAL(9,4)"


def saved_sql(category: str) -> str:
    manual = f"CASE WHEN coalesce(manual_time_minutes > 0, false) THEN manual_time_minutes::DECIMAL(18,4) ELSE {minutes_sql(category)} END"
    return f"CASE WHEN {SUCCESS} THEN ({manual}) * {COEFF} ELSE 0 END"


ROWS = f""", rows AS (SELECT request_id, timestamp, coalesce(nullif(task_type, ''), 'unknown') AS task_type, nullif(scenario_id, '') AS scenario_id, scenario_name,
 coalesce(nullif(user_id, ''), 'unknown_user') AS user_id, coalesce(nullif(user_name, ''), 'Unknown') AS user_name, coalesce(nullif(department, ''), 'Unknown') AS department,
 coalesce(nullif(style, ''), 'formal') AS style, tools, CAST(length(query_text) AS BIGINT) AS query_chars, coalesce(tokens, 0) AS tokens, {SUCCESS} AS success,
 NOT coalesce(manual_time_minutes > 0, false) AS estimated, {saved_sql("coalesce(nullif(task_type, ''), 'unknown')")} AS saved_minutes,
 CASE WHEN {SUCCESS} THEN 0 ELSE coalesce(tokens, 0) END AS wasted_tokens FROM joined)
"""
TOTALS = ROWS + """, t AS (SELECT count(*) AS n, count(CASE WHEN success THEN 1 END) AS ok, sum(saved_minutes)::DOUBLE AS minutes, sum(tokens)::BIGINT AS tokens,
 sum(wasted_tokens)::BIGINT AS wasted, count(CASE WHEN success AND len(tools) > 0 THEN 1 END) AS automated, count(CASE WHEN estimated THEN 1 END) AS estimated, sum(query_chars)::BIGINT AS chars,
 count(DISTINCT user_id) AS users, count(DISTINCT scenario_id) AS scenarios, count(CASE WHEN style = 'voice' THEN 1 END) AS voice, count(CASE WHEN style = 'typo' THEN 1 END) AS typo FROM rows)
"""


def summary_sql(rate: str, price: str) -> str:
    gain, spend = f"(minutes / 60.0::DOUBLE * {rate})", f"(tokens::DOUBLE / 1000.0::DOUBLE * {price})"
    voice, typo = pct("voice", "n"), pct("typo", "n")
    return f"""n AS total_logs, {pct('ok', 'n')} AS success_rate_percent, {r('minutes / 60.0::DOUBLE', 2)} AS total_fte_hours_saved,
 {r(gain, 2)} AS total_manual_cost, {r(spend, 2)} AS total_agent_cost, {r(f'{gain} - {spend}', 2)} AS net_savings,
 CASE WHEN {spend} > 0 THEN {r(f'{gain} / {spend}', 2)} ELSE 0.0 END AS roi_multiplier, tokens AS total_tokens_consumed, wasted AS wasted_tokens_on_errors,
 {r(f'wasted::DOUBLE / 1000.0::DOUBLE * {price}', 2)} AS wasted_cost, CASE WHEN ok > 0 THEN {r(f'{spend} / ok::DOUBLE', 2)} ELSE 0.0 END AS cost_per_successful_action,
 users AS mau_count, {r(f'{voice} + {typo}', 1)} AS mobile_voice_adoption_rate, {voice} AS voice_rate, {typo} AS typo_rate,
 CASE WHEN tokens > 0 THEN {r('(minutes / 60.0::DOUBLE) / (tokens::DOUBLE / 1000.0::DOUBLE)', 4)} ELSE 0.0 END AS token_value_index,
 {pct('automated', 'n')} AS process_automation_rate, {pct('estimated', 'n')} AS manual_minutes_estimated_percent"""


V = ("joined",)


def rows(fx):
    return roi.roi_rows(fx.joined)


@query(
    "R1_session_coeff",
    f"SELECT tokens, {COEFF}::DOUBLE AS coeff, count(*) AS n FROM fx_records GROUP BY ALL",
    ("fx_records",),
)
def _(fx):
    c = roi.session_coeff(F.coalesce("tokens", F.lit(0))).cast("double")
    return fx.records.groupBy("tokens", c.alias("coeff")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "R2_manual_minutes",
    f"""SELECT request_id, (CASE WHEN coalesce(manual_time_minutes > 0, false) THEN manual_time_minutes::DECIMAL(18,4) ELSE {minutes_sql("coalesce(task_type, 'unknown')")} END)::DOUBLE AS minutes,
 NOT coalesce(manual_time_minutes > 0, false) AS estimated FROM joined""",
    V,
)
def _(fx):
    m = roi.manual_minutes(F.col("manual_time_minutes"), F.coalesce("task_type", F.lit("unknown")))
    return fx.joined.select("request_id", m.alias("m")).select(
        "request_id", F.col("m.minutes").cast("double").alias("minutes"), "m.estimated"
    )


@query(
    "R3_roi_rows",
    ROWS + "SELECT request_id, task_type, success, tokens, wasted_tokens::BIGINT AS wasted_tokens, saved_minutes::DOUBLE AS saved_minutes, estimated FROM rows",
    V,
)
def _(fx):
    return rows(fx).select(
        "request_id", "task_type", "success", "tokens", "wasted_tokens",
        F.col("saved_minutes").cast("double").alias("saved_minutes"), "estimated",
    )


@query("R4_roi_summary", TOTALS + f"SELECT {summary_sql(RATE, PRICE)} FROM t", V)
def _(fx):
    return roi.roi_summary(rows(fx))


@query(
    "R5_roi_by_category",
    ROWS + f""", c AS (SELECT task_type, count(*) AS n, count(CASE WHEN success THEN 1 END) AS ok, sum(saved_minutes)::DOUBLE AS m, sum(tokens)::BIGINT AS tk FROM rows GROUP BY task_type)
SELECT task_type, {label_sql('task_type')} AS label, n AS count, {pct('ok', 'n')} AS success_rate_percent, {r('m / 60.0::DOUBLE', 2)} AS fte_hours_saved,
 {r(f'm / 60.0::DOUBLE * {RATE} - tk::DOUBLE / 1000.0::DOUBLE * {PRICE}', 2)} AS net_savings FROM c""",
    V,
)
def _(fx):
    return roi.roi_by_category(rows(fx))


@query(
    "R6_roi_by_scenario",
    ROWS + f""", c AS (SELECT scenario_id, arg_min(scenario_name, (timestamp, request_id)) AS name, count(*) AS n, sum(saved_minutes)::DOUBLE AS m, sum(tokens)::BIGINT AS tk
 FROM rows WHERE scenario_id IS NOT NULL GROUP BY scenario_id)
SELECT scenario_id, name, n AS count, {r('m / 60.0::DOUBLE', 2)} AS fte_hours_saved,
 {r(f'm / 60.0::DOUBLE * {RATE} - tk::DOUBLE / 1000.0::DOUBLE * {PRICE}', 2)} AS net_savings FROM c""",
    V,
)
def _(fx):
    return roi.roi_by_scenario(rows(fx))


USER_STATS = ROWS + f""", u AS (SELECT user_id, arg_min(user_name, (timestamp, request_id)) AS name, arg_min(department, (timestamp, request_id)) AS department,
 count(*) AS requests_count, sum(tokens)::BIGINT AS tokens_consumed, sum(wasted_tokens)::BIGINT AS wasted_tokens,
 {r(f'sum(tokens)::DOUBLE / 1000.0::DOUBLE * {PRICE}', 4)} AS cost FROM rows GROUP BY user_id)
"""


@query("R7_user_stats", USER_STATS + "SELECT * FROM u", V)
def _(fx):
    return roi.roi_user_stats(rows(fx))


@query("R7_top_spenders", USER_STATS + "SELECT * FROM u ORDER BY tokens_consumed DESC, user_id LIMIT 3", V)
def _(fx):
    return roi.top_spenders(roi.roi_user_stats(rows(fx)))


@query(
    "R8_department_costs",
    ROWS + f"SELECT department, {r(f'sum(tokens)::DOUBLE / 1000.0::DOUBLE * {PRICE}', 2)} AS cost FROM rows GROUP BY department",
    V,
)
def _(fx):
    return roi.department_costs(rows(fx))


@query(
    "R9_style_breakdown",
    ROWS + f"SELECT style, count(*) AS count, {pct('count(*)', '(SELECT count(*) FROM rows)')} AS percentage FROM rows GROUP BY style",
    V,
)
def _(fx):
    return roi.style_breakdown(rows(fx))


_V, _T = pct("voice", "n"), pct("typo", "n")


@query(
    "R10_style_insight",
    TOTALS + f""", p AS (SELECT {_V} AS v, {_T} AS ty, {r(f'{_V} + {_T}', 1)} AS x FROM t),
 q AS (SELECT *, printf('голос %.1f%%, опечатки %.1f%%', v, ty) AS d FROM p)
SELECT CASE WHEN x <= 0 THEN 'Неформальных запросов не зафиксировано.' WHEN x >= 20 THEN printf('%.1f%% запросов приходят в неформальном стиле (%s) — выше порога 20.0%%, поддержка Voice-to-Text оправдана.', x, d)
 ELSE printf('Неформальный стиль — %.1f%% запросов (%s). Это ниже порога 20.0%%, отдельный Voice-to-Text интерфейс данными пока не обоснован.', x, d) END AS style_insight FROM q""",
    V,
)
def _(fx):
    return roi.style_insight(roi.roi_summary(rows(fx)))


@query(
    "R11_tool_frequency",
    ROWS + "SELECT tool, count(*) AS count FROM (SELECT unnest(tools) AS tool FROM rows WHERE success) GROUP BY tool",
    V,
)
def _(fx):
    return roi.tool_frequency(rows(fx))


@query("R12_automation_rate", TOTALS + f"SELECT {pct('automated', 'n')} AS process_automation_rate FROM t", V)
def _(fx):
    return roi.roi_summary(rows(fx)).select("process_automation_rate")


@query("R13_estimated_share", TOTALS + f"SELECT {pct('estimated', 'n')} AS manual_minutes_estimated_percent FROM t", V)
def _(fx):
    return roi.roi_summary(rows(fx)).select("manual_minutes_estimated_percent")


@query(
    "R14_roi_verdict",
    TOTALS + f""", p AS (SELECT minutes / 60.0::DOUBLE * {RATE} AS b, tokens::DOUBLE / 1000.0::DOUBLE * {PRICE} AS c FROM t)
SELECT {r('b', 2)} AS benefit, {r('c', 2)} AS cost, {r('b - c', 2)} AS net, CASE WHEN c > 0 THEN {r('b / c', 2)} ELSE 0.0 END AS ratio, b > c AS pays_off FROM p""",
    V,
)
def _(fx):
    return roi.roi_verdict(rows(fx)).drop("headline")


@query(
    "R15_analysis_cost",
    TOTALS + f""", p AS (SELECT n, floor(chars::DOUBLE / 3.0::DOUBLE)::BIGINT AS e, floor(scenarios::DOUBLE * 1100.0::DOUBLE)::BIGINT AS s FROM t)
SELECT e AS embedding_tokens, s AS summarization_tokens, {r(f'(e + s)::DOUBLE / 1000.0::DOUBLE * {PRICE}', 2)} AS cost,
 {r(f'((e + s)::DOUBLE / 1000.0::DOUBLE * {PRICE}) / n::DOUBLE', 4)} AS cost_per_request FROM p""",
    V,
)
def _(fx):
    return roi.analysis_cost(rows(fx))


@query(
    "R16_derive_rates",
    f"""WITH p AS (SELECT s_suppkey AS id, abs(s_acctbal) * 100 AS monthly_rate, CASE WHEN s_nationkey % 5 = 0 THEN 0.0::DOUBLE ELSE 168.0::DOUBLE END AS hours_per_month,
 139.0::DOUBLE AS token_price_per_mln, 1e8 AS infra_capex, (s_suppkey % 4)::DOUBLE AS amortization_years, 6e5 AS electricity_per_year, 2e10 AS tokens_per_year,
 CASE WHEN s_suppkey % 7 = 0 THEN 1200.0::DOUBLE END AS hourly_override, CASE WHEN s_suppkey % 6 = 0 THEN 0.5::DOUBLE END AS price_override FROM supplier)
SELECT id, CASE WHEN hours_per_month > 0 THEN {r('monthly_rate / hours_per_month', 2)} ELSE 0.0 END AS derived_hourly_rate, {r('token_price_per_mln / 1000.0::DOUBLE', 4)} AS derived_price_per_1k,
 CASE WHEN amortization_years > 0 THEN {r('(infra_capex / nullif(amortization_years, 0) + electricity_per_year) / tokens_per_year * 1000.0::DOUBLE', 4)} ELSE 0.0 END AS infra_price_per_1k,
 hourly_override IS NOT NULL AS hourly_overridden, price_override IS NOT NULL AS price_overridden,
 {r('coalesce(price_override, token_price_per_mln / 1000.0::DOUBLE)', 4)} AS price_per_1k FROM p""",
)
def _(fx):
    c = F.col
    s = fx.table("supplier").select(
        c("s_suppkey").alias("id"),
        (F.abs("s_acctbal") * 100).alias("monthly_rate"),
        F.when(c("s_nationkey") % 5 == 0, F.lit(0.0)).otherwise(F.lit(168.0)).alias("hours_per_month"),
        F.lit(139.0).alias("token_price_per_mln"),
        F.lit(1e8).alias("infra_capex"),
        (c("s_suppkey") % 4).cast("double").alias("amortization_years"),
        F.lit(6e5).alias("electricity_per_year"),
        F.lit(2e10).alias("tokens_per_year"),
        F.when(c("s_suppkey") % 7 == 0, F.lit(1200.0)).alias("hourly_override"),
        F.when(c("s_suppkey") % 6 == 0, F.lit(0.5)).alias("price_override"),
    )
    return roi.derive_rates(s).select(
        "id", "derived_hourly_rate", "derived_price_per_1k", "infra_price_per_1k", "hourly_overridden",
        "price_overridden", roi.round_to(c("price_per_1k"), 4).alias("price_per_1k"),
    )


_TOOL_BASE = minutes_sql("category", MANUAL_MINUTES_TOOLS, 10.0)
TOOL_ROWS = f""", b AS (SELECT *, coalesce(nullif(gold_category, ''), 'other') AS category, coalesce(tokens, 0) AS tk, coalesce(status, 'success') = 'success' AS ok FROM joined),
 tr AS (SELECT request_id, category AS task_type, tk AS tokens, ok AS success, (CASE WHEN NOT ok THEN 0::DECIMAL(24,6) WHEN manual_time_minutes IS NOT NULL THEN manual_time_minutes::DECIMAL(24,6)
 ELSE {r(f"({_TOOL_BASE} * (CASE WHEN tk > 50000 THEN 2.0 WHEN tk >= 10000 THEN 1.0 ELSE 0.3 END)::DECIMAL(9,4) * (1::DECIMAL(9,4) + 0.25::DECIMAL(9,4) * len(tools)))::DECIMAL(30,8)", 2)}::DECIMAL(24,6) END) AS saved_minutes FROM b)
"""


@query(
    "R18_roi_rows_tools",
    TOOL_ROWS + "SELECT request_id, task_type, tokens, success, saved_minutes::DOUBLE AS saved_minutes FROM tr",
    V,
)
def _(fx):
    return roi.roi_rows(fx.joined, variant="tools").select(
        "request_id", "task_type", "tokens", "success", F.col("saved_minutes").cast("double").alias("saved_minutes")
    )


@query(
    "R19_category_metrics_tools",
    TOOL_ROWS + f""", c AS (SELECT task_type, count(*) AS count, count(CASE WHEN success THEN 1 END) AS success_count, sum(saved_minutes)::DOUBLE AS m, sum(tokens)::BIGINT AS tokens_used FROM tr GROUP BY task_type)
SELECT task_type, count, success_count, {pct('success_count', 'count')} AS success_rate_percent, {r('m', 2)} AS saved_minutes, tokens_used, {r('m / 60.0::DOUBLE', 2)} AS fte_hours_saved FROM c""",
    V,
)
def _(fx):
    return roi.roi_category_metrics(roi.roi_rows(fx.joined, variant="tools"))


@query(
    "R20_person_months",
    TOTALS + f"SELECT {r('minutes / 60.0::DOUBLE', 2)} AS total_fte_hours_saved, {r(r('minutes / 60.0::DOUBLE', 2) + ' / 168.0::DOUBLE', 2)} AS person_months FROM t",
    V,
)
def _(fx):
    return roi.person_months(roi.roi_summary(rows(fx)).select("total_fte_hours_saved"))


@query(
    "J11_roi_what_if",
    TOTALS + f""", g AS (SELECT DISTINCT abs(c_acctbal) AS hourly_rate, (c_custkey % 7)::DOUBLE / 10 AS price_per_1k FROM customer)
SELECT hourly_rate, price_per_1k, {summary_sql('hourly_rate', 'price_per_1k')} FROM g, t""",
    V,
)
def _(fx):
    grid = fx.table("customer").select(
        F.abs("c_acctbal").alias("hourly_rate"), ((F.col("c_custkey") % 7).cast("double") / 10).alias("price_per_1k")
    ).distinct()
    return roi.roi_what_if(rows(fx), grid)


_SHEET = ", ".join(f"{m}::DOUBLE AS {m}" for m in roi.SUMMARY_SHEET)


@query(
    "S12_roi_summary_sheet",
    TOTALS + f""", s AS (SELECT {summary_sql(RATE, PRICE)} FROM t), w AS (SELECT {_SHEET} FROM s)
SELECT metric, value FROM w UNPIVOT (value FOR metric IN ({', '.join(roi.SUMMARY_SHEET)}))""",
    V,
)
def _(fx):
    return roi.summary_sheet(rows(fx)).select("metric", "value")
