"""ROI figures on small inputs with hand-computed results."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from agentlog.config import RoiConfig
from agentlog.operators import roi

CFG = RoiConfig(hourly_rate=1200.0, price_per_1k=0.015)
SCHEMA = (
    "request_id string, timestamp timestamp, status string, tokens long, manual_time_minutes double, "
    "tools_used array<string>, task_type string, scenario_id string, scenario_name string, query_text string, "
    "user_id string, user_name string, department string, style string, gold_category string"
)


def make(spark, *rows):
    base = dict(
        status="success", tokens=10_000, manual_time_minutes=30.0, tools_used=None, task_type=None,
        scenario_id=None, scenario_name=None, query_text="q", user_id=None, user_name=None, department=None,
        style=None, gold_category=None, timestamp=None,
    )
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    full = [{**base, "request_id": f"r{i}", **r} for i, r in enumerate(rows)]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in full], SCHEMA)


def summary(spark, *rows, cfg=CFG):
    return roi.roi_summary(roi.roi_rows(make(spark, *rows), cfg), cfg).first()


@pytest.mark.parametrize(
    "tokens, weight", [(0, 0.3), (4000, 0.3), (4001, 1.0), (29_999, 1.0), (30_000, 2.0), (100_000, 2.0)]
)
def test_session_coefficient(spark, tokens, weight):
    row = spark.range(1).select(roi.session_coeff(F.lit(tokens)).cast("double")).first()
    assert row[0] == weight


def test_single_success(spark):
    s = summary(spark, {"tools_used": ["CRM"]})
    assert (s.total_fte_hours_saved, s.total_manual_cost, s.total_agent_cost) == (0.5, 600.0, 0.15)
    assert (s.net_savings, s.roi_multiplier, s.process_automation_rate) == (599.85, 4000.0, 100.0)


def test_short_and_long_sessions(spark):
    assert summary(spark, {"tokens": 1000, "manual_time_minutes": 60.0}).total_fte_hours_saved == 0.3
    assert summary(spark, {"tokens": 50_000}).total_fte_hours_saved == 1.0


def test_failed_row(spark):
    s = summary(spark, {"status": "error_tool", "tokens": 5000, "tools_used": ["CRM"]})
    assert (s.total_fte_hours_saved, s.wasted_tokens_on_errors, s.process_automation_rate) == (0.0, 5000, 0.0)


def test_zero_tokens(spark):
    s = summary(spark, {"tokens": 0})
    assert (s.total_agent_cost, s.roi_multiplier, s.token_value_index) == (0.0, 0.0, 0.0)


def test_mixed(spark):
    s = summary(spark, {}, {}, {"status": "error_tool"}, {"status": "hallucination_loop"})
    assert (s.success_rate_percent, s.total_fte_hours_saved) == (50.0, 1.0)
    assert (s.wasted_tokens_on_errors, s.total_tokens_consumed) == (20_000, 40_000)


def test_missing_minutes_use_the_class_table(spark):
    s = summary(spark, {"manual_time_minutes": None, "task_type": "code_help"})
    assert (s.total_fte_hours_saved, s.manual_minutes_estimated_percent) == (0.5, 100.0)


def test_status_is_folded(spark):
    assert summary(spark, {"status": " SUCCESS "}, {"status": "completed"}, {"status": "Ok"}).success_rate_percent == 100.0


def test_no_rows(spark):
    s = roi.roi_summary(roi.roi_rows(make(spark, {}).limit(0), CFG), CFG).first()
    assert (s.total_logs, s.success_rate_percent, s.net_savings, s.mau_count) == (0, 0.0, 0.0, 0)
    v = roi.roi_verdict(roi.roi_rows(make(spark, {}).limit(0), CFG), CFG).first()
    assert v.headline == "Недостаточно данных для вердикта" and not v.pays_off


def test_rollup_gives_the_same_report(spark):
    rows = roi.roi_rows(
        make(
            spark,
            {"user_id": "a", "style": "voice", "scenario_id": "s", "scenario_name": "S"},
            {"user_id": "b", "style": "typo", "status": "error"},
            {"user_id": "a", "tokens": 500, "task_type": "education"},
        ),
        CFG,
    )
    roll = roi.roi_rollup(rows)
    for f in (roi.roi_summary, roi.roi_by_category, roi.roi_by_scenario, roi.roi_user_stats, roi.department_costs):
        assert sorted(map(tuple, f(rows, CFG).collect())) == sorted(map(tuple, f(roll, CFG).collect()))


def test_verdict_texts(spark):
    good = roi.roi_verdict(roi.roi_rows(make(spark, {}), CFG), CFG).first()
    assert good.headline == "ИИ окупается: выгода 600 ₽ > затрат 0 ₽ (×4000.0, чистыми 600 ₽)"
    dear = replace(CFG, price_per_1k=100.0)
    bad = roi.roi_verdict(roi.roi_rows(make(spark, {}), dear), dear).first()
    assert bad.headline == "ИИ пока не окупается: выгода 600 ₽ < затрат 1 тыс ₽ (минус 400 ₽)"
    assert (bad.net, bad.ratio, bad.pays_off) == (-400.0, 0.6, False)


def test_style_insight(spark):
    def text(*styles):
        rows = roi.roi_rows(make(spark, *[{"style": s} for s in styles]), CFG)
        return roi.style_insight(roi.roi_summary(rows, CFG), CFG).first()[0]

    assert text("formal") == "Неформальных запросов не зафиксировано."
    assert text("voice", "typo", "formal", "formal").startswith("50.0% запросов приходят в неформальном стиле (голос 25.0%, опечатки 25.0%)")
    low = text("voice", *["formal"] * 9)
    assert low.startswith("Неформальный стиль — 10.0% запросов") and "ниже порога 20.0%" in low


def test_tools_variant(spark):
    rows = roi.roi_rows(
        make(
            spark,
            {"manual_time_minutes": None, "gold_category": "code_help", "tokens": 60_000, "tools_used": ["a", "b"]},
            {"manual_time_minutes": 0.0},
            {"status": "Success", "manual_time_minutes": None},
            {"manual_time_minutes": None, "tokens": 9_999},
        ),
        variant="tools",
    )
    assert [float(r.saved_minutes) for r in rows.orderBy("request_id").collect()] == [90.0, 0.0, 0.0, 3.0]


def test_assumptions(spark):
    table = {r.metric: r.value for r in roi.roi_assumptions(spark).collect()}
    assert table["manual_minutes:data_analysis"] == "45.0"
    assert float(table["fte_hourly_rate"]) == pytest.approx(2380.952, abs=1e-3)
    assert float(table["token_cost_per_1k"]) == 0.139
