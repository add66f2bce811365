"""Statistics on small inputs with hand-computed results."""

import pytest
from pyspark.sql import functions as F

from agentlog.config import AggConfig, Filters
from agentlog.operators import joins, stats


def topn(spark, counts, n, **kw):
    df = spark.createDataFrame(list(counts.items()), "task_type string, count long")
    rows = stats.topn_other(df, "task_type", n, **kw).orderBy("rank").collect()
    return [(r.task_type, r["count"]) for r in rows]


def test_topn_tail(spark):
    got = topn(spark, dict(a=100, b=50, c=40, d=30, e=5, f=3), 3)
    assert got == [("a", 100), ("b", 50), ("c", 40), ("other", 38)]


def test_topn_protects_unknown(spark):
    got = dict(topn(spark, dict(a=100, b=50, c=20, d=10, e=1, unknown=25), 2))
    assert got == {"a": 100, "b": 50, "other": 31, "unknown": 25}


def test_topn_merges_into_other_of_the_head(spark):
    assert topn(spark, dict(a=10, b=9, c=1, other=2), 2) == [("a", 10), ("b", 9), ("other", 3)]
    assert topn(spark, dict(a=10, other=9, c=1, d=2), 2) == [("a", 10), ("other", 12)]


@pytest.mark.parametrize(
    "previous, current, cfg, trend, rate",
    [
        (10, 15, dict(trend_min_total=15), "up", 50.0),
        (10, 8, dict(trend_min_total=15), "down", -20.0),
        (10, 10, dict(trend_min_total=15), "stable", 0.0),
        (10, 11, dict(trend_min_total=15), "stable", 10.0),
        (0, 25, {}, "new", None),
        (0, 0, {}, "insufficient_data", None),
        (1, 0, {}, "insufficient_data", None),
        (3, 30, {}, "insufficient_data", None),
        (100, 111, dict(trend_threshold=10), "up", 11.0),
        (100, 110, dict(trend_threshold=10), "stable", 10.0),
    ],
)
def test_trend(spark, previous, current, cfg, trend, rate):
    t = stats.trend_of(F.lit(previous), F.lit(current), AggConfig(**cfg))
    assert tuple(spark.range(1).select(t.alias("t")).select("t.*").first()) == (trend, rate)


ASSIGNED = "request_id string, task_type string, scenario_id string, is_outlier boolean, has_failure_signals boolean, timestamp timestamp, query_text string"
CLUSTERS = "scenario_id string, task_type string, name string, records_count long"


def test_unnamed_scenario_is_not_counted(spark):
    a = spark.createDataFrame([("r", "other", "x:cluster_0", False, False, None, "t")], ASSIGNED)
    c = spark.createDataFrame([], CLUSTERS)
    assert stats.totals(a, c).first().scenarios_count == 0
    assert stats.top_scenarios(a, c, stats.scenario_trends(a)).count() == 0
    assert stats.scenario_detail(a, c, "missing").count() == 0


def test_single_stamp_has_no_trend(spark):
    a = spark.createDataFrame([("r", "other", "x:cluster_0", False, False, None, "t")], ASSIGNED)
    assert [tuple(r) for r in stats.scenario_trends(a).collect()] == [("x:cluster_0", "insufficient_data", None)]


def test_failures_are_unknown_without_any_quality_field(spark):
    a = spark.createDataFrame([("r", "other", None, False, False, None, "t")], ASSIGNED)
    assert tuple(stats.failure_summary(a).first()) == ("not_available", None, None)


def test_failure_signals_count_a_record_once_per_signal(spark):
    schema = "response_status string, error_code string, user_feedback int, retry_count int, failure_signals array<string>, has_failure_signals boolean"
    rows = [
        ("Error", "tool_error", -1, 2, ["retry", "x", "x", ""], True),
        (None, None, None, None, None, True),
        ("success", None, 0, 0, None, False),
    ]
    df = spark.createDataFrame(rows, schema)
    got = {r.signal: r["count"] for r in stats.failure_top_signals(df).collect()}
    assert got == {
        "response_status:error": 1, "tool_error": 1, "user_feedback:negative": 1, "retry": 1, "x": 1, "failure": 1,
    }
    assert tuple(stats.failure_summary(df).first()) == ("available", 2, 66.67)


def test_rollup_is_accepted_in_place_of_rows(spark):
    rows = [(f"r{i}", "other", f"s:cluster_{i % 3}", i % 5 == 0, False, None, "t") for i in range(20)]
    a = spark.createDataFrame(rows, ASSIGNED)
    c = spark.createDataFrame([("s:cluster_0", "s", "S", 1)], CLUSTERS)
    roll = stats.rollup(a)
    for f in (lambda x: stats.totals(x, c), stats.outliers, stats.task_distribution):
        assert sorted(map(tuple, f(a).collect())) == sorted(map(tuple, f(roll).collect()))


def test_bounds():
    assert joins.parse_bound("  ") is None and joins.parse_bound(None) is None
    assert joins.parse_bound("2026-07-25", end=True).isoformat() == "2026-07-25T23:59:59.999999+00:00"
    assert joins.parse_bound("2026-07-25T10:00:00Z", end=True).isoformat() == "2026-07-25T10:00:00+00:00"
    assert joins.parse_bound("2026-07-25T10:00:00+03:00").isoformat() == "2026-07-25T07:00:00+00:00"
    for bad in ("yesterday", "2026-13-01", "12:00"):
        with pytest.raises(ValueError):
            joins.parse_bound(bad)


def test_same_day_bounds_keep_the_day(spark):
    df = spark.sql("SELECT * FROM VALUES (TIMESTAMP'2026-07-25 00:00:00'), (TIMESTAMP'2026-07-25 23:59:59.5'), (TIMESTAMP'2026-07-26'), (NULL) v(timestamp)")
    assert joins.apply_filters(df, Filters(from_="2026-07-25", to="2026-07-25")).count() == 2


def test_freshness_states(spark):
    a = spark.range(3).select(F.col("id").cast("string").alias("request_id"))
    schema = "status string, completed_at timestamp, logs_at_completion long"
    none = stats.freshness(a, spark.createDataFrame([], schema)).first()
    assert (none.logs_since_last_recompute, none.recompute_pending, none.recompute_running) == (3, True, False)
    running = stats.freshness(a, spark.createDataFrame([("running", None, None)], schema)).first()
    assert (running.recompute_pending, running.recompute_running) == (False, True)
