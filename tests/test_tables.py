"""Stored tables, keyed operators on hot keys, users, report file, plans, streams."""

import shutil
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from agentlog import schemas
from agentlog.operators import classify, joins, keyed, ranking, roi, users
from agentlog.plans.fixtures import Fixtures
from agentlog.session import cut_lineage, shared_folder
from agentlog.sources.report import write_roi_csv
from agentlog.sources.tables import Tables, save_bucketed
from agentlog.streaming import live

COUNTS = "source_id string, accepted long, classified long, assigned long, rejected long, duplicates long"


def counter(spark, n):
    return spark.createDataFrame([("s", n, n, n, 0, 0)], COUNTS)


def test_versions_and_batches(spark, tmp_path):
    t = Tables(spark, str(tmp_path))
    assert t.counters().count() == 0
    t.write_batch("ingest_counters", counter(spark, 1), 0)
    t.write_batch("ingest_counters", counter(spark, 2), 1)
    t.write_batch("ingest_counters", counter(spark, 5), 1)  # the same batch again
    assert live.counters(t).first().accepted == 6
    assert t.read("ingest_counters", schemas.COUNTERS, before=1).first().accepted == 1
    t.compact("ingest_counters", schemas.COUNTERS, ["source_id"], ["accepted"])
    assert live.counters(t).first().accepted == 5
    t.write_batch("ingest_counters", counter(spark, 7), 2)
    assert live.counters(t).first().accepted == 12


def test_unfinished_folders_do_not_count(spark, tmp_path):
    t = Tables(spark, str(tmp_path))
    path = t.write_batch("ingest_counters", counter(spark, 1), 0)
    t.write_batch("ingest_counters", counter(spark, 2), 1)
    shutil.os.remove(f"{path}/_SUCCESS")
    assert live.counters(t).first().accepted == 2


def test_upsert_last_wins_and_keeps_creation(spark):
    schema = "source_id string, request_id string, task_type string, seq int, created_at timestamp, updated_at timestamp"
    old = spark.createDataFrame([("s", "req-1", "a", 0, datetime(2024, 1, 1), datetime(2024, 1, 1))], schema)
    new = spark.createDataFrame([("s", "req-1", "b", 1), ("s", "req-1", "c", 2), ("s", "req-2", "d", 1)], "source_id string, request_id string, task_type string, seq int")
    out = keyed.upsert(old, new, schemas.KEYS, ["seq"], datetime(2024, 2, 2)).orderBy("request_id").collect()
    assert [(r.request_id, r.task_type, r.created_at.month, r.updated_at.month) for r in out] == [("req-1", "c", 1, 2), ("req-2", "d", 2, 2)]


def test_hot_key_is_reduced_before_the_shuffle(spark):
    """A third of the rows share one key; each task sends at most one row of it on."""
    df = spark.range(90_000).repartition(8).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("request_id"), "id"
    )
    first = keyed.first_per(df, ["request_id"], ["id"])
    assert first.count() == 60_001 and first.where("request_id = 'hot'").first().id == 0
    plan = first._jdf.queryExecution().executedPlan().toString()
    assert "partial_min" in plan and "Window" not in plan


def test_rank_of_a_hot_group(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.lit("b")).alias("g"), F.col("id").alias("x"))
    rows = ranking.rank_within(df.repartition(5), ["g"], ["x"], "rank", "size").collect()
    assert all(r["rank"] == (r.x // 3 if r.g == "hot" else r.x - r.x // 3 - 1) for r in rows)
    assert {(r.g, r.size) for r in rows} == {("hot", 1000), ("b", 2000)}


def test_checkpoint_folder_comes_from_the_session(spark, tmp_path):
    folder = shared_folder(spark)
    assert folder == shared_folder(spark)
    assert cut_lineage(spark.range(3)).count() == 3


def test_bucketed_tables_join_without_a_shuffle(spark, sf_dir, tmp_path):
    fx = Fixtures(spark, sf_dir)
    save_bucketed(fx.records.drop("k", "tools_csv"), "b_records", str(tmp_path / "r"), buckets=4)
    save_bucketed(fx.assignments, "b_assignments", str(tmp_path / "a"), buckets=4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        both = joins.joined(spark.table("b_records"), spark.table("b_assignments"))
        plan = both._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        assert both.count() == fx.records.count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE b_records")
        spark.sql("DROP TABLE b_assignments")


def test_filters_and_columns_reach_the_scan(spark, tmp_path):
    t = Tables(spark, str(tmp_path))
    rows = spark.createDataFrame([("s", "r", "x", 5)], "source_id string, request_id string, style string, tokens long")
    t.replace("records", rows, ["source_id"])
    plan = t.records().where("source_id = 's' AND tokens > 3").select("style")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(source_id" in plan and "GreaterThan(tokens,3)" in plan
    assert "ReadSchema: struct<style:string,tokens:bigint>" in plan


JOINED = (
    "request_id string, user_id string, user_name string, department string, status string, tokens long, manual_time_minutes double, "
    "tools_used array<string>, timestamp timestamp, task_type string, gold_category string, is_outlier boolean, has_failure_signals boolean"
)


def log(i, user, kind, day=1, **kw):
    base = dict(user_name=user, department=None, status="success", tokens=10_000, manual_time_minutes=30.0, tools_used=[], gold_category=None, is_outlier=False, has_failure_signals=False)
    r = {**base, **kw}
    return (f"r{i}", user, r["user_name"], r["department"], r["status"], r["tokens"], r["manual_time_minutes"], r["tools_used"], datetime(2024, 1, day), kind, r["gold_category"], r["is_outlier"], r["has_failure_signals"])


def test_personas(spark):
    kinds = ["text_generation", "education", "task_management", "other", "unknown"]
    data = [log(i, "coder", "code_help") for i in range(60)]
    data += [log(100 + i, "super", kinds[i % 5]) for i in range(60)]
    data += [log(200, "rare", "education")]
    table = {r.user_id: r for r in users.users_table(spark.createDataFrame(data, JOINED)).collect()}
    assert {u: r.persona for u, r in table.items()} == {"coder": "code_craftsman", "super": "super_user", "rare": "casual"}
    assert table["rare"].needs_guidance and not table["coder"].needs_guidance
    assert table["coder"].saved_hours == 30.0 and table["coder"].department == "Общий"


def test_active_window(spark):
    df = spark.createDataFrame([log(1, "a", "other", 31), log(2, "b", "other", 1)], JOINED)
    people = users.users_table(df)
    assert (users.users_summary(people).first().total_users, users.active_users(people).first()[0]) == (2, 1)


def test_models(spark):
    df = spark.createDataFrame(
        [log(1, "a", "other", tokens=1000, tools_used=["model:gpt-4o"]), log(2, "a", "other", tokens=500, tools_used=["x", "model:gpt-4o", "model:z"]), log(3, "a", "other", tools_used=["Jira"]), log(4, "a", "other", tools_used=["model: "])],
        JOINED,
    )
    m = users.model_analytics(df).collect()
    assert [(r.model_id, r.total_queries, r.share_percentage, r.total_tokens) for r in m] == [("gpt-4o", 2, 100.0, 1500)]
    assert users.model_summary(df.limit(0)).first().status == "not_available"


def test_empty_users(spark):
    people = users.users_table(spark.createDataFrame([], JOINED))
    s = users.users_summary(people).first()
    assert (s.total_users, s.active_users, s.avg_frustration_index) == (0, 0, 0.0)


def test_frustration(spark):
    data = [log(i, "a", "other", has_failure_signals=i < 5, is_outlier=i < 2) for i in range(10)]
    r = users.users_table(spark.createDataFrame(data, JOINED)).first()
    assert r.frustration_index == 38.0 and r.needs_guidance and "«Другое»" in r.recommendation


def test_evaluation(spark):
    from agentlog.operators.quality import classification_metrics

    df = spark.createDataFrame(
        [("code_help", "code_help"), ("data_analysis", "code_help"), ("education", "education"), (None, "unknown")], "gold string, predicted string"
    )
    m = classification_metrics(df).first()
    assert (m.n, m.n_with_gold, m.accuracy, m.unknown_rate) == (4, 3, 0.666667, 0.25)
    assert m.macro_f1 == pytest.approx((2 / 3 + 0 + 1) / 3, abs=1e-6)


def test_training_separates_groups(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    rows = fx.vectors.withColumn("label", F.concat(F.lit("class_"), F.col("proto").cast("string")))
    model = classify.train_classifier(rows, pca_dim=16)
    assert model.holdout_accuracy > 0.95 and model.meta["pca_dim"] == 16 and len(model.classes) == 12
    odd = rows.limit(3).withColumn("embedding", F.slice("embedding", 1, 16))
    assert classify.apply_pca(odd, model.pca).count() == 3


def test_report_file(spark, sf_dir, tmp_path):
    fx = Fixtures(spark, sf_dir)
    write_roi_csv(roi.roi_sheets(roi.roi_rows(fx.joined)), str(tmp_path / "out"))
    files = list((tmp_path / "out").glob("part-*"))
    assert len(files) == 1
    text = files[0].read_bytes().decode("utf-8")
    assert text.startswith("﻿# Summary\r\nmetric,value\r\nverdict_headline,")
    lines = text.split("\r\n")
    heads = [i for i, x in enumerate(lines) if x.startswith("# ") or x.startswith("﻿# ")]
    assert [lines[i].lstrip("﻿") for i in heads] == ["# Summary", "# ByCategory", "# ByScenario", "# ByStyle"]
    assert all(lines[i - 1] == "" for i in heads[1:])
    assert lines[heads[1] + 1] == "task_type,label,count,success_rate_percent,fte_hours_saved,net_savings"


def test_repeated_batch_replaces_itself(spark, sf_dir, tmp_path):
    """The sink gives the same stored content when a batch is delivered again."""
    fx = Fixtures(spark, sf_dir)
    rows = fx.vectors.withColumn("source_id", F.lit("s"))
    one, two = rows.where("vec_id < 200"), rows.where("vec_id >= 150")
    t = Tables(spark, str(tmp_path))
    sink = live.AssignmentSink(t, lambda df: df.withColumn("confidence", F.lit(0.9)))

    def state():
        a = t.assignments().select("request_id", "scenario_id").collect()
        c = t.snapshot("centroids", live.CENTROIDS).select("scenario_id", "count").collect()
        return sorted(map(tuple, a)), sorted(map(tuple, c)), tuple(live.counters(t).first())

    sink(one, 0)
    sink(two, 1)
    before = state()
    sink(two, 1)
    assert state() == before
    assert len(before[0]) == 500 and sum(n for _, n in before[1]) == 500
    assert before[2] == ("s", 500, 500, 500, 0, 50)


def test_online_state_after_recompute(spark, sf_dir, tmp_path):
    t = Tables(spark, str(tmp_path))
    c = spark.createDataFrame([("a:cluster_3", "a", [1.0, 0.0], 9), ("a:cluster_4", "a", [], 1)], "scenario_id string, task_type string, centroid array<double>, records_count long")
    live.hydrate(t, c)
    assert [tuple(r) for r in t.snapshot("centroids", live.CENTROIDS).collect()] == [("a:cluster_3", "a", [1.0, 0.0], 9)]


def test_report_bundles(spark, sf_dir):
    from agentlog.config import Filters
    from agentlog.plans import bundles

    fx = Fixtures(spark, sf_dir)
    f = Filters(source_id="src_1", from_="2024-01-05", to="2024-01-20")
    money = bundles.roi_document(fx.records, fx.assignments, f)
    n = joins.apply_filters(fx.records, f).count()
    assert money["summary"].first().total_logs == n == money["by_category"].agg(F.sum("count")).first()[0]
    people = bundles.users_document(fx.records, fx.assignments, f)
    assert people["users"].agg(F.sum("total_queries")).first()[0] == n
    assert {k: v.count() > 0 for k, v in {**money, **people}.items()} == {k: True for k in {**money, **people}}
