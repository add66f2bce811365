"""Recomputes committed as one generation, and updates by source and request."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from agentlog import schemas
from agentlog.operators import committing, keyed, scenarios
from agentlog.sources.generations import Generations

T0 = datetime(2024, 1, 1)
A = "source_id string, request_id string, scenario_id string, is_outlier boolean, updated_at timestamp"


def test_updates_meet_only_their_own_source(spark):
    rows = spark.createDataFrame([("s1", "r", "old", False, T0), ("s2", "r", "old", False, T0)], A)
    new = spark.createDataFrame(
        [("s1", "r", "z", False, 1), ("s1", "r", "a", None, 2), ("s3", "r", "no", True, 3), ("s2", "", "no", True, 4)],
        "source_id string, request_id string, scenario_id string, is_outlier boolean, step int",
    )
    out = keyed.update_scenarios(rows, new, datetime(2024, 2, 1), ["step"]).orderBy("source_id").collect()
    assert [(r.source_id, r.scenario_id, r.is_outlier, r.updated_at.month) for r in out] == [
        ("s1", "a", False, 2), ("s2", "old", False, 1),
    ]


def test_generation_shows_once_it_is_whole(spark, tmp_path):
    store = Generations(spark, str(tmp_path))
    schema = spark.range(1).schema
    assert store.current() is None and store.read("a", schema).count() == 0
    store.commit("one", {"a": spark.range(3), "b": spark.range(4)})
    broken = spark.range(5).select(F.raise_error(F.lit("lost")).cast("long").alias("id"))
    with pytest.raises(Exception, match="lost"):
        store.commit("two", {"a": spark.range(9), "b": broken})
    assert (store.current(), store.read("a", schema).count(), store.read("b", schema).count()) == ("one", 3, 4)
    store.commit("two", {"a": spark.range(9), "b": spark.range(5)})  # the same run again
    store.commit("one", {"a": spark.range(1), "b": spark.range(1)})  # done long ago
    assert (store.current(), store.read("a", schema).count(), store.read("b", schema).count()) == ("two", 9, 5)
    assert [tuple(r) for r in store.commits().orderBy("number").collect()] == [(1, "one"), (2, "two")]


def test_recompute_is_logged_once_and_keeps_other_classes(spark):
    def empty(schema):
        return spark.createDataFrame([], schema)

    other = spark.createDataFrame([("b:cluster_0", "b", [0.0, 1.0], 3)], "scenario_id string, task_type string, centroid array<double>, records_count long")
    old = empty(schemas.CLUSTERS).unionByName(other, allowMissingColumns=True)
    names = "source_id string, request_id string, task_type string, scenario_id string, is_outlier boolean, updated_at timestamp"
    a = spark.createDataFrame([("s", f"r{i}", "a", None, False, T0) for i in range(40)] + [("s", "x", "b", "b:cluster_0", False, T0)], names)
    assignments = empty(schemas.ASSIGNMENTS).unionByName(a, allowMissingColumns=True)
    vectors = a.where("task_type = 'a'").select("source_id", "request_id", F.array(F.lit(1.0), F.lit(0.0)).alias("embedding"))
    result = scenarios.recompute(assignments.where("task_type = 'a'"), vectors, old, T0, "job")
    state = committing.LogState(assignments, old, empty(schemas.SOURCES), empty(schemas.RECOMPUTE_RUNS), empty(schemas.CENTROIDS))
    after = committing.after_recompute(state, result, T0)
    again = committing.after_recompute(after, result, T0)
    assert again.recompute_runs.count() == 1
    assert {r.scenario_id: r["count"] for r in again.centroids.collect()} == {"a:cluster_0": 40, "b:cluster_0": 3}
    found = {(r.task_type, r.scenario_id) for r in again.assignments.collect()}
    assert found == {("a", "a:cluster_0"), ("b", "b:cluster_0")}
