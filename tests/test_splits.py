"""Exact shares of classes by hash order: brute force, repeated keys, nulls, empty tables."""

import hashlib
from collections import Counter, defaultdict

import pytest

from agentlog.operators import classify


def place(key, seed):
    return int(hashlib.md5(f"{seed}:{key}".encode()).hexdigest()[:15], 16), key


@pytest.fixture(scope="module")
def rows():
    labels = [None] * 7 + ["a"] * 4000 + ["b"] * 53 + ["c"]
    return [(f"r{i}", label) for i, label in enumerate(labels)]


def by_label(rows):
    groups = defaultdict(list)
    for key, label in rows:
        groups[label].append(key)
    return groups


@pytest.mark.parametrize("share", [0.0, 0.2, 1.0])
def test_split_takes_the_first_by_hash(spark, rows, share):
    df = spark.createDataFrame(rows, "request_id string, label string")
    out = classify.stratified_split(df, share=share, seed=7).collect()
    got = {r.request_id for r in out if r.is_test}
    expected = set()
    for keys in by_label(rows).values():
        expected |= set(sorted(keys, key=lambda k: place(k, 7))[: int(len(keys) * share + 0.5)])
    assert len(out) == len(rows) and got == expected


@pytest.mark.parametrize("k", [1, 3, 10])
def test_folds_are_equal_to_one_row(spark, rows, k):
    df = spark.createDataFrame(rows, "request_id string, label string")
    out = classify.stratified_folds(df, k=k).collect()
    assert len(out) == len(rows)
    sizes = Counter((r.label, r.fold) for r in out)
    for label, keys in by_label(rows).items():
        found = [sizes[label, fold] for fold in range(k)]
        assert sum(found) == len(keys) and max(found) - min(found) <= 1


def test_repeated_and_null_keys_stay_together(spark):
    data = [("same", "a")] * 300 + [(None, "a")] * 40 + [(f"r{i}", "a") for i in range(660)]
    df = spark.createDataFrame(data, "request_id string, label string")
    sides = defaultdict(set)
    for r in classify.stratified_split(df, share=0.5).collect():
        sides[r.request_id].add(r.is_test)
    assert len(sides) == 662 and all(len(s) == 1 for s in sides.values())
    assert classify.stratified_folds(df.limit(0)).collect() == []


def test_vectors_are_neither_sorted_nor_shuffled(spark):
    df = spark.range(1000).selectExpr("CAST(id AS string) AS request_id", "id % 3 AS label", "array(1.0, 2.0) AS embedding")
    plan = classify.stratified_split(df)._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan and "hashpartitioning" not in plan and "BroadcastHashJoin" in plan
