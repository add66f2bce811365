"""Clustering, stable ids and online assignment on small vectors, and skewed inputs."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from agentlog.config import ScenarioConfig
from agentlog.functions import vectors as vx
from agentlog.operators import embedding, scenarios as sc

ROW = "request_id string, task_type string, timestamp timestamp, embedding array<double>"
STATE = "scenario_id string, task_type string, centroid array<double>, count long"
T0 = datetime(2024, 1, 1)


def rows_of(spark, items):
    data = [(rid, kind, T0 + timedelta(seconds=i), [float(x) for x in v]) for i, (rid, kind, v) in enumerate(items)]
    return spark.createDataFrame(data, ROW)


def empty_state(spark):
    return spark.createDataFrame([], STATE)


def test_leader_clustering(spark):
    v = rows_of(
        spark,
        [("base", "a", [1, 0, 0]), ("near", "a", [0.99, 0.1, 0]), ("other", "a", [0, 1, 0]), ("type", "b", [1, 0, 0])],
    )
    got = {r.request_id: r.scenario_id for r in sc.assign_online(v, empty_state(spark)).rows.collect()}
    assert got == {"base": "a:cluster_0", "near": "a:cluster_0", "other": "a:cluster_1", "type": "b:cluster_0"}


def test_centroids_move_to_the_running_mean(spark):
    state = spark.createDataFrame([("a:cluster_4", "a", [1.0, 0.0], 3)], STATE)
    v = rows_of(spark, [("x", "a", [0.9, 0.2]), ("y", "a", [0, 1])])
    out = {r.scenario_id: r for r in sc.assign_online(v, state).centroids.collect()}
    assert out["a:cluster_4"].centroid == pytest.approx([(3 + 0.9) / 4, 0.2 / 4]) and out["a:cluster_4"]["count"] == 4
    assert out["a:cluster_5"].centroid == pytest.approx([0, 1])


def sequential_leaders(items, threshold):
    """Plain reading of the rule: first come, first leader; best earlier leader wins."""
    leaders, out = {}, {}
    for rid, kind, v in items:
        v = np.asarray(v, float) / np.linalg.norm(v)
        own = leaders.setdefault(kind, [])
        sims = [float(v @ u) for u in own]
        if sims and max(sims) >= threshold:
            out[rid] = f"{kind}:cluster_{int(np.argmax(sims))}"
        else:
            out[rid] = f"{kind}:cluster_{len(own)}"
            own.append(v)
    return out


def test_online_assignment_equals_a_sequential_pass(spark, monkeypatch):
    """Many more leaders than one round takes, so several rounds run."""
    monkeypatch.setattr(sc, "LEADERS_PER_ROUND", 15)
    rng = np.random.default_rng(1)
    items = [(f"r{i:04d}", "ab"[i % 2], rng.normal(size=3)) for i in range(400)]
    got = {r.request_id: r.scenario_id for r in sc.assign_online(rows_of(spark, items), empty_state(spark), 0.97).rows.collect()}
    assert got == sequential_leaders(items, 0.97)


def test_hot_vector_is_one_scenario(spark):
    """A third of all rows are copies of one vector in one class."""
    rng = np.random.default_rng(2)
    items = [(f"r{i:04d}", "a", [1, 0, 0, 0] if i % 3 == 0 else rng.normal(size=4)) for i in range(600)]
    result = sc.assign_online(rows_of(spark, items), empty_state(spark)).rows
    assert result.count() == 600
    assert result.where("CAST(substring(request_id, 2) AS INT) % 3 = 0").select("scenario_id").distinct().count() == 1


def groups(spark, sizes, kind="a", dim=16, noise=0.15, outliers=0, seed=3):
    rng = np.random.default_rng(seed)
    items = []
    for g, n in enumerate(sizes):
        center = rng.normal(size=dim)
        center /= np.linalg.norm(center)
        items += [(f"{kind}{g}_{i}", kind, center + noise * rng.normal(size=dim) / np.sqrt(dim)) for i in range(n)]
    items += [(f"{kind}out_{i}", kind, rng.normal(size=dim)) for i in range(outliers)]
    return rows_of(spark, items)


def test_discovery_finds_groups_and_outliers(spark):
    found = sc.discover_scenarios(groups(spark, [400, 60, 30], outliers=8)).rows.collect()
    by_group = {}
    for r in found:
        by_group.setdefault(r.request_id.split("_")[0], set()).add(r.scenario_id)
    assert by_group["a0"] == {"a:cluster_0"} and by_group["a1"] == {"a:cluster_1"} and by_group["a2"] == {"a:cluster_2"}
    assert all(r.is_outlier for r in found if r.request_id.startswith("aout"))


def test_discovery_of_many_copies(spark):
    """Copies fold into one cell, so neither pairs nor rows of a group are collected."""
    items = [(f"c{i}", "a", [1.0] * 8) for i in range(500)] + [(f"d{i}", "a", [(-1.0) ** j for j in range(8)]) for i in range(40)]
    found = sc.discover_scenarios(rows_of(spark, items)).rows
    assert sorted((r.scenario_id, r["count"]) for r in found.groupBy("scenario_id").count().collect()) == [
        ("a:cluster_0", 500), ("a:cluster_1", 40),
    ]


def test_small_and_shapeless_classes_fall_back(spark):
    rng = np.random.default_rng(5)
    small = [(f"s{i}", "small", rng.normal(size=32)) for i in range(4)]
    loose = [(f"l{i}", "loose", rng.normal(size=32)) for i in range(40)]
    found = sc.discover_scenarios(rows_of(spark, small + loose))
    types = {r.task_type: (r.fallback, r.statistical_reliability) for r in found.types.collect()}
    assert types == {"small": ("small_group_centroid", "low"), "loose": ("all_outliers_collapsed", "low")}
    assert {r.scenario_id for r in found.rows.collect()} == {"small:cluster_0", "loose:cluster_0"}


def test_discovery_with_projection(spark):
    cfg = ScenarioConfig(reduce_dims=8)
    found = sc.discover_scenarios(groups(spark, [80, 50], dim=40), cfg).rows
    got = found.select(F.split("request_id", "_")[0].alias("g"), "scenario_id", F.size("embedding").alias("d")).distinct().collect()
    assert sorted(map(tuple, got)) == [("a0", "a:cluster_0", 40), ("a1", "a:cluster_1", 40)]


def test_effective_sizes(spark):
    cfg = ScenarioConfig()
    a, b = sc.effective_sizes(F.col("n"), cfg)
    df = spark.createDataFrame([(1,), (12,), (100,)], "n long").select("n", a, b)
    assert [tuple(r) for r in df.orderBy("n").collect()] == [(1, 2, 2), (12, 4, 4), (100, 10, 4)]


CENT = "task_type string, scenario_id string, centroid array<double>"


def stable(spark, new, old, **kw):
    def make(items):
        return spark.createDataFrame([(s.split(":")[0], s, [float(x) for x in v]) for s, v in items.items()], CENT)

    return {r.new_id: r.stable_id for r in sc.stabilize_ids(make(new), make(old), **kw).collect()}


def test_swapped_directions_swap_ids(spark):
    old = {"a:cluster_0": [1, 0], "a:cluster_1": [0, 1]}
    new = {"a:cluster_0": [0, 1], "a:cluster_1": [1, 0.1]}
    assert stable(spark, new, old) == {"a:cluster_0": "a:cluster_1", "a:cluster_1": "a:cluster_0"}


def test_orthogonal_scenario_takes_a_free_number(spark):
    old = {"a:cluster_0": [1, 0, 0]}
    new = {"a:cluster_0": [0, 1, 0], "a:cluster_1": [1, 0, 0]}
    assert stable(spark, new, old) == {"a:cluster_1": "a:cluster_0", "a:cluster_0": "a:cluster_1"}


def test_first_run_keeps_ids(spark):
    assert stable(spark, {"b:cluster_3": [1, 0]}, {"a:cluster_0": [1, 0]}) == {"b:cluster_3": "b:cluster_3"}


def test_best_pair_goes_first(spark):
    old = {"a:cluster_0": [1, 0.02], "a:cluster_1": [1, 0.3]}
    new = {"a:cluster_0": [1, 0.1], "a:cluster_1": [1, 0.0]}
    # (1, 0) is the closest pair; the other new one is left with old 1.
    assert stable(spark, new, old) == {"a:cluster_1": "a:cluster_0", "a:cluster_0": "a:cluster_1"}


def test_greedy_matching_equals_brute_force(spark):
    rng = np.random.default_rng(7)
    new = {f"a:cluster_{i}": rng.normal(size=3) for i in range(6)}
    old = {f"a:cluster_{i}": rng.normal(size=3) for i in range(9)}

    def cos(x, y):
        return float(x @ y / np.linalg.norm(x) / np.linalg.norm(y))

    want, used = {}, set()
    for s, n, o in sorted(((-cos(v, w), n, o) for n, v in new.items() for o, w in old.items() if cos(v, w) >= 0.3)):
        if n not in want and o not in used:
            want[n] = o
            used.add(o)
    got = stable(spark, new, old, threshold=0.3)
    assert {n: o for n, o in got.items() if n in want} == want
    assert len(set(got.values())) == len(new)


def test_matching_of_many_scenarios_equals_one_sorted_pass(spark):
    """Every new scenario of one class is similar to many old ones; ties in similarity."""
    rng = np.random.default_rng(11)
    pairs = [("a", f"n{i:03d}", f"o{j:03d}", round(float(rng.random()), 2), i, j) for i in range(150) for j in range(130) if rng.random() < 0.3]
    df = spark.createDataFrame(pairs, "task_type string, new_id string, old_id string, sim double, n_new long, n_old long")
    want, used = {}, set()
    for _, new, old, *_ in sorted(pairs, key=lambda p: (-p[3], p[4], p[5])):
        if new not in want and old not in used:
            want[new] = old
            used.add(old)
    assert {r.new_id: r.stable_id for r in sc.match_pairs(df).collect()} == want
    assert sc.match_pairs(df.limit(0)).count() == 0


def test_block_join_equals_broadcast(spark):
    v = groups(spark, [50, 50, 50], outliers=30)
    refs = v.where("request_id LIKE '%_1'").select("task_type", F.col("request_id").alias("scenario_id"), F.col("embedding").alias("centroid"))
    a = embedding.nearest(v, refs).select("request_id", "best_ref", F.round("best_sim", 9)).collect()
    b = embedding.nearest(v, refs, budget=300).select("request_id", "best_ref", F.round("best_sim", 9)).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_search_and_pairs_in_passes_equal_one_pass(spark):
    v = groups(spark, [40, 40])
    q = v.limit(12).select(F.col("request_id").alias("query_id"), "embedding")
    one = embedding.vector_search(v, q, 5).collect()
    many = embedding.vector_search(v, q, 5, budget=600).collect()
    assert sorted((r.query_id, r["rank"], r.request_id) for r in one) == sorted((r.query_id, r["rank"], r.request_id) for r in many)
    refs = v.limit(12).select("task_type", F.col("request_id").alias("scenario_id"), F.col("embedding").alias("centroid"))
    a = embedding.pairs_above(v, refs, 0.9, vec="embedding").select("request_id", "ref").collect()
    b = embedding.pairs_above(v, refs, 0.9, vec="embedding", budget=600).select("request_id", "ref").collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b)) and a


def test_no_references(spark):
    v = groups(spark, [3])
    refs = spark.createDataFrame([], "task_type string, scenario_id string, centroid array<double>")
    assert {tuple(r) for r in embedding.nearest(v, refs).select("best_ref", "best_sim").collect()} == {(None, None)}


def test_representatives(spark):
    v = groups(spark, [30]).withColumn("scenario_id", F.lit("a:cluster_0")).withColumn("query_text", F.col("request_id"))
    cents = sc.centroids(v)
    out = sc.representatives(v, cents, 10, 2).collect()
    assert len(out) == 10 and len({r.query_text for r in out}) == 10
    few = v.limit(4).unionByName(v.limit(4).withColumn("request_id", F.concat("request_id", F.lit("x"))))
    assert sc.representatives(few, cents, 10, 2).count() == 4


def test_hash_embedding(spark):
    df = spark.createDataFrame([(" Hello ",), ("hello",), ("",)], "query_text string")
    a, b, c = [r.embedding for r in embedding.embed_distinct(df, vx.hash_embedder(48)).orderBy("query_text").collect()]
    assert len(a) == 48 and sorted([a, b, c]).count(b) == 2  # same text up to case and blanks


def test_cosine_of_odd_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [2.0, 0.0]), ([0.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 0.0])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(vx.cosine(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 0.0]


def test_recompute_twice_keeps_ids_and_reuses_them(spark):
    v = groups(spark, [60, 40, 20])
    a = v.select("request_id", "task_type", "timestamp")
    none = spark.createDataFrame([], "scenario_id string, task_type string, centroid array<double>")
    first = sc.recompute(a, v, none, T0, "job1")
    again = sc.recompute(a, v, first.clusters, T0, "job2")
    ids = lambda r: {x.request_id: x.scenario_id for x in r.rows.collect()}
    assert ids(first) == ids(again) and len(set(ids(first).values())) == 3
    less = v.where("request_id NOT LIKE 'a1%'")
    third = sc.recompute(a.where("request_id NOT LIKE 'a1%'"), less, first.clusters, T0, "job3")
    kept = {k: s for k, s in ids(first).items() if not k.startswith("a1")}
    assert ids(third) == kept
    run = third.run.first()
    assert (run.status, run.clusters_created, run.scenarios_named, run.logs_at_completion) == ("completed", 2, 2, 80)


def test_small_scenario_beside_a_large_one(spark):
    """Ten rows of one direction are a scenario beside thousands of others."""
    rng = np.random.default_rng(5)
    axes = np.linalg.qr(rng.standard_normal((16, 16)))[0]

    def rows(name, axis, n):
        return [
            (f"{name}{i}", "T", [float(x) for x in axes[axis] + 0.02 * rng.standard_normal(16)])
            for i in range(n)
        ]

    data = rows("a", 0, 20_000) + rows("b", 1, 20_000) + rows("c", 2, 10)
    df = spark.createDataFrame(data, "request_id string, task_type string, embedding array<double>")
    found = sc.discover_scenarios(df).rows
    small = found.where("request_id LIKE 'c%'")
    assert small.select("scenario_id").distinct().count() == 1
    assert small.where("is_outlier").count() == 0
    assert found.select("scenario_id").distinct().count() == 3


def around(rng, dim, n, cosine):
    """Unit vectors at one cosine to a random centre."""
    centre = rng.standard_normal(dim)
    centre /= np.linalg.norm(centre)
    side = rng.standard_normal((n, dim))
    side -= np.outer(side @ centre, centre)
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    return cosine * centre + np.sqrt(1 - cosine**2) * side


def labelled_groups(spark, parts, kind="T"):
    """`parts` maps a name to its vectors; request ids start with the name."""
    items = [(f"{name}_{i}", kind, v.tolist()) for name, vectors in parts.items() for i, v in enumerate(vectors)]
    return spark.createDataFrame(items, "request_id string, task_type string, embedding array<double>")


def found_groups(found):
    """Per name, the rows of each label."""
    out = {}
    for r in found.rows.groupBy(F.split("request_id", "_")[0].alias("g"), "label").count().collect():
        out.setdefault(r.g, {})[r.label] = r["count"]
    return out


@pytest.mark.parametrize("dim", [32, 128])
def test_loose_groups_come_apart(spark, dim):
    """Members at cosine 0.78 to their centre, hence about 0.6 to each other."""
    rng = np.random.default_rng(dim)
    found = sc.discover_scenarios(labelled_groups(spark, {f"g{k}": around(rng, dim, 300, 0.78) for k in range(5)}))
    got = found_groups(found)
    assert all(len(labels) == 1 for labels in got.values()), got
    assert sorted(label for labels in got.values() for label in labels) == [0, 1, 2, 3, 4]


def test_small_group_beside_shapeless_rows(spark):
    """A group of the least size beside 1,000 times as many rows without shape."""
    rng = np.random.default_rng(64)
    noise = rng.standard_normal((10_000, 64))
    found = sc.discover_scenarios(labelled_groups(spark, {"small": around(rng, 64, 10, 0.95), "noise": noise}))
    got = found_groups(found)
    assert got["small"] == {0: 10} and got["noise"][-1] >= 9_995 and got["noise"].keys() <= {-1, 0}
    assert {r.fallback for r in found.types.collect()} == {"none"}


def test_groups_of_unlike_density(spark):
    rng = np.random.default_rng(9)
    parts = {"a": around(rng, 64, 1000, 0.78), "b": around(rng, 64, 50, 0.95), "c": around(rng, 64, 30, 0.99)}
    assert found_groups(sc.discover_scenarios(labelled_groups(spark, parts))) == {"a": {0: 1000}, "b": {1: 50}, "c": {2: 30}}


def test_blocks_of_a_hot_cell(spark):
    """A third of the rows are copies of one vector; blocks are far smaller than the cell."""
    rng = np.random.default_rng(4)
    hot = np.repeat(around(rng, 16, 1, 0.9), 1500, axis=0)
    parts = {"hot": hot, "b": around(rng, 16, 1500, 0.97), "c": around(rng, 16, 1500, 0.97)}
    cfg = ScenarioConfig(cell_rows=64, block_rows=100)
    got = found_groups(sc.discover_scenarios(labelled_groups(spark, parts), cfg))
    assert got["hot"].keys() & {0, 1, 2} and len(got["hot"]) == 1
    assert all(max(x.values()) > 1400 for x in got.values()) and len({max(x, key=x.get) for x in got.values()}) == 3


def test_odd_vectors_are_outliers(spark):
    """Null, empty and zero vectors take part in no cluster and break nothing."""
    rng = np.random.default_rng(6)
    parts = labelled_groups(spark, {"a": around(rng, 16, 40, 0.97), "b": around(rng, 16, 40, 0.97)})
    odd = spark.createDataFrame([("z_1", "T", [0.0] * 16), ("z_2", "T", None), ("z_3", "T", []), ("z_4", "T", [1.0])], parts.schema)
    got = found_groups(sc.discover_scenarios(parts.unionByName(odd)))
    assert got == {"a": {0: 40}, "b": {1: 40}, "z": {-1: 4}} or got == {"a": {1: 40}, "b": {0: 40}, "z": {-1: 4}}
    assert sc.discover_scenarios(parts.limit(0)).rows.count() == 0


def test_components_within_graphs(spark):
    from agentlog.operators.graph import components

    chain = [(0, i, i + 1) for i in range(60)] + [(1, i, i + 1) for i in range(60) if i % 10]
    got = components(spark.createDataFrame(chain, "g long, a long, b long"), ["g"]).collect()
    assert {r.root for r in got if r.g == 0} == {0}
    assert {(r.node, r.root) for r in got if r.g == 1} == {(i, max(1, (i - 1) // 10 * 10 + 1)) for i in range(1, 61)}
