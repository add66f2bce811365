"""Stateful streams against a sequential pass, restarts and late rows."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F, types as T

from agentlog.streaming import state as st

T0 = datetime(2024, 1, 1)
ROW = "source_id string, request_id string, task_type string, timestamp timestamp, embedding array<double>"


def write(spark, path, rows, schema):
    """Adds one file, the next unit of a file stream."""
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path))


def stream(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def sequential(batches, known, threshold):
    """Plain reading of the rule, one row after the other, over all batches."""
    state = {k: [np.asarray(c, float), n] for k, (c, n) in known.items()}
    out = {}
    for batch in batches:
        for source, rid, kind, _, v in sorted(batch, key=lambda r: (r[3], r[1])):
            v = np.asarray(v, float)
            own = sorted((k[1], k) for k in state if k[0] == kind)
            sims = [(float(state[k][0] @ v / np.linalg.norm(state[k][0]) / np.linalg.norm(v)), -n, k) for n, k in own]
            if sims and max(sims)[0] >= threshold:
                key = max(sims)[2]
                c, n = state[key]
                state[key] = [c + (v - c) / (n + 1), n + 1]
            else:
                key = (kind, max((n for n, _ in own), default=-1) + 1)
                state[key] = [v, 1]
            out[source, rid] = f"{kind}:cluster_{key[1]}"
    return out, state


@pytest.fixture
def assigned(spark, tmp_path):
    """Two live sources whose files alternate, through one query that starts from a cluster
    table, stopped and started again in between."""
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(9, 12))
    batches = []
    for b in range(4):
        rows = []
        for i in range(30):
            k = int(rng.integers(9))
            v = centres[k] + 0.25 * rng.normal(size=12)
            rows.append((f"s{b % 2}", f"r{b}_{i:02d}", "xyz"[k % 3], T0 + timedelta(minutes=int(rng.integers(60))), v.tolist()))
        batches.append(rows)
    clusters = spark.createDataFrame(
        [("x:cluster_7", "x", centres[0].tolist(), 5), ("y:cluster_2", "y", centres[1].tolist(), None), ("z:cluster_0", "z", [], 3)],
        "scenario_id string, task_type string, centroid array<double>, records_count long",
    )
    table = st.StreamTable(spark, str(tmp_path / "out"))
    checkpoint = str(tmp_path / "ckpt")

    def sink(batch, batch_id):
        table.write(batch, batch_id, "live")

    for half in (batches[:2], batches[2:]):
        for b, rows in enumerate(half):
            write(spark, tmp_path / f"s{b % 2}", rows, ROW)
        both = stream(spark, tmp_path / "s0", ROW).unionByName(stream(spark, tmp_path / "s1", ROW))
        st.run(st.assign_stream(both, clusters, 0.9), sink, checkpoint)
    seen = {}
    rows = table.read(st.assigned_schema(T._parse_datatype_string(ROW))).collect()
    for r in rows:
        seen.setdefault(r.batch_id, set()).add(r.source_id)
    order = [[x for b in batches for x in b if (x[0], x[1]) in {(r.source_id, r.request_id) for r in rows if r.batch_id == n}]
             for n in sorted(seen)]
    return rows, order, centres, checkpoint


def test_online_state_equals_a_sequential_pass(spark, assigned):
    rows, order, centres, checkpoint = assigned
    want, state = sequential(order, {("x", 7): (centres[0], 5), ("y", 2): (centres[1], 1)}, 0.9)
    assert {(r.source_id, r.request_id): r.scenario_id for r in rows} == want and len(rows) == 120
    opened = [r.scenario_id for r in rows if r.is_new_cluster]
    assert len(opened) == len(set(opened)) and not {"x:cluster_7", "y:cluster_2"} & set(opened)
    got = {r.scenario_id: r for r in st.online_centroids(spark, checkpoint).collect()}
    assert set(got) == {f"{k}:cluster_{n}" for k, n in state}
    for (k, n), (c, count) in state.items():
        assert got[f"{k}:cluster_{n}"]["count"] == count
        assert got[f"{k}:cluster_{n}"].centroid == pytest.approx(c.tolist())


KEYED = "source_id string, request_id string, timestamp timestamp, arrived timestamp"
STORED = T.StructType([T.StructField(c, T.StringType()) for c in ("source_id", "request_id")] + [T.StructField("timestamp", T.TimestampType())])


def test_repeats_are_stored_once(spark, tmp_path):
    """Repeats at once, after the state has let go of the key, and of a second writer."""
    table = st.StreamTable(spark, str(tmp_path / "out"))
    passed = []

    def sink(writer):
        store = st.store_once(table, STORED, writer)

        def count(batch, batch_id):
            passed.append(batch.count())
            store(batch, batch_id)
            store(batch, batch_id)  # a repeated batch replaces itself

        return count

    def rows(ids, hour):
        return [("s", f"r{i}", T0, T0 + timedelta(hours=hour)) for i in ids]

    def go(path, ids_by_hour, writer):
        for ids, hour in ids_by_hour:
            write(spark, path, rows(ids, hour), KEYED)
            once = st.once_within(stream(spark, path, KEYED), within="1 hour", arrived=F.col("arrived"))
            st.run(once, sink(writer), str(tmp_path / f"ckpt-{writer}"))

    go(tmp_path / "a", [([1, 2, 2, 3], 0), ([3, 4], 0), ([5], 9), ([1, 5, 6], 20)], "one")
    go(tmp_path / "b", [([1, 6, 7], 21)], "two")
    got = sorted(r.request_id for r in table.read(STORED).collect())
    assert got == [f"r{i}" for i in range(1, 8)]
    assert sum(passed) < 4 + 2 + 1 + 3 + 3  # state took some of the repeats


def test_large_batches_are_not_broadcast(spark, tmp_path, monkeypatch):
    """Keys of a batch above the session's limit stay out of the driver; small ones are broadcast."""
    plans, write_batch = [], st.StreamTable.write

    def write(table, rows, *args):
        plans.append(rows._jdf.queryExecution().executedPlan().toString())
        write_batch(table, rows, *args)

    monkeypatch.setattr(st.StreamTable, "write", write)
    table = st.StreamTable(spark, str(tmp_path / "out"))
    store, limit = st.store_once(table, STORED, "one"), "spark.sql.autoBroadcastJoinThreshold"
    try:
        for no, size in enumerate(("-1", "-1", "10m", "10m")):
            spark.conf.set(limit, size)
            rows = [("s", f"r{i}", T0) for i in range(3 * no, 3 * no + 6)]
            store(spark.createDataFrame([*rows, rows[0]], STORED), no)
    finally:
        spark.conf.unset(limit)
    assert ["Broadcast" in p for p in plans] == [False, False, True, True]
    assert sorted(r.request_id for r in table.read(STORED).collect()) == sorted(f"r{i}" for i in range(15))


def test_keys_of_repeats_lie_on_disk(spark, tmp_path):
    spark.conf.unset(st._PROVIDER)
    write(spark, tmp_path / "in", [("s", "r", T0, T0)] * 3, KEYED)
    table = st.StreamTable(spark, str(tmp_path / "out"))
    once = st.once_within(stream(spark, tmp_path / "in", KEYED))
    st.run(once, st.store_once(table, STORED, "one"), str(tmp_path / "ckpt"))
    assert table.read(STORED).count() == 1
    files = {p.suffix for p in (tmp_path / "ckpt" / "state").rglob("*") if p.is_file()}
    assert ".zip" in files and ".delta" not in files  # of RocksDB, not of maps in the heap


def test_days_with_late_rows_and_a_restart(spark, tmp_path):
    days, late = st.StreamTable(spark, str(tmp_path / "days")), st.StreamTable(spark, str(tmp_path / "late"))

    def row(day, arrived):
        return ("s", "r", T0 + timedelta(days=day, hours=3), T0 + timedelta(days=arrived, hours=4))

    path = tmp_path / "in"
    parts = [[row(0, 0), row(0, 0), row(1, 1)], [row(20, 20), row(19, 20)], [row(1, 21), row(30, 21), row(20, 21)]]
    for part in parts:  # every part by a query started anew on the same checkpoint
        write(spark, path, part, KEYED)
        source = stream(spark, path, KEYED)
        st.run(
            st.daily_counts(source, "5 days", F.col("arrived")), lambda b, n: days.write(b, n, "one"), str(tmp_path / "c1"), "update"
        )
        st.run(st.late_counts(source, "5 days", F.col("arrived")), st.count_late(late, "one"), str(tmp_path / "c2"))
    got = {r.date: r["count"] for r in st.dynamics(days, late).collect()}
    assert got == {"2024-01-01": 2, "2024-01-02": 2, "2024-01-20": 1, "2024-01-21": 2, "2024-01-31": 1}
    assert {r.date for r in late.read(st.DAYS).collect()} == {"2024-01-02", "2024-01-31"}


def test_totals_of_a_new_checkpoint_take_over(spark, tmp_path):
    schema = "source_id string, status string"
    path, table = tmp_path / "in", st.StreamTable(spark, str(tmp_path / "out"))
    for part in ([("a", "success"), ("b", "error")], [("a", "success"), (None, "success")]):
        write(spark, path, part, schema)
        st.run(
            st.source_totals(stream(spark, path, schema)), lambda b, n: table.write(b, n, "one"), str(tmp_path / "c1"), "update"
        )
    want = {("a", 2, 2), ("b", 1, 0), ("_unknown", 1, 1)}
    assert {tuple(r) for r in table.last(st.TOTALS, ["source_id"]).collect()} == want
    st.run(st.source_totals(stream(spark, path, schema)), lambda b, n: table.write(b, n, "two"), str(tmp_path / "c2"), "update")
    assert {tuple(r) for r in table.last(st.TOTALS, ["source_id"]).collect()} == want
    assert table.read(st.TOTALS).select("writer").distinct().count() == 2
