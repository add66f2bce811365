"""Streaming operators, run to completion over files written from the given tables."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, functions as F

from agentlog import schemas
from agentlog.plans.q_normalize import EXT, OWN, RAW_STATUS, TEXT, int_sql
from agentlog.plans.registry import query
from agentlog.session import shared_folder
from agentlog.sources.raw import read_live
from agentlog.sources.tables import Tables
from agentlog.streaming import live, state


TOKENS_PLAIN = int_sql("total_tokens")
#: Rows of one written file, about: files and the tasks that write them grow in number, not in size.
FILE_ROWS = 200_000


def _folder(fx, name: str) -> str:
    return f"{shared_folder(fx.spark)}/{name}-{uuid.uuid4()}"


def _file_count(df: DataFrame) -> int:
    return max(4, math.ceil(df.count() / FILE_ROWS))


def _files(fx, df: DataFrame, name: str, fmt: str = "parquet", **options) -> str:
    """The rows as several files of bounded size, the unit a file stream reads."""
    path = _folder(fx, name)
    df.repartition(_file_count(df)).write.format(fmt).options(**options).save(path)
    return path


def _stream(fx, df: DataFrame, name: str) -> DataFrame:
    """The rows as a stream of two batches."""
    path = _files(fx, df, name)
    half = math.ceil(_file_count(df) / 2)
    return fx.spark.readStream.schema(df.schema).option("maxFilesPerTrigger", half).parquet(path)


@query("S16_read_live", f"SELECT row_idx::VARCHAR AS agent_id, {TEXT} <> '' AS filled FROM fx_raw", ("fx_raw",))
def _(fx):
    """Raw records as JSONL through the live reader; the row number travels in a field."""
    raw = fx.raw.withColumn("agent_id", F.col("row_idx").cast("string")).drop("row_idx")
    path = _files(fx, raw, "live", "json")
    tables = Tables(fx.spark, _folder(fx, "tables"))

    def sink(batch: DataFrame, batch_id: int) -> None:
        tables.write_batch("raw", batch, batch_id)

    live.run_available(read_live(fx.spark, path), sink, _folder(fx, "ckpt"))
    from agentlog.operators.normalize import with_query_text

    stored = with_query_text(tables.read("raw", schemas.RAW))
    return stored.select("agent_id", (F.col("text") != "").alias("filled"))


@query(
    "T1_normalize_stream",
    f"SELECT CASE WHEN coalesce(request_id, '') = '' THEN 'made' ELSE {EXT} END AS request_id, {TEXT} AS query_text, coalesce({RAW_STATUS}, 'success') AS status FROM fx_raw WHERE {TEXT} <> ''",
    ("fx_raw",),
)
def _(fx):
    path = _files(fx, fx.raw.drop("row_idx"), "live", "json")
    tables = Tables(fx.spark, _folder(fx, "tables"))

    def sink(batch: DataFrame, batch_id: int) -> None:
        tables.write_batch("records", batch.withColumn("source_id", F.lit("live")), batch_id)

    live.run_available(live.normalize_stream(read_live(fx.spark, path)), sink, _folder(fx, "ckpt"))
    rid = F.when(F.col("request_id").startswith("live_"), F.lit("made")).otherwise(F.col("request_id"))
    return tables.records().select(rid.alias("request_id"), "query_text", "status")


def _stored_once(fx, feeds: list[DataFrame]) -> DataFrame:
    """Every feed through a query of its own, with repeats dropped in state and at the sink."""
    table = state.StreamTable(fx.spark, _folder(fx, "records"))
    for no, feed in enumerate(feeds):
        once = state.once_within(_stream(fx, feed, f"feed{no}"))
        state.run(once, state.store_once(table, schemas.RECORDS, f"query{no}"), _folder(fx, "ckpt"))
    return table.read(schemas.RECORDS)


@query("T2_store_once", "SELECT request_id, status FROM fx_records", ("fx_records",))
def _(fx):
    """Every record arrives twice, in different files, and is stored once."""
    rows = fx.records.select(*schemas.RECORDS.fieldNames())
    return _stored_once(fx, [rows.unionByName(rows)]).select("request_id", "status")


@query("T2_two_writers", "SELECT source_id, request_id, status FROM fx_records", ("fx_records",))
def _(fx):
    """Two queries with overlapping records, then a new one that sees everything once more:
    each record is stored once and none is lost."""
    rows = fx.records.select(*schemas.RECORDS.fieldNames())
    k = F.pmod(F.xxhash64("source_id", "request_id"), F.lit(4))
    stored = _stored_once(fx, [rows.where(k < 2), rows.where((k == 1) | (k == 2)), rows])
    return stored.select("source_id", "request_id", "status")


def _two_sources(fx, clusters: DataFrame | None) -> DataFrame:
    """The vectors as two live sources, united before the one query that owns the state."""
    rows = fx.vectors.withColumn("source_id", F.concat(F.lit("src_"), F.col("vec_id") % 2))
    feeds = [_stream(fx, rows.where(F.col("source_id") == s), s) for s in ("src_0", "src_1")]
    assigned = state.assign_stream(feeds[0].unionByName(feeds[1]), clusters)
    table = state.StreamTable(fx.spark, _folder(fx, "assigned"))
    state.run(assigned, lambda batch, number: table.write(batch, number, "live"), _folder(fx, "ckpt"))
    return table.read(assigned.schema)


@query(
    "T3_two_sources",
    "SELECT proto, count(*) AS n, 1::BIGINT AS scenarios, 1::BIGINT AS opened FROM fx_vectors GROUP BY proto",
    ("fx_vectors",),
)
def _(fx):
    """Two sources, one state: every group has one scenario, opened once."""
    return _two_sources(fx, None).groupBy("proto").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("scenario_id").alias("scenarios"), F.count_if("is_new_cluster").alias("opened")
    )


@query(
    "T4_hydrated_stream",
    "SELECT request_id, task_type || ':cluster_' || (proto + 20) AS scenario_id, false AS is_new_cluster FROM fx_vectors",
    ("fx_vectors",),
)
def _(fx):
    """State that starts from a cluster table: rows join its scenarios and open none."""
    from agentlog.operators.scenarios import cluster_number, scenario_id
    from agentlog.plans.q_vectors import _centroids

    known = _centroids(fx)
    known = known.withColumn("scenario_id", scenario_id(F.col("task_type"), cluster_number(F.col("scenario_id")) + 20))
    return _two_sources(fx, known).select("request_id", "scenario_id", "is_new_cluster")


def _assigned(fx) -> Tables:
    """The vectors as a stream, half of them delivered twice, through the assignment sink."""
    rows = fx.vectors.withColumn("source_id", F.concat(F.lit("src_"), F.col("proto") % 2))
    repeated = rows.unionByName(rows.where("vec_id % 2 = 0"))
    tables = Tables(fx.spark, _folder(fx, "tables"))
    sink = live.AssignmentSink(tables, lambda df: df.withColumn("confidence", F.lit(0.9)))
    live.run_available(_stream(fx, repeated, "vectors"), sink, _folder(fx, "ckpt"))
    return tables


V = ("fx_vectors",)


@query("T3_assign_stream", "SELECT proto, count(*) AS n, 1::BIGINT AS scenarios FROM fx_vectors GROUP BY proto", V)
def _(fx):
    """Over several batches every true group ends in exactly one scenario."""
    stored = _assigned(fx).assignments()
    true = fx.vectors.select("request_id", "proto")
    return stored.join(true, "request_id").groupBy("proto").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("scenario_id").alias("scenarios")
    )


@query(
    "T5_assignment_counters",
    "SELECT 'src_' || (proto % 2) AS source_id, count(*) AS accepted, count(*) AS classified, count(*) AS assigned, 0::BIGINT AS rejected, count(CASE WHEN vec_id % 2 = 0 THEN 1 END) AS duplicates FROM fx_vectors GROUP BY 1",
    V,
)
def _(fx):
    return live.counters(_assigned(fx))


@query(
    "T5_rejected_counters",
    """SELECT 'src_' || (proto % 2) AS source_id, count(CASE WHEN vec_id % 5 <> 0 THEN 1 END) AS accepted, count(CASE WHEN vec_id % 5 = 0 THEN 1 END) AS rejected, count(CASE WHEN vec_id % 5 <> 0 THEN 1 END) AS vectors FROM fx_vectors GROUP BY 1""",
    V,
)
def _(fx):
    """Rejected rows are set aside and counted; the others leave their vector."""
    rows = fx.vectors.withColumn("source_id", F.concat(F.lit("src_"), F.col("proto") % 2)).withColumn(
        "reject_reason", F.when(F.col("vec_id") % 5 == 0, "empty_text")
    )
    tables = Tables(fx.spark, _folder(fx, "tables"))
    sink = live.AssignmentSink(tables, lambda df: df.withColumn("confidence", F.lit(0.9)))
    live.run_available(_stream(fx, rows, "vectors"), sink, _folder(fx, "ckpt"))
    stored = tables.vectors().where(F.size("embedding") > 0)
    vectors = stored.groupBy("source_id").agg(F.count(F.lit(1)).alias("vectors"))
    return live.counters(tables).join(vectors, "source_id").select("source_id", "accepted", "rejected", "vectors")


def _by_arrival(fx, rows: DataFrame, name: str) -> DataFrame:
    """A stream of files in the order of arrival."""
    path, at = _folder(fx, name), F.unix_timestamp("arrived")
    ends = rows.agg(F.min(at), F.max(at)).first()
    part = F.floor(4 * (at - ends[0]) / max(1, ends[1] - ends[0] + 1))
    for no in range(4):
        rows.where(part == no).coalesce(1).write.mode("append").parquet(path)
    return fx.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


def _counted_days(fx, feeds: list[DataFrame]) -> DataFrame:
    """Days of every feed in turn, each by queries of its own: the last one's count shows."""
    days, late = (state.StreamTable(fx.spark, _folder(fx, n)) for n in ("days", "late"))
    for no, rows in enumerate(feeds):
        feed = _by_arrival(fx, rows, f"feed{no}")
        counts = state.daily_counts(feed, "7 days", F.col("arrived"))
        state.run(counts, lambda batch, n: days.write(batch, n, f"query{no}"), _folder(fx, "ckpt"), "update")
        rest = state.late_counts(feed, "7 days", F.col("arrived"))
        state.run(rest, state.count_late(late, f"query{no}"), _folder(fx, "ckpt"))
    return state.dynamics(days, late)


def _arrivals(fx) -> DataFrame:
    """Records that arrive an hour after their time, one in eight of them 30 days after it."""
    late = F.pmod(F.xxhash64("request_id"), F.lit(8)) == 0
    hours = F.when(late, 30 * 24).otherwise(1)
    return fx.records.select("timestamp", F.timestamp_add("HOUR", hours, F.col("timestamp")).alias("arrived"))


DAYS_SQL = "SELECT strftime(timestamp, '%Y-%m-%d') AS date, count(*) AS count FROM fx_records GROUP BY 1"


@query("T6_dynamics_stream", DAYS_SQL, ("fx_records",))
def _(fx):
    """Windows of days that the watermark closes, and the rows that come too late for them."""
    return _counted_days(fx, [_arrivals(fx)])


@query("T6_restarted_stream", DAYS_SQL, ("fx_records",))
def _(fx):
    """Some days first; queries with new checkpoints then read everything."""
    rows = _arrivals(fx)
    return _counted_days(fx, [rows.where("day(timestamp) % 3 = 0"), rows])


@query(
    "T7_source_totals_stream",
    "SELECT source_id, count(*) AS records, count(CASE WHEN status = 'success' THEN 1 END) AS succeeded FROM fx_records GROUP BY 1",
    ("fx_records",),
)
def _(fx):
    table = state.StreamTable(fx.spark, _folder(fx, "totals"))
    totals = state.source_totals(_stream(fx, fx.records.select("source_id", "status"), "rows"))
    state.run(totals, lambda batch, n: table.write(batch, n, "live"), _folder(fx, "ckpt"), "update")
    return table.last(state.TOTALS, ["source_id"])


# --- readers and writers over files ------------------------------------------------


@query(
    "S2_read_jsonl",
    "SELECT row_idx::VARCHAR AS agent_id, user_query, tools_used, total_tokens, true AS is_object FROM fx_raw",
    ("fx_raw",),
)
def _(fx):
    from agentlog.sources.raw import read_raw

    raw = fx.raw.withColumn("agent_id", F.col("row_idx").cast("string")).drop("row_idx")
    rows = read_raw(fx.spark, _files(fx, raw, "jsonl", "json"), "jsonl")
    return rows.select("agent_id", "user_query", "tools_used", "total_tokens", "is_object")


@query(
    "S1_read_json_arrays",
    "SELECT row_idx::VARCHAR AS agent_id, user_query, tools_used, total_tokens, true AS is_object FROM fx_raw",
    ("fx_raw",),
)
def _(fx):
    """Files that are one JSON array each, of 5,000 records at most."""
    from agentlog.sources.raw import read_raw

    raw = fx.raw.withColumn("agent_id", F.col("row_idx").cast("string"))
    file = F.floor(F.col("row_idx") / 5000).alias("file")
    record = F.struct(*[c for c in raw.columns if c != "row_idx"])
    arrays = raw.select(file, record.alias("record")).groupBy("file").agg(
        F.to_json(F.collect_list("record")).alias("value")
    )
    path = _folder(fx, "arrays")
    arrays.write.partitionBy("file").text(path)
    rows = read_raw(fx.spark, path, "json")
    return rows.select("agent_id", "user_query", "tools_used", "total_tokens", "is_object")


@query(
    "S3_read_csv",
    f"SELECT row_idx::VARCHAR AS agent_id, user_name, {TOKENS_PLAIN} AS tokens, array_to_string({OWN}, '|') AS tools FROM fx_raw",
    ("fx_raw",),
)
def _(fx):
    from agentlog.functions.records import tools_array
    from agentlog.functions.numeric import parse_long
    from agentlog.sources.raw import read_raw

    raw = fx.raw.withColumn("agent_id", F.col("row_idx").cast("string")).drop("row_idx", "metadata")
    path = _files(fx, raw, "csv", "csv", header=True, escape='"', quote='"')
    rows = read_raw(fx.spark, path, "csv")
    tools = F.array_join(tools_array(F.col("tools_used")), "|")
    return rows.select("agent_id", "user_name", parse_long(F.col("total_tokens")).alias("tokens"), tools.alias("tools"))


@query(
    "S4_unwrap_records",
    "SELECT text AS user_query, false AS second FROM conversations UNION ALL SELECT role, true FROM conversations",
)
def _(fx):
    """Every turn as a wrapped document with two records, under one of the known keys."""
    from agentlog.sources.raw import WRAPPER_KEYS, parse_records, unwrap_records

    records = F.array(
        F.struct(F.col("text").alias("user_query"), F.lit("0").alias("agent_id")),
        F.struct(F.col("role").alias("user_query"), F.lit("1").alias("agent_id")),
    )
    pick = F.pmod("turn", F.lit(len(WRAPPER_KEYS)))
    doc = F.to_json(
        F.struct(*[F.when(pick == i, records).alias(k) for i, k in enumerate(WRAPPER_KEYS)])
    )
    rows = parse_records(unwrap_records(fx.table("conversations").select(doc.alias("value"))))
    return rows.select("user_query", (F.col("agent_id") == "1").alias("second"))


@query("S13_roi_csv")
def _(fx):
    from agentlog.operators.roi import roi_rows, roi_sheets
    from agentlog.sources.report import write_roi_csv

    path = _folder(fx, "report")
    write_roi_csv(roi_sheets(roi_rows(fx.joined)), path)
    return fx.spark.read.text(path, lineSep="\r\n").withColumnRenamed("value", "line")
