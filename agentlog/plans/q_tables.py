"""Table maintenance: scans, appends, upserts, counters, sources, set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from agentlog.operators import joins, keyed, normalize
from agentlog.plans.q_stats import _ts, _ts_sql
from agentlog.plans.registry import query

A = ("fx_assignments",)
KEYS = ["source_id", "request_id"]
NOW = "2024-03-01 00:00:00"
# A batch of updates: every third row again, once with the next class, once with another.
UPDATES = """, ord AS (SELECT *, CAST(replace(request_id, 'req_', '') AS BIGINT) AS n FROM fx_assignments),
 up AS (SELECT source_id, CASE WHEN n % 9 = 0 THEN 'new_' || request_id ELSE request_id END AS request_id, 'code_help' AS task_type, 0.5::DOUBLE AS classification_confidence, timestamp, 1 AS seq FROM ord WHERE n % 3 = 0
  UNION ALL SELECT source_id, CASE WHEN n % 9 = 0 THEN 'new_' || request_id ELSE request_id END, 'education', 0.7::DOUBLE, timestamp, 2 FROM ord WHERE n % 6 = 0)
"""


def _updates(fx):
    n = F.replace("request_id", F.lit("req_"), F.lit("")).cast("bigint")
    rows = fx.assignments.select("source_id", "request_id", "timestamp", n.alias("n"))
    rid = F.when(F.col("n") % 9 == 0, F.concat(F.lit("new_"), "request_id")).otherwise(F.col("request_id"))
    rows = rows.withColumn("request_id", rid)

    def part(step, kind, score, seq):
        return rows.where(F.col("n") % step == 0).select(
            "source_id", "request_id", F.lit(kind).alias("task_type"), F.lit(score).alias("classification_confidence"),
            "timestamp", F.lit(seq).alias("seq"),
        )

    return part(3, "code_help", 0.5, 1).unionByName(part(6, "education", 0.7, 2))


@query("S5_scan_tables", "SELECT request_id, task_type, is_outlier FROM fx_assignments", A)
def _(fx):
    """Through the table store: written once, read back with a column subset."""
    import uuid

    from agentlog.session import shared_folder
    from agentlog.sources.tables import Tables

    store = Tables(fx.spark, f"{shared_folder(fx.spark)}/tables-{uuid.uuid4()}")
    store.replace("assignments", fx.assignments.withColumn("failure_signals", F.array().cast("array<string>")))
    return store.assignments().select("request_id", "task_type", "is_outlier")


@query(
    "S7_append_new",
    UPDATES + "SELECT source_id, request_id, task_type FROM up WHERE (source_id, request_id) NOT IN (SELECT (source_id, request_id) FROM fx_assignments) QUALIFY row_number() OVER (PARTITION BY source_id, request_id ORDER BY seq) = 1",
    A,
)
def _(fx):
    return keyed.append_new(_updates(fx), fx.assignments, KEYS, ["seq"]).select("source_id", "request_id", "task_type")


@query(
    "S8_upsert",
    UPDATES + f""", l AS (SELECT * FROM up QUALIFY row_number() OVER (PARTITION BY source_id, request_id ORDER BY seq DESC) = 1)
SELECT a.source_id, a.request_id, a.task_type, a.classification_confidence, {_ts_sql('a.created_at', 'created_at')}, {_ts_sql('a.updated_at', 'updated_at')} FROM fx_assignments a ANTI JOIN l USING (source_id, request_id)
UNION ALL SELECT l.source_id, l.request_id, l.task_type, l.classification_confidence, coalesce(strftime(a.created_at, '%Y-%m-%d %H:%M:%S'), '{NOW}'), '{NOW}' FROM l LEFT JOIN fx_assignments a USING (source_id, request_id)""",
    A,
)
def _(fx):
    out = keyed.upsert(fx.assignments, _updates(fx), KEYS, ["seq"], F.lit(NOW))
    return out.select(
        "source_id", "request_id", "task_type", "classification_confidence", _ts("created_at"), _ts("updated_at")
    )


@query(
    "U3_dedup_keys",
    UPDATES + "SELECT source_id, request_id, task_type FROM up QUALIFY row_number() OVER (PARTITION BY source_id, request_id ORDER BY seq DESC) = 1",
    A,
)
def _(fx):
    return keyed.dedup_keys(_updates(fx), KEYS, ["seq"]).select("source_id", "request_id", "task_type")


@query(
    "U2_dedup_texts",
    "SELECT query_text, request_id FROM fx_assignments QUALIFY row_number() OVER (PARTITION BY query_text ORDER BY timestamp, request_id) = 1",
    A,
)
def _(fx):
    rows = fx.assignments.select("query_text", "timestamp", "request_id")
    return keyed.dedup_texts(rows).select("query_text", "request_id")


CHANGE = ", ch AS (SELECT request_id, 'moved:cluster_1' AS scenario_id, n % 2 = 0 AS is_outlier FROM (SELECT *, CAST(replace(request_id, 'req_', '') AS BIGINT) AS n FROM fx_assignments) WHERE n % 4 = 0)"


@query(
    "S9_update_scenarios",
    CHANGE + f"""SELECT a.request_id, CASE WHEN ch.request_id IS NOT NULL THEN ch.scenario_id ELSE a.scenario_id END AS scenario_id,
 CASE WHEN ch.request_id IS NOT NULL THEN ch.is_outlier ELSE a.is_outlier END AS is_outlier, CASE WHEN ch.request_id IS NOT NULL THEN '{NOW}' ELSE strftime(a.updated_at, '%Y-%m-%d %H:%M:%S') END AS updated_at
FROM fx_assignments a LEFT JOIN ch USING (request_id)""",
    A,
)
def _(fx):
    n = F.replace("request_id", F.lit("req_"), F.lit("")).cast("bigint")
    change = fx.assignments.withColumn("n", n).where("n % 4 = 0").select(
        "source_id", "request_id", F.lit("moved:cluster_1").alias("scenario_id"), (F.col("n") % 2 == 0).alias("is_outlier"), "n"
    )
    out = keyed.update_scenarios(fx.assignments, change, F.lit(NOW), ["n"])
    return out.select("request_id", "scenario_id", "is_outlier", _ts("updated_at"))


@query(
    "S9_last_update_wins",
    """, n AS (SELECT request_id, CAST(replace(request_id, 'req_', '') AS BIGINT) AS n FROM fx_assignments),
u AS (SELECT request_id, n, step FROM n, (VALUES (0), (1), (2)) s(step)),
l AS (SELECT request_id, max_by(CASE step WHEN 0 THEN 'moved:cluster_9' WHEN 1 THEN 'moved:cluster_10' END, step) AS sid, max_by(step = 2, step) AS gone, count(*) AS k FROM u WHERE step <= n % 3 GROUP BY 1)
SELECT request_id, CASE n % 3 WHEN 0 THEN 'moved:cluster_9' WHEN 1 THEN 'moved:cluster_10' END AS scenario_id, gone AS is_outlier FROM l JOIN n USING (request_id)""",
    A,
)
def _(fx):
    """One to three updates of every key; a last update without a scenario makes an outlier."""
    n = F.replace("request_id", F.lit("req_"), F.lit("")).cast("bigint")
    step = F.explode(F.sequence(F.lit(0), (n % 3).cast("int")))
    change = fx.assignments.select("source_id", "request_id", step.alias("step")).select(
        "source_id", "request_id", "step",
        F.when(F.col("step") == 0, "moved:cluster_9").when(F.col("step") == 1, "moved:cluster_10").alias("scenario_id"),
        (F.col("step") == 2).alias("is_outlier"),
    )
    out = keyed.update_scenarios(fx.assignments, change, F.lit(NOW), order=["step"])
    return out.select("request_id", "scenario_id", "is_outlier")


@query(
    "S10_merge_counters",
    """, d AS (SELECT CASE WHEN k % 50 = 0 THEN '' ELSE source_id END AS source_id, k FROM fx_records)
SELECT coalesce(nullif(source_id, ''), '_unknown') AS source_id, sum(k + 1)::BIGINT AS accepted, count(*) AS classified, sum(k % 2)::BIGINT AS assigned, sum(k % 3)::BIGINT AS rejected, 0::BIGINT AS duplicates FROM d GROUP BY 1""",
    ("fx_records",),
)
def _(fx):
    k = F.col("k")
    sid = F.when(k % 50 == 0, F.lit("")).otherwise(F.col("source_id"))
    both = fx.records.select(
        sid.alias("source_id"), (k + 1).alias("accepted"), F.lit(1).alias("classified"), (k % 2).alias("assigned"),
        (k % 3).alias("rejected"), F.lit(0).alias("duplicates"), k,
    )
    return keyed.merge_counters(both.where("k < 40"), both.where("k >= 40"))


ROUTE = "CASE WHEN gold_category IN ('text_generation', 'education', 'information_search') THEN 'knowledge-communications' WHEN gold_category IN ('code_help', 'data_analysis') THEN 'engineering-data' WHEN gold_category IN ('task_management', 'other') THEN 'operations-planning' END"


@query(
    "S11_route_workspaces",
    f"SELECT {ROUTE} AS workspace, count(*) AS n FROM fx_records WHERE {ROUTE} IS NOT NULL GROUP BY 1",
    ("fx_records",),
)
def _(fx):
    routed = normalize.route_workspaces(fx.records, category="gold_category")
    return routed.groupBy("workspace").agg(F.count(F.lit(1)).alias("n"))


DEL = "SELECT request_id FROM fx_assignments WHERE is_outlier"


@query("S15_delete_keys", f"SELECT request_id FROM fx_assignments WHERE request_id NOT IN ({DEL})", A)
def _(fx):
    return keyed.delete_keys(fx.assignments, fx.assignments.where("is_outlier")).select("request_id")


@query("F8_lookup", f"SELECT request_id, status FROM fx_records WHERE request_id IN ({DEL})", ("fx_records", "fx_assignments"))
def _(fx):
    return keyed.lookup(fx.records, fx.assignments.where("is_outlier")).select("request_id", "status")


@query(
    "J5_unassigned",
    "SELECT request_id FROM fx_records ANTI JOIN fx_assignments USING (source_id, request_id)",
    ("fx_records", "fx_assignments"),
)
def _(fx):
    return joins.unassigned(fx.records, fx.assignments).select("request_id")


@query(
    "N19_resume_tail",
    "SELECT source_id, count(*) AS missing FROM fx_records ANTI JOIN fx_assignments USING (source_id, request_id) GROUP BY 1",
    ("fx_records", "fx_assignments"),
)
def _(fx):
    tail = joins.unassigned(fx.records, fx.assignments)
    return tail.groupBy("source_id").agg(F.count(F.lit(1)).alias("missing"))


@query(
    "S17_source_updates",
    """, d AS (SELECT source_id, count(*) AS n, count(CASE WHEN k % 2 = 0 THEN 1 END) AS v, count(CASE WHEN k % 2 = 1 THEN 1 END) AS j FROM fx_records WHERE source_id <> 'src_1' GROUP BY 1),
 w AS (SELECT DISTINCT style AS name FROM fx_records WHERE style IN ('formal', 'typo'))
SELECT s.source_id, name, records_total + coalesce(d.n, 0) AS records_total, records_valid + coalesce(d.v, 0) AS records_valid, records_rejected + coalesce(d.j, 0) AS records_rejected, 'recomputed' AS status FROM fx_sources s LEFT JOIN d USING (source_id)
UNION ALL SELECT 'live_' || name, name, 0, 0, 0, 'recomputed' FROM w""",
    ("fx_sources",),
)
def _(fx):
    delta = fx.records.where("source_id <> 'src_1'").select(
        "source_id", F.lit(1).alias("records_total"), (F.col("k") % 2 == 0).cast("int").alias("records_valid"),
        (F.col("k") % 2).alias("records_rejected"),
    )
    wanted = fx.records.where("style IN ('formal', 'typo')").select(
        F.concat(F.lit("live_"), "style").alias("source_id"), F.col("style").alias("name")
    )
    out = keyed.add_source_counts(fx.sources, delta)
    out = keyed.ensure_live_sources(out, wanted, F.lit(NOW))
    out = keyed.mark_recomputed(keyed.resume_sources(out, out.where("status = 'failed'")))
    return out.select("source_id", "name", "records_total", "records_valid", "records_rejected", "status")


@query(
    "U4_replace_clusters",
    """, nw AS (SELECT 'code_help:cluster_n' || k AS scenario_id, 'code_help' AS task_type FROM fx_records GROUP BY k)
SELECT scenario_id, task_type FROM fx_clusters WHERE task_type <> 'code_help' UNION ALL SELECT scenario_id, task_type FROM nw""",
    ("fx_clusters", "fx_records"),
)
def _(fx):
    new = fx.records.select(
        F.concat(F.lit("code_help:cluster_n"), F.col("k").cast("string")).alias("scenario_id"), F.lit("code_help").alias("task_type")
    ).distinct()
    return keyed.replace_clusters(fx.clusters, new).select("scenario_id", "task_type")


@query(
    "T8_changed_since",
    "SELECT request_id FROM fx_assignments WHERE updated_at > TIMESTAMP '2024-01-20 12:00:00'",
    A,
)
def _(fx):
    return keyed.changed_since(fx.assignments, "2024-01-20 12:00:00").select("request_id")


@query(
    "Q9_duplicate_keys",
    UPDATES + "SELECT source_id, request_id, count(*) AS copies FROM up GROUP BY ALL HAVING count(*) > 1",
    A,
)
def _(fx):
    return keyed.duplicate_keys(_updates(fx))
