"""Log tables derived from the given test tables, as Spark views and as DuckDB CTEs.

The same SQL text serves both engines; only array columns differ and are built by hand.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from agentlog.functions.vectors import unit

_K = "CAST(regexp_extract(props, '([0-9]+)', 1) AS INT)"

RECORDS_SQL = f"""
SELECT concat('src_', CAST(user_id % 3 AS STRING)) AS source_id,
       concat('req_', CAST(event_id AS STRING)) AS request_id,
       concat(event_type, ' ', props) AS query_text,
       CASE WHEN event_id % 11 = 0 THEN NULL ELSE element END AS gold_category,
       CASE k % 6 WHEN 0 THEN 'formal' WHEN 1 THEN 'typo' WHEN 2 THEN 'voice' WHEN 3 THEN 'jargon' WHEN 4 THEN 'copypaste' END AS style,
       CASE WHEN user_id % 29 = 0 THEN NULL ELSE concat('u_', CAST(user_id AS STRING)) END AS user_id,
       concat('User ', CAST(user_id AS STRING)) AS user_name,
       CASE user_id % 9 WHEN 0 THEN 'IT' WHEN 1 THEN 'Analytics' WHEN 2 THEN 'Finance' WHEN 3 THEN 'HR' WHEN 4 THEN 'Management' WHEN 5 THEN 'Marketing' WHEN 6 THEN 'Sales' WHEN 7 THEN 'Security' END AS department,
       CASE WHEN k = 13 THEN NULL ELSE CAST(k * 700 AS BIGINT) END AS tokens,
       CASE WHEN k % 4 = 0 THEN CAST(floor(value) AS DOUBLE) END AS manual_time_minutes,
       CASE event_type WHEN 'purchase' THEN 'CRM' WHEN 'click' THEN concat('Jira,model:m', CAST(k % 4 AS STRING)) WHEN 'view' THEN concat('model:m', CAST(k % 3 AS STRING)) ELSE '' END AS tools_csv,
       CASE event_type WHEN 'error' THEN CASE WHEN k % 2 = 0 THEN 'error_tool' ELSE 'hallucination_loop' END WHEN 'signup' THEN 'completed' WHEN 'view' THEN 'SUCCESS' ELSE 'success' END AS status,
       CAST(ts AS TIMESTAMP) AS timestamp, k
FROM (SELECT e.*, {_K} AS k,
        CASE event_id % 7 WHEN 0 THEN 'text_generation' WHEN 1 THEN 'code_help' WHEN 2 THEN 'data_analysis' WHEN 3 THEN 'education' WHEN 4 THEN 'information_search' WHEN 5 THEN 'task_management' ELSE 'other' END AS element
      FROM $events e) t
"""

ASSIGNMENTS_SQL = f"""
SELECT source_id, request_id, task_type, CAST(k + 1 AS DOUBLE) / 100 AS classification_confidence,
       CASE WHEN is_outlier THEN NULL ELSE concat(task_type, ':cluster_', CAST(k % 4 AS STRING)) END AS scenario_id,
       CASE WHEN is_outlier THEN NULL ELSE concat('Scenario ', task_type, ' ', CAST(k % 4 AS STRING)) END AS scenario_name,
       is_outlier, (event_type = 'error' AND k % 3 = 0) AS has_failure_signals, CAST(ts AS TIMESTAMP) AS timestamp,
       concat(event_type, ' ', props) AS query_text, CAST(ts AS TIMESTAMP) AS created_at,
       CAST(ts AS TIMESTAMP) + INTERVAL '1' HOUR AS updated_at
FROM (SELECT concat('src_', CAST(user_id % 3 AS STRING)) AS source_id, concat('req_', CAST(event_id AS STRING)) AS request_id, event_type, ts, props,
        {_K} AS k, {_K} % 17 = 0 AS is_outlier,
        CASE (event_id * 3 + user_id) % 8 WHEN 0 THEN 'text_generation' WHEN 1 THEN 'code_help' WHEN 2 THEN 'data_analysis' WHEN 3 THEN 'education' WHEN 4 THEN 'information_search' WHEN 5 THEN 'task_management' WHEN 6 THEN 'other' ELSE 'unknown' END AS task_type
      FROM $events WHERE event_id % 10 <> 9) t
"""

CLUSTERS_SQL = """
SELECT scenario_id, min(task_type) AS task_type, min(scenario_name) AS name, CAST(NULL AS STRING) AS summary,
       CAST(count(*) AS BIGINT) AS records_count, 'high' AS statistical_reliability
FROM fx_assignments WHERE scenario_id IS NOT NULL AND scenario_id NOT LIKE '%:cluster_3' GROUP BY scenario_id
UNION ALL
SELECT 'other:cluster_9', 'other', CAST(NULL AS STRING), CAST(NULL AS STRING), CAST(count(*) AS BIGINT), 'low' FROM fx_assignments
"""

SIGNALS_SQL = """
SELECT source_id, request_id, timestamp, query_text, k,
       CASE WHEN status IN ('error_tool', 'hallucination_loop') THEN 'error' ELSE 'success' END AS response_status,
       CASE status WHEN 'error_tool' THEN 'tool_error' WHEN 'hallucination_loop' THEN 'hallucination_loop' END AS error_code,
       k % 3 - 1 AS user_feedback, k % 5 - 1 AS retry_count, k % 10 = 0 AS has_failure_signals
FROM fx_records
"""

SOURCES_SQL = """
SELECT source_id, concat('Source ', source_id) AS name,
       CASE source_id WHEN 'src_2' THEN 'live' ELSE 'upload' END AS origin,
       CASE source_id WHEN 'src_0' THEN 'ingesting' WHEN 'src_1' THEN 'recomputed' ELSE 'failed' END AS status,
       CAST(count(*) AS BIGINT) AS records_total, CAST(count(*) AS BIGINT) AS records_valid,
       CAST(0 AS BIGINT) AS records_rejected, min(timestamp) AS created_at
FROM fx_records GROUP BY source_id
"""

RUNS_SQL = """
SELECT concat('job_', CAST(k AS STRING)) AS job_id,
       CASE WHEN k % 4 = 3 THEN 'failed' ELSE 'completed' END AS status,
       CAST(count(*) AS BIGINT) AS logs_at_completion,
       CASE WHEN k % 4 = 3 THEN NULL ELSE max(timestamp) END AS completed_at
FROM fx_records GROUP BY k
"""

RAW_SQL = f"""
SELECT event_id AS row_idx,
       CASE WHEN k % 9 = 0 THEN NULL WHEN k % 9 = 1 THEN '' ELSE concat('ext_', CAST(event_id AS STRING)) END AS request_id,
       CASE k % 5 WHEN 0 THEN '' WHEN 1 THEN NULL WHEN 2 THEN '   ' ELSE concat('  ', event_type, ' ', CAST(k AS STRING), ' ') END AS user_query,
       CASE k % 7 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE concat(chr(160), 'Text  of ', event_type, chr(9), CAST(k AS STRING), chr(160)) END AS query_text,
       CASE k % 8 WHEN 0 THEN NULL WHEN 1 THEN 'not a date' WHEN 2 THEN '12:00' WHEN 3 THEN substring(CAST(ts AS STRING), 1, 10)
            WHEN 4 THEN concat(replace(substring(CAST(ts AS STRING), 1, 19), ' ', 'T'), 'Z')
            WHEN 5 THEN concat(substring(CAST(ts AS STRING), 1, 19), '+03:00') WHEN 6 THEN '2024-13-45'
            ELSE substring(CAST(ts AS STRING), 1, 19) END AS timestamp,
       CASE event_type WHEN 'error' THEN CASE WHEN k % 2 = 0 THEN 'Error_Tool' ELSE 'hallucination_loop' END WHEN 'signup' THEN NULL WHEN 'view' THEN 'SUCCESS' WHEN 'click' THEN 'failed' ELSE 'weird' END AS status,
       CASE k % 3 WHEN 0 THEN 'error_tool' WHEN 1 THEN '' END AS response_status,
       CASE WHEN k % 10 = 4 THEN 'E42' END AS error_code,
       CASE k % 6 WHEN 0 THEN NULL WHEN 1 THEN 'abc' WHEN 2 THEN '0' WHEN 3 THEN concat(CAST(k AS STRING), '.9') WHEN 4 THEN '' ELSE CAST(k * 700 AS STRING) END AS total_tokens,
       CASE k % 4 WHEN 0 THEN '1500' WHEN 1 THEN 'nan' WHEN 2 THEN '-3' END AS simulated_context_tokens,
       CASE k % 5 WHEN 0 THEN '0' WHEN 1 THEN '' WHEN 2 THEN 'bad' WHEN 3 THEN '12.5' END AS estimated_manual_time_minutes,
       CASE k % 3 WHEN 0 THEN '30' WHEN 2 THEN '0.0' END AS manual_time_minutes,
       CASE WHEN k % 2 = 0 THEN '7' END AS manual_time, '3' AS estimated_manual_time,
       CASE k % 4 WHEN 0 THEN 'gpt' WHEN 1 THEN '' WHEN 2 THEN '  ' END AS model, CASE WHEN k % 3 = 0 THEN 'mini' END AS model_name,
       CASE WHEN k % 5 = 0 THEN 'agent' END AS agent_id,
       CASE k % 6 WHEN 0 THEN 'code_help' WHEN 1 THEN 'education' WHEN 2 THEN 'other' WHEN 3 THEN 'strange' WHEN 4 THEN 'data_analysis' END AS category,
       CASE WHEN k % 7 = 2 THEN 'task_management' WHEN k % 7 = 3 THEN '' END AS gold_category,
       CASE k % 12 WHEN 0 THEN 'typoy' WHEN 1 THEN 'typò' WHEN 2 THEN 'Voice_Jargon' WHEN 3 THEN 'corporate slang' WHEN 4 THEN 'formnal'
            WHEN 5 THEN ' Formal ' WHEN 6 THEN 'error_tool' WHEN 7 THEN 'Success' WHEN 8 THEN '' WHEN 9 THEN 'poetic' WHEN 10 THEN 'typo_jargon' END AS style,
       CASE WHEN k % 4 = 0 THEN CAST(k AS STRING) WHEN k % 4 = 1 THEN 'x' WHEN k % 4 = 2 THEN '-1' END AS agent_steps,
       CASE user_id % 5 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE concat('u_', CAST(user_id AS STRING)) END AS user_id,
       concat('User ', CAST(user_id AS STRING)) AS user_name, CAST(NULL AS STRING) AS department, CAST(NULL AS STRING) AS source_id,
       CASE event_type WHEN 'purchase' THEN '["CRM","Mail"]' WHEN 'click' THEN '["Jira","model:m1"]' WHEN 'view' THEN '[]' WHEN 'signup' THEN 'CRM, Mail ,' END AS tools_used,
       CASE k % 6 WHEN 0 THEN NULL WHEN 1 THEN concat('{{"usage":{{"total_tokens":', CAST(k * 10 AS STRING), '}},"tools_used":["MetaTool"],"user_email":"m', CAST(user_id AS STRING), '@x.org"}}')
            WHEN 2 THEN '{{"gold_category":"code_help","category":"education"}}' WHEN 3 THEN '{{"category":" "}}' WHEN 4 THEN '{{"gold_category":"","category":"education","note":"n"}}' ELSE '{{}}' END AS metadata
FROM (SELECT e.*, {_K} AS k FROM $events e) t
"""

# Replies of a model, in the shapes the reply parser has to read.
REPLIES_SQL = f"""
SELECT event_id AS reply_id,
       CASE k % 9 WHEN 0 THEN '{{"task_type": "code_help", "confidence": 0.9}}'
            WHEN 1 THEN concat('```json', chr(10), '{{"task_type": "Data-Analysis", "confidence": "1.7"}}', chr(10), '```')
            WHEN 2 THEN 'I would say education here' WHEN 3 THEN 'no idea' WHEN 4 THEN ' `Task Management` '
            WHEN 5 THEN '{{"task_type": "nonsense"}}' WHEN 6 THEN '[1, 2]' WHEN 7 THEN '{{"task_type": "other", "confidence": "x"}}'
            ELSE 'Помощь с кодом' END AS reply
FROM (SELECT e.*, {_K} AS k FROM $events e) t
"""

_VIEWS = {
    "fx_records": (RECORDS_SQL, ()),
    "fx_assignments": (ASSIGNMENTS_SQL, ()),
    "fx_clusters": (CLUSTERS_SQL, ("fx_assignments",)),
    "fx_signals": (SIGNALS_SQL, ("fx_records",)),
    "fx_sources": (SOURCES_SQL, ("fx_records",)),
    "fx_runs": (RUNS_SQL, ("fx_records",)),
    "fx_raw": (RAW_SQL, ()),
    "fx_replies": (REPLIES_SQL, ()),
}

# DuckDB-only views: arrays, the joined base and the vectors.
_DUCK = {
    "rec": (
        "SELECT *, list_filter(string_split(tools_csv, ','), lambda x: x <> '') AS tools FROM fx_records",
        ("fx_records",),
    ),
    "joined": (
        """SELECT r.*, a.task_type, a.classification_confidence, a.scenario_id, a.scenario_name, a.is_outlier, a.has_failure_signals
FROM rec r LEFT JOIN fx_assignments a ON a.source_id = r.source_id AND a.request_id = r.request_id""",
        ("rec", "fx_assignments"),
    ),
    "fx_vectors": (
        """SELECT concat('vec_', v.vec_id) AS request_id, v.vec_id, v.vec_id % 12 AS proto,
 concat('T', (v.vec_id % 12) % 3) AS task_type,
 list_transform(list_zip(p.embedding, v.embedding), lambda z: CAST(z[1] AS DOUBLE) + 0.25 * CAST(z[2] AS DOUBLE)) AS embedding
FROM embeddings v JOIN embeddings p ON p.vec_id = v.vec_id % 12""",
        (),
    ),
}


def ctes(*names: str) -> str:
    """`WITH ...` clause that defines the named views for DuckDB."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for need in {**_VIEWS, **_DUCK}[name][1]:
            add(need)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        add(name)
    bodies = {n: s.replace("$events", "events") for n, (s, _) in {**_VIEWS, **_DUCK}.items()}
    return "WITH " + ",\n".join(f"{n} AS ({bodies[n].strip()})" for n in ordered)


class Fixtures:
    """The same views as DataFrames over one folder of test tables."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark = spark
        self.sf_dir = sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def _view(self, name: str) -> DataFrame:
        sql, needs = _VIEWS[name]
        for need in needs:
            self._view(need).createOrReplaceTempView(need)
        self.table("events").createOrReplaceTempView("fx_events")
        return self.spark.sql(sql.replace("$events", "fx_events"))

    @cached_property
    def records(self) -> DataFrame:
        tools = F.filter(F.split("tools_csv", ","), lambda t: t != "")
        return self._view("fx_records").withColumn("tools_used", tools)

    @cached_property
    def assignments(self) -> DataFrame:
        return self._view("fx_assignments")

    @cached_property
    def clusters(self) -> DataFrame:
        return self._view("fx_clusters")

    @cached_property
    def signals(self) -> DataFrame:
        signals = self._view("fx_signals")
        listed = F.when(F.col("k") % 4 == 0, F.array(F.lit("retry"), F.lit("slow"), F.lit("slow")))
        return signals.withColumn("failure_signals", listed)

    @cached_property
    def sources(self) -> DataFrame:
        return self._view("fx_sources")

    @cached_property
    def runs(self) -> DataFrame:
        return self._view("fx_runs")

    @cached_property
    def raw(self) -> DataFrame:
        return self._view("fx_raw")

    @cached_property
    def replies(self) -> DataFrame:
        return self._view("fx_replies")

    @cached_property
    def joined(self) -> DataFrame:
        from agentlog.operators.joins import joined

        return joined(self.records, self.assignments)

    @cached_property
    def vectors(self) -> DataFrame:
        """Vectors around twelve prototypes; the prototype number is the true group."""
        v = self.table("embeddings")
        p = v.where("vec_id < 12").select(F.col("vec_id").alias("proto"), F.col("embedding").alias("p"))
        rows = v.withColumn("proto", F.col("vec_id") % 12).join(p, "proto")
        mixed = F.zip_with("p", "embedding", lambda a, b: a.cast("double") + 0.25 * b.cast("double"))
        day = F.timestamp_add("MINUTE", F.col("vec_id").cast("int"), F.lit("2024-01-01").cast("timestamp"))
        return rows.select(
            F.concat(F.lit("vec_"), F.col("vec_id").cast("string")).alias("request_id"),
            "vec_id",
            "proto",
            F.concat(F.lit("T"), (F.col("proto") % 3).cast("string")).alias("task_type"),
            mixed.alias("embedding"),
            day.alias("timestamp"),
            F.concat(F.lit("text "), (F.col("vec_id") % 40).cast("string")).alias("query_text"),
        )

    @cached_property
    def unit_vectors(self) -> DataFrame:
        return self.vectors.withColumn("embedding", unit(F.col("embedding")))

    @cached_property
    def evaluation(self) -> DataFrame:
        """gold, predicted and confidence of every record."""
        return self.joined.select(
            "request_id",
            F.col("gold_category").alias("gold"),
            F.coalesce("task_type", F.lit("unknown")).alias("predicted"),
            F.coalesce("classification_confidence", F.lit(0.0)).alias("confidence"),
        )


EVAL_CTE = """ev AS (SELECT request_id, gold_category AS gold, coalesce(task_type, 'unknown') AS predicted,
 coalesce(classification_confidence, 0.0::DOUBLE) AS confidence FROM joined)"""
