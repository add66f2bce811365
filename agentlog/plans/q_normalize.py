"""Normalisation, intake, dialogues and scalar text functions."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import functions as F

from agentlog.config import LongTextConfig, NormalizeConfig
from agentlog.functions import records as rules, taxonomy, text as tx
from agentlog.functions.ids import canonical_request_id, cluster_number, scenario_id, technical_name
from agentlog.operators import classify, normalize as nz
from agentlog.plans.q_roi import label_sql
from agentlog.plans.q_stats import _ts, _ts_sql
from agentlog.plans.registry import query

RAW = ("fx_raw",)
_WS = r"[\s\x{00A0}]"


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


TEXT = strip_sql("coalesce(nullif(user_query, ''), nullif(query_text, ''), '')")
NUM = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def num_sql(x: str) -> str:
    return f"CASE WHEN regexp_matches(trim({x}), '{NUM}') THEN try_cast(trim({x}) AS DOUBLE) END"


def int_sql(x: str) -> str:
    return f"CAST(trunc({num_sql(x)}) AS BIGINT)"


@query("N1_query_text", f"SELECT row_idx, {TEXT} AS text FROM fx_raw", RAW)
def _(fx):
    return nz.with_query_text(fx.raw).select("row_idx", "text")


@query(
    "N2_split_rejects",
    f"SELECT row_idx, 'empty_query_text' AS reject_reason FROM fx_raw WHERE {TEXT} = ''",
    RAW,
)
def _(fx):
    return nz.split_rejects(fx.raw)[1].select("row_idx", "reject_reason")


EXT = "coalesce(nullif(request_id, ''), 'req_' || row_idx)"


@query("N3_external_id", f"SELECT row_idx, {EXT} AS external_id FROM fx_raw", RAW)
def _(fx):
    return nz.with_external_id(fx.raw).select("row_idx", "external_id")


UUID5 = f""", h AS (SELECT row_idx, sha1(unhex('{uuid.NAMESPACE_URL.hex}') || encode('agentlog:src:' || {EXT})) AS d FROM fx_raw)
SELECT row_idx, d[1:8] || '-' || d[9:12] || '-5' || d[14:16] || '-' || CASE WHEN d[17:17] IN ('0', '4', '8', 'c') THEN '8' WHEN d[17:17] IN ('1', '5', '9', 'd') THEN '9' WHEN d[17:17] IN ('2', '6', 'a', 'e') THEN 'a' ELSE 'b' END || d[18:20] || '-' || d[21:32] AS request_id FROM h"""


@query("N4_canonical_request_id", UUID5, RAW)
def _(fx):
    rows = nz.with_external_id(fx.raw)
    return rows.select("row_idx", canonical_request_id(F.col("external_id"), "src").alias("request_id"))


TS = """CASE WHEN k6 = 3 THEN strptime(timestamp, '%Y-%m-%d') WHEN k6 = 4 THEN strptime(timestamp, '%Y-%m-%dT%H:%M:%SZ')
 WHEN k6 = 5 THEN strptime(substring(timestamp, 1, 19), '%Y-%m-%d %H:%M:%S') - INTERVAL 3 HOUR WHEN k6 = 7 THEN strptime(timestamp, '%Y-%m-%d %H:%M:%S') END"""
SHAPE = """CASE WHEN regexp_matches(timestamp, '^[0-9-]{10}$') AND timestamp NOT LIKE '%-13-%' THEN 3 WHEN timestamp LIKE '%T%Z' THEN 4 WHEN timestamp LIKE '%+03:00' THEN 5 WHEN regexp_matches(timestamp, '^[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9:]{8}$') THEN 7 END AS k6"""


@query(
    "N5_timestamp_parse",
    f"SELECT row_idx, strftime({TS}, '%Y-%m-%d %H:%M:%S') AS ts FROM (SELECT *, {SHAPE} FROM fx_raw)",
    RAW,
)
def _(fx):
    ts = rules.parse_timestamp(F.col("timestamp"))
    return fx.raw.select("row_idx", F.date_format(ts, "yyyy-MM-dd HH:mm:ss").alias("ts"))


NOW = datetime(2024, 2, 1)


@query(
    "N6_timestamp_synthesis",
    "SELECT row_idx, epoch_us(TIMESTAMP '2024-02-01') - 1209600000000 + floor(1209600000000::DOUBLE * (row_idx::DOUBLE / (SELECT count(*) FROM fx_raw)::DOUBLE) + 0.5::DOUBLE)::BIGINT AS us FROM fx_raw",
    RAW,
)
def _(fx):
    total = fx.raw.agg(F.count(F.lit(1))).scalar()
    ts = rules.synthetic_timestamp(F.col("row_idx"), total, NOW, 14)
    return fx.raw.select("row_idx", F.unix_micros(ts).alias("us"))


RAW_STATUS = "coalesce(status, response_status)"


@query(
    "N7_status_map",
    f"""SELECT row_idx, coalesce({RAW_STATUS}, 'success') AS status, CASE WHEN lower({RAW_STATUS}) IN ('error_tool', 'hallucination_loop') THEN 'error' ELSE 'success' END AS response_status,
 CASE lower({RAW_STATUS}) WHEN 'error_tool' THEN 'tool_error' WHEN 'hallucination_loop' THEN 'hallucination_loop' END AS error_code FROM fx_raw""",
    RAW,
)
def _(fx):
    return nz.map_status(fx.raw).select("row_idx", "status", "response_status", "error_code")


@query(
    "N8_status_map_seed",
    """, s AS (SELECT *, lower(trim(coalesce(nullif(status, ''), nullif(response_status, '')))) AS st FROM fx_raw)
SELECT row_idx, coalesce(nullif(response_status, ''), CASE WHEN st IN ('success', 'ok') THEN 'success' WHEN st IN ('error_tool', 'hallucination_loop', 'error', 'failed') THEN 'error' ELSE st END) AS response_status,
 coalesce(error_code, CASE st WHEN 'error_tool' THEN 'tool_error' WHEN 'hallucination_loop' THEN 'hallucination_loop' END) AS error_code FROM s""",
    RAW,
)
def _(fx):
    return nz.map_status(fx.raw, variant="seed").select("row_idx", "response_status", "error_code")


TOKENS = f"coalesce({int_sql('total_tokens')}, {int_sql('simulated_context_tokens')}, {int_sql(chr(40) + 'metadata::JSON->>' + chr(39) + '$.usage.total_tokens' + chr(39) + chr(41))})"


@query("N9_tokens", f"SELECT row_idx, {TOKENS} AS tokens FROM fx_raw", RAW)
def _(fx):
    return nz.with_tokens(fx.raw).select("row_idx", "tokens")


def truthy_sql(x: str) -> str:
    return f"CASE WHEN {x} <> '' AND NOT coalesce(({num_sql(x)}) = 0, false) THEN {x} END"


MANUAL = num_sql(
    "coalesce(" + ", ".join(truthy_sql(c) for c in ("estimated_manual_time_minutes", "manual_time_minutes", "manual_time", "estimated_manual_time")) + ")"
)


@query("N10_manual_minutes", f"SELECT row_idx, {MANUAL} AS manual_minutes FROM fx_raw", RAW)
def _(fx):
    return nz.with_manual_minutes(fx.raw).select("row_idx", "manual_minutes")


OWN = """CASE WHEN tools_used LIKE '[%' THEN from_json(tools_used, '["VARCHAR"]') ELSE list_filter(list_transform(string_split(tools_used, ','), lambda x: trim(x)), lambda x: x <> '') END"""
TOOLS = f""", t0 AS (SELECT row_idx, model, model_name, agent_id, {OWN} AS own, from_json(metadata::JSON->'$.tools_used', '["VARCHAR"]') AS meta FROM fx_raw),
 t1 AS (SELECT row_idx, CASE WHEN len(own) > 0 THEN own ELSE coalesce(meta, []) END AS tools, trim(coalesce(nullif(model, ''), nullif(model_name, ''), nullif(agent_id, ''))) AS m FROM t0),
 t2 AS (SELECT row_idx, tools, CASE WHEN m <> '' AND len(list_filter(tools, lambda x: starts_with(x, 'model:'))) = 0 THEN list_append(tools, 'model:' || m) ELSE tools END AS tagged FROM t1)
"""


@query("N11_tools", TOOLS + "SELECT row_idx, array_to_string(tools, '|') AS tools FROM t2", RAW)
def _(fx):
    tools = rules.tools_of(F.col("tools_used"), F.col("metadata"))
    return fx.raw.select("row_idx", F.array_join(tools, "|").alias("tools"))


@query("N12_model_tag", TOOLS + "SELECT row_idx, array_to_string(tagged, '|') AS tools FROM t2", RAW)
def _(fx):
    return nz.with_tools(fx.raw).select("row_idx", F.array_join("tools", "|").alias("tools"))


STYLE = """CASE WHEN lower(trim(style)) IN ('', 'success', 'error', 'error_tool', 'hallucination_loop') THEN NULL ELSE CASE lower(trim(style)) WHEN 'typoy' THEN 'typo' WHEN 'typò' THEN 'typo'
 WHEN 'typo_jargon' THEN 'typo' WHEN 'voice_jargon' THEN 'voice' WHEN 'corporate slang' THEN 'jargon' WHEN 'corporate_slang' THEN 'jargon' WHEN 'formnal' THEN 'formal' ELSE lower(trim(style)) END END"""


@query("N13_style", f"SELECT row_idx, {STYLE} AS style FROM fx_raw", RAW)
def _(fx):
    return fx.raw.select("row_idx", rules.normalize_style(F.col("style")).alias("style"))


USER = "coalesce(nullif(user_id, ''), metadata::JSON->>'$.user_email')"


@query("N14_user", f"SELECT row_idx, {USER} AS uid FROM fx_raw", RAW)
def _(fx):
    return nz.with_user(fx.raw).select("row_idx", "uid")


@query(
    "N15_normalize",
    TOOLS + f"""SELECT {EXT} AS request_id, {TEXT} AS query_text, category AS gold_category, {STYLE} AS style, {USER} AS user_id, {TOKENS} AS tokens, {MANUAL} AS manual_time_minutes,
 array_to_string(t2.tagged, '|') AS tools_used, coalesce({RAW_STATUS}, 'success') AS status FROM fx_raw JOIN t2 USING (row_idx) WHERE {TEXT} <> ''""",
    RAW,
)
def _(fx):
    out = nz.normalize(fx.raw, NormalizeConfig()).records
    return out.drop("user_name", "department", "timestamp").withColumn("tools_used", F.array_join("tools_used", "|"))


@query(
    "N16_normalization_report",
    f"""SELECT count(*) AS records_total, count(CASE WHEN {TEXT} <> '' THEN 1 END) AS records_valid, count(CASE WHEN {TEXT} = '' THEN 1 END) AS records_rejected, count(CASE WHEN {TEXT} <> '' THEN 1 END) AS synthesized_request_id,
 count(CASE WHEN {TEXT} <> '' THEN 1 END) AS synthesized_timestamp, count(CASE WHEN {TEXT} <> '' AND coalesce(request_id, '') = '' THEN 1 END) AS true_synthesized_request_id,
 count(CASE WHEN {TEXT} <> '' AND {TS} IS NULL THEN 1 END) AS true_synthesized_timestamp, count(CASE WHEN {TEXT} = '' THEN 1 END) AS empty_query_text FROM (SELECT *, {SHAPE} FROM fx_raw)""",
    RAW,
)
def _(fx):
    report = nz.normalize(fx.raw).report
    return report.withColumn("empty_query_text", F.try_element_at("rejected_reasons", F.lit("empty_query_text"))).drop("rejected_reasons")


# Every third record is sent twice; some are already stored; some have blank text or time.
BATCH = """, bt AS (SELECT CASE WHEN k % 41 = 0 THEN '' ELSE request_id END AS request_id, source_id, CASE WHEN k % 23 = 0 THEN '  ' ELSE query_text END AS query_text,
 CASE WHEN k % 19 = 0 THEN 'bad' ELSE strftime(timestamp, '%Y-%m-%d %H:%M:%S') END AS timestamp, k, 1 AS arrival FROM fx_records),
 bb AS (SELECT * FROM bt UNION ALL SELECT * REPLACE (2 AS arrival) FROM bt WHERE k % 3 = 0),
 gd AS (SELECT *, regexp_replace(query_text, ' ', '', 'g') <> '' AND timestamp <> 'bad' AS good FROM bb),
 acc AS (SELECT DISTINCT source_id, request_id FROM gd WHERE good AND request_id <> '' AND request_id NOT IN (SELECT request_id FROM fx_assignments))
"""


def _batch(fx):
    k = F.col("k")
    rows = fx.records.select(
        F.when(k % 41 == 0, F.lit("")).otherwise(F.col("request_id")).alias("request_id"), "source_id",
        F.when(k % 23 == 0, F.lit("  ")).otherwise(F.col("query_text")).alias("query_text"),
        F.when(k % 19 == 0, F.lit("bad")).otherwise(F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss")).alias("timestamp"),
        "k", F.lit(1).alias("arrival"),
    )
    return rows.unionByName(rows.where("k % 3 = 0").withColumn("arrival", F.lit(2)))


IN = ("fx_records", "fx_assignments")


@query("N17_intake", BATCH + "SELECT source_id, request_id FROM acc", IN)
def _(fx):
    return nz.intake(_batch(fx), fx.assignments)[0].select("source_id", "request_id")


@query(
    "A18_intake_totals",
    BATCH + "SELECT source_id, (SELECT count(*) FROM acc WHERE acc.source_id = gd.source_id) AS accepted, count(CASE WHEN NOT good THEN 1 END) AS rejected, count(CASE WHEN good THEN 1 END) - (SELECT count(*) FROM acc WHERE acc.source_id = gd.source_id) AS duplicates FROM gd GROUP BY source_id",
    IN,
)
def _(fx):
    return nz.intake(_batch(fx), fx.assignments)[1]


@query(
    "N18_rebuild_logs",
    f"""SELECT request_id, {_ts_sql()}, CASE WHEN status IN ('error_tool', 'hallucination_loop') THEN 'error' ELSE 'success' END AS response_status,
 CASE status WHEN 'error_tool' THEN 'tool_error' WHEN 'hallucination_loop' THEN 'hallucination_loop' END AS error_code, tokens FROM fx_records""",
    ("fx_records",),
)
def _(fx):
    return nz.rebuild_logs(fx.records).select("request_id", _ts(), "response_status", "error_code", "metadata.tokens")


@query("N20_with_source", "SELECT request_id, 'src_x' AS source_id FROM fx_records", ("fx_records",))
def _(fx):
    return nz.with_source(fx.records, "src_x").select("request_id", "source_id")


@query(
    "N21_failure_signals",
    """, s AS (SELECT request_id, list_filter([CASE WHEN response_status = 'error' THEN 'response_status:error' END, CASE WHEN error_code <> '' THEN 'error_code:' || error_code END,
 CASE WHEN user_feedback < 0 THEN 'user_feedback:negative' END, CASE WHEN retry_count > 0 THEN 'retry_count:' || retry_count END], lambda x: x IS NOT NULL) AS sg FROM fx_signals)
SELECT request_id, array_to_string(sg, '|') AS signals, len(sg) > 0 AS has_failure_signals FROM s""",
    ("fx_signals",),
)
def _(fx):
    out = nz.with_failure_signals(fx.signals)
    return out.select("request_id", F.array_join("failure_signals", "|").alias("signals"), "has_failure_signals")


SEED_TEXT = strip_sql("coalesce(nullif(user_query, ''), nullif(query_text, ''), '')")


@query(
    "N22_seed_record",
    f"""SELECT {EXT} AS request_id, {SEED_TEXT} AS query_text, 'seed' AS source_id,
 strftime(coalesce({TS}, TIMESTAMP '2024-01-01' + INTERVAL (row_idx * 5) HOUR), '%Y-%m-%d %H:%M:%S') AS timestamp,
 coalesce(nullif(category, ''), nullif(gold_category, ''), metadata::JSON->>'$.gold_category') AS gold, metadata::JSON->>'$.note' AS note,
 simulated_context_tokens AS tokens FROM (SELECT *, {SHAPE} FROM fx_raw) WHERE {SEED_TEXT} <> ''""",
    RAW,
)
def _(fx):
    out = nz.seed_record(fx.raw, "2024-01-01 00:00:00", "seed")

    def meta(key):
        return F.try_element_at("metadata", F.lit(key))

    return out.select(
        "request_id", "query_text", "source_id", _ts(), meta("gold_category").alias("gold"), meta("note").alias("note"),
        meta("simulated_context_tokens").alias("tokens"),
    )


@query(
    "S6_conversations_to_logs",
    """, q AS (SELECT conv_id, coalesce(arg_max(text, turn) FILTER (role = 'user'), '') AS query_text, coalesce(arg_max(text, turn) FILTER (role = 'assistant'), '') AS response_text FROM conversations GROUP BY 1)
SELECT *, 'success' AS status, greatest(100, (length(query_text) + length(response_text)) // 4)::BIGINT AS total_tokens FROM q""".replace(", q AS", "WITH q AS", 1),
)
def _(fx):
    return nz.conversations_to_logs(fx.table("conversations"))


# --- scalar functions -------------------------------------------------------------


@query("X1_labels", f"SELECT request_id, {label_sql('gold_category')} AS label FROM fx_records", ("fx_records",))
def _(fx):
    return fx.records.select("request_id", taxonomy.label(F.col("gold_category")).alias("label"))


_CORE = ", ".join(f"'{t}'" for t in taxonomy.CORE_TYPES)
_KEY = r"replace(replace(lower(regexp_replace(trim(reply), '^[`\"'']+|[`\"'']+$', '', 'g')), ' ', '_'), '-', '_')"
_BY_LABEL = " ".join(f"WHEN '{v.lower()}' THEN '{k}'" for k, v in taxonomy.TASK_LABELS.items() if k != "unknown")
NORM = f"""CASE WHEN {_KEY} IN ({_CORE}) THEN {_KEY} WHEN lower(trim(reply)) IN ({', '.join("'" + v.lower() + "'" for k, v in taxonomy.TASK_LABELS.items() if k != 'unknown')}) THEN CASE lower(trim(reply)) {_BY_LABEL} END
 WHEN regexp_extract({_KEY}, '^\\s*(\\S+)', 1) IN ({_CORE}) THEN regexp_extract({_KEY}, '^\\s*(\\S+)', 1) END"""


@query("X2_normalize_label", f"SELECT reply_id, {NORM} AS task_type FROM fx_replies", ("fx_replies",))
def _(fx):
    return fx.replies.select("reply_id", taxonomy.normalize_label(F.col("reply")).alias("task_type"))


@query(
    "X3_is_valid",
    f"SELECT row_idx, coalesce(category IN ({_CORE}, 'unknown'), false) AS valid FROM fx_raw",
    RAW,
)
def _(fx):
    return fx.raw.select("row_idx", taxonomy.is_valid(F.col("category")).alias("valid"))


SQUASH = strip_sql(f"regexp_replace(text, '{_WS}+', ' ', 'g')")


@query("X4_squash", f"SELECT doc_id, {SQUASH} AS text FROM documents")
def _(fx):
    return fx.table("documents").select("doc_id", tx.squash(F.col("text")).alias("text"))


W = f"WITH w AS (SELECT doc_id, {SQUASH} AS t, CASE WHEN {SQUASH} = '' THEN [] ELSE string_split({SQUASH}, ' ') END AS w FROM documents)"


@query("X5_token_estimate", f"{W} SELECT doc_id, len(w) AS tokens FROM w")
def _(fx):
    return fx.table("documents").select("doc_id", tx.token_estimate(F.col("text")).alias("tokens"))


def chunks_sql(size: int, step: int) -> str:
    return f"list_transform(range(0, 1 + CAST(ceil(greatest(len(w) - {size}, 0) / {float(step)}::DOUBLE) AS BIGINT)), lambda i: array_to_string(w[i * {step} + 1 : i * {step} + {size}], ' '))"


@query(
    "X6_word_chunks",
    f"{W}, c AS (SELECT doc_id, unnest({chunks_sql(64, 56)}) AS chunk, unnest(range(0, 1 + CAST(ceil(greatest(len(w) - 64, 0) / 56.0::DOUBLE) AS BIGINT))) AS pos FROM w WHERE len(w) > 0) SELECT doc_id, pos, chunk FROM c",
)
def _(fx):
    chunks = tx.word_chunks(F.col("text"), 64, 8)
    out = fx.table("documents").select("doc_id", F.posexplode(chunks).alias("pos", "chunk"))
    return out.withColumn("pos", F.col("pos").cast("bigint"))


SMALL = LongTextConfig(max_direct=200, chunk=64, overlap=8, max_chunks=8, head_words=40)


@query(
    "X7_long_text",
    f"""{W}, c AS (SELECT doc_id, w, {strip_sql('text')} AS clean, {chunks_sql(64, 56)} AS ch FROM w JOIN documents USING (doc_id)),
 p AS (SELECT *, CASE WHEN len(ch) <= 8 THEN ch ELSE list_concat(ch[1:7], ch[-1:]) END AS picked FROM c)
SELECT doc_id, CASE WHEN len(w) <= 200 THEN clean ELSE array_to_string(list_transform(picked, lambda x: array_to_string(string_split(x, ' ')[1:40], ' ')), ' [...] ') END AS representation,
 CASE WHEN len(w) <= 200 THEN 'direct' ELSE 'chunk_summary' END AS strategy, CASE WHEN len(w) <= 200 THEN 0 ELSE len(ch) END AS chunks_processed, len(w) AS original_tokens FROM p""",
)
def _(fx):
    lt = tx.long_text(F.col("text"), SMALL)
    return fx.table("documents").select("doc_id", lt.alias("t")).select("doc_id", "t.*")


@query("X11_fingerprint", f"SELECT doc_id, sha256({strip_sql('text')}) AS fp FROM documents")
def _(fx):
    return fx.table("documents").select("doc_id", tx.fingerprint(F.col("text")).alias("fp"))


@query(
    "X12_extract_json",
    """SELECT reply_id, CASE WHEN reply LIKE '```%' THEN regexp_extract(reply, '(\\{.*\\})', 1) WHEN reply LIKE '{%' OR reply LIKE '[%' THEN reply END AS json FROM fx_replies""",
    ("fx_replies",),
)
def _(fx):
    return fx.replies.select("reply_id", tx.extract_json(F.col("reply")).alias("json"))


@query(
    "X13_parse_reply",
    """SELECT reply_id, CASE k WHEN 0 THEN 'code_help' WHEN 1 THEN 'data_analysis' WHEN 2 THEN 'education' WHEN 4 THEN 'task_management' WHEN 8 THEN 'code_help' ELSE 'other' END AS task_type,
 CASE k WHEN 0 THEN 0.9::DOUBLE WHEN 1 THEN 1.0::DOUBLE WHEN 2 THEN 0.55::DOUBLE WHEN 4 THEN 0.55::DOUBLE WHEN 7 THEN 0.55::DOUBLE WHEN 8 THEN 0.55::DOUBLE ELSE 0.4::DOUBLE END AS confidence
FROM (SELECT event_id AS reply_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) % 9 AS k FROM events)""",
)
def _(fx):
    return fx.replies.select("reply_id", classify.parse_reply(F.col("reply")).alias("r")).select("reply_id", "r.*")


@query(
    "X14_scenario_ids",
    """SELECT scenario_id, CAST(regexp_extract(scenario_id, '([0-9]+)$', 1) AS BIGINT) AS n, task_type || ':cluster_' || regexp_extract(scenario_id, '([0-9]+)$', 1) AS made,
 'Сценарий ' || task_type || ' ' || regexp_extract(scenario_id, '([0-9]+)$', 1) AS name FROM fx_clusters""",
    ("fx_clusters",),
)
def _(fx):
    n = cluster_number(F.col("scenario_id"))
    return fx.clusters.select(
        "scenario_id", n.alias("n"), scenario_id(F.col("task_type"), n).alias("made"),
        technical_name(F.col("task_type"), n).alias("name"),
    )


@query(
    "X15_money_text",
    """SELECT o_orderkey, CASE WHEN abs(o_totalprice) >= 1e6 THEN printf('%.1f млн ₽', o_totalprice / 1e6) WHEN abs(o_totalprice) >= 1e3 THEN printf('%.0f тыс ₽', o_totalprice / 1e3) ELSE printf('%.0f ₽', o_totalprice) END AS text FROM orders""",
)
def _(fx):
    from agentlog.functions.numeric import money_text

    orders = fx.table("orders")
    return orders.select("o_orderkey", money_text(F.col("o_totalprice")).alias("text"))


@query("X16_message_text", "SELECT conv_id, turn, text || ' tail' AS text FROM conversations")
def _(fx):
    part = F.to_json(F.array(
        F.struct(F.lit("text").alias("type"), F.col("text").alias("text")),
        F.struct(F.lit("image").alias("type"), F.lit("x").alias("text")),
        F.struct(F.lit("text").alias("type"), F.lit("tail").alias("text")),
    ))
    turns = fx.table("conversations").withColumn("content", part)
    return turns.select("conv_id", "turn", tx.message_text(F.col("content")).alias("text"))


@query(
    "X17_summaries",
    """, s AS (SELECT scenario_id, CASE WHEN records_count % 5 = 0 THEN '  ' WHEN records_count % 2 = 0 THEN coalesce(name, 'x') || ' has  many words ' ELSE ' ' || coalesce(name, 'x') || ' ' END AS name,
  CASE records_count % 4 WHEN 0 THEN ' HIGH ' WHEN 1 THEN 'huge' WHEN 2 THEN 'medium' END AS ap FROM fx_clusters),
 t AS (SELECT *, string_split(regexp_replace(trim(name), '\\s+', ' ', 'g'), ' ') AS w FROM s WHERE trim(name) <> '')
SELECT scenario_id, CASE WHEN len(w) > 4 THEN array_to_string(w[1:4], ' ') ELSE trim(name) END AS name, CASE WHEN lower(trim(ap)) IN ('low', 'medium', 'high') THEN lower(trim(ap)) ELSE 'low' END AS automation_potential FROM t""",
    ("fx_clusters",),
)
def _(fx):
    from agentlog.operators.scenarios import sanitize_summaries
    from agentlog.operators.stats import scenario_examples

    n, name = F.col("records_count"), F.coalesce("name", F.lit("x"))
    summaries = fx.clusters.select(
        "scenario_id",
        F.when(n % 5 == 0, F.lit("  ")).when(n % 2 == 0, F.concat(name, F.lit(" has  many words "))).otherwise(F.concat(F.lit(" "), name, F.lit(" "))).alias("name"),
        F.when(n % 4 == 0, F.lit(" HIGH ")).when(n % 4 == 1, F.lit("huge")).when(n % 4 == 2, F.lit("medium")).alias("automation_potential"),
        F.array().cast("array<string>").alias("examples"),
    )
    clean = sanitize_summaries(summaries, scenario_examples(fx.assignments))
    return clean.select("scenario_id", "name", "automation_potential")
