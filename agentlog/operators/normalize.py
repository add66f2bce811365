"""Raw records to the canonical log: projections, rejects, intake gate, report."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from agentlog.config import NormalizeConfig
from agentlog.functions import records as rules
from agentlog.functions.ids import URL_NAMESPACE, canonical_request_id
from agentlog.functions.numeric import parse_long
from agentlog.functions.taxonomy import literal_map
from agentlog.functions.text import first_filled, strip
from agentlog.operators.keyed import first_per, not_stored


@dataclass(frozen=True)
class Normalized:
    records: DataFrame
    logs: DataFrame
    report: DataFrame
    rejected: DataFrame


def with_query_text(raw: DataFrame) -> DataFrame:
    """Chosen and stripped text; empty when there is none."""
    text = strip(F.coalesce(first_filled(F.col("user_query"), F.col("query_text")), F.lit("")))
    return raw.withColumn("text", text)


def with_reject_reason(raw: DataFrame) -> DataFrame:
    """Null for a valid row, else why it is left out."""
    is_object = F.col("is_object") if "is_object" in raw.columns else F.lit(True)
    reason = F.when(~is_object, F.lit("not_an_object")).when(
        F.col("text") == "", F.lit("empty_query_text")
    )
    return raw.withColumn("reject_reason", reason)


def split_rejects(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid rows, and rejected rows with their reason."""
    marked = with_reject_reason(with_query_text(raw))
    valid = marked.where(F.col("reject_reason").isNull()).drop("reject_reason")
    return valid, marked.where(F.col("reject_reason").isNotNull())


def with_external_id(raw: DataFrame, prefix: str = "req_") -> DataFrame:
    """Own id or prefix + row index; the index counts rejected rows too."""
    made = F.concat(F.lit(prefix), F.col("row_idx").cast("string"))
    return raw.withColumn("external_id", F.coalesce(F.nullif(F.col("request_id"), F.lit("")), made))


def with_timestamp(
    raw: DataFrame, cfg: NormalizeConfig, total: Column | None = None, now: Column | None = None
) -> DataFrame:
    """Parsed time, else a synthetic one in [now - span, now), else now."""
    if now is None:
        now = F.lit(cfg.now.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp")
    if cfg.synthesize and total is not None:
        spare = rules.synthetic_timestamp(F.col("row_idx"), total, cfg.now, cfg.span_days)
    else:
        spare = now
    parsed = rules.parse_timestamp(F.nullif(F.col("timestamp"), F.lit("")))
    return raw.withColumn("ts", F.coalesce(parsed, spare)).withColumn("ts_synthetic", parsed.isNull())


def map_status(raw: DataFrame, variant: str = "upload") -> DataFrame:
    """response_status, error_code and the status text to store."""
    status = F.coalesce("status", "response_status")
    if variant == "seed":
        code = F.col("error_code") if "error_code" in raw.columns else F.lit(None)
        chosen = first_filled(F.col("status"), F.col("response_status"))
        pair = rules.seed_status_pair(chosen)
        return raw.withColumn("__pair", pair).select(
            *[c for c in raw.columns if c not in ("response_status", "error_code")],
            F.coalesce(F.nullif(F.col("response_status"), F.lit("")), F.col("__pair.response_status")).alias("response_status"),
            F.coalesce(code, F.col("__pair.error_code")).alias("error_code"),
        )
    stored = F.coalesce(status, F.lit("success"))
    return raw.withColumn("stored_status", stored).withColumn("__pair", rules.status_pair(stored)).select(
        *[c for c in raw.columns if c not in ("response_status", "error_code", "status")],
        F.col("stored_status").alias("status"),
        F.col("__pair.response_status").alias("response_status"),
        F.col("__pair.error_code").alias("error_code"),
    )


def with_tokens(raw: DataFrame) -> DataFrame:
    return raw.withColumn(
        "tokens",
        rules.tokens_of(F.col("total_tokens"), F.col("simulated_context_tokens"), F.col("metadata")),
    )


def with_manual_minutes(raw: DataFrame) -> DataFrame:
    aliases = (
        "estimated_manual_time_minutes", "manual_time_minutes", "manual_time", "estimated_manual_time",
    )
    return raw.withColumn("manual_minutes", rules.manual_minutes_of(*[F.col(c) for c in aliases]))


def with_tools(raw: DataFrame) -> DataFrame:
    """Tools with their metadata fallback and the model tag."""
    tools = rules.tools_of(F.col("tools_used"), F.col("metadata"))
    models = [F.col(c) for c in ("model", "model_name", "agent_id")]
    return raw.withColumn("tools", rules.with_model_tag(tools, *models))


def with_user(raw: DataFrame) -> DataFrame:
    """User id with the metadata e-mail as fallback."""
    mail = F.get_json_object("metadata", "$.user_email")
    return raw.withColumn("uid", F.coalesce(F.nullif(F.col("user_id"), F.lit("")), mail))


def with_source(df: DataFrame, source_id: str) -> DataFrame:
    """Stamp the source on every record."""
    return df.withColumn("source_id", F.lit(source_id))


def canonical_rows(
    raw: DataFrame, cfg: NormalizeConfig, total: Column | None, now: Column | None = None
) -> DataFrame:
    """All normalised columns of every raw row, rejected ones included, in one projection."""
    out = with_reject_reason(with_query_text(raw))
    out = with_timestamp(with_external_id(out, cfg.id_prefix), cfg, total, now)
    out = with_user(with_tools(with_manual_minutes(with_tokens(map_status(out)))))
    rid = canonical_request_id(F.col("external_id"), cfg.namespace, cfg.name_prefix)
    return out.select(
        "reject_reason",
        "external_id",
        rid.alias("request_id"),
        F.nullif(F.col("request_id"), F.lit("")).isNull().alias("id_synthetic"),
        F.col("text").alias("query_text"),
        F.col("category").alias("gold_category"),
        rules.normalize_style(F.col("style")).alias("style"),
        F.col("uid").alias("user_id"),
        "user_name",
        "department",
        "tokens",
        F.col("manual_minutes").alias("manual_time_minutes"),
        F.col("tools").alias("tools_used"),
        "status",
        "response_status",
        "error_code",
        parse_long(F.col("agent_steps")).alias("agent_steps"),
        F.col("ts").alias("timestamp"),
        "ts_synthetic",
    )


RECORD_COLUMNS = (
    "request_id", "query_text", "gold_category", "style", "user_id", "user_name", "department",
    "tokens", "manual_time_minutes", "tools_used", "status", "timestamp",
)


def normalize(raw: DataFrame, cfg: NormalizeConfig = NormalizeConfig()) -> Normalized:
    """Records to store, log records to classify, rejects and the report.

    `raw` carries `row_idx`; only the row count is needed from outside a row, so the whole
    normalisation is one projection without a shuffle.
    """
    total = raw.agg(F.count(F.lit(1))).scalar()
    rows = canonical_rows(raw, cfg, total)
    valid = rows.where(F.col("reject_reason").isNull())
    return Normalized(
        records=valid.select(*RECORD_COLUMNS),
        logs=_log_records(valid),
        report=normalization_report(rows, cfg),
        rejected=rows.where(F.col("reject_reason").isNotNull()).select("external_id", "reject_reason"),
    )


def _log_records(valid: DataFrame) -> DataFrame:
    meta = F.struct(
        "gold_category", "style", "user_id", "user_name", "department", "tokens", "tools_used",
        "manual_time_minutes", "agent_steps", F.col("external_id").alias("external_request_id"),
    )
    return valid.select(
        "request_id", "query_text", "timestamp", "response_status", "error_code", meta.alias("metadata")
    )


def normalization_report(rows: DataFrame, cfg: NormalizeConfig = NormalizeConfig()) -> DataFrame:
    """Counts of a normalisation.

    `synthesized_request_id` and `synthesized_timestamp` follow the established report,
    where they equal the valid count; the true counts stand beside them.
    """
    ok = F.col("reject_reason").isNull()
    reasons = ("not_an_object", "empty_query_text")
    found = F.create_map(
        *[x for r in reasons for x in (F.lit(r), F.count_if(F.coalesce(F.col("reject_reason") == r, F.lit(False))))]
    )
    return rows.agg(
        F.count(F.lit(1)).alias("records_total"),
        F.count_if(ok).alias("records_valid"),
        F.count_if(~ok).alias("records_rejected"),
        F.count_if(ok).alias("synthesized_request_id"),
        (F.count_if(ok) if cfg.synthesize else F.lit(0).cast("bigint")).alias("synthesized_timestamp"),
        F.count_if(ok & F.col("id_synthetic")).alias("true_synthesized_request_id"),
        F.count_if(ok & F.col("ts_synthetic")).alias("true_synthesized_timestamp"),
        F.map_filter(found, lambda k, v: v > 0).alias("rejected_reasons"),
    )


def rebuild_logs(records: DataFrame) -> DataFrame:
    """Log records of stored rows, to send the rest of a source again."""
    pair = rules.exact_status_pair(F.col("status"))
    meta = F.struct(
        "gold_category", "style", "user_id", "user_name", "department", "tokens",
        F.coalesce("tools_used", F.array().cast("array<string>")).alias("tools_used"), "manual_time_minutes",
    )
    return records.withColumn("__pair", pair).select(
        "source_id", "request_id", "query_text", "timestamp",
        F.col("__pair.response_status").alias("response_status"),
        F.col("__pair.error_code").alias("error_code"),
        meta.alias("metadata"),
    )


def with_failure_signals(logs: DataFrame) -> DataFrame:
    """Prefixed failure signals and their flag."""
    signals = rules.failure_signals(
        F.col("response_status"), F.col("error_code"), F.col("user_feedback"), F.col("retry_count")
    )
    return logs.withColumn("failure_signals", signals).withColumn(
        "has_failure_signals", F.size("failure_signals") > 0
    )


def seed_record(raw: DataFrame, base_ts: str, source_id: str) -> DataFrame:
    """Seed variant of a log record: five hours between rows, merged metadata."""
    text = strip(F.coalesce(first_filled(F.col("user_query"), F.col("query_text")), F.lit("")))
    made_ts = F.timestamp_add("HOUR", (F.col("row_idx") * 5).cast("int"), F.lit(base_ts).cast("timestamp"))
    gold = first_filled(F.col("category"), F.col("gold_category"))
    own = {
        "gold_category": gold,
        "style": F.col("style"),
        "agent_steps": F.col("agent_steps"),
        "tools_used": F.col("tools_used"),
        "simulated_context_tokens": F.col("simulated_context_tokens"),
        "estimated_manual_time_minutes": F.col("estimated_manual_time_minutes"),
    }
    added = F.map_filter(
        F.create_map(*[x for k, v in own.items() for x in (F.lit(k), v)]), lambda k, v: v.isNotNull()
    )
    given = F.coalesce(
        F.from_json("metadata", "map<string,string>"), F.create_map().cast("map<string,string>")
    )
    kept = F.map_filter(given, lambda k, v: ~F.array_contains(F.map_keys(added), k))
    mapped = map_status(raw.withColumn("meta", F.map_concat(kept, added)), variant="seed")
    return mapped.where(text != "").select(
        F.coalesce(F.nullif(F.col("request_id"), F.lit("")), F.concat(F.lit("req_"), F.col("row_idx").cast("string"))).alias("request_id"),
        text.alias("query_text"),
        F.coalesce(rules.parse_timestamp(F.nullif(F.col("timestamp"), F.lit(""))), made_ts).alias("timestamp"),
        F.coalesce(F.nullif(F.col("source_id"), F.lit("")), F.lit(source_id)).alias("source_id"),
        "response_status",
        "error_code",
        F.col("meta").alias("metadata"),
    )


# --- intake -----------------------------------------------------------------------


def intake(
    batch: DataFrame, existing: DataFrame, order: Sequence[str] = ("arrival",)
) -> tuple[DataFrame, DataFrame]:
    """Accepted rows and (source_id, accepted, rejected, duplicates) counts.

    `batch` has text timestamps. Blank text or a bad time rejects a row; a blank id, a
    repeat in the batch or a stored id makes it a duplicate. Repeats fold in an aggregate,
    so one much repeated id stays spread out.
    """
    good = (strip(F.coalesce("query_text", F.lit(""))) != "") & rules.parse_timestamp(
        strip(F.col("timestamp"))
    ).isNotNull()
    marked = batch.withColumn("__good", F.coalesce(good, F.lit(False)))
    named = marked.where(F.col("__good") & (F.coalesce("request_id", F.lit("")) != "")).drop("__good")
    accepted = not_stored(first_per(named, ["request_id"], order), existing, ["request_id"])
    seen = marked.groupBy("source_id").agg(
        F.count_if("__good").alias("good"), F.count_if(~F.col("__good")).alias("rejected")
    )
    taken = accepted.groupBy("source_id").agg(F.count(F.lit(1)).alias("accepted"))
    # Null-safe: records without a source are counted as well.
    both = seen.join(
        taken.withColumnRenamed("source_id", "__sid"), F.col("source_id").eqNullSafe(F.col("__sid")), "left"
    )
    n = F.coalesce("accepted", F.lit(0))
    counts = both.select(
        "source_id", n.alias("accepted"), "rejected", (F.col("good") - n).alias("duplicates")
    )
    return accepted, counts


# --- routing and dialogues --------------------------------------------------------


@dataclass(frozen=True)
class Workspace:
    key: str
    name: str
    categories: tuple[str, ...]


# --- fixed values ----------------------------------------------------------------
WORKSPACES = (
    Workspace("knowledge-communications", "Knowledge & Communications", ("text_generation", "education", "information_search")),
    Workspace("engineering-data", "Engineering & Data", ("code_help", "data_analysis")),
    Workspace("operations-planning", "Operations & Planning", ("task_management", "other")),
)
# ---------------------------------------------------------------------------------


def workspace_source_id(key: str, namespace: uuid.UUID) -> str:
    return str(uuid.uuid5(namespace, key))


def route_workspaces(
    df: DataFrame,
    spec: Sequence[Workspace] = WORKSPACES,
    namespace: uuid.UUID = uuid.uuid5(URL_NAMESPACE, "agentlog:workspaces:v1"),
    category: str = "category",
) -> DataFrame:
    """Rows with the workspace of their category; others drop out."""
    keys = literal_map({c: w.key for w in spec for c in w.categories})
    names = literal_map({w.key: w.name for w in spec})
    sources = literal_map({w.key: workspace_source_id(w.key, namespace) for w in spec})
    routed = df.withColumn("workspace", F.try_element_at(keys, F.col(category))).where(
        F.col("workspace").isNotNull()
    )
    return routed.withColumn("workspace_name", F.try_element_at(names, F.col("workspace"))).withColumn(
        "source_id", F.try_element_at(sources, F.col("workspace"))
    )


def conversations_to_logs(turns: DataFrame, usage: str | None = None) -> DataFrame:
    """One log per dialogue: last user text, last assistant text, token estimate."""

    def last(role: str) -> Column:
        own = F.when(F.col("role") == role, F.col("text"))
        at = F.when(F.col("role") == role, F.col("turn"))
        return F.coalesce(F.max_by(own, at), F.lit(""))

    counted = F.max(F.col(usage)) if usage else F.lit(None).cast("bigint")
    logs = turns.groupBy("conv_id").agg(
        last("user").alias("query_text"), last("assistant").alias("response_text"), counted.alias("used")
    )
    chars = F.length("query_text") + F.length("response_text")
    guess = F.greatest(F.lit(100), F.floor(chars / 4)).cast("bigint")
    return logs.select(
        "conv_id",
        "query_text",
        "response_text",
        F.lit("success").alias("status"),
        F.coalesce(F.nullif(F.col("used"), F.lit(0)), guess).alias("total_tokens"),
    )
