"""Classifier evaluation and contract checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from agentlog.functions.numeric import parse_double, percent, round_to, safe_div
from agentlog.functions.taxonomy import CORE_TYPES, UNKNOWN
from agentlog.functions.text import strip


def gold_label(df: DataFrame) -> DataFrame:
    """Gold class from metadata or the flat fields, blank means none (Q1)."""
    def either(first: Column, second: Column) -> Column:
        # An empty second value stays: it then means "no gold", not "look further".
        return F.coalesce(F.nullif(first, F.lit("")), second)

    meta = either(
        F.get_json_object("metadata", "$.gold_category"), F.get_json_object("metadata", "$.category")
    )
    flat = either(F.col("gold_category"), F.col("category"))
    return df.withColumn("gold", F.nullif(strip(F.coalesce(meta, flat)), F.lit("")))


def confusion(df: DataFrame) -> DataFrame:
    """Rows per (gold, predicted) pair with gold (Q3)."""
    return (
        df.where(F.col("gold").isNotNull())
        .groupBy("gold", "predicted")
        .agg(F.count(F.lit(1)).alias("count"))
    )


def per_class_metrics(df: DataFrame, labels: Sequence[str] = CORE_TYPES) -> DataFrame:
    """Precision, recall, F1 and support of every class (Q3).

    Each cell of the confusion table counts for its row class and its column class, so
    one pass over that small table gives all sums.
    """
    hit = F.col("gold") == F.col("predicted")
    sides = F.explode(
        F.array(
            F.struct(F.col("gold").alias("task_type"), F.col("count").alias("g"), F.lit(0).cast("bigint").alias("p"),
                     F.when(hit, F.col("count")).otherwise(F.lit(0)).alias("tp")),
            F.struct(F.col("predicted").alias("task_type"), F.lit(0).cast("bigint").alias("g"),
                     F.col("count").alias("p"), F.lit(0).cast("bigint").alias("tp")),
        )
    )
    sums = (
        confusion(df).select(sides.alias("s")).groupBy("s.task_type")
        .agg(F.sum("s.g").alias("support"), F.sum("s.p").alias("predicted"), F.sum("s.tp").alias("tp"))
    )
    wanted = df.sparkSession.createDataFrame([(t,) for t in labels], "task_type string")
    zero = F.lit(0)
    full = wanted.join(sums, "task_type", "left").select(
        "task_type", *[F.coalesce(c, zero).alias(c) for c in ("support", "predicted", "tp")]
    )
    none = F.lit(0.0)
    f1 = F.coalesce(safe_div(F.col("tp") * 2, F.col("support") + F.col("predicted")), none)
    return full.select(
        "task_type",
        "support",
        F.coalesce(safe_div(F.col("tp"), F.col("predicted")), none).alias("precision"),
        F.coalesce(safe_div(F.col("tp"), F.col("support")), none).alias("recall"),
        f1.alias("f1"),
    )


def classification_metrics(df: DataFrame, labels: Sequence[str] = CORE_TYPES) -> DataFrame:
    """Accuracy, macro-F1 over classes with support, unknown rate over all rows (Q2)."""
    macro = per_class_metrics(df, labels).where("support > 0").agg(
        (F.sum(F.col("f1").cast("decimal(20,12)")).cast("double") / F.nullif(F.count(F.lit(1)), F.lit(0)))
    ).scalar()
    gold = F.col("gold").isNotNull()
    hits = F.count_if(F.coalesce(gold & (F.col("gold") == F.col("predicted")), F.lit(False)))
    unknown = F.count_if(F.coalesce(F.col("predicted") == UNKNOWN, F.lit(False)))
    zero = F.lit(0.0)
    sums = df.agg(
        F.count(F.lit(1)).alias("n"), F.count("gold").alias("n_with_gold"), hits.alias("h"), unknown.alias("u")
    )
    return sums.select(
        "n",
        "n_with_gold",
        F.coalesce(round_to(safe_div(F.col("h"), F.col("n_with_gold")), 6), zero).alias("accuracy"),
        F.coalesce(round_to(macro, 6), zero).alias("macro_f1"),
        F.coalesce(round_to(safe_div(F.col("u"), F.col("n")), 6), zero).alias("unknown_rate"),
    )


def threshold_sweep(df: DataFrame, thresholds: Sequence[float] = (0.30, 0.50, 0.60)) -> DataFrame:
    """Unknown share and accuracy at several thresholds, in one pass over the rows (Q4).

    Counts per (confidence, hit) come first; only they are repeated per threshold.
    """
    hit = F.coalesce(F.col("gold") == F.col("predicted"), F.lit(False))
    gold = F.col("gold").isNotNull()
    per_level = df.groupBy("confidence").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.coalesce(F.col("predicted") == UNKNOWN, F.lit(False))).alias("u"),
        F.count_if(gold).alias("g"),
        F.count_if(gold & ~F.coalesce(F.col("predicted") == UNKNOWN, F.lit(False))).alias("gk"),
        F.count_if(hit).alias("h"),
    )
    rows = per_level.select(
        "*", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold")
    )
    kept = F.col("confidence") >= F.col("threshold")
    none = F.lit(0)
    sums = rows.groupBy("threshold").agg(
        F.sum("n").alias("n"),
        F.sum(F.when(kept, F.col("u")).otherwise(F.col("n"))).alias("unknown"),
        F.sum("g").alias("g"),
        F.sum(F.when(kept, F.col("gk")).otherwise(none)).alias("known"),
        F.sum(F.when(kept, F.col("h")).otherwise(none)).alias("correct"),
    )
    return sums.select(
        "threshold",
        F.col("unknown").alias("unknown_count"),
        percent(F.col("unknown"), F.col("n")).alias("unknown_percent"),
        F.coalesce(round_to(safe_div(F.col("correct"), F.col("g")), 6), F.lit(0.0)).alias("accuracy"),
        round_to(safe_div(F.col("correct"), F.col("known")), 6).alias("accuracy_known"),
    )


def confidence_report(df: DataFrame) -> DataFrame:
    """Min, mean and max confidence and the unknown count (Q5)."""
    total = F.sum(F.col("confidence").cast("decimal(18,8)")).cast("double")
    return df.agg(
        F.min("confidence").alias("min_confidence"),
        round_to(total / F.nullif(F.count("confidence"), F.lit(0)), 6).alias("mean_confidence"),
        F.max("confidence").alias("max_confidence"),
        F.count_if(F.coalesce(F.col("predicted") == UNKNOWN, F.lit(False))).alias("unknown_count"),
    )


def prediction_distribution(df: DataFrame) -> DataFrame:
    return df.groupBy("predicted").agg(F.count(F.lit(1)).alias("count"))


def top_confusions(df: DataFrame, k: int = 4) -> DataFrame:
    """The k most frequent predictions per gold class, ties by name (Q5)."""
    w = Window.partitionBy("gold").orderBy(F.desc("count"), "predicted")
    return confusion(df).withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= k)


# --- contracts --------------------------------------------------------------------


def _violations(df: DataFrame, key: str, checks: dict[str, Column]) -> DataFrame:
    found = F.array_compact(
        F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in checks.items()])
    )
    return df.select(F.col(key), F.explode(found).alias("violation"))


def _negative(c: str) -> Column:
    text = F.col(c)
    return text.isNotNull() & F.coalesce(parse_double(text) < 0, F.lit(True))


def upload_violations(raw: DataFrame, key: str = "row_idx") -> DataFrame:
    """Breaches of the upload contract, one row each (Q6)."""
    return _violations(
        raw,
        key,
        {
            "query_missing": F.col("user_query").isNull() & F.col("query_text").isNull(),
            "user_query_empty": F.col("user_query") == "",
            "query_text_empty": F.col("query_text") == "",
            "request_id_empty": F.col("request_id") == "",
            "status_unknown": ~F.col("status").isin("success", "error_tool", "hallucination_loop"),
            "category_unknown": ~F.col("category").isin(*CORE_TYPES),
            "tokens_invalid": _negative("simulated_context_tokens"),
            "manual_minutes_invalid": _negative("estimated_manual_time_minutes"),
            "agent_steps_invalid": _negative("agent_steps"),
        },
    )


def log_violations(logs: DataFrame, key: str = "request_id") -> DataFrame:
    """Breaches of the log contract, one row each (Q7)."""
    latency = F.col("response_latency_ms") if "response_latency_ms" in logs.columns else F.lit(None)
    return _violations(
        logs,
        key,
        {
            "request_id_missing": F.coalesce("request_id", F.lit("")) == "",
            "query_text_missing": F.coalesce("query_text", F.lit("")) == "",
            "timestamp_missing": F.col("timestamp").isNull(),
            "feedback_out_of_range": ~F.col("user_feedback").between(-1, 1),
            "latency_negative": latency < 0,
            "retry_negative": F.col("retry_count") < 0,
        },
    )


_TRENDS = ("up", "down", "stable", "new", "insufficient_data")
_SECTIONS = {
    "totals": ("records_total",),
    "tasks_distribution": ("task_type", "count"),
    "top_scenarios": ("scenario_id", "count", "trend"),
    "dynamics": ("date", "count"),
}


def statistics_violations(bundle: dict[str, DataFrame]) -> DataFrame:
    """Breaches of the statistics contract: sections, columns, enums, counts (Q8)."""
    spark = next(iter(bundle.values())).sparkSession
    missing = [("section", s) for s in _SECTIONS if s not in bundle]
    missing += [
        (s, c) for s, cols in _SECTIONS.items() if s in bundle for c in cols if c not in bundle[s].columns
    ]
    out = spark.createDataFrame([(s, f"missing:{c}") for s, c in missing], "section string, violation string")
    for name, df in bundle.items():
        checks = {f"negative:{c}": F.col(c) < 0 for c in ("count", "records_total") if c in df.columns}
        if "trend" in df.columns:
            checks["trend_unknown"] = ~F.col("trend").isin(*_TRENDS)
        if "statistical_reliability" in df.columns:
            checks["reliability_unknown"] = ~F.col("statistical_reliability").isin("high", "low")
        if checks:
            out = out.unionByName(
                _violations(df.withColumn("section", F.lit(name)), "section", checks)
            )
    return out
