"""Statistics read-model: totals, distributions, dynamics, trends, failures, progress.

Most figures derive from one small roll-up of the assignments (class × scenario × outlier
flag), so the big table is scanned once for all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from agentlog.config import AggConfig
from agentlog.functions.numeric import percent, round_to, safe_div
from agentlog.functions.records import FAILED_RESPONSES
from agentlog.functions.taxonomy import OTHER, UNKNOWN, filled, label
from agentlog.functions.text import strip
from agentlog.operators.joins import share
from agentlog.session import cut_lineage


def _is_outlier() -> Column:
    return F.coalesce(F.col("is_outlier"), F.lit(False))


_ROLLED = {"task_type", "scenario_id", "is_outlier", "n", "failures", "min_ts", "max_ts", "stamps"}


def rollup(assignments: DataFrame) -> DataFrame:
    """Counts and time bounds per class, scenario and outlier flag.

    A table that is such a roll-up already is returned as it is, so every figure below
    takes either the assignments or a stored roll-up.
    """
    if _ROLLED == set(assignments.columns):
        return assignments
    failing = F.coalesce(F.col("has_failure_signals"), F.lit(False))
    return assignments.groupBy(
        filled(F.col("task_type"), UNKNOWN).alias("task_type"),
        filled(F.col("scenario_id"), "").alias("scenario_id"),
        _is_outlier().alias("is_outlier"),
    ).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(failing).alias("failures"),
        F.min("timestamp").alias("min_ts"),
        F.max("timestamp").alias("max_ts"),
        F.count("timestamp").alias("stamps"),
    )


def stored_rollup(assignments: DataFrame) -> DataFrame:
    """The roll-up, computed once and kept: what follows reads only its few rows.

    Without it every use in a query could scan the assignments again, and the optimizer
    would move scenario joins below the aggregate, onto all rows.
    """
    return assignments if _ROLLED == set(assignments.columns) else cut_lineage(rollup(assignments))


def _scenario_counts(roll: DataFrame) -> DataFrame:
    kept = roll.where(~F.col("is_outlier") & (F.col("scenario_id") != ""))
    return kept.groupBy("scenario_id").agg(F.sum("n").alias("count"))


def known_scenario_counts(assignments: DataFrame, clusters: DataFrame) -> DataFrame:
    """Counts of scenarios that have a cluster row."""
    return _scenario_counts(stored_rollup(assignments)).join(
        clusters.select("scenario_id"), "scenario_id", "left_semi"
    )


def totals(assignments: DataFrame, clusters: DataFrame) -> DataFrame:
    """Records, scenarios, unknowns and outlier share in one row (A1)."""
    roll = stored_rollup(assignments)
    scenarios = known_scenario_counts(roll, clusters).agg(F.count(F.lit(1))).scalar()
    zero = F.lit(0).cast("bigint")
    sums = roll.agg(
        F.coalesce(F.sum("n"), zero).alias("records_total"),
        F.coalesce(F.sum(F.when(F.col("task_type") == UNKNOWN, F.col("n"))), zero).alias("unknown_count"),
        F.coalesce(F.sum(F.when(F.col("is_outlier"), F.col("n"))), zero).alias("outliers"),
    )
    return sums.select(
        "records_total",
        scenarios.alias("scenarios_count"),
        "unknown_count",
        percent(F.col("outliers"), F.col("records_total"), 4).alias("outliers_percentage"),
    )


def outliers(assignments: DataFrame) -> DataFrame:
    """Outlier count and share (A5)."""
    sums = rollup(assignments).agg(
        F.coalesce(F.sum(F.when(F.col("is_outlier"), F.col("n"))), F.lit(0)).alias("outliers"), F.sum("n").alias("total")
    )
    return sums.select(
        F.col("outliers").alias("total_outliers_count"),
        percent(F.col("outliers"), F.col("total"), 4).alias("outlier_percentage"),
    )


def topn_other(
    counts: DataFrame, key: str, n: int, other: str = OTHER, protected: tuple[str, ...] = (UNKNOWN,)
) -> DataFrame:
    """The n largest keys, the rest summed up as `other`, protected keys listed last.

    The head is a distributed top-n and the rest an anti join with those n keys, so no
    window ever orders all keys. `counts` is used several times and should be stored or
    derive from a stored roll-up. Position comes as `rank`.
    """
    live = counts.where(F.col("count") > 0)
    guard = F.col(key).isin(*protected) if protected else F.lit(False)
    free = live.where(~guard)
    head = free.orderBy(F.desc("count"), key).limit(n)
    by_size = Window.orderBy(F.desc("count"), key)  # at most n rows
    ranked = head.withColumn("rank", F.row_number().over(by_size).cast("bigint"))
    rest = (
        free.join(head.select(key), key, "left_anti")
        .agg(F.sum("count").alias("count"))
        .where("count > 0")
        .select(F.lit(other).alias(key), "count", F.lit(n + 1).cast("bigint").alias("rank"))
    )
    merged = ranked.unionByName(rest).groupBy(key).agg(
        F.sum("count").alias("count"), F.min("rank").alias("rank")
    )
    kept = live.where(guard)
    kept = kept.withColumn(
        "rank", F.row_number().over(by_size).cast("bigint") + F.lit(n + 1)
    )  # one row per protected name
    return merged.unionByName(kept)


def task_distribution(assignments: DataFrame, n: int = AggConfig.top_tasks) -> DataFrame:
    """Records per class, top n (A2)."""
    counts = stored_rollup(assignments).groupBy("task_type").agg(F.sum("n").alias("count"))
    return topn_other(counts, "task_type", n)


def with_share(df: DataFrame, total: Column | None = None) -> DataFrame:
    """Label and percent share of each class row."""
    out = df.withColumn("label", label(F.col("task_type")))
    if total is None:
        return share(out, "count")
    return out.withColumn("percentage", percent(F.col("count"), total))


def top_scenarios(
    assignments: DataFrame, clusters: DataFrame, trends: DataFrame, n: int = AggConfig.top_scenarios
) -> DataFrame:
    """The n largest known scenarios with their description and trend, plus Other (A3)."""
    counts = known_scenario_counts(assignments, clusters)
    # A scenario that is itself called `other` belongs to the rest, not to the head.
    own = F.col("scenario_id") == OTHER
    head = topn_other(counts.where(~own), "scenario_id", n, protected=())
    extra = counts.where(own).withColumn("rank", F.lit(n + 1).cast("bigint"))
    rows = head.unionByName(extra).groupBy("scenario_id").agg(
        F.sum("count").alias("count"), F.min("rank").alias("rank")
    )
    meta = _cluster_meta(clusters)
    out = rows.join(meta, "scenario_id", "left").join(trends, "scenario_id", "left")
    bucket = F.col("scenario_id") == OTHER
    for c in (*META_COLUMNS, "trend", "growth_rate_percent"):
        empty = F.lit("Other") if c == "name" else F.lit(None)
        out = out.withColumn(c, F.when(bucket, empty).otherwise(F.col(c)))
    return out


META_COLUMNS = (
    "task_type", "name", "summary", "user_goal", "pain_points", "automation_potential",
    "statistical_reliability",
)


def _cluster_meta(clusters: DataFrame) -> DataFrame:
    cols = [
        F.col(c) if c in clusters.columns else F.lit(None).cast("string").alias(c)
        for c in META_COLUMNS
    ]
    return clusters.select("scenario_id", *cols)


def dynamics(assignments: DataFrame) -> DataFrame:
    """Records per day (A4)."""
    return (
        assignments.where(F.col("timestamp").isNotNull())
        .groupBy(F.date_format("timestamp", "yyyy-MM-dd").alias("date"))
        .agg(F.count(F.lit(1)).alias("count"))
    )


# --- failures ---------------------------------------------------------------------


def _col(df: DataFrame, name: str, kind: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def with_bare_signals(df: DataFrame) -> DataFrame:
    """Adds `signals` (bare codes) and `has_quality_field` to every record."""
    status = F.lower(_col(df, "response_status", "string"))
    code = strip(_col(df, "error_code", "string"))
    feedback = _col(df, "user_feedback", "int").try_cast("int")
    retries = _col(df, "retry_count", "int").try_cast("int")
    listed = F.coalesce(
        _col(df, "failure_signals", "array<string>"), F.array().cast("array<string>")
    )
    flag = F.coalesce(_col(df, "has_failure_signals", "boolean"), F.lit(False))

    own = F.array_compact(
        F.array(
            F.when(status.isin(*FAILED_RESPONSES), F.concat(F.lit("response_status:"), status)),
            F.when(code != "", code),
            F.when(feedback < 0, F.lit("user_feedback:negative")),
            F.when(retries > 0, F.lit("retry")),
        )
    )
    more = F.filter(
        F.array_distinct(listed), lambda s: (s != "") & ~F.array_contains(own, s)
    )
    signals = F.concat(own, more)
    generic = F.array(F.lit("failure"))
    present = (
        _col(df, "response_status", "string").isNotNull()
        | _col(df, "error_code", "string").isNotNull()
        | _col(df, "user_feedback", "int").isNotNull()
        | _col(df, "retry_count", "int").isNotNull()
        | (F.size(listed) > 0)
        | flag
    )
    return df.withColumn(
        "signals", F.when(flag & (F.size(signals) == 0), generic).otherwise(signals)
    ).withColumn("has_quality_field", present)


def failure_summary(df: DataFrame) -> DataFrame:
    """Whether failures can be judged at all, how many requests failed, and their share."""
    marked = with_bare_signals(df).agg(
        F.coalesce(F.bool_or("has_quality_field"), F.lit(False)).alias("known"),
        F.count_if(F.size("signals") > 0).alias("failing"),
        F.count(F.lit(1)).alias("total"),
    )
    known = F.col("known")
    return marked.select(
        F.when(known, F.lit("available")).otherwise(F.lit("not_available")).alias("status"),
        F.when(known, F.col("failing")).alias("total_requests_with_failure_signals"),
        F.when(known, percent(F.col("failing"), F.col("total"), 2)).alias("failure_signal_percentage"),
    )


def failure_top_signals(df: DataFrame, n: int = AggConfig.top_signals) -> DataFrame:
    """The n most frequent signals, ties by name."""
    return (
        with_bare_signals(df)
        .select(F.explode("signals").alias("signal"))
        .groupBy("signal")
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.desc("count"), "signal")
        .limit(n)
    )


def dashboard_success_rate(summary: DataFrame) -> DataFrame:
    """Success rate as the dashboard shows it: what is left of 100."""
    return summary.select(
        F.greatest(F.lit(0.0), 100.0 - F.coalesce("failure_signal_percentage", F.lit(0.0))).alias(
            "success_rate"
        )
    )


# --- trends -----------------------------------------------------------------------


def half_period(assignments: DataFrame) -> DataFrame:
    """First, middle and last moment of the data; all null below two stamps."""
    if _ROLLED == set(assignments.columns):
        bounds = assignments.agg(
            F.min("min_ts").alias("lo"), F.max("max_ts").alias("hi"), F.sum("stamps").alias("n")
        )
    else:
        bounds = assignments.agg(
            F.min("timestamp").alias("lo"), F.max("timestamp").alias("hi"), F.count("timestamp").alias("n")
        )
    enough = F.col("n") >= 2
    lo, hi = F.unix_micros("lo"), F.unix_micros("hi")
    mid = F.timestamp_micros(lo + F.floor((hi - lo) / 2).cast("bigint"))
    return bounds.select(
        F.when(enough, F.col("lo")).alias("start"),
        F.when(enough, mid).alias("mid"),
        F.when(enough, F.col("hi")).alias("end"),
    )


def trend_of(previous: Column, current: Column, cfg: AggConfig = AggConfig()) -> Column:
    """Struct(trend, growth_rate_percent) of two half-period counts."""
    growth = (current - previous).cast("double") / F.nullif(previous.cast("double"), F.lit(0.0)) * 100.0
    unsure = (previous + current < cfg.trend_min_total) | (previous < cfg.trend_min_previous)
    trend = (
        F.when((previous == 0) & (current > 0), F.lit("new"))
        .when((previous == 0) | unsure, F.lit("insufficient_data"))
        .when(growth > cfg.trend_threshold, F.lit("up"))
        .when(growth < -cfg.trend_threshold, F.lit("down"))
        .otherwise(F.lit("stable"))
    )
    rate = F.when((previous > 0) & ~unsure, round_to(growth, 2))
    return F.struct(trend.alias("trend"), rate.alias("growth_rate_percent"))


def scenario_trends(
    assignments: DataFrame, cfg: AggConfig = AggConfig(), roll: DataFrame | None = None
) -> DataFrame:
    """Trend of every scenario between the halves of the whole period.

    A roll-up of the same rows, if at hand, gives the middle of the period without a scan.
    """
    mid = half_period(assignments if roll is None else roll).select("mid").scalar()
    dated = (
        assignments.where(~_is_outlier())
        .withColumn("mid", mid)
        .where(F.col("mid").isNull() | F.col("timestamp").isNotNull())
    )
    halves = dated.groupBy(filled(F.col("scenario_id"), UNKNOWN).alias("scenario_id")).agg(
        F.count_if(F.col("timestamp") <= F.col("mid")).alias("previous"),
        F.count_if(F.col("timestamp") > F.col("mid")).alias("current"),
    )
    out = halves.withColumn("t", trend_of(F.col("previous"), F.col("current"), cfg))
    return out.select("scenario_id", "t.trend", "t.growth_rate_percent")


# --- scenario lists ---------------------------------------------------------------


def scenario_examples(assignments: DataFrame, k: int = AggConfig.examples) -> DataFrame:
    """First k texts of each scenario in time order (A10).

    `row_number <= k` lets Spark cut every partition to k rows per scenario before the
    shuffle, so large scenarios stay spread out.
    """
    texts = assignments.where(
        ~_is_outlier() & (filled(F.col("scenario_id"), "") != "") & (filled(F.col("query_text"), "") != "")
    )
    w = Window.partitionBy("scenario_id").orderBy(F.asc_nulls_first("timestamp"), "request_id")
    first = texts.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k)
    ordered = F.array_sort(F.collect_list(F.struct("rn", "query_text")))
    return first.groupBy("scenario_id").agg(
        F.transform(ordered, lambda s: s["query_text"]).alias("examples")
    )


def scenarios_list(
    assignments: DataFrame,
    clusters: DataFrame,
    scenario_id: str | None = None,
    hide_empty: bool = False,
    cfg: AggConfig = AggConfig(),
) -> DataFrame:
    """All described scenarios with count, trend and examples; empty ones included.

    `assignments` is already filtered; trends see all of it even for a single scenario.
    """
    dimension = clusters
    own = assignments
    if scenario_id is not None:
        dimension = clusters.where(F.col("scenario_id") == scenario_id)
        own = assignments.where(F.col("scenario_id") == scenario_id)
    records = (
        F.col("records_count") if "records_count" in clusters.columns else F.lit(None).cast("bigint")
    )
    meta = _cluster_meta(dimension).join(
        dimension.select("scenario_id", records.alias("__stored")), "scenario_id"
    )
    count = F.coalesce("count", F.lit(0))
    out = (
        meta.join(_scenario_counts(stored_rollup(own)), "scenario_id", "left")
        .join(scenario_examples(own, cfg.examples), "scenario_id", "left")
        .join(scenario_trends(assignments, cfg), "scenario_id", "left")
        .withColumn("count", count)
        .withColumn(
            "records_count",
            F.when(F.col("count") > 0, F.col("count")).otherwise(F.coalesce("__stored", F.lit(0))),
        )
        .drop("__stored")
    )
    return out.where(F.col("count") > 0) if hide_empty else out


def scenario_detail(
    assignments: DataFrame, clusters: DataFrame, scenario_id: str, cfg: AggConfig = AggConfig()
) -> DataFrame:
    """One scenario; described but unused ones have count 0; absent ones no row."""
    out = scenarios_list(assignments, clusters, scenario_id, cfg=cfg)
    return out.withColumn("trend", F.coalesce("trend", F.lit("insufficient_data")))


def legacy_by_task(assignments: DataFrame) -> DataFrame:
    return rollup(assignments).groupBy("task_type").agg(F.sum("n").alias("count"))


def legacy_by_scenario(assignments: DataFrame, clusters: DataFrame) -> DataFrame:
    counts = (
        rollup(assignments)
        .groupBy(filled(F.col("scenario_id"), UNKNOWN).alias("scenario_id"))
        .agg(F.sum("n").alias("count"))
    )
    return counts.join(clusters.select("scenario_id", "name"), "scenario_id", "left")


def legacy_totals(assignments: DataFrame) -> DataFrame:
    """Older statistics document: total, outliers and failure rate."""
    sums = rollup(assignments).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_logs"),
        F.coalesce(F.sum(F.when(F.col("is_outlier"), F.col("n"))), F.lit(0)).alias("outliers"),
        F.sum("failures").alias("failures"),
    )
    rate = F.coalesce(safe_div(F.col("failures"), F.col("total_logs")), F.lit(0.0))
    return sums.select("total_logs", "outliers", round_to(rate, 6).alias("failure_rate"))


# --- progress ---------------------------------------------------------------------


def classified_counts(assignments: DataFrame) -> DataFrame:
    """Classified records per source."""
    return (
        assignments.where(F.col("task_type").isNotNull())
        .groupBy("source_id")
        .agg(F.count(F.lit(1)).alias("classified"))
    )


def source_progress(sources: DataFrame, counts: DataFrame) -> DataFrame:
    """How far each source is; recomputed ones are complete."""
    total = F.coalesce("records_valid", F.lit(0))
    found = F.coalesce("classified", F.lit(0))
    seen = F.when(F.col("status") == "recomputed", total).otherwise(found)
    shown = F.when(total > 0, F.least(seen, total)).otherwise(seen)
    return sources.join(counts, "source_id", "left").select(
        "source_id",
        "name",
        "status",
        total.alias("total"),
        shown.alias("classified"),
        percent(shown, total).alias("percent"),
        ((total > 0) & (seen >= total)).alias("done"),
    )


def list_sources(sources: DataFrame, counts: DataFrame) -> DataFrame:
    """Source list, newest first, with classified counts."""
    finished = F.col("status").isin("classified", "recomputed")
    valid = F.col("records_valid")
    known = F.when(F.col("classified") > 0, F.col("classified")).otherwise(
        F.when(finished, valid).otherwise(F.lit(0))
    )
    pct = (
        F.when(valid > 0, round_to(F.least(F.lit(100.0), known.cast("double") / F.nullif(valid.cast("double"), F.lit(0.0)) * 100.0), 1))
        .when(finished, F.lit(100.0))
        .otherwise(F.lit(0.0))
    )
    out = sources.join(counts, "source_id", "left").select(
        "source_id", "name", "origin", "status", "records_total", "records_valid",
        "records_rejected", known.alias("records_classified"),
        pct.alias("classification_percentage"), "created_at",
    )
    return out.orderBy(F.desc("created_at"), "source_id")


def freshness(assignments: DataFrame, runs: DataFrame) -> DataFrame:
    """Does the read-model lag behind, and is a recompute under way?"""
    total = assignments.agg(F.count(F.lit(1))).scalar()
    done = (F.col("status") == "completed") & F.col("completed_at").isNotNull()
    last = F.max(
        F.when(done, F.struct("completed_at", F.coalesce("logs_at_completion", F.lit(0)).alias("logs")))
    )
    state = runs.agg(
        last.alias("last"),
        F.coalesce(F.bool_or(F.col("status").isin("pending", "running")), F.lit(False)).alias("running"),
    ).withColumn("total", total)
    since = F.greatest(F.lit(0), F.col("total") - F.coalesce("last.logs", F.lit(0)))
    stale = (F.col("last").isNull() & (F.col("total") > 0)) | (since > 0)
    return state.select(
        F.col("last.completed_at").alias("last_recompute_at"),
        since.alias("logs_since_last_recompute"),
        (stale & ~F.col("running")).alias("recompute_pending"),
        F.col("running").alias("recompute_running"),
    )


def processing_status(progress: DataFrame, fresh: DataFrame) -> DataFrame:
    """All sources together, for the progress banner."""
    sums = progress.agg(
        F.coalesce(F.bool_or(~F.col("done") & (F.col("status") != "recomputed")), F.lit(False)).alias("indexing"),
        F.coalesce(F.sum("total"), F.lit(0)).alias("total_valid"),
        F.coalesce(F.sum("classified"), F.lit(0)).alias("total_classified"),
    )
    state = fresh.select(
        F.struct("logs_since_last_recompute", "recompute_pending", "recompute_running")
    ).scalar()
    return sums.withColumn("f", state).select(
        "indexing",
        "total_valid",
        "total_classified",
        percent(F.col("total_classified"), F.col("total_valid")).alias("percent"),
        "f.logs_since_last_recompute",
        (F.col("f.recompute_pending") & ~F.col("f.recompute_running")).alias("recompute_pending"),
        "f.recompute_running",
    )
