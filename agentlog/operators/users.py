"""Users and models: profiles, personas, frustration, departments, model shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from agentlog.config import RoiConfig, UsersConfig
from agentlog.functions.numeric import percent, round_to
from agentlog.functions.records import (
    MODEL_FAILURE_STATUSES,
    USER_FAILURE_STATUSES,
    model_id,
)
from agentlog.functions.taxonomy import UNKNOWN, filled, label, literal_map
from agentlog.functions.text import first_filled
from agentlog.operators.joins import share
from agentlog.operators.keyed import argmax_count
from agentlog.operators.roi import hours, saved_minutes
from agentlog.session import cut_lineage

# --- fixed values ----------------------------------------------------------------
PERSONA_LABELS = {
    "code_craftsman": "Разработчик (Code)",
    "analyst": "Аналитик данных",
    "super_user": "AI Super-User",
    "generalist": "Универсал",
    "casual": "Эпизодический",
}
PERSONA_ADVICE = {
    "code_craftsman": "Пользователь активно генерирует и отлаживает код. Рекомендуется интегрировать IDE-агента.",
    "analyst": "Основная ценность — разбор документов и поиск данных. Эффективно использует автоматизацию.",
    "super_user": "Лидер внедрения ИИ. Использует широкий спектр сценариев с высокой эффективностью.",
    "generalist": "Ровное использование по нескольким категориям. Рекомендуется показать продвинутые сценарии.",
    "casual": "Эпизодическое использование. Рекомендуется вводный вебинар по возможностям ИИ-агентов.",
}
DEFAULT_DEPARTMENT = "Общий"
ANONYMOUS = "Anonymous"
# ---------------------------------------------------------------------------------


def _category() -> Column:
    return F.coalesce(first_filled(F.col("task_type"), F.col("gold_category")), F.lit(UNKNOWN))


def _failing(statuses: tuple[str, ...]) -> Column:
    return F.coalesce("has_failure_signals", F.lit(False)) | F.coalesce(
        F.col("status").isin(*statuses), F.lit(False)
    )


def _with_uid(joined: DataFrame) -> DataFrame:
    uid = F.coalesce(first_filled(F.col("user_id"), F.col("user_name")), F.lit(ANONYMOUS))
    return joined.withColumn("uid", uid).withColumn("category", _category())


def user_profiles(joined: DataFrame, roi: RoiConfig = RoiConfig()) -> DataFrame:
    """Facts per user the other figures derive from (P1), with the main class.

    Three aggregates, each on the small result of the one before. The first, over all
    rows, has number buffers only, so it is a hash aggregate with map-side combine, and a
    user who holds a large part of the log is spread over all tasks.
    """
    rows = _with_uid(joined)
    minutes = saved_minutes(
        F.col("status"), F.col("manual_time_minutes"), F.col("category"), F.col("tokens"), roi
    )
    sums = ("n", "failures", "outliers", "minutes")
    per_day = rows.groupBy("uid", "category", F.to_date("timestamp").alias("day"), "user_name", "department").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(_failing(USER_FAILURE_STATUSES)).alias("failures"),
        F.count_if(F.coalesce("is_outlier", F.lit(False))).alias("outliers"),
        F.sum(minutes).alias("minutes"),
        F.min("timestamp").alias("first_seen"),
    )
    per_class = per_day.groupBy("uid", "category").agg(
        *[F.sum(c).alias(c) for c in sums],
        F.min(F.struct("first_seen", "user_name", "department")).alias("f"),
        F.collect_set("day").alias("days"),
        F.max("day").alias("last_day"),
    )
    category = F.col("category")

    def of(*names: str) -> Column:
        return F.coalesce(F.sum(F.when(category.isin(*names), F.col("n"))), F.lit(0))

    top = F.min(F.struct((-F.col("n")).alias("n"), "category"))["category"]
    days = F.array_distinct(F.flatten(F.collect_list("days")))
    per_user = per_class.groupBy("uid").agg(
        *[F.sum(c).alias(c) for c in sums],
        F.min("f").alias("f"),
        F.size(days).cast("bigint").alias("active_days"),
        F.max("last_day").alias("last_day"),
        F.count(F.lit(1)).alias("categories"),
        of("code_help").alias("code_queries"),
        of("data_analysis", "information_search").alias("data_queries"),
        top.alias("top_task_type"),
    )
    return per_user.select(
        F.col("uid").alias("user_id"),
        F.coalesce(F.nullif(F.col("f.user_name"), F.lit("")), F.col("uid")).alias("user_name"),
        filled(F.col("f.department"), DEFAULT_DEPARTMENT).alias("department"),
        F.col("n").alias("total_queries"),
        "active_days",
        "last_day",
        "categories",
        "code_queries",
        "data_queries",
        "failures",
        "outliers",
        F.col("minutes").alias("saved_minutes"),
        "top_task_type",
    )


def cohort_median(profiles: DataFrame) -> DataFrame:
    """Exact median of queries per user, over the histogram of counts."""
    histogram = profiles.groupBy("total_queries").agg(F.count(F.lit(1)).alias("users"))
    return histogram.agg(
        F.coalesce(F.percentile("total_queries", 0.5, F.col("users")), F.lit(0.0)).alias("median_queries")
    )


def with_persona(profiles: DataFrame, cfg: UsersConfig = UsersConfig()) -> DataFrame:
    """Usage archetype, first matching rule."""
    median = cohort_median(profiles).scalar()
    n = F.col("total_queries")
    rules = (
        F.when(F.col("code_queries") / n >= cfg.specialist_share, F.lit("code_craftsman"))
        .when(F.col("data_queries") / n >= cfg.specialist_share, F.lit("analyst"))
        .when(
            (F.col("categories") >= cfg.super_user_categories) & (n >= F.col("median_queries")),
            F.lit("super_user"),
        )
        .when(
            n < F.greatest(F.lit(cfg.casual_floor), F.col("median_queries") * cfg.casual_fraction),
            F.lit("casual"),
        )
        .otherwise(F.lit("generalist"))
    )
    out = profiles.withColumn("median_queries", median).withColumn("persona", rules)
    return out.withColumn(
        "persona_label", F.try_element_at(literal_map(PERSONA_LABELS), F.col("persona"))
    ).drop("median_queries")


def with_frustration(profiles: DataFrame, cfg: UsersConfig = UsersConfig()) -> DataFrame:
    """Blend of failure and outlier share in percent."""
    n = F.col("total_queries")
    failing = F.col("failures") / n * 100.0
    outlying = F.col("outliers") / n * 100.0
    return profiles.withColumn(
        "frustration_index",
        round_to(failing * cfg.failure_weight + outlying * cfg.outlier_weight, 1),
    )


def user_top_category(joined: DataFrame) -> DataFrame:
    """Most frequent class of each user, ties by name."""
    best = argmax_count(_with_uid(joined).select("uid", "category"), ["uid"], "category")
    return best.select(
        F.col("uid").alias("user_id"),
        F.col("category").alias("top_task_type"),
        label(F.col("category")).alias("top_category"),
    )


def with_guidance(users: DataFrame, cfg: UsersConfig = UsersConfig()) -> DataFrame:
    """Does the user need help, and the advice shown (P5)."""
    frustrated = F.col("frustration_index")
    rare = (F.col("persona") == "casual") & (F.col("total_queries") < 5)
    repeat = F.concat(
        F.lit("Высокий процент повторов в «"), F.col("top_category"),
        F.lit("». Рекомендуется предоставить готовый шаблон промпта."),
    )
    return users.withColumn(
        "needs_guidance", (frustrated > cfg.guidance_frustration) | rare
    ).withColumn(
        "recommendation",
        F.when(frustrated > cfg.advice_frustration, repeat).otherwise(
            F.try_element_at(literal_map(PERSONA_ADVICE), F.col("persona"))
        ),
    )


def users_table(
    joined: DataFrame, cfg: UsersConfig = UsersConfig(), roi: RoiConfig = RoiConfig()
) -> DataFrame:
    """One finished row per user.

    Profiles are stored once: the median and the reports above read them, not the log.
    """
    profiles = cut_lineage(user_profiles(joined, roi))
    profiles = with_frustration(with_persona(profiles, cfg), cfg)
    full = profiles.withColumn("top_category", label(F.col("top_task_type"))).withColumn(
        "saved_hours", round_to(hours(F.col("saved_minutes")), 1)
    )
    return with_guidance(full, cfg)


def active_users(profiles: DataFrame, days: int = UsersConfig.active_days) -> DataFrame:
    """Users seen in the last `days` before the newest day of the data."""
    newest = profiles.agg(F.max("last_day")).scalar()
    active = F.col("last_day") >= F.date_sub(newest, days)
    return profiles.agg(F.count_if(F.coalesce(active, F.lit(False))).alias("active_users"))


def _tenths(c: str) -> Column:
    return F.col(c).cast("decimal(18,1)")


def department_users(users: DataFrame) -> DataFrame:
    """Users, queries, hours and frustration per department, out of rounded rows."""
    mean = F.sum(_tenths("frustration_index")).cast("double") / F.count(F.lit(1))
    return (
        users.groupBy("department")
        .agg(
            F.count(F.lit(1)).alias("users_count"),
            F.sum("total_queries").alias("total_queries"),
            round_to(F.sum(_tenths("saved_hours")), 1).alias("avg_saved_hours"),
            round_to(mean, 1).alias("frustration_index"),
        )
        .orderBy(F.desc("total_queries"), "department")
    )


def persona_distribution(users: DataFrame) -> DataFrame:
    """Users per persona with share."""
    counts = users.groupBy("persona").agg(F.count(F.lit(1)).alias("count"))
    named = counts.withColumn(
        "label", F.try_element_at(literal_map(PERSONA_LABELS), F.col("persona"))
    )
    return share(named, "count")


def users_summary(users: DataFrame, cfg: UsersConfig = UsersConfig()) -> DataFrame:
    """Head figures of the users report (P10)."""
    active = active_users(users, cfg.active_days).scalar()
    mean = F.sum(_tenths("frustration_index")).cast("double") / F.nullif(F.count(F.lit(1)), F.lit(0))
    return users.agg(
        F.count(F.lit(1)).alias("total_users"),
        F.coalesce(round_to(mean, 1), F.lit(0.0)).alias("avg_frustration_index"),
    ).select(
        "total_users",
        active.alias("active_users"),
        F.lit(cfg.active_days).cast("bigint").alias("active_window_days"),
        "avg_frustration_index",
    )


def users_totals(users: DataFrame) -> DataFrame:
    """Queries and hours over all users."""
    return users.agg(
        F.coalesce(F.sum("total_queries"), F.lit(0)).alias("total_queries"),
        round_to(F.coalesce(F.sum(_tenths("saved_hours")), F.lit(0)), 1).alias("saved_hours"),
    )


# --- models -----------------------------------------------------------------------


def _with_model(joined: DataFrame) -> DataFrame:
    return joined.withColumn("model_id", model_id(F.col("tools_used"))).where(
        F.col("model_id").isNotNull()
    )


def model_analytics(joined: DataFrame) -> DataFrame:
    """Use, tokens, failures and main class per model named by the data.

    One shuffle by (model, class) carries everything; the second works on its small result.
    """
    rows = _with_model(joined).withColumn("category", _category())
    cells = rows.groupBy("model_id", "category").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.coalesce("tokens", F.lit(0))).alias("tokens"),
        F.count_if(_failing(MODEL_FAILURE_STATUSES)).alias("failures"),
    )
    best = F.min(F.struct((-F.col("n")).alias("n"), "category"))["category"]
    models = cells.groupBy("model_id").agg(
        F.sum("n").alias("total_queries"),
        F.sum("tokens").alias("total_tokens"),
        F.sum("failures").alias("failures"),
        best.alias("top"),
    )
    return (
        share(models, "total_queries", "share_percentage")
        .select(
            "model_id",
            "total_queries",
            "share_percentage",
            "total_tokens",
            percent(F.col("failures"), F.col("total_queries")).alias("failure_rate_percent"),
            label(F.col("top")).alias("top_task_type"),
        )
        .orderBy(F.desc("total_queries"), "model_id")
    )


def model_summary(joined: DataFrame) -> DataFrame:
    """Whether models are known, how many, and their totals."""
    sums = _with_model(joined).agg(
        F.count_distinct("model_id").alias("total_models_detected"),
        F.count(F.lit(1)).alias("total_queries_with_model"),
        F.coalesce(F.sum("tokens"), F.lit(0)).alias("total_tokens"),
    )
    status = F.when(F.col("total_models_detected") > 0, F.lit("available")).otherwise(
        F.lit("not_available")
    )
    return sums.select(status.alias("status"), "*")
