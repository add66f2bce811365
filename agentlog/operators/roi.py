"""Return on investment: minutes saved, hours, money, by every cut the reports show.

Minutes are summed as decimals and tokens as integers; money is derived from those sums
once, after the aggregate, so results do not depend on the order of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from agentlog.config import (
    MANUAL_MINUTES_TOOLS,
    MANUAL_MINUTES_TOOLS_DEFAULT,
    RateModel,
    RoiConfig,
)
from agentlog.functions.numeric import (
    MINUTES_TYPE,
    money_text,
    one_digit,
    percent,
    round_to,
    safe_div,
    short_decimal,
)
from agentlog.functions.records import succeeded
from agentlog.functions.taxonomy import OTHER, UNKNOWN, filled, label, literal_map
from agentlog.session import cut_lineage


def _decimal(value: float) -> Column:
    return F.lit(str(value)).cast("decimal(9,4)")


def session_coeff(tokens: Column, cfg: RoiConfig = RoiConfig()) -> Column:
    """Weight of a session by its length."""
    return (
        F.when(tokens <= cfg.short_max_tokens, _decimal(cfg.coeff_short))
        .when(tokens >= cfg.long_min_tokens, _decimal(cfg.coeff_long))
        .otherwise(_decimal(cfg.coeff_medium))
    )


def manual_minutes(measured: Column, category: Column, cfg: RoiConfig = RoiConfig()) -> Column:
    """Struct(minutes, estimated): measured time when positive, else the class table (R2)."""
    table = F.coalesce(F.try_element_at(literal_map(cfg.manual_minutes), category), F.lit(cfg.manual_default))
    known = F.coalesce(measured > 0, F.lit(False))
    minutes = F.when(known, measured).otherwise(table)
    return F.struct(minutes.cast(MINUTES_TYPE).alias("minutes"), (~known).alias("estimated"))


def saved_minutes(status: Column, measured: Column, category: Column, tokens: Column,
                  cfg: RoiConfig = RoiConfig()) -> Column:
    """Minutes one record saved; failed ones save none."""
    minutes = manual_minutes(measured, category, cfg)["minutes"]
    weighted = minutes * session_coeff(F.coalesce(tokens, F.lit(0)), cfg)
    return F.when(succeeded(status), weighted).otherwise(F.lit(0)).cast("decimal(24,6)")


def roi_rows(joined: DataFrame, cfg: RoiConfig = RoiConfig(), variant: str = "session") -> DataFrame:
    """Economics of every record (R3). `variant="tools"` is the prototype formula."""
    if variant == "tools":
        return _tool_rows(joined)
    tokens = F.coalesce("tokens", F.lit(0))
    category = filled(F.col("task_type"), UNKNOWN)
    ok = succeeded(F.col("status"))
    no_tools = F.array().cast("array<string>")
    return joined.select(
        "request_id",
        "timestamp",
        category.alias("task_type"),
        F.nullif(F.col("scenario_id"), F.lit("")).alias("scenario_id"),
        "scenario_name",
        filled(F.col("user_id"), "unknown_user").alias("user_id"),
        filled(F.col("user_name"), "Unknown").alias("user_name"),
        filled(F.col("department"), "Unknown").alias("department"),
        filled(F.col("style"), "formal").alias("style"),
        F.coalesce("tools_used", no_tools).alias("tools_used"),
        F.coalesce(F.length("query_text"), F.lit(0)).cast("bigint").alias("query_chars"),
        tokens.alias("tokens"),
        ok.alias("success"),
        manual_minutes(F.col("manual_time_minutes"), category, cfg)["estimated"].alias("estimated"),
        saved_minutes(F.col("status"), F.col("manual_time_minutes"), category, tokens, cfg).alias("saved_minutes"),
        F.when(ok, F.lit(0)).otherwise(tokens).alias("wasted_tokens"),
    )


def _tool_rows(joined: DataFrame) -> DataFrame:
    """Prototype: class minutes × session length × (1 + 0.25 per tool); a measured value,
    even 0, is taken unscaled; only the exact status `success` counts."""
    category = filled(F.col("gold_category"), OTHER)
    tokens = F.coalesce("tokens", F.lit(0))
    base = F.coalesce(
        F.try_element_at(literal_map(MANUAL_MINUTES_TOOLS), category),
        F.lit(MANUAL_MINUTES_TOOLS_DEFAULT),
    ).cast(MINUTES_TYPE)
    length = (
        F.when(tokens > 50_000, _decimal(2.0)).when(tokens >= 10_000, _decimal(1.0)).otherwise(_decimal(0.3))
    )
    tools = F.greatest(F.coalesce(F.size("tools_used"), F.lit(0)), F.lit(0))
    scaled = base * length * (F.lit(1).cast("decimal(9,4)") + _decimal(0.25) * tools.cast("decimal(9,0)"))
    ok = F.coalesce(F.coalesce("status", F.lit("success")) == "success", F.lit(False))
    minutes = F.when(
        F.col("manual_time_minutes").isNotNull(), F.col("manual_time_minutes").cast("decimal(24,6)")
    ).otherwise(round_to(scaled, 2).cast("decimal(24,6)"))
    return joined.select(
        "request_id",
        "timestamp",
        category.alias("task_type"),
        F.coalesce("tools_used", F.array().cast("array<string>")).alias("tools_used"),
        tokens.alias("tokens"),
        ok.alias("success"),
        F.when(ok, minutes).otherwise(F.lit(0)).cast("decimal(24,6)").alias("saved_minutes"),
        F.when(ok, F.lit(0)).otherwise(tokens).alias("wasted_tokens"),
    )


# --- money out of sums ------------------------------------------------------------


def hours(minutes: Column) -> Column:
    return minutes.cast("double") / 60.0


def benefit(minutes: Column, rate: Column | float) -> Column:
    return hours(minutes) * rate


def cost(tokens: Column, price: Column | float) -> Column:
    return tokens.cast("double") / 1000.0 * price


def _net(minutes: Column, tokens: Column, cfg: RoiConfig) -> Column:
    return round_to(benefit(minutes, cfg.hourly_rate) - cost(tokens, cfg.price_per_1k), 2)


_DIMENSIONS = ("task_type", "scenario_id", "scenario_name", "user_id", "user_name", "department", "style")
_SUMS = ("n", "ok", "minutes", "tokens", "wasted", "automated", "estimated", "chars")


def _measures(df: DataFrame, *names: str) -> list[Column]:
    """Aggregates of the named sums, over rows or over a roll-up of rows."""
    if "n" in df.columns:
        return [F.sum(m).alias(m) for m in names]
    of = {
        "n": F.count(F.lit(1)),
        "ok": F.count_if("success"),
        "minutes": F.sum("saved_minutes"),
        "tokens": F.sum("tokens"),
        "wasted": F.sum("wasted_tokens"),
        "automated": F.count_if(F.col("success") & (F.size("tools_used") > 0)),
        "estimated": F.count_if("estimated"),
        "chars": F.sum("query_chars"),
    }
    return [of[m].alias(m) for m in names]


def _first_seen(df: DataFrame) -> Column:
    return F.min("first_seen" if "first_seen" in df.columns else "timestamp").alias("first_seen")


def roi_rollup(rows: DataFrame, *dimensions: str) -> DataFrame:
    """All sums per combination of the report's dimensions.

    Every function below takes either the rows or this roll-up, so one scan can serve a
    whole report. Its buffers are numbers only, which keeps it a hash aggregate.
    """
    if "n" in rows.columns:
        return rows
    return rows.groupBy(*(dimensions or _DIMENSIONS)).agg(*_measures(rows, *_SUMS), _first_seen(rows))


def roi_totals(rows: DataFrame) -> DataFrame:
    """The integer and decimal sums all summary figures derive from; one row.

    Distinct users and scenarios are counted on a roll-up, not on expanded rows.
    """
    roll = roi_rollup(rows, "user_id", "scenario_id", "style")
    zero = F.lit(0)
    return roll.agg(
        *[F.coalesce(F.sum(m), zero).alias(m) for m in _SUMS],
        F.count_distinct("user_id").alias("users"),
        F.count_distinct("scenario_id").alias("scenarios"),
        F.coalesce(F.sum(F.when(F.col("style") == "voice", F.col("n"))), zero).alias("voice"),
        F.coalesce(F.sum(F.when(F.col("style") == "typo", F.col("n"))), zero).alias("typo"),
    )


def _summary_of(t: DataFrame, rate: Column | float, price: Column | float, keep: tuple[str, ...] = ()) -> DataFrame:
    c = F.col
    gain, spend = benefit(c("minutes"), rate), cost(c("tokens"), price)
    zero = F.lit(0.0)
    voice, typo = percent(c("voice"), c("n")), percent(c("typo"), c("n"))
    return t.select(
        *keep,
        c("n").alias("total_logs"),
        percent(c("ok"), c("n")).alias("success_rate_percent"),
        round_to(hours(c("minutes")), 2).alias("total_fte_hours_saved"),
        round_to(gain, 2).alias("total_manual_cost"),
        round_to(spend, 2).alias("total_agent_cost"),
        round_to(gain - spend, 2).alias("net_savings"),
        F.when(spend > 0, round_to(safe_div(gain, spend), 2)).otherwise(zero).alias("roi_multiplier"),
        c("tokens").alias("total_tokens_consumed"),
        c("wasted").alias("wasted_tokens_on_errors"),
        round_to(cost(c("wasted"), price), 2).alias("wasted_cost"),
        F.when(c("ok") > 0, round_to(safe_div(spend, c("ok")), 2)).otherwise(zero).alias("cost_per_successful_action"),
        c("users").alias("mau_count"),
        round_to(voice + typo, 1).alias("mobile_voice_adoption_rate"),
        voice.alias("voice_rate"),
        typo.alias("typo_rate"),
        F.when(c("tokens") > 0, round_to(safe_div(hours(c("minutes")), c("tokens") / 1000.0), 4)).otherwise(zero).alias("token_value_index"),
        percent(c("automated"), c("n")).alias("process_automation_rate"),
        percent(c("estimated"), c("n")).alias("manual_minutes_estimated_percent"),
    )


def roi_summary(rows: DataFrame, cfg: RoiConfig = RoiConfig()) -> DataFrame:
    """All scalar figures of the ROI report in one row."""
    return _summary_of(roi_totals(rows), cfg.hourly_rate, cfg.price_per_1k)


def roi_what_if(rows: DataFrame, rates: DataFrame) -> DataFrame:
    """The summary under many (hourly_rate, price_per_1k) pairs; rows are scanned once."""
    sums = roi_totals(rows)
    packed = sums.select(F.struct(*sums.columns)).scalar()
    t = rates.select("hourly_rate", "price_per_1k").withColumn("t", packed)
    return _summary_of(
        t.select("hourly_rate", "price_per_1k", "t.*"),
        F.col("hourly_rate"),
        F.col("price_per_1k"),
        keep=("hourly_rate", "price_per_1k"),
    )


def roi_verdict(rows: DataFrame, cfg: RoiConfig = RoiConfig()) -> DataFrame:
    """Does the benefit exceed the cost? Compared before rounding."""
    return _verdict_of(
        roi_totals(rows).select(
            benefit(F.col("minutes"), cfg.hourly_rate).alias("b"), cost(F.col("tokens"), cfg.price_per_1k).alias("c")
        )
    )


def _verdict_of(pair: DataFrame) -> DataFrame:
    b, c = F.col("b"), F.col("c")
    ratio = F.when(c > 0, round_to(safe_div(b, c), 2)).otherwise(F.lit(0.0))
    headline = (
        F.when((b <= 0) & (c <= 0), F.lit("Недостаточно данных для вердикта"))
        .when(
            b > c,
            F.concat(
                F.lit("ИИ окупается: выгода "), money_text(b), F.lit(" > затрат "), money_text(c),
                F.lit(" (×"), short_decimal(ratio), F.lit(", чистыми "), money_text(b - c), F.lit(")"),
            ),
        )
        .otherwise(
            F.concat(
                F.lit("ИИ пока не окупается: выгода "), money_text(b), F.lit(" < затрат "), money_text(c),
                F.lit(" (минус "), money_text(F.abs(b - c)), F.lit(")"),
            )
        )
    )
    return pair.select(
        round_to(b, 2).alias("benefit"),
        round_to(c, 2).alias("cost"),
        round_to(b - c, 2).alias("net"),
        ratio.alias("ratio"),
        (b > c).alias("pays_off"),
        headline.alias("headline"),
    )


def analysis_cost(rows: DataFrame, cfg: RoiConfig = RoiConfig()) -> DataFrame:
    """Cost of analysing these records at the same token price."""
    t = roi_totals(rows)
    embed = F.floor(F.col("chars") / F.lit(cfg.chars_per_token or 3.0))
    summarise = F.floor(F.col("scenarios") * F.lit(cfg.tokens_per_scenario))
    spend = cost(F.col("e") + F.col("s"), cfg.price_per_1k)
    return t.select("n", embed.alias("e"), summarise.alias("s")).select(
        F.col("e").alias("embedding_tokens"),
        F.col("s").alias("summarization_tokens"),
        round_to(spend, 2).alias("cost"),
        F.coalesce(round_to(safe_div(spend, F.col("n")), 4), F.lit(0.0)).alias("cost_per_request"),
    )


# --- cuts -------------------------------------------------------------------------


def _cut(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(*_measures(rows, "n", "ok", "minutes", "tokens")).withColumnRenamed("n", "count")


def roi_by_category(rows: DataFrame, cfg: RoiConfig = RoiConfig()) -> DataFrame:
    """Hours and money per class, most frequent first."""
    return (
        _cut(rows, "task_type")
        .select(
            "task_type",
            label(F.col("task_type")).alias("label"),
            "count",
            percent(F.col("ok"), F.col("count")).alias("success_rate_percent"),
            round_to(hours(F.col("minutes")), 2).alias("fte_hours_saved"),
            _net(F.col("minutes"), F.col("tokens"), cfg).alias("net_savings"),
        )
        .orderBy(F.desc("count"), "task_type")
    )


def roi_category_metrics(tool_rows: DataFrame) -> DataFrame:
    """Per-class figures of the prototype variant."""
    return _cut(tool_rows, "task_type").select(
        "task_type",
        "count",
        F.col("ok").alias("success_count"),
        percent(F.col("ok"), F.col("count")).alias("success_rate_percent"),
        round_to(F.col("minutes"), 2).alias("saved_minutes"),
        F.col("tokens").alias("tokens_used"),
        round_to(hours(F.col("minutes")), 2).alias("fte_hours_saved"),
    )


def roi_by_scenario(rows: DataFrame, cfg: RoiConfig = RoiConfig()) -> DataFrame:
    """Hours and money per scenario; the name is the one seen first."""
    named = rows.where(F.col("scenario_id").isNotNull())
    parts = named.groupBy("scenario_id", "scenario_name").agg(
        *_measures(named, "n", "minutes", "tokens"), _first_seen(named)
    )
    first = F.min(F.struct("first_seen", "scenario_name"))["scenario_name"]
    sums = parts.groupBy("scenario_id").agg(
        first.alias("name"),
        F.sum("n").alias("count"),
        F.sum("minutes").alias("minutes"),
        F.sum("tokens").alias("tokens"),
    )
    return sums.select(
        "scenario_id",
        "name",
        "count",
        round_to(hours(F.col("minutes")), 2).alias("fte_hours_saved"),
        _net(F.col("minutes"), F.col("tokens"), cfg).alias("net_savings"),
    ).orderBy(F.desc("count"), "scenario_id")


def roi_user_stats(rows: DataFrame, cfg: RoiConfig = RoiConfig()) -> DataFrame:
    """Consumption per user; name and department as first seen."""
    parts = rows.groupBy("user_id", "user_name", "department").agg(
        *_measures(rows, "n", "tokens", "wasted"), _first_seen(rows)
    )
    first = F.min(F.struct("first_seen", "user_name", "department"))
    return (
        parts.groupBy("user_id")
        .agg(
            first.alias("f"),
            F.sum("n").alias("requests_count"),
            F.sum("tokens").alias("tokens_consumed"),
            F.sum("wasted").alias("wasted_tokens"),
        )
        .select(
            "user_id",
            F.col("f.user_name").alias("name"),
            F.col("f.department").alias("department"),
            "requests_count",
            "tokens_consumed",
            "wasted_tokens",
            round_to(cost(F.col("tokens_consumed"), cfg.price_per_1k), 4).alias("cost"),
        )
    )


def top_spenders(user_stats: DataFrame, n: int = 3) -> DataFrame:
    """Users with most tokens."""
    return user_stats.orderBy(F.desc("tokens_consumed"), "user_id").limit(n)


def department_costs(rows: DataFrame, cfg: RoiConfig = RoiConfig()) -> DataFrame:
    """Token cost per department, dearest first."""
    sums = rows.groupBy("department").agg(*_measures(rows, "tokens"))
    return sums.select(
        "department", round_to(cost(F.col("tokens"), cfg.price_per_1k), 2).alias("cost")
    ).orderBy(F.desc("cost"), "department")


def style_breakdown(rows: DataFrame) -> DataFrame:
    """Records per style with their share."""
    from agentlog.operators.joins import share

    counts = rows.groupBy("style").agg(*_measures(rows, "n")).withColumnRenamed("n", "count")
    return share(counts, "count")


def style_insight(summary: DataFrame, cfg: RoiConfig = RoiConfig()) -> DataFrame:
    """Sentence about the informal share; recommends only above the threshold."""
    rate = F.col("mobile_voice_adoption_rate")
    limit = F.lit(f"{cfg.voice_recommend_percent}%")
    detail = F.concat(
        F.lit("голос "), one_digit(F.col("voice_rate")), F.lit("%, опечатки "),
        one_digit(F.col("typo_rate")), F.lit("%"),
    )
    text = (
        F.when(rate <= 0, F.lit("Неформальных запросов не зафиксировано."))
        .when(
            rate >= cfg.voice_recommend_percent,
            F.concat(
                one_digit(rate), F.lit("% запросов приходят в неформальном стиле ("), detail,
                F.lit(") — выше порога "), limit, F.lit(", поддержка Voice-to-Text оправдана."),
            ),
        )
        .otherwise(
            F.concat(
                F.lit("Неформальный стиль — "), one_digit(rate), F.lit("% запросов ("), detail,
                F.lit("). Это ниже порога "), limit,
                F.lit(", отдельный Voice-to-Text интерфейс данными пока не обоснован."),
            )
        )
    )
    return summary.select(text.alias("style_insight"))


def tool_frequency(rows: DataFrame) -> DataFrame:
    """Tools of successful records, most frequent first."""
    return (
        rows.where("success")
        .select(F.explode("tools_used").alias("tool"))
        .groupBy("tool")
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.desc("count"), "tool")
    )


def person_months(df: DataFrame, col: str = "total_fte_hours_saved", per_month: float = 168.0) -> DataFrame:
    """Hours as person-months."""
    return df.withColumn("person_months", round_to(F.col(col) / F.lit(per_month), 2))


def derive_rates(params: DataFrame) -> DataFrame:
    """Rates out of salary, token price and infrastructure columns, one row each.

    A filled `hourly_override` or `price_override` wins and is flagged.
    """
    c = F.col
    hourly = F.when(c("hours_per_month") > 0, safe_div(c("monthly_rate"), c("hours_per_month"))).otherwise(F.lit(0.0))
    price = c("token_price_per_mln") / 1000.0
    yearly = safe_div(c("infra_capex"), c("amortization_years")) + c("electricity_per_year")
    infra = F.when(
        (c("amortization_years") > 0) & (c("tokens_per_year") > 0),
        safe_div(yearly, c("tokens_per_year")) * 1000.0,
    ).otherwise(F.lit(0.0))
    return params.select(
        *params.columns,
        round_to(hourly, 2).alias("derived_hourly_rate"),
        round_to(price, 4).alias("derived_price_per_1k"),
        round_to(infra, 4).alias("infra_price_per_1k"),
        F.coalesce("hourly_override", hourly).alias("hourly_rate"),
        F.coalesce("price_override", price).alias("price_per_1k"),
        c("hourly_override").isNotNull().alias("hourly_overridden"),
        c("price_override").isNotNull().alias("price_overridden"),
    )


# --- report sheets ----------------------------------------------------------------


def assumption_pairs(cfg: RoiConfig = RoiConfig()) -> list[tuple[str, str]]:
    """Every constant behind the figures as (metric, value) text."""
    r: RateModel = cfg.rates
    pairs: list[tuple[str, object]] = [
        ("fte_hourly_rate", cfg.hourly_rate),
        ("token_cost_per_1k", cfg.price_per_1k),
        ("session_coeff_short", cfg.coeff_short),
        ("session_coeff_medium", cfg.coeff_medium),
        ("session_coeff_long", cfg.coeff_long),
        ("session_short_max_tokens", cfg.short_max_tokens),
        ("session_long_min_tokens", cfg.long_min_tokens),
        ("fte_monthly_rate", r.monthly_rate),
        ("fte_work_hours_per_month", r.hours_per_month),
        ("fte_rate_overridden", str(cfg.hourly_overridden).lower()),
        ("token_infra_capex", r.infra_capex),
        ("token_amortization_years", r.amortization_years),
        ("token_electricity_per_year", r.electricity_per_year),
        ("token_tokens_per_year", r.tokens_per_year),
        ("token_cost_overridden", str(cfg.price_overridden).lower()),
    ]
    pairs += [(f"manual_minutes:{k}", v) for k, v in cfg.manual_minutes.items()]
    return [(k, str(v)) for k, v in pairs]


def roi_assumptions(spark, cfg: RoiConfig = RoiConfig()) -> DataFrame:
    """The assumptions as a table."""
    return spark.createDataFrame(assumption_pairs(cfg), "metric string, value string")


SUMMARY_SHEET = (
    "total_logs", "success_rate_percent", "mau_count", "total_fte_hours_saved",
    "total_manual_cost", "total_agent_cost", "net_savings", "roi_multiplier",
    "cost_per_successful_action", "wasted_cost", "total_tokens_consumed",
    "wasted_tokens_on_errors", "token_value_index", "process_automation_rate",
    "mobile_voice_adoption_rate", "manual_minutes_estimated_percent",
)


def summary_sheet(rows: DataFrame, cfg: RoiConfig = RoiConfig()) -> DataFrame:
    """Summary figures turned into (row_no, metric, value) numbers."""
    one = roi_summary(rows, cfg)
    pairs = F.array(
        *[
            F.struct(F.lit(i).alias("row_no"), F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"))
            for i, m in enumerate(SUMMARY_SHEET, start=1)
        ]
    )
    return one.select(F.explode(pairs).alias("p")).select("p.*")


def roi_sheets(rows: DataFrame, cfg: RoiConfig = RoiConfig()) -> dict[str, DataFrame]:
    """The four sheets of the exported report, out of one stored roll-up."""
    spark = rows.sparkSession
    rows = cut_lineage(roi_rollup(rows))
    verdict = roi_verdict(rows, cfg)
    heads = ("headline", "pays_off", "benefit", "cost", "net", "ratio")
    lines = F.array(
        *[
            F.struct(F.lit(i - len(heads)).alias("row_no"), F.lit(f"verdict_{m}").alias("metric"), F.col(m).cast("string").alias("value"))
            for i, m in enumerate(heads)
        ]
    )
    top = verdict.select(F.explode(lines).alias("p")).select("p.*")
    numbers = summary_sheet(rows, cfg).withColumn("value", F.col("value").cast("string"))
    insight = style_insight(roi_summary(rows, cfg), cfg).select(
        F.lit(90).alias("row_no"), F.lit("style_insight").alias("metric"), F.col("style_insight").alias("value")
    )
    fixed = spark.createDataFrame(
        [(100 + i, k, v) for i, (k, v) in enumerate(assumption_pairs(cfg))],
        "row_no int, metric string, value string",
    )
    summary = top.unionByName(numbers).unionByName(insight).unionByName(fixed)
    return {
        "Summary": summary.orderBy("row_no").drop("row_no"),
        "ByCategory": roi_by_category(rows, cfg),
        "ByScenario": roi_by_scenario(rows, cfg).withColumn("name", F.coalesce("name", F.lit(""))),
        "ByStyle": style_breakdown(rows).orderBy(F.desc("count"), "style"),
    }
