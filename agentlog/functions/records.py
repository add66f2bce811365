"""Column rules of the normaliser: status, style, tokens, tools, timestamps."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, functions as F

from agentlog.functions.numeric import parse_double, parse_long
from agentlog.functions.taxonomy import literal_map
from agentlog.functions.text import first_filled, strip

# --- fixed values ----------------------------------------------------------------
STATUS_ERROR_CODES = {"error_tool": "tool_error", "hallucination_loop": "hallucination_loop"}
STYLE_ALIASES = {
    "typoy": "typo",
    "typò": "typo",
    "typo_jargon": "typo",
    "voice_jargon": "voice",
    "corporate slang": "jargon",
    "corporate_slang": "jargon",
    "formnal": "formal",
}
NOT_A_STYLE = ("success", "error", "error_tool", "hallucination_loop")
SUCCESS_STATUSES = ("success", "ok", "completed")
FAILED_RESPONSES = ("error", "failed", "failure", "timeout")
USER_FAILURE_STATUSES = ("error", "error_tool", "hallucination_loop")
MODEL_FAILURE_STATUSES = ("error", "error_tool")
# ---------------------------------------------------------------------------------

_ISO = (
    r"^\d{4}-\d{2}-\d{2}"
    r"([T ]\d{2}(:\d{2}(:\d{2}([.,]\d{1,9})?)?)?([+-]\d{2}(:?\d{2})?)?)?$"
)


def parse_timestamp(c: Column) -> Column:
    """ISO 8601 date or date-time; no zone means UTC; anything else is null."""
    text = F.replace(c, F.lit("Z"), F.lit("+00:00"))
    full = F.regexp_replace(F.replace(text, F.lit(","), F.lit(".")), r"([T ]\d{2})($|[+-])", "$1:00$2")
    return F.when(text.rlike(_ISO), full.try_cast("timestamp"))


def synthetic_timestamp(index: Column, total: Column, now: datetime, span_days: int) -> Column:
    """Spread rows evenly over the `span_days` before `now`."""
    span = span_days * 86_400_000_000
    end = F.unix_micros(F.lit(now.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp"))
    share = index.cast("double") / F.nullif(total.cast("double"), F.lit(0.0))
    offset = F.floor(F.lit(float(span)) * share + 0.5)
    return F.timestamp_micros(F.coalesce(end - F.lit(span) + offset, end))


def status_pair(status: Column) -> Column:
    """Struct(response_status, error_code) of a raw status, case folded."""
    return exact_status_pair(F.lower(status))


def exact_status_pair(status: Column) -> Column:
    """The same map without case folding, as stored rows are read back."""
    code = F.try_element_at(literal_map(STATUS_ERROR_CODES), status)
    return F.struct(
        F.when(code.isNotNull(), F.lit("error")).otherwise(F.lit("success")).alias("response_status"),
        code.alias("error_code"),
    )


def seed_status_pair(status: Column) -> Column:
    """Seed variant: more spellings, null stays null, unknown text passes."""
    s = F.lower(strip(F.nullif(status, F.lit(""))))
    code = F.try_element_at(literal_map(STATUS_ERROR_CODES), s)
    response = (
        F.when(s.isin("success", "ok"), F.lit("success"))
        .when(code.isNotNull() | s.isin("error", "failed"), F.lit("error"))
        .otherwise(s)
    )
    return F.struct(response.alias("response_status"), code.alias("error_code"))


def normalize_style(c: Column) -> Column:
    """Canonical style; leaked status words are no style; unknown text is kept."""
    clean = F.lower(strip(c))
    known = F.coalesce(F.try_element_at(literal_map(STYLE_ALIASES), clean), clean)
    return F.when((clean != "") & ~clean.isin(*NOT_A_STYLE), known)


def tokens_of(total: Column, simulated: Column, metadata: Column) -> Column:
    """First of the three token fields that parses; 0 counts as a value."""
    usage = F.get_json_object(metadata, "$.usage.total_tokens")
    return F.coalesce(parse_long(total), parse_long(simulated), parse_long(usage))


def manual_minutes_of(*aliases: Column) -> Column:
    """The first alias that is neither empty nor zero decides, parseable or not."""
    truthy = [
        F.when((c != "") & ~F.coalesce(parse_double(c) == 0.0, F.lit(False)), c)
        for c in aliases
    ]
    return parse_double(F.coalesce(*truthy))


def tools_array(c: Column) -> Column:
    """Tools as text: JSON list, or a comma list; blanks dropped from the latter (S3)."""
    listed = F.filter(F.transform(F.split(c, ","), strip), lambda t: t != "")
    return F.when(
        strip(c).startswith("["), F.from_json(c, "array<string>")
    ).otherwise(listed)


def tools_of(tools: Column, metadata: Column) -> Column:
    """Own tools, or those of the metadata when there are none."""
    own = tools_array(tools)
    nested = F.from_json(F.get_json_object(metadata, "$.tools_used"), "array<string>")
    return F.when(F.size(own) > 0, own).otherwise(
        F.coalesce(nested, F.array().cast("array<string>"))
    )


def with_model_tag(tools: Column, *models: Column) -> Column:
    """Append `model:<id>` unless a model entry is there already."""
    model = strip(first_filled(*models))
    tagged = F.exists(tools, lambda t: t.startswith("model:"))
    return F.when(
        (model != "") & ~F.coalesce(tagged, F.lit(False)),
        F.array_append(tools, F.concat(F.lit("model:"), model)),
    ).otherwise(tools)


def model_id(tools: Column) -> Column:
    """First non-blank model named in the tools."""
    names = F.transform(
        F.filter(tools, lambda t: t.startswith("model:")),
        lambda t: strip(F.substring(t, F.lit(len("model:") + 1), F.length(t))),
    )
    return F.get(F.filter(names, lambda n: n != ""), F.lit(0))


def succeeded(status: Column) -> Column:
    return F.coalesce(F.lower(strip(status)).isin(*SUCCESS_STATUSES), F.lit(False))


def failure_signals(
    response_status: Column, error_code: Column, feedback: Column, retries: Column
) -> Column:
    """Prefixed signals of one record."""
    status = F.lower(response_status)
    return F.array_compact(
        F.array(
            F.when(status.isin(*FAILED_RESPONSES), F.concat(F.lit("response_status:"), status)),
            F.when(error_code != "", F.concat(F.lit("error_code:"), error_code)),
            F.when(feedback.try_cast("int") < 0, F.lit("user_feedback:negative")),
            F.when(
                retries.try_cast("int") > 0, F.concat(F.lit("retry_count:"), retries.cast("string"))
            ),
        )
    )
