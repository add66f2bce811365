"""Task classes and their labels."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from agentlog.functions.text import strip, words

# --- fixed values ----------------------------------------------------------------
TASK_LABELS = {
    "text_generation": "Генерация текста",
    "code_help": "Помощь с кодом",
    "data_analysis": "Анализ данных",
    "education": "Объяснение / обучение",
    "information_search": "Поиск информации",
    "task_management": "Планирование / задачи",
    "other": "Другое",
    "unknown": "Не уверены",
}
TASK_DESCRIPTIONS = {
    "text_generation": "письма, инструкции, посты, ответы клиентам",
    "code_help": "написание/объяснение кода, ошибки, SQL-скрипты как код",
    "data_analysis": "Excel, аналитика, отчёты, выгрузки, SQL-запросы к данным",
    "education": "«объясни», «что значит», обучающие вопросы",
    "information_search": "сбор данных из CRM/Confluence/почты, ресёрч по компании",
    "task_management": "Jira/тикеты, встречи, напоминания, календарь",
    "other": "нерабочее, общие вопросы, аномалии",
    "unknown": "классификатор не уверен (confidence < порога)",
}
# ---------------------------------------------------------------------------------

UNKNOWN, OTHER = "unknown", "other"
CORE_TYPES = tuple(t for t in TASK_LABELS if t != UNKNOWN)


def literal_map(values: dict[str, object]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def filled(c: Column, default: str) -> Column:
    """The value, or the default when it is null or empty."""
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(default))


def label(task_type: Column) -> Column:
    """Label of a class; null and '' read as unknown, foreign keys as other."""
    key = filled(task_type, UNKNOWN)
    return F.coalesce(
        F.try_element_at(literal_map(TASK_LABELS), key), F.lit(TASK_LABELS[OTHER])
    )


def description(task_type: Column) -> Column:
    return F.coalesce(
        F.try_element_at(literal_map(TASK_DESCRIPTIONS), task_type), F.lit("")
    )


def is_valid(task_type: Column, allow_unknown: bool = True) -> Column:
    """Whether the value is a known class."""
    allowed = CORE_TYPES + ((UNKNOWN,) if allow_unknown else ())
    return F.coalesce(task_type.isin(*allowed), F.lit(False))


def normalize_label(raw: Column) -> Column:
    """Free text of a model to a core class, or null."""
    quotes = "[`\"']+"
    text = strip(raw)
    bare = F.regexp_replace(text, f"^{quotes}|{quotes}$", "")
    key = F.translate(F.lower(bare), " -", "__")
    by_label = literal_map({v.lower(): k for k, v in TASK_LABELS.items() if k != UNKNOWN})
    # Only spaces and dashes were joined, so other whitespace still splits tokens.
    token = F.get(words(key), F.lit(0))
    return F.when(
        raw != "",
        F.coalesce(
            F.when(key.isin(*CORE_TYPES), key),
            F.try_element_at(by_label, F.lower(text)),
            F.when(token.isin(*CORE_TYPES), token),
        ),
    )
