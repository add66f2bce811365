"""Line-first cleaning: judge every line by itself, remove what fails, then reject documents
that lost too much. Only built-in column functions; one pass, no shuffle."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from agentlog.llm.common import let, text_or_empty, words

SYMBOLS = "#*$%&|<>"
#: A line ends like a sentence, or holds the end of one.
SENTENCE = r"""[.!?…:;"'»”)\]][\x20\x09-\x0D]*$|[.!?…][\x20\x09]"""
BOILERPLATE = (
    r"(?i)all rights reserved|licen[sc]ed under|released under|public license|copyright \(c\)"
    r"|cookie policy|privacy policy|terms of (use|service)|powered by|click here|sign up|log in to"
)


@dataclass(frozen=True)
class Rules:
    """Limits of the line rules and of the loss a document may take."""

    bars_per_word: float = 0.2  # navigation: bars between entries
    marks_per_word: float = 0.5  # symbols glued to words
    shout_words: int = 4  # a line without small letters of at least so many words
    max_lost: float = 0.5  # share of words lost with failed lines
    min_words: int = 10
    max_repeat_percent: int = 20
    window: int = 5


def count_of(text: Column, letters: str) -> Column:
    """Number of characters of `text` that are one of `letters`."""
    return F.length(text) - F.length(F.translate(text, letters, ""))


def line_fails(line: Column, n: Column, rules: Rules) -> Column:
    """Whether a line of `n` words fails a rule; lines without a word never do."""
    navigation = (n >= 3) & (count_of(line, "|") >= n * rules.bars_per_word)
    symbols = count_of(line, "#*$%&") >= n * rules.marks_per_word
    shouting = (n >= rules.shout_words) & line.rlike(r"\p{Lu}") & ~line.rlike(r"\p{Ll}")
    return (n > 0) & (
        navigation | symbols | shouting | line.rlike(BOILERPLATE) | ~line.rlike(SENTENCE)
    )


def repeated_words(tokens: Column, window: int) -> Column:
    """Words inside windows of `window` words that occur twice or more, first ones included.

    Windows are compared by 64-bit hashes. Texts without a repeated window, nearly all, need
    only a distinct count; else positions sorted by hash show the repeats.
    """
    hashes = let(
        F.transform(tokens, lambda w: F.xxhash64(w)),
        lambda h: F.transform(
            F.sequence(F.lit(1), F.size(h) - (window - 1)),
            lambda i: F.xxhash64(*[F.element_at(h, i + k) for k in range(window)]),
        ),
    )
    hashes = F.when(F.size(tokens) >= window, hashes)

    def covered(h: Column) -> Column:
        by_hash = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        pairs = let(
            by_hash,
            lambda s: F.flatten(
                F.zip_with(
                    F.slice(s, 1, F.size(s) - 1), F.slice(s, 2, F.size(s)),
                    lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(
                        F.array().cast("array<int>")
                    ),
                )
            ),
        )
        starts = F.array_sort(F.array_distinct(pairs))
        gaps = let(
            starts,
            lambda s: F.zip_with(
                F.slice(s, 1, F.size(s) - 1), F.slice(s, 2, F.size(s)),
                lambda a, b: F.least(b - a, F.lit(window)),
            ),
        )
        return F.aggregate(gaps, F.lit(window), lambda total, gap: total + gap)

    count = let(
        hashes,
        lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(covered(h)),
    )
    return F.coalesce(count, F.lit(0)).cast("long")


def clean(docs: DataFrame, text_col: str = "text", rules: Rules = Rules()) -> DataFrame:
    """All rows of `docs` with the base counts, the cleaned text and the verdict.

    Null and empty texts have no words, so they fail the base rule and are not kept. Lines
    are split at newlines; lines without a word stay as they are. A document is kept when
    the base rules pass and the failed lines hold at most `max_lost` of its words. Repeated
    rows get equal results; an empty table gives an empty result; columns of `docs` named
    like the new ones are replaced.
    """
    names = [
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        "n_lines", "n_failed_lines", "n_lost_words", "clean_text", "kept",
    ]
    lines = docs.drop(*names).withColumn("__text", text_or_empty(text_col)).withColumn(
        "__lines",
        F.transform(
            F.split("__text", "\n"),
            lambda line: F.struct(line.alias("line"), words(line).alias("words")),
        ),
    )
    judged = lines.withColumn(
        "__lines",
        F.transform(
            "__lines",
            lambda x: F.struct(
                x["line"].alias("line"), F.size(x["words"]).alias("n"), x["words"].alias("words"),
                line_fails(x["line"], F.size(x["words"]), rules).alias("fails"),
            ),
        ),
    )
    told = judged.withColumn("__words", F.flatten("__lines.words")).withColumn(
        "__with_word", F.filter("__lines", lambda x: x["n"] > 0)["line"]
    )
    failed = F.filter("__lines", lambda x: x["fails"])
    counted = told.select(
        *[c for c in docs.columns if c not in names],
        F.size("__words").cast("long").alias("n_words"),
        F.length(F.array_join("__words", "")).cast("long").alias("word_chars"),
        count_of(F.col("__text"), SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("__with_word") - F.size(F.array_distinct("__with_word"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("__words"), rules.window).alias("n_repeat_words"),
        F.size("__lines").alias("n_lines"),
        F.size(failed).alias("n_failed_lines"),
        F.aggregate(failed["n"], F.lit(0), lambda total, n: total + n).cast("long").alias("n_lost_words"),
        F.array_join(F.filter("__lines", lambda x: ~x["fails"])["line"], "\n").alias("clean_text"),
    )
    base_failed = (F.col("n_words") < rules.min_words) | (
        100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words")
    )
    lost = F.col("n_lost_words") > rules.max_lost * F.col("n_words")
    return counted.withColumn("base_failed", base_failed).withColumn(
        "kept", ~F.col("base_failed") & ~lost
    )
