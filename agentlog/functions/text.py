"""Text clean-up, word chunks, long-text representation and reply parsing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from agentlog.config import LongTextConfig


# --- fixed values: the characters Python counts as white space ---------------------
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
# ---------------------------------------------------------------------------------
_RUN = r"(?U)[\s\x1c-\x1f]+"  # the same set: Unicode white space and four separators


def strip(c: Column) -> Column:
    """Trim every kind of Unicode white space (Spark's `trim` knows only blanks)."""
    return F.btrim(c, F.lit(WHITE_SPACE))


def squash(c: Column) -> Column:
    """Any run of white space becomes one blank, ends trimmed."""
    return F.regexp_replace(strip(c), _RUN, " ")


def first_filled(*cols: Column) -> Column:
    """First value that is neither null nor empty text."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with the value computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(c: Column) -> Column:
    """White-space separated words; an empty array for blank or null text."""
    none = F.array().cast("array<string>")
    return let(strip(c), lambda t: F.when(t != "", F.split(t, _RUN)).otherwise(none))


def token_estimate(c: Column) -> Column:
    """Number of words."""
    return F.size(words(c)).cast("bigint")


def _windows(w: Column, size: int, overlap: int) -> Column:
    overlap = max(0, min(overlap, size - 1))
    step = max(1, size - overlap)
    # A further window starts only while the previous one left words uncovered.
    last = F.ceil(F.greatest(F.size(w) - size, F.lit(0)) / F.lit(step)).cast("int")
    starts = F.sequence(F.lit(0), last)
    return F.when(F.size(w) == 0, F.array().cast("array<string>")).otherwise(
        F.transform(starts, lambda i: F.array_join(F.slice(w, i * step + 1, F.lit(size)), " "))
    )


def word_chunks(c: Column, size: int, overlap: int) -> Column:
    """Overlapping windows of `size` words; the last one reaches the end."""
    if size <= 0:
        raise ValueError("chunk size must be positive")
    return let(words(c), lambda w: _windows(w, size, overlap))


def long_text(c: Column, cfg: LongTextConfig = LongTextConfig()) -> Column:
    """Struct(representation, strategy, chunks_processed, original_tokens)."""
    clean = strip(F.coalesce(c, F.lit("")))

    def shortened(chunks: Column) -> Column:
        head = F.slice(chunks, 1, cfg.max_chunks - 1)
        picked = F.when(F.size(chunks) <= cfg.max_chunks, chunks).otherwise(
            F.concat(head, F.slice(chunks, -1, 1))
        )
        parts = F.transform(
            picked, lambda t: F.array_join(F.slice(F.split(t, " "), 1, cfg.head_words), " ")
        )
        return F.array_join(parts, " [...] ")

    def result(w: Column) -> Column:
        direct = F.size(w) <= cfg.max_direct
        none = F.array().cast("array<string>")
        chunks = F.when(direct, none).otherwise(_windows(w, cfg.chunk, cfg.overlap))

        def describe(ch: Column) -> Column:
            return F.struct(
                F.when(direct, clean).otherwise(shortened(ch)).alias("representation"),
                F.when(direct, F.lit("direct")).otherwise(F.lit("chunk_summary")).alias("strategy"),
                F.size(ch).cast("bigint").alias("chunks_processed"),
                F.size(w).cast("bigint").alias("original_tokens"),
            )

        return let(chunks, describe)

    return let(words(c), result)


def fingerprint(c: Column) -> Column:
    """Cache key of a text (X11)."""
    return F.sha2(strip(c), 256)


def message_text(content: Column) -> Column:
    """Text of a chat message given as JSON: plain string or list of parts."""
    parts = F.from_json(content, "array<string>")
    texts = F.transform(
        parts,
        lambda p: F.when(
            F.get_json_object(p, "$.type") == "text",
            F.coalesce(F.get_json_object(p, "$.text"), F.lit("")),
        ).when(~p.startswith("{"), p),
    )
    return F.when(
        strip(content).startswith("["),
        F.coalesce(F.array_join(F.filter(texts, lambda t: t.isNotNull()), " "), F.lit("")),
    ).otherwise(F.coalesce(content, F.lit("")))


def extract_json(reply: Column) -> Column:
    """JSON text inside a model reply: drop reasoning, prefer a fenced block."""
    text = strip(F.regexp_replace(reply, r"(?s)<think>.*?</think>", ""))
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\}|\[.*?\])\s*```", 1)
    bare = F.regexp_extract(text, r"(?s)(\{.*\}|\[.*\])", 1)
    found = F.nullif(F.when(fenced != "", fenced).otherwise(bare), F.lit(""))
    # Kept only when it parses.
    return F.when(F.try_parse_json(found).isNotNull(), found)
