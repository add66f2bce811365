"""Find secrets: fixed patterns, and values in credential context that are costly to guess.

The cost of a value is the least number of guesses (log10) over all ways to cut it into
dictionary words, dates, repeats, keyboard walks and stretches found only by brute force.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from agentlog.llm.common import text_or_empty

KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
    re.ASCII | re.IGNORECASE,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # a run of 32 or more is one match either way
#: A credential word, what may stand between, and the value; or the user part of a URL.
CONTEXT = re.compile(
    r"(?<![A-Za-z])(?:password|passwd|passphrase|passcode|pass|pwd|secret|token|api[_ -]?key|credentials?)"
    r"[\"']?[\x20\t]*(?::=|=>|[:=]|\x20is\x20|\x20was\x20)[\x20\t]*[\"']?([^\s\"'<>]+)"
    r"|://[^\s/:@]+:([^\s/@]+)@",
    re.ASCII | re.IGNORECASE,
)
HINTS = ("pass", "pwd", "secret", "token", "api", "credential", "://")
ROWS = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./", "abcdefghijklmnopqrstuvwxyz")
DATE = re.compile(r"(?:19|20)\d\d|\d{1,2}[-/._]?\d{1,2}[-/._]?(?:19|20)?\d\d|(?:19|20)\d\d[-/._]?\d\d[-/._]?\d\d")
LEET = str.maketrans("4@301!5$7", "aaeoiisst")
SPAN_TYPE = T.ArrayType(
    T.StructType(
        [
            T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()),
            T.StructField("end", T.LongType()), T.StructField("cost", T.DoubleType()),
        ]
    )
)
_SPAN_ARROW = pa.list_(
    pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("cost", pa.float64())])
)


@dataclass(frozen=True)
class Guesser:
    """Guess costs over a ranked word list: {word: rank}, small letters."""

    ranks: dict[str, int]
    longest: int = field(default=24)

    def cost(self, value: str) -> float:
        """Least log10 guesses of `value`; each further segment costs one binary choice."""
        n = len(value)
        best = [0.0] + [math.inf] * n
        low = value.lower()
        plain = low.translate(LEET)
        ends = _run_ends(value)
        for i in range(n):
            here = best[i] + (0.3 if i else 0.0)
            for end, cost in self._segments(value, low, plain, ends[i], i):
                if here + cost < best[end]:
                    best[end] = here + cost
            brute = best[i] + _brute(value[i])  # brute force goes on letter by letter
            if brute < best[i + 1]:
                best[i + 1] = brute
        return best[n]

    def _segments(
        self, value: str, low: str, plain: str, run_end: int, i: int
    ) -> Iterator[tuple[int, float]]:
        n = len(value)
        for end in range(i + 2, min(n, i + self.longest) + 1):
            word = low[i:end]
            rank, extra = self.ranks.get(word), 0.0
            if rank is None and plain[i:end] != word:
                rank, extra = self.ranks.get(plain[i:end]), 0.6
            if rank is not None:
                if value[i:end] != word:
                    extra += 0.3 if value[i].isupper() and value[i + 1 : end] == word[1:] else 0.9
                yield end, math.log10(rank + 1) + extra
        dated = DATE.match(value, i)
        if dated:
            yield dated.end(), math.log10(365.0 * 120) if dated.end() - i > 4 else math.log10(120)
        if run_end - i >= 3:
            yield run_end, _brute(value[i]) + math.log10(run_end - i)
        end = _walk_end(low, i)
        if end - i >= 3:
            yield end, math.log10(60.0 * 2 * (end - i))


def _run_ends(value: str) -> list[int]:
    """For every place the end of the run of equal letters around it."""
    ends = [len(value)] * len(value)
    for i in range(len(value) - 2, -1, -1):
        ends[i] = ends[i + 1] if value[i] == value[i + 1] else i + 1
    return ends


def _brute(letter: str) -> float:
    if letter.isdigit():
        return 1.0
    if letter.isalpha():
        return math.log10(26) if letter.isascii() else math.log10(100)
    return math.log10(33)


def _walk_end(low: str, i: int) -> int:
    """End of the longest keyboard or alphabet walk that starts at `i`, in one direction."""
    best = i + 1
    for row in ROWS:
        at = row.find(low[i])
        if at < 0:
            continue
        for step in (1, -1):
            end, place = i + 1, at + step
            while end < len(low) and 0 <= place < len(row) and low[end] == row[place]:
                end, place = end + 1, place + step
            best = max(best, end)
    return best


def find_spans(text: str, cost, least: float) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, cost) by start, then kind; base kinds have a null cost."""
    found: list[tuple[str, int, int, float | None]] = []
    low = text.lower()
    if any(hint in low for hint in HINTS):
        found += [
            ("assign", m.start(), m.end(), None) for m in ASSIGN.finditer(text) if len(m[2]) >= 8
        ]
    if "AKIA" in text:
        found += [
            ("access", m.start(), m.end(), None) for m in ACCESS.finditer(text) if len(m[0]) >= 16
        ]
    found += [("hex", m.start(), m.end(), None) for m in HEX.finditer(text)]
    if any(hint in low for hint in HINTS):
        base = sorted((s, e) for _, s, e, _ in found)
        for m in CONTEXT.finditer(text):
            group = 1 if m[1] is not None else 2
            value = m[group].rstrip(".,;:!?)]}")
            start = m.start(group)
            end = start + len(value)
            if not value or any(s <= start and end <= e for s, e in base):
                continue
            guesses = cost(value)
            if guesses >= least:
                found.append(("guess", start, end, guesses))
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


@lru_cache(maxsize=4)
def word_ranks(vocabulary: str) -> dict[str, int]:
    """Words of a BPE vocabulary file with word ends, ranked by their ids: merges made
    earlier are more frequent."""
    with open(vocabulary, encoding="utf-8") as f:
        ids = json.load(f)["model"]["vocab"]
    whole = sorted((i, w[:-4]) for w, i in ids.items() if w.endswith("</w>") and len(w) > 5)
    return {w: rank for rank, (_, w) in enumerate(whole, 1) if w.isalpha()}


def secret_spans(text: Column, vocabulary: str, least: float = 8.0) -> Column:
    """Array of spans (kind, start, end, cost) of a text, in code points, end exclusive."""

    @F.arrow_udf(SPAN_TYPE)
    def spans(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        cost = lru_cache(maxsize=100_000)(Guesser(word_ranks(vocabulary)).cost)
        for batch in texts:
            out = []
            for value in batch:
                rows = find_spans(value.as_py() or "", cost, least)
                out.append([dict(zip(("kind", "start", "end", "cost"), r)) for r in rows])
            yield pa.array(out, _SPAN_ARROW)

    return spans(text)


def scan(
    docs: DataFrame, vocabulary: str, text_col: str = "text", least: float = 8.0,
) -> DataFrame:
    """All rows of `docs` with `spans`, the secrets found in the whole text.

    Null and empty texts have none; repeated rows get equal results; an empty table gives an
    empty result; a column named spans is replaced. Values of the kind `guess` stand in
    credential context, are not inside a span of the base kinds and need at least
    10^`least` guesses. `vocabulary` must be readable on every executor.
    """
    return docs.drop("spans").withColumn(
        "spans", secret_spans(text_or_empty(text_col), vocabulary, least)
    )
