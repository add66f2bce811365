"""Rounding, shares and text-to-number conversion as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from agentlog.functions.text import strip

MINUTES_TYPE = "decimal(18,4)"

_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def round_to(x: Column, digits: int) -> Column:
    """Half away from zero on the scaled double; the one rounding rule of this library."""
    scale = float(10**digits)
    x = x.cast("double")
    return F.signum(x) * F.floor(F.abs(x) * scale + F.lit(0.5)) / F.lit(scale)


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    """`part` of `whole` in percent; 0 when the whole is 0 or missing."""
    ratio = part.cast("double") / F.nullif(whole.cast("double"), F.lit(0.0)) * 100.0
    return F.coalesce(round_to(ratio, digits), F.lit(0.0))


def safe_div(a: Column, b: Column) -> Column:
    """a / b, null when b is 0."""
    return a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))


def parse_double(c: Column) -> Column:
    """Text to double; anything that is not a plain finite number becomes null."""
    text = strip(c.cast("string"))
    return F.when(text.rlike(_NUMBER), text.try_cast("double"))


def parse_long(c: Column) -> Column:
    """Text to whole number, cutting the fraction off toward zero."""
    return parse_double(c).try_cast("bigint")


def one_digit(c: Column) -> Column:
    """A rounded value as text with exactly one digit after the point."""
    return c.cast("decimal(20,1)").cast("string")


def short_decimal(c: Column) -> Column:
    """A two-digit value as text without a trailing zero in the second place."""
    return F.regexp_replace(c.cast("decimal(20,2)").cast("string"), "0$", "")


def money_text(c: Column) -> Column:
    """Compact amount for headlines."""
    size = F.abs(c)
    # Halves go to the even neighbour before printing.
    return (
        F.when(size >= 1e6, F.format_string("%.1f млн ₽", F.bround(c / 1e6, 1)))
        .when(size >= 1e3, F.format_string("%.0f тыс ₽", F.bround(c / 1e3, 0)))
        .otherwise(F.format_string("%.0f ₽", F.bround(c, 0)))
    )
