"""Raw upload records from JSON, JSONL, CSV and live folders, under one fixed schema.

Every reader yields the fields of `schemas.RAW` plus `is_object` (false for an array
element or line that is no JSON object).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from agentlog.functions.numeric import parse_double
from agentlog.functions.text import strip
from agentlog.schemas import RAW

WRAPPER_KEYS = ("records", "logs", "data", "items", "queries")
_CSV_NUMBERS = (
    "simulated_context_tokens", "total_tokens", "estimated_manual_time_minutes",
    "manual_time_minutes", "manual_time",
)


def parse_records(df: DataFrame, text: str = "value") -> DataFrame:
    """Columns of the raw schema out of one JSON object per row."""
    clean = strip(F.col(text))
    parsed = F.from_json(clean, RAW)
    is_object = clean.startswith("{") & F.try_parse_json(clean).isNotNull()
    return df.select(F.coalesce(is_object, F.lit(False)).alias("is_object"), parsed.alias("r")).select(
        "r.*", "is_object"
    )


def unwrap_records(df: DataFrame, text: str = "value") -> DataFrame:
    """One row per element of a JSON array, or of the first wrapper key that holds one."""
    body = strip(F.regexp_replace(F.col(text), "^﻿", ""))

    def listed(key: str) -> Column:
        part = F.get_json_object(body, f"$.{key}")
        return F.when(strip(part).startswith("["), part)

    array = F.when(body.startswith("["), body).otherwise(F.coalesce(*map(listed, WRAPPER_KEYS)))
    return df.select(F.explode(F.from_json(array, "array<string>")).alias("value"))


def read_raw(spark: SparkSession, path: str, fmt: str = "jsonl", multiline_csv: bool = True) -> DataFrame:
    """Raw records of a file or folder.

    JSONL splits by blocks and is the format for large inputs. A JSON array is one value
    per file and read by one task per file; so is CSV unless `multiline_csv` is off.
    """
    if fmt == "json":
        return parse_records(unwrap_records(spark.read.text(path, wholetext=True)))
    if fmt == "jsonl":
        lines = spark.read.text(path).withColumn("value", F.regexp_replace("value", "^﻿", ""))
        return parse_records(lines.where(strip(F.col("value")) != ""))
    if fmt == "csv":
        return _read_csv(spark, path, multiline_csv)
    raise ValueError(f"unknown format {fmt!r}")


def _read_csv(spark: SparkSession, path: str, multiline: bool) -> DataFrame:
    table = spark.read.csv(path, header=True, multiLine=multiline, escape='"', quote='"')
    present = {c.lstrip("﻿").strip(): c for c in table.columns}

    def column(name: str) -> Column:
        if name not in present:
            return F.lit(None).cast("string").alias(name)
        c = F.col(f"`{present[name]}`")
        if name in _CSV_NUMBERS:
            c = parse_double(c).cast("string")
        return c.alias(name)

    return table.select(*[column(f.name) for f in RAW.fields], F.lit(True).alias("is_object"))


def read_live(spark: SparkSession, folder: str) -> DataFrame:
    """Stream of live records: JSONL files arriving in a folder."""
    lines = spark.readStream.text(folder)
    return parse_records(lines.where(strip(F.col("value")) != ""))


def with_row_index(df: DataFrame, name: str = "row_idx") -> DataFrame:
    """Dense 0-based index in read order.

    One count per input partition is joined back as an offset; rows themselves are not
    shuffled. The input must be a plain scan, whose partitions are the same in both passes.
    """
    numbered = df.withColumn("__id", F.monotonically_increasing_id())
    part = F.shiftright("__id", 33).alias("__part")
    sizes = numbered.groupBy(part).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    offsets = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    # The broadcast side has one row per input partition, two numbers each.
    placed = numbered.withColumn("__part", F.shiftright("__id", 33)).join(F.broadcast(offsets), "__part")
    local = F.col("__id").bitwiseAND((1 << 33) - 1)
    return placed.withColumn(name, F.col("__offset") + local).drop("__id", "__part", "__offset")
