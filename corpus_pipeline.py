"""The corpus pipeline: documents to packed training sequences in five stages.

Every stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns
a DataFrame; `run` writes each result as Parquet in the shared folder and reads it again.
All stages but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from agentlog.llm import exact, mixing, neardup, packing, quality
from agentlog.llm.common import store, text_or_empty, word_count

CAPACITY = 2048


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the line-first rules, with their failed lines removed."""
    cleaned = quality.clean(docs).withColumns(
        {"text": F.col("clean_text"), "n_chars": F.length("clean_text").cast("long")}
    )
    # stored before the filter, which would else compute the verdict's inputs twice
    judged = store(cleaned.select(*docs.columns, F.col("kept").alias("__kept")), "judged")
    return judged.filter("__kept").select(docs.columns)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact.exact_dedup(docs).filter("kept").select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return neardup.drop_near_duplicates(docs).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, whole."""
    sized = store(
        docs.withColumn("__size", word_count(text_or_empty("text"))).withColumn(
            "__key", mixing.hash_key(3, F.col("doc_id"), F.col("text"))
        ),
        "sized",
    )
    mixed = mixing.mix(sized, "source", "__size", "__key", whole=True).filter("repeats > 0")
    times = F.sequence(F.lit(1).cast("long"), F.col("repeats"))
    return mixed.withColumn("__no", F.explode(times)).select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequence and offset."""
    vocabulary = public_tokenizers.path("word_bpe_49k.json")
    return packing.pack(packing.token_pieces(docs, vocabulary, CAPACITY), CAPACITY)


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_duplicates", exact_duplicates),
    ("near_duplicates", near_duplicates),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]

#: SQL expresses neither edit-sensitive classes nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
