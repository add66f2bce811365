import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
        T.StructField("source", T.StringType()), T.StructField("kept", T.StringType()),
        T.StructField("shard", T.StringType()), T.StructField("taken", T.StringType()),
        T.StructField("sequence_id", T.StringType()), T.StructField("spans", T.StringType()),
    ]
)


def frame(spark, rows):
    """Documents (doc_id, text, source) with extra columns whose names clash with results."""
    return spark.createDataFrame([(*r, "x", "x", "x", "x", "x") for r in rows], SCHEMA)


PROSE = " ".join(f"word{i}" for i in range(60)) + "."
AWKWARD = [
    (1, None, "a"), (2, "", "a"), (3, " \t\n ", None), (None, PROSE, "b"), (5, PROSE, None),
    (5, PROSE, None), (6, PROSE.replace(" ", "  "), "b"), (7, "ä ß 日本語 “x” \x0b\x0c", ""),
    (8, "long " * 60_000, "b"), (9, "x" * 200_000, "a"), (9, "other text", "a"),
]


@pytest.fixture(scope="session")
def awkward(spark):
    return frame(spark, AWKWARD)


@pytest.fixture(scope="session")
def empty(spark):
    return frame(spark, [])
