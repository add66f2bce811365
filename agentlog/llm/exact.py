"""Exact duplicates by composable polynomial fingerprints.

The fingerprint of a byte string is its value as a number in base 256, modulo a prime. It
composes: fp(a + b) = fp(a) * 256^len(b) + fp(b), so chunks of a huge text are hashed on
their own and combined by length-shifted arithmetic. Equal fingerprints are only a
hint: the texts behind them are then compared chunk by chunk.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from agentlog.llm.common import SPACE, fresh, store, text_or_empty

#: Largest prime below 2^62. Not a Mersenne prime: there, powers of 256 repeat after 61 bytes.
PRIME = (1 << 62) - 57
CHUNK_BYTES = 1 << 16
BLANKS = b" \t\n\x0b\x0c\r"
PRINT_TYPE = T.StructType(
    [
        T.StructField("fp", T.LongType()), T.StructField("n_bytes", T.LongType()),
        T.StructField("sha256", T.StringType()),
    ]
)


def normalise(raw: bytes) -> bytes:
    """Every run of white space becomes one space; ends are kept as spaces."""
    if not raw:
        return raw
    inner = b" ".join(raw.split())
    if not inner:
        return b" "
    return b" " * (raw[:1] in BLANKS) + inner + b" " * (raw[-1:] in BLANKS)


def chunk_print(chunk: bytes, prime: int = PRIME) -> tuple[int, int]:
    """Fingerprint and length of one chunk."""
    return int.from_bytes(chunk, "big") % prime, len(chunk)


def combine(
    left: tuple[int, int], right: tuple[int, int], prime: int = PRIME
) -> tuple[int, int]:
    """Fingerprint of the concatenation of two pieces."""
    return (left[0] * pow(256, right[1], prime) + right[0]) % prime, left[1] + right[1]


def fingerprint(
    data: bytes, chunk_bytes: int = CHUNK_BYTES, prime: int = PRIME
) -> tuple[int, int]:
    total = (0, 0)
    for at in range(0, len(data), chunk_bytes):
        total = combine(total, chunk_print(data[at : at + chunk_bytes], prime), prime)
    return total


def _prints(chunk_bytes: int, prime: int):
    @F.arrow_udf(PRINT_TYPE)
    def prints(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            fp, size, sha = [], [], []
            for value in batch.cast(pa.large_binary()):
                data = normalise(value.as_py() or b"")
                number, length = fingerprint(data, chunk_bytes, prime)
                fp.append(number)
                size.append(length)
                sha.append(hashlib.sha256(data).hexdigest())
            yield pa.StructArray.from_arrays(
                [pa.array(fp, pa.int64()), pa.array(size, pa.int64()), pa.array(sha, pa.string())],
                ["fp", "n_bytes", "sha256"],
            )

    return prints


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    chunk_bytes: int = CHUNK_BYTES, prime: int = PRIME,
) -> DataFrame:
    """All rows of `docs` with keep_id, group_size, kept and text_sha256.

    Texts are equal when identical after each run of white space is made one space; null
    counts as empty. Of equal texts the row with the smallest id stays (null ids last); of
    repeated rows with that id exactly one stays. An empty table gives an empty result;
    columns of `docs` named like the new ones are replaced.

    Rows are stored once with a row number and their fingerprint. Groups are counted on
    slim rows with partial aggregation, so a group of copies of any size is a few numbers
    per task. Only texts whose fingerprint repeats are compared: each chunk place of a
    group is reduced to its smallest and largest chunk. Where these differ (a collision),
    the group is divided by whole texts.
    """
    names = ["keep_id", "group_size", "kept", "text_sha256"]
    docs = docs.drop(*names)
    row, fp, size, found = (fresh(docs, n) for n in ("__row", "__fp", "__bytes", "__print"))
    stored = store(
        docs.withColumn(found, _prints(chunk_bytes, prime)(text_or_empty(text_col)))
        .withColumn(row, F.monotonically_increasing_id())
        .select(
            "*", F.col(found)["fp"].alias(fp), F.col(found)["n_bytes"].alias(size),
            F.col(found)["sha256"].alias("text_sha256"),
        ).drop(found),
        "fingerprints",
    )
    key = [fp, size]
    slim = stored.select(row, F.col(id_col).alias("__id"), *key)
    repeated = slim.groupBy(*key).agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1").drop("__n")

    # chunkwise comparison of the texts behind repeated fingerprints
    flat = F.regexp_replace(text_or_empty(text_col), SPACE, " ")
    candidates = store(
        stored.select(row, *key, text_col).join(repeated, key, "left_semi").select(
            row, *key, F.encode(flat, "utf-8").alias("__data")
        ),
        "candidates",
    )
    chunks = candidates.select(
        *key,
        F.posexplode(
            F.transform(
                F.sequence(F.lit(0), F.floor((F.col(size) - 1) / chunk_bytes).cast("int")),
                lambda i: F.substring(F.col("__data"), i * chunk_bytes + 1, F.lit(chunk_bytes)),
            )
        ).alias("__no", "__chunk"),
    ).filter(F.col(size) > 0)
    differing = store(
        chunks.groupBy(*key, "__no")
        .agg((F.min("__chunk") != F.max("__chunk")).alias("__differ"))
        .filter("__differ").select(*key).distinct(),
        "collisions",
    )
    classed = slim.withColumn("__class", F.lit(-1).cast("long"))
    if not differing.isEmpty():  # groups with a collision are divided by the texts themselves
        by_text = candidates.join(differing, key, "left_semi")
        firsts = by_text.groupBy(*key, "__data").agg(F.min(row).alias("__first"))
        divided = by_text.join(firsts, [*key, "__data"]).select(row, "__first")
        classed = slim.join(divided, row, "left").withColumn(
            "__class", F.coalesce("__first", F.lit(-1))
        ).drop("__first")
    group = [*key, "__class"]
    best = F.min(F.struct(F.col("__id").isNull().alias("no_id"), F.col("__id"), F.col(row)))
    groups = classed.groupBy(*group).agg(
        F.count(F.lit(1)).alias("group_size"), best.alias("__best")
    )
    decided = classed.join(groups, group).select(
        row, F.col("__best.__id").alias("keep_id"), "group_size",
        (F.col(row) == F.col(f"__best.{row}")).alias("kept"),
    )
    return stored.join(decided, row).drop(row, *key)
