"""Global shuffle into shards: a two-pass external shuffle in DataFrame operations.

Pass one scatters every record to a bucket that fits in memory, by a seeded hash of its
place in the table. Pass two runs Fisher-Yates (Spark's `shuffle`) over each bucket. Every order of the
records is equally likely; nothing larger than one bucket is ever held.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from agentlog.llm.common import fresh, store

#: Bytes of one bucket. With 128 MB buckets and matching executors 100 TB are 800,000 tasks.
BUCKET_BYTES = 16 << 20
ROW_BYTES = 8
#: Buckets whose counts are summed by one task when starts of buckets are computed.
SPAN = 4096


def row_bytes(text: Column) -> Column:
    """UTF-8 bytes of a text (null: none) plus eight."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + ROW_BYTES


def two_pass_shuffle(
    df: DataFrame, size: Column, n_shards: int, seed: int = 0, bucket_bytes: int = BUCKET_BYTES,
) -> DataFrame:
    """All rows and columns of `df` with their shard and the slot in it.

    The shuffled stream is cut into `n_shards` runs whose lengths differ by one at most
    (the law `rows`); slots count from 0 without gaps. Repeated rows and rows with equal
    keys scatter on their own, because the hash takes the row's place and not its content.
    An empty table gives an empty result; shards without a row do not appear. Columns of
    `df` named shard or slot are replaced.

    The scattered rows are stored, so counting and shuffling see the same buckets and a
    repeated task writes the same rows. `size` is the memory a row needs, in bytes.
    """
    df = df.drop("shard", "slot")
    bucket, order = fresh(df, "__bucket"), fresh(df, "__order")
    total = df.agg(F.sum(size)).head()[0] or 0
    n_buckets = max(1, math.ceil(total / bucket_bytes))
    place = F.xxhash64(F.lit(seed), F.monotonically_increasing_id())
    scattered = store(
        df.withColumn(order, place)
        .withColumn(bucket, F.pmod(order, F.lit(n_buckets)).cast("int")),
        "scattered",
    )
    counts = scattered.groupBy(bucket).agg(F.count(F.lit(1)).alias("__n"))
    starts = _starts(counts, bucket)
    n_rows = counts.agg(F.sum("__n")).head()[0] or 0
    wide, n_wide = n_rows // n_shards + 1, n_rows % n_shards  # the first n_wide shards

    whole = F.struct(*[F.col(c) for c in df.columns])
    shuffled = (
        scattered.repartitionById(n_buckets, F.col(bucket))
        .sortWithinPartitions(order)  # rows arrive in any order; the same seed gives the same shards
        .groupBy(bucket).agg(F.collect_list(whole).alias("__rows"))
        .select(bucket, F.posexplode(F.shuffle("__rows", F.lit(seed))).alias("__at", "__row"))
    )
    place = F.col("__start") + F.col("__at")
    after = place - wide * n_wide
    narrow = max(wide - 1, 1)
    return (
        shuffled.join(starts, bucket)
        .withColumn(
            "shard",
            F.when(after < 0, F.floor(place / wide))
            .otherwise(n_wide + F.floor(after / narrow)).cast("int"),
        )
        .withColumn(
            "slot", F.when(after < 0, place % wide).otherwise(after % narrow).cast("long")
        )
        .select("__row.*", "shard", "slot")
    )


def _starts(counts: DataFrame, bucket: str) -> DataFrame:
    """First position of each bucket. Sums per span first, so no task sees all buckets."""
    spans = counts.withColumn("__span", F.floor(F.col(bucket) / SPAN))
    sums = spans.groupBy("__span").agg(F.sum("__n").alias("__sum"))
    before = Window.orderBy("__span").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("__span", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__base"))
    inside = Window.partitionBy("__span").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return (
        spans.withColumn("__inside", F.coalesce(F.sum("__n").over(inside), F.lit(0)))
        .join(bases, "__span")
        .select(bucket, (F.col("__base") + F.col("__inside")).alias("__start"))
    )


def write_shards(shuffled: DataFrame, path: str) -> None:
    """Write a shuffled table as one folder per shard, rows with their slot."""
    shuffled.write.partitionBy("shard").parquet(path)
