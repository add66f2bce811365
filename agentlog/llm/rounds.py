"""Grouping texts that share buckets, without ever listing all pairs of a bucket.

Rows of `members`: bucket, row, size (of the bucket), root (component so far) and the
columns `carry` that the pair filter needs. Large buckets are dealt into small cells, which
joins large groups after a round; then only pairs still in different components are listed.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from agentlog.llm.common import store
from agentlog.llm.components import components

#: Bits of the filter that thins rows before a join on wanted keys: 2^22 bits are 65,536
#: rows of a broadcast table, whatever the data.
FILTER_BITS = 22


def _side(members: DataFrame, side: str, keys: Sequence[str], carry: Sequence[str]) -> DataFrame:
    return members.select(
        *keys, F.col("row").alias(side), F.col("root").alias(f"root_{side}"),
        *[F.col(c).alias(f"{c}_{side}") for c in carry],
    )


def cell_pairs(members: DataFrame, cell: int, carry: Sequence[str], fits: Column) -> DataFrame:
    """Pairs (a, b) of different components that meet in a cell. A bucket of n rows is dealt
    into n / cell cells, each bucket in its own way, so pairs grow with the rows; a small
    bucket is one cell. Pairs that no cell lists are left to `open_members`, which takes every
    larger bucket that still holds several components."""
    cells = F.ceil(F.col("size") / cell)
    dealt = members.withColumn("cell", F.pmod(F.xxhash64("bucket", "row"), cells))
    keys = ["bucket", "cell"]
    return (
        _side(dealt, "a", keys, carry).join(_side(dealt, "b", keys, carry), keys)
        .filter((F.col("a") < F.col("b")) & (F.col("root_a") != F.col("root_b")) & fits)
        .select("a", "b").distinct()
    )


def open_members(members: DataFrame, cell: int) -> DataFrame:
    """Members of buckets that cells did not list whole and that still hold several
    components, with `main`, the bucket's largest component."""
    sizes = members.filter(F.col("size") > cell).groupBy("bucket", "root").agg(
        F.count(F.lit(1)).alias("n_root")
    )
    main = sizes.groupBy("bucket").agg(
        F.max_by("root", F.struct("n_root", "root")).alias("main"),
        F.count(F.lit(1)).alias("roots"),
    ).filter("roots > 1").drop("roots")
    return members.join(main, "bucket")


def block_groups(apart: DataFrame, block_rows: int, block_size: int) -> DataFrame:
    """(group, row, root): groups of bounded size in which every two rows of an open bucket
    meet that may join two of its components; none is left out.

    Rows of a bucket's largest component are one already, so only rows outside it look for
    others. Both kinds are cut into blocks of `block_rows` rows and a sum of `n` of
    `block_size`; a block of rows outside meets every block.
    """
    outside = F.col("root") != F.col("main")

    def blocks(kind: Column) -> Column:
        rows = F.count_if(kind) / block_rows
        return F.ceil(F.greatest(rows, F.sum(F.when(kind, F.col("n"))) / block_size)).cast("int")

    counts = apart.groupBy("bucket").agg(blocks(outside).alias("n_outside"), blocks(~outside).alias("n_main"))
    whole = F.col("n_outside") + F.col("n_main")
    deal = F.xxhash64("row")
    own = F.when(outside, F.pmod(deal, F.col("n_outside"))).otherwise(
        F.col("n_outside") + F.pmod(deal, F.col("n_main"))
    ).cast("int")
    last = F.when(outside, whole).otherwise(F.col("n_outside")) - 1
    return (
        apart.join(counts, "bucket")
        .select("bucket", "row", "root", own.alias("own"), F.explode(F.sequence(F.lit(0), last)).alias("other"))
        .select(F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other")).alias("group"), "row", "root")
    )


def group_rows(
    members: DataFrame, verify: Callable[[DataFrame], DataFrame],
    late_links: Callable[[DataFrame], DataFrame], fits: Column,
    carry: Sequence[str] = (), cell: int = 4, steps: Sequence[Column] = (),
) -> DataFrame:
    """(node, root) of all rows that a verified link joins. `verify` keeps the true links of
    a stored table of pairs; `late_links` finds the links between components in a stored
    table of `open_members`.

    `steps` are conditions that deal the buckets into steps. Each step pairs only rows that
    earlier steps left in different components and links components instead of rows, so a
    large group costs a few links a row, however many of its buckets it shares.
    """
    labels: DataFrame | None = None
    for step in steps or [F.lit(True)]:
        pairs = store(cell_pairs(_rooted(members.filter(step), labels), cell, carry, fits), "pairs")
        labels = _joined(labels, store(verify(pairs), "links"))
    apart = store(open_members(_rooted(members, labels), cell), "open")
    late = store(late_links(apart), "links")
    return labels if late.isEmpty() else _joined(labels, late)


def _rooted(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return members.withColumn("root", F.col("row"))
    return (
        members.join(labels.withColumnRenamed("node", "row"), "row", "left")
        .withColumn("root", F.coalesce("root", "row"))
    )


def _joined(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """Labels after more links, which are first drawn between components."""
    if labels is None:
        return components(links)
    for side in "ab":
        links = (
            links.join(labels.select(F.col("node").alias(side), "root"), side, "left")
            .withColumn(side, F.coalesce("root", side)).drop("root")
        )
    merged = components(links.distinct())
    moved = labels.select("node", F.col("root").alias("via")).join(
        merged.select(F.col("node").alias("via"), "root"), "via", "left"
    ).select("node", F.coalesce("root", "via").alias("root"))
    new = merged.join(labels.select("node"), "node", "left_anti")
    return store(moved.unionByName(new), "labels")


def marked(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """`rows` with `__maybe`: false only if the key is surely not in `wanted`.

    A bitmap of the wanted keys' hashes, of fixed size, is broadcast. So a join with few
    wanted keys need not shuffle all rows.
    """
    place = F.shiftrightunsigned(F.xxhash64(key), 64 - FILTER_BITS)
    slot = F.shiftright(place, 6)
    powers = [(1 << i) - (1 << 64) * (i == 63) for i in range(64)]
    bit = F.element_at(F.array(*[F.lit(x) for x in powers]), (place % 64 + 1).cast("int"))
    bitmap = wanted.select(slot.alias("__slot"), bit.alias("__bit")).groupBy("__slot").agg(
        F.bit_or("__bit").alias("__bits")
    )
    found = F.coalesce("__bits", F.lit(0)).bitwiseAND(bit) != 0
    return (
        rows.withColumn("__slot", slot).join(F.broadcast(bitmap), "__slot", "left")  # 2^16 rows at most
        .withColumn("__maybe", found).drop("__slot", "__bits")
    )


def thinned(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """`rows` without most of those whose key is not in `wanted`; an exact join must follow."""
    return marked(rows, key, wanted).filter("__maybe").drop("__maybe")
