"""Fuzzy line deduplication: MinHash over character shingles, banding, exact Jaccard,
distributed union-find.

A shingle is any ten characters in a row; a shorter line is one shingle. Runs of white space
count as one space. Spark splits, groups, joins and shuffles; numpy inside Arrow batches
hashes shingles, takes minima (of 32-bit hashes) and compares, by 44 bits of 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from agentlog.llm.common import store, text_or_empty
from agentlog.llm.neardup import GOLD, mixed
from agentlog.llm.rounds import block_groups, group_rows, thinned

BASE = np.uint64(0x9FB21C651E98DF25)
BASE_32 = np.uint32(0x9E3779B1)
#: Characters that are hashed at once: bounds a worker's memory for lines of any length.
CHUNK = 1 << 16
PAIR_BITS = 20


@dataclass(frozen=True)
class LineRules:
    """At similarity 0.8 a pair meets in one of 8 bands of 3 minima with chance 0.997."""

    shingle: int = 10
    bands: int = 8
    rows: int = 3
    similarity: float = 0.8
    cell: int = 4
    #: Rows and characters of one block of a large bucket, columns of one matrix product.
    block_rows: int = 128
    block_chars: int = 250_000
    columns: int = 4096


def windows(lines: Sequence[str], k: int, base: np.unsignedinteger) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A number for every k characters in a row of all lines joined, with the place of each
    line's first and how many it has; those between reach into the next line."""
    kind = type(base)
    padded = [line.ljust(k, "\n") for line in lines]  # no line holds a line feed
    sizes = np.fromiter(map(len, padded), np.int64, len(padded))
    codes = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), "<u4").astype(kind, copy=False)
    n = len(codes) - k + 1
    # a polynomial of k characters from those of 1, 2, 4 ... characters
    out, done, power, width, scale = np.zeros(n, kind), 0, codes, 1, int(base)
    while True:
        if k & width:
            out *= kind(scale)
            out += power[done : done + n]
            done += width
        if done == k:
            return out, np.cumsum(sizes) - sizes, sizes - k + 1
        power = power[:-width] * kind(scale) + power[width:]
        width, scale = 2 * width, scale * scale & int(np.iinfo(kind).max)


def shingles(lines: Sequence[str], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of all lines, line after line, and the number of each line's."""
    out, starts, sizes = windows(lines, k, BASE)
    inside = np.ones(len(out), bool)
    inside[(starts[1:, None] - np.arange(1, k)).ravel()] = False
    return mixed(out[inside]), sizes


def mixed_32(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 32-bit numbers."""
    x = (x ^ (x >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    x = (x ^ (x >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return x ^ (x >> np.uint32(16))


def chunks(lines: Sequence[str], k: int) -> Iterator[tuple[list[int], list[str]]]:
    """(numbers, texts) of bounded size. A longer line comes in pieces that overlap, each in a
    chunk of its own, so that no shingle is lost."""
    numbers, texts, size = [], [], 0
    for number, line in enumerate(lines):
        for at in range(0, max(1, len(line) - k + 1), CHUNK):
            piece = line[at : at + CHUNK + k - 1]
            if texts and (at or size + len(piece) > CHUNK):
                yield numbers, texts
                numbers, texts, size = [], [], 0
            numbers.append(number)
            texts.append(piece)
            size += len(piece)
    if texts:
        yield numbers, texts


def bucket_numbers(lines: Sequence[str], rules: LineRules) -> np.ndarray:
    """One row per line, one column per band: the hash of the band's minima. Each minimum is
    that of 32-bit hashes after multiplication by an odd number of its own."""
    n = rules.bands * rules.rows
    factors = (mixed(np.arange(1, n + 1, dtype=np.uint64) * GOLD) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    minima = np.full((n, len(lines)), np.iinfo(np.uint32).max, np.uint32)
    for numbers, texts in chunks(lines, rules.shingle):
        hashes, starts, sizes = windows(texts, rules.shingle, BASE_32)
        hashes = mixed_32(hashes)
        ends = np.stack([starts, starts + sizes], axis=1).ravel()[:-1]
        product = np.empty_like(hashes)
        for i, factor in enumerate(factors):
            low = np.minimum.reduceat(np.multiply(hashes, factor, out=product), ends)[::2]
            minima[i, numbers] = np.minimum(minima[i, numbers], low)
    out = np.empty((len(lines), rules.bands), np.uint64)
    for band in range(rules.bands):
        value = np.full(len(lines), np.uint64(band + 1))
        for low in minima[band * rules.rows : (band + 1) * rules.rows]:
            value = mixed(value * GOLD + low)
        out[:, band] = value
    return out.view(np.int64)


def similar(left: Sequence[str], right: Sequence[str], rules: LineRules) -> np.ndarray:
    """Whether the n-th lines of both sides reach the similarity, for at most 2^20 pairs."""

    def tagged(lines: Sequence[str]) -> np.ndarray:
        """Each line's different shingles, tagged with its number."""
        hashes, sizes = shingles(lines, rules.shingle)
        owner = np.repeat(np.arange(len(lines), dtype=np.uint64), sizes)
        tags = np.sort((owner << np.uint64(64 - PAIR_BITS)) | (hashes >> np.uint64(PAIR_BITS)))
        return tags[np.r_[True, tags[1:] != tags[:-1]]]

    def counted(tags: np.ndarray) -> np.ndarray:
        return np.bincount((tags >> np.uint64(64 - PAIR_BITS)).astype(np.int64), minlength=len(left))

    a, b = tagged(left), tagged(right)
    both = np.sort(np.concatenate([a, b]))
    common = counted(both[1:][both[1:] == both[:-1]])
    return common >= rules.similarity * (counted(a) + counted(b) - common)


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, line_no, line, key): lines with more than white space, trimmed, each run of white
    space as one space."""
    line, space = F.col("line"), " \t\x0b\x0c\r"
    # most texts have single spaces only, which one look at the whole text tells
    odd = F.contains("text", F.lit("  "))
    for c in space[1:]:
        odd = odd | F.contains("text", F.lit(c))
    runs = F.btrim(F.regexp_replace(line, f"[{space}]+", " "), F.lit(" "))
    return (
        docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).withColumn("odd", odd)
        .select("id", "odd", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
        .withColumn("line", F.when(F.col("odd"), runs).otherwise(F.trim(line))).filter("line <> ''").drop("odd")
        .withColumn("key", F.unhex(F.md5("line")))
    )


def _sketches(lines: DataFrame, rules: LineRules) -> DataFrame:
    """(row, key, buckets) of each distinct line; `row` is the place of its first copy. Copies
    are reduced in their batch and then in their task, before the shuffle."""
    names = [f"b{i}" for i in range(rules.bands)]
    schema = "key binary, row long, " + ", ".join(f"{n} long" for n in names)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first: dict[bytes, int] = {}
            for at, key in enumerate(batch.column(0).to_pylist()):
                first.setdefault(key, at)
            once = batch.take(pa.array(list(first.values()), pa.int64()))
            buckets = bucket_numbers(once.column(2).to_pylist(), rules)
            columns = [once.column(0), once.column(1), *(pa.array(c) for c in np.ascontiguousarray(buckets.T))]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "row", *names])

    found = lines.select("key", F.col("place").alias("row"), "line").mapInArrow(sketch, schema)
    return found.groupBy("key").agg(F.min("row").alias("row"), *[F.min(n).alias(n) for n in names]).select(
        "row", "key", F.array(*names).alias("buckets")
    )


def _shared_buckets(sketches: DataFrame) -> DataFrame:
    """(bucket, band, row, size) of buckets with several rows. Counting and joining use one
    shuffle, so both need the same columns of it; only shared buckets are held for the join."""
    keys = ["bucket", "band"]
    spread = sketches.select("row", F.posexplode("buckets").alias("band", "bucket")).repartition(*keys)
    shared = (
        spread.groupBy(*keys).agg(F.count(F.lit(1)).alias("size"), F.min("row").alias("low"), F.max("row").alias("high"))
        .filter("low < high").select(*keys, "size")
    )
    return spread.join(shared.hint("shuffle_hash"), keys)


def _verified(pairs: DataFrame, texts: DataFrame, rules: LineRules) -> DataFrame:
    """The pairs (a, b) whose lines are similar enough."""
    left, right = (texts.select(F.col("row").alias(x), F.col("line").alias(f"line_{x}")) for x in "ab")
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "line_a", "line_b")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = (batch.column(i).to_pylist() for i in (2, 3))
            keep, at = [], 0
            while at < len(left):
                end, size = at, 0
                while end < len(left) and (end == at or size + len(left[end]) + len(right[end]) <= 2 * CHUNK):
                    size += len(left[end]) + len(right[end])
                    end += 1
                keep.append(similar(left[at:end], right[at:end], rules))
                at = end
            yield batch.select(["a", "b"]).filter(pa.array(np.concatenate(keep) if keep else [], pa.bool_()))

    return both.mapInArrow(compare, "a long, b long")


def linked_lines(rows: Sequence[tuple[int, int, str]], rules: LineRules) -> list[tuple[int, int]]:
    """Similar pairs among (row, root, line) that join different roots, as a forest. Common
    shingles of all pairs are counted by products of matrices of bounded width."""
    if len({root for _, root, _ in rows}) < 2:
        return []
    hashes, sizes = shingles([line for _, _, line in rows], rules.shingle)
    owner = np.repeat(np.arange(len(rows)), sizes)
    values, place = np.unique(hashes, return_inverse=True)
    cells = np.sort(place * len(rows) + owner)
    cells = cells[np.r_[True, cells[1:] != cells[:-1]]]  # each shingle of a line once, by shingle
    place, owner = np.divmod(cells, len(rows))
    sizes = np.bincount(owner, minlength=len(rows))
    several = np.bincount(place, minlength=len(values)) > 1  # only shingles of two lines or more count
    number = np.cumsum(several) - 1
    owner, place = owner[several[place]], number[place[several[place]]]
    common = np.zeros((len(rows), len(rows)), np.float64)
    for at in range(0, int(number[-1]) + 1, rules.columns):
        low, high = np.searchsorted(place, [at, at + rules.columns])
        marks = np.zeros((len(rows), rules.columns), np.float32)
        marks[owner[low:high], place[low:high] - at] = 1
        common += marks @ marks.T
    union = sizes[:, None] + sizes[None, :] - common
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    out = []
    for a, b in np.argwhere(np.triu(common >= rules.similarity * union, 1)).tolist():
        left, right = find(rows[a][1]), find(rows[b][1])
        if left != right:
            parent[left] = right
            out.append((min(rows[a][0], rows[b][0]), max(rows[a][0], rows[b][0])))
    return out


def _block_links(apart: DataFrame, texts: DataFrame, rules: LineRules) -> DataFrame:
    """Links between components inside open buckets, as `block_groups` deals them; only links
    leave a group."""
    groups = block_groups(apart, rules.block_rows, rules.block_chars)
    dealt = (
        groups.join(texts, "row").select("group", "row", "root", "line")
        .repartition("group").sortWithinPartitions("group", "row")
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, rows = None, []

        def links() -> pa.RecordBatch:
            found = linked_lines(rows, rules)
            return pa.RecordBatch.from_arrays(
                [pa.array([x[i] for x in found], pa.int64()) for i in range(2)], names=["a", "b"]
            )

        for batch in batches:
            for key, row, root, line in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if key != group:
                    yield links()
                    group, rows = key, []
                rows.append((row, root, line))
        yield links()

    return dealt.mapInArrow(compare, "a long, b long").distinct()


def line_classes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: LineRules = LineRules(),
) -> DataFrame:
    """One row per line with a word: id, line_no (from 0), class_id, class_line, class_size
    and kept.

    Lines are trimmed; runs of white space count as one space. A class is a connected component of links
    between lines of Jaccard similarity `rules.similarity` or more over their shingles,
    with all copies; class_id and class_line name its first line by id (null last) and
    number, which is the one kept. Null and empty texts and blank lines have no row.
    Repeated rows are copies of each other's lines. An empty table gives an empty result.
    """
    # split and hashed once; later steps read the columns they need
    lines = store(
        _lines(docs, id_col, text_col).select(F.monotonically_increasing_id().alias("place"), "*"), "lines"
    )
    sketches = store(_sketches(lines, rules), "line-sketches")
    met = store(_shared_buckets(sketches), "line-buckets")
    wanted = store(met.select("row").distinct(), "wanted")
    texts = store(  # only numbers are held for the join, so no text is sorted
        thinned(lines.select(F.col("place").alias("row"), "line"), "row", wanted)
        .join(wanted.hint("shuffle_hash"), "row", "left_semi"),
        "line-texts",
    )
    members = store(met.join(texts.select("row", F.length("line").cast("long").alias("n")), "row"), "line-members")

    def verify(pairs: DataFrame) -> DataFrame:
        return _verified(pairs, texts, rules)

    def late_links(apart: DataFrame) -> DataFrame:
        return _block_links(apart, texts, rules)

    # most rows of a large group meet in the first band; later ones find the rest
    steps = [F.col("band") < 1, F.col("band") > 0]
    labels = group_rows(members, verify, late_links, F.lit(True), (), rules.cell, steps)
    roots = sketches.select("row", "key").join(
        labels.withColumnRenamed("node", "row"), "row", "left"
    ).select("key", F.coalesce("root", "row").alias("root"))
    classed = lines.drop("line").join(roots, "key").drop("key")
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "line_no", "place")).alias("first")
    classes = classed.groupBy("root").agg(first, F.count(F.lit(1)).alias("class_size"))
    return classed.join(classes, "root").select(
        F.col("id").alias(id_col), "line_no", F.col("first.id").alias("class_id"),
        F.col("first.line_no").alias("class_line"), "class_size",
        (F.col("place") == F.col("first.place")).alias("kept"),
    )


def drop_repeated_lines(
    docs: DataFrame, classes: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """`docs` with the text of kept lines only. `docs` must have unique ids; documents left
    without a line keep an empty text."""
    gone = classes.filter("NOT kept").groupBy(F.col(id_col).alias("__id")).agg(
        F.collect_set("line_no").alias("__gone")
    )
    lines = F.split(text_or_empty(text_col), "\n")
    left = F.filter(lines, lambda line, i: ~F.array_contains("__gone", i))
    return (
        docs.join(gone, F.col(id_col).eqNullSafe(F.col("__id")), "left")
        .withColumn(text_col, F.when(F.col("__gone").isNull(), F.col(text_col)).otherwise(F.array_join(left, "\n")))
        .drop("__id", "__gone")
    )
