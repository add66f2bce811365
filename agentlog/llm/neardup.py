"""Near duplicates by Order MinHash.

Word k-mers are labelled with their occurrence number. A sketch takes the few smallest under
a random order and keeps them in text order, so two texts agree on a sketch when the same
k-mers stand in the same order: sensitive to edit similarity, not to shared words alone.
Texts that agree on sketches are candidates; a banded alignment of their k-mers decides.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from agentlog.llm.common import SPACE, store, text_or_empty
from agentlog.llm.rounds import block_groups, group_rows, marked, thinned

CACHE_WORDS = 500_000
MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
GOLD = np.uint64(0x9E3779B97F4A7C15)
#: Elements of one block of ranks: bounds a worker's memory for texts of any length.
BLOCK = 1 << 21


@dataclass(frozen=True)
class Omh:
    """Sizes of the sketch. At similarity 0.8 a sketch of three k-mers agrees with chance
    0.51, so one of 24 agrees with chance above 0.9999999."""

    k: int = 5
    picked: int = 3
    sketches: int = 24
    similarity: float = 0.8
    #: Expected members of one cell when a large bucket is dealt into cells.
    cell: int = 4
    #: Rows and k-mers of one block of a large bucket, columns of one matrix product.
    block_rows: int = 256
    block_kmers: int = 500_000
    columns: int = 4096


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    def __missing__(self, word: str) -> int:
        self[word] = number = int.from_bytes(
            hashlib.blake2b(word.encode(), digest_size=8).digest(), "little"
        )
        return number


def labelled_kmers(text: str, k: int, words: WordHashes) -> np.ndarray:
    """Hashes of the k-mers of a text with single spaces, in text order, each different:
    the occurrence number is part of it. A text of fewer than `k` words is one k-mer."""
    if not text:
        return np.zeros(0, np.uint64)
    if len(words) > CACHE_WORDS:
        words.clear()
    tokens = text.split(" ")
    numbers = np.fromiter(map(words.__getitem__, tokens), np.uint64, len(tokens))
    n = max(1, len(numbers) - k + 1)
    out = np.full(n, np.uint64(min(k, len(numbers))))
    for i in range(min(k, len(numbers))):
        out = mixed(out * GOLD + numbers[i : i + n])
    order = np.argsort(out, kind="stable")
    ranked = out[order]
    same = np.r_[False, ranked[1:] == ranked[:-1]]
    if same.any():
        run_start = np.maximum.accumulate(np.where(same, 0, np.arange(n)))
        out[order] = mixed(ranked + (np.arange(n) - run_start).astype(np.uint64) * GOLD)
    return out


def order_sketches(kmers: np.ndarray, omh: Omh) -> np.ndarray:
    """One number per sketch: the smallest k-mers of a random order, joined in text order."""
    seeds = mixed(np.arange(1, omh.sketches + 1, dtype=np.uint64) * GOLD)
    picked = min(omh.picked, len(kmers))
    out = np.empty(omh.sketches, np.uint64)
    step = max(1, BLOCK // max(1, len(kmers)))
    for at in range(0, omh.sketches, step):
        ranks = mixed(kmers[None, :] ^ seeds[at : at + step, None])
        if picked < len(kmers):
            places = np.argpartition(ranks, picked - 1, axis=1)[:, :picked]
        else:
            places = np.tile(np.arange(len(kmers)), (len(ranks), 1))
        chosen = kmers[np.sort(places, axis=1)]
        value = seeds[at : at + step].copy()
        for i in range(picked):
            value = mixed(value * GOLD + chosen[:, i])
        out[at : at + step] = value
    return out.view(np.int64)


def aligned_similarity(a: np.ndarray, b: np.ndarray, least: float) -> float:
    """Matched k-mers in common order over all k-mers of both texts.

    The alignment is banded: for a similarity of `least` or more, matched places differ by
    no more than the k-mers that may stay unmatched. Below `least` any lower value may be
    returned.
    """
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    _, at_a, at_b = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    total = len(a) + len(b)
    band = total - 2 * least * total / (1 + least)
    near = np.abs(at_a - at_b) <= band
    at_a, at_b = at_a[near], at_b[near]
    if len(at_a) < least * (total - len(at_a)):
        return len(at_a) / (total - len(at_a)) if len(at_a) else 0.0
    places = at_b[np.argsort(at_a)]
    matched = len(places)
    if matched and not (np.diff(places) > 0).all():
        ends: list[int] = []
        for place in places.tolist():
            at = bisect.bisect_left(ends, place)
            ends[at : at + 1] = [place]
        matched = len(ends)
    return matched / (total - matched)


# Spark side

def _flat(text_col: str) -> Column:
    return F.trim(F.regexp_replace(text_or_empty(text_col), SPACE, " "))


def _sketch_table(rows: DataFrame, omh: Omh) -> DataFrame:
    """(row, id, key, n, sketch) from (row, id, key, text)."""
    schema = T.StructType(
        [
            T.StructField("row", T.LongType()), rows.schema["id"], rows.schema["key"],
            T.StructField("n", T.LongType()), T.StructField("sketch", T.ArrayType(T.LongType())),
        ]
    )

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for batch in batches:
            sizes, found = [], []
            for text in batch.column(3):
                kmers = labelled_kmers(text.as_py(), omh.k, words)
                sizes.append(len(kmers))
                found.append(order_sketches(kmers, omh) if len(kmers) else None)
            columns = [
                *(batch.column(i) for i in range(3)),
                pa.array(sizes, pa.int64()), pa.array(found, pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "id", "key", "n", "sketch"])

    return rows.mapInArrow(sketch, schema)


def _verified(pairs: DataFrame, texts: DataFrame, omh: Omh) -> DataFrame:
    """The pairs (a, b) whose texts align well enough."""
    right = pairs.join(texts.select(F.col("row").alias("b"), F.col("text").alias("text_b")), "b")
    both = right.join(texts.select(F.col("row").alias("a"), F.col("text").alias("text_a")), "a")

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        last, left = None, None  # rows come sorted by a: its k-mers are kept
        for batch in batches:
            keep = []
            for a, b, text_a, text_b in zip(*(batch.column(i) for i in range(4))):
                if last != a.as_py():
                    last, left = a.as_py(), labelled_kmers(text_a.as_py(), omh.k, words)
                other = labelled_kmers(text_b.as_py(), omh.k, words)
                keep.append(aligned_similarity(left, other, omh.similarity) >= omh.similarity)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "text_a", "text_b").mapInArrow(align, "a long, b long")


def _size_fits(omh: Omh) -> Column:
    """Texts whose lengths differ too much cannot be similar enough."""
    return F.least("n_a", "n_b") >= omh.similarity * F.greatest("n_a", "n_b")


def _block_links(apart: DataFrame, texts: DataFrame, omh: Omh) -> DataFrame:
    """Links between components inside open buckets, at most one per pair of components and
    task.

    A group of `block_groups` counts shared k-mers of all its texts at once by matrix products
    and aligns only pairs that reach the similarity; nothing else leaves it.
    """
    groups = block_groups(apart, omh.block_rows, omh.block_kmers)
    dealt = (
        groups.join(texts, "row").select("group", "row", "root", "text")
        .repartition("group").sortWithinPartitions("group", "row")
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        group, rows = None, []

        def links() -> pa.RecordBatch:
            found = linked_pairs(rows, omh)
            return pa.RecordBatch.from_arrays(
                [pa.array([x[i] for x in found], pa.int64()) for i in range(2)], names=["a", "b"]
            )

        for batch in batches:
            for key, row, root, text in zip(*(batch.column(i) for i in range(4))):
                if key.as_py() != group:
                    yield links()
                    group, rows = key.as_py(), []
                rows.append((row.as_py(), root.as_py(), labelled_kmers(text.as_py(), omh.k, words)))
        yield links()

    return dealt.mapInArrow(compare, "a long, b long").distinct()


def linked_pairs(rows: list[tuple[int, int, np.ndarray]], omh: Omh) -> list[tuple[int, int]]:
    """True links among (row, root, k-mers) that join different roots, as a forest."""
    if len({root for _, root, _ in rows}) < 2:
        return []
    sizes = np.array([len(kmers) for _, _, kmers in rows])
    owner = np.repeat(np.arange(len(rows)), sizes)
    values, place, times = np.unique(
        np.concatenate([kmers for _, _, kmers in rows]), return_inverse=True, return_counts=True
    )
    number = np.cumsum(times > 1) - 1  # only k-mers of two texts or more count
    kept = times[place] > 1
    owner, place = owner[kept], number[place[kept]]
    shared = np.zeros((len(rows), len(rows)), np.float32)
    for at in range(0, int(number[-1]) + 1, omh.columns):
        here = (place >= at) & (place < at + omh.columns)
        marks = np.zeros((len(rows), omh.columns), np.float32)
        marks[owner[here], place[here] - at] = 1
        shared += marks @ marks.T
    union = sizes[:, None] + sizes[None, :] - shared
    near_a, near_b = np.nonzero(np.triu(shared >= omh.similarity * union, 1))
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    out = []
    for a, b in zip(near_a.tolist(), near_b.tolist()):
        left, right = find(rows[a][1]), find(rows[b][1])
        if left != right and aligned_similarity(rows[a][2], rows[b][2], omh.similarity) >= omh.similarity:
            parent[left] = right
            out.append((min(rows[a][0], rows[b][0]), max(rows[a][0], rows[b][0])))
    return out


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", omh: Omh = Omh(),
) -> DataFrame:
    """One row per row of `docs`: the id, text_key (MD5 of the normalised text), class_id,
    class_size and kept.

    A class is a connected component of links between texts of aligned similarity
    `omh.similarity` or more; class_id is its smallest id (null ids last) and exactly one
    row with that id is kept. White space is made single and trimmed, so null, empty and
    blank texts are one class of copies; texts below `omh.k` words are near only to equal
    ones. Repeated rows and equal texts are reduced to one representative before any
    pairing. An empty table gives an empty result.

    Pairs inside a bucket are never emitted as a whole. Large buckets are dealt into small
    cells, which joins large groups of copies; buckets of any size and sketch that then still
    hold several components are searched block by block for links between these.
    """
    keyed = docs.select(F.col(id_col).alias("id"), _flat(text_col).alias("text")).withColumn(
        "key", F.md5("text")
    )
    numbered = keyed.select(F.monotonically_increasing_id().alias("row"), "id", "key", "text")
    rows = store(_sketch_table(numbered, omh), "sketches")
    firsts = rows.groupBy("key").agg(F.min("row").alias("rep"))
    whole = rows.select("row", "id", "key").join(firsts, "key")

    spread = rows.join(firsts.select(F.col("rep").alias("row")), "row", "left_semi").select(
        "row", "key", "n", F.posexplode("sketch").alias("place", "value")
    ).select("row", "key", "n", "place", F.xxhash64("place", "value").alias("bucket"))
    sizes = spread.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    members = store(spread.join(sizes, "bucket"), "buckets")
    wanted = store(members.select("key", "row").distinct(), "wanted")
    # copies shrink to one text per task before the shuffle
    texts = store(
        thinned(keyed.select("key", "text"), "key", wanted)
        .groupBy("key").agg(F.first("text").alias("text"))
        .join(wanted, "key").select("row", "text"),
        "texts",
    )

    def verify(pairs: DataFrame) -> DataFrame:
        return _verified(pairs, texts, omh)

    def late_links(apart: DataFrame) -> DataFrame:
        return _block_links(apart, texts, omh)

    # most rows of a large group meet in the first sketches; later ones find the rest
    first = F.col("place") < 1
    second = F.col("place").between(1, 2)
    labels = group_rows(
        members.drop("key"), verify, late_links, _size_fits(omh), ["n"], omh.cell,
        [first, second, F.col("place") > 2],
    )

    classed = whole.join(
        labels.withColumnRenamed("node", "rep"), "rep", "left"
    ).withColumn("root", F.coalesce("root", "rep"))
    best = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "row")).alias("best")
    classes = classed.groupBy("root").agg(best, F.count(F.lit(1)).alias("class_size"))
    return classed.join(classes, "root").select(
        F.col("id").alias(id_col), F.col("key").alias("text_key"), F.col("best.id").alias("class_id"), "class_size",
        (F.col("row") == F.col("best.row")).alias("kept"),
    )


def drop_near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", omh: Omh = Omh(),
) -> DataFrame:
    """`docs` with one row of each class, as `near_duplicates` defines them.

    Only rows that may be dropped, or that repeat an id with its text, meet their decision
    in a join; all others pass by it. Of rows with equal id and text any one may stay.
    """
    decided = near_duplicates(docs, id_col, text_col, omh)
    special = store(
        decided.groupBy(F.col(id_col).alias("__id"), F.col("text_key").alias("__key"))
        .agg(F.count(F.lit(1)).alias("__times"), F.max("kept").alias("__kept"))
        .filter("__times > 1 OR NOT __kept"),
        "special",
    )
    keyed = docs.withColumn("__key", F.md5(_flat(text_col)))
    split = marked(keyed, "__key", special)
    clear = split.filter("NOT __maybe").select(docs.columns)
    met = split.filter("__maybe").join(
        special.withColumnRenamed("__key", "__other"),
        (F.col("__key") == F.col("__other")) & F.col(id_col).eqNullSafe(F.col("__id")), "left",
    ).filter("__kept IS NULL OR __kept")
    once = met.filter("coalesce(__times, 1) = 1").select(docs.columns)
    repeated = met.filter("__times > 1").dropDuplicates([id_col, "__key"]).select(docs.columns)
    return clear.unionByName(once).unionByName(repeated)
