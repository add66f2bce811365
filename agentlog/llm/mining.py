"""Hard negatives by inner product: STR-packed R-trees searched best first.

Rows are range sorted by label and leading coordinate; each bounded block of them becomes an
R-tree, packed by sort-tile-recursive: sort by the coordinate of the largest spread, cut
into slabs, go on inside the slabs. A minimum bounding box gives an interval of inner
products per coordinate, and their sum bounds every row of the box. A query keeps a queue
of boxes, the one of the highest upper bound first, and leaves out boxes outside its score
windows, below its k-th score, or equal to it with larger ids only.

Anchors are searched in chunks of bounded bytes, each broadcast to the tasks, which keep the
k best of their trees; trees never move. Everything is exact, in integers.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from agentlog.llm.common import store

#: Bytes of vectors in a tree and in a chunk of anchors.
TREE_BYTES = CHUNK_BYTES = 4 << 20
LEAF_ROWS = 128
FANOUT = 16
#: Sorts after all ids.
NO_ID = np.iinfo(np.int64).max


# trees

@dataclass
class Level:
    low: np.ndarray
    high: np.ndarray
    first: np.ndarray  # children of box i: first[i] .. first[i + 1]
    least_id: np.ndarray


def _tile(vectors: np.ndarray, rows: np.ndarray, leaf_rows: int, out: list[np.ndarray]) -> None:
    """Sort-tile-recursive: slabs along the widest coordinate, then tiles inside each slab."""
    if len(rows) <= leaf_rows:
        out.append(rows)
        return
    part = vectors[rows]
    widest = int(np.argmax(part.max(axis=0) - part.min(axis=0)))
    rows = rows[np.argsort(part[:, widest], kind="stable")]
    n_leaves = -(-len(rows) // leaf_rows)
    n_slabs = max(2, int(round(n_leaves**0.5)))
    per_slab = leaf_rows * -(-n_leaves // n_slabs)
    for at in range(0, len(rows), per_slab):
        _tile(vectors, rows[at : at + per_slab], leaf_rows, out)


class Tree:
    """An R-tree over integer vectors. Levels go from the leaves up to one root."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray,
                 leaf_rows: int = LEAF_ROWS, fanout: int = FANOUT) -> None:
        tiles: list[np.ndarray] = []
        if vectors.shape[1]:
            _tile(vectors, np.arange(len(vectors)), leaf_rows, tiles)
        else:  # vectors without components all score 0
            tiles = [np.arange(len(vectors))]
        order = np.concatenate(tiles)
        self.vectors, self.ids, self.labels, self.rows = vectors[order], ids[order], labels[order], rows[order]
        first = np.r_[0, np.cumsum([len(t) for t in tiles])]
        below = Level(self.vectors, self.vectors, np.arange(len(order)), self.ids)
        self.levels: list[Level] = []
        while True:
            starts = first[:-1]
            below = Level(
                np.minimum.reduceat(below.low, starts, axis=0), np.maximum.reduceat(below.high, starts, axis=0),
                first, np.minimum.reduceat(below.least_id, starts),
            )
            self.levels.append(below)
            if len(starts) == 1:
                return
            first = np.r_[np.arange(0, len(starts), fanout), len(starts)]

    def intervals(self, queries: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per level, least and greatest possible inner product of every query and box."""
        plus, minus = np.maximum(queries, 0), np.minimum(queries, 0)
        return [
            (plus @ v.low.T + minus @ v.high.T, plus @ v.high.T + minus @ v.low.T) for v in self.levels
        ]


class Best:
    """The k best (score, id, row) within a window of scores: higher scores first, ties by
    smaller id, then by row."""

    def __init__(self, k: int, low=-np.inf, high=np.inf) -> None:
        self.k, self.low, self.high = k, low, high
        self.score = np.empty(0, object)
        self.id, self.row = np.empty(0, np.int64), np.empty(0, np.int64)

    def wants(self, low, high, least_id: int) -> bool:
        """Whether a box of that interval and smallest id can hold a better row."""
        if high < self.low or low > self.high:
            return False
        if len(self.id) < self.k or high > self.score[-1]:
            return True
        return high == self.score[-1] and least_id <= self.id[-1]

    def take(self, score: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        keep = (score >= self.low) & (score <= self.high)
        if len(self.id) == self.k:
            keep &= score >= self.score[-1]
        if not keep.any():
            return
        score, ids, rows = score[keep], ids[keep], rows[keep]
        if len(self.id):
            score, ids, rows = np.r_[self.score, score], np.r_[self.id, ids], np.r_[self.row, rows]
        order = np.lexsort((rows, ids, -score))[: self.k]
        self.score, self.id, self.row = score[order], ids[order], rows[order]


def search(tree: Tree, bounds, no: int, query: np.ndarray, wanted: np.ndarray, found: list[Best]) -> int:
    """Offer the rows of `tree` marked in `wanted` to the lists of query `no`; the number of
    leaves read. A box is read if any list wants it."""
    top = len(tree.levels) - 1
    queue = [(-bounds[top][1][no, 0], top, 0)]
    n_read = 0
    while queue:
        high, level, box = heapq.heappop(queue)
        low, least_id = bounds[level][0][no, box], tree.levels[level].least_id[box]
        if not any(b.wants(low, -high, least_id) for b in found):
            continue
        first, stop = tree.levels[level].first[box : box + 2]
        if level == 0:
            n_read += 1
            keep = wanted[first:stop]
            if keep.any():
                scores = (tree.vectors[first:stop] @ query)[keep]
                for b in found:
                    b.take(scores, tree.ids[first:stop][keep], tree.rows[first:stop][keep])
            continue
        lows, highs = bounds[level - 1][0][no], bounds[level - 1][1][no]
        ids = tree.levels[level - 1].least_id
        for child in range(first, stop):
            if any(b.wants(lows[child], highs[child], ids[child]) for b in found):
                heapq.heappush(queue, (-highs[child], level - 1, child))
    return n_read


# numbers

def whole_numbers(vectors: list[np.ndarray], dims: int) -> np.ndarray:
    """floor(256 x) of every component, short vectors filled up with zeros: floats while all
    sums of products stay exact in them, else Python integers."""
    out = np.zeros((len(vectors), dims))
    for at, v in enumerate(vectors):
        out[at, : len(v)] = np.floor(256 * np.asarray(v, np.float64))
    most = np.abs(out).max(initial=0)
    if dims * most * most < 2**53:
        return out
    return np.array([[int(x) for x in row] for row in out], dtype=object).reshape(len(vectors), dims)


def _same_kind(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both of one width and, unless exact in floats, of Python integers."""
    dims = max(a.shape[1], b.shape[1])
    a, b = (np.pad(x, ((0, 0), (0, dims - x.shape[1])), constant_values=0) for x in (a, b))
    exact = a.dtype == b.dtype == np.float64 and (
        dims * np.abs(a).max(initial=0) * np.abs(b).max(initial=0) < 2**53
    )
    if exact:
        return a, b
    return tuple(np.array([[int(x) for x in row] for row in m], dtype=object).reshape(m.shape) for m in (a, b))


def _long(x) -> int:
    """Scores beyond a long are held at its ends."""
    return int(min(max(int(x), -(2**63)), 2**63 - 1))


# Spark

TREE = T.StructType(
    [T.StructField("labels", T.ArrayType(T.LongType())), T.StructField("block", T.BinaryType())]
)
_TREE_ARROW = pa.schema([("labels", pa.list_(pa.int64())), ("block", pa.binary())])
_FOUND = "anchor_row long, list int, score long, row long, vec_id long"
_FOUND_ARROW = pa.schema(
    [("anchor_row", pa.int64()), ("list", pa.int32()), ("score", pa.int64()), ("row", pa.int64()), ("vec_id", pa.int64())]
)


def _ids(column: pa.Array) -> np.ndarray:
    return column.fill_null(NO_ID).to_numpy(zero_copy_only=False)


def _read(batch: pa.RecordBatch) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Vectors, ids, labels and row numbers of a batch."""
    vectors = [np.asarray(v, np.float64) for v in batch.column("vector").to_numpy(zero_copy_only=False)]
    return (
        vectors, _ids(batch.column("vec_id")), batch.column("label").to_numpy(zero_copy_only=False),
        batch.column("row").to_numpy(zero_copy_only=False),
    )


def _blocks(tree_bytes: int):
    """Cut sorted rows into blocks of bounded bytes, one row each, as Arrow streams."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pack(rows: pa.RecordBatch) -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema) as out:
                out.write_batch(rows)
            labels = np.unique(rows.column("label").to_numpy(zero_copy_only=False)).tolist()
            return pa.RecordBatch.from_pylist([{"labels": labels, "block": sink.getvalue().to_pybytes()}], schema=_TREE_ARROW)

        for batch in batches:
            widths = np.array([len(v) + 1 for v in batch.column("vector").to_numpy(zero_copy_only=False)])
            sizes, first = np.cumsum(8 * widths), 0
            while first < len(sizes):
                before = sizes[first - 1] if first else 0
                stop = max(first + 1, int(np.searchsorted(sizes, before + tree_bytes, side="right")))
                yield pack(batch.slice(first, stop - first))
                first = stop

    return run


def trees(rows: DataFrame, tree_bytes: int = TREE_BYTES) -> DataFrame:
    """Blocks of `rows` (row, vec_id, label, vector) for R-trees, with the labels they hold."""
    lead = F.coalesce(F.get("vector", F.lit(0)).cast("double"), F.lit(0.0))
    ordered = (
        rows.withColumn("lead", lead).repartitionByRange("label", "lead", "row")
        .sortWithinPartitions("label", "lead", "row").drop("lead")
    )
    return store(ordered.mapInArrow(_blocks(tree_bytes), TREE), "trees")


@dataclass
class Chunk:
    """Anchors of one pass: `lists` holds, per anchor, (list number, k, low, high)."""

    rows: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    lists: list[list[tuple]]
    same_label: bool


def _search(chunk, leaf_rows: int):
    """A task's part of one pass: all its trees against the anchors of the chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c: Chunk = chunk.value
        found = [[Best(k, low, high) for _, k, low, high in own] for own in c.lists]
        for batch in batches:
            for block in batch.column("block"):
                with pa.ipc.open_stream(block.as_buffer()) as stream:
                    vectors, ids, labels, rows = _read(stream.read_next_batch())
                here = np.unique(labels)
                ask = np.flatnonzero(np.isin(c.labels, here) if c.same_label else (len(here) > 1) | (c.labels != here[0]))
                ask = ask[[bool(found[a]) for a in ask]] if len(ask) else ask
                if not len(ask):
                    continue
                dims = max(len(v) for v in vectors)
                asked, vectors = _same_kind(c.vectors[ask], whole_numbers(vectors, dims))
                tree = Tree(vectors, ids, labels, rows, leaf_rows)
                bounds = tree.intervals(asked)
                for no, a in enumerate(ask.tolist()):
                    wanted = (tree.labels == c.labels[a]) if c.same_label else (tree.labels != c.labels[a])
                    if c.same_label:
                        wanted &= tree.rows != c.rows[a]
                    search(tree, bounds, no, asked[no], wanted, found[a])
        for a, own in enumerate(found):
            out = [
                {"anchor_row": int(c.rows[a]), "list": c.lists[a][at][0], "score": _long(s), "row": int(r),
                 "vec_id": None if i == NO_ID else int(i)}
                for at, b in enumerate(own) for s, i, r in zip(b.score, b.id, b.row)
            ]
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=_FOUND_ARROW)

    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each list over all tasks, with their rank."""
    order = Window.partitionBy("anchor_row", "list").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def quantised_rows(table: DataFrame, vec_id: str, vector: str, label: Column) -> DataFrame:
    """(row, vec_id, label, vector) of the rows that take part, numbered and stored."""
    finite = F.forall("vector", lambda x: F.coalesce(x.between(-7e305, 7e305), F.lit(False)))
    return store(
        table.select(
            F.col(vec_id).cast("long").alias("vec_id"), label.cast("long").alias("label"), F.col(vector).alias("vector")
        )
        .filter(F.col("label").isNotNull() & F.col("vector").isNotNull() & finite)
        .withColumn("row", F.monotonically_increasing_id()),
        "vectors",
    )


def hard_negatives(
    table: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: Column | str = "label",
    anchors: Column | None = None, n_positives: int = 5, n_negatives: int = 10,
    low_share: int = 30, high_share: int = 90, leaf_rows: int = LEAF_ROWS,
    tree_bytes: int = TREE_BYTES, chunk_bytes: int = CHUNK_BYTES,
) -> DataFrame:
    """For each anchor and each of its best rows of the same label, the best rows of other
    labels whose score is between `low_share` and `high_share` percent of the positive's.

    A score is the inner product of floor(256 x); ties go to the smaller id, null ids last,
    then to the earlier row. Rows with a null label, a null vector, or a null or non-finite
    component take no part. Short vectors count as filled up with zeros. Repeated rows and
    rows of equal id are rows of their own: all are searched, and an anchor's copy can be its
    positive. Anchors of a null id exist only if `anchors` selects them. Scores are exact;
    those beyond a long are held at its ends in the result. Other columns are ignored. An
    empty table, or none of another label, gives no row.
    """
    label = F.col(label) if isinstance(label, str) else label
    rows = quantised_rows(table, vec_id, vector, label)
    forest = trees(rows, tree_bytes)
    chosen = rows.filter(anchors if anchors is not None else F.col("vec_id") % 100 == 0)
    spark = table.sparkSession
    positives, negatives = [], []
    for part in _anchor_chunks(chosen, chunk_bytes):
        vectors, ids, labels, row = _read(part)
        dims = max((len(v) for v in vectors), default=0)
        numbers = whole_numbers(vectors, dims)
        lists = [[(0, n_positives, -np.inf, np.inf)]] * len(row)
        first = _pass(spark, forest, Chunk(row, labels, numbers, lists, True), leaf_rows)
        best = store(_best(first, n_positives), "positives")
        windows: dict[int, list] = {int(r): [] for r in row}
        # n_positives rows for each anchor of a bounded chunk
        for p in best.select("anchor_row", "rank", "score").toArrow().to_pylist():
            low, high = -(-low_share * p["score"] // 100), high_share * p["score"] // 100
            if low <= high:
                windows[p["anchor_row"]].append((p["rank"], n_negatives, low, high))
        lists = [windows[int(r)] for r in row]
        second = _pass(spark, forest, Chunk(row, labels, numbers, lists, False), leaf_rows)
        positives.append(best)
        negatives.append(store(_best(second, n_negatives), "negatives"))
    if not positives:
        return _named(spark.createDataFrame([], _FOUND + ", rank int"), spark.createDataFrame([], _FOUND + ", rank int"), rows)
    all_positives, all_negatives = positives[0], negatives[0]
    for p, n in zip(positives[1:], negatives[1:]):
        all_positives, all_negatives = all_positives.union(p), all_negatives.union(n)
    return _named(all_positives, all_negatives, rows)


def _anchor_chunks(chosen: DataFrame, chunk_bytes: int) -> Iterator[pa.RecordBatch]:
    """The anchors in chunks of bounded bytes."""
    n, width = chosen.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    n_chunks = -(-n * 8 * ((width or 0) + 1) // chunk_bytes)
    schema = None
    for number in range(n_chunks):
        part = chosen.filter(F.pmod(F.xxhash64("row"), F.lit(n_chunks)) == number).toArrow().combine_chunks()
        schema = part.schema
        batches = part.to_batches()
        if batches:
            yield pa.Table.from_batches(batches, schema).combine_chunks().to_batches(max_chunksize=len(part))[0]


def _pass(spark, forest: DataFrame, chunk: Chunk, leaf_rows: int) -> DataFrame:
    return forest.select("block").mapInArrow(_search(spark.sparkContext.broadcast(chunk), leaf_rows), _FOUND)


def _named(positives: DataFrame, negatives: DataFrame, rows: DataFrame) -> DataFrame:
    """Ids in place of row numbers."""
    p = positives.select(
        "anchor_row", F.col("rank").alias("list"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")
    )
    names = rows.select(F.col("row").alias("anchor_row"), F.col("vec_id").alias("anchor_id"))
    return (
        negatives.join(p, ["anchor_row", "list"]).join(names, "anchor_row")
        .select(
            "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score",
            F.col("score").alias("negative_score"),
        )
    )
