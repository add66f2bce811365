"""Embedding columns, nearest references, similarity pairs and vector search.

Reference vectors (centroids, queries) are broadcast only after their byte size was
measured; past the limit the same result comes from a salted block join. Distances are
matrix products inside Arrow batches, in tiles of bounded rows times references, so a task's
memory does not depend on how many references there are.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from agentlog.functions.text import fingerprint
from agentlog.functions.vectors import plain, stack, unit_rows

BROADCAST_BYTES = 64 << 20
ROWS_PER_BLOCK = 20_000
#: Rows and references of one tile of a similarity matrix: 32 MB of doubles.
TILE_ROWS, TILE_REFS = 1024, 4096

Embedder = Callable[[Iterator[pd.Series]], Iterator[pd.Series]]


def embed(df: DataFrame, fn: Embedder, text: str = "query_text", out: str = "embedding") -> DataFrame:
    """Vectors from an iterator function, which loads its model once per worker."""
    return df.withColumn(out, F.pandas_udf(fn, "array<float>")(F.col(text)))


def embed_distinct(
    df: DataFrame, fn: Embedder, text: str = "query_text", out: str = "embedding"
) -> DataFrame:
    """Embed every distinct text once and join the vectors back."""
    keyed = df.withColumn("__fp", fingerprint(F.col(text)))
    texts = keyed.where(F.col("__fp").isNotNull()).groupBy("__fp").agg(F.min(text).alias(text))
    vectors = embed(texts, fn, text, out).select("__fp", out)
    return keyed.join(vectors, "__fp", "left").drop("__fp")


# --- references -------------------------------------------------------------------


@dataclass(frozen=True)
class _Group:
    ids: list[str]
    matrix: np.ndarray


def _measure(refs: DataFrame, vec: str) -> tuple[int, int]:
    row = refs.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size(vec)), F.lit(0)).alias("d")).first()
    return int(row["n"]), int(row["d"])


def _group_matrices(pdf: pd.DataFrame, dim: int) -> dict[str, _Group]:
    groups = {}
    for name, part in pdf.sort_values(["grp", "ref"]).groupby("grp", sort=True):
        groups[name] = _Group(part["ref"].tolist(), unit_rows(stack(part["vec"], dim)))
    return groups


def _tiles(rows: np.ndarray, refs: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first row, first reference, similarities) of every tile, references innermost."""
    for r in range(0, len(rows), TILE_ROWS):
        for c in range(0, len(refs), TILE_REFS):
            yield r, c, rows[r : r + TILE_ROWS] @ refs[c : c + TILE_REFS].T


def _by_group(vec: pd.Series, grp: pd.Series, groups: dict[str, _Group], dim: int):
    """Yield (row positions, unit rows, group) for the groups of a batch."""
    rows = unit_rows(stack(vec, dim))
    names = grp.to_numpy()
    for name in pd.unique(grp.dropna()):
        if name in groups:
            at = np.flatnonzero(names == name)
            yield at, rows[at], groups[name]


def _best_of(rows: np.ndarray, group: _Group) -> tuple[np.ndarray, np.ndarray]:
    """Position and similarity of each row's best reference; ties go to the first."""
    best, sim = np.zeros(len(rows), np.int64), np.full(len(rows), -np.inf)
    for r, c, sims in _tiles(rows, group.matrix):
        top = sims.argmax(axis=1)
        value = sims[np.arange(len(sims)), top]
        here = slice(r, r + len(sims))
        better = value > sim[here]
        best[here] = np.where(better, top + c, best[here])
        sim[here] = np.where(better, value, sim[here])
    return best, sim


def _tidy_refs(refs: DataFrame, on: str | None, ref_id: str, ref_vec: str) -> DataFrame:
    grp = F.col(on) if on else F.lit("*")
    return refs.select(grp.alias("grp"), F.col(ref_id).alias("ref"), F.col(ref_vec).cast("array<double>").alias("vec"))


_BEST = T.StructType([T.StructField("ref", T.StringType()), T.StructField("sim", T.DoubleType())])


def nearest(
    v: DataFrame,
    refs: DataFrame,
    on: str | None = "task_type",
    vec: str = "embedding",
    ref_id: str = "scenario_id",
    ref_vec: str = "centroid",
    key: str = "request_id",
    budget: int = BROADCAST_BYTES,
) -> DataFrame:
    """Adds `best_ref` and `best_sim`: the most similar reference of the row's group.

    Ties go to the smaller reference id; no reference in the group gives nulls.
    """
    tidy = _tidy_refs(refs, on, ref_id, ref_vec)
    n, dim = _measure(tidy, "vec")
    if n == 0:
        return v.withColumn("best_ref", F.lit(None).cast("string")).withColumn(
            "best_sim", F.lit(None).cast("double")
        )
    if n * dim * 8 > budget:
        return _nearest_blocks(v, tidy, on, vec, key, n, dim, budget)
    shared = v.sparkSession.sparkContext.broadcast(_group_matrices(tidy.toPandas(), dim))

    @F.pandas_udf(_BEST)
    def best(vectors: pd.Series, grp: pd.Series) -> pd.DataFrame:
        ref = np.full(len(vectors), None, dtype=object)
        sim = np.full(len(vectors), np.nan)
        for at, rows, group in _by_group(vectors, grp, shared.value, dim):
            top, sim[at] = _best_of(rows, group)
            ref[at] = np.asarray(group.ids, dtype=object)[top]
        return pd.DataFrame({"ref": ref, "sim": sim})

    grp = F.col(on) if on else F.lit("*")
    out = v.withColumn("__best", best(F.col(vec), grp))
    return out.withColumn("best_ref", F.col("__best.ref")).withColumn(
        "best_sim", F.when(F.col("__best.ref").isNotNull(), F.col("__best.sim"))
    ).drop("__best")


def _nearest_blocks(
    v: DataFrame, tidy: DataFrame, on: str | None, vec: str, key: str, n: int, dim: int, budget: int
) -> DataFrame:
    """The same for references too large to broadcast.

    References are cut in blocks within the budget, rows in salted parts of bounded size;
    every part meets every block of its group in one task, and an aggregate takes the best.
    """
    blocks = math.ceil(n * dim * 8 / budget) + 1
    salts = max(1, math.ceil(v.count() / ROWS_PER_BLOCK))
    grp = F.col(on) if on else F.lit("*")

    def every(count: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))

    rows = v.select(
        F.col(key).alias("key"), grp.alias("grp"), F.col(vec).cast("array<double>").alias("vec"),
        F.pmod(F.xxhash64(key), F.lit(salts)).cast("int").alias("salt"), every(blocks).alias("block"),
    )
    parts = tidy.withColumn("block", F.pmod(F.xxhash64("ref"), F.lit(blocks)).cast("int")).withColumn(
        "salt", every(salts)
    )
    by = ["grp", "block", "salt"]

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame()
        found = []
        groups = _group_matrices(right, dim)
        for at, rows, group in _by_group(left["vec"], left["grp"], groups, dim):
            top, sim = _best_of(rows, group)
            found.append(
                pd.DataFrame(
                    {
                        "key": left["key"].to_numpy()[at],
                        "ref": np.asarray(group.ids, dtype=object)[top],
                        "neg": -sim,
                    }
                )
            )
        return plain(pd.concat(found))

    met = rows.groupBy(*by).cogroup(parts.groupBy(*by)).applyInPandas(
        meet, "key string, ref string, neg double"
    )
    best = met.groupBy("key").agg(F.min(F.struct("neg", "ref")).alias("b")).select(
        F.col("key").alias(key), F.col("b.ref").alias("best_ref"), (-F.col("b.neg")).alias("best_sim")
    )
    return v.join(best, key, "left")


def pairs_above(
    v: DataFrame,
    refs: DataFrame,
    threshold: float,
    on: str = "task_type",
    vec: str = "centroid",
    ref_id: str = "scenario_id",
    ref_vec: str = "centroid",
    budget: int = BROADCAST_BYTES,
) -> DataFrame:
    """One row per (row, reference) of a group with similarity of at least the threshold.

    Pairs below the threshold are dropped inside the batch. References past the budget are
    handled in several passes.
    """
    tidy = _tidy_refs(refs, on, ref_id, ref_vec)
    n, dim = _measure(tidy, "vec")
    if n and n * dim * 8 > budget:
        halves = [
            pairs_above(v, refs.where(F.pmod(F.xxhash64(ref_id, F.lit(n)), F.lit(2)) == i), threshold, on, vec, ref_id, ref_vec, budget)
            for i in (0, 1)
        ]
        return halves[0].unionByName(halves[1])
    shared = v.sparkSession.sparkContext.broadcast(_group_matrices(tidy.toPandas(), dim) if n else {})

    hit_type = pa.struct([("ref", pa.string()), ("sim", pa.float64())])

    @F.arrow_udf(T.ArrayType(_BEST))
    def above(vectors: pa.Array, grp: pa.Array) -> pa.Array:
        row, ref, sim = [np.zeros(0, np.int64)], [np.zeros(0, object)], [np.zeros(0)]
        for at, rows, group in _by_group(vectors.to_pandas(), grp.to_pandas(), shared.value, dim):
            names = np.asarray(group.ids, dtype=object)
            for r, c, sims in _tiles(rows, group.matrix):
                i, j = np.nonzero(sims >= threshold)
                row.append(at[r + i])
                ref.append(names[c + j])
                sim.append(sims[i, j])
        row = np.concatenate(row)
        order = np.argsort(row, kind="stable")
        ends = np.cumsum(np.bincount(row, minlength=len(vectors)))
        values = pa.StructArray.from_arrays(
            [pa.array(np.concatenate(ref)[order], pa.string()), pa.array(np.concatenate(sim)[order])],
            fields=list(hit_type),
        )
        return pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), values)

    hits = v.withColumn("__hit", F.explode(above(F.col(vec), F.col(on))))
    return hits.withColumn("ref", F.col("__hit.ref")).withColumn("sim", F.col("__hit.sim")).drop("__hit")


# --- search -----------------------------------------------------------------------


def vector_search(
    v: DataFrame,
    queries: DataFrame,
    k: int = 10,
    score_threshold: float | None = None,
    task_type: str | None = None,
    budget: int = BROADCAST_BYTES,
) -> DataFrame:
    """The k most similar vectors of every query (query_id, embedding).

    Each task keeps k rows per query while it streams its partition, so only k rows per
    query and task are shuffled. Many queries are handled in passes that fit the budget.
    """
    if task_type is not None:
        v = v.where(F.col("task_type") == task_type)
    n, dim = _measure(queries, "embedding")
    if n and n * dim * 8 > budget:
        halves = [
            vector_search(v, queries.where(F.pmod(F.xxhash64("query_id", F.lit(n)), F.lit(2)) == i), k, score_threshold, None, budget)
            for i in (0, 1)
        ]
        return halves[0].unionByName(halves[1])
    wanted = queries.select(F.col("query_id").cast("string").alias("query_id"), F.col("embedding").cast("array<double>").alias("vec")).toPandas()
    ids = wanted["query_id"].tolist()
    shared = v.sparkSession.sparkContext.broadcast(
        unit_rows(stack(wanted["vec"], dim)) if n else np.zeros((0, dim))
    )
    floor = -math.inf if score_threshold is None else score_threshold

    def top(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        none = (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, "U1"))
        best = none  # query, score, request of the k best so far
        least = np.full(len(ids), floor)  # a row below this cannot enter the k best any more
        for pdf in batches:
            rows = unit_rows(stack(pdf["embedding"], dim))
            names = pdf["request_id"].to_numpy().astype(str)
            for r, c, sims in _tiles(rows, shared.value):
                bar = least[c : c + sims.shape[1]]
                if len(sims) > k:
                    bar = np.maximum(bar, np.partition(sims, len(sims) - k, axis=0)[len(sims) - k])
                i, q = np.nonzero(sims >= bar)
                if len(q):
                    best = _keep_best(
                        np.r_[best[0], q + c], np.r_[best[1], sims[i, q]], np.r_[best[2], names[r + i]], k
                    )
                    last = np.flatnonzero(np.r_[best[0][1:] != best[0][:-1], True])
                    full = np.diff(np.r_[-1, last]) == k
                    least[best[0][last[full]]] = best[1][last[full]]
        if len(best[0]):
            query = np.asarray(ids, dtype=object)[best[0]]
            yield pd.DataFrame({"query_id": query, "request_id": best[2].astype(object), "score": best[1]})

    found = v.select("request_id", "embedding").mapInPandas(
        top, "query_id string, request_id string, score double"
    )
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "request_id")
    return found.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= k)


def _keep_best(
    query: np.ndarray, score: np.ndarray, name: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of every query, best first, ties by name."""
    order = np.lexsort((name, -score, query))
    query = query[order]
    first = np.r_[True, query[1:] != query[:-1]]
    rank = np.arange(len(query)) - np.maximum.accumulate(np.where(first, np.arange(len(query)), 0))
    kept = order[rank < k]
    return query[rank < k], score[kept], name[kept]
