"""Vector expressions, and the numpy kernels used inside Arrow batches."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F


def dot(a: Column, b: Column) -> Column:
    pairs = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 for a zero vector or different lengths."""
    length = norm(a) * norm(b)
    return F.when(
        (F.size(a) == F.size(b)) & (length > 0), dot(a, b) / F.nullif(length, F.lit(0.0))
    ).otherwise(F.lit(0.0))


def mean_vector(c: Column) -> Column:
    """Aggregate: element-wise mean, combined map-side (no row per dimension)."""
    return vector_to_array(Summarizer.mean(array_to_vector(c.cast("array<double>"))))


def unit(c: Column) -> Column:
    """The vector scaled to length 1; a zero vector stays as it is."""
    size = F.coalesce(F.nullif(norm(c), F.lit(0.0)), F.lit(1.0))
    # the outer transform computes the length once per row, not once per component
    return F.transform(F.array(size), lambda s: F.transform(c, lambda x: x.cast("double") / s))[0]


def mean_pool(df: DataFrame, group: list[str], vec: str = "embedding") -> DataFrame:
    """One unit vector per group out of the vectors of its chunks."""
    return df.groupBy(*group).agg(mean_vector(F.col(vec)).alias(vec)).withColumn(
        vec, unit(F.col(vec))
    )


# --- numpy kernels ----------------------------------------------------------------


def stack(column: pd.Series, dim: int) -> np.ndarray:
    """Batch column to a matrix; rows of a foreign length become zero vectors."""
    values = column.to_numpy()
    if len(values) and all(v is not None and len(v) == dim for v in values):
        return np.stack(values).astype(np.float64, copy=False)
    out = np.zeros((len(values), dim), dtype=np.float64)
    for i, v in enumerate(values):
        if v is not None and len(v) == dim:
            out[i] = v
    return out


def plain(pdf: pd.DataFrame) -> pd.DataFrame:
    """String columns as plain objects, which Arrow takes back whatever their chunks were."""
    texts = [c for c in pdf.columns if pd.api.types.is_string_dtype(pdf[c].dtype)]
    return pdf.astype({c: object for c in texts})


def unit_rows(m: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(size == 0.0, 1.0, size)


def hash_vector(text: str, dim: int) -> np.ndarray:
    """Repeatable stand-in embedding out of SHA-256 bytes."""
    block = hashlib.sha256(text.strip().lower().encode("utf-8")).digest()
    while len(block) < dim:
        block += hashlib.sha256(block).digest()
    v = np.frombuffer(block[:dim], dtype=np.uint8) / 127.5 - 1.0
    return v / (np.linalg.norm(v) or 1.0)


def hash_embedder(dim: int = 384) -> Callable[[Iterator[pd.Series]], Iterator[pd.Series]]:
    """Embedder in the iterator form `embed` and `embed_distinct` take."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([hash_vector(t or "", dim).tolist() for t in texts])

    return run
