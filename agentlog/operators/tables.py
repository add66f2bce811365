"""Writes that combine the keyed operators for one stored table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from agentlog.functions.taxonomy import filled
from agentlog.operators.keyed import last_per


def upsert_vectors(vectors: DataFrame, new: DataFrame, order: Sequence[str]) -> DataFrame:
    """Vector table after an upsert by request id; rows without an id are skipped."""
    fresh = last_per(new.where(filled(F.col("request_id"), "") != ""), ["request_id"], order)
    kept = vectors.join(fresh.select("request_id"), "request_id", "left_anti")
    return kept.unionByName(fresh, allowMissingColumns=True)
