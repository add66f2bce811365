"""Live records: normalise, classify, assign through the stored tables.

`AssignmentSink` serves one query; several live sources are united before it, or go through
`state.assign_stream`, whose state has one owner anyway.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, functions as F

from agentlog import schemas
from agentlog.config import NormalizeConfig, ScenarioConfig
from agentlog.functions.taxonomy import filled
from agentlog.operators import keyed, normalize as nz
from agentlog.operators.scenarios import assign_online, initial_centroids
from agentlog.session import cut_lineage
from agentlog.sources.tables import Tables

CENTROIDS = schemas.CENTROIDS


def normalize_stream(
    stream: DataFrame, cfg: NormalizeConfig = NormalizeConfig(id_prefix="live_"),
    keep_rejected: bool = False,
) -> DataFrame:
    """Valid canonical records of a raw stream (T1); with `keep_rejected` all records, with
    the reason for those that a sink has to set aside.

    A stream has no row number, so a missing id is the whole digest of the record's content:
    a record that is delivered twice gets the same id and counts as a duplicate.
    """
    content = F.sha2(F.to_json(F.struct(*[f.name for f in schemas.RAW.fields])), 256)
    raw = stream.withColumn("row_idx", content)
    rows = nz.canonical_rows(raw, replace(cfg, synthesize=False), None, F.current_timestamp())
    if keep_rejected:
        return rows.select(*nz.RECORD_COLUMNS, "response_status", "error_code", "reject_reason")
    valid = rows.where(F.col("reject_reason").isNull())
    return valid.select(*nz.RECORD_COLUMNS, "response_status", "error_code")


def hydrate(tables: Tables, clusters: DataFrame) -> None:
    """Start online assignment from a cluster table, e.g. after a recompute (T4)."""
    tables.replace("centroids", initial_centroids(clusters).select(*CENTROIDS.fieldNames()))


@dataclass(frozen=True)
class AssignmentSink:
    """Sink that assigns classified records to scenarios and stores all results.

    `classify` adds task_type, confidence and embedding to a batch. Every output is a batch
    of its own table under the query and batch id, and inputs are read as of before that id,
    so a repeated batch replaces itself. Vectors are stored too, for a later recompute. Rows
    with a `reject_reason` are kept in the table `rejected` and counted.
    """

    tables: Tables
    classify: Callable[[DataFrame], DataFrame]
    threshold: float = ScenarioConfig.join_threshold

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        t = self.tables
        if t.other_writers("centroids"):
            raise ValueError("another query writes these scenarios: unite the sources, or hydrate after it has ended")
        stored = t.read("assignments", schemas.ASSIGNMENTS, before=batch_id)
        incoming = cut_lineage(batch)
        rejected = None
        if "reject_reason" in incoming.columns:
            rejected = incoming.where(F.col("reject_reason").isNotNull())
            t.write_batch("rejected", rejected, batch_id)
            incoming = incoming.where(F.col("reject_reason").isNull())
        fresh = keyed.append_new(incoming, stored, schemas.KEYS, ["timestamp"])
        typed = cut_lineage(self.classify(fresh))
        state = t.snapshot("centroids", CENTROIDS, before=batch_id)
        result = assign_online(typed, state, self.threshold)

        signals = F.col("failure_signals") if "failure_signals" in typed.columns else F.array().cast("array<string>")
        now = F.current_timestamp()
        rows = result.rows.select(
            "source_id",
            "request_id",
            "task_type",
            F.col("confidence").alias("classification_confidence"),
            "scenario_id",
            F.lit(None).cast("string").alias("scenario_name"),
            F.lit(False).alias("is_outlier"),
            (F.size(signals) > 0).alias("has_failure_signals"),
            signals.alias("failure_signals"),
            "timestamp",
            "query_text",
            now.alias("created_at"),
            now.alias("updated_at"),
        )
        vectors = result.rows.select(
            "request_id", "task_type", "scenario_id", "source_id", "query_text",
            F.col("embedding").cast("array<float>").alias("embedding"), F.lit(False).alias("is_outlier"),
        )
        t.write_batch("vectors", vectors, batch_id)
        t.write_batch("ingest_counters", self._counters(incoming, result.rows, rejected), batch_id)
        t.write_batch("centroids", result.centroids.select(*CENTROIDS.fieldNames()), batch_id)
        t.write_batch("assignments", rows, batch_id)  # last: what they refer to is there

    @staticmethod
    def _counters(incoming: DataFrame, rows: DataFrame, rejected: DataFrame | None) -> DataFrame:
        def tagged(df: DataFrame, kind: str) -> DataFrame:
            return df.select("source_id", F.lit(kind).alias("kind"))

        events = tagged(incoming, "seen").unionByName(tagged(rows, "done"))
        if rejected is not None:
            events = events.unionByName(tagged(rejected, "rejected"))
        count = {k: F.count_if(F.col("kind") == k) for k in ("seen", "done", "rejected")}
        return events.groupBy("source_id").agg(
            count["done"].alias("accepted"), count["done"].alias("classified"), count["done"].alias("assigned"),
            count["rejected"].alias("rejected"), (count["seen"] - count["done"]).alias("duplicates"),
        )


def counters(tables: Tables) -> DataFrame:
    """Counters summed over all batches."""
    rows = tables.counters()
    return keyed.merge_counters(rows, rows.limit(0))


def run_available(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Process what is there now and stop."""
    query = (
        stream.writeStream.foreachBatch(sink)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()

