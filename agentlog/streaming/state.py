"""Streams with state: one owner of the online scenarios, repeats, windows of days.

* `assign_stream` keeps the centroids of every class as keyed state of one query. Any number
  of sources are united before it, so there is one owner of centroids and numbers.
* `once_within` drops repeats that arrive close together from state of bounded age; a sink
  finds later ones by their keys.
* `daily_counts` counts days in state that the watermark clears; `late_counts` counts the
  rows that such a window no longer takes.
* `StreamTable` is a Parquet table partitioned by writer and batch. A batch that is repeated
  after a failure overwrites its own partition; everything else is Spark's.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from agentlog import schemas
from agentlog.config import ScenarioConfig
from agentlog.functions.ids import cluster_number
from agentlog.functions.taxonomy import UNKNOWN, filled

_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"

#: What `assign_stream` adds to the columns of its rows.
_ADDED = (
    T.StructField("scenario_id", T.StringType()), T.StructField("similarity", T.DoubleType()),
    T.StructField("is_new_cluster", T.BooleanType()),
)
_CENTROID = T.StructType(
    [T.StructField("centroid", T.ArrayType(T.DoubleType())), T.StructField("count", T.LongType())]
)
_NUMBER = T.StructType([T.StructField("n", T.LongType())])


# --- online scenarios -------------------------------------------------------------


class OnlineScenarios(StatefulProcessor):
    """State of one class: the centroid and count of every scenario number.

    Rows are handled in the order (timestamp, request_id) of their batch: a row at least
    `threshold` similar to a centroid joins the most similar one, of equal ones that of the
    smallest number, and moves it to the running mean; any other row opens the next number.
    Rows without direction (null, empty or zero vectors) join nothing and open nothing; their
    scenario is null.
    """

    def __init__(self, threshold: float) -> None:
        self.threshold = threshold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.scenarios = handle.getMapState("scenarios", _NUMBER, _CENTROID)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        for row in initialState.itertuples():
            self.scenarios.updateValue((int(row.n),), ([float(x) for x in row.centroid], int(row.count)))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = sorted((k[0], np.asarray(v[0], float), v[1]) for k, v in self.scenarios.iterator())
        numbers = [n for n, _, _ in known]
        centroids, counts = [c for _, c, _ in known], [c for _, _, c in known]
        units = [c / (np.linalg.norm(c) or 1.0) for c in centroids]
        changed: set[int] = set()
        batch = pd.concat(list(rows), ignore_index=True).sort_values(["timestamp", "request_id"], kind="stable")
        found = []
        for v in batch["embedding"]:
            v = np.asarray(v if v is not None else [], float)
            length = np.linalg.norm(v)
            if not length or not np.isfinite(length):
                found.append((None, None, False))
                continue
            sims = [float(u @ v / length) if len(u) == len(v) else -1.0 for u in units]
            at = int(np.argmax(sims)) if sims else -1
            if at >= 0 and sims[at] >= self.threshold:
                counts[at] += 1
                centroids[at] = centroids[at] + (v - centroids[at]) / counts[at]
                found.append((numbers[at], sims[at], False))
            else:
                at = len(numbers)
                numbers.append(max(numbers, default=-1) + 1)
                centroids.append(v)
                counts.append(1)
                units.append(v)
                found.append((numbers[at], 1.0, True))
            units[at] = centroids[at] / (np.linalg.norm(centroids[at]) or 1.0)
            changed.add(at)
        for at in changed:
            self.scenarios.updateValue((numbers[at],), (centroids[at].tolist(), counts[at]))
        kind = key[0]
        yield batch.assign(
            scenario_id=[None if n is None else f"{kind}:cluster_{n}" for n, _, _ in found],
            similarity=[s for _, s, _ in found], is_new_cluster=[new for _, _, new in found],
        )

    def close(self) -> None:
        pass


def assign_stream(
    stream: DataFrame, clusters: DataFrame | None = None, threshold: float = ScenarioConfig.join_threshold,
) -> DataFrame:
    """A stream's rows with scenario_id, similarity and is_new_cluster (T3), from state that
    starts with the centroids of a cluster table (T4).

    `stream` has request_id, task_type, timestamp and embedding and any other columns; unite
    all sources first. A class is one key of state, its rows are read in order: that is what running
    means need; back-fill large histories with `scenarios.assign_online` and start the
    stream from its centroids. After a recompute start a query with a new checkpoint from the
    new cluster table. Needs the RocksDB state store, which is set for the session.
    """
    spark = stream.sparkSession
    spark.conf.set(_PROVIDER, _ROCKS)
    rows = stream.withColumns(
        {"task_type": filled(F.col("task_type"), UNKNOWN), "embedding": F.col("embedding").cast("array<double>")}
    )
    state = None
    if clusters is not None:
        state = clusters.where((F.size("centroid") > 0) & F.col("scenario_id").isNotNull()).select(
            filled(F.col("task_type"), UNKNOWN).alias("task_type"),
            cluster_number(F.col("scenario_id"), None).cast("long").alias("n"),
            F.col("centroid").cast("array<double>").alias("centroid"),
            F.greatest(F.lit(1), F.coalesce("records_count", F.lit(1))).cast("long").alias("count"),
        ).where("n IS NOT NULL").groupBy("task_type")
    return rows.groupBy("task_type").transformWithStateInPandas(
        OnlineScenarios(threshold), assigned_schema(rows.schema), "Append", "None", initialState=state
    )


def assigned_schema(rows: T.StructType) -> T.StructType:
    """Schema of assigned rows."""
    return T.StructType([*rows.fields, *_ADDED])


def online_centroids(spark: SparkSession, checkpoint: str) -> DataFrame:
    """scenario_id, task_type, centroid and count out of a query's state, as of its last
    batch."""
    state = spark.read.format("statestore").option("stateVarName", "scenarios").load(checkpoint)
    kind = F.col("key").getField("task_type")
    return state.select(
        F.format_string("%s:cluster_%d", kind, F.col("user_map_key.n")).alias("scenario_id"), kind.alias("task_type"),
        F.col("user_map_value.centroid").alias("centroid"), F.col("user_map_value.count").alias("count"),
    )


# --- repeats ----------------------------------------------------------------------


def once_within(stream: DataFrame, keys: Sequence[str] = schemas.KEYS, within: str = "1 hour", arrived: Column | None = None) -> DataFrame:
    """Rows without those whose key came at most `within` before.

    Age is measured on arrival, so rows with old timestamps are not late: none is dropped
    but repeats, and state holds the keys of the last `within` only. They lie in the RocksDB
    state store, which is set for the session: on disk, not in the executors' heaps.
    """
    stream.sparkSession.conf.set(_PROVIDER, _ROCKS)
    at = F.current_timestamp() if arrived is None else arrived
    return stream.withColumn("__arrived", at).withWatermark("__arrived", within).dropDuplicatesWithinWatermark(list(keys)).drop("__arrived")


# --- tables -----------------------------------------------------------------------


@dataclass(frozen=True)
class StreamTable:
    """Rows of streaming queries in one Parquet table, partitioned by writer and batch."""

    spark: SparkSession
    path: str

    def write(self, rows: DataFrame, batch_id: int, writer: str) -> None:
        """Add a batch; the same batch of the same writer is overwritten."""
        out = rows.withColumns({"writer": F.lit(writer), "batch_id": F.lit(batch_id).cast("long"), "written_at": F.current_timestamp()})
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("writer", "batch_id").parquet(self.path)

    def read(self, schema: T.StructType) -> DataFrame:
        """All rows with writer, batch_id and written_at; an absent table is empty."""
        full = T.StructType(
            [*schema.fields, T.StructField("written_at", T.TimestampType()), T.StructField("writer", T.StringType()),
             T.StructField("batch_id", T.LongType())]
        )
        self.spark.createDataFrame([], full).write.mode("append").partitionBy("writer", "batch_id").parquet(self.path)
        return self.spark.read.schema(full).parquet(self.path)

    def newest(self, schema: T.StructType) -> DataFrame:
        """Rows of the writer that wrote last: a query with a new checkpoint counts everything
        anew and takes the place of the one before."""
        rows = self.read(schema)
        writer = rows.agg(F.max_by("writer", "written_at")).scalar()
        return rows.where(F.col("writer") == writer).select(*schema.fieldNames())

    def last(self, schema: T.StructType, keys: Sequence[str]) -> DataFrame:
        """Of the newest writer's rows the last of every key, by batch."""
        rows = self.read(schema)
        writer = rows.agg(F.max_by("writer", "written_at")).scalar()
        values = [f.name for f in schema.fields if f.name not in keys]
        return rows.where(F.col("writer") == writer).groupBy(*keys).agg(
            F.max_by(F.struct(*values), "batch_id").alias("v")
        ).select(*keys, *[F.col(f"v.{c}").alias(c) for c in values])


def store_once(table: StreamTable, schema: T.StructType, writer: str, keys: Sequence[str] = schemas.KEYS) -> Callable[[DataFrame, int], None]:
    """Sink that stores every key once, however late it is repeated.

    Keys that are stored already are looked up by the batch's own keys, a join that reads the
    key columns of the history. The batch is stored first, so Catalyst knows its size: the
    history is shuffled only if the batch is too large to broadcast. The writer's own repeated
    batch is not counted as history.
    """
    def sink(batch: DataFrame, batch_id: int) -> None:
        rows = batch.dropDuplicates(list(keys)).select(*schema.fieldNames()).persist()
        try:
            rows.count()  # without a stored size a stream's batch counts as too large
            old = table.read(schema).where(~((F.col("writer") == writer) & (F.col("batch_id") >= batch_id)))
            known = old.select(*keys).join(rows.select(*keys), list(keys), "left_semi").distinct()
            table.write(rows.join(known, list(keys), "left_anti"), batch_id, writer)
        finally:
            rows.unpersist()

    return sink


# --- windows ----------------------------------------------------------------------


def in_time(timestamp: Column, arrived: Column, delay: str) -> Column:
    """Whether a row can still be counted in a window: not older than `delay` at its arrival,
    and not from the future, which would close the windows of others."""
    return F.coalesce((timestamp <= arrived) & (timestamp >= arrived - F.expr(f"INTERVAL {delay}")), F.lit(False))


def daily_counts(stream: DataFrame, delay: str = "7 days", arrived: Column | None = None) -> DataFrame:
    """Rows per day in windows that close `delay` after their time (T6); use update mode."""
    at = F.current_timestamp() if arrived is None else arrived
    on_time = stream.where(in_time(F.col("timestamp"), at, delay)).withWatermark("timestamp", delay)
    return on_time.groupBy(F.window("timestamp", "1 day")).agg(F.count(F.lit(1)).alias("count")).select(
        F.date_format("window.start", "yyyy-MM-dd").alias("date"), "count"
    )


def late_counts(stream: DataFrame, delay: str = "7 days", arrived: Column | None = None) -> DataFrame:
    """Dates of the rows that `daily_counts` leaves out; without state, in append mode."""
    at = F.current_timestamp() if arrived is None else arrived
    late = stream.where(F.col("timestamp").isNotNull() & ~in_time(F.col("timestamp"), at, delay))
    return late.select(F.date_format("timestamp", "yyyy-MM-dd").alias("date"))


DAYS = T.StructType([T.StructField("date", T.StringType()), T.StructField("count", T.LongType())])
TOTALS = T.StructType(
    [T.StructField("source_id", T.StringType()), T.StructField("records", T.LongType()), T.StructField("succeeded", T.LongType())]
)


def dynamics(days: StreamTable, late: StreamTable) -> DataFrame:
    """Rows per day: the last state of every window and all late rows."""
    return days.last(DAYS, ["date"]).unionByName(late.newest(DAYS)).groupBy("date").agg(F.sum("count").alias("count"))


def count_late(table: StreamTable, writer: str) -> Callable[[DataFrame, int], None]:
    """Sink of `late_counts`: the batch's rows per date."""
    def sink(batch: DataFrame, batch_id: int) -> None:
        table.write(batch.groupBy("date").agg(F.count(F.lit(1)).alias("count")), batch_id, writer)

    return sink


def source_totals(stream: DataFrame) -> DataFrame:
    """Running totals per source (T7), one row of state each; use update mode."""
    return stream.groupBy(filled(F.col("source_id"), "_unknown").alias("source_id")).agg(
        F.count(F.lit(1)).alias("records"), F.count_if(F.col("status") == "success").alias("succeeded")
    )


def run(
    stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append",
) -> None:
    """Process what is there now and stop."""
    query = (
        stream.writeStream.foreachBatch(sink).outputMode(mode).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
