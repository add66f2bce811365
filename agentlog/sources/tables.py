"""Parquet tables with whole-table versions and idempotent batches.

`<root>/<table>/v<version>/` is a complete version; `<root>/<table>/contains/v<version>/`
lists, per writer, the first batch it does not contain. `<root>/<table>/batches/<writer>-<id>/`
holds the batches. A writer is a streaming query (its id lives in its checkpoint), so two
queries, or one with a new checkpoint, never write the same folder. A folder counts once
Spark's commit marker is in it, so readers never see half a write, and a batch that is
written twice replaces itself.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, types as T

from agentlog import schemas
from agentlog.operators.keyed import last_per

_VERSION = re.compile(r"v(\d+)$")
_BATCH = re.compile(r"([^/]+)-(\d{12})$")
_CONTAINS = T.StructType(
    [T.StructField("writer", T.StringType()), T.StructField("next_batch", T.LongType())]
)


@dataclass(frozen=True)
class Batch:
    written: int  # time of the commit
    writer: str
    number: int
    path: str


def current_writer(spark: SparkSession) -> str:
    """The streaming query whose batch is being handled, else `main`."""
    return spark.sparkContext.getLocalProperty("sql.streaming.queryId") or "main"


class Tables:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark = spark
        self.root = root.rstrip("/")

    # The stored tables under their names (S5); unread columns are pruned by the scan.
    def records(self) -> DataFrame:
        return self.read("records", schemas.RECORDS)

    def assignments(self) -> DataFrame:
        return self.read("assignments", schemas.ASSIGNMENTS)

    def clusters(self) -> DataFrame:
        return self.read("clusters", schemas.CLUSTERS)

    def sources(self) -> DataFrame:
        return self.read("sources", schemas.SOURCES)

    def vectors(self) -> DataFrame:
        return self.read("vectors", schemas.VECTORS)

    def runs(self) -> DataFrame:
        return self.read("recompute_runs", schemas.RECOMPUTE_RUNS)

    def counters(self) -> DataFrame:
        return self.read("ingest_counters", schemas.COUNTERS)

    def read(
        self, name: str, schema: T.StructType, before: int | None = None, writer: str | None = None
    ) -> DataFrame:
        """Current version plus later batches, all rows; an absent table is empty.

        `before` leaves out the writer's own batches from that id on, which is what a
        repeated batch has to see to give the same result again.
        """
        version, batches = self._current(name, before, writer)
        return self._scan(version + [b.path for b in batches], schema)

    def snapshot(
        self, name: str, schema: T.StructType, before: int | None = None, writer: str | None = None
    ) -> DataFrame:
        """Only what was written last, for tables whose every batch is the whole state."""
        version, batches = self._current(name, before, writer)
        newest = max(batches, key=lambda b: (b.written, b.number), default=None)
        return self._scan([newest.path] if newest else version, schema)

    def _scan(self, paths: list[str], schema: T.StructType) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)

    def latest(self, name: str, schema: T.StructType, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
        """The last row of every key over the version and its batches."""
        return last_per(self.read(name, schema), keys, order)

    def other_writers(self, name: str) -> set[str]:
        """Writers besides the current one whose batches are newer than the version."""
        return {b.writer for b in self._current(name)[1]} - {current_writer(self.spark)}

    def replace(self, name: str, df: DataFrame, partition_by: Sequence[str] = ()) -> str:
        """Write a new version; the old one stays readable for running queries."""
        return self._replace(name, df, partition_by, self._next(name))

    def _next(self, name: str) -> dict[str, int]:
        """Per writer, the first batch id that is neither stored nor in the version."""
        versions = self._versions(name)
        out = self._contained(name, versions[-1][0]) if versions else {}
        for b in self._batches(name):
            out[b.writer] = max(out.get(b.writer, 0), b.number + 1)
        return out

    def _replace(
        self, name: str, df: DataFrame, partition_by: Sequence[str], contained: dict[str, int]
    ) -> str:
        number = max([v for v, _ in self._versions(name)], default=0) + 1
        marks = self.spark.createDataFrame(list(contained.items()), _CONTAINS)
        marks.write.mode("overwrite").json(f"{self.root}/{name}/contains/v{number:06d}")
        path = f"{self.root}/{name}/v{number:06d}"
        writer = df.write.mode("overwrite")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(path)
        return path

    def write_batch(self, name: str, df: DataFrame, batch_id: int, writer: str | None = None) -> str:
        """Add a batch of rows; a writer that repeats a batch id replaces that batch only."""
        writer = writer or current_writer(self.spark)
        path = f"{self.root}/{name}/batches/{writer}-{batch_id:012d}"
        df.write.mode("overwrite").parquet(path)
        return path

    def compact(self, name: str, schema: T.StructType, keys: Sequence[str], order: Sequence[str],
                partition_by: Sequence[str] = ()) -> str:
        """Fold the batches written so far into a new version; later ones stay on top."""
        contained = self._next(name)
        version, batches = self._current(name)
        paths = version + [b.path for b in batches if b.number < contained[b.writer]]
        rows = last_per(self._scan(paths, schema), keys, order)
        return self._replace(name, rows, partition_by, contained)

    # --- folders ------------------------------------------------------------------

    def _committed(self, pattern: str) -> list[tuple[str, int]]:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(pattern)
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        found = fs.globStatus(path) or []
        return [(str(s.getPath().getParent().toString()), s.getModificationTime()) for s in found]

    def _versions(self, name: str) -> list[tuple[int, str]]:
        out = []
        for path, _ in self._committed(f"{self.root}/{name}/v*/_SUCCESS"):
            match = _VERSION.search(path)
            if match:
                out.append((int(match[1]), path))
        return sorted(out)

    def _contained(self, name: str, version: int) -> dict[str, int]:
        marks = self.spark.read.schema(_CONTAINS).json(f"{self.root}/{name}/contains/v{version:06d}")
        return {r["writer"]: r["next_batch"] for r in marks.collect()}  # one row per writer

    def _batches(self, name: str) -> list[Batch]:
        out = []
        for path, written in self._committed(f"{self.root}/{name}/batches/*/_SUCCESS"):
            match = _BATCH.search(path)
            if match:
                out.append(Batch(written, match[1], int(match[2]), path))
        return sorted(out, key=lambda b: (b.writer, b.number))

    def _current(
        self, name: str, before: int | None = None, writer: str | None = None
    ) -> tuple[list[str], list[Batch]]:
        versions = self._versions(name)
        contained = self._contained(name, versions[-1][0]) if versions else {}
        own = writer or current_writer(self.spark)
        later = [
            b for b in self._batches(name)
            if b.number >= contained.get(b.writer, 0)
            and not (before is not None and b.writer == own and b.number >= before)
        ]
        return [path for _, path in versions[-1:]], later


def save_bucketed(
    df: DataFrame, table: str, path: str, keys: Sequence[str] = schemas.KEYS, buckets: int = 1024
) -> None:
    """Catalog table bucketed and sorted by key.

    Two tables written with the same keys and bucket count join on those keys without a
    shuffle: the layout for records and assignments, which every report joins.
    """
    (
        df.repartition(buckets, *keys)
        .write.mode("overwrite")
        .option("path", path)
        .bucketBy(buckets, *keys)
        .sortBy(*keys)
        .saveAsTable(table)
    )
