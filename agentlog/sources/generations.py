"""Tables that change together.

All tables of a generation are plain Parquet in a folder of their own; one row appended to
`commits` makes them visible at once. A run that stops half way leaves the former
generation in place, and a repeated commit of the same name does nothing.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

_COMMITS = T.StructType([T.StructField("number", T.LongType()), T.StructField("name", T.StringType())])


@dataclass(frozen=True)
class Generations:
    """Generations under `root`. Commits must come one after another, as recomputes do: the
    later one replaces whatever a concurrent one wrote."""

    spark: SparkSession
    root: str

    def commits(self) -> DataFrame:
        """(number, name), one row per generation."""
        try:
            return self.spark.read.schema(_COMMITS).parquet(f"{self.root}/commits")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], _COMMITS)

    def current(self) -> str | None:
        """Name of the newest generation."""
        last = self.commits().agg(F.max_by("name", F.struct("number", "name"))).first()
        return last[0]

    def commit(self, name: str, tables: Mapping[str, DataFrame]) -> None:
        """Write `tables` as the generation `name` and make it the newest."""
        done = self.commits()
        if not done.where(F.col("name") == name).isEmpty():
            return
        for table, df in tables.items():
            df.write.mode("overwrite").parquet(self._path(name, table))
        number = F.coalesce(F.max("number"), F.lit(0)) + 1
        row = done.agg(number.alias("number")).select("number", F.lit(name).alias("name"))
        # read before the append, which changes what `done` scans
        self.spark.createDataFrame(row.collect(), _COMMITS).coalesce(1).write.mode("append").parquet(
            f"{self.root}/commits"
        )

    def read(self, table: str, schema: T.StructType) -> DataFrame:
        """A table of the newest generation; empty before the first."""
        name = self.current()
        if name is None:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self._path(name, table))

    def _path(self, name: str, table: str) -> str:
        return f"{self.root}/generations/{name}/{table}"
