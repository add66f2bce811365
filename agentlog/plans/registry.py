"""Registry of runnable queries and, where SQL can say the same, their reference SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from agentlog.plans.fixtures import Fixtures, ctes


@dataclass(frozen=True)
class Query:
    build: Callable[[Fixtures], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None, views: tuple[str, ...] = ()):
    """Register `build(fixtures)` under the operator's id and name.

    `sql` is a DuckDB statement over the given tables; `views` are fixture views it needs.
    A statement starting with `, ` continues the WITH clause.
    """

    def add(build: Callable[[Fixtures], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        text = sql
        if text is not None and views:
            text = f"{ctes(*views)}\n{text.strip()}"
        QUERIES[name] = Query(build, text)
        return build

    return add


def runner(q: Query) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return q.build(Fixtures(spark, sf_dir))

    return run
