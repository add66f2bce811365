"""Everything a recompute changes, as one state to the next."""

from __future__ import annotations

from dataclasses import dataclass, fields
from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from agentlog import schemas
from agentlog.operators import keyed
from agentlog.operators.scenarios import Recompute, initial_centroids
from agentlog.sources.generations import Generations


@dataclass(frozen=True)
class LogState:
    assignments: DataFrame
    clusters: DataFrame
    sources: DataFrame
    recompute_runs: DataFrame
    centroids: DataFrame


_SCHEMAS = {
    "assignments": schemas.ASSIGNMENTS, "clusters": schemas.CLUSTERS, "sources": schemas.SOURCES,
    "recompute_runs": schemas.RECOMPUTE_RUNS, "centroids": schemas.CENTROIDS,
}


def load_state(store: Generations) -> LogState:
    """The newest generation; empty tables before the first."""
    return LogState(**{f.name: store.read(f.name, _SCHEMAS[f.name]) for f in fields(LogState)})


def after_recompute(state: LogState, result: Recompute, now: datetime | Column) -> LogState:
    """The state that follows from a recompute.

    Assignments take their new scenarios by source and request, clusters of recomputed
    classes are replaced, sources that did not fail count as recomputed, the run joins the
    log (once, however often it is repeated) and online centroids start from the clusters.
    """
    stamp = (now if isinstance(now, Column) else F.lit(now)).cast("timestamp")
    clusters = keyed.replace_clusters(state.clusters, result.clusters)
    run = result.run.withColumn("created_at", stamp).withColumn("error", F.lit(None).cast("string"))
    run = run.select(*schemas.RECOMPUTE_RUNS.fieldNames())
    runs = state.recompute_runs.join(run.select("job_id"), "job_id", "left_anti").unionByName(run)
    return LogState(
        keyed.update_scenarios(state.assignments, result.rows, stamp, ["scenario_id"]),
        clusters.select(*schemas.CLUSTERS.fieldNames()),
        keyed.mark_recomputed(state.sources),
        runs,
        initial_centroids(clusters).select(*schemas.CENTROIDS.fieldNames()),
    )


def commit_state(store: Generations, name: str, state: LogState) -> None:
    """Store a state as one generation."""
    store.commit(name, {f.name: getattr(state, f.name) for f in fields(LogState)})


def labelled_vectors(vectors: DataFrame, assignments: DataFrame) -> DataFrame:
    """Vectors with the class, scenario and outlier flag of their assignment.

    Vectors are never rewritten for new labels: these are joined on reading, without a
    shuffle where both tables are bucketed by their keys (`save_bucketed`).
    """
    labels = assignments.select(
        *schemas.KEYS, F.col("task_type").alias("__type"), F.col("scenario_id").alias("__sid"),
        F.col("is_outlier").alias("__out"), F.lit(True).alias("__hit"),
    )
    hit = F.col("__hit").isNotNull()
    joined = vectors.join(labels, list(schemas.KEYS), "left")
    return joined.withColumns(
        {
            "task_type": F.coalesce("__type", "task_type"),
            "scenario_id": F.when(hit, F.col("__sid")).otherwise(F.col("scenario_id")),
            "is_outlier": F.when(hit, F.coalesce("__out", F.lit(False))).otherwise(F.col("is_outlier")),
        }
    ).select(*vectors.columns)
