"""Scenario discovery, capping, stable ids, representatives, online assignment, recompute.

Discovery is density clustering on a graph of neighbours (`density.py`): classes of any size
and groups of any density, a small tight group beside large loose or shapeless ones.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from datetime import datetime

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window, functions as F

from agentlog.config import ScenarioConfig
from agentlog.functions.ids import cluster_number, scenario_id, technical_name
from agentlog.functions.taxonomy import UNKNOWN, filled
from agentlog.functions.text import squash, strip
from agentlog.functions.vectors import mean_vector, plain, unit_rows
from agentlog.operators.density import density_clusters, row_node
from agentlog.operators.embedding import nearest, pairs_above, vector_search
from agentlog.operators.joins import broadcast_checked, recompute_input
from agentlog.operators.keyed import first_per
from agentlog.operators.ranking import rank_within
from agentlog.session import cut_lineage


# --- discovery --------------------------------------------------------------------


def effective_sizes(n: Column, cfg: ScenarioConfig) -> tuple[Column, Column]:
    """min_cluster_size and min_samples after the clamps for small classes."""
    size = F.greatest(
        F.lit(2), F.least(F.lit(cfg.min_cluster_size), F.greatest(F.lit(2), F.floor(n / 3)))
    )
    return size, F.greatest(F.lit(1), F.least(F.lit(cfg.min_samples), size))


def _reduced(v: DataFrame, dim: int, cfg: ScenarioConfig) -> tuple[DataFrame, int]:
    """Vectors in a column `__x`, projected on principal components if the caller asks."""
    dense = F.col("embedding").cast("array<double>")
    if cfg.reduce_dims is None or dim <= cfg.reduce_dims:
        return v.withColumn("__x", dense), dim
    with_vector = v.withColumn("__in", array_to_vector(dense))
    model = PCA(k=cfg.reduce_dims, inputCol="__in", outputCol="__out").fit(with_vector)
    out = model.transform(with_vector).withColumn("__x", vector_to_array("__out"))
    return out.drop("__in", "__out"), cfg.reduce_dims


@dataclass(frozen=True)
class Discovery:
    """Labelled rows (label -1 = outlier) and one row per class with its status."""

    rows: DataFrame
    types: DataFrame


def discover_scenarios(v: DataFrame, cfg: ScenarioConfig = ScenarioConfig()) -> Discovery:
    """Scenario labels per class with the fallbacks for small or shapeless classes (M7).

    `v` has request_id, task_type and embedding, perhaps source_id, and is a stored table or
    close to one: its vectors are read a fixed number of times. Rows of equal keys count once
    and get one label. Adds label, scenario_id and is_outlier.
    """
    v = v.withColumn("task_type", filled(F.col("task_type"), UNKNOWN))
    sizes = v.groupBy("task_type").agg(F.count(F.lit(1)).alias("size"), F.max(F.size("embedding")).alias("dim"))
    min_size, min_samples = effective_sizes(F.col("size"), cfg)
    sizes = cut_lineage(sizes.withColumn("min_size", min_size).withColumn("min_samples", min_samples))
    dim = int(sizes.agg(F.max("dim")).first()[0] or 0)
    rows, reduced = _reduced(v, dim, cfg)
    keys = [c for c in ("source_id", "request_id") if c in v.columns]
    rows = rows.withColumn("node", row_node(v, keys))
    searched = sizes.drop("dim").where(F.col("size") >= cfg.min_cluster_size)
    found = density_clusters(rows.select("task_type", "node", "__x"), searched, reduced, cfg)

    counts = found.groupBy("task_type", "raw").agg(F.count(F.lit(1)).alias("rows"))
    kept = counts.join(sizes, "task_type").where(F.col("rows") >= F.col("min_size"))
    by_size = rank_within(kept.select("task_type", "raw", (-F.col("rows")).alias("order")), ["task_type"], ["order", "raw"], "label")
    names = cut_lineage(by_size.select("task_type", "raw", F.col("label").cast("bigint").alias("label")))

    clusters = names.groupBy("task_type").agg(F.count(F.lit(1)).alias("clusters"))
    small = F.col("size") < cfg.min_cluster_size
    types = cut_lineage(
        sizes.join(clusters, "task_type", "left").select(
            "task_type",
            "size",
            F.when(small, F.lit("small_group_centroid"))
            .when(F.coalesce("clusters", F.lit(0)) == 0, F.lit("all_outliers_collapsed"))
            .otherwise(F.lit("none"))
            .alias("fallback"),
        )
    ).withColumn(
        "statistical_reliability", F.when(F.col("fallback") == "none", F.lit("high")).otherwise(F.lit("low"))
    )
    labels = cut_lineage(found.join(names, ["task_type", "raw"]).select("node", "label"))
    label = F.when(F.col("fallback") != "none", F.lit(0)).otherwise(F.coalesce("label", F.lit(-1)))
    labelled = (
        rows.drop("__x").join(labels, "node", "left")
        .join(broadcast_checked(types.select("task_type", "fallback")), "task_type")
        .withColumn("label", label.cast("bigint"))
        .drop("node", "fallback")
    )
    return Discovery(with_scenario_ids(labelled), types)


def with_scenario_ids(labelled: DataFrame) -> DataFrame:
    """scenario_id and is_outlier of a label column."""
    out = labelled.withColumn("is_outlier", F.col("label") < 0)
    return out.withColumn(
        "scenario_id", F.when(~F.col("is_outlier"), scenario_id(F.col("task_type"), F.col("label")))
    )


def centroids(rows: DataFrame) -> DataFrame:
    """Mean member vector and size of every scenario, in the original space (M9)."""
    members = rows.where(F.col("scenario_id").isNotNull())
    return members.groupBy("task_type", "scenario_id").agg(
        mean_vector(F.col("embedding")).alias("centroid"), F.count(F.lit(1)).alias("records_count")
    )


def cap_clusters(rows: DataFrame, max_clusters: int = ScenarioConfig.max_clusters) -> DataFrame:
    """Keep the largest clusters of each class; members of the others move to the most
    similar kept one; outliers stay; labels are renumbered (M8)."""
    sizes = rows.where("label >= 0").groupBy("task_type", "label").agg(F.count(F.lit(1)).alias("n"))
    by_size = Window.partitionBy("task_type").orderBy(F.desc("n"), "label")  # one row per cluster
    ranked = cut_lineage(sizes.withColumn("rank", F.row_number().over(by_size)))
    kept = ranked.where(F.col("rank") <= max_clusters)
    by_label = Window.partitionBy("task_type").orderBy("label")
    names = kept.withColumn("new", F.row_number().over(by_label).cast("bigint") - 1).select(
        "task_type", "label", "new"
    )
    marked = rows.join(broadcast_checked(names), ["task_type", "label"], "left")
    stay = marked.where((F.col("label") < 0) | F.col("new").isNotNull())
    stay = stay.withColumn("label", F.coalesce("new", "label")).drop("new")
    move = marked.where((F.col("label") >= 0) & F.col("new").isNull()).drop("new")
    anchors = centroids(with_scenario_ids(stay)).withColumn(
        "new", F.format_string("%06d", cluster_number(F.col("scenario_id")))
    )
    moved = nearest(move, anchors, ref_id="new", ref_vec="centroid")
    moved = moved.withColumn("label", F.coalesce(F.col("best_ref").cast("bigint"), F.lit(0))).drop("best_ref", "best_sim")
    return with_scenario_ids(stay.unionByName(moved))


# --- stable ids -------------------------------------------------------------------


def match_pairs(pairs: DataFrame) -> DataFrame:
    """One-to-one matching, the best remaining pair first: task_type, new_id, stable_id.

    `pairs` has task_type, new_id, old_id, sim, n_new and n_old. A pair that is the best of
    both its sides is taken before any that shares one with it, so all such pairs of a round
    are taken at once; rounds go on until no pair is left. The order is strict, so the result
    is that of one sorted pass. No class is gathered in one task.
    """
    rank = F.struct((-F.col("sim")).alias("neg"), "n_new", "n_old", "new_id", "old_id")
    left = cut_lineage(pairs.select("task_type", "new_id", "old_id", rank.alias("rank")))
    matched = None
    while not left.isEmpty():
        by_new = left.groupBy("task_type", "new_id").agg(F.min("rank").alias("rank"))
        by_old = left.groupBy("task_type", "old_id").agg(F.min("rank").alias("rank"))
        found = cut_lineage(
            by_new.join(by_old, ["task_type", "rank"]).select("task_type", "new_id", "old_id")
        )
        matched = found if matched is None else matched.unionByName(found)
        left = cut_lineage(
            left.join(found.select("task_type", "new_id"), ["task_type", "new_id"], "left_anti")
            .join(found.select("task_type", "old_id"), ["task_type", "old_id"], "left_anti")
        )
    out = left.select("task_type", "new_id", "old_id") if matched is None else matched
    return out.withColumnRenamed("old_id", "stable_id")


def free_indices(unmatched: DataFrame, used: DataFrame) -> DataFrame:
    """Smallest numbers not used in the class, handed out in order of `n`.

    `unmatched` has task_type, new_id, n; `used` has task_type, n. With k unmatched and u
    used numbers the answer lies below k + u.
    """
    need = unmatched.groupBy("task_type").agg(F.count(F.lit(1)).alias("k"))
    have = used.groupBy("task_type").agg(F.count(F.lit(1)).alias("u"))
    pool = need.join(have, "task_type", "left").select(
        "task_type",
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("k") + F.coalesce("u", F.lit(0)))).alias("n"),
    )
    free = pool.join(used.select("task_type", "n").distinct(), ["task_type", "n"], "left_anti")
    w = Window.partitionBy("task_type")  # scenarios of one class
    left = unmatched.withColumn("pos", F.row_number().over(w.orderBy("n", "new_id")))
    right = free.withColumn("pos", F.row_number().over(w.orderBy("n"))).withColumnRenamed("n", "free_n")
    return left.join(right, ["task_type", "pos"]).select("task_type", "new_id", "free_n")


def stabilize_ids(new: DataFrame, old: DataFrame, threshold: float = ScenarioConfig.match_threshold) -> DataFrame:
    """Map new scenario ids to the ids of similar earlier ones.

    Both sides have task_type, scenario_id, centroid. Pairs are matched most similar
    first; unmatched scenarios take free numbers; a class without earlier scenarios keeps
    its ids.
    """
    # Roles are swapped so the (few) new centroids are the side that is held in memory.
    pairs = pairs_above(old.withColumnRenamed("scenario_id", "old_id"), new, threshold).select(
        "task_type", F.col("ref").alias("new_id"), "old_id", "sim"
    )
    pairs = pairs.withColumn("n_new", cluster_number(F.col("new_id"))).withColumn(
        "n_old", cluster_number(F.col("old_id"))
    )
    matched = cut_lineage(match_pairs(pairs))
    ids = new.select("task_type", F.col("scenario_id").alias("new_id"), cluster_number(F.col("scenario_id")).alias("n"))
    known = old.select("task_type").distinct()
    first = ids.join(known, "task_type", "left_anti").select("task_type", "new_id", F.col("new_id").alias("stable_id"))
    rest = ids.join(known, "task_type", "left_semi").join(matched, ["task_type", "new_id"], "left_anti")
    used = matched.select("task_type", cluster_number(F.col("stable_id")).alias("n"))
    fresh = free_indices(rest, used).select(
        "task_type", "new_id", scenario_id(F.col("task_type"), F.col("free_n")).alias("stable_id")
    )
    return first.unionByName(matched).unionByName(fresh)


def apply_mapping(df: DataFrame, mapping: DataFrame) -> DataFrame:
    """Replace scenario ids; unmapped ids and nulls stay."""
    pairs = broadcast_checked(mapping.select(F.col("new_id").alias("scenario_id"), "stable_id"))
    return (
        df.join(pairs, "scenario_id", "left")
        .withColumn("scenario_id", F.coalesce("stable_id", "scenario_id"))
        .drop("stable_id")
    )


# --- representatives --------------------------------------------------------------

_ORDER = ("timestamp", "request_id")


def _unique_texts(v: DataFrame, cents: DataFrame | None = None) -> DataFrame:
    """First row of every text of a scenario, with its similarity to the own centroid.

    Similarity is computed on the scan, so no vector enters the shuffle of the dedup.
    """
    texts = v.where(F.col("scenario_id").isNotNull()).withColumn("query_text", strip(F.col("query_text")))
    texts = texts.where(F.col("query_text") != "")
    cols = ["scenario_id", "query_text", *_ORDER]
    if cents is not None:
        texts = nearest(texts, cents, on="scenario_id", ref_id="scenario_id", ref_vec="centroid")
        cols.append("best_sim")
    return first_per(texts.select(*cols), ["scenario_id", "query_text"], _ORDER)


def near_far(scored: DataFrame, group: str, score: str, near: int, far: int, tie: Sequence[str]) -> DataFrame:
    """The `near` highest and `far` lowest rows per group without overlap, all when few.

    Both rank filters cut every partition to a few rows per group before the shuffle.
    Adds `position`: highest first, then lowest first.
    """
    top = Window.partitionBy(group).orderBy(F.desc(score), *[F.asc(c) for c in tie])
    low = Window.partitionBy(group).orderBy(F.asc(score), *[F.desc(c) for c in tie])
    total = near + far
    high = scored.withColumn("position", F.row_number().over(top)).where(F.col("position") <= total + 1)
    full = high.groupBy(group).agg(F.max("position").alias("__most"))
    high = high.join(full, group).where(
        (F.col("__most") <= total) | (F.col("position") <= near)
    )
    tail = scored.withColumn("position", F.row_number().over(low)).where(F.col("position") <= far)
    tail = tail.join(full.where(F.col("__most") > total), group).withColumn("position", F.col("position") + near)
    return high.drop("__most").unionByName(tail.drop("__most"))


def representatives(
    v: DataFrame, cents: DataFrame | None, count: int = ScenarioConfig.examples,
    boundary: int = ScenarioConfig.boundary,
) -> DataFrame:
    """Texts that stand for a scenario: distinct, mostly nearest to the centroid plus a few
    farthest; without centroids evenly spaced in time (M12).

    `v` has scenario_id, task_type, query_text, embedding, timestamp, request_id.
    """
    count = max(1, count)
    unique = _unique_texts(v, cents)
    if cents is None:
        ranked = rank_within(unique, ["scenario_id"], list(_ORDER), "idx", "size")
        step = F.greatest(F.lit(1), F.floor(F.col("size") / count))
        chosen = (F.pmod("idx", step) == 0) & (F.col("idx") < step * count)
        kept = ranked.where(chosen | (F.col("size") <= count))
        position = Window.partitionBy("scenario_id").orderBy("idx")  # at most `count` rows
        return kept.select(
            "scenario_id", "query_text", "request_id", F.row_number().over(position).cast("bigint").alias("position")
        )
    near = max(1, count - max(0, boundary)) if boundary > 0 else count
    picked = near_far(unique, "scenario_id", "best_sim", near, count - near, _ORDER)
    return picked.select("scenario_id", "query_text", "request_id", F.col("position").cast("bigint").alias("position"))


def representatives_search(v: DataFrame, cents: DataFrame, count: int = ScenarioConfig.examples) -> DataFrame:
    """Texts of the vectors found by searching with each centroid, own scenario only."""
    queries = cents.select(F.col("scenario_id").alias("query_id"), F.col("centroid").alias("embedding"))
    found = broadcast_checked(cut_lineage(vector_search(v, queries, count)))
    hits = v.select("request_id", "query_text", F.col("scenario_id").alias("own")).join(found, "request_id")
    text = strip(filled(F.col("query_text"), ""))
    kept = hits.withColumn("query_text", text).where(
        (F.col("own").isNull() | (F.col("own") == F.col("query_id"))) & (F.col("query_text") != "")
    )
    first = first_per(
        kept.select(F.col("query_id").alias("scenario_id"), "query_text", "rank", "request_id"),
        ["scenario_id", "query_text"],
        ["rank", "request_id"],
    )
    return first.select("scenario_id", "query_text", "request_id", F.col("rank").alias("position"))


# --- scenario descriptions --------------------------------------------------------


def technical_summary(clusters: DataFrame) -> DataFrame:
    """Description of a scenario nobody has summarised."""
    n = cluster_number(F.col("scenario_id"))
    return clusters.select(
        "scenario_id",
        "task_type",
        technical_name(F.col("task_type"), n).alias("name"),
        F.lit("Summary unavailable").alias("summary"),
        F.lit("Unknown").alias("user_goal"),
        F.array().cast("array<string>").alias("pain_points"),
        F.lit("low").alias("automation_potential"),
    )


def sanitize_summaries(summaries: DataFrame, defaults: DataFrame) -> DataFrame:
    """Clean model-written summaries.

    Name at most four words, automation one of low / medium / high, examples defaulting to
    the first five of `defaults` (scenario_id, examples). Rows without a name are dropped;
    the caller falls back to `technical_summary`.
    """
    name = squash(filled(F.col("name"), ""))
    potential = F.lower(strip(filled(F.col("automation_potential"), "low")))
    spare = defaults.select("scenario_id", F.slice("examples", 1, 5).alias("__spare"))
    return (
        summaries.where(name != "")
        .join(spare, "scenario_id", "left")
        .withColumn(
            "name",
            F.when(F.size(F.split(name, " ")) > 4, F.array_join(F.slice(F.split(name, " "), 1, 4), " ")).otherwise(
                strip(F.col("name"))
            ),
        )
        .withColumn(
            "automation_potential",
            F.when(potential.isin("low", "medium", "high"), potential).otherwise(F.lit("low")),
        )
        .withColumn(
            "examples",
            F.when(F.size("examples") > 0, F.col("examples")).otherwise(
                F.coalesce("__spare", F.array().cast("array<string>"))
            ),
        )
        .drop("__spare")
    )


# --- online assignment ------------------------------------------------------------


@dataclass(frozen=True)
class OnlineResult:
    """Assigned rows and the centroids after the batch."""

    rows: DataFrame
    centroids: DataFrame


def initial_centroids(clusters: DataFrame) -> DataFrame:
    """Centroid state for online assignment out of the cluster table (T4)."""
    return clusters.where(F.size("centroid") > 0).select(
        "scenario_id",
        filled(F.col("task_type"), UNKNOWN).alias("task_type"),
        F.col("centroid").cast("array<double>").alias("centroid"),
        F.greatest(F.lit(1), F.coalesce("records_count", F.lit(1))).cast("bigint").alias("count"),
    )


LEADERS_PER_ROUND = 500


def _leaders_of(threshold: float):
    """Group function over at most LEADERS_PER_ROUND rows: rows far from all earlier ones."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(list(_ORDER)).reset_index(drop=True)
        rows = unit_rows(np.array(pdf["embedding"].tolist(), dtype=np.float64))
        chosen: list[int] = []
        for i in range(len(rows)):
            if not chosen or (rows[chosen] @ rows[i]).max() < threshold:
                chosen.append(i)
        return plain(pdf.iloc[chosen])

    return run


def _new_leaders(misses: DataFrame, threshold: float) -> DataFrame:
    """Rows that open a scenario when the misses are read in time order.

    Each round settles the earliest rows of every class in one bounded group and then
    removes all rows similar to a leader found so far, in parallel. A leader always comes
    before the rows it removes, so the leaders are those of a strictly sequential pass.
    """
    leaders: DataFrame | None = None
    open_rows = misses
    while True:
        w = Window.partitionBy("task_type").orderBy(*_ORDER)
        head = open_rows.withColumn("__rn", F.row_number().over(w)).where(
            F.col("__rn") <= LEADERS_PER_ROUND
        ).drop("__rn")
        found = cut_lineage(head.groupBy("task_type").applyInPandas(_leaders_of(threshold), misses.schema))
        if found.isEmpty():
            return leaders if leaders is not None else found
        leaders = found if leaders is None else leaders.unionByName(found)
        refs = found.select("task_type", F.col("request_id").alias("scenario_id"), F.col("embedding").alias("centroid"))
        near = nearest(open_rows, refs)
        left = ~F.coalesce(F.col("best_sim") >= threshold, F.lit(False))
        done = found.select("request_id")
        open_rows = cut_lineage(
            near.where(left).drop("best_ref", "best_sim").join(done, "request_id", "left_anti")
        )


def assign_online(
    v: DataFrame, state: DataFrame, threshold: float = ScenarioConfig.join_threshold
) -> OnlineResult:
    """Assign a batch to scenarios; rows similar to none open new ones.

    `v` has request_id, task_type, timestamp, embedding (other columns pass through);
    `state` is `initial_centroids`. Order inside the batch is (timestamp, request_id).
    Centroids stand still during a batch and move to the running mean at its end, which is
    a weighted sum and needs no order.
    """
    order_cols = v.columns
    v = v.withColumn("task_type", filled(F.col("task_type"), UNKNOWN))
    state = cut_lineage(state)
    scored = cut_lineage(nearest(v, state))
    is_hit = F.coalesce(F.col("best_sim") >= threshold, F.lit(False))
    hits = scored.where(is_hit).select(
        *order_cols, F.col("best_ref").alias("scenario_id"), F.col("best_sim").alias("similarity"),
        F.lit(False).alias("is_new_cluster"),
    )
    narrow = ["request_id", "task_type", "timestamp", "embedding"]
    misses = scored.where(~is_hit).drop("best_ref", "best_sim")
    leaders = _new_leaders(misses.select(*narrow), threshold)

    used = state.groupBy("task_type").agg(F.max(cluster_number(F.col("scenario_id"), None)).alias("top"))
    place = Window.partitionBy("task_type").orderBy(*_ORDER)  # new scenarios of one class
    named = cut_lineage(
        leaders.withColumn("pos", F.row_number().over(place))
        .join(used, "task_type", "left")
        .select(
            "task_type",
            "request_id",
            "timestamp",
            scenario_id(F.col("task_type"), F.coalesce("top", F.lit(-1)) + F.col("pos")).alias("scenario_id"),
            F.col("embedding").cast("array<double>").alias("centroid"),
        )
    )
    opened = misses.join(named.select("request_id", "scenario_id"), "request_id").select(
        *order_cols, "scenario_id", F.lit(1.0).alias("similarity"), F.lit(True).alias("is_new_cluster")
    )
    followers = misses.join(named.select("request_id"), "request_id", "left_anti")
    joined = _join_earlier(followers, named, threshold).select(
        *order_cols, "scenario_id", "similarity", F.lit(False).alias("is_new_cluster")
    )
    rows = cut_lineage(hits.unionByName(opened).unionByName(joined))
    return OnlineResult(rows, _moved_centroids(state, rows))


def _join_earlier(rows: DataFrame, leaders: DataFrame, threshold: float) -> DataFrame:
    """Most similar leader that comes before the row.

    Pairs above the threshold are few per row; their time order is checked on the pairs.
    """
    refs = leaders.select("task_type", "scenario_id", "centroid")
    pairs = pairs_above(rows, refs, threshold, vec="embedding")
    when = leaders.select(
        F.col("scenario_id").alias("ref"), F.struct(F.col("timestamp"), F.col("request_id")).alias("__at")
    )
    earlier = pairs.join(when, "ref").where(F.col("__at") < F.struct("timestamp", "request_id"))
    best = F.min(F.struct((-F.col("sim")).alias("neg"), cluster_number(F.col("ref")).alias("n"), "ref")).alias("b")
    picked = earlier.groupBy("request_id").agg(best).select(
        "request_id", F.col("b.ref").alias("scenario_id"), (-F.col("b.neg")).alias("similarity")
    )
    return rows.join(picked, "request_id")


def _moved_centroids(state: DataFrame, rows: DataFrame) -> DataFrame:
    """Running mean of every scenario after the batch."""
    batch = rows.groupBy("scenario_id", "task_type").agg(
        mean_vector(F.col("embedding")).alias("__mean"), F.count(F.lit(1)).alias("__n")
    )
    old = F.coalesce("count", F.lit(0)).cast("double")
    new = F.coalesce("__n", F.lit(0)).cast("double")
    blend = F.zip_with("centroid", "__mean", lambda c, m: (c * old + m * new) / (old + new))
    return state.join(batch, ["scenario_id", "task_type"], "full_outer").select(
        "scenario_id",
        "task_type",
        F.when(F.col("__mean").isNull(), F.col("centroid"))
        .when(F.col("centroid").isNull(), F.col("__mean"))
        .otherwise(blend)
        .alias("centroid"),
        (F.coalesce("count", F.lit(0)) + F.coalesce("__n", F.lit(0))).alias("count"),
    )


# --- recompute --------------------------------------------------------------------


@dataclass(frozen=True)
class Recompute:
    rows: DataFrame
    clusters: DataFrame
    run: DataFrame


def recompute(
    assignments: DataFrame,
    vectors: DataFrame,
    clusters: DataFrame,
    now: datetime,
    job_id: str,
    cfg: ScenarioConfig = ScenarioConfig(),
    dim: int | None = None,
    summarise: Callable[[DataFrame], DataFrame] | None = None,
) -> Recompute:
    """Rebuild all scenarios: discover, cap, keep ids stable, describe, record the run.

    All classes run in the same jobs. `summarise` turns representatives (scenario_id,
    query_text, request_id, position) into replies (scenario_id, name, summary, user_goal,
    pain_points, automation_potential, examples), a few rows per scenario; a scenario
    without a usable reply keeps its technical name. `rows` feeds `keyed.update_scenarios`, `clusters`
    feeds `keyed.replace_clusters`.
    """
    dim = dim or int(vectors.agg(F.max(F.size("embedding"))).first()[0] or 1)
    data = recompute_input(assignments, vectors, dim)
    found = discover_scenarios(data.drop("scenario_id", "is_outlier"), cfg)
    capped = cap_clusters(found.rows, cfg.max_clusters)
    fresh = cut_lineage(centroids(capped))
    old = clusters.where(F.size("centroid") > 0).select("task_type", "scenario_id", "centroid")
    mapping = cut_lineage(stabilize_ids(fresh, old, cfg.match_threshold))
    rows = apply_mapping(cut_lineage(capped.drop("embedding", "has_vector")), mapping)
    described = apply_mapping(fresh, mapping)
    stamp = F.lit(now).cast("timestamp")
    n = cluster_number(F.col("scenario_id"))
    table = cut_lineage(
        described.join(found.types.select("task_type", "statistical_reliability"), "task_type").select(
            "scenario_id",
            "task_type",
            technical_name(F.col("task_type"), n).alias("name"),
            F.lit(None).cast("string").alias("summary"),
            F.lit(None).cast("string").alias("user_goal"),
            F.array().cast("array<string>").alias("pain_points"),
            F.lit(None).cast("string").alias("automation_potential"),
            "records_count",
            "statistical_reliability",
            "centroid",
            stamp.alias("updated_at"),
        )
    )
    if summarise is not None:
        shown = representatives(
            apply_mapping(capped, mapping).where("has_vector"),
            described.select("task_type", "scenario_id", "centroid"),
        )
        table = cut_lineage(_summarised(table, cut_lineage(shown), summarise))
    logs = assignments.agg(F.count(F.lit(1))).scalar()
    fallback = found.types.agg(F.coalesce(F.bool_or(F.col("fallback") != "none"), F.lit(False))).scalar()
    kinds = found.types.agg(F.array_sort(F.collect_list("task_type"))).scalar()
    run = table.agg(
        F.count(F.lit(1)).alias("clusters_created"), F.count("name").alias("scenarios_named")
    ).select(
        F.lit(job_id).alias("job_id"),
        F.lit("completed").alias("status"),
        "clusters_created",
        "scenarios_named",
        logs.alias("logs_at_completion"),
        fallback.alias("fallback_used"),
        kinds.alias("task_types"),
        stamp.alias("started_at"),
        stamp.alias("completed_at"),
    )
    return Recompute(rows, table, run)


def _summarised(
    table: DataFrame, shown: DataFrame, summarise: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """The cluster table with the replies on its representatives."""
    texts = F.transform(F.array_sort(F.collect_list(F.struct("position", "query_text"))), lambda x: x["query_text"])
    examples = shown.groupBy("scenario_id").agg(texts.alias("examples"))  # few per scenario
    replies = first_per(sanitize_summaries(summarise(shown), examples), ["scenario_id"], ["name"])
    told = ("name", "summary", "user_goal", "pain_points", "automation_potential")
    found = replies.select("scenario_id", *[F.col(c).alias(f"__{c}") for c in told])
    out = table.join(found, "scenario_id", "left")
    return out.withColumns({c: F.coalesce(f"__{c}", c) for c in told}).select(*table.columns)
