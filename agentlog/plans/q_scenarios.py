"""Scenario discovery, stable ids, online assignment, recompute."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import functions as F

from agentlog import schemas
from agentlog.operators import committing, keyed, scenarios
from agentlog.plans.q_vectors import CENT, _centroids, _labelled
from agentlog.plans.registry import query
from agentlog.session import shared_folder
from agentlog.sources.generations import Generations

V = ("fx_vectors",)


@query(
    "M7_discover_scenarios",
    "SELECT proto, count(*) AS n, 1::BIGINT AS scenarios, 0::BIGINT AS outliers FROM fx_vectors GROUP BY proto",
    V,
)
def _(fx):
    """Every true group must come out as exactly one scenario."""
    found = scenarios.discover_scenarios(fx.vectors)
    return found.rows.groupBy("proto").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct("scenario_id").alias("scenarios"),
        F.count_if("is_outlier").alias("outliers"),
    )


def _with_noise(fx, groups: int, share: float):
    """Rows of one class around the first `groups` vectors; `share` of the own vector is added,
    so a row's cosine to its centre is about 1 / sqrt(1 + share^2)."""
    v = fx.table("embeddings")
    p = v.where(F.col("vec_id") < groups).select(F.col("vec_id").alias("proto"), F.col("embedding").alias("p"))
    mixed = F.zip_with("p", "embedding", lambda a, b: a.cast("double") + share * b.cast("double"))
    return v.withColumn("proto", F.col("vec_id") % groups).join(p, "proto").select(
        F.concat(F.lit("vec_"), F.col("vec_id").cast("string")).alias("request_id"), "proto", F.lit("T").alias("task_type"),
        mixed.alias("embedding"),
    )


@query(
    "M7_loose_groups",
    "SELECT vec_id % 5 AS proto, count(*) AS n, 1::BIGINT AS scenarios, true AS few_outliers FROM embeddings GROUP BY 1",
)
def _(fx):
    """Five groups whose members lie at cosine 0.78 to their centre come apart."""
    found = scenarios.discover_scenarios(_with_noise(fx, 5, 0.8))
    return found.rows.groupBy("proto").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("scenario_id").alias("scenarios"),
        (F.count_if("is_outlier") * 20 <= F.count(F.lit(1))).alias("few_outliers"),
    )


@query(
    "M7_small_group",
    "SELECT 10::BIGINT AS members, 1::BIGINT AS scenarios, 0::BIGINT AS outliers, true AS mostly_alone",
)
def _(fx):
    """Ten rows of one direction beside all vectors of the table, which have no common one."""
    v = fx.table("embeddings")
    names = F.concat(F.lit("vec_"), F.col("vec_id").cast("string")).alias("request_id")
    rows = v.select(names, F.lit(False).alias("small"), F.lit("T").alias("task_type"), F.col("embedding").cast("array<double>"))
    near = _with_noise(fx, 1, 0.3).join(v.where("vec_id BETWEEN 1 AND 10").select(names), "request_id").select(
        F.concat(F.lit("near_"), "request_id").alias("request_id"), F.lit(True).alias("small"), "task_type", "embedding"
    )
    found = scenarios.discover_scenarios(rows.unionByName(near)).rows.select("small", "scenario_id", "is_outlier")
    mine = found.where("small").select("scenario_id").distinct()
    others = found.where("NOT small").join(mine, "scenario_id").agg(F.count(F.lit(1)).alias("others"))
    return found.where("small").agg(
        F.count(F.lit(1)).alias("members"), F.count_distinct("scenario_id").alias("scenarios"),
        F.count_if("is_outlier").alias("outliers"), (others.scalar() <= 10).alias("mostly_alone"),
    )


@query(
    "M8_cap_clusters",
    """, sz AS (SELECT task_type, proto, count(*) AS n, row_number() OVER (PARTITION BY task_type ORDER BY count(*) DESC, proto) AS rk FROM fx_vectors GROUP BY task_type, proto),
 kp AS (SELECT task_type, proto, row_number() OVER (PARTITION BY task_type ORDER BY proto) - 1 AS nl FROM sz WHERE rk <= 2)"""
    + CENT
    + """, s AS (SELECT v.request_id, kp.nl, v.task_type FROM fx_vectors v JOIN kp USING (task_type, proto)
 UNION ALL SELECT v.request_id, kp.nl, v.task_type FROM fx_vectors v JOIN kp USING (task_type) JOIN cent c ON c.proto = kp.proto WHERE NOT EXISTS (SELECT 1 FROM kp k2 WHERE k2.proto = v.proto)
 QUALIFY row_number() OVER (PARTITION BY v.request_id ORDER BY list_cosine_similarity(v.embedding, c.centroid) DESC, kp.nl) = 1)
SELECT request_id, nl AS label, task_type || ':cluster_' || nl AS scenario_id, false AS is_outlier FROM s""",
    V,
)
def _(fx):
    rows = fx.vectors.withColumn("label", F.col("proto"))
    capped = scenarios.cap_clusters(rows, 2)
    return capped.select("request_id", "label", "scenario_id", "is_outlier")


def _old_centroids(fx):
    """Earlier scenarios: same directions under shifted numbers, one of them unknown."""
    c = _centroids(fx)
    n = scenarios.cluster_number(F.col("scenario_id"))
    kept = c.where(n != 5)
    return kept.withColumn("scenario_id", scenarios.scenario_id(F.col("task_type"), (n + 3) % 12))


MAPPING = """, mp AS (SELECT DISTINCT task_type, task_type || ':cluster_' || proto AS new_id, CASE WHEN proto = 5 THEN 'T2:cluster_0' ELSE task_type || ':cluster_' || ((proto + 3) % 12) END AS stable_id FROM fx_vectors)
"""


@query("M10_stabilize_ids", MAPPING + "SELECT * FROM mp", V)
def _(fx):
    return scenarios.stabilize_ids(_centroids(fx), _old_centroids(fx))


@query(
    "M11_apply_mapping",
    MAPPING + "SELECT v.request_id, mp.stable_id AS scenario_id FROM fx_vectors v JOIN mp ON mp.new_id = v.task_type || ':cluster_' || v.proto",
    V,
)
def _(fx):
    mapping = scenarios.stabilize_ids(_centroids(fx), _old_centroids(fx))
    return scenarios.apply_mapping(_labelled(fx).select("request_id", "scenario_id"), mapping)


@query(
    "W7_free_indices",
    """, un AS (SELECT task_type, query_text AS new_id, count(*) AS n FROM fx_assignments GROUP BY ALL),
 us AS (SELECT DISTINCT task_type, CAST(regexp_extract(scenario_id, '([0-9]+)$', 1) AS BIGINT) AS n FROM fx_assignments WHERE scenario_id IS NOT NULL),
 fr AS (SELECT t.task_type, g.n, row_number() OVER (PARTITION BY t.task_type ORDER BY g.n) AS pos FROM (SELECT DISTINCT task_type FROM un) t, (SELECT unnest(range(0, 2000)) AS n) g WHERE (t.task_type, g.n) NOT IN (SELECT (task_type, n) FROM us)),
 up AS (SELECT task_type, new_id, row_number() OVER (PARTITION BY task_type ORDER BY n, new_id) AS pos FROM un)
SELECT up.task_type, up.new_id, fr.n AS free_n FROM up JOIN fr USING (task_type, pos)""",
    ("fx_assignments",),
)
def _(fx):
    a = fx.assignments
    wanted = a.groupBy("task_type", F.col("query_text").alias("new_id")).agg(
        F.count(F.lit(1)).alias("n")
    )
    used = a.where("scenario_id IS NOT NULL").select("task_type", scenarios.cluster_number(F.col("scenario_id")).alias("n")).distinct()
    return scenarios.free_indices(wanted, used)


@query(
    "M15_technical_summary",
    """SELECT scenario_id, task_type, 'Сценарий ' || task_type || ' ' || regexp_extract(scenario_id, '([0-9]+)$', 1) AS name, 'Summary unavailable' AS summary, 'low' AS automation_potential FROM fx_clusters""",
    ("fx_clusters",),
)
def _(fx):
    out = scenarios.technical_summary(fx.clusters)
    return out.select("scenario_id", "task_type", "name", "summary", "automation_potential")


@query(
    "T4_initial_centroids",
    CENT + "SELECT task_type || ':cluster_' || proto AS scenario_id, task_type, len(centroid) AS dim, n AS count FROM cent",
    V,
)
def _(fx):
    state = scenarios.initial_centroids(_centroids(fx))
    return state.select("scenario_id", "task_type", F.size("centroid").cast("bigint").alias("dim"), "count")


@query(
    "M16_assign_online",
    """SELECT request_id, task_type || ':cluster_' || (proto // 3) AS scenario_id, vec_id < 12 AS is_new_cluster FROM fx_vectors""",
    V,
)
def _(fx):
    """From an empty state: the first row of every group opens its scenario, in time order."""
    empty = scenarios.initial_centroids(_centroids(fx)).limit(0)
    return scenarios.assign_online(fx.vectors, empty).rows.select("request_id", "scenario_id", "is_new_cluster")


@query(
    "M16_assign_online_known",
    """, k AS (SELECT request_id, task_type, proto, vec_id, proto NOT IN (4, 7) AS known FROM fx_vectors)
SELECT request_id, CASE WHEN known THEN task_type || ':cluster_' || proto ELSE task_type || ':cluster_' || CASE proto WHEN 4 THEN 11 ELSE 12 END END AS scenario_id, NOT known AND vec_id < 12 AS is_new_cluster FROM k""",
    V,
)
def _(fx):
    """Two of the twelve scenarios are not known yet and get the next free numbers."""
    n = scenarios.cluster_number(F.col("scenario_id"))
    state = scenarios.initial_centroids(_centroids(fx).where(~n.isin(4, 7)))
    return scenarios.assign_online(fx.vectors, state).rows.select("request_id", "scenario_id", "is_new_cluster")


def _recompute(fx):
    a = fx.vectors.select("request_id", "task_type", "timestamp", "query_text", "proto")
    old = _old_centroids(fx)
    return scenarios.recompute(a, fx.vectors, old, datetime(2024, 3, 1), "job")


@query(
    "M14_recompute",
    MAPPING + "SELECT v.request_id, mp.stable_id AS scenario_id, false AS is_outlier FROM fx_vectors v JOIN mp ON mp.new_id = v.task_type || ':cluster_' || v.proto",
    V,
)
def _(fx):
    """Discovered groups get the ids their earlier scenarios had."""
    return _recompute(fx).rows.select("request_id", "scenario_id", "is_outlier")


@query(
    "M14_recompute_run",
    "SELECT 'completed' AS status, 12::BIGINT AS clusters_created, 12::BIGINT AS scenarios_named, count(*) AS logs_at_completion, false AS fallback_used, 'T0,T1,T2' AS task_types FROM fx_vectors",
    V,
)
def _(fx):
    run = _recompute(fx).run
    return run.select(
        "status", "clusters_created", "scenarios_named", "logs_at_completion", "fallback_used",
        F.array_join("task_types", ",").alias("task_types"),
    )


@query(
    "M14_recompute_clusters",
    "SELECT CASE WHEN proto = 5 THEN 'T2:cluster_0' ELSE task_type || ':cluster_' || ((proto + 3) % 12) END AS scenario_id, count(*) AS records_count, 'high' AS statistical_reliability FROM fx_vectors GROUP BY ALL",
    V,
)
def _(fx):
    table = _recompute(fx).clusters
    old = _old_centroids(fx).withColumn("statistical_reliability", F.lit("low"))
    return keyed.replace_clusters(old, table).select("scenario_id", "records_count", "statistical_reliability")


#: Two sources that use the same request ids.
TWO_SOURCES = MAPPING.rstrip() + """, tw AS (SELECT concat('s', v.vec_id % 2) AS source_id, concat('r', v.vec_id // 2) AS request_id, v.task_type, mp.stable_id FROM fx_vectors v JOIN mp ON mp.new_id = v.task_type || ':cluster_' || v.proto)
"""


def _committed(fx):
    """State after a recompute over two sources was stored and read again."""
    spark = fx.spark
    ids = {
        "source_id": F.concat(F.lit("s"), (F.col("vec_id") % 2).cast("string")),
        "request_id": F.concat(F.lit("r"), F.floor(F.col("vec_id") / 2).cast("string")),
    }
    vectors = fx.vectors.withColumns(ids)

    def table(df, schema):
        return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])

    failed = F.when(F.col("source_id") == "s1", "failed").otherwise("classified").alias("status")
    sources = vectors.select("source_id", failed).distinct()
    state = committing.LogState(
        table(vectors, schemas.ASSIGNMENTS), table(_old_centroids(fx), schemas.CLUSTERS),
        table(sources, schemas.SOURCES), spark.createDataFrame([], schemas.RECOMPUTE_RUNS),
        spark.createDataFrame([], schemas.CENTROIDS),
    )
    now = datetime(2024, 3, 1)
    result = scenarios.recompute(state.assignments, vectors, state.clusters, now, "job")
    store = Generations(spark, f"{shared_folder(spark)}/generations-{uuid.uuid4()}")
    for _ in range(2):  # a repeated commit changes nothing
        committing.commit_state(store, "job", committing.after_recompute(state, result, now))
    return committing.load_state(store), table(vectors, schemas.VECTORS)


@query(
    "M14_commit_assignments",
    TWO_SOURCES + "SELECT source_id, request_id, stable_id AS scenario_id, false AS is_outlier, '2024-03-01' AS day FROM tw",
    V,
)
def _(fx):
    state, _ = _committed(fx)
    day = F.date_format("updated_at", "yyyy-MM-dd").alias("day")
    return state.assignments.select("source_id", "request_id", "scenario_id", "is_outlier", day)


@query(
    "M14_commit_vectors",
    TWO_SOURCES + "SELECT source_id, request_id, task_type, stable_id AS scenario_id, false AS is_outlier, 64 AS dim FROM tw",
    V,
)
def _(fx):
    state, vectors = _committed(fx)
    out = committing.labelled_vectors(vectors, state.assignments)
    return out.select(
        "source_id", "request_id", "task_type", "scenario_id", "is_outlier", F.size("embedding").alias("dim")
    )


@query(
    "M14_commit_state",
    TWO_SOURCES + """SELECT 'centroid' AS kind, stable_id AS name, count(*) AS n FROM tw GROUP BY stable_id
UNION ALL SELECT 'source', source_id || ' ' || CASE source_id WHEN 's0' THEN 'recomputed' ELSE 'failed' END, 1 FROM (VALUES ('s0'), ('s1')) s(source_id)
UNION ALL SELECT 'run', 'job completed', count(*) FROM tw""",
    V,
)
def _(fx):
    """Online centroids, source status and the run after the commit."""
    state, _ = _committed(fx)
    one = F.lit(1).cast("bigint").alias("n")
    cents = state.centroids.select(F.lit("centroid").alias("kind"), F.col("scenario_id").alias("name"), F.col("count").alias("n"))
    source = state.sources.select(F.lit("source").alias("kind"), F.concat_ws(" ", "source_id", "status").alias("name"), one)
    run = state.recompute_runs.select(
        F.lit("run").alias("kind"), F.concat_ws(" ", "job_id", "status").alias("name"), F.col("logs_at_completion").alias("n")
    )
    return cents.unionByName(source).unionByName(run)


@query(
    "M14_recompute_summaries",
    MAPPING + "SELECT DISTINCT stable_id AS scenario_id, CASE WHEN task_type = 'T0' THEN 'Сценарий T0 ' || regexp_extract(stable_id, '([0-9]+)$', 1) ELSE 'About a few of' END AS name, CASE WHEN task_type <> 'T0' THEN 'texts 10' END AS summary, CASE WHEN task_type <> 'T0' THEN 'low' END AS automation_potential FROM mp",
    V,
)
def _(fx):
    """Replies on ten representatives of each scenario; class T0 gets none."""
    def replies(shown):
        texts = F.concat(F.lit("texts "), F.count(F.lit(1)).cast("string"))
        return shown.where("scenario_id NOT LIKE 'T0:%'").groupBy("scenario_id").agg(texts.alias("summary")).select(
            "scenario_id", F.lit("About a few of these").alias("name"), "summary", F.lit("x").alias("user_goal"),
            F.array(F.lit("slow")).alias("pain_points"), F.lit("sure").alias("automation_potential"),
            F.array().cast("array<string>").alias("examples"),
        )

    a = fx.vectors.select("request_id", "task_type", "timestamp", F.col("request_id").alias("query_text"))
    out = scenarios.recompute(a, fx.vectors, _old_centroids(fx), datetime(2024, 3, 1), "job", summarise=replies)
    return out.clusters.select("scenario_id", "name", "summary", "automation_potential")
