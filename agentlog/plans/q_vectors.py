"""Vectors: similarity, search, centroids, classification and training."""

from __future__ import annotations

from pyspark.sql import functions as F

from agentlog.functions import vectors as vx
from agentlog.operators import classify, embedding, joins, scenarios
from agentlog.operators.roi import round_to
from agentlog.plans.q_roi import r
from agentlog.plans.registry import query

V = ("fx_vectors",)
DIM = 64
# Mean vector of each prototype group, as a long table and as lists.
CENT = """, el AS (SELECT proto, task_type, unnest(embedding) AS x, unnest(range(1, 65)) AS i FROM fx_vectors),
 mean AS (SELECT proto, task_type, i, avg(x) AS x, count(*) AS n FROM el GROUP BY ALL),
 cent AS (SELECT proto, task_type, task_type || ':cluster_' || proto AS scenario_id, any_value(n) AS n, list(x ORDER BY i) AS centroid FROM mean GROUP BY proto, task_type)
"""


def _centroids(fx):
    return scenarios.centroids(_labelled(fx))


def _labelled(fx):
    sid = F.concat("task_type", F.lit(":cluster_"), F.col("proto").cast("string"))
    return fx.vectors.withColumn("scenario_id", sid)


def _long(df, key, vec, digits=6):
    out = df.select(key, F.posexplode(vec).alias("i", "x"))
    return out.select(key, (F.col("i") + 1).cast("bigint").alias("i"), round_to(F.col("x"), digits).alias("x"))


@query(
    "M9_centroids",
    CENT + f"SELECT task_type || ':cluster_' || proto AS scenario_id, i, {r('x', 6)} AS x FROM mean",
    V,
)
def _(fx):
    return _long(_centroids(fx), "scenario_id", "centroid")


@query(
    "X9_cosine",
    f"SELECT a.request_id, {r('list_cosine_similarity(a.embedding, b.embedding)', 6)} AS sim FROM fx_vectors a JOIN fx_vectors b ON b.vec_id = (a.vec_id + 12) % (SELECT max(vec_id) + 1 FROM fx_vectors)",
    V,
)
def _(fx):
    a = fx.vectors.select("request_id", "vec_id", "embedding")
    n = fx.vectors.agg(F.max("vec_id") + 1).scalar()
    b = fx.vectors.select(F.pmod(F.col("vec_id") - 12, n).alias("vec_id"), F.col("embedding").alias("other"))
    return a.join(b, "vec_id").select("request_id", round_to(vx.cosine(F.col("embedding"), F.col("other")), 6).alias("sim"))


@query(
    "X8_mean_pool",
    """, el AS (SELECT proto, unnest(embedding) AS x, unnest(range(1, 65)) AS i FROM fx_vectors), m AS (SELECT proto, i, avg(x) AS x FROM el GROUP BY ALL),
 z AS (SELECT proto, sqrt(sum(x * x)) AS s FROM m GROUP BY proto) """ + f"SELECT proto, i, {r('x / s', 6)} AS x FROM m JOIN z USING (proto)",
    V,
)
def _(fx):
    return _long(vx.mean_pool(fx.vectors, ["proto"]), "proto", "embedding")


def _byte(i: int) -> str:
    return f"(2 * ('0x' || h[{2 * i + 1}:{2 * i + 2}])::INT - 255)"


@query(
    "X10_hash_embedding",
    f"""WITH d AS (SELECT doc_id, sha256(lower(regexp_replace(text, '^[\\s\\x{{00A0}}]+|[\\s\\x{{00A0}}]+$', '', 'g'))) AS h FROM documents)
SELECT doc_id, 64 AS dim, 1.0::DOUBLE AS norm, sign({_byte(0)})::INT AS first_sign, abs({_byte(1)}) > abs({_byte(2)}) AS larger FROM d""",
)
def _(fx):
    docs = fx.table("documents").select("doc_id", "text")
    out = embedding.embed(docs, vx.hash_embedder(64), "text")
    at = lambda i: F.get("embedding", F.lit(i))
    return out.select(
        "doc_id",
        F.size("embedding").alias("dim"),
        round_to(vx.norm(F.col("embedding")), 4).alias("norm"),
        F.signum(at(0)).cast("int").alias("first_sign"),
        (F.abs(at(1)) > F.abs(at(2))).alias("larger"),
    )


@query(
    "E1_embed_distinct",
    "SELECT request_id, 32 AS dim FROM fx_records",
    ("fx_records",),
)
def _(fx):
    out = embedding.embed_distinct(fx.records.select("request_id", "query_text"), vx.hash_embedder(32))
    return out.select("request_id", F.size("embedding").alias("dim"))


@query(
    "J6_recompute_input",
    "SELECT v.request_id, v.vec_id % 5 <> 0 AS has_vector, CASE WHEN v.vec_id % 5 <> 0 THEN " + r("list_sum(v.embedding)", 4) + " ELSE 0.0 END AS total FROM fx_vectors v",
    V,
)
def _(fx):
    a = fx.vectors.select("request_id", "task_type", "timestamp")
    out = joins.recompute_input(a, fx.vectors.where("vec_id % 5 <> 0"), DIM)
    total = F.aggregate("embedding", F.lit(0.0), lambda acc, x: acc + x)
    return out.select("request_id", "has_vector", round_to(total, 4).alias("total"))


NEAR = CENT + """, sims AS (SELECT v.request_id, c.scenario_id, list_cosine_similarity(v.embedding, c.centroid) AS sim FROM fx_vectors v JOIN cent c USING (task_type)),
 near AS (SELECT request_id, scenario_id AS best_ref, sim FROM sims QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY sim DESC, scenario_id) = 1)
"""


@query("J8_nearest_centroid", NEAR + f"SELECT request_id, best_ref, {r('sim', 6)} AS best_sim FROM near", V)
def _(fx):
    near = embedding.nearest(fx.vectors, _centroids(fx))
    return near.select("request_id", "best_ref", round_to(F.col("best_sim"), 6).alias("best_sim"))


@query("J8_nearest_centroid_block_join", NEAR + f"SELECT request_id, best_ref, {r('sim', 6)} AS best_sim FROM near", V)
def _(fx):
    near = embedding.nearest(fx.vectors, _centroids(fx), budget=2048)
    return near.select("request_id", "best_ref", round_to(F.col("best_sim"), 6).alias("best_sim"))


SEARCH = """, q AS (SELECT 'q' || vec_id AS query_id, embedding FROM fx_vectors WHERE vec_id % 50 = 7),
 s AS (SELECT q.query_id, v.request_id, list_cosine_similarity(v.embedding, q.embedding) AS score FROM fx_vectors v, q)
"""


def _queries(fx):
    return fx.vectors.where("vec_id % 50 = 7").select(
        F.concat(F.lit("q"), F.col("vec_id").cast("string")).alias("query_id"), "embedding"
    )


@query(
    "J9_vector_search",
    SEARCH + f", k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, request_id) AS rank FROM s WHERE score >= 0.5 QUALIFY rank <= 10) SELECT query_id, request_id, rank, {r('score', 6)} AS score FROM k",
    V,
)
def _(fx):
    out = embedding.vector_search(fx.vectors, _queries(fx), 10, 0.5)
    return out.withColumn("score", round_to(F.col("score"), 6))


@query(
    "J10_pairs_above",
    CENT + f"SELECT v.request_id, c.scenario_id AS ref, {r('list_cosine_similarity(v.embedding, c.centroid)', 6)} AS sim FROM fx_vectors v JOIN cent c USING (task_type) WHERE list_cosine_similarity(v.embedding, c.centroid) >= 0.75",
    V,
)
def _(fx):
    out = embedding.pairs_above(fx.vectors, _centroids(fx), 0.75, vec="embedding")
    return out.select("request_id", "ref", round_to(F.col("sim"), 6).alias("sim"))


# Class centroids: prototypes stand for classes.
_CLASSES = ["text_generation", "code_help", "data_analysis", "education", "information_search", "task_management", "other"]
_CASE = "CASE proto % 7 " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(_CLASSES)) + " END"


def _classed(fx):
    names = F.array(*[F.lit(c) for c in _CLASSES])
    return fx.vectors.withColumn("label", F.get(names, (F.col("proto") % 7).cast("int")))


CLASS = f""", cl AS (SELECT {_CASE} AS label, unnest(embedding) AS x, unnest(range(1, 65)) AS i FROM fx_vectors), cm AS (SELECT label, i, avg(x) AS x FROM cl GROUP BY ALL)
"""


@query("M4_class_centroids", CLASS + f"SELECT label AS task_type, i, {r('x', 6)} AS x FROM cm", V)
def _(fx):
    return _long(classify.class_centroids(_classed(fx), "label"), "task_type", "centroid")


@query(
    "M4_ema_centroids",
    CLASS + f""", c2 AS (SELECT {_CASE} AS label, unnest(embedding) AS x, unnest(range(1, 65)) AS i FROM fx_vectors WHERE vec_id % 2 = 0), n2 AS (SELECT label, i, avg(x) AS x FROM c2 GROUP BY ALL)
SELECT label AS task_type, i, {r('coalesce(0.9::DOUBLE * cm.x + 0.1::DOUBLE * n2.x, cm.x)', 6)} AS x FROM cm LEFT JOIN n2 USING (label, i)""",
    V,
)
def _(fx):
    rows = _classed(fx)
    old = classify.class_centroids(rows, "label")
    new = classify.class_centroids(rows.where("vec_id % 2 = 0"), "label")
    return _long(classify.ema_centroids(old, new), "task_type", "centroid")


@query(
    "M5_classify_centroid",
    CLASS + f""", ce AS (SELECT label, list(x ORDER BY i) AS centroid FROM cm GROUP BY label),
 s AS (SELECT request_id, label, list_cosine_similarity(embedding, centroid) AS sim FROM fx_vectors, ce QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY sim DESC, label) = 1)
SELECT request_id, CASE WHEN sim < 0.3 THEN 'unknown' ELSE label END AS task_type, {r('sim', 6)} AS confidence FROM s""",
    V,
)
def _(fx):
    out = classify.classify_centroid(fx.vectors, classify.class_centroids(_classed(fx), "label"))
    return out.select("request_id", "task_type", round_to(F.col("confidence"), 6).alias("confidence"))


_RULES = " ".join(
    f"WHEN regexp_matches(t, '{'|'.join(words)}') THEN '{name}'" for words, name, _ in classify.KEYWORD_RULES
)
_SCORES = " ".join(
    f"WHEN regexp_matches(t, '{'|'.join(words)}') THEN {score}" for words, _, score in classify.KEYWORD_RULES
)


@query(
    "M6_classify_keywords",
    f"SELECT doc_id, CASE {_RULES} ELSE 'other' END AS task_type, (CASE {_SCORES} ELSE 0.55 END)::DOUBLE AS confidence FROM (SELECT doc_id, lower(text) AS t FROM documents)",
)
def _(fx):
    rule = classify.classify_keywords(F.col("text")).alias("r")
    return fx.table("documents").select("doc_id", rule).select("doc_id", "r.*")


@query(
    "M17_class_weights",
    """, c AS (SELECT gold_category AS label, count(*) AS count FROM fx_records WHERE gold_category IS NOT NULL GROUP BY 1)
SELECT label, count, (SELECT sum(count) FROM c)::DOUBLE / ((SELECT count(*) FROM c) * count)::DOUBLE AS weight FROM c""",
    ("fx_records",),
)
def _(fx):
    rows = fx.records.where("gold_category IS NOT NULL").select(F.col("gold_category").alias("label"))
    return classify.class_weights(rows)


def _gold(fx):
    return fx.records.where("gold_category IS NOT NULL").select("request_id", F.col("gold_category").alias("label"))


PLACED = """, r AS (SELECT request_id, gold_category AS label, ('0x' || md5('42:' || request_id)[1:15])::BIGINT AS h
 FROM fx_records WHERE gold_category IS NOT NULL),
 p AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY h, request_id) AS place, count(*) OVER (PARTITION BY label) AS n FROM r)
"""


@query(
    "M18_stratified_split",
    PLACED + "SELECT request_id, label, place <= floor(n * 0.2::DOUBLE + 0.5::DOUBLE) AS is_test FROM p",
    ("fx_records",),
)
def _(fx):
    return classify.stratified_split(_gold(fx)).select("request_id", "label", "is_test")


@query(
    "M18_stratified_folds",
    PLACED + """SELECT request_id, label, (SELECT count(*) FROM (SELECT unnest([0.2::DOUBLE, 0.4::DOUBLE, 0.6::DOUBLE, 0.8::DOUBLE]) AS x)
 WHERE place > floor(n * x + 0.5::DOUBLE)) AS fold FROM p""",
    ("fx_records",),
)
def _(fx):
    return classify.stratified_folds(_gold(fx)).select("request_id", "label", "fold")


def _trained(fx):
    return classify.train_classifier(_classed(fx), pca_dim=16)


@query("M1_train_classifier")
def _(fx):
    model = _trained(fx)
    meta = [(k, str(v)) for k, v in model.meta.items()]
    return fx.spark.createDataFrame(meta, "name string, value string")


@query("M2_classify")
def _(fx):
    out = classify.classify(_classed(fx), _trained(fx))
    return out.groupBy("label", "task_type").agg(
        F.count(F.lit(1)).alias("n"), round_to(F.min("confidence"), 2).alias("least_confidence")
    )


@query("M3_apply_pca")
def _(fx):
    from pyspark.ml.functions import vector_to_array

    model = _trained(fx)
    out = classify.apply_pca(_classed(fx), model.pca)
    return out.select("request_id", F.size(vector_to_array("features")).alias("dim"))


# --- representatives --------------------------------------------------------------

UNIQ = NEAR + """, un AS (SELECT v.task_type || ':cluster_' || v.proto AS scenario_id, 'text ' || (vec_id % 40) AS query_text, request_id, vec_id, embedding FROM fx_vectors v),
 u1 AS (SELECT * FROM un QUALIFY row_number() OVER (PARTITION BY scenario_id, query_text ORDER BY vec_id) = 1),
 u2 AS (SELECT u1.*, list_cosine_similarity(u1.embedding, c.centroid) AS sim FROM u1 JOIN cent c USING (scenario_id)),
 u3 AS (SELECT *, row_number() OVER (PARTITION BY scenario_id ORDER BY sim DESC, vec_id) AS hi, row_number() OVER (PARTITION BY scenario_id ORDER BY sim, vec_id DESC) AS lo, count(*) OVER (PARTITION BY scenario_id) AS u FROM u2)
"""


@query(
    "M12_representatives",
    UNIQ + "SELECT scenario_id, query_text, request_id, hi AS position FROM u3 WHERE hi <= CASE WHEN u <= 6 THEN 6 ELSE 4 END UNION ALL SELECT scenario_id, query_text, request_id, lo + 4 FROM u3 WHERE u > 6 AND lo <= 2",
    V,
)
def _(fx):
    return scenarios.representatives(_labelled(fx), _centroids(fx), 6, 2)


@query(
    "M12_representatives_even",
    UNIQ + """, e AS (SELECT *, row_number() OVER (PARTITION BY scenario_id ORDER BY vec_id) - 1 AS idx, greatest(1, u // 6) AS step FROM u3),
 f AS (SELECT * FROM e WHERE u <= 6 OR (idx % step = 0 AND idx < step * 6)) SELECT scenario_id, query_text, request_id, row_number() OVER (PARTITION BY scenario_id ORDER BY idx) AS position FROM f""",
    V,
)
def _(fx):
    return scenarios.representatives(_labelled(fx), None, 6)


@query(
    "W6_near_far",
    UNIQ + "SELECT scenario_id, request_id, hi AS position FROM u3 WHERE hi <= CASE WHEN u <= 4 THEN 4 ELSE 3 END UNION ALL SELECT scenario_id, request_id, lo + 3 FROM u3 WHERE u > 4 AND lo <= 1",
    V,
)
def _(fx):
    own = scenarios._unique_texts(_labelled(fx), _centroids(fx))
    out = scenarios.near_far(own, "scenario_id", "best_sim", 3, 1, ["timestamp", "request_id"])
    return out.select("scenario_id", "request_id", F.col("position").cast("bigint").alias("position"))


@query(
    "M13_representatives_search",
    CENT + """, s AS (SELECT c.scenario_id, v.task_type || ':cluster_' || v.proto AS own, 'text ' || (v.vec_id % 40) AS query_text, v.request_id,
  row_number() OVER (PARTITION BY c.scenario_id ORDER BY list_cosine_similarity(v.embedding, c.centroid) DESC, v.request_id) AS position FROM fx_vectors v, cent c QUALIFY position <= 10)
SELECT scenario_id, query_text, request_id, position FROM s WHERE own = scenario_id QUALIFY row_number() OVER (PARTITION BY scenario_id, query_text ORDER BY position, request_id) = 1""",
    V,
)
def _(fx):
    return scenarios.representatives_search(_labelled(fx), _centroids(fx))


@query(
    "S14_upsert_vectors",
    "SELECT request_id, CASE WHEN vec_id % 4 = 0 THEN 'moved' ELSE task_type END AS task_type FROM fx_vectors UNION ALL SELECT 'new_' || vec_id, 'moved' FROM fx_vectors WHERE vec_id % 100 = 1",
    V,
)
def _(fx):
    from agentlog.operators.tables import upsert_vectors

    base = fx.vectors.select("request_id", "task_type", "embedding", "vec_id")
    moved = base.where("vec_id % 4 = 0").withColumn("task_type", F.lit("moved"))
    added = base.where("vec_id % 100 = 1").withColumn("task_type", F.lit("moved")).withColumn(
        "request_id", F.concat(F.lit("new_"), F.col("vec_id").cast("string"))
    )
    blank = base.where("vec_id = 3").withColumn("request_id", F.lit(""))
    new = moved.unionByName(added).unionByName(blank)
    return upsert_vectors(base, new, ["vec_id"]).select("request_id", "task_type")
