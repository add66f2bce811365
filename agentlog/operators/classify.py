"""Task classification: keyword rules, centroids, a trained model, model replies."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import PCA, PCAModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window, functions as F

from agentlog.functions.numeric import parse_double
from agentlog.functions.taxonomy import CORE_TYPES, OTHER, UNKNOWN, literal_map, normalize_label
from agentlog.functions.text import let, strip
from agentlog.functions.vectors import mean_vector
from agentlog.operators.embedding import nearest
from agentlog.operators.joins import broadcast_checked
from agentlog.session import cut_lineage

# --- fixed values: keyword rules, first match wins --------------------------------
KEYWORD_RULES = (
    (("sql", "database", "excel", "отчет", "отчёт", "таблиц"), "data_analysis", 0.85),
    (("code", "function", "debug", "python", "код", "javascript"), "code_help", 0.85),
    (("письмо", "email", "почта", "найти", "search", "confluence", "crm"), "information_search", 0.8),
    (("задача", "jira", "план", "управлен", "встреч", "календар"), "task_management", 0.8),
    (("генерац", "написать письмо", "черновик", "пост для", "напиши текст"), "text_generation", 0.8),
    (("объясни", "обучен", "урок", "как работает", "что значит"), "education", 0.8),
)
KEYWORD_DEFAULT = (OTHER, 0.55)
# ---------------------------------------------------------------------------------

MAX_CLASSES = 1000


def classify_keywords(text: Column) -> Column:
    """Struct(task_type, confidence) by the first keyword group found (M6)."""

    def answer(name: str, score: float) -> Column:
        return F.struct(F.lit(name).alias("task_type"), F.lit(score).alias("confidence"))

    def rules(low: Column) -> Column:
        rule = answer(*KEYWORD_DEFAULT)
        for found, name, score in reversed(KEYWORD_RULES):
            hit = reduce(or_, [low.contains(word) for word in found])
            rule = F.when(hit, answer(name, score)).otherwise(rule)
        return rule

    return let(F.lower(F.coalesce(text, F.lit(""))), rules)


def apply_threshold(df: DataFrame, threshold: float = 0.30) -> DataFrame:
    """Foreign classes become `other`, unsure ones `unknown`."""
    known = F.when(F.col("task_type").isin(*CORE_TYPES, UNKNOWN), F.col("task_type")).otherwise(
        F.coalesce(normalize_label(F.col("task_type")), F.lit(OTHER))
    )
    return df.withColumn(
        "task_type", F.when(F.col("confidence") < threshold, F.lit(UNKNOWN)).otherwise(known)
    )


def class_centroids(df: DataFrame, label: str = "task_type", vec: str = "embedding") -> DataFrame:
    """Mean vector of every core class (M4)."""
    core = df.where(F.col(label).isin(*CORE_TYPES))
    return core.groupBy(F.col(label).alias("task_type")).agg(mean_vector(F.col(vec)).alias("centroid"))


def ema_centroids(old: DataFrame, new: DataFrame, alpha: float = 0.1) -> DataFrame:
    """Move class centroids toward the means of a batch; new or resized ones are taken over (M4)."""
    fresh = new.select("task_type", F.col("centroid").alias("__new"))
    blended = F.zip_with(
        "centroid", "__new", lambda o, n: o * F.lit(1.0 - alpha) + n * F.lit(alpha)
    )
    same = F.size("centroid") == F.size("__new")
    return old.join(fresh, "task_type", "full_outer").select(
        "task_type",
        F.when(F.col("__new").isNull(), F.col("centroid"))
        .when(F.col("centroid").isNotNull() & same, blended)
        .otherwise(F.col("__new"))
        .alias("centroid"),
    )


def classify_centroid(v: DataFrame, centroids: DataFrame, threshold: float = 0.30) -> DataFrame:
    """Class of the most similar class centroid (M5).

    Confidence is the cosine, 0.4 when negative; without any centroid the answer is
    other at 0.35.
    """
    near = nearest(v, centroids, on=None, ref_id="task_type", ref_vec="centroid")
    sim = F.col("best_sim")
    out = (
        near.withColumn("task_type", F.coalesce("best_ref", F.lit(OTHER)))
        .withColumn(
            "confidence",
            F.when(sim.isNull(), F.lit(0.35)).when(sim >= 0, sim).otherwise(F.lit(0.4)),
        )
        .drop("best_ref", "best_sim")
    )
    return apply_threshold(out, threshold)


def parse_reply(reply: Column) -> Column:
    """Struct(task_type, confidence) of a model's answer.

    A JSON object is read; other text is searched for a class name; else other at 0.4.
    """
    text = strip(reply)
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)\s*```", 1)
    body = F.when(fenced != "", strip(fenced)).otherwise(text)
    is_json = F.try_parse_json(body).isNotNull()
    is_object = is_json & body.startswith("{")

    given = F.get_json_object(body, "$.confidence")
    score = F.coalesce(F.when(is_object, parse_double(given)), F.lit(0.55))
    low = F.lower(reply)
    mentioned = F.coalesce(*[F.when(low.contains(t), F.lit(t)) for t in CORE_TYPES])
    found = F.when(is_object, normalize_label(F.get_json_object(body, "$.task_type"))).when(
        ~F.coalesce(is_json, F.lit(False)), F.coalesce(normalize_label(reply), mentioned)
    )
    bounded = F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))
    return F.struct(
        F.coalesce(found, F.lit(OTHER)).alias("task_type"),
        F.when(found.isNull(), F.lit(0.4)).otherwise(bounded).alias("confidence"),
    )


# --- training ---------------------------------------------------------------------


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Count and balanced weight n / (classes · count) per class."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("count"))
    whole = counts.agg(F.struct(F.sum("count").alias("n"), F.count(F.lit(1)).alias("k"))).scalar()
    return (
        counts.withColumn("__w", whole)
        .withColumn("weight", F.col("__w.n").cast("double") / (F.col("__w.k") * F.col("count")).cast("double"))
        .drop("__w")
    )


def split_hash(key: Column, seed: int) -> Column:
    """60 bits of the key's MD5, the same in any engine."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string"))), 1, 15)
    return F.coalesce(F.conv(digits, 16, 10).cast("long"), F.lit(0))


def hash_cuts(
    df: DataFrame, label: str, key: str, seed: int, shares: Sequence[float]
) -> DataFrame:
    """Per class (`__label`) the array `__cuts`: for each share the place (hash, key) of the last
    row among that share of the class with the smallest places; null where the share has no row.

    No sort: three passes of counts narrow each cut down to 1/2^12, then 1/2^24 of the hashes,
    then to single keys. They read label and key only, and counts of at most 4,096 ranges a
    class and cut meet in a window.
    """
    rows = df.select(
        F.col(label).alias("__label"), split_hash(F.col(key), seed).alias("__h"),
        F.col(key).cast("string").alias("__key"),
    )
    coarse = cut_lineage(
        rows.groupBy("__label", F.shiftright("__h", 48).alias("__range")).agg(F.count(F.lit(1)).alias("__n"))
    )
    sizes = coarse.groupBy("__label").agg(F.sum("__n").alias("__rows"))
    numbered = F.posexplode(F.array(*[F.lit(float(x)) for x in shares])).alias("__cut", "__share")
    wanted = sizes.select("__label", "__rows", numbered).select(
        "__label", "__cut", F.floor(F.col("__rows") * F.col("__share") + 0.5).alias("__take")
    )
    first = _reached(_per_cut(coarse, wanted), ["__range"])
    fine = _per_cut(rows, first, F.shiftright("__h", 48) == F.col("__range")).groupBy(
        "__label", "__cut", "__take", F.shiftright("__h", 36).alias("__range")
    ).agg(F.count(F.lit(1)).alias("__n"))
    second = _reached(fine, ["__range"])
    single = _per_cut(rows, second, F.shiftright("__h", 36) == F.col("__range")).groupBy(
        "__label", "__cut", "__take", "__h", "__key"
    ).agg(F.count(F.lit(1)).alias("__n"))
    last = _reached(single, ["__h", "__key"]).select(
        "__label", "__cut", F.struct("__h", "__key").alias("__place")
    )
    placed = wanted.drop("__take").alias("w").join(
        last.alias("l"),
        F.col("w.__label").eqNullSafe(F.col("l.__label")) & (F.col("w.__cut") == F.col("l.__cut")), "left",
    )
    listed = F.array_sort(F.collect_list(F.struct(F.col("w.__cut"), F.col("l.__place"))))
    return placed.groupBy(F.col("w.__label").alias("__label")).agg(
        F.transform(listed, lambda x: x["__place"]).alias("__cuts")
    )


def _per_cut(rows: DataFrame, cuts: DataFrame, also: Column | None = None) -> DataFrame:
    """`rows` beside the cuts of their class; cuts are as few as classes and shares."""
    named = broadcast_checked(cuts.withColumnRenamed("__label", "__of"))
    same = F.col("__label").eqNullSafe(F.col("__of"))
    return rows.join(named, same if also is None else same & also).drop("__of")


def _reached(counts: DataFrame, order: Sequence[str]) -> DataFrame:
    """The first range of each class and cut in which the running count reaches `__take`, which
    becomes what is left to take inside it."""
    upto = Window.partitionBy("__label", "__cut").orderBy(*order)
    before = F.sum("__n").over(upto.rowsBetween(Window.unboundedPreceding, -1))
    return cut_lineage(
        counts.withColumn("__before", F.coalesce(before, F.lit(0)))
        .where((F.col("__before") < F.col("__take")) & (F.col("__before") + F.col("__n") >= F.col("__take")))
        .select("__label", "__cut", *order, (F.col("__take") - F.col("__before")).alias("__take"))
    )


def _with_cuts(df: DataFrame, label: str, key: str, seed: int, shares: Sequence[float]) -> DataFrame:
    cuts = broadcast_checked(cut_lineage(hash_cuts(df, label, key, seed, shares)))
    place = F.struct(split_hash(F.col(key), seed).alias("__h"), F.col(key).cast("string").alias("__key"))
    return df.join(cuts, F.col(label).eqNullSafe(F.col("__label"))).drop("__label").withColumn("__place", place)


def stratified_split(
    df: DataFrame, label: str = "label", share: float = 0.2, seed: int = 42, key: str = "request_id"
) -> DataFrame:
    """Adds `is_test`: an exact share of every class, chosen by hash order.

    Rows that repeat a key stay on one side, so a share is exact where keys are unique. Null
    labels are a class, null keys come as one key. The table is not sorted or shuffled.
    """
    cut = F.get("__cuts", F.lit(0))
    test = F.coalesce(F.col("__place") <= cut, F.lit(False))
    return _with_cuts(df, label, key, seed, [share]).withColumn("is_test", test).drop("__cuts", "__place")


def stratified_folds(
    df: DataFrame, label: str = "label", k: int = 5, seed: int = 42, key: str = "request_id"
) -> DataFrame:
    """Adds `fold` 0..k-1 with class shares equal to within one row.

    Repeated keys, null labels and null keys as in `stratified_split`.
    """
    if k == 1:
        return df.withColumn("fold", F.lit(0).cast("bigint"))
    passed = F.filter("__cuts", lambda c: c.isNull() | (c < F.col("__place")))
    cut = _with_cuts(df, label, key, seed, [i / k for i in range(1, k)])
    return cut.withColumn("fold", F.size(passed).cast("bigint")).drop("__cuts", "__place")


@dataclass(frozen=True)
class TaskClassifier:
    """Trained model and what is known about it."""

    classes: tuple[str, ...]
    model: LogisticRegressionModel
    pca: PCAModel | None
    raw_dim: int
    holdout_accuracy: float | None
    n_samples: int

    @property
    def meta(self) -> dict[str, object]:
        return {
            "input": "embedding",
            "embedding_dim": self.raw_dim,
            "feature_dim": self.model.numFeatures,
            "pca_dim": self.pca.getK() if self.pca else None,
            "classes": list(self.classes),
            "holdout_accuracy": self.holdout_accuracy,
            "n_samples": self.n_samples,
        }


def apply_pca(df: DataFrame, pca: PCAModel | None, vec: str = "embedding", out: str = "features") -> DataFrame:
    """Project vectors; vectors of another length than the model's pass unprojected (M3)."""
    dense = df.withColumn(out, array_to_vector(F.col(vec).cast("array<double>")))
    if pca is None:
        return dense
    rows = pca.pc.numRows
    fits = F.size(vec) == rows
    zero = F.array_repeat(F.lit(0.0), rows)
    safe = dense.withColumn(
        "__in", array_to_vector(F.when(fits, F.col(vec).cast("array<double>")).otherwise(zero))
    )
    projected = pca.setInputCol("__in").setOutputCol("__out").transform(safe)
    return projected.withColumn(out, F.when(fits, F.col("__out")).otherwise(F.col(out))).drop("__in", "__out")


def train_classifier(
    df: DataFrame, label: str = "label", pca_dim: int = 256, test_share: float = 0.2, seed: int = 42,
    key: str = "request_id", max_iter: int = 60,
) -> TaskClassifier:
    """Balanced multinomial model on (projected) embeddings, judged on a stratified holdout (M1).

    The projection is fitted on the training part only. The class list is read by the
    driver; it is the label set, not data.
    """
    found = class_weights(df, label).orderBy(label).limit(MAX_CLASSES + 1).collect()
    if len(found) > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} classes: not a label column")
    classes = tuple(r[label] for r in found)
    order = literal_map({c: float(i) for i, c in enumerate(classes)})
    weight = literal_map({r[label]: r["weight"] for r in found})
    rows = (
        stratified_split(df, label, test_share, seed, key)
        .withColumn("y", F.try_element_at(order, F.col(label)))
        .withColumn("weight", F.try_element_at(weight, F.col(label)))
    )
    raw_dim = int(df.select(F.size("embedding")).first()[0])
    train, test = rows.where(~F.col("is_test")), rows.where("is_test")
    pca = None
    if 0 < pca_dim < raw_dim:
        dense = train.withColumn("__in", array_to_vector(F.col("embedding").cast("array<double>")))
        pca = PCA(k=pca_dim, inputCol="__in", outputCol="__out").fit(dense)
    lr = LogisticRegression(
        featuresCol="features", labelCol="y", weightCol="weight", family="multinomial",
        maxIter=max_iter, regParam=1e-4,
    )
    model = lr.fit(apply_pca(train, pca))
    scored = model.transform(apply_pca(test, pca))
    accuracy = scored.agg(F.avg((F.col("prediction") == F.col("y")).cast("double"))).first()[0]
    return TaskClassifier(classes, model, pca, raw_dim, accuracy, df.count())


def classify(df: DataFrame, classifier: TaskClassifier, threshold: float = 0.30) -> DataFrame:
    """Most probable class and its probability; unsure rows become unknown (M2)."""
    scored = classifier.model.transform(apply_pca(df, classifier.pca))
    names = F.array(*[F.lit(c) for c in classifier.classes])
    out = (
        scored.withColumn("task_type", F.get(names, F.col("prediction").cast("int")))
        .withColumn("confidence", F.array_max(vector_to_array("probability")))
        .drop("features", "rawPrediction", "probability", "prediction")
    )
    return apply_threshold(out, threshold)
