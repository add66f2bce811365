"""Mix sources to target weights by cutting a hash-ordered stream at each source's budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from agentlog.llm.common import running_totals, store

MAX_REPEATS = 3
WEIGHTS = (5, 2, 1)
BITS = 60


def hash_key(seed: int, *parts: Column) -> Column:
    """A uniform number below 2^60 from the content of a row; nulls differ from texts."""
    marked = [F.coalesce(F.concat(F.lit("="), p.cast("string")), F.lit("-")) for p in parts]
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *marked))
    return F.conv(F.substring(digest, 1, BITS // 4), 16, 10).cast("long")


def source_targets(
    rows: DataFrame, source: str, size: str, weights: tuple[int, ...] = WEIGHTS,
    share: float = 1.0, max_repeats: int = MAX_REPEATS,
) -> DataFrame:
    """Per source: its size and target.

    Sources in order of code points, null last, weigh `weights` in turn and share
    `share` of all sizes; a target stops at `max_repeats` times its source's size and the
    excess goes to the others by weight until none is above. In order of cap per weight,
    every source before the first that stays below its cap is capped. Both running totals
    are distributed, so there may be any number of sources.
    """
    per = rows.groupBy(F.col(source).alias("__source")).agg(
        F.sum(size).cast("long").alias("source_size")
    )
    ranked = running_totals(
        per.withColumn("__null", F.col("__source").isNull()).withColumn("__one", F.lit(1)),
        ["__null", "__source"], {"__rank": "__one"},
    )
    turn = F.col("__rank") % len(weights)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), turn.cast("int") + 1)
    weighed = ranked.select(
        "__source", "source_size", "__rank", weight.cast("long").alias("__weight"),
        (F.col("source_size") * max_repeats).alias("__cap"),
    ).withColumn("__ratio", F.col("__cap") / F.col("__weight"))
    level = running_totals(
        weighed, ["__ratio", "__rank"], {"__caps_before": "__cap", "__weight_before": "__weight"}
    )
    total, weight = level.agg(F.sum("source_size"), F.sum("__weight")).head()  # two numbers
    rest = (F.lit((total or 0) * share) - F.col("__caps_before")) / (
        F.lit(weight or 0) - F.col("__weight_before")
    )
    below = level.withColumn("__rest", rest).filter("__ratio >= __rest")
    first = below.agg(F.min_by("__rest", F.struct("__ratio", "__rank"))).head()[0]  # one number
    cap = F.col("__cap").cast("double")
    target = cap if first is None else F.least(cap, F.col("__weight") * F.lit(float(first)))
    return level.select("__source", "source_size", target.alias("target"))


def mix(
    rows: DataFrame, source: str, size: str, key: str, weights: tuple[int, ...] = WEIGHTS,
    share: float = 1.0, max_repeats: int = MAX_REPEATS, whole: bool = False,
) -> DataFrame:
    """All of `rows` with source_size, target, repeats and taken.

    `rows` is read several times: pass a stored table. `key` is a hash of the row's content;
    inside a source rows are ordered by it. Every row is taken as often as whole rounds
    through the source fit its target; the last round is cut at the exact budget, inside
    the row that crosses it. With `whole`, that row is taken when at least half of it fits.
    `repeats` counts whole takes, `taken` the size taken.

    Rows of one source with equal keys are one place in the order (they are repeated rows,
    or a collision of hashes); they are summed before the sort, so copies never gather in
    one task, and share their place in a second order when the cut falls among them. Null
    sources are a source; null sizes count as 0. An empty table gives an empty result.
    Columns named like the new ones are replaced.
    """
    rows = rows.drop("source_size", "target", "repeats", "taken").withColumn(
        size, F.coalesce(F.col(size), F.lit(0)).cast("long")
    )
    targets = store(source_targets(rows, source, size, weights, share, max_repeats), "targets")
    places = rows.groupBy(F.col(source).alias("__source"), F.col(key).alias("__key")).agg(
        F.sum(size).alias("__size")
    )
    ordered = running_totals(places, ["__key"], {"__before": "__size"}, group=["__source"])

    budget = F.floor(F.col("target") + 1e-6)
    rounds = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    plan = targets.withColumn("__rounds", rounds.cast("long")).withColumn(
        "__left", (budget - F.col("__rounds") * F.col("source_size")).cast("long")
    )
    right = plan.select(F.col("__source").alias("__of"), "__left")
    cuts = (
        ordered.join(right, F.col("__source").eqNullSafe(F.col("__of")))
        .filter("__before <= __left and __left < __before + __size")
        .select("__of", F.col("__key").alias("__cut"), (F.col("__left") - F.col("__before")).alias("__rest"))
    )
    plan = store(
        plan.join(cuts, F.col("__source").eqNullSafe(F.col("__of")), "left").drop("__of", "__left"),
        "cuts",
    )
    joined = rows.join(plan, F.col(source).eqNullSafe(F.col("__source"))).drop("__source")
    at_cut = F.coalesce(F.col(key) == F.col("__cut"), F.lit(False))
    once_more = F.coalesce(F.col(key) < F.col("__cut"), F.lit(False)).cast("long")
    clear = joined.filter(~at_cut).withColumn("repeats", F.col("__rounds") + once_more).withColumn(
        "taken", F.col("repeats") * F.col(size)
    )
    # rows at the cut: one per source, or repeated rows
    tied = store(
        joined.filter(at_cut).withColumn("__no", F.monotonically_increasing_id()), "at-cut"
    )
    first = running_totals(
        tied.select(F.col(source).alias("__source"), size, "__no"), ["__no"], {"__ahead": size},
        group=["__source"],
    ).select("__no", "__ahead")
    room = F.greatest(F.lit(0), F.least(F.col(size), F.col("__rest") - F.col("__ahead")))
    cut = tied.join(first, "__no").withColumn("__room", room.cast("long"))
    if whole:
        cut = cut.withColumn("__room", F.when(F.col("__room") * 2 >= F.col(size), F.col(size)).otherwise(0))
    full = ((F.col("__room") == F.col(size)) & (F.col(size) > 0)).cast("long")
    cut = cut.withColumn("repeats", F.col("__rounds") + full).withColumn(
        "taken", F.col("__rounds") * F.col(size) + F.col("__room")
    )
    keep = [*rows.columns, "source_size", "target", "repeats", "taken"]
    return clear.select(keep).unionByName(cut.select(keep))
