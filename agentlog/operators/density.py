"""Density clusters of directions per class, at a density that fits the class.

1. Rows are hashed into direction cells of several tables (signs of random projections, as
   many bits as the class needs). A cell is dealt into blocks of bounded rows, so a cell of
   any size is spread; inside a block every row is compared with every other and keeps its
   best neighbours. Only ids and similarities leave a block.
2. A row's core similarity is that of its `min_samples`-th neighbour. The radius of a class
   is a low quantile of it, as an angle; levels of density are fixed multiples of the radius.
3. A link holds at a level if it and both its rows' core similarities reach it. Connected
   components of all levels are found in the same rounds. Over the levels they form a
   forest: a component falls apart or thins out as the level gets denser.
4. Components whose rows do not point one way (their signs tell) are shapeless and never a cluster. Of the
   others those are chosen that last longest, weighted by their rows: a component against
   the components it falls into, from the densest level up.

The vectors are read twice, whatever the data: for the signs and for the neighbours.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from agentlog.config import ScenarioConfig
from agentlog.functions.vectors import stack, unit_rows
from agentlog.operators.graph import components
from agentlog.session import cut_lineage

SIGN_BITS = 24
#: Tables whose planes measure the shape of a component.
SHAPE_TABLES = 2
#: Levels of density, as multiples of the class's radius, loosest first.
LEVELS = (1.6, 1.45, 1.3, 1.15, 1.0, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3)
#: The scale ends here: components of the loosest level live from twice the radius on.
LOOSEST = 2.0
#: Radius of classes of equal rows.
LEAST_RADIUS = math.radians(5)
#: Levels a cluster must last.
LASTS = 2


# --- neighbours -------------------------------------------------------------------


def row_node(df: DataFrame, keys: list[str]) -> Column:
    """Number of a row out of its keys, alike in every pass over the table: a hash with the
    first seed under which different keys of this table differ."""
    seed = 0
    while True:
        node = F.xxhash64(F.lit(seed), *keys)
        if df.agg(F.count_distinct(node) >= F.count_distinct(F.struct(*keys))).first()[0]:
            return node
        seed += 1


def _signs(dim: int, cfg: ScenarioConfig):
    """UDF: the signs of SIGN_BITS projections for each table, packed."""
    planes = np.random.default_rng(cfg.seed).standard_normal((dim, cfg.hash_tables * SIGN_BITS))
    powers = (1 << np.arange(SIGN_BITS, dtype=np.int64))[::-1]

    @F.pandas_udf("array<long>")
    def sign(vectors: pd.Series) -> pd.Series:
        on = stack(vectors, dim) @ planes > 0
        return pd.Series(list(on.reshape(len(vectors), cfg.hash_tables, SIGN_BITS) @ powers))

    return sign


def signed_rows(rows: DataFrame, dim: int, cfg: ScenarioConfig) -> DataFrame:
    """(node, task_type, signs) of every row, stored: cells and shapes come from these."""
    signs = _signs(dim, cfg)(F.col("__x")).alias("signs")
    return cut_lineage(rows.select("node", "task_type", signs))


def _celled(signed: DataFrame, sizes: DataFrame, cfg: ScenarioConfig) -> DataFrame:
    """One row per row and table with its cell. A class that fits a cell has one table."""
    bits = F.greatest(F.lit(0), F.least(F.lit(SIGN_BITS), F.ceil(F.log2(F.col("size") / cfg.cell_rows)))).cast("int")
    plan = sizes.select("task_type", bits.alias("bits"))
    tables = signed.join(plan, "task_type").select("node", "task_type", "bits", F.posexplode("signs").alias("tab", "sign"))
    return tables.where((F.col("bits") > 0) | (F.col("tab") == 0)).withColumn(
        "cell", F.expr(f"shiftright(sign, {SIGN_BITS} - bits)")
    ).drop("sign", "bits")


def _best_of_block(dim: int, k: int):
    """Group function over one block: every row's k most similar other rows."""

    def best(pdf: pd.DataFrame) -> pd.DataFrame:
        node = pdf["node"].to_numpy()
        rows = unit_rows(stack(pdf["__x"], dim))
        sims = np.clip(rows @ rows.T, -1.0, 1.0)
        sims[node[:, None] == node[None, :]] = -2.0
        n = min(k, len(node) - 1)
        if n < 1:
            return pd.DataFrame({"a": [], "b": [], "sim": []})
        top = np.argpartition(-sims, n - 1, axis=1)[:, :n]
        a, b = np.repeat(node, n), node[top].ravel()
        sim = np.take_along_axis(sims, top, axis=1).ravel()
        return pd.DataFrame({"a": a, "b": b, "sim": sim})[sim > -2.0]

    return best


def neighbour_links(rows: DataFrame, signed: DataFrame, sizes: DataFrame, dim: int, cfg: ScenarioConfig) -> DataFrame:
    """(a, b, sim), each pair in both directions: rows that are among each other's most
    similar ones inside a block of a common cell.

    `rows` has task_type, node and `__x`; `sizes` the task types with their `size`.
    """
    in_cells = _celled(signed, sizes, cfg)
    cells = in_cells.groupBy("task_type", "tab", "cell").agg(F.ceil(F.count(F.lit(1)) / cfg.block_rows).alias("blocks"))
    places = (
        in_cells.join(cells, ["task_type", "tab", "cell"])
        .withColumn("block", F.pmod(F.xxhash64("tab", "node"), F.col("blocks")))
        .groupBy("node").agg(F.collect_list(F.struct("tab", "cell", "block")).alias("places"))  # one per table
    )
    best = (
        rows.select("task_type", "node", F.col("__x").cast("array<float>").alias("__x")).join(places, "node")
        .select("task_type", "node", "__x", F.inline("places"))
    )
    found = best.groupBy("task_type", "tab", "cell", "block").applyInPandas(
        _best_of_block(dim, cfg.neighbours), "a long, b long, sim double"
    )
    links = found.union(found.select("b", "a", "sim")).groupBy("a", "b").agg(F.max("sim").alias("sim"))
    # a row meets at most block_rows others per table
    strongest = Window.partitionBy("a").orderBy(F.desc("sim"), "b")
    return cut_lineage(links.withColumn("place", F.row_number().over(strongest)))


# --- levels -----------------------------------------------------------------------


def core_angles(links: DataFrame, classes: DataFrame) -> DataFrame:
    """(node, task_type, angle) of the rows that have `min_samples` neighbours: the angle of
    the last of these."""
    kth = (
        links.join(classes.select(F.col("node").alias("a"), "task_type", "min_samples"), "a")
        .where(F.col("place") == F.col("min_samples"))
        .select(F.col("a").alias("node"), "task_type", F.acos("sim").alias("angle"))
    )
    return cut_lineage(kth)


def _levelled(links: DataFrame, core: DataFrame, cfg: ScenarioConfig) -> tuple[DataFrame, DataFrame]:
    """Links that hold at level 0 at least, with the number of levels at which they hold; and
    the radius of every class."""
    radius = cut_lineage(
        core.groupBy("task_type").agg(
            F.greatest(F.percentile_approx("angle", 1 - cfg.radius_quantile, 10_000), F.lit(LEAST_RADIUS)).alias("radius")
        )
    )
    scaled = core.join(radius, "task_type").select("node", "task_type", (F.col("angle") / F.col("radius")).alias("core"), "radius")
    ends = scaled.select(F.col("node").alias("b"), F.col("core").alias("core_b"))
    reach = F.greatest(F.acos("sim") / F.col("radius"), F.col("core"), F.col("core_b"))
    held = F.size(F.filter(F.array(*map(F.lit, LEVELS)), lambda f: f >= F.col("reach")))
    joined = (
        links.where(F.col("place") <= cfg.neighbours)
        .join(scaled.withColumnRenamed("node", "a"), "a").join(ends, "b")
        .withColumn("reach", reach).withColumn("held", held).where("held > 0")
    )
    return cut_lineage(joined.select("task_type", "a", "b", "held")), radius


def level_components(held: DataFrame) -> DataFrame:
    """(level, node, root) of the links of every level."""
    each = F.sequence(F.lit(0), F.col("held") - 1)
    return components(held.select(F.explode(each).alias("level"), "a", "b"), ["level"])


# --- choice -----------------------------------------------------------------------


def _forest(signed: DataFrame, classes: DataFrame, member: DataFrame) -> DataFrame:
    """Components large enough to be a cluster: level, root, n, parent (their component one
    level looser) and coherence, about the length of the mean of their unit vectors.

    Two rows lie on the same side of a random plane with a chance that gives their angle, so
    the shares of rows on one side of each plane give the mean angle of all pairs.
    """
    counted = member.join(classes.select("node", "min_size"), "node").groupBy("level", "root").agg(
        F.count(F.lit(1)).alias("n"), F.first("min_size").alias("min_size")
    )
    large = cut_lineage(counted.where(F.col("n") >= F.col("min_size")).drop("min_size"))
    above = member.select(
        (F.col("level") + 1).alias("level"), F.col("node").alias("root"), F.col("root").alias("parent")
    )
    bits = [
        F.shiftright(F.col("signs")[t], k).bitwiseAND(F.lit(1)) for t in range(SHAPE_TABLES) for k in range(SIGN_BITS)
    ]
    shares = (
        member.join(large.select("level", "root"), ["level", "root"]).join(signed.select("node", "signs"), "node")
        .groupBy("level", "root").agg(*[F.avg(b).alias(f"b{i}") for i, b in enumerate(bits)])
    )
    agree = sum((F.pow(f"b{i}", 2) + F.pow(1 - F.col(f"b{i}"), 2) for i in range(len(bits))), F.lit(0.0)) / len(bits)
    shapes = shares.select("level", "root", F.sqrt(F.greatest(F.lit(0.0), F.cos(math.pi * (1 - agree)))).alias("coherence"))
    return cut_lineage(large.join(above, ["level", "root"], "left").join(shapes, ["level", "root"]))


def choose(forest: DataFrame, member: DataFrame, coherence: float) -> DataFrame:
    """(level, root) of the chosen components; none lies inside another.

    A cluster is born where a component falls apart, or where it comes out of a shapeless
    one, and lasts until it falls apart itself. Its weight is the sum over its levels of rows
    times the gain in density. From the densest clusters up, a cluster is better than what it
    falls into if it weighs more than the best choice among those.
    """
    density = [1 / LOOSEST, *[1 / f for f in LEVELS]]
    gains = F.array(*[F.lit(b - a) for a, b in zip(density, density[1:])])
    shaped = F.col("coherence") >= coherence
    above = forest.select((F.col("level") + 1).alias("level"), F.col("root").alias("parent"), shaped.alias("from_shaped"))
    parts = forest.groupBy("level", "parent").agg(F.count(F.lit(1)).alias("parts"))
    split = ~F.coalesce("from_shaped", F.lit(False)) | (F.coalesce("parts", F.lit(1)) > 1)
    comps = cut_lineage(
        forest.where(shaped).join(above, ["level", "parent"], "left").join(parts, ["level", "parent"], "left")
        .select("level", "root", split.alias("born"), (F.col("n") * F.element_at(gains, F.col("level") + 1)).alias("gain"))
    )
    births = comps.where("born").select(F.col("level").alias("up_level"), F.col("root").alias("up_root"))
    # clusters that hold a component: a member's components at looser levels (LEVELS at most)
    holders = (
        comps.join(member.select(F.col("node").alias("root"), F.col("level").alias("up_level"), F.col("root").alias("up_root")), "root")
        .where("up_level <= level").join(births, ["up_level", "up_root"])
    )
    own = holders.groupBy("level", "root", "gain").agg(F.max_by("up_root", "up_level").alias("up_root"), F.max("up_level").alias("up_level"))
    weights = own.groupBy(F.col("up_level").alias("level"), F.col("up_root").alias("root")).agg(
        F.sum("gain").alias("own"), F.count(F.lit(1)).alias("lasts")
    )
    over = cut_lineage(holders.where("born AND up_level < level").select("level", "root", "up_level", "up_root"))
    parents = over.groupBy("level", "root").agg(F.max_by("up_root", "up_level").alias("up_root"), F.max("up_level").alias("up_level"))
    alone = F.when(F.col("lasts") >= LASTS, F.col("own")).otherwise(0.0)
    clusters = cut_lineage(
        weights.join(parents, ["level", "root"], "left").withColumns({"alone": alone, "below": F.lit(0.0), "value": alone})
    )
    for _ in LEVELS:  # as many rounds as clusters lie inside each other
        inner = clusters.where("up_root IS NOT NULL").groupBy(F.col("up_level").alias("level"), F.col("up_root").alias("root")).agg(
            F.sum("value").alias("inside")
        )
        moved = cut_lineage(
            clusters.join(inner, ["level", "root"], "left").withColumn("below", F.coalesce("inside", F.lit(0.0)))
            .withColumn("old", F.col("value")).withColumn("value", F.greatest("alone", "below")).drop("inside")
        )
        clusters = moved.drop("old")
        if moved.where("old <> value").isEmpty():
            break
    better = clusters.where("alone > below").select("level", "root")
    inside = over.join(better.select(F.col("level").alias("up_level"), F.col("root").alias("up_root")), ["up_level", "up_root"])
    return cut_lineage(better.join(inside, ["level", "root"], "left_anti"))


def density_clusters(rows: DataFrame, sizes: DataFrame, dim: int, cfg: ScenarioConfig) -> DataFrame:
    """(node, task_type, raw) of the rows that belong to a cluster; raw names it.

    `rows` has task_type, node and the vector `__x`, `sizes` has task_type, size, min_size
    and min_samples of the classes to search. Rows at the rim, whose link to a member holds
    though they are not dense themselves, join the cluster of their best such neighbour.
    """
    mine = rows.join(sizes.select("task_type"), "task_type", "left_semi")
    signed = signed_rows(mine, dim, cfg).dropDuplicates(["node"])
    classes = cut_lineage(signed.select("node", "task_type").join(sizes.drop("size"), "task_type"))
    links = neighbour_links(mine, signed, sizes, dim, cfg)
    core = core_angles(links, classes)
    held, radius = _levelled(links, core, cfg)
    member = level_components(held)
    chosen = choose(_forest(signed, classes, member), member, cfg.coherence)
    inside = cut_lineage(
        member.join(chosen, ["level", "root"]).join(classes.select("node", "task_type"), "node")
        .select("node", "task_type", F.col("root").alias("raw"), "level")
    )
    factor = F.element_at(F.array(*map(F.lit, LEVELS)), F.col("level") + 1)
    rim = (
        links.where(F.col("place") <= cfg.neighbours)
        .join(inside.withColumnRenamed("node", "b"), "b").join(radius, "task_type")
        .where(F.acos("sim") <= factor * F.col("radius"))
        .join(inside.select(F.col("node").alias("a")), "a", "left_anti")
        .groupBy(F.col("a").alias("node"), "task_type")
        .agg(F.max_by("raw", F.struct("sim", "raw")).alias("raw"))
    )
    return cut_lineage(inside.drop("level").unionByName(rim))
