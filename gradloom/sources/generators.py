"""Synthetic weights, examples, labels and points for scale runs.

Randomness is a hash of ids and a seed, so a recomputed partition repeats.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradloom.functions.losses import with_softmax

# Draws of a partition, about: what one task tells apart.
PART_DRAWS = 2_000_000


def uniform(seed: int, *keys: str) -> Column:
    """Uniform number in [0, 1) that depends on the keys and the seed only."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *[F.col(k) for k in keys]), 11)
    return bits.cast("double") * F.lit(2.0**-53)


def normal(seed: int, *keys: str) -> Column:
    """Standard normal number, by the Box-Muller transform."""
    radius = F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - uniform(seed, *keys)))
    return radius * F.cos(F.lit(2.0) * F.pi() * uniform(seed + 1_000_003, *keys))


def uniform_vector(ids: DataFrame, seed: int = 0, scale: float = 1.0) -> DataFrame:
    """Random weight for every ``idx``, uniform on [0, scale)."""
    return ids.select("idx", (uniform(seed, "idx") * F.lit(scale)).alias("v"))


def uniform_matrix(ids: DataFrame, row_dim: int, seed: int = 0, scale: float = 1.0) -> DataFrame:
    cells = ids.select("idx", F.explode(F.sequence(F.lit(0), F.lit(row_dim - 1))).alias("k"))
    return cells.select("idx", "k", (uniform(seed, "idx", "k") * F.lit(scale)).alias("v"))


def sparse_examples(
    ids: DataFrame, per_example: int, dim: int, pick: Column | None = None, value: Column | None = None, seed: int = 0
) -> DataFrame:
    """``per_example`` draws of a feature in ``[0, dim)`` with a value in [-1, 1) for every ``ex_id``.

    A feature drawn twice is kept once, with its first draw.  ``pick`` and
    ``value`` override the hashed draws; they may use ``ex_id`` and ``draw``.
    Only ids move: their draws are made and told apart where they lie, a bounded number in a task.
    """
    parts = max(int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-ids.count() * per_example // PART_DRAWS))
    draws = ids.select("ex_id").repartition(parts, "ex_id").select("ex_id", F.explode(F.sequence(F.lit(0), F.lit(per_example - 1))).alias("draw"))
    pick = F.floor(uniform(seed, "ex_id", "draw") * F.lit(dim)) if pick is None else pick
    value = F.lit(2.0) * uniform(seed + 1, "ex_id", "draw") - 1.0 if value is None else value
    drawn = draws.select("ex_id", "draw", pick.cast("bigint").alias("fea_id"), value.alias("value"))
    return drawn.groupBy("ex_id", "fea_id").agg(F.min_by("value", "draw").alias("value"))


def fold_ids(examples: DataFrame, fold: int) -> DataFrame:
    """String ids ``fold{f}_{i}`` as scale runs store them."""
    return examples.withColumn("ex_id", F.concat(F.lit(f"fold{fold}_"), F.col("ex_id").cast("string")))


def label_by_score(examples: DataFrame, scores: DataFrame) -> DataFrame:
    """Use each example's score as its regression label."""
    joined = examples.drop("label").join(scores, "ex_id", "left")
    return joined.withColumn("label", F.coalesce("score", F.lit(0.0))).drop("score")


def label_by_softmax_draw(scores: DataFrame, row_dim: int, draw: Column | None = None, seed: int = 0) -> DataFrame:
    """One class per example, drawn with its softmax probability: ``ex_id, cls``.

    The class is the first whose cumulative probability exceeds the draw.
    """
    names = [f"p{i}" for i in range(row_dim)]
    rows = with_softmax(scores, [F.col(f"score{i}") for i in range(row_dim)], names)
    rows = rows.withColumn("u", uniform(seed, "ex_id") if draw is None else draw)
    running, below = F.lit(0.0), F.lit(0)
    for name in names[:-1]:
        running = running + F.col(name)
        below = below + F.when(running <= F.col("u"), 1).otherwise(0)
    return rows.select("ex_id", below.cast("int").alias("cls"))


def ball_points(ids: DataFrame, d: int, seed: int = 0, radius: float = 1.0, centre: Column | None = None) -> DataFrame:
    """A point per ``id``, uniform in the ``d``-ball of the radius around ``centre``."""
    cells = F.array(*[normal(seed + 7 * a + 1, "id") for a in range(d)])
    length = F.sqrt(F.aggregate("z", F.lit(0.0), lambda acc, z: acc + z * z))
    r = F.pow(uniform(seed, "id"), F.lit(1.0 / d)) * F.lit(radius)
    rows = ids.withColumn("z", cells).withColumns({"len": length, "r": r})
    spread = F.transform("z", lambda z: z * F.col("r") / F.col("len"))
    placed = spread if centre is None else F.zip_with(spread, centre, lambda a, b: a + b)
    return rows.select("id", placed.alias("p"))


def axis_centre(axis: Column, sign: Column, d: int, distance: float = 0.5) -> Column:
    """Point at plus or minus ``distance`` on one axis."""
    return F.array(*[F.when(axis == a, sign * F.lit(distance)).otherwise(F.lit(0.0)) for a in range(d)])


def mixture_points(ids: DataFrame, d: int, balls: int, seed: int = 0, radius: float = 0.5) -> DataFrame:
    """Points from a mixture of ``2 * balls`` balls centred at plus or minus half an axis.

    A ball's axis is random; each ball has a mirror image.
    """
    which = F.floor(uniform(seed + 11, "id") * F.lit(2 * balls)).cast("bigint")
    rows = ids.withColumns({"ball": F.shiftright(which, 1), "mirrored": which % 2})
    axis = F.floor(uniform(seed + 13, "ball") * F.lit(min(balls, d)))
    sign = F.when(F.col("mirrored") == 1, F.lit(-1.0)).otherwise(F.lit(1.0))
    return ball_points(rows.withColumn("c", axis_centre(axis, sign, d)), d, seed + 17, radius, F.col("c"))


def ranked_positives(scored: DataFrame, top: int, group: Sequence[str] = ("context_id",), item: str = "item") -> DataFrame:
    """The ``top`` best-scored items of every group, ties by item.

    The group-limit filter keeps only ``top`` rows per group and task before
    the shuffle, so a large group never meets in one task.
    """
    order = Window.partitionBy(*group).orderBy(F.desc("score"), F.asc(item))
    ranked = scored.withColumn("rank", F.row_number().over(order))
    return ranked.filter(F.col("rank") <= top)
