"""Losses over scored examples, totals, and gradients pushed back to weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradloom.functions import losses as L
from gradloom.operators.scoring import with_all
from gradloom.operators.vectors import lengthen
from gradloom.plans.joins import lookup
from gradloom.schemas import in_range, require


def point_losses(examples: DataFrame, scores: DataFrame, loss: L.PointLoss) -> DataFrame:
    """``ex_id, loss, dscore, weight`` for every example."""
    scored = with_all(examples, scores, ["score"])
    args = F.col("score"), F.col("label"), F.col("weight")
    return scored.select("ex_id", loss.value(*args).alias("loss"), loss.slope(*args).alias("dscore"), "weight")


def with_probabilities(wide: DataFrame, row_dim: int) -> DataFrame:
    """Add class probabilities ``p0 ..`` of wide scores ``score0 ..``."""
    rng = range(row_dim)
    return L.with_softmax(wide, [F.col(f"score{i}") for i in rng], [f"p{i}" for i in rng])


def softmax_long(wide: DataFrame, row_dim: int) -> DataFrame:
    """Class probabilities ``ex_id, k, prob`` of wide scores."""
    return lengthen(with_probabilities(wide, row_dim), row_dim, "p", "prob", ["ex_id"])


def softmax_jacobian(wide: DataFrame, row_dim: int) -> DataFrame:
    """Jacobian p_i(delta_ik - p_k) per example: ``ex_id, i, k, jac``."""
    probs = F.array(*[F.col(f"p{i}") for i in range(row_dim)])
    rows = with_probabilities(wide, row_dim).select("ex_id", probs.alias("p"))
    rows = rows.select("ex_id", "p", F.posexplode("p").alias("i", "p_i"))
    cells = rows.select("ex_id", "i", "p_i", F.posexplode("p").alias("k", "p_k"))
    delta = F.when(F.col("i") == F.col("k"), 1.0).otherwise(0.0)
    return cells.select("ex_id", "i", "k", (F.col("p_i") * (delta - F.col("p_k"))).alias("jac"))


def wide_targets(targets: DataFrame, row_dim: int) -> DataFrame:
    """Target weights per class as columns ``t0 ..`` with the example weight; a class outside ``[0, row_dim)`` fails."""
    targets = require(targets, (in_range(F.col("cls"), row_dim), "target class outside [0, row_dim)"))
    cells = [F.sum(F.when(F.col("cls") == i, F.col("tw")).otherwise(0.0)).alias(f"t{i}") for i in range(row_dim)]
    return targets.groupBy("ex_id").agg(*cells, F.max("weight").alias("weight"))


def multilabel_losses(targets_wide: DataFrame, scores_wide: DataFrame, row_dim: int) -> DataFrame:
    """``ex_id, loss, dscore0 .., weight`` of the multi-label softmax loss."""
    names = [f"score{i}" for i in range(row_dim)]
    scored = with_all(targets_wide, scores_wide, names)
    probs, targets = ([f"{c}{i}" for i in range(row_dim)] for c in "pt")
    scored = L.with_pull(with_probabilities(scored, row_dim), probs, targets, "pull")
    slopes = L.multilabel_slopes(probs, targets, "pull", F.col("weight"))
    return scored.select(
        "ex_id",
        L.multilabel_value(probs, targets, F.col("weight")).alias("loss"),
        *[s.alias(f"dscore{i}") for i, s in enumerate(slopes)],
        "weight",
    )


def forward(losses: DataFrame) -> DataFrame:
    """Average loss: one row ``loss, total_weight``."""
    total = F.sum("weight")
    return losses.agg(F.try_divide(F.sum("loss"), total).alias("loss"), total.alias("total_weight"))


def push_back(
    features: DataFrame, slopes: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("ex_id",)
) -> DataFrame:
    """Sum of value times slope per feature: ``idx`` and the same column names.

    Partial aggregation runs before the shuffle, so a feature present in every
    example costs one row per task.
    """
    joined = lookup(features, slopes.select(*keys, *columns), keys)
    sums = [F.sum(F.col("value") * F.col(c)).alias(c) for c in columns]
    return joined.groupBy(F.col("fea_id").alias("idx")).agg(*sums)


def fill_gradient(weights: DataFrame, grad: DataFrame, keys: Sequence[str] = ("idx",)) -> DataFrame:
    """Gradient on every coordinate of ``weights``; untouched coordinates get 0."""
    joined = weights.select(*keys).join(grad, list(keys), "left")
    return joined.select(*keys, F.coalesce("g", F.lit(0.0)).alias("g"))


def backward_vector(features: DataFrame, losses: DataFrame, total_weight: float | None = None) -> DataFrame:
    """``idx, g``: gradient of the average loss by the weights of used features."""
    if total_weight is None:
        total_weight = losses.agg(F.sum("weight")).first()[0]
    grad = push_back(features, losses, ["dscore"])
    return grad.select("idx", (F.col("dscore") / F.lit(float(total_weight))).alias("g"))


def backward_matrix(
    features: DataFrame, losses: DataFrame, row_dim: int, total_weight: float | None = None
) -> DataFrame:
    """``idx, k, g``: gradient of the average loss by a weight matrix."""
    if total_weight is None:
        total_weight = losses.agg(F.sum("weight")).first()[0]
    grad = push_back(features, losses, [f"dscore{i}" for i in range(row_dim)])
    return lengthen(grad, row_dim, "dscore", "g", ["idx"]).withColumn("g", F.col("g") / F.lit(float(total_weight)))
