"""Scores of sparse examples under linear and factorization-machine models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradloom.operators.vectors import lengthen, widen
from gradloom.plans.joins import lookup


def with_weights(features: DataFrame, weights: DataFrame, dim: int | None) -> DataFrame:
    """Feature rows with the weight columns of their coordinate."""
    return lookup(features, weights.withColumnRenamed("idx", "fea_id"), ["fea_id"], dim)


def weighted_sums(
    features: DataFrame, weights: DataFrame, columns: Sequence[str], names: Sequence[str], keys: Sequence[str], dim: int | None
) -> DataFrame:
    """Per example, the sum over its features of value times each weight column."""
    joined = with_weights(features, weights, dim)
    return joined.groupBy(*keys).agg(*[F.sum(F.col("value") * F.col(c)).alias(n) for c, n in zip(columns, names)])


def score_linear(features: DataFrame, weights: DataFrame, dim: int | None = None) -> DataFrame:
    """``ex_id, score`` for weights ``idx, v``."""
    return weighted_sums(features, weights, ["v"], ["score"], ["ex_id"], dim)


def score_linear_multi(features: DataFrame, mat: DataFrame, row_dim: int, dim: int | None = None) -> DataFrame:
    """Wide scores ``ex_id, score0 ..`` for a matrix ``idx, k, v``."""
    cols, names = ([f"{p}{i}" for i in range(row_dim)] for p in ("v", "score"))
    return weighted_sums(features, widen(mat, row_dim), cols, names, ["ex_id"], dim)


def scores_long(wide: DataFrame, row_dim: int) -> DataFrame:
    return lengthen(wide, row_dim, "score", "score", ["ex_id"])


def with_all(examples: DataFrame, scores: DataFrame, names: Sequence[str], keys: Sequence[str] = ("ex_id",)) -> DataFrame:
    """Attach scores to every example; an example without features scores 0."""
    joined = examples.join(scores, list(keys), "left")
    return joined.withColumns({n: F.coalesce(F.col(n), F.lit(0.0)) for n in names})


def fm_sums(
    features: DataFrame, mat: DataFrame, row_dim: int, keys: Sequence[str] = ("ex_id",), dim: int | None = None
) -> DataFrame:
    """Factor sums ``s0 ..`` and the sum of squares ``q`` per example."""
    joined = with_weights(features, widen(mat, row_dim), dim)
    x = F.col("value")
    vs = [F.col(f"v{i}") for i in range(row_dim)]
    squares = sum((v * v for v in vs[1:]), vs[0] * vs[0])
    sums = [F.sum(x * v).alias(f"s{i}") for i, v in enumerate(vs)]
    return joined.groupBy(*keys).agg(*sums, F.sum(x * x * squares).alias("q"))


def fm_score_expr(row_dim: int) -> Column:
    """Pairwise-interaction score from the sums of :func:`fm_sums`."""
    ss = [F.col(f"s{i}") for i in range(row_dim)]
    return F.lit(0.5) * (sum((s * s for s in ss[1:]), ss[0] * ss[0]) - F.col("q"))


def score_fm(
    features: DataFrame, mat: DataFrame, row_dim: int, keys: Sequence[str] = ("ex_id",), dim: int | None = None
) -> DataFrame:
    return fm_sums(features, mat, row_dim, keys, dim).select(*keys, fm_score_expr(row_dim).alias("score"))


def fm_backprop(features: DataFrame, mat: DataFrame, row_dim: int, dim: int | None = None) -> DataFrame:
    """Derivative of each example's score by each factor: ``ex_id, fea_id, k, grad``."""
    sums = fm_sums(features, mat, row_dim, dim=dim)
    joined = lookup(with_weights(features, widen(mat, row_dim), dim), sums, ["ex_id"])
    x = F.col("value")
    grads = F.array(*[x * (F.col(f"s{i}") - F.col(f"v{i}") * x) for i in range(row_dim)])
    return joined.select("ex_id", "fea_id", F.posexplode(grads).alias("k", "grad"))
