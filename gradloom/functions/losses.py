"""Pointwise losses and their derivatives with respect to the score."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: keeps logarithms and quotients finite for saturated scores.
GUARD = 1e-24


def sigmoid(s: Column) -> Column:
    """Logistic function that cannot overflow."""
    e = F.exp(-F.abs(s))
    return F.when(s >= 0, F.lit(1.0) / (F.lit(1.0) + e)).otherwise(e / (F.lit(1.0) + e))


@dataclass(frozen=True)
class PointLoss:
    """``value`` and ``slope`` take (score, label, weight) columns."""

    name: str
    value: Callable[[Column, Column, Column], Column]
    slope: Callable[[Column, Column, Column], Column]


SQUARED = PointLoss(
    "squared",
    lambda p, y, w: w * (p - y) * (p - y),
    lambda p, y, w: F.lit(2.0) * w * (p - y),
)


def quantile(q: float) -> PointLoss:
    """Pinball loss of score minus label; its minimizer is the (1-q) quantile of the label."""
    if not 0.0 < q < 1.0:
        raise ValueError("q must lie strictly between 0 and 1")

    def value(p, y, w):
        return w * F.when(p < y, F.lit(q - 1.0) * (p - y)).otherwise(F.lit(q) * (p - y))

    def slope(p, y, w):
        return w * F.when(p < y, F.lit(q - 1.0)).otherwise(F.lit(q))

    return PointLoss(f"quantile_{q}", value, slope)


def _log_value(p, y, w):
    hit = F.when(y, sigmoid(p)).otherwise(sigmoid(-p))
    return -w * F.log(hit + F.lit(GUARD))


def _log_slope(p, y, w):
    return F.when(y, -w * sigmoid(-p)).otherwise(w * sigmoid(p))


LOGISTIC = PointLoss("logistic", _log_value, _log_slope)


def pair_value(pos: Column, neg: Column, w: Column) -> Column:
    """Loss of ranking a positive above a negative."""
    return -w * F.log(sigmoid(pos - neg) + F.lit(GUARD))


def pair_slope(pos: Column, neg: Column, w: Column) -> Column:
    """Derivative of :func:`pair_value` by the positive score; the negative gets its opposite."""
    hit, miss = sigmoid(pos - neg), sigmoid(neg - pos)
    return -w * hit * miss / (hit + F.lit(GUARD))


def with_softmax(df: DataFrame, scores: list[Column], names: list[str]) -> DataFrame:
    """Add probabilities over wide scores, shifted by the largest score.

    Built in steps: each step's columns are used many times by the next, and
    as one expression they would multiply.
    """
    top, total = f"{names[0]}_top", f"{names[0]}_total"
    df = df.withColumn(top, F.greatest(*scores) if len(scores) > 1 else scores[0])
    df = df.withColumns({n: F.exp(s - F.col(top)) for n, s in zip(names, scores)})
    df = df.withColumn(total, sum((F.col(n) for n in names[1:]), F.col(names[0])))
    return df.withColumns({n: F.col(n) / F.col(total) for n in names}).drop(top, total)


def with_pull(df: DataFrame, probs: list[str], targets: list[str], name: str) -> DataFrame:
    """Add the sum over classes that all slopes of a row share."""
    return df.withColumn(name, sum((_pull(p, t) for p, t in zip(probs[1:], targets[1:])), _pull(probs[0], targets[0])))


def _pull(prob: str, target: str) -> Column:
    return F.col(target) * F.col(prob) / (F.col(prob) + F.lit(GUARD))


def multilabel_value(probs: list[str], targets: list[str], w: Column) -> Column:
    terms = [F.col(t) * F.log(F.col(p) + F.lit(GUARD)) for p, t in zip(probs, targets)]
    return -w * sum(terms[1:], terms[0])


def multilabel_slopes(probs: list[str], targets: list[str], pull: str, w: Column) -> list[Column]:
    """Gradient by each class score, through the softmax Jacobian."""
    return [w * (F.col(p) * F.col(pull) - _pull(p, t)) for p, t in zip(probs, targets)]
