"""Elementwise expressions shared by vectors, losses and optimizer steps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def ieee_divide(a: Column, b: Column) -> Column:
    """Division with IEEE results instead of an error on a zero divisor."""
    at_zero = (
        F.when((a == 0) | F.isnan(a), F.lit(float("nan")))
        .when(a > 0, F.lit(float("inf")))
        .otherwise(F.lit(float("-inf")))
    )
    return F.when(b == 0, at_zero).otherwise(F.try_divide(a, b))


def lincomb(*terms: tuple[float, Column]) -> Column:
    """Sum of coefficient times column; exact-zero coefficients are left out."""
    kept = [F.lit(float(c)) * col for c, col in terms if c != 0.0]
    return reduce(lambda a, b: a + b, kept) if kept else F.lit(0.0)


def sign(v: Column) -> Column:
    return F.signum(v)


def orthant_project(v: Column, orthant: Column) -> Column:
    """``v`` where its sign agrees with ``orthant``, else 0."""
    return F.when(F.signum(v) == F.signum(orthant), v).otherwise(F.lit(0.0))


def orthant(x: Column, grad: Column) -> Column:
    """Orthant a step may explore: that of x, or of steepest descent where x is 0."""
    return F.when(x != 0, x).otherwise(-grad)


def pseudo_gradient(x: Column, grad: Column, l1: Column) -> Column:
    """Least-norm element of the subdifferential of f + l1*|x|."""
    right, left = grad + l1, grad - l1
    at_zero = F.when(right < 0, right).when(left > 0, left).otherwise(F.lit(0.0))
    return F.when(x != 0, grad + l1 * F.signum(x)).otherwise(at_zero)


def soft_threshold(x: Column, cut: Column) -> Column:
    return F.when(F.abs(x) < cut, F.lit(0.0)).otherwise(x - F.signum(x) * cut)


def adagrad_scale(h: Column, g: Column, delta: float, compat: bool = False) -> Column:
    """Per-coordinate scale; ``compat`` keeps the history outside the root."""
    return h + F.sqrt(g * g + F.lit(delta)) if compat else F.sqrt(h + g * g + F.lit(delta))


def adagrad_point(x: Column, g: Column, s: Column, eta: float, l1: float, l2: float) -> Column:
    """Next point of a proximal adaptive step against gradient ``g``."""
    if l2 > 0:
        stepped = (x * s - F.lit(eta) * g) / (s + F.lit(l2 * eta))
    else:
        stepped = x - F.lit(eta) * g / s
    return soft_threshold(stepped, F.lit(l1 * eta) / s) if l1 > 0 else stepped


def adagrad_memory(h: Column, g: Column, aged: Column, max_age: int) -> Column:
    """Sum of squared gradients; once aged, an exponential average."""
    keep = 1.0 - 1.0 / max_age
    return F.when(aged, g * g * F.lit(1.0 / max_age) + h * F.lit(keep)).otherwise(h + g * g)


def step_size(eta: float, iteration: Column | int, decay: float, power: float) -> Column | float:
    """Decaying step length, for one iteration number or a column of them."""
    if isinstance(iteration, Column):
        return F.lit(eta) / F.pow(F.lit(decay) * iteration + F.lit(1.0), F.lit(power))
    return eta / (decay * iteration + 1.0) ** power
