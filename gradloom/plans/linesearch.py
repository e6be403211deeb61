"""One-dimensional searches on the driver over probes evaluated in Spark.

A line offers ``probe(alphas)``: values and slopes at several steps, from one
job.  The searches ask for the steps they may need next together with the one
they need now, so a search is usually one or two jobs.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass
from functools import cached_property
from typing import Protocol


class MinimizeError(RuntimeError):
    """A step that could not be taken; the minimizer retries once without history."""


class LineSearchFailed(MinimizeError):
    pass


class StepUnderflow(MinimizeError):
    pass


class StepOverflow(MinimizeError):
    pass


class BadHistory(MinimizeError):
    pass


@dataclass(frozen=True)
class Point:
    """A probed step; its slope may be a function, called when the slope is first read."""

    alpha: float
    value: float
    given: float | Callable[[], float]

    @cached_property
    def slope(self) -> float:
        return self.given() if callable(self.given) else self.given


class Line(Protocol):
    def probe(self, alphas: Sequence[float]) -> list[tuple[float, float | Callable[[], float]]]: ...


class Search(Protocol):
    def minimize(self, line: "Probes", init: float) -> float: ...


class Probes:
    """Remembers every probed step and fetches look-ahead steps in the same job."""

    def __init__(self, line: Line, known: Point | None = None, speculate: bool = True):
        self.line = line
        self.speculate = speculate
        self.jobs = 0
        self.seen: dict[float, Point] = {} if known is None else {known.alpha: known}

    def at(self, alpha: float, ahead: Iterable[float] = ()) -> Point:
        if alpha not in self.seen:
            extra = [a for a in ahead if a not in self.seen] if self.speculate else []
            wanted = list(dict.fromkeys([alpha, *extra]))
            self.jobs += 1
            for a, (value, slope) in zip(wanted, self.line.probe(wanted)):
                self.seen[a] = Point(a, value, slope)
        return self.seen[alpha]


def cubic_minimizer(p: Point, q: Point) -> float:
    """Minimizer of the cubic through two points with slopes, kept in the middle 80 %."""
    left, right = (p, q) if p.alpha < q.alpha else (q, p)
    width = right.alpha - left.alpha
    bend = left.slope + right.slope - 3.0 * (right.value - left.value) / width
    inside = bend * bend - left.slope * right.slope
    share = 0.5
    if inside >= 0.0:
        root = math.sqrt(inside)
        below = right.slope - left.slope + 2.0 * root
        if below != 0.0:
            share = 1.0 - (right.slope + root - bend) / below
    if not math.isfinite(share):
        share = 0.5
    return left.alpha + width * min(max(share, 0.1), 0.9)


@dataclass(frozen=True)
class StrongWolfe:
    """Bracketing search for the strong Wolfe conditions (Nocedal & Wright, section 3.5)."""

    max_iter: int = 10
    max_zoom: int = 10
    grow: float = 1.5
    armijo: float = 1e-4
    curvature: float = 0.9

    def minimize(self, line: Probes, init: float = 1.0, bound: float = math.inf) -> float:
        if init > bound:
            raise ValueError(f"first step {init} lies above the bound {bound}")
        origin = line.at(0.0, [init, init * self.grow])
        if origin.slope > 0:
            raise LineSearchFailed(f"not a descent direction: slope {origin.slope}")
        last, alpha = origin, init
        for attempt in range(self.max_iter):
            here = line.at(alpha, [min(alpha * self.grow, bound), min(alpha * self.grow**2, bound)])
            if not math.isfinite(here.value):
                alpha /= 2.0
                continue
            rose = attempt > 0 and here.value >= last.value
            if rose or not self._decreased(origin, here):
                return self._zoom(line, origin, last, here)
            if self._flat(origin, here):
                return alpha
            if here.slope >= 0:
                return self._zoom(line, origin, here, last)
            if alpha >= bound:
                return bound
            last, alpha = here, min(alpha * self.grow, bound)
        raise LineSearchFailed("no bracket found")

    def _decreased(self, origin: Point, p: Point) -> bool:
        return p.value <= origin.value + self.armijo * p.alpha * origin.slope

    def _flat(self, origin: Point, p: Point) -> bool:
        return abs(p.slope) <= self.curvature * abs(origin.slope)

    def _zoom(self, line: Probes, origin: Point, good: Point, other: Point) -> float:
        """Shrink a bracket whose ``good`` end has the lowest acceptable value so far."""
        for _ in range(self.max_zoom):
            here = line.at(cubic_minimizer(good, other))
            if not self._decreased(origin, here) or here.value >= good.value:
                other = here
                continue
            if self._flat(origin, here):
                return here.alpha
            if here.slope * (other.alpha - good.alpha) >= 0:
                other = good
            good = here
        raise LineSearchFailed("zoom did not converge")


@dataclass(frozen=True)
class Backtracking:
    """Armijo search that shrinks or grows the step, with optional Wolfe tests."""

    max_iter: int = 20
    shrink: float = 0.5
    grow: float = 2.0
    armijo: float = 1e-4
    curvature: float = 0.9
    min_alpha: float = 1e-10
    max_alpha: float = 1e10
    wolfe: bool = True
    strong_wolfe: bool = True

    def __post_init__(self):
        if not (0.0 < self.armijo < 0.5 and self.armijo < self.curvature < 1.0):
            raise ValueError("need 0 < armijo < 0.5 and armijo < curvature < 1")

    def _factor(self, origin: Point, here: Point) -> float:
        """What to multiply the step by; 1 accepts it."""
        limit = origin.value + self.armijo * here.alpha * origin.slope
        if not here.value <= limit:  # also true for nan
            return self.shrink
        if self.wolfe and here.slope < self.curvature * origin.slope:
            return self.grow
        if self.strong_wolfe and here.slope > -self.curvature * origin.slope:
            return self.shrink
        return 1.0

    def minimize(self, line: Probes, init: float = 1.0) -> float:
        origin = line.at(0.0, [init])
        alpha = init
        for _ in range(self.max_iter):
            ahead = [alpha * self.shrink, alpha * self.shrink**2]
            here = line.at(alpha, ahead + [alpha * self.grow] if self.wolfe else ahead)
            factor = self._factor(origin, here)
            if factor == 1.0:
                return alpha
            alpha *= factor
            if alpha < self.min_alpha:
                raise StepUnderflow(f"step {alpha}")
            if alpha > self.max_alpha:
                raise StepOverflow(f"step {alpha}")
        raise LineSearchFailed(f"no acceptable step after {self.max_iter} tries")
