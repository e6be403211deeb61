"""First-order minimizers over one state table.

All vectors of a run are columns of ``state(keys, x, g, ...)``, so a step is a
projection and every inner product of an iteration comes out of one
aggregate.  The driver sees scalars: losses, step lengths, a small Gram matrix.
"""

from __future__ import annotations

import json
import logging
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradloom.functions import elementwise as E
from gradloom.operators.vectors import gram_and_sum
from gradloom.plans.joins import fits_broadcast
from gradloom.plans.lineage import cut
from gradloom.plans.linesearch import (
    Backtracking,
    BadHistory,
    MinimizeError,
    Point,
    Probes,
    Search,
    StepUnderflow,
    StrongWolfe,
)
from gradloom.plans.objectives import FullLine, Objective
from gradloom.plans.runs import RunStore
from gradloom.schemas import require_dense

log = logging.getLogger(__name__)

# Why a run ended.
MAX_ITERATIONS = "max iterations reached"
VALUES_CONVERGED = "function values converged"
GRADIENT_CONVERGED = "gradient converged"
SEARCH_FAILED = "line search failed!"


@dataclass(frozen=True)
class State:
    """One iterate: the table, and the scalars that describe it."""

    table: DataFrame
    keys: tuple[str, ...]
    value: float
    adjusted_value: float
    grad_norm: float
    iteration: int
    initial_value: float
    history: int = 0
    search_failed: bool = False
    reason: str | None = None
    alpha: float | None = None
    trace: tuple[dict, ...] = ()
    gram: np.ndarray | None = field(default=None, compare=False, repr=False)

    @property
    def x(self) -> DataFrame:
        return self.table.select(*self.keys, F.col("x").alias("v"))

    @property
    def gradient(self) -> DataFrame:
        return self.table.select(*self.keys, "g")

    def reset_iterations(self) -> "State":
        """Keep point and history; forget counter, failure and verdict."""
        return replace(self, iteration=0, search_failed=False, reason=None)


def relative_improvement(old: float, new: float, initial: float) -> float:
    scale = max(abs(old), abs(new), 1e-6 * abs(initial))
    return (old - new) / scale if scale else 0.0


def trace_frame(spark: SparkSession, state: State) -> DataFrame:
    """One row per iteration: value, gradient norm, step, improvement, verdict."""
    schema = "iter int, value double, adjusted_value double, grad_norm double, alpha double, improvement double, reason string"
    names = [part.split()[0] for part in schema.split(", ")]
    return spark.createDataFrame([tuple(t[n] for n in names) for t in state.trace], schema)


def save_state(state: State, path: str, files: int | None = None) -> None:
    """Write the state table and its scalars under ``path``."""
    table = state.table.repartition(files) if files else state.table
    table.write.mode("overwrite").parquet(f"{path}/table")
    scalars = {k: getattr(state, k) for k in ("value", "adjusted_value", "grad_norm", "iteration", "initial_value",
                                              "history", "search_failed", "reason", "alpha")}
    scalars |= {"keys": list(state.keys), "trace": list(state.trace)}
    spark = state.table.sparkSession
    spark.createDataFrame([(json.dumps(scalars),)], "scalars string").write.mode("overwrite").parquet(f"{path}/scalars")


def load_state(spark: SparkSession, path: str) -> State:
    """Read a saved state; pass it to ``minimize(..., resume=...)``."""
    scalars = json.loads(spark.read.parquet(f"{path}/scalars").first()[0])
    scalars["keys"], scalars["trace"] = tuple(scalars["keys"]), tuple(scalars["trace"])
    return State(table=spark.read.parquet(f"{path}/table"), **scalars)


class Minimizer:
    """The iteration shared by all methods.

    ``max_iter < 0`` means no limit.  Every ``checkpoint_every`` iterations the
    state is written to the checkpoint folder, which bounds plans and recovery.
    A state enters the next one's plan several times, so plans grow quickly
    when that is rare.
    """

    # State columns beyond x and g that a method starts with.
    extra_columns: dict[str, float] = {}

    def __init__(
        self,
        max_iter: int = -1,
        tolerance: float = 1e-6,
        lower_fun_tolerance: float = 0.0,
        checkpoint_every: int = 1,
        hold_batch: bool = True,
    ):
        self.max_iter = max_iter
        self.tolerance = tolerance
        self.lower_fun_tolerance = lower_fun_tolerance
        self.checkpoint_every = checkpoint_every
        self.hold_batch = hold_batch

    # What a method fills in.

    def direction(self, state: State) -> Column:
        """Descent direction over the state's columns."""
        return -F.col("g")

    def step(self, state: State, objective: Objective, direction: Column) -> tuple[float, FullLine | None, Probes | None]:
        """Step length, with the line it was found on if it can be reused."""
        raise NotImplementedError

    def point(self, state: State, direction: Column, alpha: float) -> Column:
        return F.col("x") + F.lit(alpha) * direction

    def carried(self, state: State, direction: Column, alpha: float) -> dict[str, Column]:
        """Method columns of the next state, over the old columns plus ``x_new`` and ``g_new``."""
        return {}

    def next_history(self, state: State) -> int:
        return 0

    def penalty(self, keys: Sequence[str]) -> Column:
        """What the method itself adds to the value for a coordinate."""
        return F.lit(0.0)

    def adjusted(self, table: DataFrame, value: float, keys: Sequence[str] = ("idx",)) -> float:
        """Value reported and compared by the method, with its own penalties."""
        return value + (table.agg(F.sum(self.penalty(keys))).first()[0] or 0.0)

    def measured(self, table: DataFrame, keys: Sequence[str], history: int) -> tuple[np.ndarray, float]:
        """Gram matrix and penalty of a state, from one aggregate."""
        return gram_and_sum(table, self.gram_columns(history), self.penalty(keys))

    def plain_value(self, probed: Point, line) -> float:
        """Value without the method's own penalties, at a step of the line."""
        return probed.value

    def gram_columns(self, history: int) -> list[str]:
        return ["g"]

    def forget(self, state: State) -> State:
        """The same point without history, after a first failure."""
        return state

    # The loop.

    def verdict(self, previous: float, current: float, iteration: int, grad_norm: float) -> str | None:
        """Why to stop at the state after ``iteration``, if at all."""
        gain = previous - current
        settled = gain < self.tolerance if gain >= 0 else -gain > self.lower_fun_tolerance
        if settled:
            return VALUES_CONVERGED
        if 0 <= self.max_iter <= iteration + 1:
            return MAX_ITERATIONS
        return GRADIENT_CONVERGED if grad_norm < self.tolerance else None

    def minimize(self, objective: Objective, x0: DataFrame, resume: State | None = None, store: RunStore | None = None, save_every: int = 1) -> State:
        """Run to a verdict and return the last state.

        With a store, go on from its last version if it has one, and commit every
        ``save_every``-th state and the last.
        """
        last, stale = None, []
        if store is not None and resume is None:
            resume = store.resume(objective)
        begun = resume.iteration if resume is not None else 0
        for state in self.iterations(objective, x0, resume):
            if store is not None and state.iteration > begun and (state.reason or state.iteration % save_every == 0):
                store.save(state, objective)
            if last is not None:
                stale.append(last.table)
                if state.iteration > last.iteration:
                    for table in stale:
                        table.unpersist()
                    stale = []
            last = state
        return last

    def iterations(self, objective: Objective, x0: DataFrame, resume: State | None = None) -> Iterator[State]:
        """States from the first to the one with a verdict."""
        state = self._adopt(resume, objective) if resume is not None else self._start(objective, x0)
        yield state
        failed = False
        while state.reason is None:
            try:
                state = self._advance(objective, state)
                failed = False
            except MinimizeError as error:
                log.info("iteration %d: %s", state.iteration, error)
                if failed:
                    state = replace(state, search_failed=True, reason=SEARCH_FAILED)
                else:
                    failed, state = True, self.forget(state)
            yield state

    def _place(self, table: DataFrame, objective: Objective) -> DataFrame:
        """Cache the state; a large one by key, so the joins of an iteration leave it in place."""
        if not fits_broadcast(objective.dim):
            table = table.repartition(*objective.placement)
        return table.persist(StorageLevel.MEMORY_AND_DISK)

    def _start(self, objective: Objective, x0: DataFrame) -> State:
        keys = tuple(objective.keys)
        value, grad = objective.evaluate(x0)
        table = x0.withColumnRenamed("v", "x").join(grad, list(keys), "left")
        table = table.select(*keys, "x", F.coalesce("g", F.lit(0.0)).alias("g"))
        # Cut here too: the first state's plan holds the model's whole input.
        table = self._place(cut(table.withColumns({n: F.lit(v) for n, v in self.extra_columns.items()})), objective)
        require_dense(table, keys, objective.extent())
        gram, penalty = self.measured(table, keys, 0)
        objective.tidy()
        adjusted = value + penalty
        return State(table, keys, value, adjusted, math.sqrt(gram[-1, -1]), 0, adjusted, gram=gram)

    def _adopt(self, state: State, objective: Objective) -> State:
        table, names = self._place(state.table, objective), self.gram_columns(state.history)
        if state.gram is not None and len(state.gram) == len(names):
            return replace(state, table=table)
        return replace(state, table=table, gram=self.measured(table, state.keys, state.history)[0])

    def _advance(self, objective: Objective, state: State) -> State:
        direction = self.direction(state)
        line = None
        try:
            if self.hold_batch:
                objective.hold()
            try:
                alpha, line, probes = self.step(state, objective, direction)
            finally:
                if self.hold_batch:
                    objective.release()
            moved = state.table.withColumn("x_new", self.point(state, direction, alpha))
            grad = line.finish(alpha) if line is not None and objective.same_data_next() else None
            if grad is not None:
                value = self.plain_value(probes.at(alpha), line)
            else:
                value, grad = objective.evaluate(moved.select(*state.keys, F.col("x_new").alias("v")))
            return self._settle(objective, state, moved, direction, alpha, value, grad)
        finally:
            if line is not None:
                line.close()

    def _settle(self, objective, state, moved, direction, alpha, value, grad) -> State:
        keys = list(state.keys)
        joined = moved.join(grad.withColumnRenamed("g", "g_new"), keys, "left")
        joined = joined.withColumn("g_new", F.coalesce("g_new", F.lit(0.0)))
        carried = self.carried(state, direction, alpha)
        table = joined.select(
            *keys, F.col("x_new").alias("x"), F.col("g_new").alias("g"), *[c.alias(n) for n, c in carried.items()]
        )
        iteration, history = state.iteration + 1, self.next_history(state)
        if self.checkpoint_every > 0 and iteration % self.checkpoint_every == 0:
            table = self._place(cut(table), objective)
        else:
            table = table.persist(StorageLevel.MEMORY_AND_DISK)
        gram, penalty = self.measured(table, keys, history)  # also materializes the table
        objective.tidy()
        grad_norm = math.sqrt(gram[-1, -1])
        adjusted = value + penalty
        improvement = relative_improvement(state.adjusted_value, adjusted, state.initial_value)
        reason = self.verdict(state.value, value, state.iteration, grad_norm)
        row = {"iter": iteration, "value": value, "adjusted_value": adjusted, "grad_norm": grad_norm,
               "alpha": alpha, "improvement": improvement, "reason": reason}
        log.info("iteration %(iter)d: value %(value).6g, improvement %(improvement).3g, step %(alpha).4g", row)
        return State(table, state.keys, value, adjusted, grad_norm, iteration, state.initial_value, history,
                     False, reason, alpha, (*state.trace, row), gram)


class GradientDescent(Minimizer):
    """Steps of decaying length against the gradient."""

    def __init__(self, eta: float, power: float, decay: float, **common):
        super().__init__(**common)
        self.eta, self.power, self.decay = eta, power, decay

    def step(self, state, objective, direction):
        return E.step_size(self.eta, state.iteration, self.decay, self.power), None, None


class AdaGrad(Minimizer):
    """Adaptive per-coordinate steps with L1 and L2 proximal terms.

    The default scale is sqrt(h + g^2 + delta); ``compat=True`` uses
    h + sqrt(g^2 + delta).
    """

    extra_columns = {"h": 0.0}

    def __init__(
        self, eta: float, l2: float = 0.0, l1: float = 0.0, max_age: int = 5, delta: float = 1e-4, compat: bool = False, **common
    ):
        super().__init__(**common)
        if l1 < 0 or l2 < 0:
            raise ValueError("penalties must not be negative")
        self.eta, self.l2, self.l1 = eta, l2, l1
        self.max_age, self.delta, self.compat = max_age, delta, compat

    def step(self, state, objective, direction):
        return self.eta, None, None

    def point(self, state, direction, alpha):
        s = E.adagrad_scale(F.col("h"), F.col("g"), self.delta, self.compat)
        return E.adagrad_point(F.col("x"), F.col("g"), s, alpha, self.l1, self.l2)

    def carried(self, state, direction, alpha):
        aged = F.lit(state.iteration > self.max_age)
        return {"h": E.adagrad_memory(F.col("h"), F.col("g"), aged, self.max_age)}

    def forget(self, state):
        return replace(state, table=state.table.withColumn("h", F.lit(0.0)))

    def penalty(self, keys):
        return F.lit(0.5 * self.l2) * F.col("x") * F.col("x") + F.lit(self.l1) * F.abs("x")

    def adjusted_gradient(self, state: State) -> DataFrame:
        """Gradient with both penalty terms."""
        g = F.col("g") + F.lit(self.l2) * F.col("x") + F.lit(self.l1) * F.signum("x")
        return state.table.select(*state.keys, g.alias("g"))


def pair_columns(history: int) -> list[str]:
    """Stored steps and gradient changes, newest first."""
    return [f"s{i}" for i in range(history)] + [f"y{i}" for i in range(history)]


def two_loop(gram: np.ndarray, history: int) -> np.ndarray:
    """Coefficients of minus the L-BFGS inverse Hessian applied to the last basis vector.

    ``gram`` holds the inner products of ``s0.., y0.., g``.  The recursion runs
    on coefficients over that basis, so no vector is touched (Chen, Wang and
    Zhou, "Large-scale L-BFGS using MapReduce", 2014).
    """
    size = 2 * history + 1
    q = np.zeros(size)
    q[-1] = 1.0
    if history:
        curvature = gram[0, history]
        if not curvature >= 0:
            raise BadHistory(f"curvature {curvature}")
    weights = np.zeros(history)
    for i in range(history):
        rho = gram[i, history + i]
        weights[i] = (gram[i] @ q) / rho if rho else math.nan
        if math.isnan(weights[i]):
            raise BadHistory("no curvature along a stored step")
        q[history + i] -= weights[i]
    if history:
        q *= gram[0, history] / gram[history, history]
    for i in reversed(range(history)):
        q[i] += weights[i] - (gram[history + i] @ q) / gram[i, history + i]
    return -q


class LBFGS(Minimizer):
    """Limited-memory BFGS with ``memory`` stored pairs.

    One aggregate gives all inner products and one projection the direction,
    whatever the memory.
    """

    def __init__(self, memory: int, search: Search | None = None, base_step: float = 1.0, fixed_steps: Sequence[float] | None = None,
                 max_search: int = 10, max_zoom: int = 10, **common):
        super().__init__(**common)
        self.memory = memory
        self.search = search or StrongWolfe(max_iter=max_search, max_zoom=max_zoom)
        self.base_step = base_step
        self.fixed_steps = fixed_steps

    def gram_columns(self, history):
        return [*pair_columns(history), "g"]

    def next_history(self, state):
        return min(state.history + 1, self.memory)

    def direction(self, state):
        coefficients = two_loop(state.gram, state.history)
        return E.lincomb(*[(c, F.col(n)) for c, n in zip(coefficients, self.gram_columns(state.history))])

    def slope(self, state: State) -> float:
        """Directional derivative at step 0, from the Gram matrix."""
        return float(state.gram[-1] @ two_loop(state.gram, state.history))

    def first_step(self, state: State) -> float:
        return self.base_step if state.iteration == 0 else 1.0

    def step(self, state, objective, direction):
        if self.fixed_steps is not None:
            return self.fixed_steps[state.iteration], None, None
        xd = state.table.select(*state.keys, "x", direction.alias("d"))
        line = objective.line(xd)
        known = Point(0.0, state.value, self.slope(state)) if objective.line_starts_at_state() else None
        probes = Probes(line, known, speculate=not isinstance(line, FullLine))
        try:
            alpha = self.search.minimize(probes, self.first_step(state))
            if alpha * state.grad_norm < 1e-10:
                raise StepUnderflow(f"step {alpha}")
        except MinimizeError:
            line.close()
            raise
        return alpha, line, probes

    def carried(self, state, direction, alpha):
        kept = self.next_history(state)
        out = {"s0": F.col("x_new") - F.col("x"), "y0": F.col("g_new") - F.col("g")}
        out |= {f"{v}{i}": F.col(f"{v}{i - 1}") for v in "sy" for i in range(1, kept)}
        return {n: out[n] for n in pair_columns(kept)}

    def forget(self, state):
        table = state.table.select(*state.keys, "x", "g")
        kept = len(state.gram) - 2 * state.history
        return replace(state, table=table, history=0, gram=state.gram[-kept:, -kept:])


class OWLQN(LBFGS):
    """L-BFGS for an objective plus ``sum l1(key) |x|`` (Andrew and Gao, 2007).

    ``l1`` is a number or a function from the key columns to a column.
    """

    def __init__(self, memory: int, l1, search: Search | None = None, max_search: int = 10, **common):
        super().__init__(memory, search, max_search=max_search, **common)
        self.l1 = l1
        self.custom_search = search
        self.max_search = max_search

    def weight(self, keys: Sequence[str]) -> Column:
        l1 = self.l1(*[F.col(k) for k in keys]) if callable(self.l1) else F.lit(float(self.l1))
        return F.when(l1 >= 0, l1).otherwise(F.raise_error(F.lit("negative l1 weight")).cast("double"))

    def pseudo(self, keys, x: Column | None = None, g: Column | None = None) -> Column:
        x, g = F.col("x") if x is None else x, F.col("g") if g is None else g
        return E.pseudo_gradient(x, g, self.weight(keys))

    def penalty(self, keys):
        return self.weight(keys) * F.abs("x")

    def gram_columns(self, history):
        return [*pair_columns(history), "pg", "g"]

    def measured(self, table, keys, history):
        return super().measured(table.withColumn("pg", self.pseudo(keys)), keys, history)

    def direction(self, state):
        """Quasi-Newton direction of the pseudo-gradient, kept in its descent orthant."""
        coefficients = two_loop(state.gram[:-1, :-1], state.history)
        columns = [F.col(n) for n in pair_columns(state.history)] + [self.pseudo(state.keys)]
        free = E.lincomb(*zip(coefficients, columns))
        return E.orthant_project(free, -self.pseudo(state.keys))

    def point(self, state, direction, alpha):
        home = E.orthant(F.col("x"), self.pseudo(state.keys))
        return E.orthant_project(F.col("x") + F.lit(alpha) * direction, home)

    def first_step(self, state):
        return self.base_step if state.iteration == 0 else 1.0

    def step(self, state, objective, direction):
        if self.fixed_steps is not None:
            return self.fixed_steps[state.iteration], None, None
        search = self.custom_search or Backtracking(
            shrink=0.1 if state.iteration < 1 else 0.5, max_iter=self.max_search
        )
        line = ProjectedLine(self, objective, state, direction)
        try:
            known = Point(0.0, state.adjusted_value, line.first_slope) if objective.line_starts_at_state() else None
            probes = Probes(line, known, speculate=objective.tries_at_once())
            alpha = search.minimize(probes, self.first_step(state))
        except BaseException:
            line.close()
            raise
        return alpha, line, probes

    def plain_value(self, probed, line):
        return line.plain[probed.alpha]


class ProjectedLine:
    """Penalized value along steps projected onto the orthant of the state.

    A projected point is not linear in the step, so scores at two points say nothing about a third.  Instead the
    steps of a probe are columns of one table and scored in one pass over the features; a step's slope needs its
    gradient, which is pushed back from those scores only where the search asks for it, and is the
    next state's gradient if the step is taken.
    """

    def __init__(self, owner: OWLQN, objective: Objective, state: State, direction: Column):
        self.owner, self.objective, self.keys = owner, objective, list(state.keys)
        home = E.orthant(F.col("x"), owner.pseudo(self.keys))
        xd = state.table.select(*self.keys, "x", "g", direction.alias("d"), home.alias("home"))
        self.xd = xd.persist(StorageLevel.MEMORY_AND_DISK)
        self.weight = owner.weight(self.keys)
        self.plain: dict[float, float] = {}
        self._where: dict[float, tuple] = {}
        self._gradients: dict[float, DataFrame] = {}
        self._open: list = []
        self._first_slope: float | None = None

    def _point(self, alpha: float) -> Column:
        return E.orthant_project(F.col("x") + F.lit(alpha) * F.col("d"), F.col("home"))

    def first_slope(self) -> float:
        """Slope at step 0, from the state's own gradient; the first probe brings it along."""
        if self._first_slope is None:
            self._first_slope = self.xd.agg(self._at_start()).first()[0] or 0.0
        return self._first_slope

    def _at_start(self) -> Column:
        return F.sum(self.owner.pseudo(self.keys) * F.col("d"))

    def probe(self, alphas):
        alphas = [float(a) for a in alphas]
        names = [f"p{n}" for n in range(len(alphas))]
        points = self.xd.select(*self.keys, *[self._point(a).alias(p) for a, p in zip(alphas, names)])
        trials = self.objective.trials(points, names)
        self._open.append(trials)
        first, *penalties = self.xd.agg(self._at_start(), *[F.sum(self.weight * F.abs(self._point(a))) for a in alphas]).first()
        self._first_slope = first or 0.0
        out = []
        for n, (a, value, penalty) in enumerate(zip(alphas, trials.values(), penalties)):
            self.plain[a], self._where[a] = value, (trials, n)
            out.append((value + (penalty or 0.0), lambda a=a: self._slope(a)))
        return out

    def _gradient(self, alpha: float) -> DataFrame:
        if alpha not in self._gradients:
            trials, n = self._where[alpha]
            self._gradients[alpha] = trials.gradient(n).persist(StorageLevel.MEMORY_AND_DISK)
        return self._gradients[alpha]

    def _slope(self, alpha: float) -> float:
        pseudo = E.pseudo_gradient(F.col("v"), F.coalesce("g", F.lit(0.0)), self.weight)
        at = self.xd.select(*self.keys, "d", self._point(alpha).alias("v"))
        return at.join(self._gradient(alpha), self.keys, "left").agg(F.sum(pseudo * F.col("d"))).first()[0] or 0.0

    def finish(self, alpha: float) -> DataFrame:
        """Gradient at the accepted step."""
        return self._gradient(float(alpha))

    def close(self) -> None:
        for gradient in self._gradients.values():
            gradient.unpersist()
        for trials in self._open:
            trials.close()
        self.xd.unpersist()
