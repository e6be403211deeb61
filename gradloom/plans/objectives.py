"""Differentiable functions of a distributed parameter table.

An objective maps a parameter table ``keys, v`` to a number and a gradient
table ``keys, g``.  ``line`` restricts it to ``x + alpha d``: the built-in
models cache what does not depend on alpha, so that any number of steps is
one aggregate without a join.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradloom.functions import losses as L
from gradloom.operators import classes as C
from gradloom.operators import gradients as G
from gradloom.operators import links as K
from gradloom.operators import ranking as R
from gradloom.operators import scoring as S
from gradloom.operators import transport as T
from gradloom.operators.batches import HOLD, NO_HOLD, Batch, BatchCycle
from gradloom.operators.vectors import widen
from gradloom.plans.joins import fits_broadcast
from gradloom.plans.lineage import cut
from gradloom.schemas import in_range, require


class Objective:
    """Base for user objectives: only ``value_grad`` must be given."""

    keys: Sequence[str] = ("idx",)
    # Columns the optimizer's state is placed by; a subset of ``keys``.
    placement: Sequence[str] = ("idx",)
    # Number of coordinates, where known.
    dim: int | None = None

    def extent(self) -> dict[str, int]:
        """Key column -> number of its values, ``[0, n)``, where a start must have every one."""
        return {}

    def value_grad(self, x: DataFrame) -> tuple[float, DataFrame]:
        raise NotImplementedError

    def evaluate(self, x: DataFrame) -> tuple[float, DataFrame]:
        """Like ``value_grad``, but the gradient may leave out coordinates where it is 0."""
        return self.value_grad(x)

    def value(self, x: DataFrame) -> float:
        return self.value_grad(x)[0]

    def gradient(self, x: DataFrame) -> DataFrame:
        return self.value_grad(x)[1]

    def line(self, xd: DataFrame) -> "FullLine":
        """The function along ``keys, x, d``; the default evaluates everything per step."""
        return FullLine(self, xd)

    def tries_at_once(self) -> bool:
        """Whether :meth:`trials` scores its points together, so that more points cost no further pass."""
        return False

    def trials(self, points: DataFrame, names: Sequence[str]) -> "Trials":
        """The function at the points that are the columns ``names`` of ``points``."""
        return Trials(self, points, names)

    def hold(self) -> None:
        """Keep the current batch for a line search."""

    def release(self) -> None:
        """Stop keeping the batch."""

    def line_starts_at_state(self) -> bool:
        """Whether the value at the current state equals the held line at step 0."""
        return True

    def same_data_next(self) -> bool:
        """Whether the next evaluation sees the data the line was built on."""
        return True

    def cursor(self):
        """Where the objective is in its data, in plain numbers; None if that does not change."""
        return None

    def restore(self, cursor) -> None:
        """Go to where ``cursor`` was taken."""

    def tidy(self) -> None:
        """Drop caches of finished evaluations."""


class Trials:
    """Values at several points of one table, and the gradient at any of them; evaluates each by itself."""

    def __init__(self, objective: Objective, points: DataFrame, names: Sequence[str]):
        self.objective, self.points, self.names = objective, points, names
        self._gradients: dict[int, DataFrame] = {}

    def values(self) -> list[float]:
        out = []
        for n, name in enumerate(self.names):
            value, self._gradients[n] = self.objective.evaluate(self.points.select(*self.objective.keys, F.col(name).alias("v")))
            out.append(value)
        return out

    def gradient(self, n: int) -> DataFrame:
        return self._gradients[n]

    def close(self) -> None:
        self.objective.tidy()


class SumTrials(Trials):
    """Points scored together: ``table`` has a row for each example with its scores at every point.

    ``value(n)`` is the column of its loss at point n, ``push(n)`` the gradient from the scores kept.
    """

    def __init__(self, table: DataFrame, count: int, value: Callable[[int], Column], push: Callable[[int], DataFrame], scale: float):
        self.table = table.persist(StorageLevel.MEMORY_AND_DISK)
        self.count, self.value, self.push, self.scale = count, value, push, scale

    def values(self) -> list[float]:
        row = self.table.agg(*[F.sum(self.value(n)).alias(f"v{n}") for n in range(self.count)]).first()
        return [(v or 0.0) * self.scale for v in row]

    def gradient(self, n: int) -> DataFrame:
        return self.push(n)

    def close(self) -> None:
        self.table.unpersist()


class FullLine:
    """Evaluates value and gradient afresh at every step."""

    def __init__(self, objective: Objective, xd: DataFrame, point: Callable[[float], Column] | None = None):
        self.objective, self.xd = objective, xd
        self.point = point or (lambda a: F.col("x") + F.lit(a) * F.col("d"))

    def probe(self, alphas: Sequence[float]) -> list[tuple[float, float]]:
        out = []
        keys = list(self.objective.keys)
        for a in alphas:
            value, grad = self.objective.evaluate(self.xd.select(*keys, self.point(a).alias("v")))
            slope = grad.join(self.xd.select(*keys, "d"), keys).agg(F.sum(F.col("g") * F.col("d"))).first()[0]
            self.objective.tidy()
            out.append((value, slope or 0.0))
        return out

    def finish(self, alpha: float):
        return None

    def close(self) -> None:
        """Nothing is cached."""


class SumLine:
    """A line whose per-row state is cached.

    ``terms(a)`` gives value and slope columns at a step.  ``stage(table, tag,
    a)`` may first add columns for a step, whose names end in the tag.
    """

    def __init__(self, table: DataFrame, terms: Callable, scale: float, finish=None, stage: Callable | None = None):
        self.table = table.persist(StorageLevel.MEMORY_AND_DISK)
        self.terms, self.scale = terms, scale
        self._finish = finish
        self._stage = stage

    def probe(self, alphas: Sequence[float]) -> list[tuple[float, float]]:
        sums, table = [], self.table
        for n, a in enumerate(alphas):
            if self._stage:
                table = self._stage(table, f"_{n}", float(a))
                value, slope = self.terms(f"_{n}")
            else:
                value, slope = self.terms(float(a))
            sums += [F.sum(value).alias(f"v{n}"), F.sum(slope).alias(f"s{n}")]
        row = table.agg(*sums).first()
        return [((row[f"v{n}"] or 0.0) * self.scale, (row[f"s{n}"] or 0.0) * self.scale) for n in range(len(alphas))]

    def finish(self, alpha: float):
        """Loss table at the accepted step, from the cached scores."""
        return self._finish(alpha) if self._finish else None

    def close(self) -> None:
        self.table.unpersist()


class BatchObjective(Objective):
    """Shared batch handling of the example-based models."""

    def __init__(self, cycle: BatchCycle, dim: int):
        self.cycle, self.dim = cycle, dim
        cycle.reads(dim)
        self._cached: list[DataFrame] = []

    def extent(self) -> dict[str, int]:
        sizes = {"idx": self.dim, "k": getattr(self, "row_dim", None)}
        return {} if self.dim is None else {k: sizes[k] for k in self.keys}

    def hold(self) -> None:
        self.cycle.hold()

    def release(self) -> None:
        self.cycle.release()

    def cursor(self):
        return self.cycle.cursor()

    def restore(self, cursor) -> None:
        self.cycle.restore(cursor)

    def line_starts_at_state(self) -> bool:
        return self.cycle.num_batches == 1 or self.cycle.policy == "hold"

    def same_data_next(self) -> bool:
        return self.cycle.num_batches == 1

    def _keep(self, df: DataFrame) -> DataFrame:
        df = df.persist(StorageLevel.MEMORY_AND_DISK)
        self._cached.append(df)
        return df

    def tidy(self) -> None:
        for df in self._cached:
            df.unpersist()
        self._cached = []

    def moving(self) -> bool:
        """Whether each evaluation takes another batch."""
        return self.cycle.num_batches > 1 and (self.cycle.policy == NO_HOLD or not self.cycle.holding)

    def line(self, xd: DataFrame):
        return FullLine(self, xd) if self.moving() else self.held_line(self.cycle.current, xd)

    def tries_at_once(self) -> bool:
        return type(self).held_trials is not BatchObjective.held_trials and not self.moving()

    def trials(self, points: DataFrame, names: Sequence[str]) -> Trials:
        return self.held_trials(self.cycle.current, points, names) if self.tries_at_once() else Trials(self, points, names)

    def held_trials(self, batch: Batch, points: DataFrame, names: Sequence[str]) -> Trials:
        raise NotImplementedError

    def losses(self, batch: Batch, x: DataFrame) -> DataFrame:
        raise NotImplementedError

    def gradient_of(self, batch: Batch, losses: DataFrame, x: DataFrame) -> DataFrame:
        raise NotImplementedError

    def held_line(self, batch: Batch, xd: DataFrame):
        raise NotImplementedError

    def value_grad(self, x: DataFrame) -> tuple[float, DataFrame]:
        value, grad = self.evaluate(x)
        return value, G.fill_gradient(x, grad, self.keys)

    def evaluate(self, x: DataFrame) -> tuple[float, DataFrame]:
        batch = self.cycle.next()
        losses = self._keep(self.losses(batch, x))
        value = G.forward(losses).first()["loss"]
        return value, self.gradient_of(batch, losses, x)

    def value(self, x: DataFrame) -> float:
        return G.forward(self.losses(self.cycle.next(), x)).first()["loss"]


class LinearModel(BatchObjective):
    """Average point loss of a sparse linear score; parameters ``idx, v``."""

    def __init__(self, cycle: BatchCycle, dim: int, loss: L.PointLoss):
        super().__init__(cycle, dim)
        self.loss = loss

    def losses(self, batch, x):
        scores = S.score_linear(batch.for_scoring(self.dim), x, self.dim)
        return G.point_losses(batch.targets, scores, self.loss)

    def gradient_of(self, batch, losses, x):
        grad = G.push_back(batch.by_example, losses, ["dscore"])
        return grad.select("idx", (F.col("dscore") / F.lit(batch.total_weight)).alias("g"))

    def held_line(self, batch, xd):
        features = batch.for_scoring(self.dim)
        sums = S.weighted_sums(features, xd, ["x", "d"], ["s0", "sd"], ["ex_id"], self.dim)
        table = S.with_all(batch.targets, sums, ["s0", "sd"])

        def terms(a):
            args = F.col("s0") + F.lit(a) * F.col("sd"), F.col("label"), F.col("weight")
            return self.loss.value(*args), self.loss.slope(*args) * F.col("sd")

        def finish(a):
            args = F.col("s0") + F.lit(a) * F.col("sd"), F.col("label"), F.col("weight")
            losses = table.select("ex_id", self.loss.slope(*args).alias("dscore"))
            return self.gradient_of(batch, losses, xd)

        return SumLine(table, terms, 1.0 / batch.total_weight, finish)

    def held_trials(self, batch, points, names):
        scores = [f"score_{n}" for n in range(len(names))]
        sums = S.weighted_sums(batch.for_scoring(self.dim), points, names, scores, ["ex_id"], self.dim)
        trials_of = S.with_all(batch.targets, sums, scores)
        args = [(F.col(s), F.col("label"), F.col("weight")) for s in scores]

        def push(n):
            return self.gradient_of(batch, trials.table.select("ex_id", self.loss.slope(*args[n]).alias("dscore")), points)

        trials = SumTrials(trials_of, len(names), lambda n: self.loss.value(*args[n]), push, 1.0 / batch.total_weight)
        return trials


def linear_l2(cycle: BatchCycle, dim: int) -> LinearModel:
    return LinearModel(cycle, dim, L.SQUARED)


def linear_binlog(cycle: BatchCycle, dim: int) -> LinearModel:
    return LinearModel(cycle, dim, L.LOGISTIC)


def linear_quantile(cycle: BatchCycle, dim: int, q: float) -> LinearModel:
    return LinearModel(cycle, dim, L.quantile(q))


class SoftmaxModel(BatchObjective):
    """Multi-label softmax over ``row_dim`` classes; parameters ``idx, k, v``.

    The cycle's targets are wide (see ``gradients.wide_targets``).
    """

    keys = ("idx", "k")

    def __init__(self, cycle: BatchCycle, dim: int, row_dim: int):
        super().__init__(cycle, dim)
        self.row_dim = row_dim

    def losses(self, batch, x):
        scores = S.score_linear_multi(batch.for_scoring(self.dim), x, self.row_dim, self.dim)
        return G.multilabel_losses(batch.targets, scores, self.row_dim)

    def gradient_of(self, batch, losses, x):
        return G.backward_matrix(batch.by_example, losses, self.row_dim, batch.total_weight)

    def held_line(self, batch, xd):
        rng = range(self.row_dim)
        x, d = (widen(xd.select("idx", "k", F.col(c).alias("v")), self.row_dim, c) for c in ("x", "d"))
        names = [f"s{i}" for i in rng] + [f"t{i}" for i in rng]
        cols = [f"x{i}" for i in rng] + [f"d{i}" for i in rng]
        sums = S.weighted_sums(batch.for_scoring(self.dim), x.join(d, "idx"), cols, names, ["ex_id"], self.dim)
        targets = batch.targets.withColumnsRenamed({f"t{i}": f"y{i}" for i in rng})
        table = S.with_all(targets, sums, names)

        labels = [f"y{i}" for i in rng]

        def stage(df, tag, a):
            probs = [f"p{i}{tag}" for i in rng]
            df = L.with_softmax(df, [F.col(f"s{i}") + F.lit(a) * F.col(f"t{i}") for i in rng], probs)
            return L.with_pull(df, probs, labels, f"pull{tag}")

        def slopes(tag):
            return L.multilabel_slopes([f"p{i}{tag}" for i in rng], labels, f"pull{tag}", F.col("weight"))

        def terms(tag):
            along = [g * F.col(f"t{i}") for i, g in enumerate(slopes(tag))]
            return L.multilabel_value([f"p{i}{tag}" for i in rng], labels, F.col("weight")), sum(along[1:], along[0])

        def finish(a):
            staged = stage(table, "_at", a)
            losses = staged.select("ex_id", *[g.alias(f"dscore{i}") for i, g in enumerate(slopes("_at"))])
            return self.gradient_of(batch, losses, xd)

        return SumLine(table, terms, 1.0 / batch.total_weight, finish, stage)

    def held_trials(self, batch, points, names):
        rng, steps = range(self.row_dim), range(len(names))
        # One pass over the points: a column for each of them and each class.
        cells = [
            F.coalesce(F.max(F.when(F.col("k") == i, F.col(name))), F.lit(0.0)).alias(f"x{n}_{i}")
            for n, name in enumerate(names) for i in rng
        ]
        wide = points.groupBy("idx").agg(*cells)
        scores = [f"s{n}_{i}" for n in steps for i in rng]
        sums = S.weighted_sums(batch.for_scoring(self.dim), wide, [f"x{n}_{i}" for n in steps for i in rng], scores, ["ex_id"], self.dim)
        labels = [f"t{i}" for i in rng]
        table = S.with_all(batch.targets, sums, scores)
        for n in steps:
            probs = [f"p{n}_{i}" for i in rng]
            table = L.with_pull(L.with_softmax(table, [F.col(f"s{n}_{i}") for i in rng], probs), probs, labels, f"pull{n}")
        kept = table.select("ex_id", "weight", *labels, *[f"p{n}_{i}" for n in steps for i in rng], *[f"pull{n}" for n in steps])

        def value(n):
            return L.multilabel_value([f"p{n}_{i}" for i in rng], labels, F.col("weight"))

        def push(n):
            slopes = L.multilabel_slopes([f"p{n}_{i}" for i in rng], labels, f"pull{n}", F.col("weight"))
            return self.gradient_of(batch, trials.table.select("ex_id", *[g.alias(f"dscore{i}") for i, g in enumerate(slopes)]), points)

        trials = SumTrials(kept, len(names), value, push, 1.0 / batch.total_weight)
        return trials


def linear_softmax(cycle: BatchCycle, dim: int, row_dim: int) -> SoftmaxModel:
    return SoftmaxModel(cycle, dim, row_dim)


class LongSoftmax(BatchObjective):
    """Multi-label softmax for any number of classes; parameters ``idx, k, v``, dense.

    Parameters that may be broadcast go to the examples, whose cells are made and summed in one pass and never
    kept.  Beyond that no column and no broadcast grows with the classes: scores are rows ``ex_id, k``, and an
    example's sum of exponentials is its largest score and a scaled sum.  The cycle's targets are long (``ex_id, cls, tw,
    weight``); an example's are a map, which comes to its scores where they lie.  Repeated targets add up, an
    example without features scores 0 in every class, and a class outside ``[0, row_dim)`` fails.
    """

    keys = ("idx", "k")

    def __init__(self, cycle: BatchCycle, dim: int, row_dim: int):
        super().__init__(cycle, dim)
        self.row_dim = row_dim
        self._weights: dict[int, float] = {}
        self._packed: tuple[Batch, DataFrame] | None = None

    def _in_place(self) -> bool:
        """Whether the parameters, ``dim`` by ``row_dim``, go to the examples."""
        return fits_broadcast(self.dim * self.row_dim)

    def _examples(self, batch: Batch) -> DataFrame:
        """Packed examples of the current batch."""
        if self._packed is None or self._packed[0] is not batch:
            if self._packed is not None:
                self._packed[1].unpersist()
            rows = C.packed_examples(batch.load().by_example.plain, self._targets(batch))
            self._packed = batch, rows.persist(StorageLevel.MEMORY_AND_DISK)
        return self._packed[1]

    def _pushed(self, batch: Batch, sums: DataFrame) -> DataFrame:
        return C.gradient(sums).withColumn("g", F.col("g") / F.lit(self._total(batch)))

    def _targets(self, batch: Batch) -> DataFrame:
        """``ex_id, weight, ts``: the target weights of an example by class."""
        known = require(batch.targets, (in_range(F.col("cls"), self.row_dim), "target class outside [0, row_dim)"), (F.col("tw").isNotNull(), "null target weight"))
        per_class = known.groupBy("ex_id", "cls").agg(F.sum("tw").alias("tw"), F.max("weight").alias("weight"))
        entries = F.map_from_entries(F.collect_list(F.struct("cls", "tw")))
        return per_class.groupBy("ex_id").agg(F.max("weight").alias("weight"), entries.alias("ts"))

    def _total(self, batch: Batch) -> float:
        if batch.number not in self._weights:
            self._weights[batch.number] = batch.load().targets.groupBy("ex_id").agg(F.max("weight").alias("weight")).agg(F.sum("weight")).first()[0] or 0.0
        return self._weights[batch.number]

    def _cells(self, batch: Batch, x: DataFrame, columns: Sequence[str], names: Sequence[str]) -> DataFrame:
        """``ex_id, weight, ts, k`` and a score per weight column; one row without k where an example has no feature."""
        entries = self.dim * self.row_dim  # decides on the broadcast: rows of the parameter table, not coordinates
        scores = S.weighted_sums(batch.for_scoring(entries), x, columns, names, ["ex_id", "k"], entries)
        return self._targets(batch).join(scores, "ex_id", "left")

    def _stage(self, df: DataFrame, tag: str, score: Column) -> DataFrame:
        """Add probability, target and slope of each cell, and its part of the loss."""
        example = Window.partitionBy("ex_id")
        top, total, p, part, pull = (f"{n}{tag}" for n in ("top", "total", "p", "part", "pull"))
        df = df.withColumn(p, score).withColumn(top, F.max(p).over(example)).withColumn(p, F.exp(F.col(p) - F.col(top)))
        df = df.withColumn(total, F.sum(p).over(example))
        # An example without features has one row, and 1 / row_dim in each class.
        blank = F.col("k").isNull()
        df = df.withColumn(p, F.when(blank, F.lit(1.0 / self.row_dim)).otherwise(F.col(p) / F.col(total)))
        given = F.aggregate(F.map_values("ts"), F.lit(0.0), lambda acc, t: acc + t)
        df = df.withColumn("t", F.when(blank, given).otherwise(F.coalesce(F.try_element_at("ts", F.col("k")), F.lit(0.0))))
        df = df.withColumn(part, F.col("t") * F.col(p) / (F.col(p) + F.lit(L.GUARD))).withColumn(pull, F.sum(part).over(example))
        slope = F.col("weight") * (F.col(p) * F.col(pull) - F.col(part))
        loss = -F.col("weight") * F.col("t") * F.log(F.col(p) + F.lit(L.GUARD))
        return df.withColumns({f"loss{tag}": loss, f"dscore{tag}": slope}).drop(top, total, p, part, pull, "t")

    def losses(self, batch, x):
        cells = self._cells(batch, x, ["v"], ["s"])
        return self._stage(cells, "", F.coalesce("s", F.lit(0.0))).select("ex_id", "k", "loss", "dscore")

    def value(self, x):
        batch = self.cycle.next()
        if self._in_place():
            return C.totals(C.softmax_sums(self._examples(batch), C.dense(x, ["v"], self.dim, self.row_dim)))[0] / self._total(batch)
        return (self.losses(batch, x).agg(F.sum("loss")).first()[0] or 0.0) / self._total(batch)

    def evaluate(self, x):
        batch = self.cycle.next()
        if self._in_place():
            sums = self._keep(C.softmax_sums(self._examples(batch), C.dense(x, ["v"], self.dim, self.row_dim), gradient=True))
            return C.totals(sums)[0] / self._total(batch), self._pushed(batch, sums)
        losses = self._keep(self.losses(batch, x))
        return (losses.agg(F.sum("loss")).first()[0] or 0.0) / self._total(batch), self.gradient_of(batch, losses, x)

    def gradient_of(self, batch, losses, x):
        slopes = losses.where(F.col("k").isNotNull()).select("ex_id", "k", "dscore")
        pushed = batch.by_example.join(slopes).groupBy(F.col("fea_id").alias("idx"), "k").agg(F.sum(F.col("value") * F.col("dscore")).alias("g"))
        return pushed.withColumn("g", F.col("g") / F.lit(self._total(batch)))

    def held_line(self, batch, xd):
        if self._in_place():
            return ClassLine(self, batch, xd)
        cells = self._cells(batch, xd, ["x", "d"], ["s", "sd"]).na.fill(0.0, ["s", "sd"])

        def stage(df, tag, a):
            return self._stage(df, tag, F.col("s") + F.lit(a) * F.col("sd"))

        def finish(a):
            return self.gradient_of(batch, stage(cells, "", a), xd)

        return SumLine(cells, lambda tag: (F.col(f"loss{tag}"), F.col(f"dscore{tag}") * F.col("sd")), 1.0 / self._total(batch), finish, stage)


class ClassLine:
    """A line of :class:`LongSoftmax` whose examples are scored again in each probe, since cells are too many to keep."""

    def __init__(self, model: LongSoftmax, batch: Batch, xd: DataFrame):
        self.model, self.batch = model, batch
        self.examples = model._examples(batch)
        self.matrices = C.dense(xd, ["x", "d"], model.dim, model.row_dim)

    def probe(self, alphas: Sequence[float]) -> list[tuple[float, float]]:
        weight = self.model._total(self.batch)
        found = C.totals(C.softmax_sums(self.examples, self.matrices, [float(a) for a in alphas]))
        return [(found[2 * n] / weight, found[2 * n + 1] / weight) for n in range(len(alphas))]

    def finish(self, alpha: float):
        return self.model._pushed(self.batch, C.softmax_sums(self.examples, self.matrices, [float(alpha)], gradient=True))

    def close(self) -> None:
        """The examples are the model's."""


def linear_softmax_long(cycle: BatchCycle, dim: int, row_dim: int) -> LongSoftmax:
    return LongSoftmax(cycle, dim, row_dim)


class PairRanking(BatchObjective):
    """Sampled pairwise ranking with a factorization machine; parameters ``idx, k, v``.

    The cycle's targets are positives (``link_id, ex_id, item, weight,
    rel_weight``); ``sample`` makes negatives of a batch of positives and
    ``featurize`` turns keyed examples of either kind into feature rows.
    Negatives of all rounds are scored in one query; ``evaluate_rounds`` keeps
    one round at a time instead.

    With ``fresh``, ``sample`` sees the cycle's ``epoch`` as a column, and each
    epoch has negatives of its own, drawn again only when the cycle moves on:
    a line search that holds its batch holds its negatives too.
    """

    keys = ("idx", "k")

    def __init__(
        self,
        positives: BatchCycle,
        dim: int,
        row_dim: int,
        sample: Callable[[DataFrame], DataFrame],
        featurize: Callable[[DataFrame], DataFrame],
        fresh: bool = False,
    ):
        super().__init__(positives, dim)
        self.row_dim, self.fresh = row_dim, fresh
        self.sample, self.featurize = sample, featurize
        self._sampled: tuple[tuple[int, int], RankedLinks] | None = None
        self._sent: list = []

    def tidy(self) -> None:
        super().tidy()
        while self._sent:
            self._sent.pop().unpersist()

    def _matrix(self, x: DataFrame, column: str = "v"):
        """The parameters for tasks, kept until this evaluation is over."""
        self._sent.append(K.matrix(x, column, self.dim, self.row_dim))
        return self._sent[-1]

    def _links_of(self, positives: Batch) -> "RankedLinks":
        """The positive batch by link and its negatives, kept while current."""
        drawn = positives.number, self.cycle.epoch if self.fresh else 0
        if self._sampled is not None and self._sampled[0] == drawn:
            return self._sampled[1].load()
        if self._sampled is not None:
            self._sampled[1].release()
        self._sampled = drawn, RankedLinks(self, positives).load()
        return self._sampled[1]

    def negatives(self, positives: DataFrame) -> DataFrame:
        if not self.fresh:
            return self.sample(positives)
        if "epoch" in positives.columns:
            raise ValueError("positives have a column epoch, which the sampler is to be given")
        return self.sample(positives.withColumn("epoch", F.lit(self.cycle.epoch).cast("bigint"))).drop("epoch")

    def line_starts_at_state(self) -> bool:
        return self.cycle.policy == HOLD if self.fresh else super().line_starts_at_state()

    def same_data_next(self) -> bool:
        return not self.fresh and super().same_data_next()

    def line(self, xd):
        if self.fresh and (self.cycle.policy == NO_HOLD or not self.cycle.holding):
            return FullLine(self, xd)
        return super().line(xd)

    def evaluate_rounds(self, x: DataFrame, rounds: int) -> tuple[float, DataFrame]:
        """Like ``evaluate``, with the negatives of one round cached at a time.

        A round adds its losses, weights and slopes to running sums; those of the gradient are a table as
        large as the parameters.  The positives are scored again in every round.
        """
        links = self._links_of(self.cycle.next())
        loss = weight = 0.0
        running = None
        for number in range(rounds):
            batch = links.batch(F.col("iter") == number).load()
            part, share, grad = self._pushed(links, batch.targets, x)
            loss, weight = loss + part, weight + share
            # Written, so that the round's rows can go.
            running = cut(grad if running is None else running.unionByName(grad).groupBy("idx", "k").agg(F.sum("g").alias("g")))
            self.tidy()
            batch.release()
        if not weight:
            raise ValueError("no pair has a weight")
        return loss / weight, running.withColumn("g", F.col("g") / F.lit(weight))

    def _pushed(self, links: "RankedLinks", examples: DataFrame, x: DataFrame) -> tuple[float, float, DataFrame]:
        if links.whole:
            sums = K.link_sums(links.packed(examples), self._matrix(x), self.row_dim, gradient=True)
            sums = self._keep(sums.groupBy("idx").agg(*[F.sum(c).alias(c) for c in sums.columns[1:]]))
            found = {r["idx"]: r["a0"] for r in sums.where("idx < 0").collect()}
            return found.get(-2) or 0.0, found.get(-1) or 0.0, R.gradient_cells(sums, x, self.row_dim)
        pos, neg = (links.scored(part, x, entries=True) for part in links.ends(examples))
        loss, weight, grad, sums = R.ranking_gradient(pos, neg, x, self.row_dim, links.hot)
        self._cached.append(sums)
        return loss, weight, grad

    def value(self, x: DataFrame) -> float:
        links = self._links_of(self.cycle.next())
        if links.whole:
            found, weight = link_totals(K.link_sums(links.packed(), self._matrix(x), self.row_dim))
            return found[0][0] / weight if weight else None
        pos, neg = (links.scored(part, x) for part in links.ends())
        return G.forward(R.pair_losses(pos, neg, links.hot)).first()["loss"]

    def evaluate(self, x: DataFrame) -> tuple[float, DataFrame]:
        links = self._links_of(self.cycle.next())
        loss, weight, grad = self._pushed(links, links.examples, x)
        return loss / weight if weight else None, grad.withColumn("g", F.col("g") / F.lit(weight))

    def held_line(self, batch, xd):
        """Scores are quadratic in the step: three coefficients per example."""
        links = self._links_of(batch)
        if links.whole:
            return LinkLine(self, links, xd)
        rng = range(self.row_dim)
        x, d = (widen(xd.select("idx", "k", F.col(c).alias("v")), self.row_dim, c) for c in ("x", "d"))
        z = F.col("value")

        def squares(a, b):
            return sum((F.col(f"{a}{i}") * F.col(f"{b}{i}") for i in rng), F.lit(0.0))

        sums = {f"s{i}": z * F.col(f"x{i}") for i in rng} | {f"t{i}": z * F.col(f"d{i}") for i in rng}
        sums |= {f"q_{ab}": z * z * squares(*ab) for ab in ("xx", "xd", "dd")}
        half = F.lit(0.5)
        quadratic = {
            "c0": half * (squares("s", "s") - F.col("q_xx")),
            "c1": squares("s", "t") - F.col("q_xd"),
            "c2": half * (squares("t", "t") - F.col("q_dd")),
        }
        names = list(quadratic)
        both = x.join(d, "idx")
        pos, neg = (links.sums(part, both, sums).withColumns(quadratic) for part in links.ends())
        pairs = R.pair_up(pos, neg, [*names, "weight", "rel_weight"], links.hot)
        # A pair's loss depends on the difference of its scores: as little of a pair is kept as a step needs.
        weight = F.col("pos_weight") * F.col("neg_rel_weight")
        pairs = pairs.select(*[(F.col(f"pos_{n}") - F.col(f"neg_{n}")).alias(n) for n in names], weight.alias("weight"))

        def terms(a):
            gap = F.col("c0") + F.lit(a) * F.col("c1") + F.lit(a * a) * F.col("c2"), F.lit(0.0), F.col("weight")
            along = F.col("c1") + F.lit(2.0 * a) * F.col("c2")
            return L.pair_value(*gap), L.pair_slope(*gap) * along

        line = SumLine(pairs, terms, 1.0)
        line.scale = 1.0 / line.table.agg(F.sum("weight")).first()[0]
        return line


def link_totals(sums: DataFrame) -> tuple[list[tuple[float, float]], float]:
    """(loss, slope) of every step, and the weight of all pairs."""
    rows = {r["idx"]: (r["loss"], r["slope"]) for r in sums.where("idx < 0").groupBy("idx").agg(F.sum("a0").alias("loss"), F.sum("c").alias("slope")).collect()}
    return [rows[-2 - n] for n in range(len(rows) - 1)], rows[-1][0] if rows else 0.0


class LinkLine:
    """A line of :class:`PairRanking` whose links are scored again in each probe, since pairs are too many to keep."""

    def __init__(self, model: PairRanking, links: "RankedLinks", xd: DataFrame):
        self.model, self.links = model, links
        self.matrices = [K.matrix(xd, c, model.dim, model.row_dim) for c in ("x", "d")]

    def probe(self, alphas: Sequence[float]) -> list[tuple[float, float]]:
        point, direction = self.matrices
        found, weight = link_totals(K.link_sums(self.links.packed(), point, self.model.row_dim, direction, [float(a) for a in alphas]))
        return [(loss / weight, slope / weight) for loss, slope in found]

    def finish(self, alpha: float):
        return None

    def close(self) -> None:
        for sent in self.matrices:
            sent.unpersist()


class RankedLinks:
    """A batch of positives placed by link, and what follows from them: negatives, features, scores.

    Only the positives are cached; the rest is made where they lie.  Where links have very different
    numbers of negatives (``hot``), their negatives are dealt out by example instead.
    """

    def __init__(self, model: PairRanking, positives: Batch):
        self.model, self.number = model, positives.number
        self._source, self._placed = positives, None

    def load(self) -> "RankedLinks":
        if self._placed is not None:
            return self
        model, whole = self.model, self._source.load().targets
        drawn = model.negatives(whole)
        if "weight" in drawn.columns:
            drawn = require(drawn, (F.col("weight").isNotNull(), "null weight in a batch"))
        self.hot = R.hot_links(drawn)
        links, negatives = whole.count(), drawn.count()
        self._placed = R.place_positives(R.one_per_link(whole), 1 + -(-negatives // max(links, 1)))
        self.parts = self._placed.rdd.getNumPartitions()
        spread = self.parts, *R.RANK_KEYS
        negatives = model.negatives(self._placed)
        self.examples = R.as_positives(self._placed).unionByName(negatives.repartition(*spread) if self.hot else negatives)
        small = fits_broadcast(model.dim)
        # Links that a row can hold, and parameters that a task can: then nothing of an example moves.
        self.whole = not small and not self.hot and K.fits_task(model.dim, model.row_dim)
        self.hot_features = [] if small or self.whole else R.hot_features(model.featurize(negatives))
        return self

    def packed(self, examples: DataFrame | None = None) -> DataFrame:
        """Whole links with their examples and features."""
        examples = self.load().examples if examples is None else examples
        return K.packed_links(examples, self.model.featurize(examples), self.model.dim)

    def batch(self, chosen: Column) -> Batch:
        """The positives with a part of the negatives."""
        examples = self.load().examples.filter((F.col("iter") < 0) | chosen)
        return Batch(examples, None, self.number, R.RANK_KEYS, self.model.dim, placed=True)

    def ends(self, examples: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        """Positives and negatives."""
        examples = self.load().examples if examples is None else examples
        return examples.filter(F.col("iter") < 0), examples.filter(F.col("iter") >= 0)

    def sums(self, examples: DataFrame, weights: DataFrame, sums: dict[str, Column]) -> DataFrame:
        features = self.model.featurize(examples)
        return R.example_sums(examples, features, weights, sums, ["weight", "rel_weight"], self.model.dim, hot=self.hot_features, parts=self.parts)

    def scored(self, examples: DataFrame, x: DataFrame, entries: bool = False) -> DataFrame:
        model = self.model
        return R.score_ranked(examples, model.featurize(examples), x, model.row_dim, model.dim, entries=entries, hot=self.hot_features, parts=self.parts)

    def release(self) -> None:
        if self._placed is not None:
            self._placed.unpersist()
            self._placed = None


def fm_pair_ranking(positives, dim, row_dim, sample, featurize, fresh=False) -> PairRanking:
    return PairRanking(positives, dim, row_dim, sample, featurize, fresh)


class TransportDual(Objective):
    """Negative entropic dual of optimal transport, to be minimized over ``side, idx, v``.

    With ``log`` its entropy term is ``eps`` times the logarithm of the total mass (plus 1 at the
    optimum, where both forms have the same potentials up to a constant): its gradient compares
    shares of the mass, which stay meaningful where the mass itself is 0 or infinite in doubles,
    as it is far from the optimum for small ``eps``.
    """

    keys = ("side", "idx")
    placement = ("side", "idx")

    def __init__(self, pair: T.PointPair, eps: float, log: bool = False):
        self.pair, self.eps, self.log = pair, eps, log
        self._cached: list[DataFrame] = []

    def zero_potentials(self) -> DataFrame:
        u = self.pair.x.select(F.lit("u").alias("side"), F.col("id").alias("idx"))
        v = self.pair.y.select(F.lit("v").alias("side"), F.col("id").alias("idx"))
        return u.unionByName(v).withColumn("v", F.lit(0.0))

    def share(self) -> Column:
        return F.when(F.col("side") == "u", F.lit(1.0 / self.pair.n)).otherwise(F.lit(1.0 / self.pair.m))

    def entropy(self, total: float) -> float:
        """The entropy term from the logarithm of the total mass."""
        if self.log:
            return self.eps * total
        return self.eps * (math.exp(total) if total < 709 else math.inf)

    def gradient(self, sums: DataFrame, total: float) -> DataFrame:
        mass = F.exp(F.col("lse") - F.lit(total if self.log else 0.0))
        return sums.select("side", "idx", (mass - self.share()).alias("g"))

    def value_grad(self, x):
        sums = T.ot_log_sums(self.pair, x.withColumnRenamed("v", "p"), self.eps).persist(StorageLevel.MEMORY_AND_DISK)
        self._cached.append(sums)
        bucket, e = T.in_bucket("lse")
        ours = F.col("side") == "u"
        rows = sums.groupBy(bucket.alias("bucket")).agg(F.sum(F.when(ours, e)).alias("e"), F.sum(F.col("x") * self.share()).alias("mean")).collect()
        total = T.log_total(rows)
        value = self.entropy(total) - sum(r["mean"] or 0.0 for r in rows)
        grad = x.select("side", "idx").join(self.gradient(sums, total), ["side", "idx"], "left")
        return value, grad.select("side", "idx", F.coalesce("g", -self.share()).alias("g"))

    def line(self, xd):
        return TransportLine(self, xd)

    def tidy(self):
        for df in self._cached:
            df.unpersist()
        self._cached = []


class TransportLine:
    """One pass over the tiles for a group of steps; the first step's gradient comes with it.

    The pass leaves that step's sum at every point, which is the gradient, and the slope is its
    product with the direction.  So a step that is taken at once costs no other pass.
    """

    def __init__(self, dual: TransportDual, xd: DataFrame):
        self.dual, self.xd = dual, xd
        self._at: tuple[float, DataFrame, float] | None = None

    def probe(self, alphas):
        dual, alphas = self.dual, [float(a) for a in alphas]
        self.close()
        sums = T.ot_log_sums(dual.pair, self.xd, dual.eps, "x", "d", alphas).persist(StorageLevel.MEMORY_AND_DISK)
        bucket, e = T.in_bucket("lse")
        counted = F.col("side").isNull() | (F.col("side") == "u")
        slope = F.when(F.col("side").isNull(), F.col("ds") * dual.eps).otherwise(F.col("d")) * e
        rows = sums.groupBy("n", bucket.alias("bucket")).agg(
            F.sum(F.when(counted, e)).alias("e"),
            F.sum(slope).alias("slope"),
            F.sum(F.col("x") * dual.share()).alias("mean"),
            F.sum(F.col("d") * dual.share()).alias("rise"),
        ).collect()
        # Only step 0 has rows of points, and with them the means.
        mean, rise = (sum(r[c] or 0.0 for r in rows if r["n"] == 0) for c in ("mean", "rise"))
        out = []
        for n, a in enumerate(alphas):
            mine = [r for r in rows if r["n"] == n]
            total = T.log_total(mine)
            if n == 0:
                self._at = a, sums, total
            base = total if dual.log else 0.0
            with np.errstate(over="ignore", invalid="ignore"):
                # A value of inf rejects the step, whatever its slope is then.
                slope = sum(float(r["slope"] * np.exp(T.WIDTH * r["bucket"] - base)) for r in mine if r["slope"])
            out.append((dual.entropy(total) - mean - a * rise, slope - rise))
        return out

    def finish(self, alpha):
        if self._at is None or self._at[0] != alpha:
            return None
        _, sums, total = self._at
        return self.dual.gradient(sums.where("n = 0"), total)

    def close(self):
        if self._at is not None:
            self._at[1].unpersist()
            self.dual.pair.end_passes()
        self._at = None


class L2Penalty(Objective):
    """Half the squared norm."""

    def __init__(self, keys: Sequence[str] = ("idx",)):
        self.keys = keys

    def value_grad(self, x):
        total = x.agg(F.sum(F.col("v") * F.col("v"))).first()[0] or 0.0
        return 0.5 * total, x.select(*self.keys, F.col("v").alias("g"))

    def line(self, xd):
        x, d = F.col("x"), F.col("d")
        return SumLine(xd, lambda a: (F.lit(0.5) * (x + F.lit(a) * d) ** 2, (x + F.lit(a) * d) * d), 1.0)

    def tries_at_once(self):
        return True

    def trials(self, points, names):
        return PointTrials(points, self.keys, names, lambda v: F.lit(0.5) * v * v, lambda v: v)


class L1Penalty(Objective):
    """Sum of absolute values, with the sign as its (sub)gradient."""

    def __init__(self, keys: Sequence[str] = ("idx",)):
        self.keys = keys

    def value_grad(self, x):
        total = x.agg(F.sum(F.abs("v"))).first()[0] or 0.0
        return total, x.select(*self.keys, F.signum("v").alias("g"))

    def line(self, xd):
        x, d = F.col("x"), F.col("d")
        return SumLine(xd, lambda a: (F.abs(x + F.lit(a) * d), F.signum(x + F.lit(a) * d) * d), 1.0)

    def tries_at_once(self):
        return True

    def trials(self, points, names):
        return PointTrials(points, self.keys, names, F.abs, F.signum)


class PointTrials(Trials):
    """A sum over coordinates at several points; nothing is kept, since the points are."""

    def __init__(self, points: DataFrame, keys: Sequence[str], names: Sequence[str], value: Callable[[Column], Column], slope: Callable[[Column], Column]):
        self.points, self.keys, self.names, self.value, self.slope = points, keys, names, value, slope

    def values(self):
        row = self.points.agg(*[F.sum(self.value(F.col(c))).alias(f"v{n}") for n, c in enumerate(self.names)]).first()
        return [v or 0.0 for v in row]

    def gradient(self, n):
        return self.points.select(*self.keys, self.slope(F.col(self.names[n])).alias("g"))

    def close(self) -> None:
        """Nothing is cached."""


class Combined(Objective):
    """a1 * f1 + a2 * f2."""

    def __init__(self, a1: float, f1: Objective, a2: float, f2: Objective):
        if tuple(f1.keys) != tuple(f2.keys):
            raise ValueError("objectives of different parameter tables")
        self.parts = [(float(a1), f1), (float(a2), f2)]
        self.keys, self.placement, self.dim = f1.keys, f1.placement, f1.dim

    def value_grad(self, x):
        (a1, (v1, g1)), (a2, (v2, g2)) = ((a, f.value_grad(x)) for a, f in self.parts)
        return a1 * v1 + a2 * v2, self._add(g1, g2)

    def _add(self, g1, g2):
        (a1, _), (a2, _) = self.parts
        keys = list(self.keys)
        both = g1.withColumnRenamed("g", "g1").join(g2.withColumnRenamed("g", "g2"), keys, "full")
        total = F.lit(a1) * F.coalesce("g1", F.lit(0.0)) + F.lit(a2) * F.coalesce("g2", F.lit(0.0))
        return both.select(*keys, total.alias("g"))

    def evaluate(self, x):
        (a1, (v1, g1)), (a2, (v2, g2)) = ((a, f.evaluate(x)) for a, f in self.parts)
        return a1 * v1 + a2 * v2, self._add(g1, g2)

    def value(self, x):
        return sum(a * f.value(x) for a, f in self.parts)

    def line(self, xd):
        return CombinedLine([(a, f.line(xd)) for a, f in self.parts])

    def tries_at_once(self):
        return all(f.tries_at_once() for _, f in self.parts)

    def trials(self, points, names):
        return CombinedTrials(self, [f.trials(points, names) for _, f in self.parts])

    def hold(self):
        for _, f in self.parts:
            f.hold()

    def release(self):
        for _, f in self.parts:
            f.release()

    def line_starts_at_state(self):
        return all(f.line_starts_at_state() for _, f in self.parts)

    def same_data_next(self):
        return all(f.same_data_next() for _, f in self.parts)

    def cursor(self):
        return [f.cursor() for _, f in self.parts]

    def restore(self, cursor):
        for (_, f), c in zip(self.parts, cursor, strict=True):
            if c is not None:
                f.restore(c)

    def extent(self):
        return self.parts[0][1].extent() or self.parts[1][1].extent()

    def tidy(self):
        for _, f in self.parts:
            f.tidy()


class CombinedLine:
    def __init__(self, parts):
        self.parts = parts

    def probe(self, alphas):
        probed = [(a, line.probe(alphas)) for a, line in self.parts]
        return [
            (sum(a * got[n][0] for a, got in probed), sum(a * got[n][1] for a, got in probed))
            for n in range(len(alphas))
        ]

    def finish(self, alpha):
        return None

    def close(self):
        for _, line in self.parts:
            line.close()


class CombinedTrials(Trials):
    def __init__(self, owner: Combined, parts: list[Trials]):
        self.owner, self.parts = owner, parts

    def values(self):
        weights = [a for a, _ in self.owner.parts]
        return [sum(a * v for a, v in zip(weights, got, strict=True)) for got in zip(*(t.values() for t in self.parts), strict=True)]

    def gradient(self, n):
        return self.owner._add(*(t.gradient(n) for t in self.parts))

    def close(self):
        for t in self.parts:
            t.close()
