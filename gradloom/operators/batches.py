"""Mini-batches: a driver cursor over batches that live in Spark."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradloom.plans.joins import SpreadRows, fits_broadcast
from gradloom.schemas import in_range, require

HOLD, NO_HOLD, REFRESH = "hold", "no_hold", "refresh_on_hold"


class Batch:
    """Targets and features of one batch, cached in the placements scoring needs.

    ``features`` is a table, a function that makes it from the cached targets,
    or None for a batch without any.  With ``dim``, a feature id outside
    ``[0, dim)`` fails the job that places the features.  Targets that are ``placed``
    already, and cheap to make, are taken as they are; ``cached`` features are cheap to read.
    """

    def __init__(self, targets: DataFrame, features, number: int = 0, keys=("ex_id",), dim: int | None = None, placed: bool = False, cached: bool = False):
        self.number, self.placed, self.cached = number, placed, cached
        self.checks = [] if dim is None else [(in_range(F.col("fea_id"), dim), "feature id outside [0, dim)")]
        self.keys = list(keys)
        self._targets, self._features = targets, features
        self._loaded = False
        self._by_feature: SpreadRows | None = None
        self._weight: float | None = None

    def load(self) -> "Batch":
        if not self._loaded:
            given = [c for c in ("label", "weight") if c in self._targets.columns]
            rows = require(self._targets, *[(F.col(c).isNotNull(), f"null {c} in a batch") for c in given])
            if self.placed:
                self.targets = rows
            else:
                placed = rows.repartition(*self.keys).sortWithinPartitions(*self.keys)
                self.targets = placed.persist(StorageLevel.MEMORY_AND_DISK)
            if callable(self._features):
                self._features = self._features(self.targets)
            if self._features is not None:
                # Placing reads the rows twice; they are worked out once, and let go when placed.
                rows = self._features if self.cached else self._features.select("*").persist(StorageLevel.MEMORY_AND_DISK)
                self.by_example = SpreadRows.place(rows, self.keys, *self.checks)
                if not self.cached:
                    self.by_example.rows.count()
                    rows.unpersist()
            self._loaded = True
        return self

    @property
    def total_weight(self) -> float:
        if self._weight is None:
            self._weight = self.load().targets.agg(F.sum("weight")).first()[0] or 0.0
        return self._weight

    def for_scoring(self, dim: int | None) -> DataFrame | SpreadRows:
        """Features placed by example while the weights can be broadcast, else by feature."""
        self.load()
        if fits_broadcast(dim):
            return self.by_example.plain
        if self._by_feature is None:
            # From the rows in the first placement, which have been checked.
            self._by_feature = SpreadRows.place(self.by_example.plain, ["fea_id"])
        return self._by_feature

    def release(self) -> None:
        if self._loaded:
            if not self.placed:
                self.targets.unpersist()
            if self._features is not None:
                self.by_example.unpersist()
            if self._by_feature is not None:
                self._by_feature.unpersist()
                self._by_feature = None
            self._loaded = False


class BatchCycle:
    """Cycles through ``num_batches`` batches of an example table.

    ``policy`` says what a line search sees: ``hold`` keeps the batch of the
    last evaluation, ``refresh_on_hold`` moves on once and then holds,
    ``no_hold`` gives every evaluation the next batch.  ``epoch`` counts how
    often the cycle began anew; it stands still while a batch is held.
    """

    def __init__(
        self,
        targets: DataFrame,
        features: DataFrame | None = None,
        num_batches: int = 1,
        policy: str = HOLD,
        batch_column: str = "batch_id",
        keys=("ex_id",),
    ):
        if policy not in (HOLD, NO_HOLD, REFRESH):
            raise ValueError(f"unknown policy {policy}")
        self.targets, self.features = targets, features
        self.num_batches = num_batches
        self.policy = policy
        self.batch_column = batch_column
        self.keys = list(keys)
        self.position, self.epoch = -1, 0
        self.holding = False
        #: Coordinates of the model that reads the features; the smallest one if several do.
        self.dim: int | None = None
        self._current: Batch | None = None
        self._numbered: DataFrame | None = None

    def reads(self, dim: int | None) -> None:
        """A model with ``dim`` coordinates reads the features: other ids make loading fail."""
        if dim is not None:
            self.dim = dim if self.dim is None else min(dim, self.dim)

    @property
    def epoch_done(self) -> bool:
        return self.position + 1 >= self.num_batches

    def slice(self, number: int) -> tuple[DataFrame, DataFrame | None]:
        """Targets and features of one batch, uncached."""
        if self.num_batches == 1 and self.batch_column not in self.targets.columns:
            return self.targets, self.features
        chosen = F.col(self.batch_column) == number
        targets = self.targets.filter(chosen).drop(self.batch_column)
        if self.features is None:
            return targets, None
        if self.batch_column in self.features.columns:
            return targets, self.features.filter(chosen).drop(self.batch_column)
        return targets, self.features.join(targets.select(*self.keys), self.keys, "left_semi")

    def _batch(self, number: int) -> Batch:
        """One batch; features without a number are given their examples' once, for all batches, and kept."""
        targets, features = self.slice(number)
        numbered = self.num_batches > 1 and features is not None and self.batch_column not in self.features.columns
        if numbered:
            if self._numbered is None:
                numbers = self.targets.select(*self.keys, self.batch_column).distinct()
                self._numbered = self.features.join(numbers, self.keys).persist(StorageLevel.MEMORY_AND_DISK)
            features = self._numbered.filter(F.col(self.batch_column) == number).drop(self.batch_column)
        return Batch(targets, features, number, self.keys, self.dim, cached=numbered)

    def advance(self, steps: int = 1) -> int:
        rounds, self.position = divmod(self.position + steps, self.num_batches)
        self.epoch += rounds
        return self.position

    def next(self) -> Batch:
        if self._current is not None and (self.holding or self.num_batches == 1):
            if not self.holding:
                self.advance()
            return self._current.load()
        self.advance()
        self._drop()
        self._current = self._batch(self.position).load()
        return self._current

    def next_features(self) -> DataFrame:
        """Features of the next batch, for scoring without targets; advances unless held."""
        if not (self.holding and self._current is not None):
            self.advance()
            if self._current is not None and self._current.number != self.position:
                self._drop()
        return self.slice(self.position)[1]

    @property
    def current(self) -> Batch:
        return self._current if self._current is not None else self.next()

    def hold(self) -> None:
        if self.policy == NO_HOLD:
            return
        if self.policy == REFRESH:
            self.holding = False
            self.next()
        self.holding = True

    def release(self) -> None:
        self.holding = False

    def cursor(self) -> dict:
        """Position, epoch and hold, as a saved run keeps them."""
        return {"position": self.position, "epoch": self.epoch, "holding": self.holding, "num_batches": self.num_batches}

    def restore(self, cursor: dict) -> None:
        """Stand where the cursor was taken: its batch is the current one again, the next call gives its successor."""
        if cursor["num_batches"] != self.num_batches:
            raise ValueError(f"saved with {cursor['num_batches']} batches, resumed with {self.num_batches}")
        self._drop()
        self.position, self.holding, self.epoch = cursor["position"], cursor["holding"], cursor.get("epoch", 0)
        if self.position >= 0:
            self._current = self._batch(self.position)

    @contextmanager
    def held(self) -> Iterator["BatchCycle"]:
        """Hold for the length of a ``with`` block, also when a search fails."""
        self.hold()
        try:
            yield self
        finally:
            self.release()

    def _drop(self) -> None:
        if self._current is not None:
            self._current.release()
            self._current = None

    def free(self) -> None:
        """Keep nothing in the cache."""
        self._drop()
        if self._numbered is not None:
            self._numbered.unpersist()
            self._numbered = None
