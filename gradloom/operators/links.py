"""Pair ranking by whole links, for parameters that a task can hold but that are too many for a join's broadcast.

A link is one row: its examples and their features, made where its positive lies.  A task gets the parameters as one
matrix, goes through its links a run at a time, and emits sums: loss, slope and weight, and one row for each coordinate
that its examples use.  So neither features nor scores move, and what moves grows with tasks and coordinates.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradloom.functions.losses import GUARD
from gradloom.operators.vectors import widen
from gradloom.schemas import in_range, require

#: Entries of a parameter matrix that a task may hold (256 MB); a gradient's sums take as much again.
ENTRIES = 1 << 25
#: Coordinates that are fetched at once, and examples and features that a task works on at once.
FETCHED, RUN = 1 << 19, 1 << 18


def fits_task(dim: int | None, row_dim: int) -> bool:
    return dim is not None and dim * row_dim <= ENTRIES


def matrix(x: DataFrame, column: str, dim: int, row_dim: int) -> Broadcast:
    """A column of a parameter table ``idx, k`` as a broadcast matrix; absent entries are 0."""
    out = np.zeros((dim, row_dim))
    wide = widen(x.select("idx", "k", F.col(column).alias("v")), row_dim)
    for start in range(0, dim, FETCHED):
        rows = wide.where((F.col("idx") >= start) & (F.col("idx") < min(start + FETCHED, dim))).toArrow()
        at = rows["idx"].to_numpy()
        for k in range(row_dim):
            out[at, k] = rows[f"v{k}"].to_numpy()
    return x.sparkSession.sparkContext.broadcast(out)


def packed_links(examples: DataFrame, features: DataFrame, dim: int) -> DataFrame:
    """``link_id, es``: examples (without ``fea_id``) and features of a link, in as many partitions as tasks can run.

    Where the examples are placed by link, nothing moves.
    """
    features = require(features, (in_range(F.col("fea_id"), dim), "feature id outside [0, dim)"))
    none = F.lit(None).cast("double")
    own = F.struct("iter", "i", F.col("weight").cast("double").alias("weight"), F.col("rel_weight").cast("double").alias("rel_weight"),
                   F.lit(None).cast("bigint").alias("fea_id"), none.alias("value"))
    fea = F.struct("iter", "i", none.alias("weight"), none.alias("rel_weight"), F.col("fea_id").cast("bigint").alias("fea_id"), F.col("value").cast("double").alias("value"))
    rows = examples.select("link_id", own.alias("e")).union(features.select("link_id", fea.alias("e")))
    packed = rows.groupBy("link_id").agg(F.collect_list("e").alias("es"))
    return packed.coalesce(examples.sparkSession.sparkContext.defaultParallelism)


class Links:
    """Examples, features and pairs of a run of links."""

    def __init__(self, es: pa.ListArray):
        flat = es.flatten()
        link = pc.list_parent_indices(es).to_numpy(zero_copy_only=False)

        def column(name):
            return flat.field(name)

        number, i, fea = (column(c) for c in ("iter", "i", "fea_id"))
        own = fea.is_null().to_numpy(zero_copy_only=False)
        slot, n = _slots(link, number.to_numpy(zero_copy_only=False), i.to_numpy(zero_copy_only=False))
        self.n, at = n, slot[own]
        there = np.zeros(n, bool)
        there[at] = True
        weight, rel = (self._largest(at, column(c).filter(pa.array(own))) for c in ("weight", "rel_weight"))
        link_of, first = np.zeros(n, np.int64), number.to_numpy(zero_copy_only=False)[own] < 0
        link_of[at] = link[own]
        positive = np.full(len(es), -1)
        positive[link[own][first]] = at[first]
        there[at[first]] = False
        self.neg = np.flatnonzero(there)
        self.pos = positive[link_of[self.neg]]
        if (self.pos < 0).any():
            raise ValueError("a negative without a positive")
        there[at[first]] = True
        self.weight = weight[self.pos] * rel[self.neg]
        kept = ~own
        kept[kept] = there[slot[kept]]
        self.slot = slot[kept]
        kept = pa.array(kept)
        self.fea = fea.filter(kept).to_numpy(zero_copy_only=False)
        self.value = column("value").filter(kept).fill_null(0.0).to_numpy(zero_copy_only=False)

    def _largest(self, at: np.ndarray, given: pa.Array) -> np.ndarray:
        """The largest of an example's values; a null adds nothing to any sum."""
        out = np.full(self.n, -np.inf)
        np.maximum.at(out, at, given.fill_null(0.0).to_numpy(zero_copy_only=False))
        return out

    def sums(self, rows: np.ndarray) -> np.ndarray:
        """By example, the sum of ``rows`` of its features."""
        return np.bincount(self.slot, rows, self.n)

    def products(self, parameters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values times parameters by feature, and their sums by example, a row for each factor."""
        terms = parameters[self.fea].T * self.value
        return terms, np.array([self.sums(t) for t in terms])

    def gaps(self, scores: np.ndarray) -> np.ndarray:
        return scores[self.pos] - scores[self.neg]


def _slots(link: np.ndarray, number: np.ndarray, i: np.ndarray) -> tuple[np.ndarray, int]:
    """A number for each example key, the same for equal ones, and how many there may be."""
    if not len(link):
        return link, 0
    sizes = [int(link.max()) + 1, *(int(c.max()) - int(c.min()) + 1 for c in (number, i))]
    if sizes[0] * sizes[1] * sizes[2] <= 8 * len(link):
        return (link.astype(np.int64) * sizes[1] + (number - number.min())) * sizes[2] + (i - i.min()), sizes[0] * sizes[1] * sizes[2]
    used, slot = np.unique(np.stack([link, number, i], 1), axis=0, return_inverse=True)
    return slot.ravel(), len(used)


def _losses(gap: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Loss of each pair and its derivative by the positive's score (see ``losses.pair_value``)."""
    e = np.exp(-np.abs(gap))
    near, far = 1.0 / (1.0 + e), e / (1.0 + e)
    hit, miss = np.where(gap >= 0, near, far), np.where(gap >= 0, far, near)
    return -weight * np.log(hit + GUARD), -weight * hit * miss / (hit + GUARD)


def _runs(batch: pa.RecordBatch) -> Iterator[pa.ListArray]:
    """Links with about ``RUN`` entries; one with more is by itself."""
    es = batch.column("es")
    run = (np.cumsum(pc.list_value_length(es).to_numpy(zero_copy_only=False)) - 1) // RUN
    starts = np.flatnonzero(np.diff(run, prepend=-1))
    for start, end in zip(starts, [*starts[1:], len(run)]):
        yield es.slice(start, end - start)


def link_sums(packed: DataFrame, point: Broadcast, row_dim: int, direction: Broadcast | None = None, alphas: Sequence[float] = (0.0,), gradient: bool = False) -> DataFrame:
    """Sums ``idx, a0.., c`` of all tasks.

    At ``idx`` -1 the pairs' weight (``a0``), at -2 - n their loss (``a0``) and slope (``c``) at step n; with ``gradient``,
    which is that at the point, also a row for each coordinate of the features, as ``ranking.gradient_cells`` reads them.
    """
    names = [*[f"a{k}" for k in range(row_dim)], "c"]
    schema = pa.schema([("idx", pa.int64()), *[(n, pa.float64()) for n in names]])

    def tasks(batches):
        x, d = point.value, None if direction is None else direction.value
        totals = np.zeros((1 + len(alphas), row_dim + 1))
        pushed, used = (np.zeros((row_dim + 1, len(x))), np.zeros(len(x), bool)) if gradient else (None, None)
        for es in (es for b in batches for es in _runs(b)):
            links = Links(es)
            terms, s = links.products(x)
            gap = links.gaps(0.5 * ((s * s).sum(0) - links.sums((terms * terms).sum(0))))
            c1 = c2 = 0.0
            if d is not None:
                along, t = links.products(d)
                c1 = links.gaps((s * t).sum(0) - links.sums((terms * along).sum(0)))
                c2 = links.gaps(0.5 * ((t * t).sum(0) - links.sums((along * along).sum(0))))
            totals[0, 0] += links.weight.sum()
            for n, a in enumerate(alphas, 1):
                loss, slope = _losses(gap + a * c1 + a * a * c2, links.weight)
                totals[n, 0] += loss.sum()
                totals[n, -1] += (slope * (c1 + 2.0 * a * c2)).sum()
            if gradient:
                slope = _losses(gap, links.weight)[1]
                pulls = np.bincount(links.pos, slope, links.n) - np.bincount(links.neg, slope, links.n)
                pull = pulls[links.slot] * links.value
                used[links.fea] = True
                for k in range(row_dim):
                    np.add.at(pushed[k], links.fea, pull * s[k][links.slot])
                np.add.at(pushed[-1], links.fea, pull * links.value)
        yield pa.RecordBatch.from_arrays([pa.array(-1 - np.arange(len(totals))), *[pa.array(c) for c in totals.T.copy()]], schema=schema)
        if gradient:
            found = np.flatnonzero(used)
            for start in range(0, len(found), RUN):
                idx = found[start : start + RUN]
                yield pa.RecordBatch.from_arrays([pa.array(idx), *[pa.array(row[idx]) for row in pushed]], schema=schema)

    return packed.mapInArrow(tasks, "idx bigint, " + ", ".join(f"{n} double" for n in names))
