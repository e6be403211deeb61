"""Multi-label softmax over many classes in one pass: a cell (example, class) is made and summed where its example lies.

The parameters are a matrix small enough for a broadcast.  A task holds :data:`CELLS` cells at a time, or those of
one example's features, and emits its sums: one array for each coordinate that its examples use.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradloom.functions.losses import GUARD

#: Cells (feature times class) that a task works on at a time.
CELLS = 1 << 18


def packed_examples(features: DataFrame, targets: DataFrame) -> DataFrame:
    """``ex_id, weight, cls, tw, fea, val`` of targets ``ex_id, weight, ts`` (a map), dealt out evenly.

    Repeated features add up first, so an example's arrays have an entry a coordinate at most.
    """
    summed = features.groupBy("ex_id", "fea_id").agg(F.coalesce(F.sum("value"), F.lit(0.0)).alias("value"))
    listed = summed.groupBy("ex_id").agg(F.collect_list(F.struct("fea_id", "value")).alias("f"))
    rows = targets.join(listed, "ex_id", "left").select(
        "ex_id", "weight", F.map_keys("ts").alias("cls"), F.map_values("ts").alias("tw"),
        F.coalesce("f.fea_id", F.array().cast("array<bigint>")).alias("fea"), F.coalesce("f.value", F.array().cast("array<double>")).alias("val"),
    )
    # A number, so that few bytes with many cells are not taken for little work.
    spark = features.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return rows.repartition(parts, "ex_id")


def dense(x: DataFrame, columns: Sequence[str], dim: int, row_dim: int) -> list[np.ndarray]:
    """Columns of a parameter table ``idx, k`` as matrices, for tables that may be broadcast; absent entries are 0."""
    rows = x.select("idx", "k", *columns).toArrow()
    idx, k = rows["idx"].to_numpy(), rows["k"].to_numpy()
    if len(idx) and (idx.min() < 0 or idx.max() >= dim or k.min() < 0 or k.max() >= row_dim):
        raise ValueError("a parameter outside [0, dim) or [0, row_dim)")
    out = []
    for c in columns:
        matrix = np.zeros((dim, row_dim))
        matrix[idx, k] = rows[c].to_numpy()
        out.append(matrix)
    return out


def _chunks(batch: pa.RecordBatch, row_dim: int, cells: int) -> Iterator[pa.RecordBatch]:
    """Runs of examples with about ``cells`` cells; one with more is by itself."""
    cost = np.maximum(pc.list_value_length(batch["fea"]).to_numpy(zero_copy_only=False), 1) * row_dim
    run = (np.cumsum(cost) - 1) // cells
    starts = np.flatnonzero(np.diff(run, prepend=-1))
    for start, end in zip(starts, [*starts[1:], len(run)]):
        yield batch.slice(start, end - start)


def _entries(batch: pa.RecordBatch, key: str, value: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row in the batch, key and value of every entry of two list columns."""
    return tuple(a.to_numpy(zero_copy_only=False) for a in (pc.list_parent_indices(batch[key]), batch[key].flatten(), batch[value].flatten()))


def _summed(rows: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """``n`` rows: the sum of those ``rows`` that go to each; ``at`` is sorted."""
    out = np.zeros((n, rows.shape[1]))
    if len(at):
        starts = np.flatnonzero(np.diff(at, prepend=-1))
        out[at[starts]] = np.add.reduceat(rows, starts, axis=0) if len(starts) < len(at) else rows
    return out


def softmax_sums(examples: DataFrame, matrices: Sequence[np.ndarray], alphas: Sequence[float] = (0.0,), gradient: bool = False) -> DataFrame:
    """``idx, vs``, a task's sums: loss and slope at every step of ``alphas`` in rows without ``idx``, else a coordinate's gradient.

    ``matrices`` are the point and, for slopes and steps, the direction; the gradient is that at the first step.
    """
    x, *direction = matrices
    cells, row_dim = CELLS, x.shape[1]

    def sums(batches):
        totals = np.zeros(2 * len(alphas))
        pushed: dict[int, np.ndarray] = {}
        for chunk in (c for b in batches for c in _chunks(b, row_dim, cells)):
            n = chunk.num_rows
            weight = chunk["weight"].to_numpy(zero_copy_only=False)[:, None]
            row, fea, val = _entries(chunk, "fea", "val")
            at, cls, tw = _entries(chunk, "cls", "tw")
            along = _summed(direction[0][fea] * val[:, None], row, n) if direction else None
            scores = _summed(x[fea] * val[:, None], row, n)
            for j, a in enumerate(alphas):
                p = scores + a * along if direction else scores
                p = np.exp(p - p.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                hit = p[at, cls]
                part = tw * hit / (hit + GUARD)
                totals[2 * j] -= (weight[at, 0] * tw * np.log(hit + GUARD)).sum()
                slopes = p * (weight * np.bincount(at, part, n)[:, None])
                slopes[at, cls] -= weight[at, 0] * part  # a class is given once
                if direction:
                    totals[2 * j + 1] += (slopes * along).sum()
                if gradient and j == 0 and len(fea):
                    order = np.argsort(fea, kind="stable")
                    used, at_used = np.unique(fea[order], return_inverse=True)
                    for i, g in zip(used.tolist(), _summed(slopes[row[order]] * val[order][:, None], at_used, len(used))):
                        pushed[i] = pushed[i] + g if i in pushed else g.copy()
        idx, vs = [None, *pushed], [totals, *pushed.values()]
        for start in range(0, len(idx), max(cells // row_dim, 1)):
            some = slice(start, start + max(cells // row_dim, 1))
            yield pa.RecordBatch.from_arrays([pa.array(idx[some], pa.int64()), pa.array(vs[some], pa.list_(pa.float64()))], ["idx", "vs"])

    return examples.mapInArrow(sums, "idx bigint, vs array<double>")


def totals(sums: DataFrame) -> list[float]:
    """Loss and slope of every step in turn, over all tasks."""
    rows = sums.where("idx IS NULL").select(F.posexplode("vs").alias("n", "v")).groupBy("n").agg(F.sum("v").alias("v")).collect()
    return [r["v"] for r in sorted(rows, key=lambda r: r["n"])]


def gradient(sums: DataFrame) -> DataFrame:
    """``idx, k, g`` over all tasks."""
    cells = sums.where("idx IS NOT NULL").select("idx", F.posexplode("vs").alias("k", "v"))
    return cells.groupBy("idx", "k").agg(F.sum("v").alias("g"))
