"""Distributed vector and matrix algebra.

A vector is ``(idx, v)``, a matrix ``(idx, k, v)``; the functions take the
key columns and treat both alike.  Vectors that live together (optimizer
state) should be columns of one table: then every operation below is a plain
projection or one aggregate and no join is needed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradloom.functions.elementwise import ieee_divide
from gradloom.schemas import in_range, require

VECTOR_KEYS = ("idx",)
MATRIX_KEYS = ("idx", "k")


def align(left: DataFrame, right: DataFrame, keys: Sequence[str] = VECTOR_KEYS) -> DataFrame:
    """Put two vectors side by side as columns ``a`` and ``b``; an absent entry is 0."""
    both = left.withColumnRenamed("v", "a").join(right.withColumnRenamed("v", "b"), list(keys), "full")
    return both.select(*keys, *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("a", "b")])


def zip_map(
    left: DataFrame, right: DataFrame, f: Callable[..., Column], keys: Sequence[str] = VECTOR_KEYS, keyed: bool = False
) -> DataFrame:
    """Elementwise ``f(a, b)``, or ``f(*keys, a, b)`` when ``keyed``."""
    pair = align(left, right, keys)
    args = [F.col(k) for k in keys] if keyed else []
    return pair.select(*keys, f(*args, F.col("a"), F.col("b")).alias("v"))


def add(left, right, keys=VECTOR_KEYS) -> DataFrame:
    return zip_map(left, right, lambda a, b: a + b, keys)


def subtract(left, right, keys=VECTOR_KEYS) -> DataFrame:
    return zip_map(left, right, lambda a, b: a - b, keys)


def multiply(left, right, keys=VECTOR_KEYS) -> DataFrame:
    return zip_map(left, right, lambda a, b: a * b, keys)


def divide(left, right, keys=VECTOR_KEYS) -> DataFrame:
    return zip_map(left, right, ieee_divide, keys)


def linear_combination(a: float, left: DataFrame, b: float, right: DataFrame, keys=VECTOR_KEYS) -> DataFrame:
    return zip_map(left, right, lambda x, y: F.lit(float(a)) * x + F.lit(float(b)) * y, keys)


def map_values(vec: DataFrame, f: Callable[[Column], Column], keys=VECTOR_KEYS) -> DataFrame:
    return vec.select(*keys, f(F.col("v")).alias("v"))


def scale(vec: DataFrame, c: float, keys=VECTOR_KEYS) -> DataFrame:
    return map_values(vec, lambda v: v * F.lit(float(c)), keys)


def dot(table: DataFrame, a: str, b: str) -> DataFrame:
    """Inner product of two columns of one table, as one row ``dot``."""
    return table.agg(F.coalesce(F.sum(F.col(a) * F.col(b)), F.lit(0.0)).alias("dot"))


def norm(table: DataFrame, col: str = "v", p: float = 2.0) -> DataFrame:
    """(sum |v|^p)^(1/p) as one row ``norm``."""
    size = F.abs(F.col(col))
    if p == 1.0:
        total = F.sum(size)
    elif p == 2.0:
        total = F.sqrt(F.sum(size * size))
    else:
        total = F.pow(F.sum(F.pow(size, F.lit(float(p)))), F.lit(1.0 / p))
    return table.agg(F.coalesce(total, F.lit(0.0)).alias("norm"))


def gram(table: DataFrame, cols: Sequence[str], *more: Column) -> DataFrame:
    """All inner products of ``cols`` in one pass: one row, columns ``dot_i_j`` with i <= j, and ``more`` aggregates."""
    sums = [
        F.coalesce(F.sum(F.col(a) * F.col(cols[j])), F.lit(0.0)).alias(f"dot_{i}_{j}")
        for i, a in enumerate(cols)
        for j in range(i, len(cols))
    ]
    return table.agg(*sums, *more)


def gram_matrix(table: DataFrame, cols: Sequence[str]) -> np.ndarray:
    """The Gram matrix as a small driver-side array of ``len(cols)`` squared numbers."""
    return gram_and_sum(table, cols, F.lit(0.0))[0]


def gram_and_sum(table: DataFrame, cols: Sequence[str], term: Column) -> tuple[np.ndarray, float]:
    """The Gram matrix and the sum of ``term`` over the rows, from one aggregate."""
    row = gram(table, cols, F.sum(term).alias("total")).first()
    n = len(cols)
    out = np.empty((n, n))
    for i in range(n):
        for j in range(i, n):
            out[i, j] = out[j, i] = row[f"dot_{i}_{j}"]
    return out, row["total"] or 0.0


def dense_blocks(vec: DataFrame, block_size: int, keys: Sequence[str] = VECTOR_KEYS) -> DataFrame:
    """Ordered arrays of at most ``block_size`` coordinates: ``block, values``."""
    order = F.struct(*keys, "v")
    return (
        vec.groupBy(F.floor(F.col("idx") / F.lit(block_size)).cast("bigint").alias("block"))
        .agg(F.array_sort(F.collect_list(order)).alias("entries"))
        .select("block", F.transform("entries", lambda e: e["v"]).alias("values"))
    )


def _in_blocks(table: DataFrame, block_size: int, cols: Sequence[str]) -> DataFrame:
    return table.select(F.floor(F.col("idx") / F.lit(block_size)).cast("bigint").alias("block"), *cols)


def _checked(out, shape: tuple[int, ...]) -> np.ndarray:
    out = np.asarray(out, dtype=np.float64)
    if out.shape != shape:
        raise ValueError(f"a block function returned shape {out.shape} for a block of {shape}")
    return out


def map_blocks(
    table: DataFrame,
    block_size: int,
    f: Callable[..., np.ndarray],
    cols: Sequence[str] = ("v",),
    keyed: bool = False,
) -> DataFrame:
    """Apply a NumPy function to whole blocks of one or more aligned columns.

    ``f`` gets one array per column (preceded by the coordinates when
    ``keyed``) and returns an array of the same length.  A block holds at most
    ``block_size`` coordinates, so a group never grows with the data.
    """
    cols = list(cols)

    def on_block(block: pa.Table) -> pa.Table:
        block = block.sort_by("idx")
        idx, *args = (block[c].to_numpy() for c in ("idx", *cols))
        out = f(idx, *args) if keyed else f(*args)
        return pa.table({"idx": idx, "v": _checked(out, idx.shape)})

    return _in_blocks(table, block_size, ["idx", *cols]).groupBy("block").applyInArrow(on_block, "idx bigint, v double")


def map_matrix_blocks(
    mat: DataFrame,
    row_dim: int,
    block_size: int,
    f: Callable[..., np.ndarray],
    other: DataFrame | None = None,
    keyed: bool = False,
) -> DataFrame:
    """Apply a NumPy function to blocks of whole matrix columns, alone or side by side with another matrix's.

    ``f`` gets an array of ``row_dim`` times the block's coordinates for each matrix, in order of ``k`` and
    ``idx``; when ``keyed`` it first gets the coordinates.  It returns an array of that shape.  Entries that
    are absent are 0; a block has the coordinates that either matrix has.  A ``k`` outside ``[0, row_dim)``
    and a repeated entry fail.  A group has at most ``row_dim * block_size`` entries of each matrix.
    """

    def cells(table: DataFrame) -> DataFrame:
        known = require(table, (in_range(F.col("k"), row_dim), "matrix row outside [0, row_dim)"))
        return _in_blocks(known, block_size, ["idx", "k", "v"]).groupBy("block")

    def filled(block: pa.Table, idx: np.ndarray) -> np.ndarray:
        at = block["k"].to_numpy().astype(np.int64) * len(idx) + np.searchsorted(idx, block["idx"].to_numpy())
        if len(np.unique(at)) < len(at):
            raise ValueError("a repeated matrix entry")
        out = np.zeros(row_dim * len(idx))
        out[at] = block["v"].to_numpy()
        return out.reshape(row_dim, len(idx))

    def on_blocks(*blocks: pa.Table) -> pa.Table:
        idx = np.unique(np.concatenate([b["idx"].to_numpy() for b in blocks]))
        args = [filled(b, idx) for b in blocks]
        out = _checked(f(idx, *args) if keyed else f(*args), (row_dim, len(idx)))
        k = np.repeat(np.arange(row_dim, dtype=np.int32), len(idx))
        return pa.table({"idx": np.tile(idx, row_dim), "k": k, "v": out.ravel()})

    schema = "idx bigint, k int, v double"
    if other is None:
        return cells(mat).applyInArrow(lambda block: on_blocks(block), schema)
    return cells(mat).cogroup(cells(other)).applyInArrow(lambda one, two: on_blocks(one, two), schema)


def widen(mat: DataFrame, row_dim: int, prefix: str = "v", keys: Iterable[str] = ("idx",)) -> DataFrame:
    """Matrix rows as columns ``prefix0 .. prefix{row_dim-1}``; absent entries are 0."""
    cells = [
        F.coalesce(F.max(F.when(F.col("k") == i, F.col("v"))), F.lit(0.0)).alias(f"{prefix}{i}")
        for i in range(row_dim)
    ]
    return mat.groupBy(*keys).agg(*cells)


def lengthen(wide: DataFrame, row_dim: int, prefix: str, out: str, keys: Iterable[str]) -> DataFrame:
    """Inverse of :func:`widen`: ``keys, k, out``."""
    values = F.array(*[F.col(f"{prefix}{i}") for i in range(row_dim)])
    return wide.select(*keys, F.posexplode(values).alias("k", out))
