"""Whitening of vectors by distributed block matrices.

Rows are numbered and written once, centred exactly in integers, and indexed into the blocks of
an MLlib ``BlockMatrix``.  The transpose times the matrix gives the scatter, its eigenvectors are
found on the driver (dimension x dimension numbers), and a second product with the whitening
matrix projects all rows.  The model is fitted on the *different* vectors, each once, however
often a vector is repeated; copies are folded before they are moved.

The product of two tall matrices has one result block, where plain multiplication would gather
all rows in one task.  So the inner dimension is split (``numMidDimSplits``): every split adds up
its own row blocks, and only sums of dimension x dimension numbers meet.

Defined cases: rows whose vector is null or empty or holds null, NaN or infinite entries are no
rows; repeated rows and repeated or null ids give a result each.  Vectors of different lengths
raise ``ValueError``.  Components without variance (below 1e-12 of the total) do not exist, so
fewer than asked for may come, and none if there are fewer than two different vectors or no rows.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import Matrices, MatrixUDT
from pyspark.mllib.linalg.distributed import BlockMatrix
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

#: Rows of a block: enough blocks for all tasks, few enough that the driver can hold their numbers, each of bounded size.
LEAST_BLOCK, BLOCKS, BLOCK_BYTES = 256, 4096, 1 << 24
#: Columns of a block.
WIDE = 1024
NEGLIGIBLE = 1e-12


def whole(vector: str) -> Column:
    """Whether a vector has entries, all of them finite numbers."""
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) != float("inf")))
    return F.coalesce((F.size(vector) > 0) & finite, F.lit(False))


def scaled(vector: str) -> Column:
    """Entries as integers: 64ths, rounded down, plus a million."""
    return F.transform(vector, lambda c: F.floor(64 * c.cast("double")) + 1_000_000)


def numbered(rows: DataFrame, folder: str) -> tuple[DataFrame, int]:
    """Rows with ``row`` numbers from 0 without gaps, written once; and how many there are.

    The number is the place in the written partition after the partitions before it: their sizes
    are the only thing that is gathered.
    """
    spark = rows.sparkSession
    rows.withColumn("__mark", F.monotonically_increasing_id()).write.parquet(folder)
    table = spark.read.schema(rows.schema.add("__mark", "long")).parquet(folder)
    part = F.shiftright("__mark", 33)
    sizes = sorted(table.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())
    starts = np.cumsum([0, *(r["n"] for r in sizes)])
    offsets = spark.createDataFrame([(r["p"], int(s)) for r, s in zip(sizes, starts, strict=False)], "__p long, __start long")
    placed = table.join(F.broadcast(offsets), part == F.col("__p"))
    return placed.withColumn("row", F.col("__start") + F.col("__mark").bitwiseAND(F.lit((1 << 33) - 1))).drop("__mark", "__p", "__start"), int(starts[-1])


def _sums(rows: DataFrame) -> tuple[int, list[int]]:
    """Rows, and the exact sum of each dimension of ``x``."""

    def add(batches):
        for batch in batches:
            x = batch.column(0)
            sizes = np.diff(x.offsets.to_numpy())
            if len(sizes):
                if sizes.min() != sizes.max():
                    raise ValueError("vectors of different lengths")
                total = x.flatten().to_numpy().reshape(len(sizes), -1).sum(0)
                yield pa.RecordBatch.from_arrays([pa.array([len(sizes)], pa.int64()), pa.array([total.tolist()], pa.list_(pa.int64()))], names=["n", "x"])

    parts = rows.select("x").mapInArrow(add, "n bigint, x array<bigint>")
    total = parts.select("n", F.posexplode("x").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("s"), F.sum("n").alias("n")).sort("i").collect()
    if len({r["n"] for r in total}) > 1:
        raise ValueError("vectors of different lengths")
    return (total[0]["n"], [r["s"] for r in total]) if total else (0, [])


class Fit(NamedTuple):
    n: int  # rows that the model is fitted on
    sums: list[int]  # of each dimension over them


_PLACE = "struct<_1: bigint, _2: bigint>"
_BLOCK = MatrixUDT.sqlType().simpleString()


def _blocks(table: DataFrame, n_rows: int, fit: Fit, folder: str, key: str) -> tuple[BlockMatrix, DataFrame]:
    """Numbered rows (row, key, x), centred, as a matrix of blocks; and (i, keys, deviations) of each row of blocks.

    The blocks are put together in numpy and written, once, in the format that MLlib itself
    reads; an ``IndexedRowMatrix`` would move every number as an object.
    """
    spark, wide = table.sparkSession, len(fit.sums)
    height = max(min(max(-(-n_rows // BLOCKS), LEAST_BLOCK), BLOCK_BYTES // (8 * wide)), 1)
    kind = table.schema[key].dataType
    schema = f"_1 {_PLACE}, _2 {_BLOCK}, keys array<{kind.simpleString()}>, deviations array<bigint>"

    def put(place: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("row").combine_chunks()
        x = pc.list_flatten(rows["x"]).to_numpy().reshape(rows.num_rows, wide)
        steep = fit.n * float(np.abs(x).max()) + max(map(abs, fit.sums))
        d = x * fit.n - np.array(fit.sums, np.int64) if steep < 2**62 else x.astype(object) * fit.n - np.array(fit.sums, object)
        # Python integers where 64 bits may not do; Arrow refuses a deviation beyond them.
        exact = d if float(np.abs(d).max()) ** 2 * wide < 2**62 else d.astype(object)
        deviations, v, out = (exact * exact).sum(1), (d / fit.n).astype(float), []
        for j in range(-(-wide // WIDE)):
            part = v[:, j * WIDE : (j + 1) * WIDE]
            matrix = {"type": 1, "numRows": part.shape[0], "numCols": part.shape[1], "colPtrs": None, "rowIndices": None, "values": part.ravel(order="F"), "isTransposed": False}
            out.append(({"_1": place[0].as_py(), "_2": j}, matrix, rows[key].to_pylist() if not j else None, deviations.tolist() if not j else None))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)

    arrow = to_arrow_schema(StructType.fromDDL(schema))
    rows = table.select(F.expr(f"row div {height}").alias("i"), "row", key, "x")
    rows.groupBy("i").applyInArrow(put, schema).write.parquet(folder)
    matrices = spark.read.schema(StructType([StructField("_1", StructType.fromDDL("_1 bigint, _2 bigint")), StructField("_2", MatrixUDT())])).parquet(folder)
    model = callMLlibFunc("createBlockMatrix", matrices, height, WIDE, n_rows, wide)
    labels = spark.read.schema(schema).parquet(folder).where("_1._2 = 0").select(F.col("_1._1").alias("i"), "keys", "deviations")
    return BlockMatrix(model, height, WIDE), labels


def _scatter(matrix: BlockMatrix) -> np.ndarray:
    """The matrix's transpose times the matrix, its inner dimension split."""
    splits = max(min(-(-matrix.numRows() // matrix.rowsPerBlock), int(SparkSession.active().conf.get("spark.sql.shuffle.partitions"))), 1)
    # numMidDimSplits has no place in the Python signature.
    product = matrix.transpose()._java_matrix_wrapper.call("multiply", matrix._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(product, WIDE, WIDE).toLocalMatrix().toArray()


def _local(spark: SparkSession, values: np.ndarray) -> BlockMatrix:
    """A matrix of dimension x components numbers as blocks."""
    cuts = [values[i : i + WIDE] for i in range(0, len(values), WIDE)]
    blocks = [((i, 0), Matrices.dense(*c.shape, c.ravel(order="F").tolist())) for i, c in enumerate(cuts)]
    return BlockMatrix(spark.sparkContext.parallelize(blocks, len(blocks)), WIDE, WIDE, values.shape[0], values.shape[1])


def whiten(rows: DataFrame, folder: str, components: int = 16, key: str = "vec_id") -> DataFrame:
    """``key``, component, n, deviation, whitened, explained and identity_error of every row and component.

    ``rows`` holds ``key`` and ``x``, an array of integers; ``folder`` takes the numbered rows.
    """
    spark = rows.sparkSession
    table, n_rows = numbered(rows.select(key, "x"), f"{folder}/rows")
    fit, n = numbered(table.select("x").distinct(), f"{folder}/fit")
    counted, sums = _sums(fit)
    assert counted == n
    kind = rows.schema[key].dataType.simpleString()
    shape = f"`{key}` {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    if n < 2:
        return spark.createDataFrame([], shape)
    model = Fit(n, sums)
    fitted, _ = _blocks(fit.withColumn("__none", F.lit(0)), n, model, f"{folder}/fit-blocks", "__none")
    covariance = _scatter(fitted) / n
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    order = np.argsort(-values)[:components]
    order = order[values[order] > NEGLIGIBLE * np.trace(covariance)]
    if not len(order):
        return spark.createDataFrame([], shape)
    whitener = _local(spark, vectors[:, order] / np.sqrt(values[order]))
    seen = _scatter(fitted.multiply(whitener)) / n
    error = float(np.abs(seen - np.eye(len(order))).max())
    explained = [float(v) for v in values[order] / np.trace(covariance)]

    everything, labels = _blocks(table, n_rows, model, f"{folder}/blocks", key)
    projected = callMLlibFunc("getMatrixBlocks", everything.multiply(whitener)._java_matrix_wrapper._java_model)
    projected = projected.select(F.col("_1._1").cast("long").alias("i"), F.unwrap_udt("_2").alias("m"))
    k = len(order)

    def unfold(batches):
        for batch in batches:
            for keys, deviations, m in zip(batch["keys"], batch["deviations"], batch["m"], strict=True):
                shape = m["numRows"].as_py(), m["numCols"].as_py()
                whitened = m["values"].values.to_numpy().reshape(shape, order="C" if m["isTransposed"].as_py() else "F")
                at = pa.array(np.repeat(np.arange(shape[0]), k))
                component = np.tile(np.arange(1, k + 1, dtype=np.int32), shape[0])
                yield pa.RecordBatch.from_arrays([keys.values.take(at), pa.array(component), deviations.values.take(at), pa.array(whitened.ravel())], names=[key, "component", "deviation", "whitened"])

    out = labels.join(projected, "i").drop("i").mapInArrow(unfold, f"`{key}` {kind}, component int, deviation bigint, whitened double")
    share = F.array(*map(F.lit, explained))
    return out.select(
        key, "component", F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.element_at(share, F.col("component")).alias("explained"), F.lit(error).alias("identity_error"),
    )
