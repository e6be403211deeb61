"""Vectors and matrices from arrays and from rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradloom.schemas import in_range, require


def vector_from_array(rows: DataFrame, array: str = "v", offset: str | None = None) -> DataFrame:
    """Coordinates of array columns; with ``offset``, arrays are blocks starting there."""
    start = F.col(offset).cast("bigint") if offset else F.lit(0).cast("bigint")
    parts = rows.select(start.alias("start"), F.posexplode(array).alias("pos", "v"))
    return parts.select((F.col("start") + F.col("pos")).alias("idx"), F.col("v").cast("double").alias("v"))


def vector_from_rows(spark: SparkSession, rows: DataFrame, dim: int, on_repeat: str = "fail") -> DataFrame:
    """Dense vector on ``[0, dim)``; absent coordinates are 0.

    Out-of-range indices fail the query.  Repeated ones fail too, or add up
    with ``on_repeat='sum'``.
    """
    checked = require(rows.select("idx", "v"), (in_range(F.col("idx"), dim), "index outside [0, dim)"))
    per_idx = checked.groupBy("idx").agg(F.sum("v").alias("v"), F.count(F.lit(1)).alias("n"))
    if on_repeat == "fail":
        per_idx = require(per_idx, (F.col("n") == 1, "repeated index"))
    dense = spark.range(dim).withColumnRenamed("id", "idx").join(per_idx, "idx", "left")
    return dense.select("idx", F.coalesce("v", F.lit(0.0)).alias("v"))


def matrix_from_array(rows: DataFrame, array: str = "m", row_major: bool = True, offset: str | None = None) -> DataFrame:
    """Entries of nested arrays: an array of rows, or an array of columns.

    With ``offset``, arrays are blocks of columns starting there.  A stored matrix has ``row_dim`` rows k and ``dim`` columns idx.
    """
    outer, inner = ("k", "idx") if row_major else ("idx", "k")
    start = F.col(offset).cast("bigint") if offset else F.lit(0).cast("bigint")
    lines = rows.select(start.alias("start"), F.posexplode(array).alias(outer, "line"))
    cells = lines.select("start", outer, F.posexplode("line").alias(inner, "v"))
    return cells.select((F.col("start") + F.col("idx")).alias("idx"), F.col("k").cast("int").alias("k"), F.col("v").cast("double").alias("v"))


def matrix_from_rows(spark: SparkSession, rows: DataFrame, dim: int, row_dim: int) -> DataFrame:
    """Dense matrix from rows ``idx, v ARRAY`` of length ``row_dim``; absent columns are 0."""
    checked = require(
        rows.select("idx", "v"),
        (in_range(F.col("idx"), dim), "index outside [0, dim)"),
        (F.size("v") == row_dim, "column of wrong length"),
    )
    per_idx = require(
        checked.groupBy("idx").agg(F.first("v").alias("v"), F.count(F.lit(1)).alias("n")),
        (F.col("n") == 1, "repeated index"),
    )
    zero = F.array_repeat(F.lit(0.0), row_dim)
    dense = spark.range(dim).withColumnRenamed("id", "idx").join(per_idx, "idx", "left")
    return dense.select("idx", F.posexplode(F.coalesce("v", zero)).alias("k", "v"))
