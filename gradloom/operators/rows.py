"""Preparing example rows: ids, weights, features, targets, label splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed format of string example ids: the second number is the id.
FOLD_ID = r"fold(\d+)_(\d+)"


def fold_indexer(col: Column) -> Column:
    return F.regexp_extract(col, FOLD_ID, 2).cast("bigint")


def index_examples(rows: DataFrame, indexer=fold_indexer, source: str = "ex_id", out: str = "ex_id") -> DataFrame:
    """Replace any example id by a BIGINT with a Column-to-Column indexer."""
    return rows.withColumn(out, indexer(F.col(source)))


def default_weight(examples: DataFrame) -> DataFrame:
    return examples.withColumn("weight", F.coalesce(F.col("weight"), F.lit(1.0)))


def distribute_features(examples: DataFrame) -> DataFrame:
    """Sparse example rows to the long table ``ex_id, fea_id, value``; repeated features add up."""
    return (
        examples.select("ex_id", F.explode("features").alias("f"))
        .groupBy("ex_id", F.col("f.fea_id").alias("fea_id"))
        .agg(F.sum("f.value").alias("value"))
    )


def block_features(features: DataFrame, block_size: int) -> DataFrame:
    """Features per (example, block) with offsets local to the block, in order."""
    block = F.floor(F.col("fea_id") / F.lit(block_size)).cast("bigint")
    entry = F.struct((F.col("fea_id") - F.col("fea_block") * F.lit(block_size)).alias("offset"), "value")
    return (
        features.withColumn("fea_block", block)
        .groupBy("ex_id", "fea_block")
        .agg(F.array_sort(F.collect_list(entry)).alias("entries"))
    )


def distribute_targets(examples: DataFrame, block_size: int) -> DataFrame:
    """Label and weight with the distinct feature blocks an example touches."""
    blocks = F.transform("features", lambda f: F.floor(f["fea_id"] / F.lit(block_size)).cast("bigint"))
    return examples.select("ex_id", "label", "weight", F.array_sort(F.array_distinct(blocks)).alias("fea_blocks"))


def split_potentials(potentials: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The u part and the v part of a potential table ``side, idx, p``."""
    u, v = (potentials.filter(F.col("side") == s).select("idx", "p") for s in ("u", "v"))
    return u, v


def positive_labels(examples: DataFrame) -> DataFrame:
    return examples.filter(F.col("is_positive")).drop("is_positive")


def negative_labels(examples: DataFrame) -> DataFrame:
    return examples.filter(~F.col("is_positive")).drop("is_positive")


def total_weight(examples: DataFrame) -> DataFrame:
    return examples.agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias("total_weight"))
