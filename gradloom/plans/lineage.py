"""Cutting lineage of iterative plans in a folder every executor can reach."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """Folder for checkpoints: the cluster's own setting, else a test folder.

    A machine-local folder is only ever chosen on a local master, where the
    driver and the executors are one process.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", "")
    current = sc.getCheckpointDir()
    if configured:
        if current is None:
            sc.setCheckpointDir(configured)
        return configured
    if current is not None:
        return current
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a shared folder before running an optimizer")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="gradloom-checkpoint-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialize ``df`` reliably and forget how it was made."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
