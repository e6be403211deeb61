"""Table layouts and in-plan checks.

=============  =====================================================
vector         ``idx BIGINT, v DOUBLE``, dense on ``[0, dim)``
matrix         ``idx BIGINT, k INT, v DOUBLE`` (``row_dim`` values of k)
examples       ``ex_id BIGINT, label, weight DOUBLE``
features       ``ex_id BIGINT, fea_id BIGINT, value DOUBLE``
multi targets  ``ex_id BIGINT, cls INT, tw DOUBLE, weight DOUBLE``
=============  =====================================================
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def require(df: DataFrame, *checks: tuple[Column, str]) -> DataFrame:
    """Fail the query on the first row that breaks a check.

    The checks are a filter, so no later column pruning can drop them.
    """
    for ok, message in checks:
        holds = F.coalesce(ok, F.lit(False))
        df = df.filter(holds | F.raise_error(F.lit(message)).cast("boolean"))
    return df


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; have {df.columns}")
    return df


def in_range(col: Column, size: int) -> Column:
    return (col >= 0) & (col < F.lit(size))


def vector_violations(rows: DataFrame, dim: int) -> DataFrame:
    """Entries outside ``[0, dim)``, not finite, or repeated: ``idx, n, reason``."""
    bad_value = F.isnull("v") | F.isnan("v")
    per_idx = rows.groupBy("idx").agg(
        F.count(F.lit(1)).alias("n"), F.max(bad_value.cast("int")).alias("bad")
    )
    reason = (
        F.when(~in_range(F.col("idx"), dim), "index")
        .when(F.col("bad") == 1, "value")
        .when(F.col("n") > 1, "repeated")
    )
    return per_idx.select("idx", "n", reason.alias("reason")).filter("reason IS NOT NULL")


def class_violations(targets: DataFrame, row_dim: int) -> DataFrame:
    """Target rows whose class id is outside ``[0, row_dim)``."""
    return targets.filter(~in_range(F.col("cls"), row_dim))


def require_dense(table: DataFrame, keys: Sequence[str], extent: dict[str, int]) -> None:
    """Fail unless no key repeats and, where ``extent`` gives the number of a key's values, each of them is there."""
    inside = F.lit(True)
    for key, size in extent.items():
        inside = inside & in_range(F.col(key), size)
    per_key = table.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.first(F.coalesce(inside, F.lit(False))).alias("inside"))
    facts = per_key.agg(F.max("n").alias("most"), F.count(F.lit(1)).alias("keys"), F.min("inside").alias("inside")).first()
    if facts["most"] is not None and facts["most"] > 1:
        raise ValueError(f"a coordinate of the start is given {facts['most']} times")
    if extent and facts["keys"] and not facts["inside"]:
        raise ValueError(f"the start has coordinates outside {extent}")
    if extent and facts["keys"] != math.prod(extent.values()):
        raise ValueError(f"the start has {facts['keys']} of {math.prod(extent.values())} coordinates")
