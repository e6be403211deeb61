"""Feature rows are worked out once, however many placements and batches read them."""

import pytest
from pyspark.sql import functions as F

from gradloom.operators.batches import BatchCycle
from gradloom.plans import objectives as O

ROWS, BATCHES = 40, 4


def counted(spark, counter):
    def pass_on(batches):
        for b in batches:
            counter.add(b.num_rows)
            yield b

    ex = F.col("id")
    rows = spark.range(ROWS).select((ex % 16).alias("ex_id"), (ex % 7).alias("fea_id"), (ex / 9.0).alias("value"))
    return rows, rows.mapInArrow(pass_on, rows.schema)


def targets(spark):
    ex = F.col("id")
    return spark.range(16).select(ex.alias("ex_id"), (ex / 5.0).alias("label"), (ex % 2 + 1.0).alias("weight"))


def cells(grad):
    return {r["idx"]: r["g"] for r in grad.collect()}


def test_both_placements(spark, monkeypatch):
    monkeypatch.setattr("gradloom.plans.joins.BROADCAST_ROWS", 0)
    counter = spark.sparkContext.accumulator(0)
    plain, features = counted(spark, counter)
    x = spark.range(7).select(F.col("id").alias("idx"), (F.col("id") / 3.0).alias("v"))
    value, grad = O.linear_l2(BatchCycle(targets(spark), features), 7).value_grad(x)
    found = cells(grad)
    assert counter.value == ROWS
    monkeypatch.undo()
    expected, other = O.linear_l2(BatchCycle(targets(spark), plain), 7).value_grad(x)
    assert value == pytest.approx(expected, rel=1e-12) and found == pytest.approx(cells(other), rel=1e-12)


def test_batches_of_features_without_a_number(spark):
    counter = spark.sparkContext.accumulator(0)
    plain, features = counted(spark, counter)
    number = (F.col("ex_id") % BATCHES).alias("batch_id")
    given, own = targets(spark).select("*", number), plain.select("*", number)
    x = spark.range(7).select(F.col("id").alias("idx"), (F.col("id") / 3.0).alias("v"))
    cycles = BatchCycle(given, features, BATCHES), BatchCycle(given, own, BATCHES)
    models = [O.linear_l2(c, 7) for c in cycles]
    for _ in range(BATCHES + 1):
        (v1, g1), (v2, g2) = (m.value_grad(x) for m in models)
        assert v1 == pytest.approx(v2, rel=1e-12) and cells(g1) == pytest.approx(cells(g2), rel=1e-12)
    assert counter.value == ROWS
    cycles[0].free()
    assert cycles[0]._numbered is None
