"""Softmax with classes as rows against the one with classes as columns."""

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from gradloom.operators import gradients as G
from gradloom.operators.batches import BatchCycle
from gradloom.plans import joins as J
from gradloom.plans import objectives as O
from gradloom.plans import optimizers as M

DIM, CLASSES = 4, 5


def tables(spark, seed=5):
    rng = np.random.default_rng(seed)
    fea = [(e, f, float(rng.normal() * 30)) for e in range(12) for f in range(DIM) if e != 3 and rng.random() < 0.7]
    targets = [(e, int(rng.integers(CLASSES)), float(rng.random() + 0.1), 1.0 + e % 3) for e in range(12) for _ in range(2)]
    targets += [(0, targets[0][1], 0.5, 1.0)]  # a class given twice; example 3 has no feature
    x = [(i, k, float(rng.normal())) for i in range(DIM) for k in range(CLASSES)]
    return (spark.createDataFrame(targets, "ex_id bigint, cls int, tw double, weight double"),
            spark.createDataFrame(fea, "ex_id bigint, fea_id bigint, value double"), spark.createDataFrame(x, "idx bigint, k int, v double"))


def as_cells(df, col):
    return {(r["idx"], r["k"]): r[col] for r in df.collect()}


@pytest.mark.parametrize("bound", [J.BROADCAST_ROWS, 0])
def test_equals_the_wide_form(spark, monkeypatch, bound):
    monkeypatch.setattr(J, "BROADCAST_ROWS", bound)
    targets, fea, x = tables(spark)
    wide = O.linear_softmax(BatchCycle(G.wide_targets(targets, CLASSES), fea), DIM, CLASSES)
    long = O.linear_softmax_long(BatchCycle(targets, fea), DIM, CLASSES)
    (v1, g1), (v2, g2) = wide.value_grad(x), long.value_grad(x)
    assert v2 == pytest.approx(v1, rel=1e-12) and long.value(x) == pytest.approx(v1, rel=1e-12)
    g1, g2 = as_cells(g1, "g"), as_cells(g2, "g")
    assert g1.keys() == g2.keys() and all(g2[k] == pytest.approx(g1[k], abs=1e-11) for k in g1)
    xd = x.select("idx", "k", F.col("v").alias("x"), (F.col("v") * 0.3 - F.col("k") * 0.1).alias("d"))
    lines = wide.line(xd), long.line(xd)
    for one, two in zip(*(line.probe([0.0, 0.4, 1.7]) for line in lines)):
        assert two == pytest.approx(one, rel=1e-9)
    ends = [as_cells(line.finish(0.4), "g") for line in lines]
    assert all(ends[1][k] == pytest.approx(ends[0][k], abs=1e-11) for k in ends[0])


def test_fits_and_refuses(spark):
    targets, fea, x = tables(spark)
    zero = x.withColumn("v", F.lit(0.0))
    states = [M.LBFGS(3, max_iter=2, max_search=30).minimize(model, zero) for model in (
        O.linear_softmax(BatchCycle(G.wide_targets(targets, CLASSES), fea), DIM, CLASSES),
        O.linear_softmax_long(BatchCycle(targets, fea), DIM, CLASSES))]
    assert states[1].value == pytest.approx(states[0].value, rel=1e-9)
    bad = targets.withColumn("cls", F.lit(CLASSES))
    with pytest.raises(PySparkException, match="target class outside"):
        O.linear_softmax_long(BatchCycle(bad, fea), DIM, CLASSES).value(x)
    with pytest.raises(PySparkException, match="null target weight"):
        O.linear_softmax_long(BatchCycle(targets.withColumn("tw", F.lit(None).cast("double")), fea), DIM, CLASSES).value(x)


def test_cells_stay_where_their_examples_lie(spark, monkeypatch):
    """The sums leave a task, not a row for each example and class; whatever part of the examples a task works on at a time."""
    targets, fea, x = tables(spark)
    model = O.linear_softmax_long(BatchCycle(targets, fea), DIM, CLASSES)
    value, grad = model.evaluate(x)
    sums = model._cached[-1]
    tasks = model._examples(model.cycle.current).rdd.getNumPartitions()
    assert sums.count() <= tasks * (1 + DIM) and "Window" not in sums._jdf.queryExecution().toString()
    cells = as_cells(grad, "g")
    monkeypatch.setattr("gradloom.operators.classes.CELLS", 1)
    again, other = O.linear_softmax_long(BatchCycle(targets, fea), DIM, CLASSES).evaluate(x)
    assert again == pytest.approx(value, rel=1e-12) and as_cells(other, "g") == pytest.approx(cells, abs=1e-12)
