"""Saved runs: versions on disk, unfinished ones, and where the objective goes on."""

import os

import pytest
from pyspark.sql import functions as F

from gradloom.operators.batches import BatchCycle
from gradloom.plans import objectives as O
from gradloom.plans import optimizers as M
from gradloom.plans.runs import RunStore


def model(spark, batches=3):
    examples = spark.createDataFrame([(i, float(i % 5), 1.0, i % batches) for i in range(30)], "ex_id bigint, label double, weight double, batch_id bigint")
    features = examples.select("ex_id", (F.col("ex_id") % 4).alias("fea_id"), F.lit(1.0).alias("value"), "batch_id")
    return O.linear_l2(BatchCycle(examples, features, batches), 4)


@pytest.fixture(scope="module")
def x0(spark):
    return spark.createDataFrame([(i, 0.0) for i in range(4)], "idx bigint, v double")


def points(state):
    return {r["idx"]: r["x"] for r in state.table.collect()}


def test_stopped_anywhere_the_run_ends_the_same(spark, x0, tmp_path):
    method = lambda n: M.LBFGS(2, fixed_steps=[0.2] * 9, max_iter=n, lower_fun_tolerance=1e9)
    whole = method(5).minimize(model(spark), x0)
    for stop in (1, 3):
        store = RunStore(spark, f"file://{tmp_path}/{stop}")
        assert store.resume(model(spark)) is None
        method(stop).minimize(model(spark), x0, store=store)
        state = method(5).minimize(model(spark), x0, store=store)
        assert points(state) == pytest.approx(points(whole), rel=1e-12)
        assert (state.value, state.iteration, state.history) == (pytest.approx(whole.value), 5, 2)
        assert [t["iter"] for t in state.trace] == [1, 2, 3, 4, 5]
        # One version stays, and nothing else.
        names = [n for n in os.listdir(tmp_path / str(stop)) if not n.endswith(".crc")]
        assert sorted(n.split("-")[0] for n in names) == ["manifest", "table"] and len(store.versions()) == 1


def test_what_was_not_committed_is_not_read(spark, x0, tmp_path):
    store = RunStore(spark, f"file://{tmp_path}/run", keep=2)
    objective = model(spark)
    state = M.GradientDescent(0.1, 0.5, 0.5, max_iter=2, lower_fun_tolerance=1e9).minimize(objective, x0)
    first = store.save(state, objective)
    state.table.limit(0).write.parquet(f"file://{tmp_path}/run/table-{first + 1}")  # a run that died before its manifest
    assert store.versions() == [first] and store.load().table.count() == 4
    second = store.save(state, objective)
    assert second == first + 2 and store.versions() == [first, second]
    third = store.save(state, objective)
    assert store.versions() == [second, third]
    assert not os.path.exists(tmp_path / f"run/table-{first + 1}")
    assert store.load(version=second).iteration == 2
    with pytest.raises(FileNotFoundError):
        store.load(version=first)
    with pytest.raises(FileNotFoundError):
        RunStore(spark, f"file://{tmp_path}/none").load()


def test_cursors(spark, x0, tmp_path):
    objective = O.Combined(1.0, model(spark), 0.1, O.L2Penalty(("idx",)))
    objective.evaluate(x0)
    objective.evaluate(x0)
    kept = objective.cursor()
    again = O.Combined(1.0, model(spark), 0.1, O.L2Penalty(("idx",)))
    again.restore(kept)
    assert again.parts[0][1].cycle.current.number == 1
    assert again.evaluate(x0)[0] == pytest.approx(objective.evaluate(x0)[0])
    with pytest.raises(ValueError, match="3 batches, resumed with 2"):
        model(spark, 2).restore(kept[0])
