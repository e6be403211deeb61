"""Block functions over matrices, and negatives by epoch and by round."""

import math

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from gradloom.operators import ranking as K
from gradloom.operators import vectors as V
from gradloom.operators.batches import REFRESH, Batch, BatchCycle
from gradloom.plans import objectives as O
from gradloom.plans import optimizers as M


def mat(spark, cells):
    return spark.createDataFrame([(i, k, float(v)) for i, k, v in cells], "idx bigint, k int, v double")


def as_cells(df):
    return {(r["idx"], r["k"]): r["v"] for r in df.collect()}


def test_matrix_blocks_against_numpy(spark):
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=(3, 50)), rng.normal(size=(3, 50))
    cells = lambda m: [(j, k, m[k, j]) for k in range(3) for j in range(50)]
    left, right = mat(spark, cells(a)), mat(spark, cells(b))
    for block in (1, 7, 50, 1000):
        got = as_cells(V.map_matrix_blocks(left, 3, block, lambda x, y: x * y.max(axis=0), right))
        want = a * b.max(axis=0)
        assert got == {(j, k): want[k, j] for k in range(3) for j in range(50)}
        keyed = as_cells(V.map_matrix_blocks(left, 3, block, lambda i, x: x[::-1] + i, keyed=True))
        assert keyed == {(j, k): a[2 - k, j] + j for k in range(3) for j in range(50)}


def test_absent_matrix_entries_are_zero_and_bad_ones_fail(spark):
    one, two = mat(spark, [(0, 1, 2.0), (9, 0, 5.0)]), mat(spark, [(4, 1, 3.0)])
    assert as_cells(V.map_matrix_blocks(one, 2, 4, lambda x: x + 1)) == {(0, 0): 1, (0, 1): 3, (9, 0): 6, (9, 1): 1}
    both = as_cells(V.map_matrix_blocks(one, 2, 4, lambda x, y: x + 10 * y, two))
    assert both == {(0, 0): 0, (0, 1): 2, (4, 0): 0, (4, 1): 30, (9, 0): 5, (9, 1): 0}
    empty = mat(spark, [])
    assert as_cells(V.map_matrix_blocks(empty, 2, 4, lambda x: x + 1)) == {}
    assert as_cells(V.map_matrix_blocks(empty, 2, 4, lambda x, y: x + y, two)) == {(4, 0): 0, (4, 1): 3}
    for bad, message in (([(0, 2, 1.0)], "outside"), ([(0, 0, 1.0), (0, 0, 2.0)], "repeated"), ([(0, None, 1.0)], "outside")):
        table = spark.createDataFrame(bad, "idx bigint, k int, v double")
        with pytest.raises(PySparkException, match=message):
            V.map_matrix_blocks(table, 2, 4, lambda x: x).collect()
    with pytest.raises(PySparkException, match="shape"):
        V.map_matrix_blocks(one, 2, 4, lambda x: x[0]).collect()
    vec = spark.createDataFrame([(0, 1.0), (1, 2.0)], "idx bigint, v double")
    with pytest.raises(PySparkException, match="shape"):
        V.map_blocks(vec, 4, lambda v: v[:1]).collect()


LINKS, ROUNDS, PER_ROUND, ITEMS = 40, 3, 2, 12


def model(spark, batches=1, policy="hold", fresh=True):
    pos = spark.range(LINKS).select(
        F.col("id").alias("link_id"), F.col("id").alias("ex_id"), (F.col("id") % ITEMS).alias("item"),
        F.lit(1.0).alias("weight"), F.lit(1.0).alias("rel_weight"), (F.col("id") % batches).cast("int").alias("batch_id"))
    cycle = BatchCycle(pos, num_batches=batches, policy=policy, keys=["link_id"])

    def fea(e):
        user = F.lit(ITEMS).cast("bigint") + F.col("link_id") % 4
        return e.select(*K.RANK_KEYS, F.explode(F.array("item", user)).alias("fea_id"), F.lit(1.0).alias("value"))

    draw = lambda p: K.neg_sample(p, ROUNDS, PER_ROUND, K.uniform_items(ITEMS, ROUNDS, PER_ROUND))
    return O.fm_pair_ranking(cycle, ITEMS + 4, 2, draw, fea, fresh)


def start(spark):
    dim = ITEMS + 4
    return mat(spark, [(i, k, ((i * 5 + k * 3) % 7 - 3) / 4.0) for i in range(dim) for k in range(2)])


def test_epochs_draw_anew_and_held_ones_do_not(spark):
    objective, x = model(spark), start(spark)
    first = objective.value(x)
    with objective.cycle.held():
        assert objective.value(x) == pytest.approx(first, rel=1e-12)
    kept = objective.cursor()
    second = objective.value(x)
    assert abs(second - first) > 1e-6 and objective.cycle.epoch == 1
    other = model(spark)
    other.restore(kept)  # a run that is resumed draws what would have come next
    assert other.value(x) == pytest.approx(second, rel=1e-12)
    fixed = model(spark, fresh=False)
    assert fixed.value(x) == pytest.approx(fixed.value(x), rel=1e-12)


def test_epochs_move_with_the_cycle(spark):
    objective, x = model(spark, batches=2), start(spark)
    values = [objective.value(x) for _ in range(4)]
    assert objective.cycle.epoch == 1
    assert abs(values[0] - values[2]) > 1e-6 and abs(values[1] - values[3]) > 1e-6


@pytest.mark.parametrize("policy", ["hold", REFRESH, "no_hold"])
def test_fits_with_fresh_negatives(spark, policy):
    objective = model(spark, policy=policy)
    state = M.LBFGS(3, max_iter=3, max_search=30).minimize(objective, start(spark))
    assert math.isfinite(state.value) and objective.cycle.epoch >= 1


def test_rounds_add_up_with_one_of_them_kept(spark, monkeypatch):
    live, most = {}, []
    load, release = Batch.load, Batch.release

    def loading(self):
        out = load(self)
        if "iter" in self.keys:
            live[id(self)] = self.targets.count()
            most.append(sum(live.values()))
        return out

    def releasing(self):
        live.pop(id(self), None)
        release(self)

    objective, x = model(spark, fresh=False), start(spark)
    value, grad = objective.evaluate(x)
    want = as_cells(grad.withColumnRenamed("g", "v"))
    objective._sampled[1].release()
    monkeypatch.setattr(Batch, "load", loading)
    monkeypatch.setattr(Batch, "release", releasing)
    got_value, got = objective.evaluate_rounds(x, ROUNDS)
    assert max(most) == LINKS * (1 + PER_ROUND) and not live
    assert got_value == pytest.approx(value, rel=1e-12)
    got = as_cells(got.withColumnRenamed("g", "v"))
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)
