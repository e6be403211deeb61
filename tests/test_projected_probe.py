"""Steps of a projected search are scored together; the taken step's gradient is used again."""

import pytest
from pyspark.sql import functions as F

from gradloom.operators import gradients as G
from gradloom.operators.batches import HOLD, NO_HOLD, BatchCycle
from gradloom.plans import objectives as O
from gradloom.plans import optimizers as M

N, DIM = 60, 7


@pytest.fixture(scope="module")
def rows(spark):
    examples = spark.range(N).select(F.col("id").alias("ex_id"), ((F.col("id") * 7 % 11) / 4.0 - 1).alias("label"), (1.0 + F.col("id") % 3).alias("weight"))
    features = spark.range(N * 3).select(
        (F.col("id") % N).alias("ex_id"), (F.col("id") * 5 % DIM).alias("fea_id"), (((F.col("id") * 13) % 17) / 8.0 - 1).alias("value")
    )
    features = features.where("ex_id <> 9").groupBy("ex_id", "fea_id").agg(F.sum("value").alias("value"))  # example 9 has none
    return examples, features


def points(spark, classes=None):
    table = spark.range(DIM).select(F.col("id").alias("idx"))
    if classes:
        table = table.crossJoin(spark.range(classes).select(F.col("id").cast("int").alias("k")))
    k = F.col("k") if classes else F.lit(0)
    return table.select("*", *[F.sin(F.col("idx") * (n + 1) + k).alias(f"p{n}") for n in range(3)])


def compare(model, table):
    names = ["p0", "p1", "p2"]
    assert model.tries_at_once()
    trials = model.trials(table, names)
    values, keys = trials.values(), list(model.keys)
    for n, name in enumerate(names):
        value, grad = model.value_grad(table.select(*keys, F.col(name).alias("v")))
        assert values[n] == pytest.approx(value, rel=1e-12)
        want = {tuple(r[:-1]): r[-1] for r in grad.select(*keys, "g").collect()}
        got = {tuple(r[:-1]): r[-1] for r in trials.gradient(n).select(*keys, "g").collect()}
        assert {k: got.get(k, 0.0) for k in want} == pytest.approx(want, abs=1e-12)
    trials.close()
    model.tidy()


def test_trials_equal_evaluations(spark, rows):
    examples, features = rows
    linear = O.linear_l2(BatchCycle(examples, features), DIM)
    compare(linear, points(spark))
    compare(O.Combined(0.7, linear, 0.3, O.Combined(2.0, O.L2Penalty(), 0.5, O.L1Penalty())), points(spark))
    targets = G.wide_targets(examples.select("ex_id", (F.col("ex_id") % 4).cast("int").alias("cls"), F.lit(1.5).alias("tw"), "weight"), 4)
    compare(O.linear_softmax(BatchCycle(targets, features), DIM, 4), points(spark, 4))


def reference(examples, features, l1, steps):
    """The whole run in numpy: full evaluations, one step at a time."""
    import numpy as np

    a = np.zeros((N, DIM))
    for r in features.collect():
        a[r["ex_id"], r["fea_id"]] += r["value"]
    e = {r["ex_id"]: r for r in examples.collect()}
    y, w = (np.array([e[i][c] for i in range(N)]) for c in ("label", "weight"))

    def f(x):
        s = a @ x - y
        return (w * s * s).sum() / w.sum(), 2 * a.T @ (w * s) / w.sum()

    def pseudo(x, g):
        return np.where(x != 0, g + l1 * np.sign(x), np.where(g + l1 < 0, g + l1, np.where(g - l1 > 0, g - l1, 0)))

    x, out = np.zeros(DIM), []
    value, g = f(x)
    pairs = []
    for n in range(steps):
        pg = pseudo(x, g)
        q, weights = pg.copy(), []
        for s, t in reversed(pairs):
            weights.append(s @ q / (s @ t))
            q -= weights[-1] * t
        if pairs:
            q *= (pairs[-1][0] @ pairs[-1][1]) / (pairs[-1][1] @ pairs[-1][1])
        for (s, t), b in zip(pairs, reversed(weights)):
            q += (b - t @ q / (s @ t)) * s
        d = np.where(np.sign(-q) == np.sign(-pg), -q, 0)
        home = np.where(x != 0, x, -pg)

        def at(alpha):
            p = np.where(np.sign(x + alpha * d) == np.sign(home), x + alpha * d, 0)
            v, gp = f(p)
            return p, v, gp, v + l1 * abs(p).sum(), pseudo(p, gp) @ d

        start, slope = value + l1 * abs(x).sum(), pg @ d
        alpha, shrink = 1.0, 0.1 if n < 1 else 0.5
        for _ in range(10):
            p, v, gp, total, along = at(alpha)
            if not total <= start + 1e-4 * alpha * slope:
                alpha *= shrink
            elif along < 0.9 * slope:
                alpha *= 2
            elif along > -0.9 * slope:
                alpha *= shrink
            else:
                break
        pairs = [*pairs, (p - x, gp - g)][-5:]
        x, value, g = p, v, gp
        out.append((alpha, value + l1 * abs(x).sum()))
    return x, out


@pytest.mark.parametrize("policy", [HOLD, NO_HOLD])
def test_run_equals_numpy(spark, rows, policy):
    examples, features = rows
    model = O.linear_l2(BatchCycle(examples, features, policy=policy), DIM)
    state = M.OWLQN(5, 0.05, max_iter=4, tolerance=0.0, lower_fun_tolerance=1e9).minimize(model, spark.range(DIM).select(F.col("id").alias("idx"), F.lit(0.0).alias("v")))
    x, steps = reference(examples, features, 0.05, state.iteration)
    assert [r["alpha"] for r in state.trace] == [a for a, _ in steps]
    assert [r["adjusted_value"] for r in state.trace] == pytest.approx([v for _, v in steps], rel=1e-9)
    assert {r["idx"]: r["x"] for r in state.table.collect()} == pytest.approx(dict(enumerate(x)), abs=1e-9)
    assert (x == 0).any()


def test_one_scoring_pass_serves_a_search(spark, rows):
    """No evaluation after the first; a probe's steps are one trial table, and few of their gradients are worked out."""
    examples, features = rows
    calls = {"evaluate": 0, "trials": 0, "gradient": 0}

    class Counted(O.LinearModel):
        def evaluate(self, x):
            calls["evaluate"] += 1
            return super().evaluate(x)

        def trials(self, table, names):
            calls["trials"] += 1
            got = super().trials(table, names)
            push = got.push

            def counted(n):
                calls["gradient"] += 1
                return push(n)

            got.push = counted
            return got

    model = Counted(BatchCycle(examples, features), DIM, O.L.SQUARED)
    start = spark.range(DIM).select(F.col("id").alias("idx"), F.lit(0.0).alias("v"))
    method = M.OWLQN(5, 0.05, max_iter=4, tolerance=0.0, lower_fun_tolerance=1e9)
    state = method.minimize(model, start)
    assert calls["evaluate"] == 1
    assert calls["trials"] <= 2 * state.iteration
    assert state.iteration <= calls["gradient"] <= 2 * state.iteration


def test_jobs_of_an_iteration(spark, rows):
    examples, features = rows
    model = O.linear_l2(BatchCycle(examples, features), DIM)
    start = spark.range(DIM).select(F.col("id").alias("idx"), F.lit(0.0).alias("v"))
    tracker, counts, trace = spark.sparkContext.statusTracker(), [], None
    spark.sparkContext.setJobGroup("owlqn-jobs", "test")
    for state in M.OWLQN(5, 0.05, max_iter=5, tolerance=0.0, lower_fun_tolerance=1e9).iterations(model, start):
        counts.append(len(tracker.getJobIdsForGroup("owlqn-jobs")))
        trace = state.trace
    spark.sparkContext.setJobGroup("", "")
    plain = [b - a for a, b, row in zip(counts[1:], counts[2:], trace[1:]) if row["alpha"] == 1.0]
    print(counts, [r["alpha"] for r in trace])
    assert plain and max(plain) <= 20
