"""Edge inputs, skewed keys, finite differences, searches and failure handling."""

import math

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from gradloom.functions import losses as L
from gradloom.operators import gradients as G
from gradloom.operators import ranking as K
from gradloom.operators import scoring as S
from gradloom.operators import transport as T
from gradloom.operators.batches import BatchCycle
from gradloom.plans import joins as J
from gradloom.plans import objectives as O
from gradloom.plans import optimizers as M
from gradloom.plans.linesearch import Backtracking, LineSearchFailed, Probes, StepUnderflow, StrongWolfe
from gradloom.schemas import vector_violations
from gradloom.sources.builders import matrix_from_rows, vector_from_rows


def vec(spark, values):
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "idx bigint, v double")


def features(spark, rows):
    return spark.createDataFrame([(e, f, float(v)) for e, f, v in rows], "ex_id bigint, fea_id bigint, value double")


def as_array(df, col="v"):
    return np.array([r[col] for r in df.orderBy("idx").collect()])


# --- builders and checks -------------------------------------------------------


def test_vector_rows_are_checked(spark):
    rows = spark.createDataFrame([(0, 1.0), (2, 2.0), (2, 3.0)], "idx bigint, v double")
    assert as_array(vector_from_rows(spark, rows, 4, "sum")).tolist() == [1.0, 0.0, 5.0, 0.0]
    with pytest.raises(PySparkException, match="repeated index"):
        vector_from_rows(spark, rows, 4).collect()
    with pytest.raises(PySparkException, match="outside"):
        vector_from_rows(spark, rows, 2, "sum").collect()
    reasons = {r["idx"]: r["reason"] for r in vector_violations(rows, 2).collect()}
    assert reasons == {2: "index"}


def test_matrix_rows_are_checked(spark):
    rows = spark.createDataFrame([(1, [1.0, 2.0])], "idx bigint, v array<double>")
    assert sorted(map(tuple, matrix_from_rows(spark, rows, 2, 2).collect())) == [(0, 0, 0.0), (0, 1, 0.0), (1, 0, 1.0), (1, 1, 2.0)]
    with pytest.raises(PySparkException, match="wrong length"):
        matrix_from_rows(spark, rows, 2, 3).collect()


def test_empty_and_saturated_scores(spark):
    empty = features(spark, [])
    assert S.score_linear(empty, vec(spark, [1.0]), 1).count() == 0
    rows = spark.createDataFrame([(0, True, 1.0, -800.0), (1, False, 1.0, 800.0), (2, True, 1.0, 800.0)],
                                 "ex_id bigint, label boolean, weight double, score double")
    args = F.col("score"), F.col("label"), F.col("weight")
    got = rows.select(L.LOGISTIC.value(*args).alias("v"), L.LOGISTIC.slope(*args).alias("s")).collect()
    assert all(math.isfinite(r["v"]) and math.isfinite(r["s"]) for r in got)
    assert got[0]["v"] == pytest.approx(-math.log(1e-24)) and got[2]["v"] == pytest.approx(0.0)


def test_link_violations(spark):
    pos = spark.createDataFrame([(1,), (1,), (2,)], "link_id bigint")
    neg = spark.createDataFrame([(2,), (3,)], "link_id bigint")
    assert sorted(map(tuple, K.link_violations(pos, neg).collect())) == [(1, "repeated positive"), (3, "no positive")]


# --- skew -----------------------------------------------------------------------


def test_hot_key_is_spread_over_all_of_many_partitions(spark):
    """A third of the rows on one key: no partition of 200 holds twice the mean, and the pieces follow the count."""
    n, parts = 1_000_000, 200
    key = F.when(F.col("id") % 3 == 0, F.lit(7)).when(F.col("id") % 50 == 1, F.lit(8)).otherwise(F.col("id") + 100).cast("bigint")
    rows = spark.range(n).select(key.alias("k"), F.col("id").alias("r"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        spread = J.SpreadRows(rows, ["k"])
        per_task = spread.rows.repartition(parts, "k", "__salt").groupBy(F.spark_partition_id()).count()
        assert per_task.agg(F.max("count")).first()[0] < 2 * n / parts
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted(spread.fan.values()) == [64, 2048]  # 2 % of the rows are 2.7 partitions, a third is 67
    assert sum(J.pieces(parts / k) for k in range(1, 2 * parts)) < 2 * J.PIECES * parts * sum(1 / k for k in range(1, 2 * parts)) + 4 * parts
    table = rows.select("k").distinct().withColumn("t", F.col("k") * 2)
    got = spread.join(table).agg(F.count("*"), F.sum((F.col("t") != F.col("k") * 2).cast("int"))).first()
    assert tuple(got) == (n, 0)


def test_keys_of_null_and_of_no_rows(spark):
    assert J.fan_out(spark.range(0).select(F.col("id").alias("k")), ["k"]) == {}
    nulls = spark.range(30_000).select(F.when(F.col("id") % 2 == 0, F.col("id")).alias("k"), F.col("id").alias("r"))
    spread = J.SpreadRows(nulls, ["k"])
    assert len(spread.fan) == 1
    assert spread.join(spark.range(30_000).select(F.col("id").alias("k"), F.lit(1).alias("t"))).count() == 15_000
    assert spread.join(spark.range(30_000).select(F.col("id").alias("k"), F.lit(1).alias("t")), "left").count() == 30_000


def test_placing_reads_its_input_once_more_than_its_keys(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(len(b))
            yield b

    rows = spark.range(20_000).select((F.col("id") % 9000).alias("k"), F.col("id").alias("r")).mapInPandas(counted, "k bigint, r bigint")
    placed = J.SpreadRows.place(rows, ["k"])
    table = spark.range(9000).select(F.col("id").alias("k"), F.lit(1).alias("t"))
    assert placed.join(table).count() == placed.join(table).count() == 20_000
    assert read.value == 2 * 20_000
    placed.unpersist()


# --- what loading and starting refuse ---------------------------------------------


def linear_case(spark, fea, dim=4):
    ex = spark.createDataFrame([(0, 1.0, 1.0), (1, 2.0, 1.0)], "ex_id bigint, label double, weight double")
    return O.linear_l2(BatchCycle(ex, features(spark, fea)), dim)


@pytest.mark.parametrize("bound", [J.BROADCAST_ROWS, 0])
@pytest.mark.parametrize("bad", [4, -1, None])
def test_feature_ids_outside_the_model_fail(spark, monkeypatch, bad, bound):
    monkeypatch.setattr(J, "BROADCAST_ROWS", bound)
    x = vec(spark, [0.0] * 4)
    assert linear_case(spark, [(0, 0, 1.0), (1, 3, 1.0)]).value(x) > 0
    rows = spark.createDataFrame([(0, 0, 1.0), (1, bad, 1.0)], "ex_id bigint, fea_id bigint, value double")
    ex = spark.createDataFrame([(0, 1.0, 1.0), (1, 2.0, 1.0)], "ex_id bigint, label double, weight double")
    with pytest.raises(PySparkException, match="feature id outside"):
        O.linear_l2(BatchCycle(ex, rows), 4).value(x)


def test_starts_that_are_not_dense_fail(spark):
    model = linear_case(spark, [(0, 0, 1.0), (1, 3, 1.0)])
    run = M.LBFGS(2, max_iter=1)
    for values, message in (([0, 1, 2], "3 of 4"), ([0, 1, 2, 2, 3], "2 times"), ([0, 1, 2, 3, 4], "outside"), ([0, 1, 2, 4], "outside")):
        x = spark.createDataFrame([(i, 0.0) for i in values], "idx bigint, v double")
        with pytest.raises(ValueError, match=message):
            run.minimize(model, x)


def ranking_case(spark, pos, sample=None, **options):
    positives = spark.createDataFrame([(link, i, item, 1.0, 1.0) for i, (link, item) in enumerate(pos)],
                                      "link_id bigint, ex_id bigint, item bigint, weight double, rel_weight double")
    draw = sample or (lambda p: K.neg_sample(p, 2, 3, K.uniform_items(5, 2, 3)))
    fea = lambda e: e.select(*K.RANK_KEYS, F.explode(F.array("item", F.lit(5).cast("bigint") + F.col("link_id") % 2)).alias("fea_id"), F.lit(1.0).alias("value"))
    return O.fm_pair_ranking(BatchCycle(positives, keys=["link_id"]), 7, 2, draw, fea, **options)


def rank_x(spark):
    return spark.createDataFrame([(i, k, ((i * 5 + k * 3) % 7 - 3) / 4.0) for i in range(7) for k in range(2)], "idx bigint, k int, v double")


def test_links_with_two_positives_or_none_fail(spark):
    x = rank_x(spark)
    assert ranking_case(spark, [(0, 1), (1, 2)]).value(x) > 0
    with pytest.raises(PySparkException, match="more than one positive"):
        ranking_case(spark, [(0, 1), (0, 2)]).value(x)
    with pytest.raises(PySparkException, match="without a link"):
        ranking_case(spark, [(0, 1), (None, 2)]).value(x)

    def astray(p):
        return K.neg_sample(p, 2, 3, K.uniform_items(5, 2, 3)).withColumn("link_id", F.col("link_id") + F.when(F.col("i") == 1, 50).otherwise(0))

    with pytest.raises(PySparkException, match="negative without a positive"):
        ranking_case(spark, [(0, 1), (1, 2)], astray).value(x)


def test_hot_key_is_found_split_and_joined_exactly(spark):
    n = 60_000
    key = F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") + 100).cast("bigint")
    rows = spark.range(n).select(key.alias("k"), F.col("id").alias("r"))
    table = rows.select("k").distinct().withColumn("t", F.col("k") * 2)
    placed = J.SpreadRows.place(rows, ["k"])
    assert len(placed.fan) == 1
    per_task = placed.rows.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert per_task < 0.45 * n  # a third sits on one key, of 4 partitions
    for spread in (placed, J.SpreadRows(rows, ["k"])):
        out = spread.join(table)
        assert out.count() == n
        assert out.filter(F.col("t") != F.col("k") * 2).count() == 0
    placed.unpersist()


def test_large_dimension_plan_equals_broadcast_plan(spark, monkeypatch):
    """Linear model with the wide plan, a bias in every example, and one example holding a third of the rows."""
    n = 3000
    many = spark.range(n).select(F.lit(0).cast("bigint").alias("ex_id"), (F.col("id") % 500 + 1).alias("fea_id"), F.lit(0.01).alias("value"))
    many = many.groupBy("ex_id", "fea_id").agg(F.sum("value").alias("value"))
    one = spark.range(1, n).select(F.col("id").alias("ex_id"), F.lit(0).cast("bigint").alias("fea_id"), (F.col("id") % 7 / 7.0).alias("value"))
    fea = many.unionByName(one)
    ex = spark.range(n).select(F.col("id").alias("ex_id"), (F.col("id") % 5).cast("double").alias("label"), F.lit(1.0).alias("weight"))
    x = spark.range(501).select(F.col("id").alias("idx"), (F.col("id") % 11 / 10.0).alias("v"))
    results = []
    monkeypatch.setattr(J, "COLD_ROWS", 0)
    for bound in (J.BROADCAST_ROWS, 0):
        monkeypatch.setattr(J, "BROADCAST_ROWS", bound)
        model = O.linear_l2(BatchCycle(ex, fea), 501)
        state = M.LBFGS(3, max_iter=2, max_search=30).minimize(model, x)
        results.append((state.value, as_array(state.x)))
    assert results[0][0] == pytest.approx(results[1][0], rel=1e-9)
    np.testing.assert_allclose(results[0][1], results[1][1], rtol=1e-8, atol=1e-10)


# --- gradients against finite differences ------------------------------------------


def check_gradient(model, x, keys, step=1e-6, count=3):
    value, grad = model.value_grad(x)
    exact = {tuple(r[k] for k in keys): r["g"] for r in grad.collect()}
    for key in sorted(exact)[:: max(len(exact) // count, 1)]:
        here = F.lit(True)
        for k, part in zip(keys, key):
            here = here & (F.col(k) == F.lit(part))
        up, down = (model.value(x.withColumn("v", F.when(here, F.col("v") + d).otherwise(F.col("v")))) for d in (step, -step))
        assert exact[key] == pytest.approx((up - down) / (2 * step), abs=1e-5)


@pytest.mark.parametrize("loss", [L.SQUARED, L.quantile(0.3), L.LOGISTIC], ids=lambda p: p.name)
def test_linear_gradients(spark, loss):
    rng = np.random.default_rng(1)
    fea = features(spark, [(e, f, rng.normal()) for e in range(20) for f in range(4)])
    label = "boolean" if loss is L.LOGISTIC else "double"
    ys = [bool(e % 2) if loss is L.LOGISTIC else float(e % 3) for e in range(20)]
    ex = spark.createDataFrame([(e, ys[e], 1.0 + e % 2) for e in range(20)], f"ex_id bigint, label {label}, weight double")
    check_gradient(O.LinearModel(BatchCycle(ex, fea), 4, loss), vec(spark, rng.normal(size=4)), ["idx"])


def test_softmax_and_its_line(spark):
    rng = np.random.default_rng(2)
    fea = features(spark, [(e, f, rng.normal()) for e in range(15) for f in range(3)])
    tgt = spark.createDataFrame([(e, (e + c) % 3, w, 1.0) for e in range(15) for c, w in ((0, 0.7), (1, 0.3))],
                                "ex_id bigint, cls int, tw double, weight double")
    model = O.linear_softmax(BatchCycle(G.wide_targets(tgt, 3), fea), 3, 3)
    x = spark.createDataFrame([(i, k, float(rng.normal())) for i in range(3) for k in range(3)], "idx bigint, k int, v double")
    check_gradient(model, x, ["idx", "k"])
    check_line(model, x, ["idx", "k"])


def check_line(model, x, keys, steps=(0.0, 0.3)):
    """Cached probes equal full evaluations."""
    _, grad = model.value_grad(x)
    xd = x.join(grad, keys).select(*keys, F.col("v").alias("x"), (-F.col("g")).alias("d"))
    fast, full = model.line(xd).probe(steps), O.FullLine(model, xd).probe(steps)
    np.testing.assert_allclose(fast, full, rtol=1e-9, atol=1e-12)


def test_ranking_gradient_and_line(spark):
    pos = spark.createDataFrame([(e, e, 1.0, 1.0 + e % 2, e % 4) for e in range(6)],
                                "ex_id bigint, link_id bigint, rel_weight double, weight double, item bigint")

    def featurize(ex):
        item = ex.select(*K.RANK_KEYS, F.col("item").alias("fea_id"), F.lit(1.0).alias("value"))
        context = ex.select(*K.RANK_KEYS, (F.lit(4) + F.col("link_id") % 2).alias("fea_id"), F.lit(0.5).alias("value"))
        return item.unionByName(context)

    model = O.fm_pair_ranking(BatchCycle(pos, keys=["link_id"]), 6, 2,
                              lambda p: K.neg_sample(p, 2, 3, K.uniform_items(4, 2, 3)), featurize)
    rng = np.random.default_rng(3)
    x = spark.createDataFrame([(i, k, float(rng.normal())) for i in range(6) for k in range(2)], "idx bigint, k int, v double")
    check_gradient(model, x, ["idx", "k"])
    check_line(model, x, ["idx", "k"])


def test_transport_against_brute_force(spark):
    rng = np.random.default_rng(4)
    a, b, u, v = rng.random((15, 2)), rng.random((10, 2)), rng.random(15) / 5, rng.random(10) / 5
    points = [spark.createDataFrame([(i, [float(z) for z in p]) for i, p in enumerate(pts)], "id bigint, p array<double>") for pts in (a, b)]
    pair = T.PointPair.of(*points, block=5)
    cost = 0.5 * ((a[:, None] - b[None]) ** 2).sum(2)
    e = np.exp((u[:, None] + v[None] - cost) / 0.1) / 150
    rows = [("u", i, float(z)) for i, z in enumerate(u)] + [("v", i, float(z)) for i, z in enumerate(v)]
    x = spark.createDataFrame(rows, "side string, idx bigint, v double")
    value, grad = O.TransportDual(pair, 0.1).value_grad(x)
    assert value == pytest.approx(0.1 * e.sum() - u.mean() - v.mean())
    got = {(r["side"], r["idx"]): r["g"] for r in grad.collect()}
    np.testing.assert_allclose([got["u", i] for i in range(15)], e.sum(1) - 1 / 15, atol=1e-12)
    np.testing.assert_allclose([got["v", j] for j in range(10)], e.sum(0) - 1 / 10, atol=1e-12)


def test_transport_with_gaps_in_the_ids(spark):
    points = [spark.createDataFrame([(i, [i / 20.0] * 6) for i in ids], "id bigint, p array<double>") for ids in ((0, 10, 20), (0, 7))]
    dual = O.TransportDual(T.PointPair.of(*points), 0.5)
    assert (dual.pair.n, dual.pair.m, dual.zero_potentials().count()) == (3, 2, 5)
    fit = M.LBFGS(5, search=Backtracking(wolfe=False, strong_wolfe=False), base_step=1.0, max_iter=60, tolerance=1e-12)
    mass = T.ot_mass(dual.pair, fit.minimize(dual, dual.zero_potentials()).x.withColumnRenamed("v", "p"), 0.5)
    got = {(r["side"], r["idx"]): r["mass"] for r in mass.collect()}
    assert got == pytest.approx({("u", 0): 1 / 3, ("u", 10): 1 / 3, ("u", 20): 1 / 3, ("v", 0): 0.5, ("v", 7): 0.5}, abs=1e-3)
    with pytest.raises(ValueError, match="both sides"):
        T.PointPair.of(points[0], points[1].limit(0))


def points_and_potentials(spark, n=15, m=10, seed=4):
    rng = np.random.default_rng(seed)
    a, b, u, v = rng.random((n, 3)), rng.random((m, 3)), rng.random(n) / 5, rng.random(m) / 5
    points = [spark.createDataFrame([(i, [float(z) for z in p]) for i, p in enumerate(pts)], "id bigint, p array<double>") for pts in (a, b)]
    cost = 0.5 * ((a[:, None] - b[None]) ** 2).sum(2)
    rows = [("u", i, float(z)) for i, z in enumerate(u)] + [("v", i, float(z)) for i, z in enumerate(v)]
    return points, cost, u, v, spark.createDataFrame(rows, "side string, idx bigint, v double")


@pytest.mark.parametrize("broadcast", [True, False])
def test_tiles_stay_where_they_are(spark, monkeypatch, broadcast):
    points, cost, u, v, x = points_and_potentials(spark)
    if not broadcast:
        monkeypatch.setattr("gradloom.plans.joins.BROADCAST_ROWS", 0)
    pair = T.PointPair.of(*points, block=4)
    pair.tiles.count()
    plan = T.with_potentials(pair, x.withColumnRenamed("v", "p"), ["p"])._jdf.queryExecution().executedPlan().toString()
    # Coordinates occur in the kept store, and in no exchange above it.
    above = plan.split("InMemoryRelation")[0] + "".join(part.split("Initial Plan")[-1] for part in plan.split("InMemoryRelation")[2:])
    assert "InMemoryTableScan" in plan and all("xp" not in line for line in above.splitlines() if "Exchange" in line)
    mass = {(r["side"], r["idx"]): r["mass"] for r in T.ot_mass(pair, x.withColumnRenamed("v", "p"), 0.1).collect()}
    e = np.exp((u[:, None] + v[None] - cost) / 0.1) / cost.size
    want = {("u", i): z for i, z in enumerate(e.sum(1))} | {("v", j): z for j, z in enumerate(e.sum(0))}
    assert mass == pytest.approx(want, rel=1e-12)
    pair.close()


def test_taken_step_costs_no_other_pass(spark):
    points, cost, u, v, x = points_and_potentials(spark)
    for log in (False, True):
        dual = O.TransportDual(T.PointPair.of(*points, block=6), 0.1, log=log)
        xd = x.withColumnRenamed("v", "x").withColumn("d", F.sin("idx"))
        line = dual.line(xd)
        (value, slope), (further, steeper) = line.probe([0.5, 1.0])
        at = lambda a: xd.select("side", "idx", (F.col("x") + a * F.col("d")).alias("v"))
        want, grad = dual.value_grad(at(0.5))
        assert value == pytest.approx(want, rel=1e-9) and further == pytest.approx(dual.value_grad(at(1.0))[0], rel=1e-9)
        got = {(r["side"], r["idx"]): r["g"] for r in line.finish(0.5).collect()}
        assert got == pytest.approx({(r["side"], r["idx"]): r["g"] for r in grad.collect()}, abs=1e-12)
        assert line.finish(1.0) is None
        for a, s in ((0.5, slope), (1.0, steeper)):
            up, down = dual.value_grad(at(a + 1e-5))[0], dual.value_grad(at(a - 1e-5))[0]
            assert s == pytest.approx((up - down) / 2e-5, rel=1e-4)
        line.close()


def test_transport_where_exponentials_leave_doubles(spark):
    points, cost, *_ = points_and_potentials(spark)
    eps = 2e-4
    pair = T.PointPair.of(*points, block=7)
    dual = O.TransportDual(pair, eps, log=True)
    x = dual.zero_potentials()
    x = x.withColumn("v", F.when(F.col("side") == "u", 0.7).otherwise(0.0))
    value, grad = dual.value_grad(x)
    z = (0.7 - cost) / eps
    lse = z.max() + np.log(np.exp(z - z.max()).mean())
    assert value == pytest.approx(eps * lse - 0.7)
    share = np.exp(z - z.max() - np.log(np.exp(z - z.max()).sum())).sum(1)
    got = {r["idx"]: r["g"] for r in grad.where("side = 'u'").collect()}
    np.testing.assert_allclose([got[i] for i in range(15)], share - 1 / 15, atol=1e-12)
    # Balancing gives one side its exact mass, from wherever the exponentials were.
    balanced = T.ot_balance(pair, x.withColumnRenamed("v", "p"), eps, "v")
    mass = {r["idx"]: r["mass"] for r in T.ot_mass(pair, balanced, eps).where("side = 'v'").collect()}
    assert mass == pytest.approx({j: 0.1 for j in range(10)}, rel=1e-9)
    # The fit in logarithms reaches both marginals.
    dual = O.TransportDual(T.PointPair.of(*points), 0.02, log=True)
    fit = M.LBFGS(5, search=Backtracking(wolfe=False, strong_wolfe=False), base_step=0.1, max_iter=30, tolerance=1e-9)
    state = fit.minimize(dual, dual.zero_potentials())
    total = state.gradient.agg(F.max(F.abs("g"))).first()[0]
    assert total < 5e-3


def test_near_points_far_from_the_origin():
    x = np.full((1, 64), 1e8)
    assert T.half_squared_distance(x, x + 0.5)[0, 0] == 8.0


def test_classes_out_of_range_and_nulls_fail(spark):
    targets = spark.createDataFrame([(1, 7, 1.0, 1.0)], "ex_id bigint, cls int, tw double, weight double")
    with pytest.raises(PySparkException, match="target class"):
        G.wide_targets(targets, 3).collect()
    features = spark.createDataFrame([(1, 0, 1.0), (2, 0, 1.0)], "ex_id bigint, fea_id bigint, value double")
    x = spark.createDataFrame([(0, 0.0)], "idx bigint, v double")
    for row in ((2, None, 1.0), (2, 1.0, None)):
        examples = spark.createDataFrame([(1, 1.0, 1.0), row], "ex_id bigint, label double, weight double")
        with pytest.raises(PySparkException, match="null"):
            O.linear_l2(BatchCycle(examples, features), 1).value_grad(x)


# --- searches and the loop -----------------------------------------------------------


class Curve:
    def __init__(self, f, df):
        self.f, self.df = f, df

    def probe(self, alphas):
        return [(self.f(a), self.df(a)) for a in alphas]


def test_two_loop_equals_explicit_recursion():
    rng = np.random.default_rng(5)
    s, y, g = rng.normal(size=(3, 20)), rng.normal(size=(3, 20)), rng.normal(size=20)
    y += 3 * s
    basis = np.vstack([s, y, g])
    d = M.two_loop(basis @ basis.T, 3) @ basis
    h = np.eye(20) * (s[0] @ y[0]) / (y[0] @ y[0])
    for i in (2, 1, 0):
        rho = 1 / (s[i] @ y[i])
        left = np.eye(20) - rho * np.outer(s[i], y[i])
        h = left @ h @ left.T + rho * np.outer(s[i], s[i])
    np.testing.assert_allclose(d, -h @ g, atol=1e-9)


@pytest.mark.parametrize("init", [1e-3, 1.0, 30.0])
def test_searches_meet_their_conditions(init):
    curve = Curve(lambda a: (a - 3) ** 2 + math.sin(a), lambda a: 2 * (a - 3) + math.cos(a))
    for search in (StrongWolfe(max_iter=40), Backtracking(max_iter=40)):
        probes = Probes(curve)
        alpha = search.minimize(probes, init)
        assert curve.f(alpha) <= curve.f(0) + 1e-4 * alpha * curve.df(0)
        assert abs(curve.df(alpha)) <= 0.9 * abs(curve.df(0))


def test_searches_fail_loudly():
    with pytest.raises(LineSearchFailed, match="descent"):
        StrongWolfe().minimize(Probes(Curve(lambda a: a, lambda a: 1.0)), 1.0)
    rising = Curve(lambda a: a, lambda a: -1.0)
    with pytest.raises(StepUnderflow):
        Backtracking(max_iter=100).minimize(Probes(rising), 1.0)
    with pytest.raises(LineSearchFailed):
        Backtracking(max_iter=3).minimize(Probes(rising), 1.0)
    assert StrongWolfe().minimize(Probes(Curve(lambda a: -a, lambda a: -1.0)), 1.0, bound=2.0) == 2.0


def test_verdicts():
    method = M.GradientDescent(1.0, 1.0, 1.0, max_iter=5, tolerance=1e-3, lower_fun_tolerance=0.5)
    assert method.verdict(1.0, 0.9999, 0, 1.0) == M.VALUES_CONVERGED
    assert method.verdict(1.0, 1.6, 0, 1.0) == M.VALUES_CONVERGED
    assert method.verdict(1.0, 1.4, 0, 1.0) is None
    assert method.verdict(2.0, 1.0, 4, 1.0) == M.MAX_ITERATIONS
    assert method.verdict(2.0, 1.0, 0, 1e-4) == M.GRADIENT_CONVERGED
    assert M.GradientDescent(1.0, 1.0, 1.0).verdict(2.0, 1.0, 10_000, 1.0) is None


class Bowl(O.Objective):
    """A user objective: only value and gradient are given."""

    def value_grad(self, x):
        total = x.agg(F.sum((F.col("v") - 1) ** 2)).first()[0]
        return total, x.select("idx", (2 * (F.col("v") - 1)).alias("g"))


def test_user_objective_and_failed_search(spark):
    x0 = vec(spark, [0.0, 3.0, -2.0])
    state = M.LBFGS(3, max_iter=10).minimize(Bowl(), x0)
    np.testing.assert_allclose(as_array(state.x), [1.0, 1.0, 1.0], atol=1e-5)

    class Never:
        def minimize(self, line, init):
            raise LineSearchFailed("no")

    failed = M.LBFGS(3, search=Never()).minimize(Bowl(), x0)
    assert failed.search_failed and failed.reason == M.SEARCH_FAILED and failed.iteration == 0
    assert failed.reset_iterations().reason is None


def test_held_batch_is_released_when_a_search_fails(spark):
    ex = spark.createDataFrame([(e, float(e), 1.0, e % 2) for e in range(4)], "ex_id bigint, label double, weight double, batch_id int")
    cycle = BatchCycle(ex, features(spark, [(e, 0, 1.0) for e in range(4)]), 2)
    with pytest.raises(LineSearchFailed):
        with cycle.held():
            raise LineSearchFailed("no")
    assert not cycle.holding


def test_points_of_one_place_are_one_site(spark):
    """Many points on few places: the sums of all pairs from tiles of places; steps and costs too."""
    rng = np.random.default_rng(8)
    places, n, m, eps = rng.random((4, 2)), 90, 35, 0.05
    a, b = places[rng.integers(0, 4, n)], places[rng.integers(0, 3, m)]
    u, v, du, dv = rng.normal(size=n), rng.normal(size=m), rng.normal(size=n), rng.normal(size=m)
    points = [spark.createDataFrame([(10 * i, [float(z) for z in p]) for i, p in enumerate(pts)], "id bigint, p array<double>") for pts in (a, b)]
    cost = 0.5 * ((a[:, None] - b[None]) ** 2).sum(2)
    pair = T.PointPair.of(*points)
    assert pair.counts["u"] <= 4 and pair.counts["v"] <= 3
    assert pair.tiles.agg(F.sum(F.size("xi") * F.size("yj"))).first()[0] == pair.counts["u"] * pair.counts["v"]
    rows = [(s, 10 * i, float(p), float(d)) for s, ps, ds in (("u", u, du), ("v", v, dv)) for i, (p, d) in enumerate(zip(ps, ds))]
    xd = spark.createDataFrame(rows, "side string, idx bigint, x double, d double")

    def dual(t):
        e = np.exp((u[:, None] + t * du[:, None] + v + t * dv - cost) / eps) / cost.size
        return e, eps * e.sum() - (u + t * du).mean() - (v + t * dv).mean(), (e * (du[:, None] + dv)).sum() - du.mean() - dv.mean()

    mass = {(r["side"], r["idx"]): r["mass"] for r in T.ot_mass(pair, xd.select("side", "idx", F.col("x").alias("p")), eps).collect()}
    e = dual(0.0)[0]
    assert mass == pytest.approx({("u", 10 * i): z for i, z in enumerate(e.sum(1))} | {("v", 10 * j): z for j, z in enumerate(e.sum(0))}, rel=1e-10)
    line = O.TransportDual(pair, eps).line(xd)
    for t, (value, slope) in zip((0.0, 0.1, 0.3), line.probe([0.0, 0.1, 0.3])):
        assert (value, slope) == pytest.approx(dual(t)[1:], rel=1e-10)
    line.close()
    got = {(r["i"], r["j"]): r["c"] for r in T.ot_costs(pair).collect()}
    assert got == pytest.approx({(10 * i, 10 * j): cost[i, j] for i in range(n) for j in range(m)}, abs=1e-12)
    pair.close()
