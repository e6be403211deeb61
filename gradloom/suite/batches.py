"""Mini-batches of orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradloom.operators.batches import BatchCycle
from gradloom.plans.lineage import cut
from gradloom.plans.objectives import linear_l2
from gradloom.suite.base import CTES, R, case, dim, ex_reg, fea, rnd, w0

BATCHES = 5

CTES["by_batch"] = "SELECT *, ex_id % 5 AS batch_id FROM loss_l2"
CTES["grad_by_batch"] = """SELECT l.batch_id, f.fea_id AS idx, sum(f.value * l.dscore) AS g
  FROM fea f JOIN by_batch l ON f.ex_id = l.ex_id GROUP BY 1, 2"""


def cycle(spark, sf, policy="hold", column=True) -> BatchCycle:
    batch = (F.col("ex_id") % BATCHES).alias("batch_id")
    targets = ex_reg(spark, sf).select("*", batch)
    features = fea(spark, sf)
    return BatchCycle(targets, features.select("*", batch) if column else features, BATCHES, policy)


def _values(spark, sf, calls) -> "DataFrame":  # noqa: F821
    rows = [(n, int(p), float(v)) for n, (p, v) in enumerate(calls)]
    out = spark.createDataFrame(rows, "call int, batch_id bigint, value double")
    return out.select("call", "batch_id", rnd("value").alias("value"))


def _calls_sql(batches: list[int]) -> str:
    order = ", ".join(f"({n}::INTEGER, {b}::BIGINT)" for n, b in enumerate(batches))
    return f"""SELECT call, b.batch_id, {R('sum(loss) / sum(weight)')} AS value FROM (VALUES {order}) o(call, batch_id)
    JOIN by_batch b ON b.batch_id = o.batch_id GROUP BY 1, 2"""


@case("batch_cycle", _calls_sql([0, 1, 2, 3, 4, 0, 1]))
def batch_cycle(spark, sf):
    """Successive evaluations see successive batches, modulo their number."""
    batches = cycle(spark, sf)
    model, x = linear_l2(batches, dim(spark, sf)), w0(spark, sf)
    calls = []
    for _ in range(7):
        value = model.value(x)
        calls.append((batches.position, value))
    batches.free()
    return _values(spark, sf, calls)


@case(
    "batch_gradients",
    f"""SELECT batch_id, idx, {R('g / (SELECT sum(weight) FROM by_batch b WHERE b.batch_id = q.batch_id)', 8)} AS g FROM grad_by_batch q""",
)
def batch_gradients(spark, sf):
    """Gradient of every batch; features follow their example by a semi join."""
    batches = cycle(spark, sf, column=False)
    model, x = linear_l2(batches, dim(spark, sf)), w0(spark, sf)
    out = None
    for _ in range(BATCHES):
        _, grad = model.value_grad(x)
        used = batches.current.by_example.plain.select(F.col("fea_id").alias("idx")).distinct()
        # Written while its batch is the current one.
        part = cut(grad.join(used, "idx").select(F.lit(batches.position).cast("bigint").alias("batch_id"), "idx", rnd("g", 8).alias("g")))
        out = part if out is None else out.unionByName(part)
    batches.free()
    return out


@case("batch_hold_release", _calls_sql([0, 0, 0, 1, 2]))
def batch_hold_release(spark, sf):
    """While held, evaluations repeat the batch; afterwards the cycle goes on."""
    batches = cycle(spark, sf)
    model, x = linear_l2(batches, dim(spark, sf)), w0(spark, sf)
    calls = [(lambda v: (batches.position, v))(model.value(x))]
    with batches.held():
        calls += [(lambda v: (batches.position, v))(model.value(x)) for _ in range(2)]
    calls += [(lambda v: (batches.position, v))(model.value(x)) for _ in range(2)]
    batches.free()
    return _values(spark, sf, calls)


@case("batch_no_hold", _calls_sql([0, 1, 2, 3]))
def batch_no_hold(spark, sf):
    batches = cycle(spark, sf, "no_hold")
    model, x = linear_l2(batches, dim(spark, sf)), w0(spark, sf)
    calls = [(lambda v: (batches.position, v))(model.value(x))]
    with batches.held():
        calls += [(lambda v: (batches.position, v))(model.value(x)) for _ in range(2)]
    calls.append((lambda v: (batches.position, v))(model.value(x)))
    batches.free()
    return _values(spark, sf, calls)


@case("batch_refresh_on_hold", _calls_sql([0, 1, 1, 2]))
def batch_refresh_on_hold(spark, sf):
    """Holding first moves on one batch, and then stays there."""
    batches = cycle(spark, sf, "refresh_on_hold")
    model, x = linear_l2(batches, dim(spark, sf)), w0(spark, sf)
    calls = [(lambda v: (batches.position, v))(model.value(x))]
    with batches.held():
        calls += [(lambda v: (batches.position, v))(model.value(x)) for _ in range(2)]
    calls.append((lambda v: (batches.position, v))(model.value(x)))
    batches.free()
    return _values(spark, sf, calls)


@case(
    "batch_position",
    f"""SELECT step::INTEGER AS step, b AS position, done AS epoch_done, {R('w', 4)} AS weight FROM (VALUES
    (0, 0::BIGINT, false), (1, 3::BIGINT, false), (2, 4::BIGINT, true), (3, 0::BIGINT, false)) o(step, b, done)
    JOIN (SELECT batch_id, sum(weight) AS w FROM by_batch GROUP BY 1) t ON t.batch_id = o.b""",
)
def batch_position(spark, sf):
    """Cursor facts: position, end of an epoch, and the weight of the batch there."""
    batches = cycle(spark, sf)
    seen = []
    for n, steps in enumerate((1, 3, 1, 1)):
        batches.advance(steps)
        targets, _ = batches.slice(batches.position)
        fact = targets.agg(F.sum("weight").alias("weight")).withColumns(
            {"step": F.lit(n), "position": F.lit(batches.position).cast("bigint"), "epoch_done": F.lit(batches.epoch_done)}
        )
        seen.append(fact.select("step", "position", "epoch_done", rnd("weight", 4).alias("weight")))
    out = seen[0]
    for fact in seen[1:]:
        out = out.unionByName(fact)
    return out


@case("next_features", f"SELECT ex_id, fea_id, {R('value')} AS value FROM fea WHERE ex_id % 5 = 1")
def next_features(spark, sf):
    batches = cycle(spark, sf)
    batches.next_features()
    return batches.next_features().select("ex_id", "fea_id", rnd("value").alias("value"))
