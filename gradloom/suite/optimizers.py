"""Optimizer steps over state tables, and whole runs.

Fixed-step runs are compared with the same steps unrolled in SQL; runs with a
line search are compared with optima known in closed form.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gradloom.functions import elementwise as E
from gradloom.operators import vectors as V
from gradloom.operators.batches import BatchCycle
from gradloom.plans import objectives as O
from gradloom.plans import optimizers as M
from gradloom.plans.linesearch import Backtracking, Probes, StrongWolfe
from gradloom.plans.runs import RunStore
from gradloom.suite.base import CTES, R, abc, bias, case, dim, ex_bin, ex_reg, fea, rank_v, read, rnd, w0
from gradloom.suite.ranking import ranking_model
from gradloom.suite.sources import scratch

# A state table over parts: point, gradient, two stored pairs, squared-gradient memory.
CTES["st"] = """SELECT idx, CASE WHEN idx % 4 = 0 THEN 0.0::DOUBLE ELSE c * b + a / 7.0 END AS x, (a - 0.95::DOUBLE) * c + b / 9.0 AS g,
  c / 5.0 AS s0, c / 4.0 + b / 11.0 AS y0, b - 0.5::DOUBLE AS s1, b * 1.1 - 0.45::DOUBLE + a / 50.0 AS y1, a * b AS h FROM abc"""


def st(spark, sf):
    a, b, c, idx = (F.col(n) for n in ("a", "b", "c", "idx"))
    return abc(spark, sf).select(
        "idx",
        F.when(idx % 4 == 0, F.lit(0.0)).otherwise(c * b + a / 7.0).alias("x"),
        ((a - 0.95) * c + b / 9.0).alias("g"),
        (c / 5.0).alias("s0"),
        (c / 4.0 + b / 11.0).alias("y0"),
        (b - 0.5).alias("s1"),
        (b * 1.1 - 0.45 + a / 50.0).alias("y1"),
        (a * b).alias("h"),
    )


def _out(df, *cols):
    return df.select("idx", *[rnd(c).alias(c) for c in cols])


@case("take_step", f"SELECT idx, {R('x - 0.37 * g')} AS v FROM st")
def take_step(spark, sf):
    return _out(st(spark, sf).withColumn("v", F.col("x") + F.lit(0.37) * -F.col("g")), "v")


CTES["lb"] = """SELECT sum(s0*y0) AS sy0, sum(y0*y0) AS yy0, sum(s1*y1) AS sy1, sum(s0*g) AS s0g, sum(s1*g) AS s1g,
  sum(s1*y0) AS s1y0, sum(y0*g) AS y0g, sum(y1*g) AS y1g, sum(y0*y1) AS y01, sum(y1*y1) AS yy1, sum(s0*y1) AS s0y1, sum(s0*s1) AS s01 FROM st"""
# Two-loop recursion for two pairs, newest first, written out in scalars.
CTES["lc"] = """SELECT *, sy0 / yy0 AS gam, a0, a1, b1, a1 - b1 AS t1, (gam * (y0g - a0 * yy0 - a1 * y01) + (a1 - b1) * s1y0) / sy0 AS b0 FROM (
  SELECT *, sy0 / yy0 * (y1g - a0 * y01 - a1 * yy1) / sy1 AS b1, sy0 / yy0 AS gam0 FROM (
    SELECT *, (s1g - a0 * s1y0) / sy1 AS a1 FROM (SELECT *, s0g / sy0 AS a0 FROM lb)))"""


@case("lbfgs_direction", f"SELECT idx, {R('-(gam * (g - a0 * y0 - a1 * y1) + t1 * s1 + (a0 - b0) * s0)')} AS d FROM st, lc")
def lbfgs_direction(spark, sf):
    """One aggregate for the Gram matrix, one projection for the direction."""
    table = st(spark, sf)
    names = [*M.pair_columns(2), "g"]
    coefficients = M.two_loop(V.gram_matrix(table, names), 2)
    return _out(table.withColumn("d", E.lincomb(*[(c, F.col(n)) for c, n in zip(coefficients, names)])), "d")


@case("lbfgs_direction_first", f"SELECT idx, {R('-g')} AS d FROM st")
def lbfgs_direction_first(spark, sf):
    table = st(spark, sf)
    coefficients = M.two_loop(V.gram_matrix(table, ["g"]), 0)
    return _out(table.withColumn("d", E.lincomb((coefficients[0], F.col("g")))), "d")


@case(
    "lbfgs_update_history",
    f"""SELECT idx, {R('x_new - x')} AS s0, {R('s0')} AS s1, {R('g_new - g')} AS y0, {R('y0')} AS y1
    FROM (SELECT *, x - 0.2 * g AS x_new, g * 0.9 + x * 0.1 AS g_new FROM st)""",
)
def lbfgs_update_history(spark, sf):
    """The newest pair comes first, the oldest leaves."""
    table = st(spark, sf).withColumns({"x_new": F.col("x") - 0.2 * F.col("g"), "g_new": F.col("g") * 0.9 + F.col("x") * 0.1})
    state = M.State(table, ("idx",), 0.0, 0.0, 0.0, 2, 0.0, history=2)
    carried = M.LBFGS(2).carried(state, F.col("g"), 0.2)
    return _out(table.select("idx", *[c.alias(n) for n, c in carried.items()]), "s0", "s1", "y0", "y1")


@case("adagrad_history", f"SELECT idx, {R('h + g * g')} AS young, {R('g * g / 5 + 0.8 * h')} AS aged FROM st")
def adagrad_history(spark, sf):
    h, g = F.col("h"), F.col("g")
    young, aged = (E.adagrad_memory(h, g, F.lit(old), 5) for old in (False, True))
    return _out(st(spark, sf).withColumns({"young": young, "aged": aged}), "young", "aged")


def _ada_sql(scale):
    return f"(SELECT *, {scale} AS s FROM st)"


_PUBLISHED, _COMPAT = "sqrt(h + g * g + 1e-4)", "h + sqrt(g * g + 1e-4)"


def _ada_cases(suffix, scale, compat):
    def scaled(spark, sf):
        return st(spark, sf).withColumn("s", E.adagrad_scale(F.col("h"), F.col("g"), 1e-4, compat))

    @case(f"adagrad_step{suffix}", f"SELECT idx, {R('(x * s - 0.1 * g) / (s + 0.05 * 0.1)')} AS l2, {R('x - 0.1 * g / s')} AS plain FROM {_ada_sql(scale)}")
    def step(spark, sf):
        args = F.col("x"), F.col("g"), F.col("s")
        both = {"l2": E.adagrad_point(*args, 0.1, 0.0, 0.05), "plain": E.adagrad_point(*args, 0.1, 0.0, 0.0)}
        return _out(scaled(spark, sf).withColumns(both), "l2", "plain")

    cut = "0.4 * 0.1 / s"

    @case(f"soft_threshold{suffix}", f"SELECT idx, {R(f'CASE WHEN abs(x) < {cut} THEN 0 ELSE x - sign(x) * {cut} END')} AS v FROM {_ada_sql(scale)}")
    def threshold(spark, sf):
        return _out(scaled(spark, sf).withColumn("v", E.soft_threshold(F.col("x"), F.lit(0.4 * 0.1) / F.col("s"))), "v")


_ada_cases("", _PUBLISHED, False)
_ada_cases("_compat", _COMPAT, True)


@case(
    "adagrad_adjust",
    f"""SELECT idx, {R('g + 0.05 * x + 0.02 * sign(x)')} AS g, {R('(SELECT 1.5 + 0.025 * sum(x * x) + 0.02 * sum(abs(x)) FROM st)', 4)} AS value FROM st""",
)
def adagrad_adjust(spark, sf):
    method = M.AdaGrad(0.1, l2=0.05, l1=0.02)
    table = st(spark, sf)
    value = method.adjusted(table, 1.5)
    grad = method.adjusted_gradient(M.State(table, ("idx",), 1.5, 1.5, 0.0, 0, 1.5))
    return grad.select("idx", rnd("g").alias("g"), rnd(F.lit(value), 4).alias("value"))


@case("sgd_step_size", f"SELECT o_orderkey AS iter, {R('0.1 / pow(0.5 * o_orderkey + 1, 1.0 / 30)')} AS eta FROM orders")
def sgd_step_size(spark, sf):
    """The step length of as many iterations as there are orders."""
    eta = E.step_size(0.1, F.col("o_orderkey"), 0.5, 1.0 / 30)
    return read(spark, sf, "orders").select(F.col("o_orderkey").alias("iter"), rnd(eta).alias("eta"))


@case("orthant_project", f"SELECT idx, {R('CASE WHEN sign(x) = sign(g) THEN x ELSE 0 END')} AS v FROM st")
def orthant_project(spark, sf):
    return _out(st(spark, sf).withColumn("v", E.orthant_project(F.col("x"), F.col("g"))), "v")


@case("orthant", f"SELECT idx, {R('CASE WHEN x <> 0 THEN x ELSE -g END')} AS v FROM st")
def orthant(spark, sf):
    return _out(st(spark, sf).withColumn("v", E.orthant(F.col("x"), F.col("g"))), "v")


_L1 = "CASE WHEN idx < 100 THEN 0.0 ELSE 0.03 + idx % 3 / 50.0 END"


def l1_weight(idx):
    return F.when(idx < 100, F.lit(0.0)).otherwise(0.03 + (idx % 3) / 50.0)


@case(
    "pseudo_gradient",
    f"""SELECT idx, {R('''CASE WHEN x <> 0 THEN g + l1 * sign(x) WHEN g + l1 < 0 THEN g + l1
    WHEN g - l1 > 0 THEN g - l1 ELSE 0 END''')} AS g FROM (SELECT *, ({_L1})::DOUBLE AS l1 FROM st)""",
)
def pseudo_gradient(spark, sf):
    method = M.OWLQN(5, l1_weight)
    return _out(st(spark, sf).select("idx", method.pseudo(["idx"]).alias("g")), "g")


@case("l1_penalty_weighted", f"SELECT {R(f'sum(({_L1}) * abs(x))', 4)} AS penalty FROM st")
def l1_penalty_weighted(spark, sf):
    method = M.OWLQN(5, l1_weight)
    return st(spark, sf).agg(rnd(F.sum(method.weight(["idx"]) * F.abs("x")), 4).alias("penalty"))


# --- whole runs with fixed steps, unrolled in SQL -------------------------------------

BATCHES = 5
CTES["tot"] = "SELECT sum(weight) AS tw FROM ex_reg"


def _iterate(name: str, steps: int, start: str, nexts, batch=None) -> None:
    """Define ``{name}_x0 .. {name}_x{steps}`` with gradient and value at every point.

    ``start`` gives the state columns of step 0 over w0; ``nexts(i)`` those of
    step i+1 over the state with gradient ``{name}_g{i}``.  ``batch(i)`` is the
    number of the fifth of the examples that point i is evaluated on.
    """
    for i in range(steps + 1):
        examples, tot = "ex_reg", "(SELECT tw FROM tot)"
        if batch is not None:
            examples, tot = f"{name}_b{i}", f"(SELECT sum(weight) FROM {name}_b{i})"
            CTES[examples] = f"SELECT * FROM ex_reg WHERE ex_id % {BATCHES} = {batch(i) % BATCHES}"
        prior = f"{name}_g{i - 1}"
        CTES[f"{name}_x{i}"] = f"SELECT idx, {start} FROM w0" if i == 0 else f"SELECT idx, {nexts(i - 1)} FROM {prior}"
        CTES[f"{name}_e{i}"] = f"""SELECT e.ex_id, e.weight * (p - e.label) * (p - e.label) AS loss, 2 * e.weight * (p - e.label) AS ds
          FROM {examples} e JOIN (SELECT ex_id, sum(value * x) AS p FROM fea JOIN {name}_x{i} ON fea_id = idx GROUP BY 1) s ON s.ex_id = e.ex_id"""
        CTES[f"{name}_f{i}"] = f"SELECT sum(loss) / {tot} AS f FROM {name}_e{i}"
        CTES[f"{name}_g{i}"] = f"""SELECT w.*, coalesce(q.g, 0.0::DOUBLE) / {tot} AS g FROM {name}_x{i} w LEFT JOIN
          (SELECT fea_id, sum(value * ds) AS g FROM fea JOIN {name}_e{i} USING (ex_id) GROUP BY 1) q ON q.fea_id = w.idx"""


def regression(spark, sf):
    return O.linear_l2(BatchCycle(ex_reg(spark, sf), fea(spark, sf)), dim(spark, sf))


def _run_sql(name, steps):
    return f"SELECT idx, {R('x')} AS x, {R(f'(SELECT f FROM {name}_f{steps})')} AS value FROM {name}_x{steps}"


def _run(spark, sf, method, x0=None):
    state = method.minimize(regression(spark, sf), w0(spark, sf) if x0 is None else x0)
    return state.table.select("idx", rnd("x").alias("x"), rnd(F.lit(state.value)).alias("value"))


_iterate("sgd", 3, "v AS x", lambda i: f"x - {0.2 / (0.5 * i + 1) ** 0.5!r}::DOUBLE * g AS x")


@case("sgd", _run_sql("sgd", 3))
def sgd(spark, sf):
    return _run(spark, sf, M.GradientDescent(0.2, 0.5, 0.5, max_iter=3, lower_fun_tolerance=1e9))


_TRACE = " UNION ALL ".join(
    f"""SELECT {i}::INTEGER AS iter, (SELECT f FROM sgd_f{i}) AS value, (SELECT f FROM sgd_f{i - 1}) AS before,
    (SELECT sqrt(sum(g * g)) FROM sgd_g{i}) AS norm""" for i in (1, 2, 3)
)


@case(
    "convergence_trace",
    f"""SELECT iter, {R('value')} AS value, {R('norm')} AS grad_norm,
    {R('(before - value) / greatest(abs(before), abs(value))')} AS improvement,
    CASE WHEN iter = 3 THEN 'max iterations reached' END AS reason FROM ({_TRACE})""",
)
def convergence_trace(spark, sf):
    """Value, gradient norm, relative improvement and verdict of every iteration."""
    method = M.GradientDescent(0.2, 0.5, 0.5, max_iter=3, lower_fun_tolerance=1e9)
    state = method.minimize(regression(spark, sf), w0(spark, sf))
    rows = M.trace_frame(spark, state)
    return rows.select("iter", rnd("value").alias("value"), rnd("grad_norm").alias("grad_norm"), rnd("improvement").alias("improvement"), "reason")


def _ada_next(i):
    s = "sqrt(h + g * g + 1e-4)"
    l2 = f"(x * {s} - 0.1 * g) / ({s} + 0.05 * 0.1)"
    cut = f"0.01 * 0.1 / {s}"
    return f"CASE WHEN abs({l2}) < {cut} THEN 0 ELSE {l2} - sign({l2}) * {cut} END AS x, " + (
        "g * g / 1.0 + 0.0 * h AS h" if i > 1 else "h + g * g AS h"
    )


_iterate("ada", 4, "v AS x, 0.0::DOUBLE AS h", _ada_next)


@case("adagrad", _run_sql("ada", 4))
def adagrad(spark, sf):
    method = M.AdaGrad(0.1, l2=0.05, l1=0.01, max_age=1, max_iter=4, lower_fun_tolerance=1e9)
    return _run(spark, sf, method)


# L-BFGS with memory 1 and given steps: d = -(gam*(g - a0*y) + (a0 - b0)*s).
def _lb_next(i):
    if i == 0:
        return "x - 0.3 * g AS x, x AS xo, g AS go"
    return f"""x + 0.6 * (-(gam * (g - a0 * (g - go)) + (a0 - gam * (yg - a0 * yy) / sy) * (x - xo))) AS x, x AS xo, g AS go"""


def _lb_chain(name="lbf", steps=3, batch=None):
    _iterate(name, steps, "v AS x, 0.0::DOUBLE AS xo, 0.0::DOUBLE AS go", _lb_next, batch)
    for i in range(1, steps):
        CTES[f"{name}_k{i}"] = f"""SELECT sy, yy, yg, sg / sy AS a0, sy / yy AS gam FROM (SELECT sum((x - xo) * (g - go)) AS sy,
          sum((g - go) * (g - go)) AS yy, sum((g - go) * g) AS yg, sum((x - xo) * g) AS sg FROM {name}_g{i})"""
        CTES[f"{name}_x{i + 1}"] = f"SELECT idx, {_lb_next(i)} FROM {name}_g{i}, {name}_k{i}"


_lb_chain()


@case("lbfgs_fixed_steps", _run_sql("lbf", 3))
def lbfgs_fixed_steps(spark, sf):
    method = M.LBFGS(1, fixed_steps=[0.3, 0.6, 0.6], max_iter=3, lower_fun_tolerance=1e9)
    return _run(spark, sf, method)


def _owl_pg(x="x", g="g"):
    return f"CASE WHEN {x} <> 0 THEN {g} + 0.02 * sign({x}) WHEN {g} + 0.02 < 0 THEN {g} + 0.02 WHEN {g} - 0.02 > 0 THEN {g} - 0.02 ELSE 0 END"


def _owl_step(alpha, free):
    d = f"(CASE WHEN sign({free}) = sign(-({_owl_pg()})) THEN {free} ELSE 0 END)"
    home = f"(CASE WHEN x <> 0 THEN x ELSE -({_owl_pg()}) END)"
    moved = f"(x + {alpha} * {d})"
    return f"CASE WHEN sign({moved}) = sign({home}) THEN {moved} ELSE 0 END AS x, x AS xo, g AS go"


def _owl_free(i):
    if i == 0:
        return f"(-({_owl_pg()}))"
    return f"(-(gam * (({_owl_pg()}) - a0 * (g - go)) + (a0 - gam * (yg - a0 * yy) / sy) * (x - xo)))"


_iterate("owl", 2, "v AS x, 0.0::DOUBLE AS xo, 0.0::DOUBLE AS go", lambda i: _owl_step((0.3, 0.6)[i], _owl_free(i)))
CTES["owl_k1"] = f"""SELECT sy, yy, yg, sg / sy AS a0, sy / yy AS gam FROM (SELECT sum((x - xo) * (g - go)) AS sy,
  sum((g - go) * (g - go)) AS yy, sum((g - go) * ({_owl_pg()})) AS yg, sum((x - xo) * ({_owl_pg()})) AS sg FROM owl_g1)"""
CTES["owl_x2"] = f"SELECT idx, {_owl_step(0.6, _owl_free(1))} FROM owl_g1, owl_k1"


@case("owlqn_fixed_steps", _run_sql("owl", 2))
def owlqn_fixed_steps(spark, sf):
    method = M.OWLQN(5, 0.02, fixed_steps=[0.3, 0.6], max_iter=2, lower_fun_tolerance=1e9)
    return _run(spark, sf, method)


_TRIED = [0.05, 0.3, 2.0]
_TRIED_SQL = ", ".join(f"({a}::DOUBLE)" for a in _TRIED)
_TRIED_D = f"(CASE WHEN sign({_owl_free(0)}) = sign(-({_owl_pg()})) THEN {_owl_free(0)} ELSE 0 END)"
CTES["owl_tried"] = f"SELECT a, idx, d, CASE WHEN sign(x + a * d) = sign(home) THEN x + a * d ELSE 0 END AS p FROM (SELECT idx, x, {_TRIED_D} AS d, CASE WHEN x <> 0 THEN x ELSE -({_owl_pg()}) END AS home FROM owl_g0), (VALUES {_TRIED_SQL}) t(a)"
CTES["owl_tried_s"] = f"""SELECT a, ex_id, label, weight, coalesce(s, 0) AS s FROM ex_reg CROSS JOIN (VALUES {_TRIED_SQL}) t(a)
  LEFT JOIN (SELECT a, ex_id, sum(value * p) AS s FROM fea JOIN owl_tried ON fea_id = idx GROUP BY 1, 2) USING (a, ex_id)"""
CTES["owl_tried_g"] = "SELECT a, fea_id AS idx, sum(2 * weight * (s - label) * value) / (SELECT tw FROM tot) AS g FROM owl_tried_s JOIN fea USING (ex_id) GROUP BY 1, 2"


@case(
    "owlqn_projected_probe",
    f"""SELECT a AS alpha, {R('loss + penalty')} AS value, {R('slope')} AS slope
    FROM (SELECT a, sum(weight * pow(s - label, 2)) / sum(weight) AS loss FROM owl_tried_s GROUP BY 1)
    JOIN (SELECT a, 0.02 * sum(abs(p)) AS penalty, sum(({_owl_pg('p', 'coalesce(g, 0)')}) * d) AS slope
      FROM owl_tried LEFT JOIN owl_tried_g USING (a, idx) GROUP BY 1) USING (a)""",
)
def owlqn_projected_probe(spark, sf):
    """Penalized value and slope at several projected steps, scored in one pass over the features."""
    model, method = regression(spark, sf), M.OWLQN(5, 0.02)
    state = next(method.iterations(model, w0(spark, sf)))
    line = M.ProjectedLine(method, model, state, method.direction(state))
    rows = [(a, value, slope()) for a, (value, slope) in zip(_TRIED, line.probe(_TRIED))]
    line.close()
    out = spark.createDataFrame(rows, "alpha double, value double, slope double")
    return out.select("alpha", rnd("value").alias("value"), rnd("slope").alias("slope"))


# --- line searches -----------------------------------------------------------------------

_ALPHAS = [0.0, 0.05, 0.4]
CTES["ray"] = "SELECT ex_id, sum(value * x) AS s0, sum(value * -g) AS sd FROM fea JOIN sgd_g0 ON fea_id = idx GROUP BY 1"


@case(
    "line_probe",
    f"""SELECT a AS alpha, {R('sum(weight * pow(s0 + a * sd - label, 2)) / sum(weight)')} AS value,
    {R('sum(2 * weight * (s0 + a * sd - label) * sd) / sum(weight)')} AS slope
    FROM (VALUES (0.0::DOUBLE), (0.05::DOUBLE), (0.4::DOUBLE)) t(a), ex_reg JOIN ray USING (ex_id) GROUP BY 1""",
)
def line_probe(spark, sf):
    """Several steps along the descent ray from one join-free aggregate."""
    model, x = regression(spark, sf), w0(spark, sf)
    _, grad = model.value_grad(x)
    xd = x.join(grad, "idx").select("idx", F.col("v").alias("x"), (-F.col("g")).alias("d"))
    line = model.line(xd)
    rows = [(a, *p) for a, p in zip(_ALPHAS, line.probe(_ALPHAS))]
    line.close()
    out = spark.createDataFrame(rows, "alpha double, value double, slope double")
    return out.select("alpha", rnd("value").alias("value"), rnd("slope").alias("slope"))


def _searched(spark, sf, model, search, init):
    """Whether the found step satisfies both Wolfe conditions."""
    x = w0(spark, sf)
    _, grad = model.value_grad(x)
    xd = x.join(grad, "idx").select("idx", F.col("v").alias("x"), (-F.col("g")).alias("d"))
    probes = Probes(model.line(xd))
    alpha = search.minimize(probes, init)
    origin, here = probes.at(0.0), probes.at(alpha)
    armijo = here.value <= origin.value + 1e-4 * alpha * origin.slope
    flat = abs(here.slope) <= 0.9 * abs(origin.slope)
    probes.line.close()
    return spark.createDataFrame([(armijo, flat, probes.jobs <= 12)], "armijo boolean, curvature boolean, few_jobs boolean")


_WOLFE = "SELECT true AS armijo, true AS curvature, count(*) > 0 AS few_jobs FROM orders"


@case("search_strong_wolfe", _WOLFE)
def search_strong_wolfe(spark, sf):
    return _searched(spark, sf, regression(spark, sf), StrongWolfe(), 50.0)


@case("search_strong_wolfe_growing", _WOLFE)
def search_strong_wolfe_growing(spark, sf):
    return _searched(spark, sf, regression(spark, sf), StrongWolfe(max_iter=30), 1e-3)


@case("search_backtracking", _WOLFE)
def search_backtracking(spark, sf):
    model = O.linear_binlog(BatchCycle(ex_bin(spark, sf), fea(spark, sf)), dim(spark, sf))
    return _searched(spark, sf, model, Backtracking(), 64.0)


# --- whole runs with searches, against known optima ---------------------------------------

# One feature per order (its customer's nation): the optimum is a mean per nation.
CTES["nat"] = "SELECT o_orderkey AS ex_id, c_nationkey::BIGINT AS fea_id FROM orders JOIN customer ON c_custkey = o_custkey"
CTES["nat_mean"] = """SELECT fea_id, sum(weight) AS w, sum(weight * label) / sum(weight) AS mean,
  (SELECT sum(weight) FROM ex_reg) AS tw FROM ex_reg JOIN nat USING (ex_id) GROUP BY 1"""


def by_nation(spark, sf):
    customers = read(spark, sf, "customer")
    orders = read(spark, sf, "orders").join(customers, F.col("c_custkey") == F.col("o_custkey"))
    return orders.select(F.col("o_orderkey").alias("ex_id"), F.col("c_nationkey").cast("bigint").alias("fea_id"), F.lit(1.0).alias("value"))


def nations(spark, sf):
    return read(spark, sf, "nation").select(F.col("n_nationkey").cast("bigint").alias("idx"), F.lit(0.0).alias("v"))


@case("lbfgs_l2", f"SELECT fea_id AS idx, {R('mean', 3)} AS x FROM nat_mean")
def lbfgs_l2(spark, sf):
    """Least squares on one-hot features converges to the weighted means."""
    model = O.linear_l2(BatchCycle(ex_reg(spark, sf), by_nation(spark, sf)), 25)
    state = M.LBFGS(5, max_iter=40, tolerance=1e-12).minimize(model, nations(spark, sf))
    return state.table.select("idx", rnd("x", 3).alias("x"))


@case(
    "owlqn_l2",
    f"""SELECT fea_id AS idx, {R('sign(mean) * greatest(abs(mean) - l1 * tw / (2 * w), 0)', 3)} AS x
    FROM (SELECT *, CASE WHEN fea_id < 12 THEN 0.02 ELSE 0.3 END AS l1 FROM nat_mean)""",
)
def owlqn_l2(spark, sf):
    """With an L1 weight per coordinate, the optimum is the soft-thresholded mean.

    The unpenalized value may rise on the way, hence the lower tolerance.
    """
    model = O.linear_l2(BatchCycle(ex_reg(spark, sf), by_nation(spark, sf)), 25)
    method = M.OWLQN(5, lambda idx: F.when(idx < 12, 0.02).otherwise(0.3), max_iter=14, tolerance=1e-12, lower_fun_tolerance=1.0)
    state = method.minimize(model, nations(spark, sf))
    return state.table.select("idx", rnd("x", 3).alias("x"))


CTES["nat_bin"] = "SELECT fea_id, sum(CASE WHEN label THEN weight ELSE 0 END) / sum(weight) AS p FROM ex_bin JOIN nat USING (ex_id) GROUP BY 1"


@case("lbfgs_binlog", f"SELECT fea_id AS idx, {R('ln(p / (1 - p))', 3)} AS x FROM nat_bin")
def lbfgs_binlog(spark, sf):
    """Logistic regression on one-hot features converges to the log-odds."""
    model = O.linear_binlog(BatchCycle(ex_bin(spark, sf), by_nation(spark, sf)), 25)
    state = M.LBFGS(5, max_iter=40, tolerance=1e-12).minimize(model, nations(spark, sf))
    return state.table.select("idx", rnd("x", 3).alias("x"))


@case("lbfgs_quantile", "SELECT count(*) AS n, true AS near FROM ex_reg")
def lbfgs_quantile(spark, sf):
    """A bias under quantile loss q settles at the (1-q) quantile of the label, by share of weight."""
    bias_only = bias(spark, sf)
    model = O.linear_quantile(BatchCycle(ex_reg(spark, sf), bias_only), 1, 0.67)
    x0 = spark.range(1).select(F.col("id").alias("idx"), F.lit(0.5).alias("v"))
    state = M.LBFGS(5, max_iter=25, tolerance=1e-10).minimize(model, x0)
    level = state.table.first()["x"]
    below = F.sum(F.when(F.col("label") <= level, F.col("weight")).otherwise(0.0)) / F.sum("weight")
    return ex_reg(spark, sf).agg(F.count(F.lit(1)).alias("n"), (F.abs(below - 0.33) < 0.02).alias("near"))


@case("lbfgs_softmax", "SELECT count(*) AS n, true AS calibrated FROM embeddings")
def lbfgs_softmax(spark, sf):
    """With a bias alone, fitted class probabilities are the average target weights."""
    from gradloom.operators.gradients import wide_targets
    from gradloom.suite.base import CLASSES, ex_multi

    targets = wide_targets(ex_multi(spark, sf), CLASSES)
    ones = targets.select("ex_id", F.lit(0).cast("bigint").alias("fea_id"), F.lit(1.0).alias("value"))
    x0 = spark.range(1).select(F.col("id").alias("idx"), F.explode(F.sequence(F.lit(0), F.lit(CLASSES - 1))).alias("k"), F.lit(0.0).alias("v"))
    model = O.linear_softmax(BatchCycle(targets, ones), 1, CLASSES)
    state = M.LBFGS(5, max_iter=30, tolerance=1e-12).minimize(model, x0)
    fitted = state.table.select("k", F.exp("x").alias("e"))
    share = fitted.select("k", (F.col("e") / F.sum("e").over(Window.partitionBy())).alias("p"))
    cells = F.array(*[F.avg(f"t{i}") for i in range(CLASSES)]).alias("t")
    wanted = targets.agg(cells, F.count(F.lit(1)).alias("n")).select("n", F.posexplode("t").alias("k", "t"))
    both = wanted.join(share, "k")
    return both.agg(F.max("n").alias("n"), (F.max(F.abs(F.col("t") - F.col("p"))) < 1e-4).alias("calibrated"))


def _ranking_run(spark, sf, method):
    state = method.minimize(ranking_model(spark, sf), rank_v(spark, sf))
    values = [t["value"] for t in state.trace]
    falling = all(b <= a for a, b in zip(values, values[1:])) and values[-1] < state.initial_value
    return state.table.agg(F.countDistinct("idx").alias("n"), F.lit(falling).alias("falling"))


_FALLING = "SELECT count(*) + 26 AS n, true AS falling FROM part"


@case("lbfgs_ranking", _FALLING)
def lbfgs_ranking(spark, sf):
    return _ranking_run(spark, sf, M.LBFGS(5, max_iter=3))


@case("sgd_ranking", _FALLING)
def sgd_ranking(spark, sf):
    """Gradient descent on the ranking loss plus a small L2 penalty."""
    model = O.Combined(1.0, ranking_model(spark, sf), 1e-3, O.L2Penalty(("idx", "k")))
    state = M.GradientDescent(0.1, 1 / 30, 1.0, max_iter=3).minimize(model, rank_v(spark, sf))
    falling = state.value < state.initial_value
    return state.table.agg(F.countDistinct("idx").alias("n"), F.lit(falling).alias("falling"))


@case("adagrad_ranking", _FALLING)
def adagrad_ranking(spark, sf):
    method = M.AdaGrad(0.1, l2=0.5e-4, l1=0.5e-6, max_age=12, max_iter=3)
    state = method.minimize(ranking_model(spark, sf), rank_v(spark, sf))
    return state.table.agg(F.countDistinct("idx").alias("n"), F.lit(state.value < state.trace[0]["value"]).alias("falling"))


@case("state_save_resume", _run_sql("sgd", 3))
def state_save_resume(spark, sf):
    """Two iterations, saved; the third after loading in a fresh minimizer."""
    path = f"{scratch(spark)}/state"
    first = M.GradientDescent(0.2, 0.5, 0.5, max_iter=2, lower_fun_tolerance=1e9)
    M.save_state(first.minimize(regression(spark, sf), w0(spark, sf)), path)
    from dataclasses import replace

    loaded = replace(M.load_state(spark, path), reason=None)
    second = M.GradientDescent(0.2, 0.5, 0.5, max_iter=3, lower_fun_tolerance=1e9)
    state = second.minimize(regression(spark, sf), w0(spark, sf), resume=loaded)
    return state.table.select("idx", rnd("x").alias("x"), rnd(F.lit(state.value)).alias("value"))


# --- runs over five batches ----------------------------------------------------------


def batched(spark, sf, policy="hold"):
    number = (F.col("ex_id") % BATCHES).alias("batch_id")
    return O.linear_l2(BatchCycle(ex_reg(spark, sf).select("*", number), fea(spark, sf).select("*", number), BATCHES, policy), dim(spark, sf))


def _batched_run(spark, sf, method, policy="hold"):
    state = method.minimize(batched(spark, sf, policy), w0(spark, sf))
    return state.table.select("idx", rnd("x").alias("x"), rnd(F.lit(state.value)).alias("value"))


_iterate("bsgd", 6, "v AS x", lambda i: f"x - {0.2 / (0.5 * i + 1) ** 0.5!r}::DOUBLE * g AS x", lambda i: i)


@case("sgd_batches", _run_sql("bsgd", 6))
def sgd_batches(spark, sf):
    """Six steps, each with the gradient of the next of five batches."""
    return _batched_run(spark, sf, M.GradientDescent(0.2, 0.5, 0.5, max_iter=6, lower_fun_tolerance=1e9))


_iterate("bada", 4, "v AS x, 0.0::DOUBLE AS h", _ada_next, lambda i: i)


@case("adagrad_batches", _run_sql("bada", 4))
def adagrad_batches(spark, sf):
    return _batched_run(spark, sf, M.AdaGrad(0.1, l2=0.05, l1=0.01, max_age=1, max_iter=4, lower_fun_tolerance=1e9))


_STEPS = [0.3, 0.6, 0.6, 0.6]
_lb_chain("blb", 4, lambda i: i)
_lb_chain("rlb", 3, lambda i: 2 * i)


@case("lbfgs_cycling_batches", _run_sql("blb", 4))
def lbfgs_cycling_batches(spark, sf):
    """Each point on the next batch: a stored pair spans two of them."""
    return _batched_run(spark, sf, M.LBFGS(1, fixed_steps=_STEPS, max_iter=4, lower_fun_tolerance=1e9))


@case("lbfgs_refresh_on_hold", _run_sql("rlb", 3))
def lbfgs_refresh_on_hold(spark, sf):
    """Holding for a step takes one batch, the next point another."""
    return _batched_run(spark, sf, M.LBFGS(1, fixed_steps=_STEPS, max_iter=3, lower_fun_tolerance=1e9), "refresh_on_hold")


@case("resume_mid_cycle", f"SELECT *, 1::INTEGER AS versions FROM ({_run_sql('blb', 4)})")
def resume_mid_cycle(spark, sf):
    """A run that stopped at its second of five batches goes on, in a fresh objective and minimizer, as if it had not."""
    store = RunStore(spark, f"{scratch(spark)}/run")
    M.LBFGS(1, fixed_steps=_STEPS, max_iter=2, lower_fun_tolerance=1e9).minimize(batched(spark, sf), w0(spark, sf), store=store)
    state = M.LBFGS(1, fixed_steps=_STEPS, max_iter=4, lower_fun_tolerance=1e9).minimize(batched(spark, sf), w0(spark, sf), store=store)
    rows = state.table.select("idx", rnd("x").alias("x"), rnd(F.lit(state.value)).alias("value"))
    return rows.withColumn("versions", F.lit(len(store.versions())))
