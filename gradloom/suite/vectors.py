"""Vector algebra over the part table."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradloom.functions import elementwise as E
from gradloom.operators import vectors as V
from gradloom.suite.base import R, abc, case, mat_a, mat_b, rnd, vec

MK = V.MATRIX_KEYS


def _out(df, keys=("idx",), d=6):
    return df.select(*keys, rnd("v", d).alias("v"))


def _binary(name, f, expr):
    @case(f"vec_{name}", f"SELECT idx, {R(expr)} AS v FROM abc")
    def vector(spark, sf):
        return _out(f(vec(spark, sf, "a"), vec(spark, sf, "b")))

    on_mats = expr.replace("a", "x.v").replace("b", "y.v")

    @case(f"mat_{name}", f"SELECT x.idx, x.k, {R(on_mats)} AS v FROM mat_a x JOIN mat_b y ON x.idx = y.idx AND x.k = y.k")
    def matrix(spark, sf):
        return _out(f(mat_a(spark, sf), mat_b(spark, sf), MK), MK)


_binary("add", V.add, "a + b")
_binary("sub", V.subtract, "a - b")
_binary("mul", V.multiply, "a * b")


@case("vec_div", f"SELECT idx, {R('c / a')} AS v FROM abc")
def vec_div(spark, sf):
    return _out(V.divide(vec(spark, sf, "c"), vec(spark, sf, "a")))


@case(
    "vec_div_by_zero",
    f"""SELECT idx, CASE WHEN c = 0 AND a > 0 THEN 'inf' WHEN c = 0 THEN 'other' ELSE 'finite' END AS kind,
    CASE WHEN c <> 0 THEN {R('a / c')} END AS v FROM abc""",
)
def vec_div_by_zero(spark, sf):
    out = V.divide(vec(spark, sf, "a"), vec(spark, sf, "c"))
    infinite = F.col("v") == float("inf")
    finite = F.abs("v") < float("inf")
    kind = F.when(infinite, "inf").when(finite, "finite").otherwise("other")
    return out.select("idx", kind.alias("kind"), F.when(finite, rnd("v")).alias("v"))


@case(
    "mat_div",
    f"SELECT x.idx, x.k, {R('y.v / x.v')} AS v FROM mat_a x JOIN mat_b y ON x.idx = y.idx AND x.k = y.k",
)
def mat_div(spark, sf):
    return _out(V.divide(mat_b(spark, sf), mat_a(spark, sf), MK), MK)


@case("vec_scale", f"SELECT idx, {R('a * 0.312')} AS v FROM abc")
def vec_scale(spark, sf):
    return _out(V.scale(vec(spark, sf, "a"), 0.312))


@case("mat_scale", f"SELECT idx, k, {R('v * 0.312')} AS v FROM mat_a")
def mat_scale(spark, sf):
    return _out(V.scale(mat_a(spark, sf), 0.312, MK), MK)


@case("vec_map", f"SELECT idx, {R('exp(-c) + sqrt(abs(c))')} AS v FROM abc")
def vec_map(spark, sf):
    return _out(V.map_values(vec(spark, sf, "c"), lambda v: F.exp(-v) + F.sqrt(F.abs(v))))


@case("vec_zip_map", f"SELECT idx, {R('greatest(a, c) * b')} AS v FROM (SELECT idx, a, c, a - c AS b FROM abc)")
def vec_zip_map(spark, sf):
    f = lambda a, c: F.greatest(a, c) * (a - c)
    return _out(V.zip_map(vec(spark, sf, "a"), vec(spark, sf, "c"), f))


@case("vec_zip_map_keyed", f"SELECT idx, {R('CASE WHEN idx % 3 = 0 THEN a ELSE c / (1 + idx % 5) END')} AS v FROM abc")
def vec_zip_map_keyed(spark, sf):
    f = lambda i, a, c: F.when(i % 3 == 0, a).otherwise(c / (1 + i % 5))
    return _out(V.zip_map(vec(spark, sf, "a"), vec(spark, sf, "c"), f, keyed=True))


@case(
    "mat_zip_map_keyed",
    f"""SELECT x.idx, x.k, {R('CASE WHEN (x.idx + x.k) % 2 = 0 THEN x.v ELSE y.v END')} AS v
    FROM mat_a x JOIN mat_b y ON x.idx = y.idx AND x.k = y.k""",
)
def mat_zip_map_keyed(spark, sf):
    f = lambda i, k, a, b: F.when((i + k) % 2 == 0, a).otherwise(b)
    return _out(V.zip_map(mat_a(spark, sf), mat_b(spark, sf), f, MK, keyed=True), MK)


@case("vec_dot", f"SELECT {R('sum(a * c)', 4)} AS dot FROM abc")
def vec_dot(spark, sf):
    return V.dot(abc(spark, sf), "a", "c").select(rnd("dot", 4).alias("dot"))


@case("mat_dot", f"SELECT {R('sum(x.v * y.v)', 4)} AS dot FROM mat_a x JOIN mat_b y ON x.idx = y.idx AND x.k = y.k")
def mat_dot(spark, sf):
    return V.dot(V.align(mat_a(spark, sf), mat_b(spark, sf), MK), "a", "b").select(rnd("dot", 4).alias("dot"))


@case(
    "vec_norm",
    f"""SELECT p, {R('n', 4)} AS norm FROM (
    SELECT 2.0::DOUBLE AS p, sqrt(sum(c * c)) AS n FROM abc UNION ALL
    SELECT 1.0::DOUBLE, sum(abs(c)) FROM abc UNION ALL
    SELECT 0.5::DOUBLE, pow(sum(sqrt(abs(c))), 2) / (SELECT count(*) FROM abc) FROM abc UNION ALL
    SELECT -1.0::DOUBLE, 1 / sum(1 / a) * (SELECT count(*) FROM abc) FROM abc UNION ALL
    SELECT 3.0::DOUBLE, pow(sum(pow(abs(c), 3)), 1.0 / 3) FROM abc)""",
)
def vec_norm(spark, sf):
    """Norms of several orders; those of p = 0.5 and -1 are divided by or multiplied with the size."""
    table = abc(spark, sf)
    n = F.lit(float(table.count()))
    parts = []
    for p, col, fix in ((2.0, "c", None), (1.0, "c", None), (0.5, "c", 1 / n), (-1.0, "a", n), (3.0, "c", None)):
        one = V.norm(table, col, p)
        value = F.col("norm") if fix is None else F.col("norm") * fix
        parts.append(one.select(F.lit(p).alias("p"), rnd(value, 4).alias("norm")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@case("mat_norm", f"SELECT {R('sqrt(sum(v * v))', 4)} AS norm FROM mat_b")
def mat_norm(spark, sf):
    return V.norm(mat_b(spark, sf)).select(rnd("norm", 4).alias("norm"))


@case("vec_sign", "SELECT idx, CASE WHEN c > 0 THEN 1.0::DOUBLE WHEN c < 0 THEN -1.0::DOUBLE ELSE 0.0::DOUBLE END AS v FROM abc")
def vec_sign(spark, sf):
    return _out(V.map_values(vec(spark, sf, "c"), E.sign))


@case("vec_count", "SELECT count(*) AS n FROM abc")
def vec_count(spark, sf):
    return vec(spark, sf, "a").agg(F.count(F.lit(1)).alias("n"))


@case("vec_lincomb", f"SELECT idx, {R('1.7 * a - 0.4 * c')} AS v FROM abc")
def vec_lincomb(spark, sf):
    return _out(V.linear_combination(1.7, vec(spark, sf, "a"), -0.4, vec(spark, sf, "c")))


_PAIRS = [(i, j) for i in range(3) for j in range(i, 3)]


@case(
    "vec_many_dots",
    "SELECT " + ", ".join(f"{R(f'sum({a} * {b})', 4)} AS dot_{i}_{j}" for i, a in enumerate("abc") for j, b in enumerate("abc") if i <= j) + " FROM abc",
)
def vec_many_dots(spark, sf):
    return V.gram(abc(spark, sf), ["a", "b", "c"]).select(*[rnd(f"dot_{i}_{j}", 4).alias(f"dot_{i}_{j}") for i, j in _PAIRS])


@case("vec_expression", f"SELECT idx, {R('(a * b - ((c * 0.312 + a) + b) * c)')} AS v FROM abc")
def vec_expression(spark, sf):
    """A compound expression on vectors that share a table: one projection."""
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    return abc(spark, sf).select("idx", rnd(a * b - ((c * 0.312 + a) + b) * c).alias("v"))


@case("map_blocks", f"SELECT idx, {R('exp(c) * 2 - c')} AS v FROM abc")
def map_blocks(spark, sf):
    import numpy as np

    return _out(V.map_blocks(abc(spark, sf), 217, lambda c: np.exp(c) * 2 - c, ["c"]))


@case("map_blocks_binary", f"SELECT idx, {R('a * c + b')} AS v FROM abc")
def map_blocks_binary(spark, sf):
    return _out(V.map_blocks(abc(spark, sf), 217, lambda a, b, c: a * c + b, ["a", "b", "c"]))


@case("map_blocks_keyed", f"SELECT idx, {R('c * (idx % 4) + a')} AS v FROM abc")
def map_blocks_keyed(spark, sf):
    return _out(V.map_blocks(abc(spark, sf), 217, lambda i, a, c: c * (i % 4) + a, ["a", "c"], keyed=True))


@case(
    "mat_map_blocks",
    f"SELECT idx, k, {R('v * 2 + 1')} AS v FROM (SELECT idx, k, v - sum(v) OVER (PARTITION BY idx) AS v FROM mat_b)",
)
def mat_map_blocks(spark, sf):
    """Blocks of whole matrix columns: twice a column's values less its sum, and one."""
    return _out(V.map_matrix_blocks(mat_b(spark, sf), 5, 217, lambda m: (m - m.sum(axis=0)) * 2 + 1), MK)


@case(
    "mat_map_blocks_binary",
    f"""SELECT idx, k, {R('coalesce(a, 0) * tot + coalesce(b, 0)')} AS v FROM (
    SELECT coalesce(a.idx, b.idx) AS idx, coalesce(a.k, b.k) AS k, a.v AS a, b.v AS b,
      sum(coalesce(b.v, 0)) OVER (PARTITION BY coalesce(a.idx, b.idx)) AS tot
    FROM mat_a a FULL JOIN mat_b b ON a.idx = b.idx AND a.k = b.k)""",
)
def mat_map_blocks_binary(spark, sf):
    """Two matrices side by side: the first times the second's column sum, plus the second."""
    return _out(V.map_matrix_blocks(mat_a(spark, sf), 5, 217, lambda a, b: a * b.sum(axis=0) + b, mat_b(spark, sf)), MK)


@case("mat_map_blocks_keyed", f"SELECT idx, k, {R('v * (idx % 4) + k')} AS v FROM mat_b")
def mat_map_blocks_keyed(spark, sf):
    import numpy as np

    return _out(V.map_matrix_blocks(mat_b(spark, sf), 5, 217, lambda i, m: m * (i % 4) + np.arange(5)[:, None], keyed=True), MK)
