"""Builders, readers, writers and generators."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from gradloom.operators import scoring as S
from gradloom.operators import transport as T
from gradloom.operators.vectors import dense_blocks
from gradloom.plans.lineage import checkpoint_dir
from gradloom.sources import builders as B
from gradloom.sources import generators as N
from gradloom.sources import tables as IO
from gradloom.suite.base import (
    CLASSES,
    CTES,
    EMBED_DIM,
    R,
    abc,
    case,
    dim,
    ex_reg,
    fea,
    fea_emb,
    m0,
    mat_a,
    ot_pair,
    ot_points,
    pot0,
    read,
    rnd,
    rows_of,
    vec,
    w0,
)
from gradloom.suite.examples import scores


def scratch(spark) -> str:
    """A fresh folder name under the shared checkpoint folder."""
    return f"{checkpoint_dir(spark)}/tables-{uuid.uuid4().hex}"


# --- sources and sinks -------------------------------------------------------------


@case("vec_write_read", f"SELECT idx, {R('a')} AS v FROM abc")
def vec_write_read(spark, sf):
    path = f"{scratch(spark)}/vector"
    IO.write_vector(vec(spark, sf, "a"), path, files=4)
    return IO.read_vector(spark, path).select("idx", rnd("v").alias("v"))


@case("mat_write_read", f"SELECT idx, k, {R('v')} AS v FROM mat_a")
def mat_write_read(spark, sf):
    path = f"{scratch(spark)}/matrix"
    IO.write_vector(mat_a(spark, sf), path, files=4)
    return IO.read_vector(spark, path).select("idx", "k", rnd("v").alias("v"))


@case("examples_write_read", f"SELECT ex_id, {R('label')} AS label, weight, (ex_id % 5)::INTEGER AS fold FROM ex_reg WHERE ex_id % 5 IN (1, 3)")
def examples_write_read(spark, sf):
    """Folds live in their own folders; reading two of five touches only theirs."""
    path = f"{scratch(spark)}/examples"
    IO.write_examples(ex_reg(spark, sf).withColumn("fold", (F.col("ex_id") % 5).cast("int")), path)
    return IO.read_examples(spark, path, [1, 3]).select("ex_id", rnd("label").alias("label"), "weight", "fold")


@case("costs_write_read", f"SELECT i, j, {R('c')} AS c FROM ot_cost")
def costs_write_read(spark, sf):
    path = f"{scratch(spark)}/costs"
    IO.write_costs(T.ot_costs(ot_pair(spark, sf)), path, files=8)
    return IO.read_costs(spark, path).select("i", "j", rnd("c").alias("c"))


@case("vec_from_array", f"SELECT vec_id * 64 + i - 1 AS idx, {R('embedding[i]')} AS v FROM embeddings, range(1, 65) t(i)")
def vec_from_array(spark, sf):
    blocks = read(spark, sf, "embeddings").withColumn("start", F.col("vec_id") * 64)
    return B.vector_from_array(blocks, "embedding", "start").select("idx", rnd("v").alias("v"))


@case(
    "vec_from_rows",
    f"""SELECT p_partkey AS idx, {R('coalesce(v, 0)')} AS v FROM part LEFT JOIN (
    SELECT l_partkey, sum(l_quantity) / 50.0::DOUBLE AS v FROM lineitem WHERE l_quantity > 45 GROUP BY 1) ON l_partkey = p_partkey""",
)
def vec_from_rows(spark, sf):
    return quantities(spark, sf, read(spark, sf, "lineitem").filter("l_quantity > 45"))


@case(
    "vec_from_rows_all",
    f"""SELECT idx, {R('coalesce(v, 0)')} AS v FROM (SELECT unnest(range(2 * count(*))) AS idx FROM part) LEFT JOIN (
    SELECT l_partkey, sum(l_quantity) / 50.0::DOUBLE AS v FROM lineitem GROUP BY 1) ON l_partkey = idx""",
)
def vec_from_rows_all(spark, sf):
    """All lines; the second half of the vector has no rows and is 0."""
    return quantities(spark, sf, read(spark, sf, "lineitem"), 2)


def quantities(spark, sf, lines, times=1):
    rows = lines.select(F.col("l_partkey").alias("idx"), (F.col("l_quantity") / 50.0).alias("v"))
    return B.vector_from_rows(spark, rows, times * rows_of(spark, sf, "part"), on_repeat="sum").select("idx", rnd("v").alias("v"))


def _mat_sql(idx, k):
    return f"SELECT {idx} AS idx, {k} AS k, {R('e')} AS v FROM (SELECT vec_id, i - 1 AS pos, embedding[i] AS e FROM embeddings, range(1, 65) t(i))"


@case("mat_from_array", _mat_sql("vec_id", "pos::INTEGER"))
def mat_from_array(spark, sf):
    """Column-major: every embedding is one column of the matrix."""
    rows = read(spark, sf, "embeddings").select("vec_id", F.array("embedding").alias("m"))
    return B.matrix_from_array(rows, row_major=False, offset="vec_id").select("idx", "k", rnd("v").alias("v"))


@case("mat_from_nested_array", f"SELECT ex_id * 4 + i AS idx, k::INTEGER AS k, {R('e')} AS v FROM (SELECT vec_id AS ex_id, i, k, embedding[k * 4 + i + 1] AS e FROM embeddings, range(4) a(i), range(16) b(k))")
def mat_from_nested_array(spark, sf):
    """Row-major nested arrays: 16 rows of 4 columns per embedding, side by side."""
    rows = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda k: F.slice("embedding", k * 4 + 1, 4))
    nested = read(spark, sf, "embeddings").select((F.col("vec_id") * 4).alias("start"), rows.alias("m"))
    return B.matrix_from_array(nested, offset="start").select("idx", "k", rnd("v").alias("v"))


@case("mat_from_rows", _mat_sql("vec_id", "pos::INTEGER") + " UNION ALL SELECT (SELECT count(*) FROM embeddings) AS idx, k::INTEGER, 0.0::DOUBLE FROM range(64) t(k)")
def mat_from_rows(spark, sf):
    """Rows of arrays; the last column of the matrix has no row and is 0."""
    rows = read(spark, sf, "embeddings").select(F.col("vec_id").alias("idx"), F.col("embedding").cast("array<double>").alias("v"))
    n = rows_of(spark, sf, "embeddings")
    return B.matrix_from_rows(spark, rows, n + 1, EMBED_DIM).select("idx", "k", rnd("v").alias("v"))


@case("vec_dense_blocks", "SELECT idx // 217 AS block, string_agg(round(a, 4)::DECIMAL(18, 4)::VARCHAR, ',' ORDER BY idx) AS vals, count(*) AS n FROM abc GROUP BY 1")
def vec_dense_blocks(spark, sf):
    blocks = dense_blocks(vec(spark, sf, "a"), 217)
    text = F.transform("values", lambda v: F.round(v, 4).cast("decimal(18,4)").cast("string"))
    return blocks.select("block", F.array_join(text, ",").alias("vals"), F.size("values").cast("bigint").alias("n"))


# --- generators ----------------------------------------------------------------------


@case("gen_uniform_vec", "SELECT count(*) AS n, true AS in_range, true AS centred, true AS spread FROM part")
def gen_uniform_vec(spark, sf):
    """Uniform weights for every part: range, mean and variance."""
    out = N.uniform_vector(read(spark, sf, "part").select(F.col("p_partkey").alias("idx")), seed=7, scale=0.3)
    n = F.count(F.lit(1))
    return out.agg(
        n.alias("n"),
        (F.min("v") >= 0).__and__(F.max("v") < 0.3).alias("in_range"),
        (F.abs(F.avg("v") - 0.15) < 5 * 0.3 / F.sqrt(12.0 * n)).alias("centred"),
        (F.abs(F.var_samp("v") / (0.09 / 12.0) - 1.0) < 5 / F.sqrt(n)).alias("spread"),
    )


@case("gen_uniform_mat", "SELECT k::INTEGER AS k, (SELECT count(*) FROM part) AS n, true AS in_range FROM range(10) t(k)")
def gen_uniform_mat(spark, sf):
    out = N.uniform_matrix(read(spark, sf, "part").select(F.col("p_partkey").alias("idx")), 10, seed=3)
    return out.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min(F.col("v").between(0.0, 1.0)).alias("in_range"))


CTES["gen_draw"] = """SELECT o_orderkey AS ex_id, d AS draw, (o_orderkey * 7919 + d * 104729) % 1009 AS fea_id,
  ((o_orderkey * 31 + d * 17) % 201 - 100) / 101.0::DOUBLE AS value FROM orders, range(30) t(d)"""


@case("gen_sparse_examples", f"SELECT ex_id, fea_id, {R('arg_min(value, draw)')} AS value FROM gen_draw GROUP BY 1, 2")
def gen_sparse_examples(spark, sf):
    """Thirty modular draws per order; a repeated feature keeps its first value."""
    ids = read(spark, sf, "orders").select(F.col("o_orderkey").alias("ex_id"))
    pick = (F.col("ex_id") * 7919 + F.col("draw") * 104729) % 1009
    value = ((F.col("ex_id") * 31 + F.col("draw") * 17) % 201 - 100) / 101.0
    out = N.sparse_examples(ids, 30, 1009, pick, value)
    return out.select("ex_id", "fea_id", rnd("value").alias("value"))


@case("gen_sparse_examples_hashed", "SELECT o_orderkey AS ex_id, true AS enough, true AS in_range FROM orders")
def gen_sparse_examples_hashed(spark, sf):
    """Hashed draws: no repeated feature, ids and values in range."""
    ids = read(spark, sf, "orders").select(F.col("o_orderkey").alias("ex_id"))
    out = N.sparse_examples(ids, 30, 1_000_000, seed=5)
    ok = F.col("fea_id").between(0, 999_999) & F.col("value").between(-1.0, 1.0)
    counts = out.groupBy("ex_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("fea_id").alias("m"), F.min(ok).alias("in_range"))
    return counts.select("ex_id", ((F.col("n") == F.col("m")) & F.col("n").between(25, 30)).alias("enough"), "in_range")


@case("label_by_score", f"SELECT ex_id, {R('score')} AS label, weight FROM ex_reg JOIN score0 USING (ex_id)")
def label_by_score(spark, sf):
    out = N.label_by_score(ex_reg(spark, sf), scores(spark, sf))
    return out.select("ex_id", rnd("label").alias("label"), "weight")


CTES["draws"] = "SELECT vec_id AS ex_id, ((vec_id * 7919) % 1000 + 0.5::DOUBLE) / 1000.0::DOUBLE AS u FROM embeddings"


@case(
    "label_by_softmax_draw",
    """SELECT ex_id, min(k)::INTEGER AS cls FROM (SELECT p.ex_id, p.k, d.u, sum(p.prob) OVER (PARTITION BY p.ex_id ORDER BY p.k) AS running
    FROM mprob p JOIN draws d ON d.ex_id = p.ex_id) WHERE running > u OR k = 9 GROUP BY 1""",
)
def label_by_softmax_draw(spark, sf):
    wide = S.score_linear_multi(fea_emb(spark, sf), m0(spark, sf), CLASSES, EMBED_DIM)
    u = ((F.col("ex_id") * 7919) % 1000 + F.lit(0.5)) / 1000.0
    return N.label_by_softmax_draw(wide, CLASSES, u)


@case("gen_ball_points", "SELECT count(*) AS n, true AS inside, true AS centred, true AS radius_law FROM customer")
def gen_ball_points(spark, sf):
    """Points of a 5-ball: inside it, centred, and half of them beyond the median radius."""
    d = 5
    ids = read(spark, sf, "customer").select(F.col("c_custkey").alias("id"))
    points = N.ball_points(ids, d, seed=1)
    length = F.sqrt(F.aggregate("p", F.lit(0.0), lambda acc, z: acc + z * z))
    n = F.count(F.lit(1))
    beyond = F.avg((F.col("len") > 0.5 ** (1 / d)).cast("double"))
    means = [F.abs(F.avg(F.col("p")[a])) < 5 / F.sqrt(n * (d + 2)) for a in range(d)]
    centred = means[0]
    for m in means[1:]:
        centred = centred & m
    rows = points.withColumn("len", length)
    return rows.agg(n.alias("n"), (F.max("len") <= 1.0 + 1e-12).alias("inside"), centred.alias("centred"), (F.abs(beyond - 0.5) < 2.5 / F.sqrt(n)).alias("radius_law"))


@case("gen_mixture_points", "SELECT count(*) AS n, true AS near_a_centre, true AS both_sides FROM customer")
def gen_mixture_points(spark, sf):
    """Every point lies within half a unit of some centre at plus or minus half an axis."""
    d = 4
    ids = read(spark, sf, "customer").select(F.col("c_custkey").alias("id"))
    points = N.mixture_points(ids, d, balls=4, seed=2)
    square = F.aggregate("p", F.lit(0.0), lambda acc, z: acc + z * z)
    reach = F.array_max(F.transform("p", lambda z: F.abs(z)))
    gap = square - reach + F.lit(0.25)  # squared distance to the nearest centre
    rows = points.select(gap.alias("gap"), F.expr("aggregate(p, 0D, (a, z) -> a + z)").alias("total"))
    return rows.agg(
        F.count(F.lit(1)).alias("n"),
        (F.max("gap") <= 0.25 + 1e-9).alias("near_a_centre"),
        ((F.min("total") < 0) & (F.max("total") > 0)).alias("both_sides"),
    )
