"""Registry of cases, and the learning fixtures built from the sample tables.

Every fixture exists twice: as a DataFrame and as a SQL common table
expression of the same name in ``CTES``.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Case(NamedTuple):
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


CASES: dict[str, Case] = {}


def case(name: str, sql: str | None = None):
    """Register a query under ``name``; ``sql`` may use any fixture by name."""

    def register(run):
        if name in CASES:
            raise ValueError(f"case {name} is registered twice")
        CASES[name] = Case(name, run, sql)
        return run

    return register


# Rounding that gives the same bits in both engines, without negative zero.


def rnd(c: Column | str, d: int = 6) -> Column:
    r = F.round(F.col(c) if isinstance(c, str) else c, d)
    return F.when(r == 0, F.lit(0.0)).otherwise(r)


def R(expr: str, d: int = 6) -> str:
    r = f"round(({expr})::DOUBLE, {d})"
    return f"CASE WHEN {r} = 0 THEN 0.0::DOUBLE ELSE {r} END"


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def rows_of(spark: SparkSession, sf: str, name: str) -> int:
    """Row count from the Parquet footers."""
    return read(spark, sf, name).count()


CTES: dict[str, str] = {}
# Fixtures that a statement uses several times and that are worked out once: the joins over them have no other good order.
ONCE = {"rank_sum", "rank_score"}


def with_fixtures(body: str) -> str:
    """Prefix the fixtures a statement uses, each after those it uses itself."""
    own, rest = re.match(r"\s*(?:WITH\s+(RECURSIVE\s+)?)?(.*)", body, re.S | re.I).groups()
    chained = body.lstrip().upper().startswith("WITH ")
    used: list[str] = []

    def visit(text: str) -> None:
        for word in re.findall(r"\b[a-z_][a-z0-9_]*\b", text):
            if word in CTES and word not in used and word not in open_names:
                open_names.add(word)
                visit(CTES[word])
                used.append(word)

    open_names: set[str] = set()
    visit(body)
    parts = [f"{n} AS {'MATERIALIZED ' if n in ONCE else ''}({CTES[n]})" for n in used]
    if not parts:
        return body
    if chained:
        return "WITH " + ",\n".join(parts) + ",\n" + rest
    return "WITH " + ",\n".join(parts) + "\n" + body


# --- sparse regression and classification over orders -----------------------

CTES["dims"] = "SELECT count(*) + 2 AS dim, count(*) AS parts FROM part"
CTES["w0"] = """SELECT idx, ((idx * 7) % 13 - 6) / 23.0::DOUBLE AS v
  FROM (SELECT p_partkey + 1 AS idx FROM part UNION ALL SELECT 0 UNION ALL SELECT count(*) + 1 FROM part)"""
CTES["fea_nobias"] = """SELECT l_orderkey AS ex_id, l_partkey + 1 AS fea_id, sum(l_quantity) / 50.0::DOUBLE AS value
  FROM lineitem GROUP BY 1, 2"""
CTES["fea"] = """SELECT ex_id, fea_id, value FROM fea_nobias
  UNION ALL SELECT o_orderkey, 0::BIGINT, 1.0::DOUBLE FROM orders"""
CTES["ex_reg"] = """SELECT o_orderkey AS ex_id, floor(o_totalprice / 100.0::DOUBLE) / 1000.0::DOUBLE AS label,
  (1 + o_custkey % 3)::DOUBLE AS weight FROM orders"""
CTES["ex_bin"] = """SELECT o_orderkey AS ex_id, o_orderstatus = 'F' AS label, (1 + o_custkey % 3)::DOUBLE AS weight
  FROM orders"""
CTES["score0"] = """SELECT e.ex_id, coalesce(s.score, 0.0::DOUBLE) AS score FROM (SELECT o_orderkey AS ex_id FROM orders) e
  LEFT JOIN (SELECT f.ex_id, sum(f.value * w0.v) AS score FROM fea f JOIN w0 ON f.fea_id = w0.idx GROUP BY 1) s
  ON e.ex_id = s.ex_id"""


def dim(spark, sf) -> int:
    return rows_of(spark, sf, "part") + 2


def modular_weights(ids: DataFrame) -> DataFrame:
    return ids.select("idx", (((F.col("idx") * 7) % 13 - 6) / F.lit(23.0)).alias("v"))


def w0(spark, sf) -> DataFrame:
    return modular_weights(spark.range(dim(spark, sf)).withColumnRenamed("id", "idx"))


def fea_nobias(spark, sf) -> DataFrame:
    lines = read(spark, sf, "lineitem")
    return lines.groupBy(F.col("l_orderkey").alias("ex_id"), (F.col("l_partkey") + 1).alias("fea_id")).agg(
        (F.sum("l_quantity") / 50.0).alias("value")
    )


def bias(spark, sf) -> DataFrame:
    orders = read(spark, sf, "orders")
    return orders.select(F.col("o_orderkey").alias("ex_id"), F.lit(0).cast("bigint").alias("fea_id"), F.lit(1.0).alias("value"))


def fea(spark, sf) -> DataFrame:
    return fea_nobias(spark, sf).unionByName(bias(spark, sf))


def order_weight() -> Column:
    return (F.lit(1) + F.col("o_custkey") % 3).cast("double").alias("weight")


def ex_reg(spark, sf) -> DataFrame:
    label = F.floor(F.col("o_totalprice") / 100.0).cast("double") / 1000.0
    return read(spark, sf, "orders").select(F.col("o_orderkey").alias("ex_id"), label.alias("label"), order_weight())


def ex_bin(spark, sf) -> DataFrame:
    label = F.col("o_orderstatus") == "F"
    return read(spark, sf, "orders").select(F.col("o_orderkey").alias("ex_id"), label.alias("label"), order_weight())


# --- vectors over parts ------------------------------------------------------

CTES["abc"] = """SELECT p_partkey AS idx, p_retailprice / 1000.0::DOUBLE AS a, p_size / 50.0::DOUBLE AS b,
  (p_partkey % 7 - 3) / 3.0::DOUBLE AS c FROM part"""
CTES["mat_a"] = """SELECT idx, k::INTEGER AS k, a * (k + 1) / 3.0::DOUBLE AS v FROM abc, range(5) t(k)"""
CTES["mat_b"] = """SELECT idx, k::INTEGER AS k, c - k / 7.0::DOUBLE AS v FROM abc, range(5) t(k)"""


def abc(spark, sf) -> DataFrame:
    return read(spark, sf, "part").select(
        F.col("p_partkey").alias("idx"),
        (F.col("p_retailprice") / 1000.0).alias("a"),
        (F.col("p_size") / 50.0).alias("b"),
        ((F.col("p_partkey") % 7 - 3) / 3.0).alias("c"),
    )


def vec(spark, sf, col: str) -> DataFrame:
    return abc(spark, sf).select("idx", F.col(col).alias("v"))


def _five(df: DataFrame) -> DataFrame:
    return df.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(4))))


def mat_a(spark, sf) -> DataFrame:
    return _five(abc(spark, sf)).select("idx", "k", (F.col("a") * (F.col("k") + 1) / 3.0).alias("v"))


def mat_b(spark, sf) -> DataFrame:
    return _five(abc(spark, sf)).select("idx", "k", (F.col("c") - F.col("k") / 7.0).alias("v"))


# --- multi-label classification of embeddings ---------------------------------

CLASSES, EMBED_DIM = 10, 64
CTES["fea_emb"] = """SELECT vec_id AS ex_id, (i - 1)::BIGINT AS fea_id, embedding[i]::DOUBLE AS value
  FROM embeddings, range(1, 65) t(i)"""
CTES["ex_multi"] = """SELECT vec_id AS ex_id, label::INTEGER AS cls, 0.75::DOUBLE AS tw, 1.0::DOUBLE AS weight FROM embeddings
  UNION ALL SELECT vec_id, ((label + 1) % 10)::INTEGER, 0.25::DOUBLE, 1.0::DOUBLE FROM embeddings"""
CTES["m0"] = """SELECT idx::BIGINT AS idx, k::INTEGER AS k, ((idx * 5 + k * 3) % 17 - 8) / 23.0::DOUBLE AS v
  FROM range(64) i(idx), range(10) j(k)"""
CTES["mscore"] = """SELECT f.ex_id, m0.k, sum(f.value * m0.v) AS score FROM fea_emb f JOIN m0 ON f.fea_id = m0.idx GROUP BY 1, 2"""
CTES["mprob"] = """SELECT ex_id, k, exp(score - mx) / sum(exp(score - mx)) OVER (PARTITION BY ex_id) AS prob
  FROM (SELECT *, max(score) OVER (PARTITION BY ex_id) AS mx FROM mscore)"""
CTES["mtgt"] = """SELECT p.ex_id, p.k, p.prob, coalesce(t.tw, 0.0::DOUBLE) AS tw FROM mprob p
  LEFT JOIN (SELECT ex_id, cls, sum(tw) AS tw FROM ex_multi GROUP BY 1, 2) t ON p.ex_id = t.ex_id AND p.k = t.cls"""
CTES["mloss"] = """SELECT ex_id, -sum(tw * ln(prob + 1e-24)) AS loss, sum(tw * prob / (prob + 1e-24)) AS pull,
  1.0::DOUBLE AS weight FROM mtgt GROUP BY 1"""
CTES["mslope"] = """SELECT t.ex_id, t.k, t.prob * l.pull - t.tw * t.prob / (t.prob + 1e-24) AS dscore
  FROM mtgt t JOIN mloss l ON t.ex_id = l.ex_id"""


def fea_emb(spark, sf) -> DataFrame:
    rows = read(spark, sf, "embeddings").select(F.col("vec_id").alias("ex_id"), F.posexplode("embedding").alias("pos", "e"))
    return rows.select("ex_id", F.col("pos").cast("bigint").alias("fea_id"), F.col("e").cast("double").alias("value"))


def ex_multi(spark, sf) -> DataFrame:
    rows = read(spark, sf, "embeddings").select(F.col("vec_id").alias("ex_id"), F.col("label").cast("int").alias("cls"))
    first = rows.withColumn("tw", F.lit(0.75))
    second = rows.select("ex_id", ((F.col("cls") + 1) % 10).alias("cls"), F.lit(0.25).alias("tw"))
    return first.unionByName(second).withColumn("weight", F.lit(1.0))


def m0(spark, sf) -> DataFrame:
    cells = spark.range(EMBED_DIM).select(F.col("id").alias("idx"), F.explode(F.sequence(F.lit(0), F.lit(CLASSES - 1))).alias("k"))
    return cells.select("idx", "k", (((F.col("idx") * 5 + F.col("k") * 3) % 17 - 8) / 23.0).alias("v"))


# --- two of very many classes for each customer ------------------------------------

MANY = 2000
CTES["many_fea"] = """SELECT c_custkey AS ex_id, c_nationkey::BIGINT AS fea_id, 1.0::DOUBLE AS value FROM customer
  UNION ALL SELECT c_custkey, 25::BIGINT, c_acctbal / 10007.0::DOUBLE FROM customer"""
CTES["many_x"] = f"""SELECT idx::BIGINT AS idx, k::INTEGER AS k, ((idx * 5 + k * 3) % 17 - 8) / 23.0::DOUBLE AS v
  FROM range(26) i(idx), range({MANY}) j(k)"""
CTES["many_t"] = f"""SELECT ex_id, k, sum(t) AS t FROM (
  SELECT c_custkey AS ex_id, (c_custkey * 7) % {MANY} AS k, 0.75::DOUBLE AS t FROM customer
  UNION ALL SELECT c_custkey, (c_custkey * 11 + 1) % {MANY}, 0.25::DOUBLE FROM customer) GROUP BY 1, 2"""
CTES["many_p"] = """SELECT ex_id, k, e / sum(e) OVER (PARTITION BY ex_id) AS p FROM (
  SELECT ex_id, k, exp(s - max(s) OVER (PARTITION BY ex_id)) AS e FROM (
  SELECT ex_id, k, sum(value * v) AS s FROM many_fea JOIN many_x ON fea_id = idx GROUP BY 1, 2))"""
CTES["many_cell"] = """SELECT p.ex_id, p.k, p, coalesce(t, 0.0::DOUBLE) AS t, (1 + p.ex_id % 3)::DOUBLE AS weight,
  coalesce(t, 0.0::DOUBLE) * p / (p + 1e-24) AS part FROM many_p p LEFT JOIN many_t t ON p.ex_id = t.ex_id AND p.k = t.k"""
CTES["many_loss"] = """SELECT ex_id, max(weight) AS weight, -max(weight) * sum(t * ln(p + 1e-24)) AS loss FROM many_cell GROUP BY 1"""
CTES["many_slope"] = """SELECT ex_id, k, weight * (p * sum(part) OVER (PARTITION BY ex_id) - part) AS dscore FROM many_cell"""
CTES["many_grad"] = """SELECT fea_id AS idx, k, sum(value * dscore) / (SELECT sum(weight) FROM many_loss) AS g
  FROM many_fea f JOIN many_slope s ON f.ex_id = s.ex_id GROUP BY 1, 2"""


def many_classes(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Long targets, features and parameters of ``MANY`` classes."""
    people = read(spark, sf, "customer").withColumn("ex_id", F.col("c_custkey"))

    def pairs(a, b, **names):
        return people.select("ex_id", F.explode(F.array(F.struct(*a), F.struct(*b))).alias("e")).select("ex_id", *[F.col(f"e.col{i + 1}").cast(t).alias(n) for i, (n, t) in enumerate(names.items())])

    key = F.col("c_custkey")
    targets = pairs([((key * 7) % MANY).cast("int").alias("col1"), F.lit(0.75).alias("col2")],
                    [((key * 11 + 1) % MANY).cast("int").alias("col1"), F.lit(0.25).alias("col2")], cls="int", tw="double")
    fea = pairs([F.col("c_nationkey").cast("bigint").alias("col1"), F.lit(1.0).alias("col2")],
                [F.lit(25).cast("bigint").alias("col1"), (F.col("c_acctbal") / 10007.0).alias("col2")], fea_id="bigint", value="double")
    cells = spark.range(26).select(F.col("id").alias("idx"), F.explode(F.sequence(F.lit(0), F.lit(MANY - 1))).alias("k"))
    x = cells.select("idx", "k", (((F.col("idx") * 5 + F.col("k") * 3) % 17 - 8) / 23.0).alias("v"))
    return targets.withColumn("weight", (F.col("ex_id") % 3 + 1).cast("double")), fea, x


# --- ranking of items in orders -------------------------------------------------

FACTORS, ROUNDS, PER_ROUND = 4, 3, 5
CTES["rank_pos"] = """SELECT o_orderkey AS ex_id, o_orderkey AS link_id, 1.0::DOUBLE AS rel_weight,
  (1 + o_custkey % 3)::DOUBLE AS weight, l.item, o_custkey % 20 AS cust, substr(o_orderpriority, 1, 1)::BIGINT AS prio
  FROM orders JOIN (SELECT l_orderkey, min(l_partkey) AS item FROM lineitem GROUP BY 1) l ON l_orderkey = o_orderkey"""
CTES["rank_neg"] = """SELECT ex_id * 5 + i AS ex_id, link_id, rel_weight / 15.0::DOUBLE AS rel_weight, weight,
  (item + 1 + (link_id * 31 + iter * 17 + i * 7) % (parts - 1)) % parts AS item, cust, prio,
  iter::INTEGER AS iter, i::INTEGER AS i FROM rank_pos, dims, range(3) a(iter), range(5) b(i)"""
CTES["rank_ex"] = """SELECT *, -1 AS iter, 0 AS i FROM rank_pos UNION ALL BY NAME SELECT * FROM rank_neg"""
CTES["rank_fea"] = """SELECT link_id, iter, i, item AS fea_id, 1.0::DOUBLE AS value FROM rank_ex
  UNION ALL SELECT link_id, iter, i, parts + cust, 0.5::DOUBLE FROM rank_ex, dims
  UNION ALL SELECT link_id, iter, i, parts + 20 + prio, 1.0::DOUBLE FROM rank_ex, dims"""
CTES["rank_v"] = """SELECT idx, k::INTEGER AS k, ((idx * 11 + k * 5) % 19 - 9) / 23.0::DOUBLE AS v
  FROM (SELECT unnest(range(parts + 26)) AS idx FROM dims), range(4) j(k)"""
CTES["rank_sum"] = """SELECT f.link_id, f.iter, f.i, v.k, sum(f.value * v.v) AS s, sum(f.value * f.value * v.v * v.v) AS q
  FROM rank_fea f JOIN rank_v v ON f.fea_id = v.idx GROUP BY 1, 2, 3, 4"""
CTES["rank_score"] = """SELECT link_id, iter, i, 0.5::DOUBLE * sum(s * s - q) AS score FROM rank_sum GROUP BY 1, 2, 3"""
CTES["rank_pair"] = """SELECT n.link_id, n.iter, n.i, p.weight * n.rel_weight AS weight, ps.score AS pos_score, ns.score AS neg_score,
  1 / (1 + exp(ns.score - ps.score)) AS sig
  FROM rank_neg n JOIN rank_pos p ON n.link_id = p.link_id
  JOIN rank_score ns ON ns.link_id = n.link_id AND ns.iter = n.iter AND ns.i = n.i
  JOIN rank_score ps ON ps.link_id = n.link_id AND ps.iter = -1"""
CTES["rank_loss"] = """SELECT link_id, iter, i, -weight * ln(sig + 1e-24) AS loss, weight,
  -weight * sig * (1 - sig) / (sig + 1e-24) AS dpos FROM rank_pair"""
CTES["rank_slope"] = """SELECT link_id, iter, i, -dpos AS dscore FROM rank_loss
  UNION ALL SELECT link_id, -1, 0, sum(dpos) FROM rank_loss GROUP BY 1"""
CTES["rank_pull"] = """SELECT f.fea_id, s.k, sum(f.value * sl.dscore * s.s) AS a, sum(f.value * f.value * sl.dscore) AS c
  FROM rank_fea f JOIN rank_slope sl ON f.link_id = sl.link_id AND f.iter = sl.iter AND f.i = sl.i
  JOIN rank_sum s ON s.link_id = f.link_id AND s.iter = f.iter AND s.i = f.i GROUP BY 1, 2"""
CTES["rank_grad"] = """SELECT p.fea_id AS idx, p.k, (p.a - v.v * p.c) / (SELECT sum(weight) FROM rank_loss) AS g
  FROM rank_pull p JOIN rank_v v ON v.idx = p.fea_id AND v.k = p.k"""

# The same chain with the negatives of the next epoch.
_NEXT = r"\brank_(neg|ex|fea|sum|score|pair|loss|slope|pull|grad)\b"
for _name in re.findall(r"rank_[a-z]+", " ".join(CTES)):
    if re.fullmatch(_NEXT, _name):
        CTES[_name.replace("rank_", "rank1_")] = re.sub(_NEXT, r"rank1_\1", CTES[_name])
CTES["rank1_neg"] = CTES["rank1_neg"].replace("i * 7)", "i * 7 + 13)")
ONCE |= {"rank1_sum", "rank1_score"}


def rank_pos(spark, sf) -> DataFrame:
    items = read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_partkey").alias("item"))
    orders = read(spark, sf, "orders").join(items, "o_orderkey")
    return orders.select(
        F.col("o_orderkey").alias("ex_id"),
        F.col("o_orderkey").alias("link_id"),
        F.lit(1.0).alias("rel_weight"),
        order_weight(),
        "item",
        (F.col("o_custkey") % 20).alias("cust"),
        F.substring("o_orderpriority", 1, 1).cast("bigint").alias("prio"),
    )


def modular_choice() -> Column:
    return F.col("link_id") * 31 + F.col("iter") * 17 + F.col("i") * 7


def rank_sampler(parts: int, epochs: bool = False):
    """The sampler of ``rank_neg``; with ``epochs``, of a column ``epoch`` too."""
    from gradloom.operators.ranking import uniform_items

    return uniform_items(parts, ROUNDS, PER_ROUND, modular_choice() + F.col("epoch") * 13 if epochs else modular_choice())


def rank_features(parts: int):
    """Feature rows of keyed ranking examples: item, customer group, priority."""

    def featurize(examples: DataFrame) -> DataFrame:
        def entry(idx, value):
            return F.struct(idx.cast("bigint").alias("fea_id"), F.lit(value).alias("value"))

        entries = F.array(
            entry(F.col("item"), 1.0), entry(F.lit(parts) + F.col("cust"), 0.5), entry(F.lit(parts + 20) + F.col("prio"), 1.0)
        )
        return examples.select("link_id", "iter", "i", F.explode(entries).alias("f")).select("link_id", "iter", "i", "f.fea_id", "f.value")

    return featurize


def rank_v(spark, sf) -> DataFrame:
    parts = rows_of(spark, sf, "part")
    cells = spark.range(parts + 26).select(F.col("id").alias("idx"), F.explode(F.sequence(F.lit(0), F.lit(FACTORS - 1))).alias("k"))
    return cells.select("idx", "k", (((F.col("idx") * 11 + F.col("k") * 5) % 19 - 9) / 23.0).alias("v"))


# --- transport between customers and suppliers -----------------------------------

EPS = 0.1
CTES["ot_x"] = "SELECT c_custkey AS id, c_acctbal / 9973.0::DOUBLE AS p0, c_nationkey / 23.0::DOUBLE AS p1 FROM customer"
CTES["ot_y"] = "SELECT s_suppkey AS id, s_acctbal / 9973.0::DOUBLE AS p0, s_nationkey / 23.0::DOUBLE AS p1 FROM supplier"
CTES["pot0"] = """SELECT 'u' AS side, id AS idx, (id % 7) / 16.0::DOUBLE AS p FROM ot_x
  UNION ALL SELECT 'v', id, (id % 5) / 16.0::DOUBLE FROM ot_y"""
CTES["ot_cost"] = """SELECT x.id AS i, y.id AS j, 0.5::DOUBLE * ((x.p0 - y.p0) * (x.p0 - y.p0) + (x.p1 - y.p1) * (x.p1 - y.p1)) AS c
  FROM ot_x x, ot_y y"""
CTES["ot_exp"] = """SELECT i, j, exp((u.p + v.p - c) / 0.1::DOUBLE)
    / ((SELECT count(*) FROM ot_x) * (SELECT count(*) FROM ot_y)) AS e
  FROM ot_cost JOIN pot0 u ON u.side = 'u' AND u.idx = i JOIN pot0 v ON v.side = 'v' AND v.idx = j"""
CTES["ot_mass"] = """SELECT 'u' AS side, i AS idx, sum(e) AS mass FROM ot_exp GROUP BY i
  UNION ALL SELECT 'v', j, sum(e) FROM ot_exp GROUP BY j"""


def ot_points(spark, sf, table: str, prefix: str) -> DataFrame:
    key = {"c": "c_custkey", "s": "s_suppkey"}[prefix]
    p = F.array(F.col(f"{prefix}_acctbal") / 9973.0, F.col(f"{prefix}_nationkey") / 23.0)
    return read(spark, sf, table).select(F.col(key).alias("id"), p.alias("p"))


def ot_pair(spark, sf):
    from gradloom.operators.transport import PointPair

    return PointPair.of(ot_points(spark, sf, "customer", "c"), ot_points(spark, sf, "supplier", "s"))


def pot0(spark, sf) -> DataFrame:
    u = read(spark, sf, "customer").select(F.lit("u").alias("side"), F.col("c_custkey").alias("idx"), ((F.col("c_custkey") % 7) / 16.0).alias("p"))
    v = read(spark, sf, "supplier").select(F.lit("v").alias("side"), F.col("s_suppkey").alias("idx"), ((F.col("s_suppkey") % 5) / 16.0).alias("p"))
    return u.unionByName(v)
