"""Negative sampling and pairwise ranking over orders and their items."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gradloom.operators import ranking as K
from gradloom.operators.batches import BatchCycle
from gradloom.operators.gradients import forward
from gradloom.plans.joins import fits_broadcast
from gradloom.plans.lineage import cut
from gradloom.plans.objectives import fm_pair_ranking
from gradloom.sources.generators import ranked_positives
from gradloom.suite.base import (
    CTES,
    FACTORS,
    PER_ROUND,
    ROUNDS,
    R,
    case,
    rank_features,
    rank_pos,
    rank_sampler,
    rank_v,
    rnd,
    rows_of,
)
from gradloom.operators.scoring import score_fm


def negatives(spark, sf):
    return K.neg_sample(rank_pos(spark, sf), ROUNDS, PER_ROUND, rank_sampler(rows_of(spark, sf, "part")))


def scored(spark, sf, entries=False):
    """Positives and negatives with their scores; both lie where their link does."""
    parts = rows_of(spark, sf, "part")
    pos = K.place_positives(rank_pos(spark, sf), 1 + ROUNDS * PER_ROUND)
    ends = K.as_positives(pos), K.neg_sample(pos, ROUNDS, PER_ROUND, rank_sampler(parts))
    features = [rank_features(parts)(end) for end in ends]
    hot = [] if fits_broadcast(parts + 26) else K.hot_features(features[1])
    links = pos.rdd.getNumPartitions()
    return [K.score_ranked(end, fea, rank_v(spark, sf), FACTORS, parts + 26, entries=entries, hot=hot, parts=links) for end, fea in zip(ends, features)]


def losses(spark, sf):
    # Every positive has as many negatives as any other, so no link is hot.
    return K.pair_losses(*scored(spark, sf), {})


@case("neg_sample", f"SELECT link_id, iter, i, ex_id, item, {R('rel_weight')} AS rel_weight FROM rank_neg")
def neg_sample(spark, sf):
    out = negatives(spark, sf)
    return out.select("link_id", "iter", "i", "ex_id", "item", rnd("rel_weight").alias("rel_weight"))


@case(
    "neg_sampler_uniform_items",
    """SELECT link_id, 15::BIGINT AS n, true AS all_other, true AS all_known, true AS weights_add_up FROM rank_pos""",
)
def neg_sampler_uniform_items(spark, sf):
    """Hashed draws: never the positive's item, always a known item, weights sum to the positive's."""
    parts = rows_of(spark, sf, "part")
    pos = rank_pos(spark, sf).withColumn("own_item", F.col("item"))
    neg = K.neg_sample(pos, ROUNDS, PER_ROUND, K.uniform_items(parts, ROUNDS, PER_ROUND))
    return neg.groupBy("link_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.col("item") != F.col("own_item")).alias("all_other"),
        F.min(F.col("item").between(0, parts - 1)).alias("all_known"),
        (F.abs(F.sum("rel_weight") - 1.0) < 1e-9).alias("weights_add_up"),
    )


@case("score_fm_ranking", f"SELECT link_id, iter, i, {R('score')} AS score FROM rank_score")
def score_fm_ranking(spark, sf):
    pos, neg = scored(spark, sf)
    return pos.unionByName(neg).select(*K.RANK_KEYS, rnd("score").alias("score"))


@case("loss_pair_sigmoid", f"SELECT link_id, iter, i, {R('loss')} AS loss, {R('weight')} AS weight, {R('dpos')} AS dpos FROM rank_loss")
def loss_pair_sigmoid(spark, sf):
    out = losses(spark, sf)
    return out.select(*K.RANK_KEYS, *[rnd(c).alias(c) for c in ("loss", "weight", "dpos")])


@case("pair_slopes", f"SELECT link_id, iter, i, {R('dscore')} AS dscore FROM rank_slope")
def pair_slopes(spark, sf):
    return K.pair_slopes(losses(spark, sf)).select(*K.RANK_KEYS, rnd("dscore").alias("dscore"))


@case("forward_pairs", f"SELECT {R('sum(loss) / sum(weight)')} AS loss, {R('sum(weight)', 4)} AS total_weight FROM rank_loss")
def forward_pairs(spark, sf):
    return forward(losses(spark, sf)).select(rnd("loss").alias("loss"), rnd("total_weight", 4).alias("total_weight"))


@case("backward_fm_pairs", f"SELECT idx, k, {R('g', 9)} AS g FROM rank_grad")
def backward_fm_pairs(spark, sf):
    _, total, grad, _ = K.ranking_gradient(*scored(spark, sf, entries=True), rank_v(spark, sf), FACTORS, {})
    return grad.select("idx", "k", rnd(F.col("g") / total, 9).alias("g"))


def ranking_model(spark, sf, fresh=False):
    parts = rows_of(spark, sf, "part")
    cycle = BatchCycle(rank_pos(spark, sf), keys=["link_id"])
    sampler = rank_sampler(parts, fresh)
    return fm_pair_ranking(cycle, parts + 26, FACTORS, lambda pos: K.neg_sample(pos, ROUNDS, PER_ROUND, sampler), rank_features(parts), fresh)


@case(
    "fm_pair_ranking",
    f"""SELECT v.idx, v.k, {R('coalesce(g.g, 0)', 9)} AS g, {R('(SELECT sum(loss) / sum(weight) FROM rank_loss)')} AS value
    FROM rank_v v LEFT JOIN rank_grad g ON g.idx = v.idx AND g.k = v.k""",
)
def fm_pair_ranking_case(spark, sf):
    """Value and gradient of the ranking objective, all sampling rounds in one query."""
    value, grad = ranking_model(spark, sf).value_grad(rank_v(spark, sf))
    return grad.select("idx", "k", rnd("g", 9).alias("g"), rnd(F.lit(value)).alias("value"))


def _value_grad_sql(epoch: int, chain: str) -> str:
    return f"""SELECT {epoch}::INTEGER AS epoch, v.idx, v.k, {R('coalesce(g.g, 0)', 9)} AS g,
    {R(f'(SELECT sum(loss) / sum(weight) FROM {chain}_loss)')} AS value
    FROM rank_v v LEFT JOIN {chain}_grad g ON g.idx = v.idx AND g.k = v.k"""


@case("fm_pair_ranking_epochs", f"{_value_grad_sql(0, 'rank')} UNION ALL {_value_grad_sql(1, 'rank1')}")
def fm_pair_ranking_epochs(spark, sf):
    """Two epochs, each with negatives of its own; within a held batch they stand still."""
    model, v = ranking_model(spark, sf, fresh=True), rank_v(spark, sf)
    out = []
    for epoch in range(2):
        value, grad = model.evaluate(v)
        with model.cycle.held():
            value_again = model.value(v)
        if model.cycle.epoch != epoch or abs(value_again - value) > 1e-12 * abs(value):
            raise ValueError("negatives changed while their batch was held")
        full = v.select("idx", "k").join(grad, ["idx", "k"], "left")
        out.append(full.select(F.lit(epoch).alias("epoch"), "idx", "k", rnd(F.coalesce("g", F.lit(0.0)), 9).alias("g"), rnd(F.lit(value)).alias("value")))
        out[-1] = cut(out[-1])
    return out[0].unionByName(out[1])


@case(
    "fm_pair_ranking_rounds",
    f"""SELECT v.idx, v.k, {R('coalesce(g.g, 0)', 9)} AS g, {R('(SELECT sum(loss) / sum(weight) FROM rank_loss)')} AS value
    FROM rank_v v LEFT JOIN rank_grad g ON g.idx = v.idx AND g.k = v.k""",
)
def fm_pair_ranking_rounds(spark, sf):
    """Value and gradient added up over the sampling rounds, one of which is kept at a time."""
    v = rank_v(spark, sf)
    value, grad = ranking_model(spark, sf).evaluate_rounds(v, ROUNDS)
    full = v.select("idx", "k").join(grad, ["idx", "k"], "left")
    return full.select("idx", "k", rnd(F.coalesce("g", F.lit(0.0)), 9).alias("g"), rnd(F.lit(value)).alias("value"))


@case(
    "neg_batches_accumulate",
    f"""SELECT iter, {R('sum(loss)', 4)} AS loss, {R('sum(weight)', 4)} AS weight,
    {R('(SELECT sum(loss) / sum(weight) FROM rank_loss)')} AS total FROM rank_loss GROUP BY iter""",
)
def neg_batches_accumulate(spark, sf):
    """Loss and weight per sampling round, and their weighted total, from one query."""
    per_round = losses(spark, sf).groupBy("iter").agg(F.sum("loss").alias("loss"), F.sum("weight").alias("weight"))
    whole = Window.partitionBy()  # over one row a round
    total = F.sum("loss").over(whole) / F.sum("weight").over(whole)
    return per_round.withColumn("total", total).select("iter", rnd("loss", 4).alias("loss"), rnd("weight", 4).alias("weight"), rnd("total").alias("total"))


@case(
    "link_violations",
    """SELECT link_id, CASE WHEN pos > 1 THEN 'repeated positive' ELSE 'no positive' END AS reason FROM (
    SELECT link_id, sum(is_pos)::BIGINT AS pos, sum(is_neg)::BIGINT AS neg FROM (
      SELECT o_custkey AS link_id, 1 AS is_pos, 0 AS is_neg FROM orders WHERE o_orderstatus = 'F'
      UNION ALL SELECT o_custkey, 0, 1 FROM orders WHERE o_orderstatus = 'O') GROUP BY 1)
    WHERE pos > 1 OR (pos = 0 AND neg > 0)""",
)
def link_violations(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    links = {s: orders.filter(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("link_id")) for s in "FO"}
    return K.link_violations(links["F"], links["O"])


@case(
    "link_violations_all",
    """SELECT link_id, CASE WHEN pos > 1 THEN 'repeated positive' ELSE 'no positive' END AS reason FROM (
    SELECT o_custkey AS link_id, count(*) FILTER (WHERE o_orderstatus = 'F') AS pos, count(*) FILTER (WHERE o_orderstatus <> 'F') AS neg
    FROM orders GROUP BY 1) WHERE pos > 1 OR (pos = 0 AND neg > 0)""",
)
def link_violations_all(spark, sf):
    """All orders: those that are not finished are the negatives."""
    orders = spark.read.parquet(f"{sf}/orders.parquet").withColumnRenamed("o_custkey", "link_id")
    return K.link_violations(orders.filter("o_orderstatus = 'F'"), orders.filter("o_orderstatus <> 'F'"))


CTES["cand"] = """SELECT DISTINCT o_custkey % 20 AS cust, substr(o_orderpriority, 1, 1)::BIGINT AS prio, l_partkey AS item
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderkey % 3 = 0 AND l_quantity > 25"""
CTES["cand_fea"] = """SELECT cust, prio, item, item AS fea, 1.0::DOUBLE AS x FROM cand
  UNION ALL SELECT cust, prio, item, parts + cust, 0.5::DOUBLE FROM cand, dims
  UNION ALL SELECT cust, prio, item, parts + 20 + prio, 1.0::DOUBLE FROM cand, dims"""
CTES["cand_score"] = """SELECT cust, prio, item, 0.5::DOUBLE * sum(s * s - q) AS score FROM (
  SELECT cust, prio, item, k, sum(x * v) AS s, sum(x * x * v * v) AS q FROM cand_fea JOIN rank_v ON fea = idx
  GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3"""


CTES["every_cand"] = """SELECT DISTINCT o_custkey % 20 AS cust, substr(o_orderpriority, 1, 1)::BIGINT AS prio, l_partkey AS item
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey"""
CTES["every_fea"] = """SELECT cust, prio, item, item AS fea, 1.0::DOUBLE AS x FROM every_cand
  UNION ALL SELECT cust, prio, item, parts + cust, 0.5::DOUBLE FROM every_cand, dims
  UNION ALL SELECT cust, prio, item, parts + 20 + prio, 1.0::DOUBLE FROM every_cand, dims"""
CTES["every_score"] = """SELECT cust, prio, item, 0.5::DOUBLE * sum(s * s - q) AS score FROM (
  SELECT cust, prio, item, k, sum(x * v) AS s, sum(x * x * v * v) AS q FROM every_fea JOIN rank_v ON fea = idx
  GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3"""


def _five_best(scores):
    return f"""SELECT cust, prio, item, {R('score')} AS score, rank::INTEGER AS rank FROM (
    SELECT *, row_number() OVER (PARTITION BY cust, prio ORDER BY round(score, 9) DESC, item) AS rank FROM {scores}) WHERE rank <= 5"""


@case("gen_ranked_positives", _five_best("cand_score"))
def gen_ranked_positives(spark, sf):
    """The five best-scored items of every (customer group, priority) context, from a part of the orders."""
    return five_best(spark, sf, F.col("o_orderkey") % 3 == 0, F.col("l_quantity") > 25)


@case("gen_ranked_positives_all", _five_best("every_score"))
def gen_ranked_positives_all(spark, sf):
    """The five best-scored items of every (customer group, priority) context."""
    return five_best(spark, sf, F.lit(True), F.lit(True))


def five_best(spark, sf, of_orders, of_lines):
    parts = rows_of(spark, sf, "part")
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    lines = spark.read.parquet(f"{sf}/lineitem.parquet")
    cand = orders.filter(of_orders).join(lines.filter(of_lines), F.col("l_orderkey") == F.col("o_orderkey"))
    cand = cand.select((F.col("o_custkey") % 20).alias("cust"), F.substring("o_orderpriority", 1, 1).cast("bigint").alias("prio"), F.col("l_partkey").alias("item")).distinct()
    keyed = cand.withColumns({"link_id": F.col("cust") * 10 + F.col("prio"), "iter": F.lit(-1), "i": F.col("item")})
    score = score_fm(rank_features(parts)(keyed), rank_v(spark, sf), FACTORS, K.RANK_KEYS, parts + 26)
    ranked = keyed.join(score, K.RANK_KEYS).withColumn("exact", F.col("score")).withColumn("score", F.round("score", 9))
    top = ranked_positives(ranked, 5, ["cust", "prio"])
    return top.select("cust", "prio", "item", rnd("exact").alias("score"), "rank")
