"""Ranking by whole links, with more parameters than a join broadcasts: as by joins, and without moving an example."""

import pytest
from pyspark.sql import functions as F

from gradloom.operators import links as L
from gradloom.operators import ranking as K
from gradloom.operators.batches import BatchCycle
from gradloom.plans import objectives as O

LINKS, ITEMS, DIM = 60, 20, 24


def positives(spark):
    link = F.col("id")
    return spark.range(LINKS).select(link.alias("link_id"), link.alias("ex_id"), (link * 7 % ITEMS).alias("item"),
                                     (1.0 + link % 3).alias("weight"), F.lit(1.0).alias("rel_weight"))


def featurize(e):
    """Some examples have no feature, some a feature twice, some a feature without a value."""
    user = F.lit(ITEMS).cast("bigint") + F.col("link_id") % 4
    some = e.where("(link_id + i) % 11 != 3").select(*K.RANK_KEYS, F.explode(F.array("item", user, "item")).alias("fea_id"))
    return some.withColumn("value", F.when(F.col("fea_id") != 5, F.lit(0.5) + F.col("i") / 8))


def draw(p):
    """A link without negatives, a sparse round, and a negative without a weight of its own."""
    drawn = K.neg_sample(p, 2, 3, K.uniform_items(ITEMS, 2, 3)).where("link_id != 17")
    return drawn.withColumns({"iter": F.col("iter") * 500_000, "rel_weight": F.when(F.col("link_id") != 9, F.col("rel_weight"))})


def start(spark):
    cells = spark.range(DIM).select(F.col("id").alias("idx"), F.explode(F.array(F.lit(0), F.lit(1))).alias("k"))
    return cells.select("idx", "k", (((F.col("idx") * 5 + F.col("k") * 3) % 7 - 3) / 4.0).alias("v"))


def model_of(spark, drawn=draw):
    return O.fm_pair_ranking(BatchCycle(positives(spark), keys=["link_id"]), DIM, 2, drawn, featurize)


def found(spark):
    model, x = model_of(spark), start(spark)
    xd = x.select("idx", "k", F.col("v").alias("x"), (F.col("v") * F.col("v") - 0.3).alias("d"))
    value, grad = model.evaluate(x)
    by_round, grad_by_round = model.evaluate_rounds(x, 1)
    out = [value, model.value(x), by_round]
    cells = [{(r["idx"], r["k"]): r["g"] or 0.0 for r in g.collect()} for g in (grad, grad_by_round)]
    model.cycle.hold()
    line = model.line(xd)
    out += [z for p in line.probe([0.0, 0.5, 2.0]) for z in p]
    line.close()
    model.tidy()
    return out, cells


def test_whole_links_give_what_joins_give(spark, monkeypatch):
    numbers, cells = found(spark)
    monkeypatch.setattr("gradloom.plans.joins.BROADCAST_ROWS", 0)
    monkeypatch.setattr(L, "FETCHED", 7)
    monkeypatch.setattr(L, "RUN", 50)
    for entries in (1 << 25, 0):  # whole links, and features that move to their weights
        monkeypatch.setattr(L, "ENTRIES", entries)
        others, other_cells = found(spark)
        assert others == pytest.approx(numbers, rel=1e-10)
        assert other_cells[0] == pytest.approx(cells[0], abs=1e-12) and other_cells[1] == pytest.approx(cells[1], abs=1e-12)


def test_whole_links_move_nothing_and_keep_no_pair(spark, monkeypatch):
    monkeypatch.setattr("gradloom.plans.joins.BROADCAST_ROWS", 0)
    model, x = model_of(spark), start(spark)
    links = model._links_of(model.cycle.next())
    assert links.whole
    above, *parts = links.packed()._jdf.queryExecution().executedPlan().toString().split("Union", 1)
    assert parts and "collect_list" in above and "Exchange" not in above
    xd = x.select("idx", "k", F.col("v").alias("x"), F.lit(1.0).alias("d"))
    line = model.held_line(model.cycle.current, xd)
    assert not hasattr(line, "table")
    line.close()


def test_a_negative_without_a_positive_fails(spark, monkeypatch):
    monkeypatch.setattr("gradloom.plans.joins.BROADCAST_ROWS", 0)
    model = model_of(spark, lambda p: draw(p).withColumn("link_id", F.when(F.col("link_id") == 20, F.lit(77)).otherwise(F.col("link_id"))))
    with pytest.raises(Exception, match="a negative without a positive"):
        model.value(start(spark))
