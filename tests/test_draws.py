"""Generated examples are made where their ids lie."""

from pyspark.sql import functions as F

from gradloom.sources import generators as N


def test_draws_do_not_move(spark):
    """Only ids are exchanged; an id that is given twice draws the same and is kept once."""
    ids = spark.range(200).select((F.col("id") % 150).alias("ex_id"))
    out = N.sparse_examples(ids, 30, 1000, seed=3)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "ENSURE_REQUIREMENTS" not in plan
    drawn = ids.distinct().withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(29))))
    drawn = drawn.select("ex_id", F.floor(N.uniform(3, "ex_id", "draw") * 1000).alias("fea_id")).distinct()
    assert out.count() == drawn.count() == out.join(drawn, ["ex_id", "fea_id"]).count()
