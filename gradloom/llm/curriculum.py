"""Mixing sources along a time-varying curriculum.

Each source has a weight schedule over training time (0 to 1), piecewise linear
between knots.  Its integral up to time t, times the total, is the source's cumulative
word demand; inverting that demand gives the time at which each document is due, and
documents are range-sorted by it.  Demand beyond one pass repeats a source's documents
in the same order.

Documents stand in their source in the order of a hash, ties by id and text.  Where each
one starts is a two-level prefix sum: rows are range-partitioned on (source, order), so a
large source covers many partitions, each partition is summed once, and only the sums
(one row per source and partition) meet.  Null text has size 0, null source is a source
of its own and sorts last; equal rows are separate documents.  Size-0 documents are
never taken and have no position.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradloom.plans.lineage import cut

#: The plan of the mix, one row per source, goes through the driver; for more sources it is a table.
MOST_SOURCES = 100_000
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: Sequence[tuple[str | None, int]], weights: Sequence[float], most: float = 3.0) -> list[float]:
    """Words of each source (in order): the sum of all sizes shared by weight, none above ``most`` times its size.

    What a full source can't take is shared by weight among the others, again and again.
    ``weights`` repeats along the sources.
    """
    total = float(sum(n for _, n in sizes))
    w = [float(weights[i % len(weights)]) for i in range(len(sizes))]
    full: set[int] = set()
    while True:
        left = total - sum(most * sizes[i][1] for i in full)
        open_ = [i for i in range(len(sizes)) if i not in full]
        share = sum(w[i] for i in open_)
        got = {i: left * w[i] / share for i in open_} if share else {}
        over = {i for i in open_ if got[i] > most * sizes[i][1]}
        if not over:
            return [most * sizes[i][1] if i in full else got.get(i, 0.0) for i in range(len(sizes))]
        full |= over


def tilted(shares: Sequence[float], tilt: float) -> list[tuple[float, float]]:
    """(start, end) weight of each source on a straight schedule with these mean shares; larger shares come later.

    At every time the weights sum to 1, so a position in the mix is a time of training.
    """
    mean = sum(s * s for s in shares)
    lean = [s - mean for s in shares]
    scale = max((abs(x) for x in lean), default=0.0) or 1.0
    return [(s * (1 - tilt * x / scale), s * (1 + tilt * x / scale)) for s, x in zip(shares, lean, strict=True)]


def _with_sums_before(table: DataFrame, order: Sequence[Column], sums: dict[str, Column]) -> DataFrame:
    """The table with sums over all rows that stand before each one in a total order, in two levels."""
    parts = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Written once: its partition numbers must be the same for both readers below.
    rows = cut(table.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__block", F.spark_partition_id()))
    blocks = rows.groupBy("__block").agg(*[F.sum(x).alias(name) for name, x in sums.items()])
    earlier = Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    blocks = blocks.select("__block", *[F.coalesce(F.sum(name).over(earlier), F.lit(0)).alias(f"__{name}") for name in sums])
    inside = Window.partitionBy("__block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({name: F.coalesce(F.sum(x).over(inside), F.lit(0)) for name, x in sums.items()}).join(F.broadcast(blocks), "__block")
    return rows.withColumns({name: F.col(name) + F.col(f"__{name}") for name in sums}).drop("__block", *[f"__{name}" for name in sums])


def plan_table(totals: DataFrame, weights: Sequence[float], most: float, tilt: float) -> DataFrame:
    """``targets`` and ``tilted`` for any number of sources: __source, source_size, target, w0, w1 of the rows __source, n.

    A source is full when its ratio of ``most`` times its size to its weight is below that of the first
    source, in the order of ratios, that can take its share of what the sources before it leave.
    """
    by_name = F.col("__source").asc_nulls_last()
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    rows = _with_sums_before(totals, [by_name], {"rank": F.lit(1)}).withColumn("w", w).withColumn("room", most * F.col("n"))
    rows = rows.withColumn("ratio", F.coalesce(F.try_divide("room", "w"), F.lit(float("inf"))))
    rows = cut(_with_sums_before(rows, [F.col("ratio"), by_name], {"below": F.col("room"), "used": F.col("w")}))
    total, shared = rows.agg(F.sum("n"), F.sum("w")).first()
    left, share = F.lit(float(total)) - F.col("below"), F.lit(shared) - F.col("used")
    level = F.coalesce(F.try_divide(left, share), F.lit(0.0))
    first = rows.where(F.col("room") >= level * F.col("w")).orderBy("ratio", by_name).select("ratio", F.when(F.col("w") > 0, level).otherwise(0.0)).first()
    bound, level = first or (float("inf"), 0.0)
    rows = rows.withColumn("target", F.when(F.col("ratio") < bound, F.col("room")).otherwise(level * F.col("w")))
    rows = rows.withColumn("share", F.col("target") / (rows.agg(F.sum("target")).first()[0] or 1.0))
    mean, low, high = rows.agg(F.sum(F.col("share") * F.col("share")), F.min("share"), F.max("share")).first()
    lean = tilt * (F.col("share") - mean) / (max(abs(low - mean), abs(high - mean)) or 1.0)
    return rows.select("__source", F.col("n").alias("source_size"), "target", (F.col("share") * (1 - lean)).alias("w0"), (F.col("share") * (1 + lean)).alias("w1"))


def due(part: Column, start: Column, end: Column) -> Column:
    """Time by which ``part`` of a source's demand is met, under a straight schedule from ``start`` to ``end``."""
    # integral a*t + (b-a)*t^2/2 = part*(a+b)/2; the stable root, for a = b too
    half = part * (start + end) / 2
    return F.try_divide(2 * half, start + F.sqrt(F.greatest(start * start + 2 * (end - start) * half, F.lit(0.0))))


def place(
    docs: DataFrame,
    weights: Sequence[float],
    most: float = 3.0,
    tilt: float = 0.5,
    key: str = "doc_id",
    source: str = "source",
    text: str = "text",
) -> DataFrame:
    """One row per document: key, __source, size, source_size, target, begin (words before it), start and end weights.

    Sources, not documents, are collected to the driver: one row each, ``MOST_SOURCES`` at most; more stay a table.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col(key),
        F.col(source).alias("__source"),
        word_count(F.col(text)).alias("size"),
        F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")).alias("__order"),
    )
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["__source", "__order", key, "size"]
    # Written once: its partition numbers must be the same for both readers below.
    placed = cut(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()))
    sums = placed.groupBy("__source", "__part").agg(F.sum("size").alias("__sum"))
    totals = sums.groupBy("__source").agg(F.sum("__sum").alias("n"))
    by_source = totals.limit(MOST_SOURCES + 1).collect()
    if len(by_source) > MOST_SOURCES:
        plan = plan_table(totals, weights, most, tilt)
    else:
        by_source = sorted(by_source, key=lambda r: (r[0] is None, (r[0] or "").encode("utf-32-be", "surrogatepass")))
        want = targets([(r[0], r["n"]) for r in by_source], weights, most)
        total = sum(want) or 1.0
        plan = [(r[0], r["n"], t, a, b) for r, t, (a, b) in zip(by_source, want, tilted([t / total for t in want], tilt), strict=True)]
        plan = F.broadcast(spark.createDataFrame(plan, "__source string, source_size bigint, target double, w0 double, w1 double"))
    earlier = Window.partitionBy("__source").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("__source", "__part", F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__before"))
    starts = sums.alias("s").join(plan.alias("p"), F.col("p.__source").eqNullSafe(F.col("s.__source"))).drop(F.col("p.__source"))
    # Its groups lie within one partition each, so none is larger than that.
    inside = Window.partitionBy("__source", "__part").orderBy(*order[1:]).rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("__inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    same = F.col("r.__source").eqNullSafe(F.col("s.__source")) & (F.col("r.__part") == F.col("s.__part"))
    return (
        placed.alias("r")
        .join(starts.alias("s"), same)
        .select(f"r.{key}", "r.__source", "r.size", "s.source_size", "s.target", (F.col("r.__inside") + F.col("s.__before")).alias("begin"), "s.w0", "s.w1")
    )


def occurrences(placed: DataFrame, most: float = 3.0) -> DataFrame:
    """The curriculum: one row per use of a document, with pass, words used and position, sorted by position.

    The source's words fill its demand in order, again from the first one on each pass;
    the last document of the last pass may be cut short.
    """
    used = F.least(F.round("target"), F.floor(F.col("source_size") * most)).cast("long")
    start = F.col("begin") + F.col("pass") * F.col("source_size")
    passes = F.when(F.col("size") > 0, F.sequence(F.lit(0), F.greatest(F.ceil(F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0))) - 1, F.lit(0)).cast("int")))
    uses = (
        placed.withColumn("pass", F.explode(passes))
        .withColumn("words", F.least(start + F.col("size"), used) - start)
        .where("words > 0")
        .withColumn("position", due(F.try_divide(start, F.col("target")), F.col("w0"), F.col("w1")))
    )
    parts = int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = ["position", "__source", "begin", "pass"]
    return uses.repartitionByRange(parts, *by).sortWithinPartitions(*by)


def mix(docs: DataFrame, weights: Sequence[float], most: float = 3.0, tilt: float = 0.5, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """Per document: key, source, size, source_size, target, taken (words used in all passes) and first position.

    taken is 0 and position null where the mix does not use the document.  Sorted by position.
    """
    used = F.least(F.round("target"), F.floor(F.col("source_size") * most)).cast("long")
    passes = F.sequence(F.lit(0), F.greatest(F.ceil(F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0))) - 1, F.lit(0)).cast("int"))

    def words(k: Column) -> Column:
        start = F.col("begin") + k * F.col("source_size")
        return F.greatest(F.least(start + F.col("size"), used) - start, F.lit(0))

    taken = F.aggregate(F.transform(passes, words), F.lit(0).cast("long"), lambda a, b: a + b)
    first = F.when((F.col("size") > 0) & (F.col("taken") > 0), due(F.try_divide(F.col("begin"), F.col("target")), F.col("w0"), F.col("w1")))
    done = place(docs, weights, most, tilt, key, source, text).withColumn("taken", taken).withColumn("position", first)
    done = done.select(key, F.col("__source").alias("source"), "size", "source_size", "target", "taken", "position")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return done.repartitionByRange(parts, F.col("position").asc_nulls_last(), key).sortWithinPartitions(F.col("position").asc_nulls_last(), key)
