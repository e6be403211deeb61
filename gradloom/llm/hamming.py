"""Exact top-k search over binary codes by incremental multi-index hashing.

A code is split into ``segments``; within distance r of a query some segment is within
r // segments.  Rounds raise the radius of the segments' lookups, one segment after another
once a radius has many masks.  With radius a in the first j segments and a - 1 in the others
every code nearer than ``a * segments + j`` has been met, so a query is closed when its
last place is surely covered, and only then; a round joins only open queries' probes.

Equal codes are one index entry and equal queries one query: of each code only the
k + 1 smallest ids can be wanted, as ties go to the smaller id.  A bucket holding a large
share of the index is split, and its probes go to every split.

Defined cases: a null code or id is neither indexed nor asked for; a row is no neighbour
of its own id; fewer than k other rows give fewer results; rows repeated with one id count once.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradloom.plans.lineage import cut

BITS = 64
#: From so many masks on, a round raises the radius of one segment only.
MASKS_A_ROUND = 500
SPLITS = 16


def sign_code(vector: Column) -> Column:
    """Bit i is set when element i is above 0; null for a null vector.  A vector of more than 64 elements fails the query."""
    bits = F.transform(vector, lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    long = F.raise_error(F.concat(F.lit(f"vector of more than {BITS} elements: "), F.size(vector).cast("string"))).cast("long")
    return F.when(F.size(vector) > BITS, long).when(vector.isNotNull(), F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b)))


def _spans(segments: int) -> list[tuple[int, int]]:
    """(shift, width) of every segment."""
    edges = [BITS * i // segments for i in range(segments + 1)]
    return [(a, b - a) for a, b in itertools.pairwise(edges)]


def _masks(width: int, radius: int) -> np.ndarray:
    return np.array([sum(1 << i for i in bits) for bits in itertools.combinations(range(width), radius)], np.int64)


def _segment(code: Column, shift: int, width: int) -> Column:
    return F.shiftrightunsigned(code, shift).bitwiseAND(F.lit((1 << width) - 1))


def search(rows: DataFrame, queries: DataFrame, k: int = 10, key: str = "id", code: str = "code", segments: int | None = None) -> DataFrame:
    """``query_id, rank, id, distance`` of the k nearest of ``rows`` for every row of ``queries``."""
    spark = rows.sparkSession
    rows = rows.select(F.col(key).cast("long").alias("id"), F.col(code).alias("code")).where("id IS NOT NULL AND code IS NOT NULL")
    asked = queries.select(F.col(key).cast("long").alias("query_id"), F.col(code).alias("q")).where("query_id IS NOT NULL AND q IS NOT NULL").distinct()
    # row_number keeps k + 1 ids of a code in each task before they meet.
    place = F.row_number().over(Window.partitionBy("code").orderBy("id"))
    few = rows.groupBy("code", "id").agg(F.lit(1).alias("one")).withColumn("place", place).where(F.col("place") <= k + 1)
    few = few.select("code", "id", "place").persist(StorageLevel.MEMORY_AND_DISK)
    codes = few.where("place = 1").select("code", F.col("id").alias("least"))
    total = codes.count()
    m = segments or max(1, math.ceil(BITS / max(math.log2(max(total, 2)), 1)))
    spans = _spans(m)

    entries = F.explode(F.array(*[F.struct(F.lit(s).alias("seg"), _segment(F.col("code"), *span).alias("value")) for s, span in enumerate(spans)]))
    index = codes.withColumn("e", entries).select("e.seg", "e.value", "code", "least")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    large = max(total // (4 * parts), 1000)  # so at most 4 * parts * m buckets are split
    hot = {(r["seg"], r["value"]) for r in index.groupBy("seg", "value").count().where(F.col("count") > large).collect()}
    hot_here = F.concat_ws(":", "seg", "value").isin([f"{s}:{v}" for s, v in hot])
    salt = F.when(hot_here, F.pmod(F.xxhash64("code"), F.lit(SPLITS))).otherwise(F.lit(0)).cast("int") if hot else F.lit(0)
    index = index.withColumn("salt", salt).persist(StorageLevel.MEMORY_AND_DISK)

    best = None
    waiting = cut(asked.select("q").distinct().withColumn("bound", F.lit(BITS)))
    for radius, some, covered in _rounds(spans):
        found = _probes(waiting, spans, radius, some, hot).join(
            index.hint("shuffle_hash"), ["seg", "value", "salt"]
        ).where(F.bit_count(F.col("q").bitwiseXOR(F.col("code"))) <= F.col("bound"))
        found = found.select("q", "code", "least", F.bit_count(F.col("q").bitwiseXOR(F.col("code"))).alias("distance")).distinct()
        if best is not None:
            found = found.unionByName(best).distinct()
        order = Window.partitionBy("q").orderBy("distance", "least")
        best = cut(found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1).drop("place"))
        state = best.groupBy("q").agg(F.count("*").alias("n"), F.max("distance").alias("last"))
        state = waiting.select("q").join(state, "q", "left")
        bound = F.when(F.col("n") > k, F.col("last")).otherwise(F.lit(BITS))
        waiting = cut(state.select("q", bound.alias("bound")).where(F.col("bound") > covered))
        if covered >= BITS or waiting.isEmpty():
            break

    listed = best.select("q", "code", "distance").join(few.select("code", "id"), "code")
    order = Window.partitionBy("q").orderBy("distance", "id")
    listed = listed.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1)
    listed = listed.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("distance", "id"))).alias("near"))  # k + 1 each
    near = F.slice(F.filter("near", lambda x: x["id"] != F.col("query_id")), 1, k)
    out = asked.join(listed, "q").select("query_id", F.posexplode(near).alias("rank", "hit"))
    return out.select("query_id", (F.col("rank") + 1).cast("long").alias("rank"), F.col("hit.id").alias("id"), F.col("hit.distance").cast("long").alias("distance"))


def _rounds(spans: list[tuple[int, int]]):
    """(radius, segments raised to it, distance covered after that)."""
    m = len(spans)
    for radius in range(max(w for _, w in spans) + 1):
        if math.comb(max(w for _, w in spans), radius) <= MASKS_A_ROUND:
            yield radius, range(m), m * (radius + 1) - 1
        else:
            for j in range(m):
                yield radius, range(j, j + 1), m * radius + j


def _probes(waiting: DataFrame, spans, radius: int, some, hot: set) -> DataFrame:
    """A row for each segment value within exactly ``radius`` of a query's segment."""
    chosen = [(s, *spans[s], _masks(spans[s][1], radius)) for s in some if spans[s][1] >= radius]
    split = {s: np.array([v for t, v in hot if t == s], np.int64) for s in some}

    def probe(batches):
        for batch in batches:
            q, bound = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for lo in range(0, len(q), 64):  # 64 queries' masks at a time
                code, most = q[lo : lo + 64].astype(np.int64), bound[lo : lo + 64].astype(np.int32)
                for s, shift, width, masks in chosen:
                    own = (code.view(np.uint64) >> np.uint64(shift)).astype(np.int64) & ((1 << width) - 1)
                    value = (own[:, None] ^ masks[None, :]).ravel()
                    at = np.repeat(np.arange(len(code)), len(masks))
                    salt = np.zeros(len(value), np.int32)
                    again = np.flatnonzero(np.isin(value, split[s])) if len(split[s]) else []
                    if len(again):
                        more = np.repeat(again, SPLITS - 1)
                        salt = np.concatenate([salt, np.tile(np.arange(1, SPLITS, dtype=np.int32), len(again))])
                        value, at = np.concatenate([value, value[more]]), np.concatenate([at, at[more]])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x) for x in (code[at], most[at], np.full(len(at), s, np.int32), value, salt)], names=["q", "bound", "seg", "value", "salt"]
                    )

    return waiting.select("q", F.col("bound").cast("int")).mapInArrow(probe, "q bigint, bound int, seg int, value bigint, salt int")
