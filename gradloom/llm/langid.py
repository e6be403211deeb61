"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts come from every labelled training text.  The log-probability matrix has
``buckets`` rows and one column per language, so its size does not depend on the
corpus; it is broadcast, and numpy sums its entries over the n-grams of each text.

Null or letterless text gives ``und`` with score 0, as does every text when no
language was learned.  Repeated rows give repeated results; ties go to the language
that sorts first; an empty table gives no rows.  ``found`` is a column beside any others;
``identify`` keeps those it is told to, which may not have the names of its results.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructType

from gradloom.llm import tokens as T

UNKNOWN = "und"
#: More labels than this are no languages; the matrix would outgrow a broadcast.
MOST_LANGUAGES = 1000
_FOUND = StructType().add("lang_pred", StringType()).add("score", DoubleType())


class Settings(NamedTuple):
    orders: tuple[int, ...] = (1, 2, 3)
    buckets: int = 1 << 15
    smoothing: float = 0.5


class Model(NamedTuple):
    languages: list[str]
    prior: np.ndarray  # log share of training texts
    weights: np.ndarray  # a row of log probabilities per language; the last entry is 0, for what is no n-gram
    settings: Settings


def _grams(data: np.ndarray, starts: np.ndarray, settings: Settings):
    """Bucket of every n-gram by order, ``buckets`` where none starts, and where each text starts."""
    points, at = T.characters(data, starts)
    low = T.letters()[points]
    letter = low > 0
    left = np.repeat(at[1:], np.diff(at)) - np.arange(len(points))  # characters to the end of the text
    found = []
    for order in settings.orders:
        n = max(len(points) - order + 1, 0)
        code = np.full(n, order, np.uint32)
        real = left[:n] >= order
        some = np.zeros(n, bool)
        for k in range(order):
            code = (code ^ low[k : k + n]) * np.uint32(0x85EBCA6B)
            code ^= code >> np.uint32(13)
            some |= letter[k : k + n]
        bucket = np.full(len(points), settings.buckets, np.int64)
        bucket[:n] = np.where(real & some, (code * np.uint32(0xC2B2AE35)) >> np.uint32(32 - (settings.buckets - 1).bit_length()), settings.buckets)
        found.append(bucket)
    return found, at, letter


def fit(docs: DataFrame, settings: Settings = Settings(), text: str = "text", lang: str = "lang") -> Model:
    """Learn from all rows with text and language."""
    spark = docs.sparkSession
    rows = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where(F.col("lang").isNotNull() & F.col("text").isNotNull())

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            names = np.array(batch.column(1).to_pylist(), object)
            for row, data, starts in T.slices(batch.column(0)):
                grams, at, _ = _grams(data, starts, settings)
                here = names[row : row + len(starts) - 1]
                for name in set(here):
                    if name not in sums:
                        if len(sums) >= MOST_LANGUAGES:
                            raise ValueError(f"more than {MOST_LANGUAGES} languages")
                        sums[name] = np.zeros(settings.buckets + 1, np.int64)
                    mine = np.repeat(here == name, np.diff(at))
                    for g in grams:
                        sums[name] += np.bincount(g[mine], minlength=settings.buckets + 1)
                    sums[name][-1] = 0
        for name, total in sums.items():
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(used), pa.string()), pa.array(used.astype(np.int32)), pa.array(total[used])], names=["lang", "bucket", "n"]
            )

    counts = rows.mapInArrow(count, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    # At most MOST_LANGUAGES rows, then at most languages x buckets.
    shares = sorted((r["lang"], r["n"]) for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(MOST_LANGUAGES + 1).collect())
    if len(shares) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    languages = [name for name, _ in shares]
    table = np.full((len(languages), settings.buckets + 1), settings.smoothing)
    if languages:
        got = counts.toPandas()
        order = {name: i for i, name in enumerate(languages)}
        np.add.at(table, (got["lang"].map(order).to_numpy(int), got["bucket"].to_numpy(int)), got["n"].to_numpy(float))
    table = np.log(table) - np.log(table[:, :-1].sum(1, keepdims=True)) if languages else table
    table[:, -1] = 0
    n = np.array([n for _, n in shares], float)
    return Model(languages, np.log(n / n.sum()) if languages else n, table.astype(np.float32), settings)


def found(model: Model, text: Column | str, spark: SparkSession) -> Column:
    """struct<lang_pred, score> of a text; only the text itself goes through Python, other columns stay where they are."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf(_FOUND)
    def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        languages, prior, weights, settings = shared.value
        names = np.array([*languages, UNKNOWN], object)
        for column in texts:
            best = np.full(len(column), len(languages))
            certain = np.zeros(len(column))
            for row, data, starts in T.slices(column):
                grams, at, letter = _grams(data, starts, settings)
                some = np.flatnonzero(np.diff(at))
                if not len(some) or not languages:
                    continue
                logs = np.tile(prior, (len(some), 1))
                for k in range(len(languages)):
                    for g in grams:
                        logs[:, k] += np.add.reduceat(weights[k][g], at[some], dtype=np.float64)
                has = np.add.reduceat(letter, at[some], dtype=np.int64) > 0
                top = logs.argmax(1)
                share = 1.0 / np.exp(logs - logs[np.arange(len(some)), top][:, None]).sum(1)
                best[row + some[has]] = top[has]
                certain[row + some[has]] = share[has]
            yield pa.StructArray.from_arrays([pa.array(names[best], pa.string()), pa.array(certain)], names=["lang_pred", "score"])

    return score(text)


def identify(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, lang_pred and score (posterior of that language) for every row."""
    if {"lang_pred", "score"} & set(keep):
        raise ValueError("columns named lang_pred or score cannot be kept; use found()")
    rows = docs.select(*keep, found(model, F.col(text), docs.sparkSession).alias("__found"))
    return rows.select(*keep, "__found.lang_pred", "__found.score")
