"""A training corpus from raw documents: five stages, each over all that its predecessor kept."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradloom.llm import curriculum, decontaminate, jaccard, langid, linededup
from gradloom.llm.storage import checked, new_folder
from gradloom.plans.lineage import cut

#: A document is rejected when no language is found in it or the found one is less certain than this.
LEAST_CERTAIN = 0.5
WEIGHTS = (5, 2, 1)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the model knows; it learns from all of them that have a label.

    Null, empty and letterless texts go; if no row has a label, all go.  Other columns are kept, whatever
    their names; repeated rows stay or go alike; an empty table stays empty.
    """
    found = langid.found(langid.fit(docs), F.col("text"), spark)
    return docs.where((found["lang_pred"] != langid.UNKNOWN) & (found["score"] >= LEAST_CERTAIN))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that repeat an earlier one; those left with no line at all go."""
    done = linededup.dedup(docs, new_folder(spark, "lines"), counts=True)
    done = done.where((F.col("__gone") == 0) | (F.col("__gone") < F.col("__lines")))
    length = F.when(F.col("__gone") > 0, F.length("text")).otherwise(F.col("n_chars"))
    return done.withColumn("n_chars", length.cast("long")).select(*docs.columns)


def told_apart(docs: DataFrame) -> DataFrame:
    """The documents with ``__same``, a number below 2**62 that rows share if and only if they share their text (null is empty).

    It is a hash of the text; by another one a seed is found for which no two texts meet.  So no text is moved for it.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    for seed in itertools.count():
        key = F.xxhash64(text, F.lit(seed)).bitwiseAND(F.lit(jaccard.UNNAMED - 1))
        other = docs.select(key.alias("k"), F.xxhash64(F.lit(seed), text).alias("o")).groupBy("k")
        if other.agg(F.min("o").alias("low"), F.max("o").alias("high")).where("low <> high").isEmpty():
            return docs.withColumn("__same", key)


def join_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one whose id is the smallest.  Documents without words stay.

    Rows are told apart by id and text: of repeated rows one stays, other texts of an id and
    rows with a null id, which come last, are documents of their own.
    """
    rows = told_apart(docs)
    groups = jaccard.join(rows.select("__same", "text"), new_folder(spark, "jaccard"), key="__same")
    groups = groups.where("n_shingles > 0").groupBy("__same").agg(F.min("component_id").alias("__group"))
    # A row for each text, so that neither a text nor a group with very many rows meets in a task.
    ids = rows.groupBy("__same", "doc_id").agg(F.count("*").alias("n"))
    own = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "n")
    texts = cut(ids.groupBy("__same").agg(F.min(own).alias("own"), F.sum("n").alias("rows")).join(groups, "__same"))
    first = texts.groupBy("__group").agg(F.min(F.struct("own.none", "own.doc_id", "__same")).alias("first"), F.count("*").alias("n")).where("n > 1")
    fate = texts.join(checked(cut(first)), "__group", "left").select(
        "__same", F.coalesce(F.col("first.__same") != F.col("__same"), F.lit(False)).alias("__gone"), F.col("own.doc_id").alias("__first"), (F.col("own.n") > 1).alias("__twice"), "rows"
    )
    fate = cut(fate.where("__gone OR rows > 1").drop("rows"))
    rows = rows.join(checked(fate), "__same", "left")
    rows = rows.where("__gone IS NULL OR (NOT __gone AND doc_id <=> __first)")
    if not fate.where("__twice AND NOT __gone").isEmpty():
        twice = F.coalesce("__twice", F.lit(False))
        rows = rows.where(~twice).union(rows.where(twice).dropDuplicates(["__same"]))
    return rows.select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item; each row goes or stays by its own text, also where its id is null or repeated."""
    return decontaminate.clean(told_apart(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), key="__same").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes of each document, and where in training they first come."""
    done = curriculum.mix(docs, WEIGHTS)
    return done.select("doc_id", "source", "size", "source_size", "target", "taken", F.round("position", 6).alias("position"))


STAGES = [
    ("language ID", identify_language),
    ("line dedup", dedup_lines),
    ("n-gram Jaccard join", join_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("mixing sources", mix_sources),
]

#: The language model has no SQL; tests/llm/test_pipeline.py checks the pipeline against plain code.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's result is written and read again by the next."""
    folder = new_folder(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        done = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return done
        done.write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
    return docs
