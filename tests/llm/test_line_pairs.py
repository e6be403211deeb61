"""Which lines meet before their words are compared."""

import random

from pyspark.sql import functions as F
from test_pipeline import plain_lines

from gradloom.llm import linededup
from gradloom.llm.storage import new_folder


def test_long_lines_that_share_few_words_are_not_compared(spark):
    """Sketches of long lines are full; the number of rare words that a pair shares tells them apart."""
    words = lambda i, n: [f"own{i}x{k}" for k in range(n)]
    lines = [" ".join([*words(i, 199), f"common{i // 2}"]) for i in range(40)]  # each pair shares one word
    near = " ".join([*words(0, 190), *words("changed", 9), "common0"])
    docs = spark.createDataFrame([(i, line) for i, line in enumerate([*lines, near])], "doc_id long, text string")
    folder = new_folder(spark, "lines")
    done = {r["doc_id"]: r["text"] for r in linededup.dedup(docs, folder).collect()}
    assert done == {**dict(enumerate(lines)), 40: ""}
    compared = sum(spark.read.parquet(f"{folder}/{name}").count() for name in ("first-matches-pairs", "other-matches-pairs"))
    assert compared == 1


def test_lines_of_all_sizes_and_spaces(spark):
    """Near copies of lines of 1 to 60 words, parted by any spaces, against plain code."""
    draw = random.Random(3)
    texts = {}
    for i in range(300):
        line = [f"w{int(draw.paretovariate(0.4)) % 5000}" for _ in range(draw.randint(1, 60))]
        copies = [line]
        for _ in range(3):
            copies.append([w if draw.random() > 0.06 else f"new{draw.randint(0, 99)}" for w in line if draw.random() > 0.05])
        texts[i] = "\n".join("".join(w + draw.choice([" ", "  ", "\t", " \r", "\x0b\x0c"]) for w in c) for c in copies)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = linededup.dedup(docs, new_folder(spark, "lines"), counts=True).where("__lines = 0 OR __gone < __lines")
    assert {r["doc_id"]: r["text"] for r in rows.collect()} == plain_lines(texts)


def test_the_rarity_table_is_as_short_as_its_words_allow(spark):
    """What passes through the driver is in proportion to the words that lines share; none of these gets the rank of a word of one line."""
    texts = [f"own{i} " + " ".join(f"shared{i // 2}x{k}" for k in range(20)) for i in range(200)]
    lines = linededup._lines(linededup._identified(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "doc_id", "text"))
    table, buckets, frequent = linededup._rarity(lines)
    rank = table.first()["rank"]
    assert len(rank) == buckets <= 8 * 2000 and not frequent
    hashes = lines.select(F.explode(linededup._words(F.col("__line"))).alias("w")).select("w", F.xxhash64("w").alias("h")).distinct().collect()
    assert all(rank[r["h"] & (buckets - 1)] for r in hashes if r["w"].startswith("shared"))
    assert sum(rank[r["h"] & (buckets - 1)] == 0 for r in hashes if r["w"].startswith("own")) > 100
    assert len(linededup._rarity(lines.limit(0))[0].first()["rank"]) == 1


def test_frequent_words_and_words_repeated_in_a_line(spark, monkeypatch):
    """The parts of frequent words, which small tables do not have, find the same lines."""
    draw = random.Random(5)
    texts = {i: "\n".join(" ".join(f"w{draw.randint(0, 11)}" for _ in range(draw.randint(1, 9))) for _ in range(4)) for i in range(150)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for rank in (linededup.HOT_RANK, 12):
        monkeypatch.setattr(linededup, "HOT_RANK", rank)
        rows = linededup.dedup(docs, new_folder(spark, "lines"), counts=True).where("__lines = 0 OR __gone < __lines")
        assert {r["doc_id"]: r["text"] for r in rows.collect()} == plain_lines(texts)
