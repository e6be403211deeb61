"""The language model against plain dictionaries."""

import math
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from gradloom.llm import ngram
from gradloom.llm.storage import new_folder
from gradloom.llm.tokens import remainder

SF = "/root/testdata/sf0.001"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


class Plain:
    def __init__(self, texts, order):
        self.n = order
        grams = [Counter() for _ in range(order + 1)]
        for t in texts:
            seq = ["<s>"] * (order - 1) + words(t) + ["</s>"]
            for i in range(order - 1, len(seq)):
                for k in range(1, order + 1):
                    grams[k][tuple(seq[i - k + 1 : i + 1])] += 1
        self.raw = Counter({g[0]: v for g, v in grams[1].items()})
        self.counts = {order: grams[order]}
        for k in range(order - 1, 0, -1):
            self.counts[k] = Counter(g[1:] for g in self.counts[k + 1])
        self.d, self.ctx = {}, {}
        for k, c in self.counts.items():
            n = [sum(1 for v in c.values() if v == j) for j in (1, 2, 3, 4)]
            self.d[k] = (0, *ngram.discounts(*n))
            ctx = defaultdict(lambda: [0, 0, 0, 0])
            for g, v in c.items():
                ctx[g[:-1]][0] += v
                ctx[g[:-1]][min(v, 3)] += 1
            self.ctx[k] = ctx

    def p(self, gram):
        k = len(gram)
        if k == 0:
            return 1 / (len(self.raw) + 1)
        ctx = self.ctx[k].get(gram[:-1])
        if not ctx:
            return self.p(gram[1:])
        c = self.counts[k].get(gram, 0)
        free = sum(d * n for d, n in zip(self.d[k][1:], ctx[1:])) / ctx[0]
        return max(c - self.d[k][min(c, 3)], 0) / ctx[0] + free * self.p(gram[1:])

    def score(self, text):
        seq = ["<s>"] * (self.n - 1) + words(text) + ["</s>"]
        return sum(math.log10(self.p(tuple(seq[i - self.n + 1 : i + 1]))) for i in range(self.n - 1, len(seq)))


@pytest.mark.parametrize("order", [2, 3])
def test_scores_equal_plain_model(spark, order):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("held_out", remainder("doc_id", 10) == 0)
    model = ngram.train(docs.where(~F.col("held_out")), new_folder(spark, "ngram"), order)
    got = {r["doc_id"]: r for r in ngram.score(docs, model, keep=("doc_id", "held_out")).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    plain = Plain([r["text"] for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 10], order)
    total = sum(plain.raw.values())
    for r in rows:
        mine, seq = got[r["doc_id"]], [*words(r["text"]), "</s>"]
        assert mine["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 10 == 0)
        assert (mine["n_tokens"], mine["train_tokens"]) == (len(seq), total)
        assert mine["n_known"] == sum(plain.raw[w] > 0 for w in seq)
        base = sum(math.log10((plain.raw[w] + 0.1) / (total + 0.1 * (len(plain.raw) + 1))) for w in seq)
        assert mine["base_score"] == pytest.approx(base, rel=1e-9)
        assert mine["score"] == pytest.approx(plain.score(r["text"]), rel=1e-9)


def test_probabilities_sum_to_one(spark):
    texts = ["a b a b c", "a b d", "b a c c", ""]
    plain = Plain(texts, 2)
    vocabulary = [*plain.raw, "unknown"]
    for context in ("a", "b", "<s>", "never"):
        assert sum(plain.p((context, w)) for w in vocabulary) == pytest.approx(1)


def test_edge_rows(spark):
    """Null and empty texts score their end; hot, long, repeated and clashing rows count as they are."""
    rows = [(1, None, "x"), (2, "", "x"), (3, "a b " * 30_000, "x"), (3, "a b", "x"), (3, "a b", "x"), (None, "é ü", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __text string")
    model = ngram.train(docs, new_folder(spark, "ngram"), 2)
    got = ngram.score(docs, model).collect()
    plain = Plain([r[1] for r in rows], 2)
    assert sorted((r["n_tokens"] for r in got)) == [1, 1, 3, 3, 3, 60_001]
    assert sorted(r["score"] for r in got) == pytest.approx(sorted(plain.score(r[1]) for r in rows), rel=1e-9)


def test_no_training_text(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    model = ngram.train(docs.where("doc_id > 1"), new_folder(spark, "ngram"), 2)
    row = ngram.score(docs, model).first()
    assert (row["score"], row["base_score"], row["n_known"], row["n_tokens"]) == (0, 0, 0, 3)
    assert ngram.score(docs.limit(0), model).count() == 0
