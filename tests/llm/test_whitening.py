"""Whitening by block matrices against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradloom.llm import whitening
from gradloom.llm.storage import new_folder


def whitened(spark, rows, **settings):
    """rows: (id, vector or None)."""
    table = spark.createDataFrame([(i, v, 1.0) for i, v in rows], "vec_id long, v array<float>, whitened double").repartition(3)
    kept = table.where(whitening.whole("v")).select("vec_id", whitening.scaled("v").alias("x"), "whitened")
    return whitening.whiten(kept, new_folder(spark, "whitening"), **settings)


def plain(vectors, components):
    x = np.floor(64 * np.array(vectors, np.float32).astype(float)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(0)
    values, axes = np.linalg.eigh(((n * fit - s) / n).T @ ((n * fit - s) / n) / n)
    order = np.argsort(-values)[:components]
    scores = ((n * x - s) / n) @ (axes[:, order] / np.sqrt(values[order]))
    return n, ((n * x - s) ** 2).sum(1), scores, values[order] / values.sum()


@pytest.mark.parametrize("dim, components, wide", [(5, 3, 1024), (24, 16, 1024), (9, 9, 4)])
def test_equals_numpy(spark, monkeypatch, dim, components, wide):
    monkeypatch.setattr(whitening, "WIDE", wide)
    monkeypatch.setattr(whitening, "LEAST_BLOCK", 16)
    rng = np.random.default_rng(dim)
    vectors = (rng.normal(size=(150, dim)) @ rng.normal(size=(dim, dim))).astype(np.float32)
    vectors[100:130] = vectors[3]  # copies count once in the fit
    got = whitened(spark, list(enumerate(vectors.tolist())), components=components).toPandas()
    n, deviation, scores, explained = plain(vectors, components)
    assert len(got) == 150 * components and (got["n"] == n).all() and n == 120
    table = got.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    sign = np.sign((table * scores).sum(0))
    np.testing.assert_allclose(table * sign, scores, atol=1e-8)
    assert got[got["component"] == 1].set_index("vec_id")["deviation"].sort_index().tolist() == deviation.tolist()
    np.testing.assert_allclose(got.drop_duplicates("component").sort_values("component")["explained"], explained, rtol=1e-10)
    assert got["identity_error"].max() < 1e-9 and got["identity_error"].nunique() == 1


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    bad = [(1, None), (2, []), (3, [1.0, None]), (4, [nan, 1.0]), (5, [1.0, -inf])]
    good = [(6, [1.0, 2.0]), (6, [3.0, 1.0]), (None, [0.0, -1.0]), (7, [1.0, 2.0])]
    got = whitened(spark, bad + good).collect()
    # Two dimensions give two components; three different vectors.
    assert sorted((r["vec_id"] or 0, r["component"], r["n"]) for r in got) == sorted((i or 0, c, 3) for i, _ in good for c in (1, 2))
    assert whitened(spark, bad).count() == 0 and whitened(spark, []).count() == 0
    assert whitened(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])]).count() == 0  # one vector has no variance
    flat = whitened(spark, [(i, [float(i), 5.0]) for i in range(4)]).collect()
    assert {r["component"] for r in flat} == {1}  # the second dimension has no variance
    with pytest.raises(Exception, match="different lengths"):
        whitened(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0, 3.0]), (3, [1.0, 0.0])]).count()


def test_numbers_have_no_gaps(spark):
    rows = spark.range(1000, numPartitions=7).withColumn("x", F.array("id"))
    table, n = whitening.numbered(rows.where("id % 3 > 0"), new_folder(spark, "numbered"))
    assert n == 666 and sorted(r["row"] for r in table.select("row").collect()) == list(range(666))
