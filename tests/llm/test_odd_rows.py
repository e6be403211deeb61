"""Null, empty, very long, tied, repeated and clashing rows, and empty tables, for operators without such tests elsewhere."""

import pytest

from gradloom.llm import curriculum, hamming, jaccard, linededup, quality, warc
from gradloom.llm.storage import new_folder

LONG = "lorem ipsum dolor sit amet consectetur " * 20_000


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, None, "a", 0), (2, "", "a", 0), (3, LONG, None, 0), (4, "one two three four five six", "b", 0), (4, "one two three four five six", "b", 0), (None, "x", "b", 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size int")


def test_archives(spark):
    rows = [(1, "http://a.b/", None, 0), (2, None, "", 0), (3, "http://a.b/", LONG, 0), (4, "http://a.b/?é", LONG, 0), (4, "http://a.b/?é", LONG, 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, key int")

    def stored(pages):
        folder = new_folder(spark, "warc")
        index = warc.build_index(warc.write(pages, folder), folder)
        wanted = pages.select(warc.url_key(pages["url"]).alias("urlkey"), pages["page_id"].alias("key"))
        return warc.read(warc.lookup(index, wanted), folder).collect()

    got = sorted((r["key"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in stored(pages))
    n = len(LONG)
    assert got == [(1, "revisit", 2, 0), (2, "response", None, 0), (3, "revisit", 4, n), (4, "response", None, n), (4, "response", None, n)]
    assert stored(pages.limit(0)) == []


def test_lines(spark, docs):
    done = linededup.dedup(docs, new_folder(spark, "lines"), counts=True)
    assert done.columns[:4] == docs.columns
    got = sorted(((r["doc_id"] or 0, r["text"], r["__lines"], r["__gone"]) for r in done.collect()), key=lambda r: r[0])
    assert got == [(0, "x", 1, 0), (1, None, 0, 0), (2, "", 0, 0), (3, LONG, 1, 0), *[(4, "one two three four five six", 1, 0)] * 2]
    assert linededup.dedup(docs.limit(0), new_folder(spark, "lines")).count() == 0


def test_nearest(spark):
    rows = [(20, 0, 1), (1, 0, 1), (2, 0, 1), (3, 1, 1), (3, 1, 1), (4, None, 1), (None, 0, 1)]
    codes = spark.createDataFrame(rows, "id long, code long, rank int")
    got = hamming.search(codes, codes.where("id % 20 = 0"), k=3).collect()
    assert sorted((r["rank"], r["id"], r["distance"]) for r in got) == [(1, 1, 0), (2, 2, 0), (3, 3, 1)]
    assert hamming.search(codes.limit(0), codes.limit(0), k=3).count() == 0


def test_quality(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in quality.score(docs, quality.fit(docs, none)).collect()} == {0.5}
    labels = spark.createDataFrame([(3, 1), (4, 0), (4, None), (None, 1)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    got = quality.score(docs, model).collect()
    assert len(got) == 6 and all(0 <= r["score"] <= 1 for r in got)
    assert quality.score(docs.limit(0), model).count() == 0


def test_components(spark, docs):
    got = sorted(((r["doc_id"] or 0, r["n_shingles"], r["component_id"]) for r in jaccard.join(docs, new_folder(spark, "jaccard")).collect()), key=lambda r: r[0])
    assert got == [(0, 1, None), (1, 0, 1), (2, 0, 2), (3, 6, 3), (4, 2, 4), (4, 2, 4)]
    assert jaccard.join(docs.limit(0), new_folder(spark, "jaccard")).count() == 0


def test_mix(docs):
    got = curriculum.mix(docs, (5, 2, 1)).collect()
    assert len(got) == 6 and all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    assert sorted((r["doc_id"] or 0, r["size"], r["source_size"]) for r in got) == [(0, 1, 13), (1, 0, 0), (2, 0, 0), (3, 120_000, 120_000), (4, 6, 13), (4, 6, 13)]
    assert curriculum.mix(docs.limit(0), (5, 2, 1)).count() == 0


def test_long_vectors_are_refused(spark):
    rows = spark.createDataFrame([(1, [1.0] * 64), (2, [-1.0, 1.0]), (3, None)], "id long, v array<double>")
    code = hamming.sign_code(rows["v"]).alias("code")
    assert {r["id"]: r["code"] for r in rows.select("id", code).collect()} == {1: -1, 2: 2, 3: None}
    longer = spark.createDataFrame([(1, [1.0] * 65)], "id long, v array<double>")
    with pytest.raises(Exception, match="more than 64 elements: 65"):
        longer.select(hamming.sign_code(longer["v"])).collect()


@pytest.mark.parametrize("weights, most", [((5, 2, 1), 3.0), ((1, 4, 40), 1.5), ((3, 1), 0.5)])
def test_more_sources_than_the_driver_holds(spark, monkeypatch, weights, most):
    sizes = {None: 9, "a": 1, "b": 300, "c": 0, "é": 40, "z": 2, "\U0001f600": 7, "\uffee": 5}
    rows = [(i, s, "w " * n) for i, (s, n) in enumerate(sizes.items())]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")

    def mixed():
        return {r["doc_id"]: [-1.0 if x is None else x for x in tuple(r)[2:]] for r in curriculum.mix(docs, weights, most).collect()}

    want = mixed()
    monkeypatch.setattr(curriculum, "MOST_SOURCES", 3)
    got = mixed()
    assert got.keys() == want.keys()
    for i in want:
        assert got[i] == pytest.approx(want[i], rel=1e-9)


def test_links_through_rows_without_id(spark):
    """Two texts that link only through one that has no id are one component."""
    words = [f"w{i}" for i in range(60)]
    texts = [(1, words[:50]), (None, words[5:55]), (2, words[10:60]), (None, ["other"] * 7), (None, ["other"] * 7)]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in texts], "doc_id long, text string")
    got = jaccard.join(docs, new_folder(spark, "jaccard")).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"]) for r in got if r["n_shingles"] > 40) == [(0, 1), (1, 1), (2, 1)]
    assert [(r["doc_id"], r["component_id"]) for r in got if r["n_shingles"] < 40] == [(None, None)] * 2


def test_text_of_a_hundred_thousand_lines(spark):
    lines = [f"l{i} n{7 * i} of t{3 * i} u{i}" for i in range(50_000)]
    text = "\n".join([*lines, "", *lines])
    docs = spark.createDataFrame([(1, text), (2, f"{lines[7]}\nsomething else here")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in linededup.dedup(docs, new_folder(spark, "lines"), counts=True).collect()}
    assert got[1]["__lines"] == 100_000 and got[1]["__gone"] >= 50_000
    left = got[1]["text"].split("\n")
    assert left[0] == lines[0] and len(left) == 100_001 - got[1]["__gone"]
    assert got[2]["text"] == "something else here"


def test_language_beside_columns_of_its_names(spark):
    import corpus_pipeline
    from gradloom.llm import langid

    rows = [(i, "el perro come la carne en la calle" if i % 2 else "the dog eats the meat in the street", "es" if i % 2 else "en", "s", 1) for i in range(20)]
    rows += [(21, None, None, "s", 1), (22, "", None, "s", 1), (23, "12345", None, "s", 1), (24, LONG * 3, None, "s", 1), (24, LONG * 3, None, "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string, lang_pred int")
    kept = corpus_pipeline.identify_language(spark, docs, "")
    assert kept.columns == docs.columns
    assert {*range(20)} <= {r["doc_id"] for r in kept.collect()} and not {21, 22, 23} & {r["doc_id"] for r in kept.collect()}
    assert sum(r["doc_id"] == 24 for r in kept.collect()) in (0, 2)
    assert corpus_pipeline.identify_language(spark, docs.limit(0), "").count() == 0
    with pytest.raises(ValueError, match="cannot be kept"):
        langid.identify(docs, langid.fit(docs), keep=("score",))
