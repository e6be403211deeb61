"""Every query with SQL against DuckDB, and what SQL cannot say against plain code."""

import itertools
import re
import string
from collections import defaultdict

import pytest

from gradloom.llm import decontaminate as D
from gradloom.llm import langid
from gradloom.llm import queries as Q
from gradloom.suite.checks import duck

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(Q.SQL))
def test_equals_sql(spark, name):
    got = Q.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = duck(SF).sql(Q.SQL[name])
    assert sorted(want.columns) == columns
    order = lambda rows: sorted(rows, key=repr)
    mine = order(tuple(round(v, 5) if isinstance(v, float) else v for v in r) for r in got.select(*columns).collect())
    theirs = order(tuple(round(v, 5) if isinstance(v, float) else v for v in r) for r in want.select(*columns).fetchall())
    assert mine == theirs


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_components(texts):
    """Set sizes and smallest linked id of every text, by comparing all pairs."""
    sets = {}
    for i, t in texts.items():
        w = words(t)
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(texts, 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (len(sets[i]), find(i)) for i in texts}


def plain_template(text):
    """(words lowered, kind of slot or None) of a text, word by word."""
    out, opens, after = [], True, False
    for raw in re.findall(r"[^\x20\x09-\x0D]+", text or ""):
        word, start = raw.strip("".join(c for c in string.punctuation if c != "%")), opens
        opens = raw[-1] in ".!?:"
        if not word:
            continue
        number = any(c in "0123456789" for c in word) or word.lower() in D.NUMBER_WORDS
        kind = "number" if number else "unit" if after and word.lower() in D.UNITS else "name" if not start and re.match("[A-ZÀ-Þ]", word) else None
        out.append((word.lower(), kind))
        after = number
    return out


def plain_windows(t, width):
    return {i: tuple(k or w for w, k in t[i : i + width]) for i in range(len(t) - width + 1) if 2 * sum(k is not None for _, k in t[i : i + width]) <= width}


def plain_matches(docs, items):
    found = set()
    items = {i: plain_template(t) for i, t in items.items()}
    for d, text in docs.items():
        t = plain_template(text)
        by_width = {}
        for item, s in items.items():
            width = min(len(s), D.WIDTH)
            own = plain_windows(s, width) if width else {}
            if width not in by_width:
                by_width[width] = defaultdict(list)
                for at, w in plain_windows(t, width).items():
                    by_width[width][w].append(at)
            places, shifts = set(), defaultdict(list)
            for at, w in own.items():
                for there in by_width[width].get(w, []):
                    shifts[there - at].append(at)
            for shift, ats in shifts.items():
                values = defaultdict(set)
                for j in {j for a in ats for j in range(a, a + width) if s[j][1]}:
                    values[s[j][0]].add(t[j + shift][0])
                if all(len(v) == 1 for v in values.values()):
                    places |= set(ats)
            if own and len(places) >= D.COVERAGE * len(own):
                found.add((d, item))
    return found


def texts_of(spark, table, key, sf=SF):
    return {r[key]: r["text"] for r in spark.read.parquet(f"{sf}/{table}.parquet").select(key, "text").collect()}


def test_components_equal_all_pairs(spark):
    want = plain_components(texts_of(spark, "documents", "doc_id"))
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in Q.op7_jaccard(spark, SF).collect()} == want


def test_contamination_equals_plain_templates(spark):
    got = {(r["doc_id"], r["item_id"]) for r in Q.op5_decontaminate(spark, SF).collect()}
    assert got == plain_matches(texts_of(spark, "documents", "doc_id"), texts_of(spark, "benchmark", "item_id"))
    assert got


def test_changed_questions(spark):
    item = "A train from Paris travels 120 km in 2 hours and then returns to Paris in 3 hours at a lower speed"
    other = item.replace("Paris", "Berlin").replace("120", "95").replace(" 2 ", " 4 ").replace(" 3 ", " 5 ")
    mixed = other.replace("returns to Berlin", "returns to London")
    docs = spark.createDataFrame([(1, "text " + item), (2, other), (2, other), (3, mixed), (4, None), (5, ""), (6, "other text"), (None, item)], "doc_id long, text string")
    items = spark.createDataFrame([(7, item), (8, None), (9, "")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["exact"]) for r in D.matches(docs, items).collect()}
    assert {(1, 7, True), (2, 7, False)} <= got and not {d for d, *_ in got} & {4, 5, 6, None}
    assert sorted(r["doc_id"] or 0 for r in D.clean(docs, items).collect() if r["doc_id"] != 3) == [0, 4, 5, 6]
    assert D.matches(docs.limit(0), items).count() == D.matches(docs, items.limit(0)).count() == 0


def test_recased_copies(spark):
    """An item whose case was changed is found, with other numbers too; one with other words is not."""
    item = "A train from París travels 120 km in 2 hours and then returns to Ávila in 3 hours at a größere speed than Anna Ñandú expected of it"
    quiet = "the old mill by the river was sold to a baker who painted its door in a bright shade of blue"
    changed = item.replace("120", "95").replace(" 2 ", " 4 ").replace(" 3 ", " 5 ")
    other = "A BAKER FROM PARÍS TRAVELS TO THE OLD MILL BY THE SEA AND THEN SLEEPS FOR 3 HOURS AT A RATHER LOUD INN"
    texts = [item.upper(), "SO THEY SAID: " + item.upper(), item.lower(), changed.upper(), changed.lower(), quiet.upper(), quiet.title(), other]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    items = spark.createDataFrame([(7, item), (8, quiet), (9, quiet.upper())], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["exact"] for r in D.matches(docs, items).collect()}
    assert got == {(0, 7): True, (1, 7): True, (2, 7): True, (3, 7): False, (4, 7): False} | {(d, i): True for d in (5, 6) for i in (8, 9)}
    assert [r["doc_id"] for r in D.clean(docs, items).collect()] == [7]


def test_copies_of_items_with_few_literal_words(spark):
    """Titles, lists of names, sums and short items are found where they stand word for word, and only there."""
    items = [
        "Who Wrote The Famous Novel About Captain Ahab And The White Whale",
        "Name these: Anna Berta Carla Dora Emma Frida Gerda Hanna Ida Jana",
        "12 km + 30 km + 45 km = 87 km and 5 kg + 6 kg = 11 kg",
        "Welche Stadt hat Dom, Rathaus, Oper, Theater, Museum, Hafen, Schloss?",
        "In Paris 1789?",
    ]
    texts = [f"they asked us this. {t} and so on it went" for t in items] + [items[0].lower(), items[1].upper()]
    texts += ["Who Painted The Large Picture About Captain Cook And The Blue Ship", "13 km + 31 km + 46 km = 90 km and 6 kg + 7 kg = 13 kg", "In Rome 1790?"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    table = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["exact"]) for r in D.matches(docs, table).collect()}
    assert got == {(i, i, True) for i in range(5)} | {(5, 0, True), (6, 1, True)}


def test_languages_of_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang", "text")
    rows = Q.op9_language(spark, "/root/testdata/sf0.01").join(docs, "doc_id").where("held_out AND lang IS NOT NULL AND lang_pred <> 'und'").collect()
    assert len(rows) > 200 and sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.95 * len(rows)
    odd = spark.createDataFrame([(1, None, 0.0), (2, "", 0.0), (3, "12 34 --", 0.0), (None, "12", 0.0)], "doc_id long, text string, score double")
    model = langid.fit(docs)
    assert {(r["lang_pred"], r["score"]) for r in langid.identify(odd, model).collect()} == {("und", 0.0)}
    assert langid.identify(odd.limit(0), model).count() == 0


def test_quality_of_held_out_texts(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = Q.op6_quality(spark, "/root/testdata/sf0.01").join(labels, "doc_id").where("held_out AND quality IS NOT NULL").select("score", "quality").collect()
    good, bad = ([r["score"] for r in rows if r["quality"] == k] for k in (1, 0))
    above = sum((a > b) + 0.5 * (a == b) for a in good for b in bad) / (len(good) * len(bad))
    assert above > 0.85 and all(0 <= r["score"] <= 1 for r in rows)
