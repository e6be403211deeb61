"""Personal data: patterns against a plain reading of their rules, gradients, windows and odd rows."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradloom.llm import pii, tagger

SF = "/root/testdata/sf0.001"


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(d[::-1])) % 10 == 0


def plain(text):
    """The patterns as they are written, with re's own leftmost search."""
    digits = lambda s: re.sub("[^0-9]", "", s)
    tests = [
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        (r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m))),
        (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    ]
    return [(k, *m.span()) for k, (p, test) in enumerate(tests) for m in re.finditer(p, text) if test(m.group())]


def test_base_spans_equal_patterns():
    r = random.Random(5)
    fixed = ["a@b.c@d.e.f", "@x.y", "a@b", "a@@b.c d@e.f", "1.2.3.4.5.6.7.8", "300.1.1.1", "4111 1111-1111 1111", "+1 (348) 555-4944", "٣.1.2.3.4", "é@b.c", "x@é.y a.b@c.d-e.f."]
    texts = fixed + ["".join(r.choice("ab@@..  --++%0124578()9\n\té") for _ in range(r.randrange(60))) for _ in range(30_000)]
    texts += ["".join(r.choice("0123456789.- ") for _ in range(40)) for _ in range(5000)]
    for t in texts:
        assert sorted(pii.base_spans(t)) == sorted(plain(t)), t


def test_gradient():
    w = tagger.fresh(3)
    w = tagger.Weights(*(x.astype(np.float32) for x in w))
    r = np.random.default_rng(1)
    chars, labels, length = r.integers(0, tagger.NONE, (7, 4)).astype(np.uint8), r.integers(0, 5, (7, 4)), np.array([7, 5, 1, 3])
    chars[np.arange(7)[:, None] >= length] = tagger.NONE
    _, g = tagger.gradient(w, chars, labels, length)
    for field, x in enumerate(w):
        for _ in range(6):
            at = tuple(r.integers(0, n) for n in x.shape)
            old, step = x[at], 1e-2
            x[at] = old + step
            up = tagger.gradient(w, chars, labels, length)[0]
            x[at] = old - step
            down = tagger.gradient(w, chars, labels, length)[0]
            x[at] = old
            assert (up - down) / (2 * step) == pytest.approx(g[field][at], abs=2e-3)


def test_decode_equals_all_paths():
    import itertools

    r = np.random.default_rng(2)
    w = tagger.fresh(2)
    w = w._replace(move=r.normal(0, 1, (5, 5)).astype(np.float32), start=r.normal(0, 1, 5).astype(np.float32))
    e, length = r.normal(0, 1, (5, 4, 30)).astype(np.float32), r.integers(1, 5, 30)
    e[0, :, :15] += 3
    best = tagger.decode(w, e, length)
    for n in range(30):
        def value(p):
            return w.start[p[0]] + sum(e[k, t, n] for t, k in enumerate(p)) + sum(w.move[a, b] for a, b in itertools.pairwise(p))

        top = max(itertools.product(range(5), repeat=int(length[n])), key=value)
        assert value(tuple(best[: length[n], n])) == pytest.approx(value(top), abs=1e-5)


@pytest.fixture(scope="module")
def learned(spark):
    return pii.fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def test_tagger_adds_forms_without_pattern(learned):
    found = 0
    texts = ["and write to jane.doe (at) mail (dot) org then", "the and call (348) 555-4944 today of", "the address 10[.]1[.]22[.]3 was to", "and 4242.4242.4242.4242 is of the"]
    for text in texts:
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        found += bool(pii.added_spans(text, pii.label(learned, points, np.array([0, len(points)]), pii.Settings()), []))
    assert found >= 3


def held_out(r, words):
    """Forms without a pattern, made apart from the training forms, each between words of other documents."""
    digits = lambda n: "".join(map(str, r.integers(0, 10, n)))
    word = lambda: str(r.choice(words)).lower()
    for _ in range(100):
        a, b, c = digits(3), digits(3), digits(4)
        card = next(x for x in iter(lambda: digits(16), "") if luhn(x))
        yield 0, (f"{word()}.{digits(2)} at {word()} dot com", f"{word()} (at) {word()} (dot) org", f"{word()}_{digits(1)}[at]{word()}[dot]net")[int(r.integers(3))]
        yield 1, (" . ", "[.]")[int(r.integers(2))].join(str(x) for x in r.integers(1, 256, 4))
        yield 2, ".".join(card[i : i + 4] for i in range(0, 16, 4))
        yield 3, (f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}")[int(r.integers(3))]
        yield None, ("".join("0123456789abcdef"[x] for x in r.integers(0, 16, 16)), f"QX-{digits(9)}", f"2023-11-{10 + int(r.integers(18))}", f"{digits(2)},{digits(3)}.{digits(2)}")[int(r.integers(4))]


def test_recall_and_precision_on_held_out_forms(spark, learned):
    """By kind: a span is found if its kind is right and 80 % of it is covered; a span that meets none of its kind is wrong."""
    texts = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").where("text IS NOT NULL").orderBy("doc_id").limit(40).collect()]
    words = [w for t in texts for w in t.split() if w.isalpha()]
    r = np.random.default_rng(99)
    found, said, right, decoys = [0] * 4, [0] * 4, [0] * 4, 0
    for kind, form in held_out(r, words):
        before, after = (" ".join(r.choice(words, 8)) for _ in "ab")
        text = f"{before} {form} {after}"
        a, b = len(before) + 1, len(before) + 1 + len(form)
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        got = pii.added_spans(text, pii.label(learned, points, np.array([0, len(points)]), pii.Settings()), pii.base_spans(text))
        for k, x, y in got:
            said[k] += 1
            right[k] += k == kind and x < b and y > a
            decoys += kind is None
        if kind is not None:
            found[kind] += any(k == kind and min(y, b) - max(x, a) >= 0.8 * len(form) for k, x, y in got)
    print("recall", found, "precision", [p / max(n, 1) for p, n in zip(right, said, strict=True)], "spans in 100 decoys", decoys)
    assert min(found) >= 60 and sum(found) >= 320
    assert all(p >= 0.85 * n for p, n in zip(right, said, strict=True)) and decoys <= 5


def test_nothing_inside_longer_runs():
    """A span glued to letters or digits outside it is none."""
    text = "id 33e61083.12.9.7aa and 10[.]1[.]22[.]3 x"
    labels = np.zeros(len(text), np.uint8)
    labels[5:18] = labels[25:40] = 2
    assert pii.added_spans(text, labels, []) == [(1, 25, 40)]


def test_windows_reconcile(learned):
    """A span on any border of windows is found as it is elsewhere."""
    s = pii.Settings(window=64, overlap=32)
    for before in range(0, 70, 7):
        text = "the of and " * 12
        text = text[:before] + " anre 46.144.27.142 edes " + text
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        labels = pii.label(learned, points, np.array([0, len(points)]), s)
        at = text.index("46.")
        assert (labels[at : at + 13] == 2).mean() > 0.9


def test_query_rows(spark, learned):
    """Null, empty, very long, repeated and clashing rows; base spans stay, and clean text gets none."""
    long = "word " * 40_000 + "a.b@c.de"
    rows = [(1, None, 0), (2, "", 0), (3, long, 0), (4, "x +1 (348) 555-4944", 0), (4, "x +1 (348) 555-4944", 0), (None, "é 1.2.3.4 é", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans int")
    got = sorted(((r["doc_id"] or 0, [tuple(s) for s in r["base"]], {tuple(s) for s in r["spans"]}) for r in pii.find(docs, learned).collect()), key=lambda r: r[0])
    assert [b for _, b, _ in got] == [[("ip", 2, 9)], [], [], [("email", 200_000, 200_008)], [("phone", 2, 19)], [("phone", 2, 19)]]
    assert all(set(b) <= s for _, b, s in got)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = pii.find(docs, learned).join(docs, "doc_id").collect()
    extra = 0
    for r in found:
        assert [(pii.KINDS.index(s["kind"]), s["start"], s["end"]) for s in r["base"]] == sorted(plain(r["text"] or ""))
        extra += len(r["spans"]) - len(r["base"])
    assert extra <= len(found) // 20
    assert pii.find(docs.limit(0), learned).count() == 0


def test_digest(spark):
    from gradloom.llm.queries import op10_pii

    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in op10_pii(spark, SF).where(F.col("doc_id") < 100).collect():
        spans = sorted(plain(docs[r["doc_id"]]))
        text = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in spans)
        assert r["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == i for s in spans) for i in range(4)]
        assert set(filter(None, text.split(","))) <= set(r["spans"].split(","))


def test_no_labelled_spans(spark):
    docs = spark.createDataFrame([(1, None)], "doc_id long, text string")
    row = pii.find(docs, pii.fit(docs)).first()
    assert (row["base"], row["spans"]) == ([], [])
