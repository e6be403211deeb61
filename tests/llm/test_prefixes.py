"""Token counts of prefixes against the library, prefix by prefix."""

import random

import pytest
from pyspark.sql import functions as F

from gradloom.llm import prefixes
from gradloom.llm.storage import new_folder

tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")

ODD = [
    "", "a", " ", "hello world", "I'll we've 's 'tis !!'ll x'", "'re'", "a  b   c\n\n d\n\nx \n", "a<|endoftext|> b  <|endof <|endoftext|><|endoftext|>x'",
    "<|endoftext|>", "é日本語  😀😀 ä́  ", "-" * 300 + " " * 200 + "x", "a" * 50 + "b'r", "՘ՙ ࢏1 \U0001df25", "\x1c a\x1f b\x85\xa0c", " 's",
    "½²³ ºª µ×÷", "x  y", "'ſ 'S",
]


@pytest.fixture(scope="module")
def file():
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        return f.read()


def test_every_prefix(file):
    table, library = prefixes.Prefixes(file), tokenizers.Tokenizer.from_str(file)
    rng = random.Random(1)
    parts = [*"abcdeiortshln   '''\n\t.,!-19é日😀<|>", "<|endoftext|>", "'ll", "'re", " the", "ing", "  ", "\r\n"]
    texts = ODD + ["".join(rng.choices(parts, k=rng.randint(1, 25))) for _ in range(300)]
    for text in texts:
        total, steps = table.count(text)
        counts = prefixes.counts_of(steps).tolist()
        assert counts == [len(library.encode(text[: i + 1], add_special_tokens=False).ids) for i in range(len(text))], text
        assert total == (counts[-1] if text else 0)


def test_code_points_in_their_contexts(file):
    table, library = prefixes.Prefixes(file), tokenizers.Tokenizer.from_str(file)
    points = [*range(0x300), *random.Random(2).sample(range(0x300, 0xD800), 1500), *random.Random(3).sample(range(0x10000, 0x110000), 500)]
    texts = [f"a{chr(c)}1{chr(c)}!{chr(c)}{chr(c)} b{chr(c)}" for c in points]
    want = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [table.count(t)[0] for t in texts] == want


def test_memory_is_bounded_and_steps_may_be_wide(file, monkeypatch):
    monkeypatch.setattr(prefixes, "REMEMBERED", 5)
    table = prefixes.Prefixes(file)
    text = " ".join(f"word{i}" for i in range(50))
    want = prefixes.counts_of(table.count(text)[1])
    monkeypatch.setattr(table, "run", lambda piece: [1000 * (i + 1) for i in range(len(piece))])
    wide = prefixes.counts_of(table.count("ab cd")[1])
    assert wide.tolist() == [1000, 2000, 3000, 4000, 5000] and len(want) == len(text)


def test_table_answers_truncation_and_budget(spark, file):
    library = tokenizers.Tokenizer.from_str(file)
    texts = [*ODD, None, "one two  three " * 20_000]
    docs = spark.createDataFrame([(i if i else None, t, "n") for i, t in enumerate(texts)], "doc_id long, text string, total string")
    table = prefixes.store(docs.union(docs.limit(1)), file, new_folder(spark, "prefixes"), keep=("doc_id", "total"))
    assert table.columns == ["doc_id", "total", "n_bytes", "n_tokens", "steps"]
    asked = table.withColumn("at3", prefixes.tokens_at("steps", F.lit(3))).withColumn("within4", prefixes.longest_within("steps", F.lit(4)))
    rows = asked.collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        text = texts[r["doc_id"] or 0] or ""
        size = lambda t: len(library.encode(t, add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["at3"]) == (len(text.encode()), size(text), size(text[:3]))
        fits = [i for i in range(min(len(text), 400) + 1) if size(text[:i]) <= 4]
        assert r["within4"] == max(fits)
    none = table.where("doc_id = 1").select(prefixes.longest_within("steps", F.lit(None)).alias("n"), prefixes.tokens_at("steps", F.lit(None)).alias("m")).first()
    assert tuple(none) == (0, 0)
    assert prefixes.count(docs.limit(0), file).count() == 0
    with pytest.raises(ValueError, match="cannot be kept"):
        prefixes.count(docs.withColumnRenamed("total", "steps"), file, keep=("steps",))


def test_other_files_are_refused():
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        with pytest.raises(ValueError, match="byte-level"):
            prefixes.Prefixes(f.read())
