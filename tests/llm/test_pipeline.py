"""Every stage of the pipeline against plain code, each on what the one before it kept."""

import corpus_pipeline as P
from test_queries import SF, plain_components, plain_matches, texts_of, words

from gradloom.llm import queries as Q
from gradloom.suite.checks import duck


def plain_lines(texts):
    """Texts without lines that repeat an earlier one; without any line with words left, none."""
    seen, kept = [], {}
    for i in sorted(texts):
        lines, gone, worded = [], 0, 0
        for line in (texts[i] or "").split("\n"):
            s = set(words(line))
            worded += bool(s)
            if s and any(180 * len(s & t) >= 80 * (len(s) + len(t)) for t in seen if 0.8 * len(s) <= len(t) <= 1.25 * len(s)):
                gone += 1
            else:
                lines.append(line)
            if s:
                seen.append(s)
        if not gone or gone < worded:
            kept[i] = "\n".join(lines) if gone else texts[i]
    return kept


def test_stages(spark, tmp_path):
    docs, before, bench = spark.read.parquet(f"{SF}/documents.parquet"), texts_of(spark, "documents", "doc_id"), texts_of(spark, "benchmark", "item_id")
    columns = docs.columns
    for i, (_, stage) in enumerate(P.STAGES):
        done = stage(spark, docs, SF)
        done.write.parquet(f"{tmp_path}/{i}")
        done = spark.read.parquet(f"{tmp_path}/{i}")
        if i < 4:
            after = {r["doc_id"]: r["text"] for r in done.collect()}
            assert done.columns == columns
        if i == 0:
            assert 0.8 * len(before) <= len(after) <= len(before) and after.items() <= before.items()
        elif i == 1:
            assert after == plain_lines(before)
        elif i == 2:
            found = plain_components(before)
            assert after == {k: t for k, t in before.items() if found[k][1] == k}
        elif i == 3:
            dirty = {d for d, _ in plain_matches(before, bench)}
            assert after == {k: t for k, t in before.items() if k not in dirty}
        else:
            con = duck(SF)
            con.execute(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{tmp_path}/3/*.parquet'")
            names = ["doc_id", "size", "source_size", "taken"]
            want = con.sql(Q.OP8_SQL).select(*names).fetchall()
            assert sorted(tuple(r) for r in done.select(*names).collect()) == sorted(want)
        docs, before = done, after


def test_repeated_and_null_ids(spark, tmp_path):
    """Stages 3 and 4 decide on rows: of repeated rows one stays, and an id's other texts are not touched."""
    one = "the small boat left the harbour at dawn and came back with a net full of silver fish"
    two = "nobody in the village remembered who had built the tower on top of the northern hill"
    leak = "how many apples are left in the basket when the two children have eaten half of them"
    rows = [(1, one), (1, one), (2, one), (2, two), (None, one), (None, two), (3, leak), (3, "a clean text"), (None, leak), (None, "another clean text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    order = lambda rows: sorted(rows, key=repr)
    done = P.join_near_copies(spark, docs, str(tmp_path))
    want = [(1, one), (2, two), (3, leak), (3, "a clean text"), (None, "another clean text")]
    assert order(map(tuple, done.collect())) == order(want)
    done = P.drop_contaminated(spark, docs, str(tmp_path))
    assert order(map(tuple, done.collect())) == order(r for r in rows if r[1] != leak)


def test_rows_are_told_apart_where_they_lie(spark, tmp_path):
    """Stages 3 and 4 write no copy of their texts, and tell rows apart by text whatever their ids."""
    from pyspark.sql import functions as F

    same = " ".join(f"w{i}" for i in range(40))
    rows = [(None, same), (7, same), (7, same), (5, f"{same} more"), (5, f"{same} more"), (9, ""), (9, ""), (9, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    texts = P.told_apart(docs).select("__same", F.coalesce("text", F.lit("")).alias("t")).distinct()
    assert texts.count() == texts.select("__same").distinct().count() == 3
    done = P.join_near_copies(spark, docs, str(tmp_path))
    assert sorted(map(tuple, done.collect()), key=repr) == sorted([(5, f"{same} more"), (9, ""), (9, ""), (9, None)], key=repr)
    docs.write.parquet(f"{tmp_path}/docs")
    spark.createDataFrame([(1, same)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    for stage in (P.join_near_copies, P.drop_contaminated):
        plan = stage(spark, docs, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
        assert "LogicalRDD" not in "".join(line for line in plan.splitlines() if "text" in line)
