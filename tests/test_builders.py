"""The matrix builder from nested arrays, which the queries of both orders run through."""

from gradloom.sources import builders as B
from gradloom.suite import load_cases

SF = "/root/testdata/sf0.001"


def test_blocks_of_columns(spark):
    rows = spark.createDataFrame([(0, [[1.0, 2.0], [3.0, 4.0]]), (2, [[5.0], [6.0]])], "start long, m array<array<double>>")
    cells = {(r["idx"], r["k"]): r["v"] for r in B.matrix_from_array(rows, offset="start").collect()}
    assert cells == {(0, 0): 1.0, (1, 0): 2.0, (0, 1): 3.0, (1, 1): 4.0, (2, 0): 5.0, (2, 1): 6.0}
    columns = spark.createDataFrame([(7, [[1.0, 2.0], [3.0, 4.0]])], "start long, m array<array<double>>")
    cells = {(r["idx"], r["k"]): r["v"] for r in B.matrix_from_array(columns, row_major=False, offset="start").collect()}
    assert cells == {(7, 0): 1.0, (7, 1): 2.0, (8, 0): 3.0, (8, 1): 4.0}


def test_queries_use_the_builder(spark, monkeypatch):
    calls, build = [], B.matrix_from_array

    def seen(rows, array="m", row_major=True, offset=None):
        calls.append(row_major)
        return build(rows, array, row_major, offset)

    monkeypatch.setattr(B, "matrix_from_array", seen)
    for name in ("mat_from_array", "mat_from_nested_array"):
        load_cases()[name].run(spark, SF)
    assert calls == [False, True]
