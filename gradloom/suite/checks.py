"""Run cases on Spark and their SQL on DuckDB, and compare bit for bit."""

from __future__ import annotations

import math
import tempfile
import time

from gradloom.suite.base import with_fixtures

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def duck(sf: str):
    import duckdb

    con = duckdb.connect()
    spill = tempfile.mkdtemp(prefix='run-', dir='/tmp')
    con.execute(f"SET temp_directory = '{spill}'")
    con.execute("SET max_temp_directory_size = '4GB'")
    con.execute("SET memory_limit = '8GB'")
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(r[i] for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) for v in r))


def _bad(v):
    return isinstance(v, float) and (math.isnan(v) or (v == 0 and math.copysign(1, v) < 0))


def compare(spark, con, case, sf):
    """None when equal, else a short description of the first difference."""
    started = time.time()
    df = case.run(spark, sf)
    got_names, got = _rows(df.columns, [tuple(r) for r in df.collect()])
    spent = time.time() - started
    if case.sql is None:
        return spent, len(got), None
    cur = con.execute(with_fixtures(case.sql))
    names = [d[0] for d in cur.description]
    want_names, want = _rows(names, cur.fetchall())
    problem = None
    spark_types = {f.name: f.dataType.simpleString() for f in df.schema}
    duck_types = {d[0]: str(d[1]).lower() for d in cur.description}
    same = {"bigint": "bigint", "int": "integer", "double": "double", "string": "varchar", "boolean": "boolean"}
    wrong = {n: (t, duck_types.get(n)) for n, t in spark_types.items() if same.get(t) != duck_types.get(n)}
    if got_names != want_names:
        problem = f"columns {got_names} != {want_names}"
    elif wrong:
        problem = f"types {wrong}"
    elif len(got) != len(want):
        problem = f"rows {len(got)} != {len(want)}"
    elif got != want:
        diff = [(a, b) for a, b in zip(got, want) if a != b]
        problem = f"{len(diff)} rows differ, first {diff[0]}"
    elif any(_bad(v) for r in got + want for v in r):
        problem = "nan or negative zero"
    elif not got:
        problem = "no rows"
    return spent, len(got), problem
