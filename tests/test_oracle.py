"""Every query with SQL against DuckDB over the smallest tables, and that its branches occur."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

from quire.operators import lines
from quire.plans import files, further, manuscript, oracle, queries

QUERIES, SQL = queries.QUERIES | further.QUERIES | files.QUERIES, oracle.SQL | further.SQL | files.SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(small):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    return c


def plain(value):
    return round(value, 6) if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, small, con, name):
    df = QUERIES[name](spark, small)
    columns = sorted(df.columns)
    got = sorted(([plain(r[c]) for c in columns] for r in df.collect()), key=repr)
    res = con.execute(SQL[name])
    names = [c[0] for c in res.description]
    assert sorted(names) == columns
    want = sorted(([plain(r[names.index(c)]) for c in columns] for r in res.fetchall()), key=repr)
    assert got == want and got


def test_every_query_has_sql():
    assert set(SQL) == set(QUERIES)


def test_the_manuscript_reaches_all_branches(spark, small):
    df = lines.blocks(manuscript.raw_lines(spark, small).select("doc_id", "line_no", "raw"))
    levels = {r.level: (r.n, r.long, r.short) for r in df.groupBy("level").agg(F.count("*").alias("n"), F.count_if("ambiguous").alias("long"), F.count_if(~F.col("ambiguous")).alias("short")).collect()}
    assert set(levels) == set(range(-1, 11))
    assert all(long and short for k, (_, long, short) in levels.items() if k >= 0)


def test_windows_of_blocks_share_one_exchange(spark, small):
    df = lines.blocks(spark.createDataFrame([(1, 0, "a")], "doc_id int, line_no int, raw string").repartition(3))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(doc_id") == 1
