import re

from sparrowhawk.llm import queries


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_native_operators_have_no_python(spark, small):
    for name in ("op4_sharding", "op6_url_filter"):
        assert not re.search("Python|Pandas|Arrow", plan(queries.QUERIES[name](spark, small))), name


def test_no_cartesian_products(spark, small):
    for name, f in queries.QUERIES.items():
        assert not re.search("CartesianProduct|BroadcastNestedLoopJoin", plan(f(spark, small))), name


def test_oracles(spark, small):
    import glob
    import os

    import duckdb

    c = duckdb.connect()
    for p in glob.glob(f"{small}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    for name, sql in queries.ORACLES.items():
        df = queries.QUERIES[name](spark, small)
        columns = sorted(df.columns)
        rel = c.sql(sql)
        assert sorted(rel.columns) == columns
        at = [rel.columns.index(x) for x in columns]
        assert sorted(str(tuple(r[x] for x in columns)) for r in df.collect()) == sorted(str(tuple(r[i] for i in at)) for r in rel.fetchall()), name
