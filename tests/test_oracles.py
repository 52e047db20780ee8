"""Every registered query against its SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

from sparrowhawk import registry


@pytest.fixture(scope="module")
def duck(small):
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for p in glob.glob(f"{small}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    return f"{v:.6g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_equal(spark, small, duck, name):
    df = registry.QUERIES[name](spark, small)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    rel = duck.sql(registry.ORACLES[name])
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    assert got == sorted(tuple(plain(r[i]) for i in at) for r in rel.fetchall())


#: Nations (key, name), customers of a high balance for each key, and whether the customers have keys of their own.
GATES = {
    "all pass": ([(1, "a"), (2, "b")], {1: 12, 2: 13}, True),
    "one fails": ([(1, "a"), (2, "b"), (None, "c")], {1: 12, 2: 11, None: 12}, True),
    "names repeat": ([(1, "a"), (2, "a"), (3, "b"), (4, "b")], {1: 6, 2: 6, 3: 5, 4: 6}, True),
    "keys repeat": ([(1, "a"), (1, "a"), (1, "b")], {1: 6}, True),
    "no nations": ([], {1: 12}, True),
    "no customers": ([(1, "b"), (2, "a")], {}, True),
    "customers without keys": ([(1, "a")], {1: 12}, False),
    "no name fails": ([(1, None), (2, "a")], {2: 12}, True),
    "an empty name fails": ([(1, ""), (2, None), (3, "a")], {3: 12}, True),
}


@pytest.mark.parametrize("case", GATES)
def test_deploy_gates_of_odd_tables(spark, tmp_path, case):
    nations, rich, keyed = GATES[case]
    customers = [(i if keyed else None, k, 9000.0) for k, n in rich.items() for i in range(n)] + [(99, 1, b) for b in (None, 8000.0, -1.0)]
    spark.createDataFrame(nations, "n_nationkey int, n_name string").coalesce(1).write.parquet(f"{tmp_path}/nation.parquet")
    spark.createDataFrame(customers, "c_custkey long, c_nationkey int, c_acctbal double").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    c = duckdb.connect()
    for t in ("nation", "customer"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    rel = c.sql(registry.ORACLES["deploy_gates"])
    df = registry.QUERIES["deploy_gates"](spark, str(tmp_path))
    assert df.columns == rel.columns and [tuple(r) for r in df.collect()] == rel.fetchall()


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(spark, small, name):
    df = registry.QUERIES[name](spark, small)
    rows = df.collect()
    assert len(rows) > 0 or name == "line_rules"  # the core's rules find nothing in prose; core_rules has lines for each


def test_contract(spark, small):
    import __spark_entry__ as e

    assert set(registry.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
