import zlib
from collections import Counter, defaultdict

import pytest

from sparrowhawk.llm import sharding as S

from .helpers import EDGE, documents


@pytest.fixture(scope="module")
def rows():
    return EDGE + [(i, f"text {i}") for i in range(1000, 5000)]


def test_contract(spark, rows):
    got = S.assign(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    want = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        assert 0 <= r["shard"] < 24 and r["law"] == "key"
        assert r["grown_shard"] in (r["shard"], 24)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    n = Counter(r["grown_shard"] for r in got)
    assert 100 < n[24] < 260 and all(100 < n[s] < 260 for s in range(24))


def test_doc_id_and_count_decide(spark, rows):
    one = {r["doc_id"]: r["shard"] for r in S.assign(documents(spark, rows)).collect()}
    two = {r["doc_id"]: r["shard"] for r in S.assign(documents(spark, [(i, "other") for i, _ in reversed(rows)])).collect()}
    assert one == two


def test_growth_goes_only_into_the_new_shard(spark):
    docs = documents(spark, [(i, "x") for i in range(2000)])
    for n in (24, 25, 26):
        assert all(r["grown_shard"] in (r["shard"], n) for r in S.assign(docs, n).collect())


def test_weights_and_subtrees(spark):
    """A heavier rack draws rows into it from its siblings; other regions keep theirs."""
    from pyspark.sql import functions as F

    tree = S.tree_for(24)
    heavy = {g: {c: dict(s) for c, s in r.items()} for g, r in tree.items()}
    heavy[0][0] = {k: 2.0 for k in heavy[0][0]}
    heavy[0][1] = {k: 0.0001 for k in heavy[0][1]}  # the region weighs the same, its racks don't
    keys = spark.range(4000).select(F.col("id").cast("string").alias("k"))
    got = keys.select(S.shard_of(tree, F.col("k")).alias("a"), S.shard_of(heavy, F.col("k")).alias("b")).collect()
    assert all(r["a"] == r["b"] for r in got if r["a"] >= 8 or r["b"] >= 8 if r["a"] // 8 == r["b"] // 8)
    assert all(r["b"] < 4 for r in got if r["a"] < 8 and r["b"] < 8 and r["b"] // 4 != r["a"] // 4)


def test_empty(spark):
    assert S.assign(documents(spark, [(1, "x")]).where("false")).count() == 0
