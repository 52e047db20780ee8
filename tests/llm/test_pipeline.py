from collections import Counter

import pytest

import corpus_pipeline as C
from sparrowhawk.llm import near_dedup as N

from .test_decontamination import distance
from .test_exact_dedup import brute as exact


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Each stage's documents over a few hundred rows that copies, near copies, leaks and junk were put into."""
    import os

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("the given tables aren't here")
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").limit(120)
    rows = [tuple(r) for r in docs.collect()]
    bench = spark.read.parquet(f"{sf}/benchmark.parquet").first()["text"]
    more = [(9001, rows[0][1] + "  ", "en", "s", 1), (9002, rows[1][1].replace(" ", "  "), "en", "s", 1), (9003, rows[3][1] + " tail", "fr", "s", 1), (9004, rows[2][1] + "\n" + bench, "en", "s", 1), (9005, None, None, "s", 0), (9006, "12345", None, "s", 5)]
    out = [spark.createDataFrame(rows + more, docs.schema)]
    base = tmp_path_factory.mktemp("stages")
    for name, f in C.STAGES:
        f(spark, out[-1], sf).write.parquet(f"{base}/{name}")
        out.append(spark.read.parquet(f"{base}/{name}"))
    return out, [[tuple(r) for r in x.collect()] for x in out], spark.read.parquet(f"{sf}/benchmark.parquet").collect()


def ids(rows):
    return {r[0] for r in rows}


def test_schema_and_order(stages):
    frames, _, _ = stages
    assert [n for n, _ in C.STAGES] == ["language_id", "exact_dedup", "near_dedup", "decontamination", "packing"]
    assert all(x.columns == frames[0].columns for x in frames[1:-1])


def test_language_drops_only_what_has_none(stages):
    _, rows, _ = stages
    assert {9005, 9006} & ids(rows[1]) == set()
    assert len(rows[0]) - len(rows[1]) <= 2 + 1


def test_exact_dedup_is_brute_force(stages):
    _, rows, _ = stages
    assert ids(rows[2]) == {r[0] for r in exact([(x[0], x[1]) for x in rows[1]]) if r[3]}


def test_near_dedup_is_brute_force(stages):
    _, rows, _ = stages
    from .test_near_dedup import brute

    groups = brute([(x[0], x[1]) for x in rows[2]])
    assert ids(rows[3]) == {i for i, g in groups.items() if i == g}
    assert 9003 not in ids(rows[3])


def test_leaks_go_and_clean_documents_stay(stages):
    _, rows, bench = stages
    from sparrowhawk.llm.decontamination import normalised

    gone = ids(rows[3]) - ids(rows[4])
    texts = {x[0]: normalised(x[1]) for x in rows[3]}
    holds = {i for i, t in texts.items() if any(normalised(b["text"]) in t for b in bench)}
    assert holds <= gone
    for i in gone - holds:
        assert any(distance(normalised(b["text"])[:80], texts[i]) <= 8 for b in bench)


def test_packing_holds_every_piece(stages):
    frames, rows, _ = stages
    packed = frames[-1].collect()
    assert {r["doc_id"] for r in packed} == ids(rows[4])
    per = Counter()
    for r in packed:
        per[r["sequence_id"]] += r["length"]
    assert max(per.values()) <= 4096


def test_rows_that_share_an_id_are_dropped_one_by_one(spark, small):
    """A copy, a near copy and a leak bear the ids of documents that stay, in both orders of rows."""
    docs = spark.read.parquet(f"{small}/documents.parquet").where("length(text) > 600").orderBy("doc_id").limit(6)
    a, b, c, d, e, f = [r["text"] for r in docs.collect()]
    bench = spark.read.parquet(f"{small}/benchmark.parquet").first()["text"]
    rows = [(1, a), (2, b), (2, a), (3, c), (3, a + " tail"), (4, d), (4, e + "\n" + bench), (5, f)]
    for given in (rows, rows[::-1]):
        kept = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in given], docs.schema)
        for _, stage in C.STAGES[1:-1]:
            kept = stage(spark, kept, small)
        assert sorted((r["doc_id"], r["text"]) for r in kept.collect()) == sorted([(1, a), (2, b), (3, c), (4, d), (5, f)])


def test_run_leaves_its_result_only(spark, small, tmp_path, monkeypatch):
    import os

    from sparrowhawk.llm import common

    monkeypatch.setattr(common, "shared_root", lambda spark: f"file://{tmp_path}")
    assert C.run(spark, small).count() > 0
    assert [x.split("-")[1] for x in os.listdir(tmp_path / "sparrowhawk")] == ["packing"]


def test_elements_helper():
    assert N.similarity(N.elements("a b c d e f".split()), N.elements("a b c d e f".split())) == 1
