import random

import numpy as np

from sparrowhawk.llm import near_dedup as N

from .helpers import EDGE, documents, sentence


def brute(rows, threshold=0.8):
    """Least id of each component of pairs of at least the threshold; ids are unique."""
    sets = {i: N.elements(N.words_of(t)) for i, t in rows if i is not None}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if len(sets[a]) and len(sets[b]) and N.similarity(sets[a], sets[b]) >= threshold:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_components_equal_brute_force(spark):
    rng = random.Random(5)
    rows = list(EDGE)
    base = [f"w{rng.randrange(10_000)}" for _ in range(120)]
    for i in range(60):  # a large group, some of it only linked through others
        words = list(base)
        for _ in range(rng.randrange(0, 5)):
            words[rng.randrange(120)] = f"e{rng.randrange(10_000)}"
        rows.append((100 + i, " ".join(words)))
    rows += [(300 + i, " ".join(f"u{rng.randrange(10_000)}" for _ in range(rng.randrange(1, 200)))) for i in range(40)]
    rows += [(400, sentence(60).upper()), (401, sentence(60) + "!!!")]
    got = N.near_groups(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    want = brute(rows)
    assert {r["doc_id"]: r["group_id"] for r in got if r["doc_id"] is not None} == want
    assert all(r["kept"] == (r["doc_id"] == r["group_id"]) for r in got)


def test_no_rows_and_columns_stay(spark):
    assert N.near_groups(documents(spark, [(1, "x")]).where("false")).count() == 0
    docs = documents(spark, EDGE)
    kept = N.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, 1, 2, 3, 4, 7, 7, 9, 10]


def test_a_repeated_id_with_other_text_loses_no_link(spark):
    a, b, c = sentence(60), " ".join(f"q{i}" for i in range(60)), " ".join(f"r{i}" for i in range(60))
    rows = [(1, b), (7, a), (7, b + " tail"), (9, a + " tail"), (None, a + " more"), (None, None), (8, c), (7, c + " end"), (7, a)]
    want = {(1, b): (1, True), (7, b + " tail"): (1, False), (7, a): (7, True), (9, a + " tail"): (7, False), (None, a + " more"): (7, False), (None, None): (None, True), (7, c + " end"): (7, True), (8, c): (7, False)}
    for given in (rows, rows[::-1]):
        docs = documents(spark, given)
        got = N._grouped(docs, 0.8).join(docs.selectExpr("xxhash64(text) AS text_hash", "text").distinct(), "text_hash").collect()
        assert {(r["doc_id"], r["text"]): (r["group_id"], r["kept"]) for r in got} == want
        assert len({r["stays"] for r in got if r["group_id"] == 7}) == 2  # two groups with one number have keys of their own
        kept = sorted(((r["doc_id"], r["text"]) for r in N.drop_near_copies(docs).collect()), key=str)
        assert kept == sorted([k for k, v in want.items() if v[1]] + [(7, a)], key=str)


def test_components_that_do_not_settle_raise(spark):
    import pytest

    with pytest.raises(RuntimeError):
        N.components(spark.createDataFrame([(i, i + 1) for i in range(50)], "a long, b long"), rounds=1)


def test_strips_are_unit_elements_and_fractions_count():
    rng = np.random.default_rng(2)
    words = [f"w{i % 7}" for i in range(90)]
    shingles, counts = np.unique(N.elements(words[:9]), return_counts=True)
    assert (N.strips(shingles, counts.astype(float))[0] == N.elements(words[:9])).all()
    ids = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    w, v = rng.uniform(0.1, 3.5, 400), rng.uniform(0.1, 3.5, 400)
    (a, ca), (b, cb) = N.strips(ids, w), N.strips(ids, v)
    s = N.signatures([a, b], 4096, [ca, cb])
    assert abs((s[0] == s[1]).mean() - np.minimum(w, v).sum() / np.maximum(w, v).sum()) < 0.04


def test_recall_on_the_given_table(spark):
    """All pairs of sf0.01 at the threshold, by an index of elements, against the groups."""
    import os
    from collections import Counter, defaultdict

    at = "/root/testdata/sf0.01/documents.parquet"
    if not os.path.exists(at):
        import pytest

        pytest.skip("the given tables aren't here")
    docs = spark.read.parquet(at)
    sets = {r["doc_id"]: N.elements(N.words_of(r["text"])) for r in docs.collect()}
    having = defaultdict(list)
    for i, s in sets.items():
        for x in s.tolist():
            having[x].append(i)
    common = Counter((a, b) for ids in having.values() if len(ids) > 1 for k, a in enumerate(ids) for b in ids[k + 1 :])
    close = [p for p, n in common.items() if n / (len(sets[p[0]]) + len(sets[p[1]]) - n) >= 0.8]
    group = {r["doc_id"]: r["group_id"] for r in N.near_groups(docs).collect()}
    assert len(close) > 50 and all(group[a] == group[b] for a, b in close)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in close:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    assert group == {i: find(i) for i in sets}


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    for share in (0.2, 0.5, 0.9):
        n = int(3000 * share)
        b = np.r_[a[:n], rng.integers(0, 1 << 63, 3000 - n, dtype=np.uint64)]
        s = N.signatures([np.sort(a), np.sort(b)], 1024)
        assert abs((s[0] == s[1]).mean() - N.similarity(np.sort(a), np.sort(b))) < 0.06


def test_signatures_do_not_depend_on_company():
    sets = [N.elements(f"a{i} b c d e f g".split() * (i + 1)) for i in range(6)]
    every = N.signatures(sets)
    assert all((N.signatures([s])[0] == every[i]).all() for i, s in enumerate(sets))
    assert (every != 0).all()


def test_elements_count_repeats():
    assert len(N.elements("a b c".split())) == 1
    assert len(N.elements([])) == 0
    twice = N.elements("a b c d e a b c d e".split())
    assert len(twice) == 6 and len(np.unique(twice)) == 6


def test_threshold_is_kept_exactly(spark):
    """Pairs just above and just below: 100 words, edits at the end cost single shingles."""
    base = [f"k{i}" for i in range(104)]
    near = base[:-10] + [f"x{i}" for i in range(10)]  # 90 of 110 shingles
    far = base[:-15] + [f"y{i}" for i in range(15)]  # 85 of 115
    rows = [(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(far))]
    got = {r["doc_id"]: r["group_id"] for r in N.near_groups(documents(spark, rows)).collect()}
    assert got == brute(rows) == {1: 1, 2: 1, 3: 3}


def test_star_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)]
    got = {r["id"]: r["root"] for r in N.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in root if find(x) != x}
