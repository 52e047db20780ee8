import random

import numpy as np
import pytest

from sparrowhawk.llm import decontamination as D

from .helpers import EDGE, documents, sentence


def distance(pattern, text):
    """Least edits of pattern against any part of text."""
    t, place = np.array([ord(c) for c in text], np.int64), np.arange(len(text) + 1)
    row = np.zeros(len(text) + 1, np.int64)
    for i, p in enumerate(pattern, 1):
        new = np.minimum(row + 1, np.r_[i, row[:-1] + (t != ord(p))])
        row = np.minimum.accumulate(new - place) + place
    return int(row.min())


def brute(docs, items):
    out = set()
    for d, text in docs:
        t = D.normalised(text)
        for i, item in items:
            x = D.normalised(item)
            if i is None or not x:
                continue
            if len(x) < D.MIN_ITEM:
                places = [k for k in range(len(t)) if t.startswith(x, k)]
                word = lambda k: 0 < k < len(t) and t[k - 1].isalnum() and t[k].isalnum()
                if any(not word(k) and not word(k + len(x)) for k in places):
                    out.add((d, i))
            elif any(distance(x[s:e], t) <= (e - s) // 10 for s, e in D.cut(len(x))):
                out.add((d, i))
    return out


def edited(rng, text, n):
    c = list(text)
    for _ in range(n):
        at, kind = rng.randrange(len(c)), rng.randrange(3)
        if kind == 0:
            c[at] = rng.choice("abcxyz ")
        elif kind == 1:
            c.insert(at, rng.choice("abcxyz"))
        else:
            del c[at]
    return "".join(c)


@pytest.fixture(scope="module")
def case():
    rng = random.Random(11)
    words = ["".join(rng.choice("aeioustrnl") for _ in range(rng.randrange(2, 8))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, prose(rng.randrange(8, 40))) for i in range(12)] + [(50, None), (51, "short"), (53, "Which Hat?"), (54, "which hat?"), (55, ""), (56, prose(60)[:24]), (57, prose(60)[:30]), (58, prose(60)[:31]), (59, prose(60)[:40]), (60, prose(60)[:47]), (None, prose(30)), (52, "日本語のテスト文章はここにあります、とても長い文章です。もう一度、とても長い文章です。")]
    docs = list(EDGE)
    for n in range(60):
        i, item = rng.choice(items[:12])
        part = item[: rng.choice([len(item), 90, 60])]
        docs.append((100 + n, prose(rng.randrange(0, 30)) + " " + edited(rng, part, rng.randrange(0, 14)).upper() + "\n" + prose(rng.randrange(0, 30))))
    docs += [(200, "前 " + items[-1][1] + " 後"), (201, items[0][1]), (202, items[1][1].replace(" ", "\n\t "))]
    docs += [(300 + n, prose(120)) for n in range(20)]
    docs += [(400, "in short, yes"), (401, "shortly after"), (402, "WHICH  HAT? none"), (403, "which hat ? none"), (404, "which hat?ss"), (405, "xwhich hat?")]
    for n in range(80):  # short items with as many edits as their tenth, and some more
        i, item = rng.choice([x for x in items if x[0] in (56, 57, 58, 59, 60)])
        docs.append((500 + n, f"{prose(6)} {edited(rng, item, rng.randrange(0, len(item) // 10 + 2))} {prose(6)}"))
    return docs, items


def test_equal_to_brute_force(spark, case):
    docs, items = case
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = D.leaks(documents(spark, docs), bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == brute(docs, items)
    assert all(0 < r["matched"] <= r["windows"] and r["start"] < r["end"] for r in got)
    blocks = D.leaks(documents(spark, docs), bench, block_chars=200).collect()
    assert sorted(map(tuple, blocks), key=str) == sorted(map(tuple, got), key=str)


def test_rows_of_one_id_are_told_by_text(spark):
    item = sentence(30)
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = [(7, "clean words"), (7, f"so {item} there"), (None, item), (None, "clean"), (8, item)]
    for given in (rows, rows[::-1]):
        kept = D.drop_leaked(documents(spark, given), bench).collect()
        assert sorted(((r["doc_id"], r["text"]) for r in kept), key=str) == sorted([(7, "clean words"), (None, "clean")], key=str)


def test_every_budget_leaves_a_common_qgram():
    assert all(n - D.Q + 1 - D.Q * int(D.BUDGET * n) >= 1 for n in range(D.MIN_ITEM, D.WINDOW + 1))


def test_drop_keeps_clean_documents(spark, case):
    docs, items = case
    bad = {d for d, _ in brute(docs, items)}
    df = documents(spark, docs)
    kept = D.drop_leaked(df, spark.createDataFrame(items, "item_id long, text string"))
    assert kept.columns == df.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(d) for d, _ in docs if d not in bad)


def test_empty_tables(spark):
    docs, bench = documents(spark, [(1, sentence(30))]), spark.createDataFrame([(1, sentence(30))], "item_id long, text string")
    assert D.leaks(docs.where("false"), bench).count() == 0
    assert D.leaks(docs, bench.where("false")).count() == 0
    assert D.leaks(docs, bench).count() == 1


def test_part_passages_at_any_offset(spark):
    """Verbatim stretches of 55 characters and more, wherever they start; the expectation doesn't use cut()."""
    rng = random.Random(5)
    words = ["".join(rng.choice("aeioustrnlmdp") for _ in range(rng.randrange(2, 9))) for _ in range(3000)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, D.normalised(prose(rng.randrange(12, 60)))) for i in range(30)]
    docs, want = [], set()
    for n in range(200):
        i, item = rng.choice([x for x in items if len(x[1]) >= 60])
        size = rng.randrange(55, min(len(item), 115) + 1)
        at = rng.randrange(len(item) - size + 1)
        docs.append((n, f"{prose(20)} zq{item[at : at + size]}zq {prose(20)}"))
        want.add((n, i))
    docs += [(1000 + n, prose(200)) for n in range(50)]
    got = D.leaks(documents(spark, docs, extra=False), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want
