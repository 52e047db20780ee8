import random
import zlib

import pytest

from sparrowhawk.llm import language_id as L

from .helpers import EDGE, documents

EN, DE = "the and of that with have this from they which one would there their what about".split(), "der die und das nicht ist ein eine mit auf für von sich auch werden wir haben".split()


def corpus(n, seed=2):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choice(EN if i % 2 else DE) for _ in range(rng.randrange(5, 60))), "en" if i % 2 else "de") for i in range(n)]


def test_held_out_accuracy_and_contract(spark):
    rows = corpus(400) + [(1000 + i, t, None) for i, t in EDGE if i] + [(None, "der die das", "de")]
    got = {r["doc_id"]: r for r in L.identify(documents(spark, rows)).collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items() if i is not None)
    held = [i for i, *_ in rows[:400] if got[i]["held_out"]]
    assert len(held) > 40 and all(got[i]["lang_pred"] == rows[i][2] for i in held)
    assert all(0 <= r["score"] <= 1 and r["lang_pred"] in ("en", "de", "und") for r in got.values())
    for i, text, _ in rows[400:]:
        if not any(c.isalpha() for c in text or ""):
            assert got[i]["lang_pred"] == "und" and not got[i]["accepted"]


def test_prediction_depends_on_text_only(spark):
    model = L.train([t for _, t, _ in corpus(200)], [x for *_, x in corpus(200)])
    a = L.identify(documents(spark, [(1, "the and of that", "de"), (2, "der die das und", None)]), model).collect()
    assert {r["doc_id"]: r["lang_pred"] for r in a} == {1: "en", 2: "de"}


def test_keep_identified(spark):
    model = L.train([t for _, t, _ in corpus(200)], [x for *_, x in corpus(200)])
    docs = documents(spark, [(1, "the and of that have"), (2, None), (3, "12 34 !!"), (None, "der die das nicht")])
    kept = L.keep_identified(docs, model)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {1, None}


def test_nothing_to_learn_from(spark):
    docs = documents(spark, [(1, "abc", None), (2, "def", None)])
    assert {r["lang_pred"] for r in L.identify(docs).collect()} == {"und"}
    assert L.identify(docs.where("false")).count() == 0


def test_training_is_deterministic_and_cache_is_harmless():
    rows = corpus(120)
    a, b = (L.train([t for _, t, _ in rows], [x for *_, x in rows]) for _ in range(2))
    assert (a.logits == b.logits).all() and a.temperature == b.temperature
    texts = [t for _, t, _ in corpus(50, seed=9)]
    one = [a.predict(t) for t in texts]
    a.cache.clear()
    assert [a.predict(t) for t in reversed(texts)][::-1] == one


FOREIGN = ["квартира находится рядом со станцией метро и парком", "qqq zzz", "xkcd vwzq jjkq zxqv", "hyvää huomenta kaikille ystäville täällä", "日本語のテスト文章はここにあります"]


@pytest.mark.parametrize("languages", [1, 2, 4])
def test_foreign_and_shuffled_texts_are_rejected(languages):
    words = [EN, DE, "le la les des est une dans pour que qui pas sur avec sont par mais".split(), "el los las una por con para como más pero sus esta entre cuando".split()]
    rng = random.Random(8)
    rows = [(" ".join(rng.choice(words[k]) for _ in range(rng.randrange(5, 60))), f"l{k}") for i in range(160) for k in range(languages)]
    model = L.train([t for t, _ in rows], [x for _, x in rows])
    assert all(not model.predict(t)[2] for t in FOREIGN)
    for t, y in rows:
        assert model.predict(t)[::2] == (y, True)
    mixed = [" ".join("".join(rng.sample(w, len(w))) for w in t.split()) for t, _ in rows if len(t.split()) >= 16]
    assert sum(model.predict(t)[2] for t in mixed) <= len(mixed) // 20


def test_given_texts_are_accepted_and_shuffled_ones_are_not(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    model = L.fit(docs)
    rows = [r["text"] for r in docs.collect() if len((r["text"] or "").split()) >= 32]
    rng = random.Random(4)
    assert all(model.predict(t)[2] for t in rows)
    mixed = [" ".join("".join(rng.sample(w, len(w))) for w in t.split()[:400]) for t in rows]
    assert sum(model.predict(t)[2] for t in mixed) <= len(mixed) // 50


def test_more_languages_than_allowed_raise(spark):
    docs = documents(spark, [(i, "some words", f"l{i}") for i in range(30)])
    with pytest.raises(ValueError):
        L.fit(docs, most_languages=10)
    assert len(L.fit(docs).languages) == len([i for i in range(30) if zlib.crc32(str(i).encode()) % 5])


def test_sample_is_bounded_and_does_not_depend_on_order(spark):
    rows = corpus(300) + [(None, "der die das", "de")] * 500
    a, b = (L.fit(documents(spark, r, extra=False).repartition(n), per_language=30) for r, n in ((rows, 1), (rows[::-1], 5)))
    assert (a.logits == b.logits).all() and a.familiar == b.familiar


def test_null_and_long_texts_do_not_thin_the_sample(spark):
    rows = corpus(200) + [(1000 + i, None, "de") for i in range(20_000)] + [(30_000 + i, "le la les " * 12_000, "fr") for i in range(8)]
    model = L.fit(documents(spark, rows, extra=False), per_language=40)
    assert sorted(model.languages) == ["de", "en", "fr"]
    assert model.predict("le la les")[0] == "fr"
