import hashlib
import random
from collections import defaultdict

import pytest

from sparrowhawk.llm import warc as W


def pages(spark, rows):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for name in ("digest", "key", "first", "n", "d"):
        df = df.withColumn(name, F.lit("clash"))
    return df


def brute(rows):
    least = defaultdict(list)
    for i, _, h in rows:
        if i is not None:
            least[(h or "").encode()].append(i)
    out = []
    for i, _, h in rows:
        p = (h or "").encode()
        revisit = len(p) >= 100 and least[p] and i != min(least[p])
        out.append((i, len(p), hashlib.sha256(p).hexdigest(), "revisit" if revisit else "response", min(least[p]) if revisit else None))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    out = [(i, f"http://h{rng.randrange(6)}.Example.com/p{i % 50}?q={i}#f", f"<p>{i % 40}</p>" * rng.choice([1, 30, 3000])) for i in range(300)]
    return out + [(900, None, None), (901, "no scheme", ""), (902, "http://x.org/a\r\nb\tc", "é☃" * 60), (903, "http://x.org/", "\r\n\r\nWARC/1.1" * 20), (904, "http://x.org/", "y"), (905, "http://z.org", None)]


def test_round_trip(spark, rows):
    got = W.round_trip(pages(spark, rows))
    assert got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_look_up_by_the_two_levels(spark, rows):
    index = W.CaptureIndex(W.write_archives(pages(spark, rows), block=8))
    by_key = defaultdict(set)
    for i, url, _ in rows:
        by_key[W.surt_key(url)].add(i)
    for i, url, h in rows[::17] + rows[-6:]:
        found = index.lookup(url)
        assert {f["page_id"] for f in found} == by_key[W.surt_key(url)]
        mine = next(f for f in found if f["page_id"] == i)
        assert mine["payload"] in (None, (h or "").encode())
    assert index.lookup("http://not.there/") == []


def test_keys_agree(spark, rows):
    df = spark.createDataFrame([(u,) for _, u, _ in rows] + [("HTTP://A.B.c/x?y#z",), ("//h/p",)], "url string")
    assert all(r["k"] == W.surt_key(r["url"]) for r in df.select("url", W.surt(df["url"]).alias("k")).collect())


def test_null_and_repeated_pages(spark):
    """One response for a payload, whatever repeats; ids of records don't repeat."""
    long, none = "z" * 200, "y" * 200
    rows = [(None, "http://a/", long), (1, "http://b/", long), (1, "http://a/", long), (1, "http://a/", long), (2, "http://a/", long), (None, "http://n/", none), (None, "http://n/", none), (None, None, none), (3, "http://a/", "x"), (3, "http://a/", "x")]
    for given in (rows, rows[::-1]):
        archives = W.write_archives(pages(spark, given))
        got = sorted(((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in W.read_archives(archives).collect()), key=str)
        assert got == sorted(
            [(1, 200, "response", None), (1, 200, "revisit", 1), (1, 200, "revisit", 1), (2, 200, "revisit", 1), (None, 200, "revisit", 1), (None, 200, "response", None), (None, 200, "revisit", None), (None, 200, "revisit", None)]
            + [(3, 1, "response", None)] * 2,
            key=str,
        )
        index = W.CaptureIndex(archives)
        found = [f for u in ("http://a/", "http://b/", "http://n/", None) for f in index.lookup(u)]
        assert len(found) == len({f["id"] for f in found}) == len(rows)


def test_a_directory_out_of_order_is_noticed(spark, tmp_path):
    rows = [(i, f"http://h{i % 9}.org/{i:03d}", f"{i}") for i in range(60)]
    paths = [r["path"] for r in W.write_archives(pages(spark, rows), folder=f"file://{tmp_path}/w", block=4).collect()]
    path = max(paths, key=lambda p: len(W.Archive(p).entries))
    name = path.removeprefix("file://") + ".idx"
    lines = open(name).read().split("\n")
    with open(name, "w") as out:
        out.write("\n".join(lines[::-1]))
    batch = W.pa.RecordBatch.from_pydict({"path": [path]})
    with pytest.raises(ValueError):
        list(W._reader([batch]))


def test_broken_records_are_noticed():
    raw = W.record(1, "http://a/", b"payload", hashlib.sha256(b"payload").hexdigest())
    assert W.parse(raw)["payload"] == b"payload"
    with pytest.raises(ValueError):
        W.parse(raw.replace(b"payload", b"pay1oad"))
    with pytest.raises(ValueError):
        W.parse(raw[:-2])


def test_empty(spark):
    assert W.round_trip(pages(spark, [(1, "u", "h")]).where("false")).count() == 0
