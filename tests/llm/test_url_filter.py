from pyspark.sql import functions as F

from sparrowhawk.llm import url_filter as U

URLS = [
    None, "", "no scheme", "http://", "https://A.Example.com/en/x", "http://example.com/en/1", "http://www.example.com/en/1?q", "http://notexample.com/en/", "http://x.net/es/1", "http://net/fr/", "http://x.net/de/#y",
    "http://a.org/p/", "http://a.org/p?x=1", "http://b.org/q", "http://B.org/q#z", "ftp://u:p@c.org:21/r", "http://d.org", "http://d.org/", "x://y://z.org/w", "http://ÄÖ.org/é",
]


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
    path = rest[end:]
    for c in "?#":
        path = path.split(c)[0]
    return host, path


def brute(rows, listed):
    out = []
    for i, url in rows:
        host, path = split(url)
        fits = [(len(h + p), h + p, v) for v, h, p in U.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        if fits:
            _, rule, verdict = max(fits)
        else:
            key = host + (path[:-1] if path.endswith("/") else path)
            rule, verdict = None, "block" if host and key in listed else "allow"
        out.append((i, host, path, rule, verdict))
    return sorted(out, key=str)


def test_equal_to_brute_force(spark):
    rows = [(i, u) for i, u in enumerate(URLS)] + [(5, URLS[5]), (None, "http://a.org/p/")]
    rows += [(100 + i, f"http://h{i % 40}.org/p{i % 7}/") for i in range(300)]
    listed = {"a.org/p", "d.org", "c.org:21", "nothing.org"} | {f"h{i}.org/p{i % 7}" for i in range(0, 40, 3)}
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit(1)).withColumn("block", F.lit(2)).withColumn("url_key", F.lit(3))
    table = spark.createDataFrame([(x,) for x in listed] + [("d.org",), (None,)], "url_key string")
    got = U.judge(pages, table)
    assert got.columns == ["page_id", "host", "path", "rule", "verdict"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, listed)


def test_filter_is_joined_where_it_is_not_small(spark, monkeypatch):
    monkeypatch.setattr(U, "BROADCAST_BLOCKS", 0)
    pages = spark.createDataFrame([(i, f"http://h{i}.org/") for i in range(200)], "page_id long, url string")
    listed = spark.createDataFrame([(f"h{i}.org",) for i in range(0, 200, 2)], "url_key string")
    assert {r["page_id"] for r in U.judge(pages, listed).where("verdict = 'block'").collect()} == set(range(0, 200, 2))


def test_bloom_has_no_false_negatives_and_few_false_positives(spark):
    listed = spark.range(5000).select(F.concat(F.lit("l"), "id").alias("url_key"))
    n = 5000 * U.BITS_PER_KEY // 256
    blocks = U.bloom_blocks(listed, n)
    asked = listed.unionAll(spark.range(5000).select(F.concat(F.lit("m"), "id")))
    probe = asked.withColumn("block", U._shifted(F.col("url_key"), n)).join(blocks, "block", "left")
    ok = F.lit(True)
    for i, w in enumerate(U._words(F.col("url_key"))):
        ok = ok & (F.col(f"w{i}").bitwiseAND(w) == w)
    got = {r["k"]: r["count"] for r in probe.where(ok).groupBy(F.left("url_key", F.lit(1)).alias("k")).count().collect()}
    assert got["l"] == 5000 and got.get("m", 0) < 500


def test_empty(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    listed = spark.createDataFrame([], "url_key string")
    assert U.judge(pages, listed).count() == 0
    assert U.judge(spark.createDataFrame([(1, "http://q.org/")], "page_id long, url string"), listed).first()["verdict"] == "allow"
