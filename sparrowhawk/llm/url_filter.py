"""URL verdicts: prefix rules, then a list by a blocked Bloom filter and an exact hash join.

A rule fits a url of its host or a subdomain whose path starts with the rule's path; the
longest rule wins. Where no rule fits, a url is blocked if its canonical form is listed.
The list is hashed into a blocked Bloom filter: a key sets eight bits in one block of 256,
kept as four 64-bit words. Pages are probed first; only possible hits keep their key for the
exact join with the list, which removes the filter's false positives. The list is a written
table and pages are read once more beside it. Everything is DataFrame functions. The filter is broadcast if its blocks, counted from the list, are few enough
(BROADCAST_BLOCKS), and else joined by block number.

Cases: host and path of a null url, or one without ``://``, are empty: no rule fits, it is
never listed, verdict allow. Repeated rows each get their verdict. An empty list blocks
nothing. Other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import written

#: (verdict, host, path prefix)
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
#: Bits of the filter for each listed key; the blocks of 256 bits that are broadcast at most (44 bytes each).
BITS_PER_KEY, BROADCAST_BLOCKS = 12, 1 << 20
#: Pages with fewer bytes of html are thin; the query's list holds their canonical urls.
THIN_BYTES = 1200
A_TO_Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (after the first ``://`` up to ``/?#``, A-Z lower-cased) and path (then up to ``?#``)."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.translate(host, A_TO_Z, A_TO_Z.lower()), F.lit("")), F.coalesce(path, F.lit(""))


def best_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits as struct(rule, verdict), else null. Length is that of host and path together."""
    out = None
    for verdict, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        value = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out if out is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def canonical(host: Column, path: Column) -> Column:
    """Host and path without the path's last slash; empty for no host."""
    return F.when(host == "", F.lit(None)).otherwise(F.concat(host, F.regexp_replace(path, "/$", "")))


def _words(key: Column) -> list[Column]:
    """The four words of a key's eight bits: two bits in each word, by two hashes."""
    h = [F.xxhash64(F.lit(i), key) for i in (11, 12)]
    out = []
    for w in range(4):
        bits = [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(x, 6 * w).bitwiseAND(63).cast("int")) for x in h]
        out.append(bits[0].bitwiseOR(bits[1]))
    return out


def _shifted(key: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(7), key), F.lit(n).cast("long"))


def bloom_blocks(listed: DataFrame, n: int) -> DataFrame:
    """block, w0 to w3 of the filter over the distinct column url_key of listed."""
    key = F.col("url_key")
    rows = listed.select(_shifted(key, n).alias("block"), *[w.alias(f"w{i}") for i, w in enumerate(_words(key))])
    return rows.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(4)])


def judge(pages: DataFrame, listed: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict of every page; listed: canonical urls in column url_key."""
    listed = written(listed.select("url_key").where(F.col("url_key").isNotNull()).distinct(), "listed")
    keys = listed.count()
    n = max(1, -(-keys * BITS_PER_KEY // 256))
    host, path = host_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rows = rows.withColumn("_rule", best_rule(F.col("host"), F.col("path"), rules))
    # Only urls that have a host and that no rule fits have a key to ask for.
    rows = rows.withColumn("_key", F.when(F.col("_rule").isNull(), canonical(F.col("host"), F.col("path"))))
    blocks = bloom_blocks(listed, n)
    # Rows without a key meet no block and no listed key; negative numbers deal them evenly where the joins shuffle.
    spread = -1 - F.pmod(F.xxhash64("page_id", "host", "path"), F.lit(1 << 20))
    probed = rows.withColumn("_block", F.when(F.col("_key").isNotNull(), _shifted(F.col("_key"), n)).otherwise(spread)).join(
        F.broadcast(blocks) if n <= BROADCAST_BLOCKS else blocks, F.col("_block") == F.col("block"), "left"
    )
    maybe = F.col("block").isNotNull()
    for i, w in enumerate(_words(F.col("_key"))):
        maybe = maybe & (F.col(f"w{i}").bitwiseAND(w) == w)
    # What the filter passes keeps its key and is joined exactly.
    passed = F.coalesce(maybe, F.lit(False))
    asked = probed.select("page_id", "host", "path", "_rule", F.when(passed, F.col("_key")).alias("_key"), F.when(passed, F.lit(0).cast("long")).otherwise(spread).alias("_part"))
    exact = asked.join(listed.withColumn("part", F.lit(0).cast("long")), (F.col("_key") == F.col("url_key")) & (F.col("_part") == F.col("part")), "left")
    verdict = F.coalesce(F.col("_rule.verdict"), F.when(F.col("url_key").isNull(), "allow").otherwise("block"))
    return exact.select("page_id", "host", "path", F.col("_rule.rule").alias("rule"), verdict.alias("verdict"))


def thin_list(pages: DataFrame, bytes_: int = THIN_BYTES) -> DataFrame:
    """url_key: canonical urls of the pages whose html has fewer bytes (null: none)."""
    host, path = host_path(F.col("url"))
    return pages.where(F.coalesce(F.octet_length("html"), F.lit(0)) < bytes_).select(canonical(host, path).alias("url_key"))


ORACLE_SQL = f"""
WITH rest AS (SELECT page_id, html, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END r FROM pages),
parts AS (SELECT page_id, html, translate(regexp_extract(r, '^([^/?#]*)', 1), '{A_TO_Z}', '{A_TO_Z.lower()}') AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
rules(verdict, h, p) AS (VALUES {', '.join(map(str, RULES))}),
listed AS (SELECT DISTINCT host || regexp_replace(path, '/$', '') u FROM parts WHERE host <> '' AND octet_length(encode(coalesce(html, ''))) < {THIN_BYTES}),
best AS (SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(verdict, length(h || p)) AS v
  FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(v, CASE WHEN host <> '' AND host || regexp_replace(path, '/$', '') IN (SELECT u FROM listed) THEN 'block' ELSE 'allow' END) AS verdict
FROM parts LEFT JOIN best USING (page_id)"""
