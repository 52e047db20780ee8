"""The registered queries of this subpackage and, where SQL can express them, their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


#: The key of the query over invented tables; real ones are secrets that are given to mask.
QUERY_KEY = b"for invented tables only"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dedup import near_groups

    return near_groups(_table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import identify

    return identify(_table(spark, sf_dir, "documents"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_groups

    return exact_groups(_table(spark, sf_dir, "documents"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import assign

    return assign(_table(spark, sf_dir, "documents"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import judge, thin_list

    pages = _table(spark, sf_dir, "pages")
    return judge(pages, thin_list(pages))


def op5_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii_pseudonyms import mask

    return mask(_table(spark, sf_dir, "documents"), QUERY_KEY)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import round_trip

    return round_trip(_table(spark, sf_dir, "pages"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import pack

    return pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secret_scan import scan

    return scan(_table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import leaks

    return leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_near_dedup": op1_near_dedup,
    "op2_language_id": op2_language_id,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_sharding": op4_sharding,
    "op5_pii_pseudonyms": op5_pii_pseudonyms,
    "op6_url_filter": op6_url_filter,
    "op7_warc": op7_warc,
    "op8_packing": op8_packing,
    "op9_secret_scan": op9_secret_scan,
    "op10_decontamination": op10_decontamination,
}


def _oracles() -> dict[str, str]:
    from . import sharding, url_filter

    return {
        "op3_exact_dedup": r"""
WITH n AS (SELECT doc_id, coalesce(text, '') t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') k FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY length(t) DESC, doc_id) i, count(*) OVER (PARTITION BY k) c,
  first_value(doc_id) OVER (PARTITION BY k ORDER BY length(t) DESC, doc_id) f FROM n)
SELECT doc_id, f AS keep_id, c::BIGINT AS group_size, doc_id = f AS kept, sha256(k) AS text_sha256 FROM r""",
        "op4_sharding": sharding.oracle_sql(),
        "op6_url_filter": url_filter.ORACLE_SQL,
        "op7_warc": """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) h FROM pages),
d AS (SELECT page_id, octet_length(h) n, sha256(h) x FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY x) m FROM d)
SELECT page_id, n::BIGINT AS payload_bytes, x AS payload_digest, CASE WHEN n >= 100 AND page_id > m THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND page_id > m THEN m END AS refers_to FROM f""",
    }


ORACLES = _oracles()
