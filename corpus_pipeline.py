"""The corpus pipeline: five stages, each over all that its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result as
Parquet to the cluster's shared folder and reads it again as the next stage's docs. All but
the last return the columns of documents. Filtering stages tell rows by doc_id and text: a row
that bears the doc_id of a dropped one stays, and rows with a null doc_id are rows like others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparrowhawk.llm.common import discard, shared_path, working_area, written


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is accepted."""
    from sparrowhawk.llm.language_id import keep_identified

    return keep_identified(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with equal texts but for white space."""
    from sparrowhawk.llm.exact_dedup import drop_copies

    return drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    from sparrowhawk.llm.near_dedup import drop_near_copies

    return drop_near_copies(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark."""
    from sparrowhawk.llm.decontamination import drop_leaked

    return drop_leaked(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents left, packed into sequences; columns as op8_packing returns them."""
    import public_tokenizers

    from sparrowhawk.llm.packing import pack as packed

    return packed(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontaminate),
    ("packing", pack),
]

#: SQL cannot express the trained model or the tokenizer; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. A stage's working tables are deleted once its result is written, and so is the result before it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    last = None
    for name, stage in STAGES:
        at = shared_path(spark, f"pipeline-{name}")
        with working_area(spark, f"work-{name}"):
            docs = written(stage(spark, docs, sf_dir), name, at)
        if last is not None:
            discard(last)
        last = docs
    return docs
