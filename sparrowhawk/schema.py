"""Schemas and dimensions: findings, severities, confidences."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

FINDING = T.StructType(
    [
        T.StructField("rule_id", T.StringType(), False),
        T.StructField("severity", T.StringType(), False),
        T.StructField("confidence", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("fix", T.StringType()),
        T.StructField("file", T.StringType()),
        T.StructField("line", T.IntegerType()),
        T.StructField("column", T.IntegerType()),
        T.StructField("snippet", T.StringType()),
        T.StructField("cwe", T.StringType()),
        T.StructField("fingerprint", T.StringType()),
    ]
)

SEVERITIES = ["critical", "high", "medium", "low"]
CONFIDENCES = ["low", "medium", "high"]
#: Points of a severity in weighted totals.
WEIGHTS = {"critical": 10, "high": 5, "medium": 2, "low": 1}


def choose(value: Column, mapping: dict, default=None) -> Column:
    """CASE value WHEN key THEN ... over a small mapping."""
    out = None
    for k, v in mapping.items():
        out = F.when(value == k, F.lit(v)) if out is None else out.when(value == k, F.lit(v))
    return out.otherwise(F.lit(default))


def severity_rank(severity: Column) -> Column:
    """0 (critical) to 3 (low); 9 for others."""
    return choose(severity, {s: i for i, s in enumerate(SEVERITIES)}, 9)


def confidence_rank(confidence: Column) -> Column:
    return choose(confidence, {s: i for i, s in enumerate(CONFIDENCES)}, 0)


def sql_case(value: str, mapping: dict, default="NULL") -> str:
    """The same as SQL text, for oracles."""
    q = lambda v: f"'{v}'" if isinstance(v, str) else str(v)
    return "CASE " + " ".join(f"WHEN {value} = {q(k)} THEN {q(v)}" for k, v in mapping.items()) + f" ELSE {default if default == 'NULL' else q(default)} END"
