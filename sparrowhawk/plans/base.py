"""Relations that the queries share, with the same as SQL for the oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import fingerprint, java, mask_snippet
from ..operators.lines import explode_lines

#: Rules for prose, in patterns that Java and RE2 read alike: id, severity, confidence, weakness, title, pattern.
RULES = [
    ("secret.token-assignment", "critical", "high", "CWE-798", "Token assigned in text", r"token = \"[0-9a-f]{16,}\""),
    ("secret.generic-credential", "critical", "low", "CWE-798", "Hardcoded credential", r"[a-z]+ = \"[^\"]{6,}\""),
    ("pii.email", "high", "medium", "CWE-359", "Mail address", r"[A-Za-z0-9_%+-][A-Za-z0-9._%+-]*@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"),
    ("pii.card-shaped", "high", "low", "CWE-359", "Card-shaped number", r"[0-9]{16}"),
    ("pii.phone", "medium", "medium", "CWE-359", "Phone number", r"\+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4}"),
    ("pii.ipv4", "low", "high", "CWE-200", "Network address", r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}"),
    ("legal.notice", "low", "low", "CWE-1104", "Licence line", r"All rights reserved"),
    ("style.shouting", "low", "medium", "CWE-710", "Shouted words", r"[A-Z]{4,}!!"),
]
#: Controls of frameworks by weakness.
CONTROLS = [
    ("SOC2", "CWE-798", "CC6.1"), ("SOC2", "CWE-798", "CC6.7"), ("SOC2", "CWE-200", "CC6.1"), ("SOC2", "CWE-200", "CC6.7"),
    ("PCI-DSS", "CWE-798", "6.5.2"), ("PCI-DSS", "CWE-798", "8.3.2"), ("PCI-DSS", "CWE-200", "3.2"), ("PCI-DSS", "CWE-200", "6.5.2"),
    ("GDPR", "CWE-359", "Art.32"), ("GDPR", "CWE-359", "Art.5"),
]


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def doc_files(spark, d) -> DataFrame:
    """documents as files."""
    t = table(spark, d, "documents")
    return t.select("doc_id", "source", F.concat("source", F.lit("/"), "doc_id", F.lit(".js")).alias("file"), F.col("text").alias("content"))


def doc_lines(spark, d) -> DataFrame:
    return explode_lines(doc_files(spark, d))


def apply_rules(lines: DataFrame, rules=RULES) -> DataFrame:
    """Findings of lines (file, line, text) by rules in DataFrame functions: one for each distinct match of a line."""
    t = F.col("text")

    def of(rule):
        i, s, c, w, n, p = rule
        found = F.array_distinct(F.regexp_extract_all(t, F.lit(java(p, False)), F.lit(0)))
        return F.transform(found, lambda m: F.struct(F.lit(i).alias("rule_id"), F.lit(s).alias("severity"), F.lit(c).alias("confidence"), F.lit(w).alias("cwe"), F.lit(n).alias("title"), m.alias("match")))

    each = [of(r) for r in rules]
    rows = lines.select("file", "line", "text", F.explode(F.concat(*each)).alias("f")).select("file", "line", "text", "f.*")
    rows = rows.withColumns({"column": F.instr(t, F.col("match")), "snippet": mask_snippet(t, F.col("match"))})
    return rows.withColumn("fingerprint", fingerprint(F.col("rule_id"), F.col("file"), F.col("snippet"))).drop("text", "match")


def doc_findings(spark, d) -> DataFrame:
    return apply_rules(doc_lines(spark, d))


FILES_SQL = "files AS (SELECT doc_id, source, source || '/' || doc_id || '.js' AS file, text AS content FROM documents)"
LINES_SQL = f"{FILES_SQL}, lines AS (SELECT file, unnest(l) AS text, unnest(range(1, len(l) + 1))::INT AS line FROM (SELECT file, string_split_regex(content, '\\r?\\n') AS l FROM files))"


def findings_sql(rules=RULES) -> str:
    """WITH's content up to the relation findings."""
    hits = " UNION ALL ".join(
        f"SELECT '{i}' AS rule_id, '{s}' AS severity, '{c}' AS confidence, '{w}' AS cwe, '{n}' AS title, file, line, text, unnest(list_distinct(regexp_extract_all(text, '{p}'))) AS m FROM lines" for i, s, c, w, n, p in rules
    )
    return f"""{LINES_SQL}, hits AS ({hits}),
shown AS (SELECT rule_id, severity, confidence, cwe, title, file, line, strpos(text, m)::INT AS "column", CASE WHEN length(m) >= 8 THEN replace(text, m, left(m, 4) || '****' || right(m, 2)) ELSE text END AS s FROM hits),
masked AS (SELECT * EXCLUDE (s), CASE WHEN length(s) > 160 THEN left(s, 157) || '...' ELSE s END AS snippet FROM shown),
findings AS (SELECT *, left(sha1(rule_id || ' ' || file || ' ' || regexp_replace(snippet, '^\\s+|\\s+$', '', 'g')), 16) AS fingerprint FROM masked)"""


FINDINGS_SQL = findings_sql()
RANK_SQL = "CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 9 END"
EFFECTIVE_SQL = "CASE WHEN confidence = 'low' THEN CASE severity WHEN 'critical' THEN 'high' WHEN 'high' THEN 'medium' WHEN 'medium' THEN 'low' END ELSE severity END"
COLUMNS = "rule_id, severity, confidence, cwe, title, file, line, \"column\", snippet, fingerprint"


def grade_sql(by: str = "") -> str:
    c = {s: f"count(*) FILTER (({EFFECTIVE_SQL}) = '{s}')" for s in ("critical", "high", "medium", "low")}
    own = ", ".join(f"count(*) FILTER (severity = '{s}') AS {s}" for s in c)
    g = f"CASE WHEN {c['critical']} > 0 THEN 'F' WHEN {c['high']} >= 3 THEN 'D' WHEN {c['high']} > 0 THEN 'C' WHEN {c['medium']} >= 3 THEN 'C' WHEN {c['medium']} > 0 OR {c['low']} > 0 THEN 'B' ELSE 'A' END"
    return f"SELECT {by + ', ' if by else ''}{own}, {g} AS grade FROM findings{' GROUP BY ' + by if by else ''}"
