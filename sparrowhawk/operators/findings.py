"""The algebra of findings: union, suppression, supersession, deduplication, grading, ranking."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import fingerprint, glob_to_regex, matches
from ..schema import SEVERITIES, WEIGHTS, choose, confidence_rank, severity_rank

KEY = ["file", "line"]
#: A data-flow finding supersedes its structural counterpart on the same line.
TAINT_TO_AST = {
    "taint.command-injection": "ast.command-injection",
    "taint.sql-injection": "ast.sql-injection",
    "taint.code-injection": "ast.eval-dynamic",
    "taint.path-traversal": "ast.path-traversal",
    "taint.ssrf": "ast.ssrf",
}
GENERIC = "secret.generic-credential"
#: Documentation paths and placeholders of secrets.
DOCS = r"(?:\.md$|\.txt$|README|CHANGELOG|CONTRIBUTING|LICENSE)"
PLACEHOLDER_LINE = r"(?:your[_-]?(?:api[_-]?key|token|secret)|placeholder|changeme|todo|fixme|xxx+|replace[_-]?me|insert[_-]?key|redacted|redact)"


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def with_fingerprint(findings: DataFrame) -> DataFrame:
    return findings.withColumn("fingerprint", fingerprint(F.col("rule_id"), F.col("file"), F.col("snippet")))


# -- suppression ---------------------------------------------------------------------------------------

def directives(lines: DataFrame, name: str = "sparrowhawk") -> DataFrame:
    """file, line (the target), rule (``*``: every rule), reason of suppression comments.

    ``<name>-ignore-line [rules]``, ``<name>-ignore-next-line [rules]`` (rules by space or
    comma, brackets may stand around them), ``<name>-ignore[rule]: reason`` and
    ``<name>-ignore-next[rule]: reason``, after ``//``, ``#``, ``/*`` or ``*``.
    """
    start = rf"(?i)(?://|#|/\*|\*)\s*{name}-ignore"
    t = F.col("text")
    by_rule, by_line = start + r"(-next)?\[([^\]]+)\]\s*:?\s*(.*)", start + r"(-next)?-line(?![A-Za-z0-9_])([^*\n]*)"
    new = lines.where(t.rlike(by_rule)).select(
        "file", (F.col("line") + F.when(F.regexp_extract(t, by_rule, 1) != "", 1).otherwise(0)).alias("line"), F.trim(F.regexp_extract(t, by_rule, 2)).alias("rule"), F.trim(F.regexp_extract(t, by_rule, 3)).alias("reason")
    )
    listed = F.trim(F.regexp_replace(F.trim(F.regexp_extract(t, by_line, 2)), r"^\[|\]$", ""))
    rules = F.when(listed == "", F.array(F.lit("*"))).otherwise(F.filter(F.split(listed, r"[\s,]+"), lambda x: x != ""))
    old = lines.where(t.rlike(by_line) & ~t.rlike(by_rule)).select(
        "file", (F.col("line") + F.when(F.regexp_extract(t, by_line, 1) != "", 1).otherwise(0)).alias("line"), F.explode(rules).alias("rule"), F.lit(None).cast("string").alias("reason")
    )
    return new.unionByName(old)


def suppress_inline(findings: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, suppressed) by directives (file, line, rule)."""
    d = found.groupBy(*KEY).agg(F.collect_set("rule").alias("_rules"))
    hit = F.coalesce(F.array_contains("_rules", "*") | F.array_contains(F.col("_rules"), F.col("rule_id")), F.lit(False))
    joined = findings.join(d, KEY, "left")
    return joined.where(~hit).drop("_rules"), joined.where(hit).drop("_rules")


def suppress_docs(findings: DataFrame, line_text: str | None = None) -> DataFrame:
    """Without findings in documentation, but for secrets; and without secrets on lines (line_text) of placeholders."""
    secret = F.col("rule_id").startswith("secret.")
    keep = ~matches(F.col("file"), DOCS) | secret
    if line_text:
        keep = keep & ~(secret & matches(F.coalesce(F.col(line_text), F.lit("")), PLACEHOLDER_LINE))
    return findings.where(keep)


def config_ignore(findings: DataFrame, rules=(), paths=(), pairs=()) -> DataFrame:
    """Without ignored rules, path globs, and pairs of rule and path (a pair's path is a glob or a part of the path)."""
    f, r = F.col("file"), F.col("rule_id")
    gone = r.isin(*rules) if rules else F.lit(False)
    for g in paths:
        gone = gone | f.rlike(glob_to_regex(g))
    for pair in pairs:
        rule, path = pair.get("rule"), pair.get("path")
        gone = gone | ((r == rule if rule else F.lit(True)) & ((f.rlike(glob_to_regex(path)) | f.contains(path)) if path else F.lit(True)))
    return findings.where(~gone)


def override_severity(findings: DataFrame, overrides: dict[str, str]) -> DataFrame:
    good = {k: v for k, v in overrides.items() if v in SEVERITIES}
    return findings.withColumn("severity", F.coalesce(choose(F.col("rule_id"), good), F.col("severity"))) if good else findings


def without_preset(findings: DataFrame, prefixes: list[str]) -> DataFrame:
    """Without the rules that a framework's preset leaves out, by prefix."""
    gone = reduce(lambda a, p: a | F.col("rule_id").startswith(p), prefixes, F.lit(False))
    return findings.where(~gone)


def min_confidence(findings: DataFrame, level: str = "medium") -> DataFrame:
    return findings.where(confidence_rank(F.col("confidence")) >= confidence_rank(F.lit(level)))


def only(findings: DataFrame, prefix: str) -> DataFrame:
    return findings.where(F.col("rule_id").startswith(prefix))


def on_lines(findings: DataFrame, added: DataFrame) -> DataFrame:
    """Only findings on the given lines (file, line), such as those that a diff adds."""
    return findings.join(added.select(*KEY).distinct(), KEY, "left_semi")


def hotspots(findings: DataFrame, rules: str, paths: str) -> DataFrame:
    """Distinct files with rules or paths of these patterns."""
    return findings.where(matches(F.col("rule_id"), rules) | matches(F.col("file"), paths)).select("file").distinct()


# -- supersession and deduplication ----------------------------------------------------------------------

def supersede(findings: DataFrame) -> DataFrame:
    """Without generic credentials on lines that have anything more specific, and structural findings that data flow confirms."""
    rule = F.col("rule_id")
    line = Window.partitionBy(*KEY)
    flowed = F.collect_set(choose(rule, TAINT_TO_AST)).over(line)
    specific = F.max((rule != GENERIC).cast("int")).over(line)
    marked = findings.withColumns({"_flowed": flowed, "_specific": specific})
    gone = ((rule == GENERIC) & (F.col("_specific") == 1)) | F.array_contains(F.col("_flowed"), rule)
    return marked.where(~gone).drop("_flowed", "_specific")


def first_of_each(findings: DataFrame, key: list[str], order: list) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*key).orderBy(*order)
    return findings.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def dedupe(findings: DataFrame, rank: str = "pass_rank") -> DataFrame:
    """One finding of each rule, file, line and column: that of the first pass (column rank, if it is there), then the most severe and sure."""
    order = ([rank] if rank in findings.columns else []) + [severity_rank(F.col("severity")), F.desc(confidence_rank(F.col("confidence"))), "snippet"]
    return first_of_each(findings, ["rule_id", "file", "line", "column"], order)


def dedupe_history(findings: DataFrame) -> DataFrame:
    """One finding of each rule, file and first twelve characters of the match."""
    return findings.withColumn("_m", F.left("match", F.lit(12))).dropDuplicates(["rule_id", "file", "_m"]).drop("_m")


def dedupe_blobs(findings: DataFrame) -> DataFrame:
    """One finding of each rule, file, line and match over all versions of a history, the least sha's; nulls are values like others."""
    return first_of_each(findings, ["rule_id", "file", "line", "match"], ["sha"])


def ranked(findings: DataFrame) -> DataFrame:
    """In the order of reports: severity, file, line, column, rule."""
    return findings.orderBy(severity_rank(F.col("severity")), "file", "line", "column", "rule_id")


# -- grades and totals --------------------------------------------------------------------------------------

def effective_severity(severity: Column, confidence: Column) -> Column:
    """A low-confidence finding counts one tier lower; a low one then doesn't count."""
    lower = choose(severity, dict(zip(SEVERITIES, SEVERITIES[1:])))
    return F.when(confidence == "low", lower).otherwise(severity)


def severity_counts(prefix: str = "") -> list[Column]:
    return [F.count_if(F.col("severity") == s).alias(f"{prefix}{s}") for s in SEVERITIES]


def grade_of(critical: Column, high: Column, medium: Column, low: Column) -> Column:
    return (
        F.when(critical > 0, "F").when(high >= 3, "D").when(high > 0, "C").when(medium >= 3, "C").when((medium > 0) | (low > 0), "B").otherwise("A")
    )


def grade(findings: DataFrame, by: list[str] = ()) -> DataFrame:
    """Counts by severity and the grade, by effective severity; dense, also for no findings."""
    e = effective_severity(F.col("severity"), F.col("confidence"))
    own = [F.count_if(e == s).alias(f"_{s}") for s in SEVERITIES]
    out = findings.groupBy(*by).agg(*severity_counts(), *own)
    return out.select(*by, *SEVERITIES, grade_of(*[F.col(f"_{s}") for s in SEVERITIES]).alias("grade"))


def agent_grade(findings: DataFrame, by: list[str] = ()) -> DataFrame:
    """The grade of an agent's setup: as they are, and low ones don't count."""
    c = {s: F.count_if(F.col("severity") == s) for s in SEVERITIES}
    g = F.when(c["critical"] > 0, "F").when(c["high"] >= 3, "D").when(c["high"] > 0, "C").when(c["medium"] > 0, "B").otherwise("A")
    return findings.groupBy(*by).agg(g.alias("grade"))


def category(rule_id: Column) -> Column:
    return F.split_part(rule_id, F.lit("."), F.lit(1))


def by_category(findings: DataFrame) -> DataFrame:
    return findings.groupBy(category(F.col("rule_id")).alias("category")).agg(F.count("*").alias("n"))


def top_files(findings: DataFrame, n: int = 10) -> DataFrame:
    return findings.groupBy("file").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "file").limit(n)


def weighted(counts: dict[str, Column]) -> Column:
    return sum((counts[s] * w for s, w in WEIGHTS.items()), F.lit(0))


def severity_matrix(findings: DataFrame) -> DataFrame:
    """category by severity with totals, by weight."""
    out = findings.groupBy(category(F.col("rule_id")).alias("category")).pivot("severity", SEVERITIES).count().fillna(0, SEVERITIES)
    total = sum((F.col(s) for s in SEVERITIES), F.lit(0))
    return out.withColumns({"total": total, "weight": weighted({s: F.col(s) for s in SEVERITIES})})


def risk_score(findings: DataFrame, files: DataFrame) -> DataFrame:
    """score, percent and level of all findings against the number of files scanned."""
    score = F.sum(F.coalesce(choose(F.col("severity"), WEIGHTS), F.lit(0)))
    a = findings.agg(F.coalesce(score, F.lit(0)).cast("long").alias("score"))
    b = files.agg(F.count("*").alias("files"))
    share = F.floor(F.col("score") / (F.greatest("files", F.lit(1)) * 10) * 100 + 0.5)
    percent = F.least(F.lit(100), share).cast("int")
    level = F.when(percent == 0, "NONE").when(percent < 10, "LOW").when(percent < 30, "MEDIUM").when(percent < 60, "HIGH").otherwise("CRITICAL")
    return a.crossJoin(b).select("score", "files", percent.alias("percent"), level.alias("level"))


def top_risks(findings: DataFrame, n: int = 5) -> DataFrame:
    return ranked(findings).limit(n)


def gate(findings: DataFrame, fail_on: str) -> DataFrame:
    """worst severity and whether it reaches fail_on."""
    worst = F.min(severity_rank(F.col("severity")))
    name = F.element_at(F.array(*map(F.lit, SEVERITIES)), worst + 1)
    return findings.agg(F.when(worst.isNotNull(), name).alias("worst"), F.coalesce(worst <= SEVERITIES.index(fail_on), F.lit(False)).alias("failed"))


def priorities(findings: DataFrame, by: list[str]) -> DataFrame:
    """A running number by severity within each group, as in a plan of fixes."""
    w = Window.partitionBy(*by).orderBy(severity_rank(F.col("severity")), "file", "line", "column", "rule_id")
    return findings.withColumn("priority", F.row_number().over(w))


def precision_recall(scored: DataFrame, category: str) -> DataFrame:
    """tp, fp, fn, precision, recall, f1 of boolean columns truth and predicted, by category and over all (category null)."""
    t, p = F.col("truth"), F.col("predicted")
    out = scored.rollup(category).agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    out = out.withColumns({"precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn"))})
    return out.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
