"""Queries over findings: ranking, suppression, supersession, grades, totals, diffs, scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audit, diff
from ..operators import findings as ops
from ..operators.graph import cut
from ..schema import WEIGHTS
from .samples import PAIRS
from .base import COLUMNS, CONTROLS, EFFECTIVE_SQL, FINDINGS_SQL, RANK_SQL, RULES, apply_rules, doc_files, doc_findings, doc_lines, grade_sql, table

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def sql(body: str) -> str:
    return f"WITH {FINDINGS_SQL} {body}"


WEIGHT_SQL = "CASE severity " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in WEIGHTS.items()) + " ELSE 0 END"


@query("findings_report", sql(f"SELECT {COLUMNS}, {RANK_SQL} AS severity_rank FROM findings"))
def findings_report(spark, d):
    """All findings of the documents, in the order of reports."""
    from ..schema import severity_rank

    return ops.ranked(cut(doc_findings(spark, d))).withColumn("severity_rank", severity_rank(F.col("severity")))


@query("sev_counts", sql("SELECT file, " + ", ".join(f"count(*) FILTER (severity = '{s}') AS {s}" for s in WEIGHTS) + " FROM findings GROUP BY file"))
def sev_counts(spark, d):
    return doc_findings(spark, d).groupBy("file").agg(*ops.severity_counts())


@query("grade", sql(grade_sql("file")))
def grade(spark, d):
    return ops.grade(doc_findings(spark, d), ["file"])


@query("grade_overall", sql(grade_sql()))
def grade_overall(spark, d):
    return ops.grade(doc_findings(spark, d))


@query("agent_grade", sql("SELECT file, CASE WHEN bool_or(severity = 'critical') THEN 'F' WHEN count(*) FILTER (severity = 'high') >= 3 THEN 'D' WHEN bool_or(severity = 'high') THEN 'C' WHEN bool_or(severity = 'medium') THEN 'B' ELSE 'A' END AS grade FROM findings GROUP BY file"))
def agent_grade(spark, d):
    return ops.agent_grade(doc_findings(spark, d), ["file"])


@query("by_category", sql("SELECT split_part(rule_id, '.', 1) AS category, count(*) AS n FROM findings GROUP BY 1"))
def by_category(spark, d):
    return ops.by_category(doc_findings(spark, d))


@query("top_files", sql("SELECT file, count(*) AS n FROM findings GROUP BY file ORDER BY n DESC, file LIMIT 10"))
def top_files(spark, d):
    return ops.top_files(doc_findings(spark, d))


@query("severity_matrix", sql("SELECT *, critical + high + medium + low AS total, critical * 10 + high * 5 + medium * 2 + low AS weight FROM (SELECT split_part(rule_id, '.', 1) AS category, " + ", ".join(f"count(*) FILTER (severity = '{s}') AS {s}" for s in WEIGHTS) + " FROM findings GROUP BY 1)"))
def severity_matrix(spark, d):
    return ops.severity_matrix(doc_findings(spark, d))


@query("category_matrix", sql("SELECT split_part(rule_id, '.', 1) AS category, count(*) AS n FROM findings GROUP BY 1 ORDER BY n DESC, category LIMIT 12"))
def category_matrix(spark, d):
    return ops.by_category(doc_findings(spark, d)).orderBy(F.desc("n"), "category").limit(12)


@query(
    "risk_score",
    sql(
        f"""SELECT score, files, p AS percent, CASE WHEN p = 0 THEN 'NONE' WHEN p < 10 THEN 'LOW' WHEN p < 30 THEN 'MEDIUM' WHEN p < 60 THEN 'HIGH' ELSE 'CRITICAL' END AS level FROM
(SELECT score, files, least(100, floor(score / (greatest(files, 1) * 10) * 100 + 0.5))::INT AS p FROM (SELECT (SELECT coalesce(sum({WEIGHT_SQL}), 0) FROM findings)::BIGINT AS score, (SELECT count(*) FROM files) AS files))"""
    ),
)
def risk_score(spark, d):
    return ops.risk_score(doc_findings(spark, d), doc_files(spark, d))


@query(
    "scorecard",
    sql(f"SELECT g.*, score, autofixable FROM ({grade_sql()}) g, (SELECT sum({WEIGHT_SQL})::BIGINT AS score, count(*) FILTER (rule_id LIKE 'secret.%' OR rule_id LIKE 'pii.%') AS autofixable FROM findings)"),
)
def scorecard(spark, d):
    f = doc_findings(spark, d)
    fixable = F.col("rule_id").startswith("secret.") | F.col("rule_id").startswith("pii.")
    from ..schema import choose

    totals = f.agg(F.sum(F.coalesce(choose(F.col("severity"), WEIGHTS), F.lit(0))).cast("long").alias("score"), F.count_if(fixable).alias("autofixable"))
    return ops.grade(f).crossJoin(totals)  # one row each


@query("top_risks", sql(f'SELECT rule_id, file, line, "column" FROM findings ORDER BY {RANK_SQL}, file, line, "column", rule_id LIMIT 10'))
def top_risks(spark, d):
    return ops.top_risks(doc_findings(spark, d), 10).select("rule_id", "file", "line", "column")


@query("risky_files", sql(f'SELECT file FROM (SELECT file, min(p) AS p FROM (SELECT file, row_number() OVER (ORDER BY {RANK_SQL}, file, line, "column", rule_id) AS p FROM findings) GROUP BY file) ORDER BY p LIMIT 10'))
def risky_files(spark, d):
    """The first ten files in the order of reports: the least position of each, without a global window."""
    from ..schema import severity_rank

    f = doc_findings(spark, d).withColumn("at", F.struct(severity_rank(F.col("severity")), "file", "line", "column", "rule_id"))
    return f.groupBy("file").agg(F.min("at").alias("at")).orderBy("at").limit(10).select("file")


@query("gate", sql(f"SELECT ['critical', 'high', 'medium', 'low'][w + 1] AS worst, w <= 1 AS failed FROM (SELECT min({RANK_SQL}) AS w FROM findings)"))
def gate(spark, d):
    return ops.gate(doc_findings(spark, d), "high")


@query("priorities", sql(f'SELECT rule_id, file, line, "column", row_number() OVER (PARTITION BY file ORDER BY {RANK_SQL}, file, line, "column", rule_id)::INT AS priority FROM findings'))
def priorities(spark, d):
    return ops.priorities(doc_findings(spark, d), ["file"]).select("rule_id", "file", "line", "column", "priority")


@query("min_conf", sql(f"SELECT {COLUMNS} FROM findings WHERE confidence IN ('medium', 'high')"))
def min_conf(spark, d):
    return ops.min_confidence(doc_findings(spark, d))


@query("effective_severity", sql(f"SELECT severity, confidence, {EFFECTIVE_SQL} AS effective, count(*) AS n FROM findings GROUP BY ALL"))
def effective_severity(spark, d):
    f = doc_findings(spark, d).withColumn("effective", ops.effective_severity(F.col("severity"), F.col("confidence")))
    return f.groupBy("severity", "confidence", "effective").agg(F.count("*").alias("n"))


@query("secrets_only", sql(f"SELECT {COLUMNS} FROM findings WHERE rule_id LIKE 'secret.%'"))
def secrets_only(spark, d):
    return ops.only(doc_findings(spark, d), "secret.")


@query("supersede", sql(f"SELECT {COLUMNS} FROM (SELECT *, bool_or(rule_id <> 'secret.generic-credential') OVER (PARTITION BY file, line) AS specific FROM findings) WHERE rule_id <> 'secret.generic-credential' OR NOT specific"))
def supersede(spark, d):
    return ops.supersede(doc_findings(spark, d))


@query("suppress_inline", sql("SELECT rule_id, file, line, \"column\", n > 0 AS suppressed FROM (SELECT rule_id, f.file, f.line, \"column\", count(l.line) AS n FROM findings f LEFT JOIN lines l ON l.file = f.file AND l.line = f.line - 1 AND contains(l.text, '###') GROUP BY ALL)"))
def suppress_inline(spark, d):
    """Lines that hold ### stand for a comment that suppresses all of the next line."""
    rows = doc_lines(spark, d)
    made = rows.where(F.col("text").contains("###")).withColumn("text", F.lit("// sparrowhawk-ignore-next-line"))
    kept, gone = ops.suppress_inline(doc_findings(spark, d), ops.directives(made))
    out = kept.withColumn("suppressed", F.lit(False)).unionByName(gone.withColumn("suppressed", F.lit(True)))
    return out.select("rule_id", "file", "line", "column", "suppressed")


@query("suppress_docs", sql(f"SELECT {COLUMNS} FROM findings WHERE file NOT LIKE 'src1/%' OR rule_id LIKE 'secret.%'"))
def suppress_docs(spark, d):
    """Files of one source stand for documentation."""
    f = doc_findings(spark, d).withColumn("_file", F.col("file")).withColumn("file", F.when(F.col("file").startswith("src1/"), F.concat("file", F.lit(".md"))).otherwise(F.col("file")))
    return ops.suppress_docs(f).withColumn("file", F.col("_file")).drop("_file")


@query("config_ignore", sql(f"SELECT {COLUMNS} FROM findings WHERE rule_id <> 'legal.notice' AND file NOT LIKE 'src2/%' AND NOT (rule_id = 'pii.email' AND contains(file, 'src3'))"))
def config_ignore(spark, d):
    return ops.config_ignore(doc_findings(spark, d), rules=["legal.notice"], paths=["src2/*"], pairs=[{"rule": "pii.email", "path": "src3"}])


@query("sev_override", sql("SELECT rule_id, file, line, CASE rule_id WHEN 'pii.email' THEN 'low' WHEN 'legal.notice' THEN 'high' ELSE severity END AS severity FROM findings"))
def sev_override(spark, d):
    f = ops.override_severity(doc_findings(spark, d), {"pii.email": "low", "legal.notice": "high", "pii.phone": "unheard-of"})
    return f.select("rule_id", "file", "line", "severity")


@query("preset", sql(f"SELECT {COLUMNS} FROM findings WHERE rule_id NOT LIKE 'style.%' AND rule_id NOT LIKE 'legal.%'"))
def preset(spark, d):
    return ops.without_preset(doc_findings(spark, d), ["style.", "legal."])


@query("pr_scan", sql(f"SELECT {COLUMNS} FROM findings WHERE line % 2 = 0"))
def pr_scan(spark, d):
    """Even lines stand for those that a diff adds."""
    return ops.on_lines(doc_findings(spark, d), doc_lines(spark, d).where("line % 2 = 0"))


@query("staged_semi", sql(f"SELECT {COLUMNS} FROM findings WHERE file IN (SELECT source || '/' || doc_id || '.js' FROM documents WHERE lang = 'de')"))
def staged_semi(spark, d):
    t = table(spark, d, "documents").where("lang = 'de'").select(F.concat("source", F.lit("/"), "doc_id", F.lit(".js")).alias("file"))
    return doc_findings(spark, d).join(t, "file", "left_semi")


@query("hotspots", sql("SELECT DISTINCT file FROM findings WHERE regexp_matches(rule_id, '^secret', 'i') OR regexp_matches(file, 'src7/', 'i')"))
def hotspots(spark, d):
    return ops.hotspots(doc_findings(spark, d), "^secret", "src7/")


@query("dedupe", sql(f"SELECT {COLUMNS} FROM findings"))
def dedupe(spark, d):
    f = doc_findings(spark, d)
    return ops.dedupe(ops.union_all([f, f.where("severity = 'high'")]))


@query("dedupe_history", sql("SELECT DISTINCT rule_id, file, left(snippet, 12) AS head FROM findings"))
def dedupe_history(spark, d):
    return ops.dedupe_history(doc_findings(spark, d).withColumn("match", F.col("snippet"))).select("rule_id", "file", F.left("match", F.lit(12)).alias("head"))


@query("dedupe_blobs", sql('SELECT rule_id, file, line, snippet AS match, \'v0\' AS sha FROM findings GROUP BY rule_id, file, line, snippet'))
def dedupe_blobs(spark, d):
    """Three versions of every file with the same findings."""
    versions = doc_findings(spark, d).withColumn("match", F.col("snippet")).withColumn("sha", F.explode(F.array(F.lit("v2"), F.lit("v0"), F.lit("v1"))))
    return ops.dedupe_blobs(versions).select("rule_id", "file", "line", "match", "sha")


@query("first_occurrence", sql('SELECT rule_id, file, line, "column" FROM (SELECT *, row_number() OVER (PARTITION BY rule_id, file ORDER BY line, "column") AS rn FROM findings) WHERE rn = 1'))
def first_occurrence(spark, d):
    return ops.first_of_each(doc_findings(spark, d), ["rule_id", "file"], ["line", "column"]).select("rule_id", "file", "line", "column")


@query("fingerprint", sql("SELECT fingerprint, count(*) AS n FROM findings GROUP BY fingerprint"))
def fingerprint_query(spark, d):
    return doc_findings(spark, d).groupBy("fingerprint").agg(F.count("*").alias("n"))


BASE = "SELECT * FROM findings WHERE file NOT LIKE '%7.js' AND rule_id <> 'pii.phone'"
NOW = "SELECT * FROM findings WHERE file NOT LIKE '%3.js'"


def _snapshots(spark, d):
    """Two snapshots: files whose names end in 7 are new and phones were not looked for; those in 3 are gone."""
    f = doc_findings(spark, d)
    return f.where(~F.col("file").endswith("7.js") & (F.col("rule_id") != "pii.phone")), f.where(~F.col("file").endswith("3.js"))


@query(
    "baseline_diff",
    sql(
        f"""SELECT rule_id, file, snippet, CASE WHEN (rule_id, file) IN (SELECT (rule_id, file) FROM ({NOW})) THEN 'remaining' ELSE 'resolved' END AS status FROM ({BASE})
UNION ALL SELECT rule_id, file, snippet, 'introduced' FROM ({NOW}) WHERE (rule_id, file) NOT IN (SELECT (rule_id, file) FROM ({BASE}))"""
    ),
)
def baseline_diff(spark, d):
    return diff.baseline_diff(*_snapshots(spark, d))


@query(
    "trend",
    sql(
        f"""SELECT resolved, new, persisted, resolved > new AS improving FROM (SELECT count(*) FILTER (c.fingerprint IS NULL) AS resolved, count(*) FILTER (b.fingerprint IS NULL) AS new,
  count(*) FILTER (b.fingerprint IS NOT NULL AND c.fingerprint IS NOT NULL) AS persisted FROM (SELECT DISTINCT fingerprint FROM ({BASE})) b FULL JOIN (SELECT DISTINCT fingerprint FROM ({NOW})) c ON b.fingerprint = c.fingerprint)"""
    ),
)
def trend(spark, d):
    return diff.trend(*_snapshots(spark, d))


@query("set_except", sql(f"SELECT DISTINCT fingerprint FROM ({NOW}) EXCEPT SELECT fingerprint FROM ({BASE})"))
def set_except(spark, d):
    b, c = _snapshots(spark, d)
    return c.select("fingerprint").subtract(b.select("fingerprint"))


@query("set_intersect", sql(f"SELECT DISTINCT fingerprint FROM ({NOW}) INTERSECT SELECT fingerprint FROM ({BASE})"))
def set_intersect(spark, d):
    b, c = _snapshots(spark, d)
    return c.select("fingerprint").intersect(b.select("fingerprint"))


_PRF = "CASE WHEN {b} > 0 THEN {a} / {b} ELSE 0.0 END"


@query(
    "prf",
    sql(
        f"""SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM (SELECT *, {_PRF.format(a='tp', b='(tp + fp)')} AS precision, {_PRF.format(a='tp', b='(tp + fn)')} AS recall FROM
(SELECT source, count(*) FILTER (t AND p) AS tp, count(*) FILTER (NOT t AND p) AS fp, count(*) FILTER (t AND NOT p) AS fn FROM
(SELECT d.source, l.quality = 0 AS t, EXISTS (SELECT 1 FROM findings f WHERE f.file = d.source || '/' || d.doc_id || '.js') AS p FROM labels l JOIN documents d USING (doc_id)) GROUP BY ROLLUP (source)))"""
    ),
)
def prf(spark, d):
    """Findings as a prediction of low quality, by source and over all."""
    truth = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id").select("source", F.concat("source", F.lit("/"), "doc_id", F.lit(".js")).alias("file"), (F.col("quality") == 0).alias("truth"))
    found = doc_findings(spark, d).select("file").distinct().withColumn("_p", F.lit(True))
    scored = truth.join(found, "file", "left").withColumn("predicted", F.coalesce("_p", F.lit(False)))
    return ops.precision_recall(scored, "source")


_CONTROLS = ", ".join(map(str, CONTROLS))
_FAILING = f"SELECT framework, control, count(*) AS n_findings, array_to_string(list_sort(list_distinct(list(rule_id))), ',') AS rules FROM findings f JOIN (VALUES {_CONTROLS}) c(framework, cwe, control) USING (cwe) GROUP BY framework, control"


def _failing(spark, d):
    rules = spark.createDataFrame([(r[0], r[3]) for r in RULES], "rule_id string, cwe string")
    return audit.compliance(doc_findings(spark, d).drop("cwe"), rules, spark.createDataFrame(CONTROLS, "framework string, cwe string, control string"))


@query("compliance", sql(_FAILING))
def compliance(spark, d):
    return _failing(spark, d).withColumn("rules", F.array_join("rules", ","))


@query("compliance_summary", sql(f"SELECT framework, count(*) AS failing, sum(n_findings)::BIGINT AS n_findings FROM ({_FAILING}) GROUP BY framework"))
def compliance_summary(spark, d):
    return audit.compliance_summary(_failing(spark, d))


@query("full_audit", sql(f"SELECT grade, CASE WHEN grade < 'B' THEN 'PASS' WHEN grade < 'D' THEN 'WARN' ELSE 'FAIL' END AS verdict, CASE WHEN grade = 'A' THEN 'PASS' WHEN grade IN ('B', 'C') THEN 'FAIL' ELSE 'WARN' END AS verdict_raw FROM ({grade_sql()})"))
def full_audit(spark, d):
    """Verdict by grade; verdict_raw as the comparison of grades as text gives it."""
    g = F.col("grade")
    return ops.grade(doc_findings(spark, d)).select(
        "grade", F.when(g < "B", "PASS").when(g < "D", "WARN").otherwise("FAIL").alias("verdict"), F.when(g == "A", "PASS").when(g.isin("B", "C"), "FAIL").otherwise("WARN").alias("verdict_raw")
    )


@query("diagnostics", sql("SELECT count(DISTINCT file) AS degraded FROM (SELECT file FROM lines WHERE length(text) > 4000 UNION ALL SELECT file FROM files WHERE length(content) > 20000)"))
def diagnostics(spark, d):
    long = doc_lines(spark, d).where(F.length("text") > 4000).select("file")
    large = doc_files(spark, d).where(F.length("content") > 20000).select("file")
    return long.union(large).agg(F.countDistinct("file").alias("degraded"))


@query("grouped_lists", sql("SELECT split_part(rule_id, '.', 1) AS category, array_to_string(list_sort(list_distinct(list(rule_id))), ',') AS rules FROM findings GROUP BY 1"))
def grouped_lists(spark, d):
    f = doc_findings(spark, d)
    return f.groupBy(ops.category(F.col("rule_id")).alias("category")).agg(F.array_join(F.sort_array(F.collect_set("rule_id")), ",").alias("rules"))


@query("line_rules")
def line_rules(spark, d):
    """The core's line rules, and those of a pack that the session names (sparrowhawk.rules.pack), over documents and pages as files, in one Arrow pass."""
    from ..operators.rules import match_rules
    from ..sources.files import catalogue

    pages = table(spark, d, "pages").select(F.concat(F.lit("page/"), "page_id", F.lit(".html")).alias("file"), F.col("html").alias("content"))
    return match_rules(doc_files(spark, d).select("file", "content").unionByName(pages), catalogue(spark))


@query("apply_rules_pages", "WITH files AS (SELECT 'page/' || page_id || '.html' AS file, html AS content FROM pages)" + FINDINGS_SQL[FINDINGS_SQL.index(", lines AS") :] + f" SELECT {COLUMNS} FROM findings")
def apply_rules_pages(spark, d):
    from ..operators.lines import explode_lines

    pages = table(spark, d, "pages").select(F.concat(F.lit("page/"), "page_id", F.lit(".html")).alias("file"), F.col("html").alias("content"))
    return apply_rules(explode_lines(pages))


_N = len(PAIRS)
_RULE_ARRAY = "[" + ", ".join(f"'{p[0]}'" for p in PAIRS) + "]"


def _samples(spark, d):
    """Parts as files: a line that a rule of the core fires on and, in the next line, one like it that it doesn't."""
    lines = F.array(*[F.lit(f"{fires}\n{quiet}") for _, fires, quiet in PAIRS])
    return table(spark, d, "part").select(F.concat(F.lit("p"), "p_partkey", F.lit(".js")).alias("file"), F.element_at(lines, (F.col("p_partkey") % _N + 1).cast("int")).alias("content"))


@query("core_rules", f"SELECT 'p' || p_partkey || '.js' AS file, {_RULE_ARRAY}[p_partkey % {_N} + 1] AS rule_id, true AS fires, false AS fires_next FROM part")
def core_rules(spark, d):
    """Every rule of the core on lines made for it: whether it fires on the first, and on the second."""
    from ..operators.rules import match_rules

    files = _samples(spark, d)
    own = files.select("file", F.element_at(F.array(*[F.lit(p[0]) for p in PAIRS]), (F.regexp_extract("file", "[0-9]+", 0).cast("long") % _N + 1).cast("int")).alias("rule_id"))
    found = match_rules(files).groupBy("file", "rule_id").agg(F.bool_or(F.col("line") == 1).alias("fires"), F.bool_or(F.col("line") == 2).alias("fires_next"))
    return own.join(found, ["file", "rule_id"], "left").select("file", "rule_id", F.coalesce("fires", F.lit(False)).alias("fires"), F.coalesce("fires_next", F.lit(False)).alias("fires_next"))


#: What a whole scan finds in the projects of scan_files: rule, file's name, line, whether it is suppressed.
_SCANNED = [
    ("secret.stripe-live-key", "key.js", 1, False), ("ast.eval-dynamic", "key.js", 2, True), ("taint.command-injection", "flow.js", 3, False), ("py.taint.code-injection", "run.py", 2, False), ("code.eval", "run.py", 2, False), ("iac.dockerfile", "Dockerfile", 1, False), ("corp.marker", "own.js", 1, False),
    ("taint.command-injection", "route.js", 3, False), ("ast.command-injection", "lib.js", 2, False),
]


def scan_files(spark, d):
    """Suppliers as projects of some files each."""
    texts = {
        "key.js": "const password = 'sk_live_" + "a1" * 10 + "'\neval(x) // sparrowhawk-ignore-line", "flow.js": "const c = req.body.c\nconst d = c\nexec(d)", "run.py": "a = input()\neval(a)", "Dockerfile": "FROM node\nUSER app", "own.js": "CORP-MARKER", "README.md": "eval(x)",
        "lib.js": "export function run(cmd) {\n  execSync(cmd)\n}", "route.js": "import { run } from './lib'\nfunction h(req) {\n  run(req.body.cmd)\n}", "ignored.js": "eval(y)",
    }
    each = F.array(*[F.struct(F.lit(k).alias("name"), F.lit(v).alias("content")) for k, v in texts.items()])
    return table(spark, d, "supplier").select("s_suppkey", F.explode(each).alias("f")).select(F.concat(F.lit("s"), "s_suppkey", F.lit("/"), "f.name").alias("file"), "f.content")


SCAN_CONFIG = {"customRules": [{"id": "corp.marker", "re": "corp-marker", "severity": "low"}], "ignorePaths": ["**/ignored.js"], "severityOverrides": {"iac.dockerfile": "critical"}}


@query("whole_scan", "SELECT x.r AS rule_id, 's' || s_suppkey || '/' || x.f AS file, x.l AS line, x.s AS suppressed, CASE x.r WHEN 'iac.dockerfile' THEN 'critical' WHEN 'corp.marker' THEN 'low' ELSE NULL END AS set_severity FROM supplier, (VALUES " + ", ".join(f"({{'r': '{r}', 'f': '{f}', 'l': {n}, 's': {str(s).lower()}}})" for r, f, n, s in _SCANNED) + ") v(x)")
def whole_scan(spark, d):
    """All passes over suppliers' projects, superseded, suppressed, configured and deduplicated."""
    from ..operators.scan import scan

    own = F.when(F.col("rule_id").isin("iac.dockerfile", "corp.marker"), F.col("severity"))
    return scan(scan_files(spark, d), config=SCAN_CONFIG).select("rule_id", "file", "line", "suppressed", own.alias("set_severity"))


@query("corpus_scores", "SELECT c AS category, tp, fp, fn, tp / (tp + fp) AS precision, 1.0::DOUBLE AS recall, 2 * (tp / (tp + fp)) / (tp / (tp + fp) + 1) AS f1 FROM (SELECT *, (1.0 * n)::DOUBLE AS one FROM (SELECT unnest(['vuln', NULL]) AS c, count(*)::BIGINT AS tp, 0::BIGINT AS fp, 0::BIGINT AS fn, count(*) AS n FROM part))")
def corpus_scores(spark, d):
    """The parts' files as a labelled corpus of which each expects its own rule; others that fire are expected as well."""
    from ..operators.scan import corpus_scores as run

    files = _samples(spark, d)
    from ..operators.rules import match_rules

    found = match_rules(files).withColumn("suppressed", F.lit(False))
    own = files.select(F.lit("vuln").alias("category"), "file", F.element_at(F.array(*[F.lit(p[0]) for p in PAIRS]), (F.regexp_extract("file", "[0-9]+", 0).cast("long") % _N + 1).cast("int")).alias("rule_id"))
    only = found.join(own.select("file", "rule_id"), ["file", "rule_id"], "left_semi")
    return run(only, own)
