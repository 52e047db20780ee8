"""Sinks: reports of findings as text, JSON, SARIF, HTML, markdown, badge, fix list; and tables."""

from __future__ import annotations

import html
import json

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..operators.findings import grade, ranked
from ..schema import SEVERITIES, choose, severity_rank

LEVELS = {"critical": "error", "high": "error", "medium": "warning", "low": "note"}
#: Findings in a report that a person reads, the first by rank; it says how many there are. All are written by write_findings and write_sarif.
SHOWN = 5000


def write_findings(findings: DataFrame, path: str, format_: str = "parquet") -> None:
    """All findings as a table: a baseline, or JSON by line."""
    findings.write.mode("overwrite").format(format_).save(path)


def as_json(findings: DataFrame) -> DataFrame:
    """Each finding as one JSON text."""
    return findings.select(F.to_json(F.struct(*findings.columns)).alias("value"))


def _rows(findings: DataFrame) -> list:
    return ranked(findings).limit(SHOWN).collect()


def _more(g) -> str:
    """What a report says about the findings that it doesn't show."""
    left = sum(g[s] for s in SEVERITIES) - SHOWN
    return f"{left} more findings are not shown here" if left > 0 else ""


def _grade(findings: DataFrame):
    return grade(findings).first()


def text_report(findings: DataFrame) -> str:
    g = _grade(findings)
    head = [f"Grade {g['grade']}: " + ", ".join(f"{g[s]} {s}" for s in SEVERITIES)]
    return "\n".join(head + [f"{r['severity'].upper():8} {r['file']}:{r['line']}:{r['column']} {r['rule_id']}  {r['snippet']}" for r in _rows(findings)] + ([_more(g)] if _more(g) else []))


def sarif_parts(findings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rules with their index in the order of first sight, results with rule_index and level)."""
    order = F.struct(severity_rank(F.col("severity")), "file", "line", "column", "rule_id")
    first = findings.groupBy("rule_id").agg(F.min(order).alias("_first"), F.min_by("title", order).alias("title"), F.min_by("severity", order).alias("severity"))
    # One row per rule: the catalogue's size, not the findings'.
    rules = first.withColumn("rule_index", F.row_number().over(Window.orderBy("_first")) - 1).drop("_first")
    level = choose(F.col("severity"), LEVELS, "warning")
    return rules, findings.withColumn("level", level).join(rules.select("rule_id", "rule_index"), "rule_id")


def sarif(findings: DataFrame, tool: str = "sparrowhawk", version: str = "0.1") -> str:
    """SARIF 2.1.0; of more than SHOWN findings it has the first, and says how many are left. write_sarif has no bound."""
    rules, results = sarif_parts(findings)
    rule_rows = [
        {"id": r["rule_id"], "name": r["title"], "shortDescription": {"text": r["title"]}, "defaultConfiguration": {"level": LEVELS.get(r["severity"], "warning")}} for r in rules.orderBy("rule_index").collect()
    ]
    result_rows = [_result(r) for r in _rows(results)]
    driver = {"name": tool, "version": version, "rules": rule_rows}
    return json.dumps({"$schema": "https://json.schemastore.org/sarif-2.1.0.json", "version": "2.1.0", "runs": [{"tool": {"driver": driver}, "results": result_rows, **({"properties": {"note": more}} if (more := _more(_grade(findings))) else {})}]}, indent=2)


def _result(r) -> dict:
    return {
        "ruleId": r["rule_id"], "ruleIndex": r["rule_index"], "level": r["level"], "message": {"text": r["title"]}, "partialFingerprints": {"primary": r["fingerprint"]},
        "locations": [{"physicalLocation": {"artifactLocation": {"uri": r["file"]}, "region": {"startLine": r["line"], "startColumn": r["column"]}}}],
    }


def write_sarif(findings: DataFrame, path: str) -> None:
    """All findings as SARIF results, one JSON text a line, below path/results, and the rules below path/rules; written by the tasks."""
    rules, results = sarif_parts(findings)
    at = F.struct(F.col("line").alias("startLine"), F.col("column").alias("startColumn"))
    place = F.struct(F.struct(F.struct(F.col("file").alias("uri")).alias("artifactLocation"), at.alias("region")).alias("physicalLocation"))
    row = F.struct(F.col("rule_id").alias("ruleId"), F.col("rule_index").alias("ruleIndex"), "level", F.struct(F.col("title").alias("text")).alias("message"), F.struct(F.col("fingerprint").alias("primary")).alias("partialFingerprints"), F.array(place).alias("locations"))
    results.select(F.to_json(row).alias("value")).write.text(f"{path}/results")
    rules.select(F.to_json(F.struct(F.col("rule_id").alias("id"), F.col("title").alias("name"), "rule_index", "severity")).alias("value")).write.text(f"{path}/rules")


def html_report(findings: DataFrame) -> str:
    g, e = _grade(findings), lambda x: html.escape(str(x))
    rows = "".join(f"<tr><td>{e(r['severity'])}</td><td>{e(r['rule_id'])}</td><td>{e(r['file'])}:{r['line']}</td><td><code>{e(r['snippet'])}</code></td></tr>" for r in _rows(findings))
    return f"<!DOCTYPE html><html><body><h1>Grade {g['grade']}</h1><table>{rows}</table><p>{_more(g)}</p></body></html>"


def dashboard(findings: DataFrame, history: DataFrame | None = None) -> str:
    """An HTML page of aggregates: the grade, a matrix of categories by severity, the files with most findings, and a trend (history: day, n)."""
    from ..operators.findings import severity_matrix, top_files

    g, e = _grade(findings), lambda x: html.escape(str(x))
    row = lambda cells, tag="td": "<tr>" + "".join(f"<{tag}>{e(c)}</{tag}>" for c in cells) + "</tr>"
    head = ["category", *SEVERITIES, "total"]
    matrix = "".join(row([r[c] for c in head]) for r in severity_matrix(findings).orderBy(F.desc("weight"), "category").collect())
    files = "".join(row([r["file"], r["n"]]) for r in top_files(findings).collect())
    days = history.orderBy(F.desc("day")).limit(90).collect()[::-1] if history is not None else []
    most = max((r["n"] for r in days), default=1) or 1
    line = " ".join(f"{i * 6},{100 - 100 * r['n'] // most}" for i, r in enumerate(days))
    trend = f'<svg width="{6 * len(days)}" height="100"><polyline fill="none" stroke="#247" points="{line}"/></svg>' if days else ""
    return f"<!DOCTYPE html><html><body><h1>Grade {g['grade']}</h1><table>{row(head, 'th')}{matrix}</table><table>{row(['file', 'findings'], 'th')}{files}</table>{trend}</body></html>"


def read_audit(spark: SparkSession, path: str, key: list[str], order: list[str], content: str, schema: str) -> DataFrame:
    """An exported audit log (JSON by line) with link_ok and hash_ok: what was changed outside shows."""
    from ..operators.diff import verify_chain

    return verify_chain(spark.read.schema(schema).json(path), key, order, F.col(content))


def markdown(findings: DataFrame, shown: int = 20) -> str:
    """A comment for a change: the grade, and the first findings."""
    g = _grade(findings)
    lines = [f"**Grade {g['grade']}**", "", "| severity | rule | place |", "|-|-|-|"]
    return "\n".join(lines + [f"| {r['severity']} | {r['rule_id']} | {r['file']}:{r['line']} |" for r in ranked(findings).limit(shown).collect()])


def fix_list(findings: DataFrame) -> DataFrame:
    """group (confirmed, review), n, rule_id, file, line: numbered within the group, low confidence for review."""
    group = F.when(F.col("confidence") == "low", "review").otherwise("confirmed")
    w = Window.partitionBy("group", "file").orderBy(severity_rank(F.col("severity")), "line", "column", "rule_id")
    return findings.withColumn("group", group).withColumn("n", F.row_number().over(w)).select("group", "file", "n", "rule_id", "line")


def badge(findings: DataFrame) -> str | None:
    """An SVG badge; None while there are critical or high findings."""
    g = _grade(findings)
    if g["critical"] or g["high"]:
        return None
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="120" height="20"><rect width="120" height="20" fill="#2b7"/><text x="8" y="14" fill="#fff">secure: {g["grade"]}</text></svg>'


def chat_payload(findings: DataFrame) -> str:
    """The message of a chat webhook."""
    g = _grade(findings)
    return json.dumps({"text": f"Scan: grade {g['grade']}", "blocks": [{"type": "section", "text": {"type": "mrkdwn", "text": ", ".join(f"{g[s]} {s}" for s in SEVERITIES)}}]})


def content_policy(endpoints: DataFrame) -> str:
    """A Content-Security-Policy of the distinct domains that the code calls; more than SHOWN raise, as no header holds them."""
    hosts = [r[0] for r in endpoints.select("domain").distinct().orderBy("domain").limit(SHOWN + 1).collect()]
    if len(hosts) > SHOWN:
        raise ValueError(f"more than {SHOWN} domains")
    return "default-src 'self'; connect-src 'self'" + "".join(f" https://{h}" for h in hosts)


def privacy_policy(inventory: DataFrame, company: str = "The operator") -> str:
    """A draft from the one row of a privacy audit."""
    r = inventory.first()
    lines = [f"{company} processes: {', '.join(r['pii_fields']) or 'no personal fields'}.", f"Stored at {r['storage']} places, sent at {r['transmission']}.", f"Consent is asked at {r['consent']} places; retention is set at {r['retention']}."]
    return "\n".join(lines)


#: What a line of a rule becomes: (pattern, replacement). Only suggestions; no file is changed.
FIXES = {
    "code.insecure-http": (r"http://(?!localhost|127\.0\.0\.1)", "https://"),
    "net.tls-verification-disabled": (r"rejectUnauthorized\s*:\s*false", "rejectUnauthorized: true"),
    "crypto.weak-hash": (r"createHash\(\s*['\"](?:md5|sha1)['\"]\s*\)", "createHash('sha256')"),
    "ai.browser-api-key": (r"dangerouslyAllowBrowser\s*:\s*true", "dangerouslyAllowBrowser: false"),
    "code.cors-wildcard": (r"origin\s*:\s*['\"]\*['\"]", "origin: process.env.ALLOWED_ORIGIN"),
    "code.eval": (r"(?<![A-Za-z0-9_])eval\s*\(", "JSON.parse("),
    "crypto.insecure-random": (r"Math\.random\(\)", "crypto.randomUUID()"),
    "auth.jwt-alg-none": (r"['\"]none['\"]", "'HS256'"),
    "injection.xxe": (r"noent\s*:\s*true", "noent: false"),
    "error.detail-to-client": (r"(?<![A-Za-z0-9_])(?:err|error|e|ex)\.(?:stack|message)", "'internal error'"),
    "cookie.insecure-flags": (r"(\bres\.cookie\([^)]*)\)", "$1, { httpOnly: true, secure: true, sameSite: 'lax' })"),
    "ai.disabled-sandbox": (r"dangerouslyDisableSandbox\s*:\s*true", "dangerouslyDisableSandbox: false"),
    "secret.generic-credential": (r"([:=]\s*)['\"][^'\"]{6,}['\"]", "$1process.env.SECRET"),
}


def suggested_fixes(findings: DataFrame, lines: DataFrame) -> DataFrame:
    """file, line, rule_id, before, after of findings whose rule has a rewrite, by the line's text (file, line, text)."""
    j = findings.where(F.col("rule_id").isin(*FIXES)).select("file", "line", "rule_id").distinct().join(lines.select("file", "line", "text"), ["file", "line"])
    after = F.col("text")
    for rule, (pattern, by) in FIXES.items():
        after = F.when(F.col("rule_id") == rule, F.regexp_replace("text", pattern, by)).otherwise(after)
    return j.select("file", "line", "rule_id", F.col("text").alias("before"), after.alias("after")).where("before <> after")
