import json

from pyspark.sql import functions as F

from sparrowhawk.operators import audit, graph, supply
from sparrowhawk.operators.lines import explode_lines, near
from sparrowhawk.plans import reports
from sparrowhawk.plans.base import doc_findings
from sparrowhawk.sources import files as S


def test_file_tree(spark, tmp_path):
    for name, data in {"src/a.js": b"x\r\ny", "src/b.bin": b"x", "node_modules/m/c.js": b"x", "d.py": b"a\x00b", ".env.local": b"K=1", "big.js": b"z" * (2 * 1024 * 1024 + 1), "Dockerfile": b"FROM x"}.items():
        p = tmp_path / "proj" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data)
    got = {r["file"]: r["content"] for r in S.file_tree(spark, f"file://{tmp_path}/proj").collect()}
    assert got == {"src/a.js": "x\r\ny", ".env.local": "K=1", "Dockerfile": "FROM x"}


def test_config(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"ignoreRules": ["x"]}')
    (tmp_path / "b.json").write_text("{nonsense")
    assert S.config(spark, f"file://{tmp_path}/a.json") == {"ignoreRules": ["x"]}
    assert S.config(spark, f"file://{tmp_path}/b.json") == S.config(spark, f"file://{tmp_path}/none.json") == {}


def test_lines_and_windows(spark):
    f = spark.createDataFrame([("a", "1\r\n2\n\n4")], "file string, content string")
    rows = explode_lines(f)
    assert [(r["line"], r["text"]) for r in rows.orderBy("line").collect()] == [(1, "1"), (2, "2"), (3, ""), (4, "4")]
    got = rows.withColumn("n", near(F.col("text") == "1", "file", 1, 0)).orderBy("line").collect()
    assert [r["n"] for r in got] == [True, True, False, False]


def test_other_tools(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"results": [{"check_id": "x.y", "path": "a.py", "start": {"line": 3}, "extra": {"severity": "ERROR", "message": "m"}}]}))
    (tmp_path / "b.json").write_text(json.dumps({"results": [{"test_id": "B1", "filename": "a.py", "line_number": 4, "issue_severity": "LOW", "issue_text": "t"}]}))
    (tmp_path / "g.json").write_text(json.dumps([{"RuleID": "aws", "File": "f", "StartLine": 2, "Description": "d"}]))
    (tmp_path / "t.json").write_text(json.dumps({"Results": [{"Target": "os", "Vulnerabilities": [{"VulnerabilityID": "CVE-1", "PkgName": "p", "InstalledVersion": "1", "Severity": "HIGH"}]}]}))
    u = f"file://{tmp_path}"
    every = [supply.external_findings(x, n, "rule", "severity", "file", "line", "message") for n, x in (("semgrep", S.semgrep(spark, f"{u}/s.json")), ("bandit", S.bandit(spark, f"{u}/b.json")), ("gitleaks", S.gitleaks(spark, f"{u}/g.json")))]
    got = {(r["rule_id"], r["severity"], r["line"]) for x in every for r in x.collect()}
    assert got == {("semgrep.x.y", "high", 3), ("bandit.B1", "low", 4), ("gitleaks.aws", "critical", 2)}
    assert S.image_scan(spark, f"{u}/t.json").first()["severity"] == "high"


def test_project_and_threats(spark):
    paths = spark.createDataFrame([(".env",), ("public/.env",), ("package.json",)], "path string")
    assert {r["rule_id"] for r in audit.project_files(paths, False).collect()} == {"project.env-not-ignored", "project.env-exposed", "package.no-lockfile"}
    assert {r["rule_id"] for r in audit.project_files(paths.unionAll(spark.createDataFrame([("yarn.lock",)], "path string")), True).collect()} == {"project.env-exposed"}
    files = spark.createDataFrame([("a.js", "app.get('/x', h); fetch('http://x')")], "file string, content string")
    assert {r["surface"] for r in audit.threat_model(files).where("present").collect()} == {"api", "external"}
    assert {r["check"] for r in audit.doctor(spark.createDataFrame([("s.json", '{"hooks": "curl x | sh", "OPENAI_BASE_URL": "y"}')], "file string, content string")).collect()} == {"hook-remote-code", "base-url-override"}
    gates = spark.createDataFrame([("a", True), ("b", None), ("c", False)], "gate string, passed boolean")
    g = audit.deploy_gates(gates).first()
    assert (g["ready"], g["failed"], g["unknown"]) == (False, ["c"], ["b"]) and audit.deploy_gates(gates.where("passed")).first()["ready"] and not audit.deploy_gates(gates.where("false")).first()["ready"]


def test_inventories(spark):
    rows = [("a.js", n, t) for n, t in enumerate(["const email = u.email", "localStorage.setItem('token', t)", "openai.chat.completions.create({})", "x", "gtag('a')", "new WebSocket('wss://h.io/x')", "fetch('https://z.unknown-host.weird/p')"], 1)]
    lines = spark.createDataFrame(rows, "file string, line int, text string")
    p = audit.privacy_audit(lines).first()
    assert p["pii_fields"] == ["email"] and p["storage"] == 1 and p["overall_risk"] == "HIGH" and len(p["risks"]) == 5
    a = audit.ai_data(lines).collect()
    assert [(r["line"], r["provider"], r["severity"]) for r in a] == [(3, "OpenAI", "high")]
    e = {(r["method"], r["domain"], r["suspicious"]) for r in audit.endpoints(lines).collect()}
    assert e == {("websocket", "h.io", True), ("fetch", "z.unknown-host.weird", True), ("url", "z.unknown-host.weird", True)}
    assert "https://h.io" in reports.content_policy(audit.endpoints(lines)) and "email" in reports.privacy_policy(audit.privacy_audit(lines))


def test_exports(spark):
    e = spark.createDataFrame([("a", "f", None, None), ("b", "g", "a", "f"), ("c", "h", "b", "g"), ("x", "y", "y", "z")], "file string, name string, from_file string, from_name string")
    assert {(r["file"], r["name"], r["home"], r["local"]) for r in graph.resolve_exports(e).collect()} == {("a", "f", "a", "f"), ("b", "g", "a", "f"), ("c", "h", "a", "f")}


def test_reports(spark, small, tmp_path):
    f = doc_findings(spark, small)
    s = json.loads(reports.sarif(f))
    driver, results = s["runs"][0]["tool"]["driver"], s["runs"][0]["results"]
    assert len(results) == f.count() and all(driver["rules"][r["ruleIndex"]]["id"] == r["ruleId"] for r in results)
    assert results[0]["ruleIndex"] == 0 and s["version"] == "2.1.0"
    assert reports.text_report(f).startswith("Grade ") and "<table>" in reports.html_report(f) and "| severity |" in reports.markdown(f)
    assert reports.badge(f) is None and "secure: A" in reports.badge(f.where("false")) and "grade" in json.loads(reports.chat_payload(f))["text"]
    reports.write_findings(f, f"{tmp_path}/base")
    assert spark.read.parquet(f"{tmp_path}/base").count() == f.count()
