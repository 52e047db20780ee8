import json

from pyspark.sql import functions as F

from sparrowhawk.functions import commands
from sparrowhawk.operators import diff, gates, supply
from sparrowhawk.plans import reports


def test_gates_pass_warn_fail_and_unknown(spark):
    clean = {c: 0 for c in gates.COUNTS} | {"env_tracked": False, "env_ignored": True, "manifest_known": True}
    rows = [("clean", clean), ("worst", clean | {"criticals": 1, "env_ignored": False}), ("high", clean | {"highs": 2}), ("none", {"criticals": 0})]
    names = ["k", *gates.COUNTS, *gates.FLAGS]
    df = spark.createDataFrame([(k, *[f.get(n) for n in names[1:]]) for k, f in rows], "k string, " + ", ".join(f"{c} long" for c in gates.COUNTS) + ", " + ", ".join(f"{c} boolean" for c in gates.FLAGS))
    got = gates.gate_results(df, ["k"])
    status = {(r["k"], r["gate"]): r["status"] for r in got.collect()}
    assert len(gates.GATES) == 13 and {v for (k, _), v in status.items() if k == "clean"} == {"pass"}
    assert status["worst", "static-scan"] == status["worst", "configuration"] == "fail" and status["high", "static-scan"] == "warn" and status["none", "static-scan"] == "unknown"
    assert {r["k"]: r["ready"] for r in gates.ready(got, ["k"]).collect()} == {"clean": True, "worst": False, "high": True, "none": False}
    strict = {(r["k"], r["gate"]): r["status"] for r in gates.gate_results(df, ["k"], strict=True).collect()}
    assert strict["high", "static-scan"] == "fail"
    assert {r["status"] for r in gates.gate_results(df.select("k"), ["k"]).collect()} == {"unknown"}


def test_scan_facts(spark):
    rows = [("secret.x", "critical", False), ("code.eval", "high", False), ("code.eval", "critical", True)]
    got = gates.scan_facts(spark.createDataFrame(rows, "rule_id string, severity string, suppressed boolean")).first()
    assert tuple(got) == (1, 1, 1)


def test_outbound(spark):
    rows = [("mail a@b.org", None, None, None), (None, "http://10.0.0.1/x", None, None), (None, "https://api.openai.com:443/v1", None, None), (None, "https://u:p@evil.io/10.0.0.1", "~/.aws/c", "ls"), (None, None, None, None), ("k sk_live_" + "a1" * 10, "172.16.0.1", ".env", "sudo rm -rf /")]
    got = commands.outbound(spark.createDataFrame(rows, "data string, url string, path string, command string"), ["evil"]).collect()
    assert [r["refused"] for r in got] == [["pii:email"], ["internal:10.0.0.1"], [], ["host:evil", "path:.aws"], [], ["secret:Stripe secret key", "internal:172.16.0.1", "path:.env", "command:rm -rf", "command:sudo"]]
    assert [r["allowed"] for r in got] == [False, False, True, False, True, False]


def test_audit_reports_of_other_tools(spark):
    npm = {"vulnerabilities": {"a": {"name": "a", "severity": "moderate", "via": [{"title": "Bad a"}]}, "b": {"name": "b", "severity": "high", "via": ["a"]}}}
    pip = {"dependencies": [{"name": "x", "version": "1", "vulns": [{"id": "V-1", "fix_versions": ["1.2", "2"]}, {"id": "V-2", "fix_versions": []}]}, {"name": "y", "version": "1", "vulns": []}]}
    df = lambda x: spark.createDataFrame([("r.json", json.dumps(x)), ("bad", "{"), ("none", None)], "file string, content string")
    assert sorted(tuple(r)[1:] for r in supply.npm_audit(df(npm)).collect()) == [("a", "medium", "Bad a"), ("b", "high", "by a")]
    for report in (pip, pip["dependencies"]):
        assert sorted(tuple(r)[1:] for r in supply.pip_audit(df(report)).collect()) == [("x", "1", "V-1", "1.2"), ("x", "1", "V-2", None)]


def test_sbom_by_project(spark):
    rows = [("p", "a", "1"), ("p", "a", "1"), ("p", "b", "2"), ("q", "a", "1")]
    c = spark.createDataFrame(rows, "file string, package string, version string")
    got = {r["file"]: [x["name"] for x in json.loads(r["sbom"])["components"]] for r in supply.sbom(c, by=["file"]).collect()}
    assert got == {"p": ["a", "b"], "q": ["a"]}
    assert [x["name"] for x in json.loads(supply.sbom(c).first()["sbom"])["components"]] == ["a", "b"]


def _findings(spark, n):
    return spark.range(n).select(F.lit("code.eval").alias("rule_id"), F.lit("high").alias("severity"), F.lit("high").alias("confidence"), F.lit("t <b>").alias("title"), F.lit("a<b>.js").alias("file"), F.col("id").cast("int").alias("line"), F.lit(1).alias("column"), F.lit("s").alias("snippet"), F.lit("fp").alias("fingerprint"))


def test_reports_say_what_they_leave_out(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(reports, "SHOWN", 10)
    few, many = _findings(spark, 10), _findings(spark, 25)
    for report in (reports.text_report, reports.html_report, reports.sarif):
        assert "15 more findings" in report(many) and "more findings" not in report(few)
    reports.write_sarif(many, str(tmp_path / "sarif"))
    rows = [json.loads(r[0]) for r in spark.read.text(str(tmp_path / "sarif" / "results")).collect()]
    assert len(rows) == 25 and rows[0]["locations"][0]["physicalLocation"]["artifactLocation"]["uri"] == "a<b>.js"
    page = reports.dashboard(many, spark.createDataFrame([("2024-01-01", 3), ("2024-01-02", 1)], "day string, n long"))
    assert "a&lt;b&gt;.js" in page and "<polyline" in page and "Grade D" in page


def test_an_audit_log_comes_back(spark, tmp_path):
    e = spark.createDataFrame([("u", i, f"x{i}") for i in range(5)], "k string, i int, x string")
    reports.write_findings(diff.hash_chain(e, ["k"], ["i"], F.col("x")), str(tmp_path / "log"), "json")
    back = reports.read_audit(spark, str(tmp_path / "log"), ["k"], ["i"], "x", "k string, i int, x string, previous_hash string, hash string")
    assert back.count() == 5 and back.where("link_ok and hash_ok").count() == 5
