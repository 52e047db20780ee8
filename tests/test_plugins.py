"""Plugins, shaping functions, requests on their way out, findings over a history."""

import sys
import types

from pyspark.sql import functions as F

from sparrowhawk.functions import commands
from sparrowhawk.operators import findings, plugins, propagation, rules
from sparrowhawk.operators.catalog import CORE
from sparrowhawk.operators.scan import scan


def module(name, **names):
    sys.modules[name] = types.ModuleType(name)
    sys.modules[name].__dict__.update(names)
    return name


def test_plugins(spark):
    def todo(path, content):
        return [{"rule_id": "own.todo", "line": n} for n, line in enumerate(content.split("\n"), 1) if "TODO" in line]

    def twins(files):
        return files.groupBy("content").agg(F.min("file").alias("file"), F.count("*").alias("n")).where("n > 1").select("file", F.lit("own.twin").alias("rule_id"), F.lit("low").alias("severity"))

    good = module("own_good", RULES=[{"id": "own.marker", "severity": "high", "pattern": "OWN-MARKER", "title": "marker"}], FILE_RULES=[todo], CROSS_FILE_RULES=[twins])
    bad = module("own_bad", RULES=[{"id": "x", "severity": "worst", "pattern": "x", "title": "x"}], FILE_RULES=[todo])
    p = plugins.load([good, bad, "own_missing", good])
    assert [e.split(":")[0] for e in p.errors] == ["own_bad", "own_missing"] and len(p.rules) == len(p.file_rules) == 1
    rows = [("a.js", "x\nTODO"), ("b.js", "x\nTODO"), ("c.js", "OWN-MARKER"), ("n.js", None)]
    files = spark.createDataFrame(rows, "file string, content string")
    got = sorted((r["file"], r["rule_id"], r["line"]) for r in scan(files, plugins=p).where("rule_id like 'own%'").collect())
    assert got == [("a.js", "own.todo", 2), ("a.js", "own.twin", 1), ("b.js", "own.todo", 2), ("c.js", "own.marker", 1)]
    assert plugins.run_plugins(files, plugins.Plugins()) == []


def test_shaping_functions():
    names = rules.shaping_functions({"shapingFunctions": ["toDTO", "strip\\w*", "a b", 3, "*x", ""]})
    assert names == ("toDTO", "strip\\w*")
    line = "console.log(toDTO(user.password))"
    hits = lambda given: [h["rule_id"] for h in rules.hits_of("a.js", line, [rules.ready(r) for r in given])]
    assert hits(CORE) and not hits(rules.with_shaping(CORE, names))
    assert rules.shaping_functions({}) == () and rules.with_shaping(CORE, ()) == list(CORE)
    text = ["const u = await User.findOne(q)", "const v = toDTO(u)", "res.json(v)", "res.json(toDTO(u))"]
    assert propagation.record_responses(text, names) == []


def test_requests(spark):
    key = "AKIA" + "Q" * 16
    rows = [
        (0, "https://x.example.org/", "", "hello"), (1, "http://localhost:80/", "", ""), (2, "https://x.example.org", key, f"{key} password = 'abcdefgh'"), (3, "https://api.openai.com/v1", key, key), (4, "https://a.b.pypi.org:443/", key, ""),
        (5, "https://api.openai.com.evil.org/", key, None), (6, None, None, None), (7, "https://x.example.org", "", "mail jo@corp.com"), (8, "https://u:p@127.0.0.1/", "", ""),
    ]
    df = spark.createDataFrame(rows, "i int, url string, headers string, body string")
    got = {r["i"]: list(r["violations"]) for r in commands.inspect_requests(df).collect()}
    assert got == {0: [], 1: ["blocked_domain"], 2: ["secret_exfil", "secret_exfil", "secret_in_header", "pii_exfil"], 3: [], 4: [], 5: ["secret_in_header"], 6: [], 7: ["pii_exfil"], 8: ["blocked_domain"]}
    assert commands.inspect_requests(df, with_pii=False).where("i = 7").first()["allowed"]


def test_dedupe_blobs(spark):
    rows = [("r", "f", 1, "m", "b"), ("r", "f", 1, "m", "a"), ("r", "f", 2, "m", "b"), ("r", None, 1, None, "c"), ("r", None, 1, None, "c")]
    df = spark.createDataFrame(rows, "rule_id string, file string, line int, match string, sha string")
    got = sorted(((r["file"] or "", r["line"], r["sha"]) for r in findings.dedupe_blobs(df).collect()))
    assert got == [("", 1, "c"), ("f", 1, "a"), ("f", 2, "b")]
