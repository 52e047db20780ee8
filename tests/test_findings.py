import pytest
from pyspark.sql import functions as F

from sparrowhawk.operators import diff
from sparrowhawk.operators import findings as O

SCHEMA = "rule_id string, severity string, confidence string, file string, line int, column int, snippet string"


def make(spark, rows):
    return spark.createDataFrame([(*r, *(None,) * (7 - len(r))) for r in rows], SCHEMA)


@pytest.mark.parametrize(
    "rows, want",
    [
        ([], "A"), ([("critical", "high")], "F"), ([("critical", "low")], "C"), ([("high", "high")] * 2, "C"), ([("high", "medium")] * 3, "D"), ([("high", "low")] * 2, "B"), ([("high", "low")] * 3, "C"),
        ([("medium", "high")] * 2, "B"), ([("medium", "high")] * 3, "C"), ([("low", "high")], "B"), ([("low", "low")] * 5, "A"), ([("medium", "low")], "B"),
    ],
)
def test_grade(spark, rows, want):
    got = O.grade(make(spark, [("r", s, c, "f", 1, 1) for s, c in rows])).first()
    assert got["grade"] == want
    assert [got[s] for s in O.SEVERITIES] == [sum(r[0] == s for r in rows) for s in O.SEVERITIES]


def test_supersede_and_dedupe(spark):
    f = make(
        spark,
        [
            ("secret.generic-credential", "critical", "low", "a", 1, 1), ("auth.weak-session-secret", "high", "high", "a", 1, 5), ("secret.generic-credential", "critical", "low", "a", 2, 1),
            ("taint.sql-injection", "high", "high", "a", 3, 1), ("ast.sql-injection", "high", "high", "a", 3, 2), ("ast.sql-injection", "high", "high", "a", 4, 2), ("ast.ssrf", "high", "high", "a", 3, 2), ("ast.ssrf", "high", "high", "a", 3, 2),
        ],
    )
    got = sorted((r["rule_id"], r["line"]) for r in O.dedupe(O.supersede(f)).collect())
    assert got == [("ast.sql-injection", 4), ("ast.ssrf", 3), ("auth.weak-session-secret", 1), ("secret.generic-credential", 2), ("taint.sql-injection", 3)]


def test_inline_suppression(spark):
    lines = spark.createDataFrame(
        [
            ("a", 1, "x // tool-ignore-line"), ("a", 2, "# tool-ignore-next-line r1, r2"), ("a", 4, "/* TOOL-ignore-line [r3] */"), ("a", 5, "// tool-ignore[r4]: it is fine"), ("a", 6, "// tool-ignore-next[*]: all"),
            ("a", 8, "tool-ignore-line without a comment sign"), ("a", 9, "// tool-ignore-lines r1"),
        ],
        "file string, line int, text string",
    )
    d = O.directives(lines, "tool")
    assert sorted((r["line"], r["rule"]) for r in d.collect()) == [(1, "*"), (3, "r1"), (3, "r2"), (4, "r3"), (5, "r4"), (7, "*")]
    assert d.where("rule = 'r4'").first()["reason"] == "it is fine"
    f = make(spark, [(r, "high", "high", "a", n, 1) for n, r in ((1, "q"), (3, "r1"), (3, "r3"), (4, "r3"), (7, "z"), (8, "z"))])
    kept, gone = O.suppress_inline(f, d)
    assert sorted((r["line"], r["rule_id"]) for r in kept.collect()) == [(3, "r3"), (8, "z")] and gone.count() == 4


def test_docs_and_config(spark):
    f = make(spark, [("code.eval", "high", "low", "README.md", 1, 1), ("secret.x", "high", "low", "docs/a.txt", 1, 1), ("code.eval", "high", "low", "src/a.js", 1, 1), ("secret.y", "high", "low", "src/b.js", 2, 1)])
    assert {r["file"] for r in O.suppress_docs(f).collect()} == {"docs/a.txt", "src/a.js", "src/b.js"}
    with_text = f.withColumn("t", F.when(F.col("rule_id") == "secret.y", "k = your_api_key"))
    assert {r["file"] for r in O.suppress_docs(with_text, "t").collect()} == {"docs/a.txt", "src/a.js"}
    assert {r["file"] for r in O.config_ignore(f, ["secret.x"], ["**/*.md"], [{"rule": "code.eval", "path": "src"}]).collect()} == {"src/b.js"}
    assert O.override_severity(f, {"secret.x": "low", "secret.y": "wrong"}).where("severity = 'low'").count() == 1
    assert O.min_confidence(f).count() == 0 and O.hotspots(f, "^secret", "nothing").count() == 2


def test_totals(spark):
    f = make(spark, [("a.x", "critical", "high", "f", 1, 1), ("a.y", "low", "high", "f", 2, 1), ("b.z", "medium", "high", "g", 1, 1)])
    files = spark.createDataFrame([("f",), ("g",)], "file string")
    r = O.risk_score(f, files).first()
    assert (r["score"], r["percent"], r["level"]) == (13, 65, "CRITICAL")
    assert O.risk_score(f.where("false"), files).first()["level"] == "NONE"
    m = {x["category"]: (x["critical"], x["low"], x["total"], x["weight"]) for x in O.severity_matrix(f).collect()}
    assert m == {"a": (1, 1, 2, 11), "b": (0, 0, 1, 2)}
    g = O.gate(f, "high").first()
    assert (g["worst"], g["failed"]) == ("critical", True) and O.gate(f.where("false"), "high").first()["failed"] is False
    assert [x["file"] for x in O.top_files(f).collect()] == ["f", "g"]


def test_scores(spark):
    s = spark.createDataFrame([("a", True, True), ("a", True, False), ("b", False, True), ("b", False, False)], "c string, truth boolean, predicted boolean")
    got = {r["c"]: (r["tp"], r["fp"], r["fn"], r["precision"], r["recall"]) for r in O.precision_recall(s, "c").collect()}
    assert got == {"a": (1, 0, 1, 1.0, 0.5), "b": (0, 1, 0, 0.0, 0.0), None: (1, 1, 1, 0.5, 0.5)}


def test_baseline(spark):
    base = make(spark, [("r", "high", "high", "a", 1, 1, "x"), ("q", "high", "high", "a", 1, 1, "y")])
    now = make(spark, [("r", "high", "high", "a", 9, 1, "changed"), ("p", "high", "high", "b", 1, 1, "z")])
    assert {(r["rule_id"], r["status"]) for r in diff.baseline_diff(base, now).collect()} == {("r", "remaining"), ("q", "resolved"), ("p", "introduced")}


def test_components_and_chain(spark):
    b = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", None)], "name string, version string")
    h = spark.createDataFrame([("a", "2"), ("d", "1"), ("c", None)], "name string, version string")
    assert {(r["name"], r["change"]) for r in diff.component_diff(b, h).collect()} == {("a", "changed"), ("b", "removed"), ("d", "added")}
    e = spark.createDataFrame([("u", i, f"x{i}") for i in range(4)], "k string, i int, x string")
    chain = diff.hash_chain(e, ["k"], ["i"], F.col("x"))
    assert diff.verify_chain(chain, ["k"], ["i"], F.col("x")).where("not link_ok or not hash_ok").count() == 0
    forged = chain.withColumn("x", F.when(F.col("i") == 2, "evil").otherwise(F.col("x")))
    assert [r["i"] for r in diff.verify_chain(forged, ["k"], ["i"], F.col("x")).where("not hash_ok").collect()] == [2]
    assert chain.columns == ["k", "i", "x", "previous_hash", "hash"]
    again = {r["i"]: r["hash"] for r in diff.hash_chain(forged.select("k", "i", "x"), ["k"], ["i"], F.col("x")).collect()}
    was = {r["i"]: r["hash"] for r in chain.collect()}
    assert [again[i] == was[i] for i in range(4)] == [True, True, False, False]  # a rewritten entry changes every later hash
    import hashlib

    last = "GENESIS"
    for i in range(4):
        last = hashlib.sha256(f"{last}\nx{i}".encode()).hexdigest()
        assert was[i] == last


def test_chain_keys_nulls_and_ties(spark):
    rows = [(k, i, None if i == 1 else f"é{i}") for k in ("u", None, "v") for i in range(3)]
    e = spark.createDataFrame(rows, "k string, i int, x string").repartition(3)
    chain = diff.hash_chain(e, ["k"], ["i"], F.col("x"))
    assert chain.count() == 9 and chain.where("previous_hash = 'GENESIS'").count() == 3
    assert diff.verify_chain(chain, ["k"], ["i"], F.col("x")).where("not link_ok or not hash_ok").count() == 0
    assert diff.hash_chain(e.where("false"), ["k"], ["i"], F.col("x")).count() == 0
