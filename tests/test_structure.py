"""Calls by structure: each rule with lines it fires on and lines it doesn't."""

import pytest

from sparrowhawk.operators import structure as S

CASES = [
    ("eval(x)", ["ast.eval-dynamic"]), ("eval('1')", []), ("eval(`a`)", []), ("eval(`a${b}`)", ["ast.eval-dynamic"]), ("// eval(x)\n/* eval(y) */ const s = 'eval(z)'", []),
    ("cp.exec(\n  // why\n  'ls ' + d\n)", ["ast.command-injection"]), ("exec('ls')", []), ("function exec(a) { return 1 }", []), ("spawn(cmd, [])", ["ast.command-injection"]),
    ("fs.readFile(req.query.p)", ["ast.path-traversal"]), ("path.join(base, req.params['f'])", ["ast.path-traversal"]), ("fs.readFile(name)", []), ("fs.readFile(path.basename(req.x))", []),
    ("axios.get(req.query.u)", ["ast.ssrf"]), ("fetch(req.body.url)", ["ast.ssrf"]), ("fetch(url)", []), ("app.get(req.x)", []),
    ("Object.assign(user, req.body)", ["ast.mass-assignment"]), ("Object.assign(req.user, extra)", []), ("User.create(req.body)", ["ast.mass-assignment"]), ("new User(req.body)", ["ast.mass-assignment"]), ("new Date(req.body.d)", []),
    ("User.find(req.query)", ["ast.nosql-injection"]), ("User.findOne({ name: req.body.name, a: 1 })", ["ast.nosql-injection"]), ("User.find({ a: 1 })", []), ("db.x.aggregate({ '$where': f })", ["ast.nosql-injection"]),
    ("new Function(code)", ["ast.function-constructor"]), ("new Function('return 1')", []),
    ("function run(a) {\n  db.query('x' + a)\n}\nrun(req.body.q)", ["taint.interprocedural"]), ("const run = (a) => db.query(`x ${a}`)\nconst b = 1\nrun(req.body)", ["taint.interprocedural"]),
    ("const run = a => { log(a) }\nrun(req.body)", []), ("function run({ a }) { db.query(a) }\nrun(req.body)", []), ("function run(a) { db.query('x', [a]) }\nrun(req.body)", []), ("const run = (a) => a\ndb.query(a)\nrun(req.body)", []),
    ("const r = /[/'\"]x(/g.test(a) ? b / 2 : eval(c)", ["ast.eval-dynamic"]), ("const r = /[/'\"(]x/g.test(a) ? b / 2 : eval(c)", ["ast.eval-dynamic"]), ("if (a) { eval(b) } }", None), ("<p>Don't</p>", None), ("", []), ("a\n.b\n.exec(x)", ["ast.command-injection"]),
    ("const t = `a ${`b ${eval(x)}`} c`", ["ast.eval-dynamic"]), ("User?.create?.(req.body)", ["ast.mass-assignment"]), ("class A { exec(a) { return 1 } }", []),
]


@pytest.mark.parametrize("text,rules", CASES)
def test_rules(text, rules):
    parsed, hits = S.findings_of(text)
    assert parsed == (rules is not None) and [h["rule_id"] for h in hits] == (rules or [])


def test_places_and_long_texts():
    hits = S.findings_of("const a = 1\n  db.users.find(\n req.query)\nawait new User(req.body)")[1]
    assert [(h["line"], h["column"]) for h in hits] == [(2, 3), (4, 7)]
    parsed, hits = S.findings_of("f(`x ${a}`, { k: [1, 2] });\n" * 40_000 + "eval(x)")
    assert parsed and [h["line"] for h in hits] == [40_001]


def test_files(spark):
    rows = [("a.js", "eval(x)"), ("a.js", "eval(x)"), ("b.ts", None), ("c.py", "eval(x)"), ("d.jsx", "<p>Don't</p>"), (None, "eval(x)")]
    files = spark.createDataFrame(rows, "file string, content string")
    assert sorted((r["file"], r["rule_id"]) for r in S.structural(files).collect()) == [("a.js", "ast.eval-dynamic")] * 2
    found = spark.createDataFrame([("a.js", "code.eval"), ("a.js", "secret.x"), ("d.jsx", "code.eval"), (None, "code.eval")], "file string, rule_id string")
    kept = S.replace_line_rules(found, S.analysed(files)).collect()
    assert sorted((r["file"] or "", r["rule_id"]) for r in kept) == [("", "code.eval"), ("a.js", "secret.x"), ("d.jsx", "code.eval")]
    assert S.structural(files.where("false")).count() == 0
