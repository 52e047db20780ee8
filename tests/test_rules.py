import re

import pytest

from sparrowhawk.operators import rules as R
from sparrowhawk.operators import taint as T
from sparrowhawk.operators.catalog import CORE, Rule
from sparrowhawk.plans.samples import PAIRS
from sparrowhawk.sources import files as S

COMPILED = [R.Compiled(r) for r in CORE]


@pytest.mark.parametrize("rule, fires, quiet", PAIRS)
def test_pairs(rule, fires, quiet):
    hit = lambda line: rule in {h["rule_id"] for h in R.hits_of("a.js", line, COMPILED)}
    assert hit(fires) and not hit(quiet)


def test_every_core_rule_has_a_pair():
    assert {p[0] for p in PAIRS} == {r.id for r in CORE}


def test_clean_file_is_quiet():
    code = "const express = require('express');\nconst key = process.env.API_KEY;\napp.get('/x', auth, handler);\n// a comment about eval()\ndb.query('SELECT a FROM t WHERE id = $1', [id]);\n"
    assert R.hits_of("a.js", code, COMPILED) == []


def test_literals_never_hide_a_match():
    for c in COMPILED:
        for _, fires, _ in (p for p in PAIRS if p[0] == c.rule.id):
            for m in c.pattern.finditer(fires):
                assert c.may_match(m[0].lower())


def test_long_lines_and_paths():
    assert R.hits_of("a.js", "eval(" + "x" * 4100, COMPILED) == []
    assert R.hits_of("a.py", "q = \"SELECT a FROM t WHERE id = '\" + id", COMPILED) == []


def test_pathological_lines_are_fast():
    import time

    t = time.time()
    for line in ("a" * 3900, "(" * 3900, "SELECT " * 550, "`" * 3900, "password " * 430, "{" * 3900, "console.log(" * 320):
        R.hits_of("a.js", line, COMPILED)
    assert time.time() - t < 6


def test_findings_frame(spark):
    files = spark.createDataFrame([("a.js", "x\r\neval(y)\r\n"), ("b.js", None), (None, "eval(z)")], "file string, content string")
    got = sorted((str(r["file"]), r["line"], r["column"], r["rule_id"], r["confidence"]) for r in R.match_rules(files).collect())
    assert got == [("None", 1, 1, "code.eval", "low"), ("a.js", 2, 1, "code.eval", "low")]


def test_custom_rules():
    own = R.custom_rules({"customRules": [{"id": "my corp/no", "re": "foo", "severity": "low", "cwe": "CWE-1"}, {"id": "x", "re": "("}, {"re": "y"}, None]})
    assert [(r.id, r.severity, r.confidence, r.cwe) for r in own] == [("my-corp-no", "low", "medium", "CWE-1")]
    assert [h["rule_id"] for h in R.hits_of("f", "a FOO b", [R.Compiled(r) for r in own])] == ["my-corp-no"]


def test_file_rules(spark):
    rows = [
        ("Dockerfile", "FROM node\nENV DB_PASSWORD=x\nADD https://a/b /c"), ("ok/Dockerfile", "FROM node:20\nUSER app"), (".github/workflows/a.yml", "run: echo ${{ github.event.x }}\nuses: a/b@v1\nuses: a/b@" + "0" * 40 + "\npermissions: write-all"),
        ("a.tf", 'cidr_blocks = ["0.0.0.0/0"]\nacl = "public-read"'), ("k.yaml", "kind: Pod\nprivileged: true"), ("other.yaml", "privileged: true"), ("docker-compose.yml", "- /var/run/docker.sock:/x\nnetwork_mode: host\nDB_PASSWORD: abc"),
        ("next.config.js", "module.exports = {}"), ("s.js", "app.post('/login', h)"), ("t.js", "app.post('/login', limiter, h)\nconst limiter = rateLimit()"), ("u.js", "multer({ dest: 'x' })"), ("v.js", "multer({ limits: {} })"),
    ]
    got = sorted((r["file"], r["line"], r["rule_id"]) for r in R.file_rules(spark.createDataFrame(rows, "file string, content string")).collect())
    assert got == sorted(
        [("Dockerfile", n, "iac.dockerfile") for n in (1, 1, 2, 3)] + [(".github/workflows/a.yml", n, "iac.github-actions") for n in (1, 2, 4)] + [("a.tf", 1, "iac.terraform"), ("a.tf", 2, "iac.terraform"), ("k.yaml", 2, "iac.kubernetes")]
        + [("docker-compose.yml", n, "iac.docker-compose") for n in (1, 2, 3)] + [("next.config.js", 1, "nextjs.missing-security-headers"), ("s.js", 1, "ratelimit.missing-on-auth"), ("u.js", 1, "upload.unrestricted-multer")]
    )


PACK = r"""
const goRules = [
  { id: 'go.sql', severity: 'high', confidence: 'high', title: 'It\'s SQL', re: /db\.Query\([^)]*\+/i, fileFilter: /\.go$/, skipComments: true, cwe: 'CWE-89' },
  {
    id: "go.exec",
    severity: 'critical',
    title: 'exec',
    re: /exec\.Command\([^\/]*[^]*x/,
    message: 'm',
  },
  { id: 'go.none', severity: 'low', title: 'no pattern' },
  { id: 'go.dead', severity: 'low', title: 'dead', re: /zzz/ },
];
"""


def test_rule_pack(spark, tmp_path):
    (tmp_path / "pack.js").write_text(PACK)
    pack = S.rule_pack(spark, f"file://{tmp_path}/pack.js", dead=("go.dead",))
    assert [(r.id, r.severity, r.title, r.ignore_case, r.file_filter, r.skip_comments, r.enabled) for r in pack] == [
        ("go.sql", "high", "It's SQL", True, r"\.go$", True, True), ("go.exec", "critical", "exec", False, None, False, True), ("go.dead", "low", "dead", False, None, False, False),
    ]
    files = spark.createDataFrame([("a.go", "db.query(a + b)\nzzz"), ("a.py", "db.query(a + b)")], "file string, content string")
    assert [(r["file"], r["rule_id"]) for r in R.match_rules(files, pack).collect()] == [("a.go", "go.sql")]
    assert S.rules_table(spark, CORE).count() == len(CORE)
    (tmp_path / "pack.json").write_text('{"id": "j.x", "severity": "low", "pattern": "q+", "title": "t", "other": 1}\n')
    assert S.rule_pack(spark, f"file://{tmp_path}/pack.json") == [Rule("j.x", "low", "q+", "t")]


JS = [
    ("const id = req.params.id;\nconst q = 'x' + id;\ndb.query(q);", ["taint.sql-injection"]), ("db.query(req.body.q)", []), ("const id = req.params.id;\ndb.query('a $1', [id]);", []), ("const { a, b: c } = req.body\nexec(c)", ["taint.command-injection"]),
    ("const a = req.body.x\nconst s = 'a'\nfetch('a')", []), ("let u = req.query.u\nres.redirect(u)", ["taint.open-redirect"]), ("const a = 1\nexec(a)", []), ("const a = req.body\n// exec(a)", []), ("const a = req.url\nif (a == b) c = 1\nfs.readFile(c)", []),
]


@pytest.mark.parametrize("code, want", JS)
def test_js_flows(code, want):
    assert [f["rule_id"] for f in T.js_flows(code.split("\n"))] == want


PY = [
    ("a = input()\neval(a)", ["py.taint.code-injection"]), ("a = int(input())\nx = int(a)\neval(x)", []), ("a = input()\na = 'safe'\neval(a)", []), ("def f():\n    a = input()\nos.system(a)", []), ("a = request.args.get('q')\ncursor.execute('x %s', (a,))", []),
    ("a = request.args.get('q')\ncursor.execute(f'x {a}')", ["py.taint.sql-injection"]), ("a = sys.argv[1]\nb = shlex.quote(a)\nos.system(b)", []), ("a = sys.argv[1]\nopen(a)", ["py.taint.path-traversal"]), ("# a = input()\n# eval(a)", []),
]


@pytest.mark.parametrize("code, want", PY)
def test_py_flows(code, want):
    assert [f["rule_id"] for f in T.py_flows(code.split("\n"))] == want


def test_equal_files_are_analysed_once_and_all_reported(spark):
    code = "a = input()\neval(a)"
    files = spark.createDataFrame([("a.py", code), ("b.py", code), ("c.txt", code)], "file string, content string")
    assert {r["file"] for r in T.flows(files).collect()} == {"a.py", "b.py"}


def test_patterns_are_ascii():
    assert all(c.pattern.flags & re.A for c in COMPILED)


def test_line_rules_runs_core_and_a_named_pack(spark, tmp_path):
    from sparrowhawk import registry

    (tmp_path / "pack.js").write_text(PACK)
    spark.createDataFrame([(1, "export default zzz\nconst a = eval(b)", "web")], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "<p>")], "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    found = lambda: [(r["rule_id"], r["line"]) for r in registry.QUERIES["line_rules"](spark, str(tmp_path)).orderBy("line").collect()]
    assert found() == [("code.eval", 2)]
    spark.conf.set(S.PACK_KEY, f"file://{tmp_path}/pack.js")
    try:
        assert len(S.catalogue(spark)) == len(CORE) + 3 and found() == [("go.dead", 1), ("code.eval", 2)]
    finally:
        spark.conf.unset(S.PACK_KEY)


GUARDED = r"""
  { id: 'a.env', severity: 'high', title: 't', re: /secret_\w+/, filter: (line) => !/process\.env|your_/i.test(line), message: 'm' },
  { id: 'a.helmet', severity: 'low', title: 't', re: /express\(\)/, filter: (line, content, lines) => !lines.some(l => /helmet/i.test(l)), message: 'm' },
"""


def test_filters_of_a_pack(spark, tmp_path):
    (tmp_path / "pack.js").write_text(GUARDED)
    pack = S.rule_pack(spark, f"file://{tmp_path}/pack.js")
    assert [(r.unless_line, r.unless_file, r.derived_confidence) for r in pack] == [("(?i)process\\.env|your_", None, "medium"), (None, "(?i)helmet", "medium")]
    files = [("a.js", "x = secret_ab\ny = process.env.secret_ab"), ("b.js", "app = express()"), ("c.js", "app = express()\napp.use(Helmet())")]
    got = R.match_rules(spark.createDataFrame(files, "file string, content string"), pack).collect()
    assert sorted((r["file"], r["line"], r["rule_id"]) for r in got) == [("a.js", 1, "a.env"), ("b.js", 1, "a.helmet")]


def test_content_is_not_carried_with_lines(spark):
    files = spark.createDataFrame([("a.js", "x")], "file string, content string")
    plan = R.file_rules(files)._jdf.queryExecution().optimizedPlan().toString()
    assert all("content" not in x.split("posexplode", 1)[1].split("[", 2)[-1] for x in plan.split("\n") if "Generate posexplode" in x), plan


PY_MORE = [
    ("a = input()\nif x:\n    os.system(f'ls {a}')", [("py.taint.command-injection", 3, "medium")]), ("a = input()\nb = a + 'x'\nsubprocess.run(\n    b,\n    shell=True)", [("py.taint.command-injection", 3, "high")]),
    ("if x:\n    a = input()\neval(a)", []), ("a, b = input(), 1\neval(b)", [("py.taint.code-injection", 2, "medium")]), ("a = input()\ncursor.execute(\"q\", a)", [("py.taint.sql-injection", 2, "medium")]),
    ("a = input()\nwith open(a) as f:\n    pass", [("py.taint.path-traversal", 2, "medium")]), ("a = input()\nprint 'two'\neval(a)", [("py.taint.code-injection", 3, "medium")]), ("a = input()\n\"\"\"\neval(a)\n\"\"\"", []),
    ("a = input()\na += '!'\neval(a)", [("py.taint.code-injection", 3, "medium")]), ("x = 'a = input()'\neval(x)", []), ("def f(a):\n    b = request.args.get('q')\n    return pickle.loads(b)", [("py.taint.deserialization", 3, "medium")]), ("def (:\n", []),
]


@pytest.mark.parametrize("code, want", PY_MORE)
def test_py_flows_by_syntax(code, want):
    assert [(f["rule_id"], f["line"], f["confidence"]) for f in T.py_flows(code.split("\n"))] == want


def test_assignments_of_a_line():
    for line, want in [("const { a, b: c = 1 } = req.body", ["a", "c"]), ("x = y", ["x"]), ("a.b = y", []), ("if (a == b) c", []), ("if (a === b) c = 1", ["c"]), ("const f = (x) => x", ["f"]), ("let s = 'a=b'", ["s"]), ("s('a=b')", []), ("a <= b", []), ("a += b", [])]:
        assert T.js_assigned(line)[0] == want, line


def test_cross_file_facts_are_taken_once(spark):
    files = [("a.js", "export function run(x) {\n  exec(x)\n}"), ("b.js", "import { run } from './a'\nfunction h(req) {\n  run(req.body.c)\n}"), ("c.js", "export function go(x) {\n  fetch(x)\n}\nfunction t(req) {\n  go(req.query.u)\n}")]
    got = T.cross_file_flows(spark.createDataFrame(files, "file string, content string"))
    assert sorted((r["file"], r["line"], r["rule_id"], r["hops"]) for r in got.collect()) == [("b.js", 3, "taint.command-injection", 0), ("c.js", 5, "taint.ssrf", 0)]
    assert len(re.findall("ArrowEvalPython", got._jdf.queryExecution().optimizedPlan().toString())) == 0 or "InMemoryRelation" in got._jdf.queryExecution().optimizedPlan().toString()
