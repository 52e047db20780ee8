"""Line rules over files: one Arrow pass in which the whole catalogue meets each line."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import replace

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions.text import ANON_KEY, ENV_REFERENCE, PLACEHOLDER, PUBLIC_KEY_NAME, PUBLIC_KEY_VALUE, fingerprint, needed_literals
from .catalog import CORE, PII_FIELD, SECRET_FIELD, SHAPING, Rule
from .lines import LONG_LINE

COMMENT = re.compile(r"\s*(?://|#|\*|/\*)")
HIT = "array<struct<line:int,column:int,rule_id:string,severity:string,confidence:string,title:string,cwe:string,snippet:string>>"


# -- predicates that rules name ---------------------------------------------------------------------------

def _i(pattern: str):
    return re.compile(pattern, re.I | re.A)


#: Weak secrets, shapes of SQL, public routes, and the patterns of the predicates below.
_PLACEHOLDER, _ENV, _PUBLIC, _PUBLIC_NAME, _ANON = _i(PLACEHOLDER), re.compile(ENV_REFERENCE), re.compile(PUBLIC_KEY_VALUE), _i(PUBLIC_KEY_NAME), _i(ANON_KEY)
WEAK = _i(r"^(?:secret|secretkey|keyboard cat|changeme|change[_-]?me|password|passwd|123456|test|dev|mysecret|supersecret|topsecret|shhh+|admin|token|jwt|s3cr3t)$")
SQL_SHAPES = [_i(r"\bSELECT\b.*\bFROM\b"), _i(r"\bINSERT\s+INTO\b.*(?:\bVALUES\b|\()"), _i(r"\bUPDATE\b.*\bSET\b"), _i(r"\bDELETE\s+FROM\b.*\bWHERE\b")]
SQL_VALUE = _i(r"(?:WHERE|SET|VALUES|LIKE|IN|=|<|>)[^;]*?(?:`[^`]*\$\{|['\"]\s*\+|\+\s*['\"])")
PUBLIC_ROUTE = re.compile(r"login|signin|sign-in|signup|sign-up|register|logout|webhook|health|healthz|ping|public|oauth|callback|csp-report")


def placeholder(value: str) -> bool:
    v = value.strip()
    return len(v) < 6 or bool(_PLACEHOLDER.search(v) or _ENV.search(v))


def public_key(line: str, value: str) -> bool:
    return bool(_PUBLIC.search(value) or _PUBLIC_NAME.search(line) or _ANON.search(line))


def inside_string(line: str, at: int) -> bool:
    """Whether a quote is open at a place of the line."""
    quote, escaped = "", False
    for c in line[:at]:
        if escaped:
            escaped = False
        elif quote and c == "\\":
            escaped = True
        elif c == quote:
            quote = ""
        elif not quote and c in "\"'`":
            quote = c
    return bool(quote)


def call_arguments(line: str, opened: int) -> str | None:
    """What stands between a call's parentheses; None if they aren't closed on the line."""
    depth = 0
    for m in re.finditer(r"\"(?:\\.|[^\"\\])*\"?|'(?:\\.|[^'\\])*'?|`(?:\\.|[^`\\])*`?|[()]", line[opened:]):
        depth += {"(": 1, ")": -1}.get(m[0], 0)
        if depth == 0:
            return line[opened + 1 : opened + m.start()]
    return None


def leaks(field: str, shaping: tuple[str, ...] = ()):
    pattern, shaped = _i(field), _i(r"\b(?:" + "|".join([*SHAPING, *shaping]) + r")\s*\(")

    def test(line, m):
        inner = call_arguments(line, m.end() - 1)
        return inner is not None and bool(pattern.search(inner)) and not shaped.search(inner)

    return test


def _unowned(line, m):
    return not re.search(r"req\.user|userId|owner|tenant|req\.session\.user|accountId", line, re.I) and bool(re.search(r"^id$|Id$|uuid|_id|pk$|slug$|key$", m[1]) or re.search("findById|findByPk", line))


def _comparison(line, m):
    if re.search(r"process\.env|test|expect\(|assert|describe\(|it\(", line, re.I):
        return False
    return not re.search(r"\b(?:role|isAdmin|admin)\b", line, re.I) or bool(re.search(r"letmein|backdoor|god|secret|bypass|master|root", line, re.I))


def _connection(line, m):
    return not re.search(r":\/\/(?:user|username|root|admin):(?:pass|password|changeme|xxx+|\.\.\.)@", m[0], re.I) and not re.match(r"(?:mongodb|postgres(?:ql)?|mysql|redis):\/\/", m[0], re.I)


#: Filters that look for a field in what a call gives away, unless a shaping function takes it out.
LEAKS = {"leaks_secret_property": rf"\.(?:{SECRET_FIELD})\b", "leaks_pii_property": rf"\.(?:email|phone|{PII_FIELD})\b", "leaks_secret_word": rf"\b(?:{SECRET_FIELD})\b"}
#: name -> (line, match) -> whether the hit stays
FILTERS = {
    "mixed_case_body": lambda line, m: all(re.search(p, m[0].partition(":")[2]) for p in ("[A-Z]", "[a-z]", "[0-9]")),
    "not_a_re_word": lambda line, m: not re.search(r"\bre_(?:export|run|try|use|new|set|get|map|do)\b", line, re.I),
    "real_connection": _connection,
    "real_credential": lambda line, m: not placeholder(m[2]) and not public_key(line, m[2]),
    "real_sql": lambda line, m: any(p.search(line) for p in SQL_SHAPES) and bool(SQL_VALUE.search(line)),
    "not_a_namespace": lambda line, m: not re.search(r"xmlns|w3\.org|schemas?\.|\.dtd|\.xsd", line, re.I),
    "weak_secret": lambda line, m: not placeholder(m[1]) or bool(WEAK.search(m[1].strip())) or len(m[1]) < 16,
    "real_first_group": lambda line, m: not placeholder(m[1]),
    "unowned_id": _unowned,
    "private_route": lambda line, m: not PUBLIC_ROUTE.search(m[1].lower()),
    "suspicious_comparison": _comparison,
    **{name: leaks(field) for name, field in LEAKS.items()},
    "no_http_only": lambda line, m: (a := call_arguments(line, m.end() - 1)) is not None and "httponly" not in a.lower(),
    "upload_context": lambda line, m: bool(re.search(r"file|upload|multer|req\.file|\.originalname", line, re.I)),
}


class Compiled:
    """A rule made ready in a worker: pattern, literals of which one must be there, predicate."""

    __slots__ = ("rule", "pattern", "literals", "keep", "files", "line_guard", "file_guard")

    def __init__(self, rule: Rule):
        self.rule = rule
        self.pattern = re.compile(rule.pattern.replace("[^]", r"[\s\S]"), re.A | (re.I if rule.ignore_case else 0))
        self.literals = tuple(sorted(needed_literals(self.pattern.pattern) or ()))
        self.keep = leaks(LEAKS[rule.filter], rule.shaping) if rule.shaping and rule.filter in LEAKS else FILTERS.get(rule.filter)
        self.files = re.compile(rule.file_filter) if rule.file_filter else None
        self.line_guard = re.compile(rule.unless_line) if rule.unless_line else None
        self.file_guard = re.compile(rule.unless_file) if rule.unless_file else None

    def may_match(self, low: str) -> bool:
        """Whether a lower-cased text has what every match has."""
        return not self.literals or any(x in low for x in self.literals)


#: Once in each worker: re itself keeps fewer patterns than a catalogue has.
_ready: dict[Rule, Compiled] = {}


def ready(rule: Rule) -> Compiled:
    if rule not in _ready:
        _ready[rule] = Compiled(rule)
    return _ready[rule]


def masked(line: str, match: str) -> str:
    out = line.replace(match, f"{match[:4]}****{match[-2:]}") if len(match) >= 8 else line
    return out if len(out) <= 160 else out[:157] + "..."


def hits_of(path: str, content: str, rules: list[Compiled]) -> list[dict]:
    """Findings of one file. A line over LONG_LINE characters is not searched; the file's literals rule out most rules first."""
    low = content.lower()
    active = [r for r in rules if r.may_match(low) and (r.files is None or r.files.search(path)) and not (r.file_guard and r.file_guard.search(content))]
    if not active:
        return []
    out = []
    for n, line in enumerate(re.split(r"\r?\n", content), 1):
        if not line or len(line) > LONG_LINE:
            continue
        low, comment = line.lower(), bool(COMMENT.match(line))
        for c in active:
            r = c.rule
            if comment and r.skip_comments or not c.may_match(low):
                continue
            for m in c.pattern.finditer(line):
                if r.skip_in_string and inside_string(line, m.start()) or c.keep and not c.keep(line, m) or c.line_guard and c.line_guard.search(line):
                    continue
                out.append({"line": n, "column": m.start() + 1, "rule_id": r.id, "severity": r.severity, "confidence": r.derived_confidence, "title": r.title, "cwe": r.cwe, "snippet": masked(line, m[0])})
    return out


def match_rules(files: DataFrame, rules: Iterable[Rule] = CORE) -> DataFrame:
    """Findings of files (file, content) by line rules: rule_id, severity, confidence, title, cwe, file, line, column, snippet, fingerprint."""
    chosen = [r for r in rules if r.enabled and r.pattern]

    @F.pandas_udf(HIT)
    def run(paths: pd.Series, contents: pd.Series) -> pd.Series:
        compiled = [ready(r) for r in chosen]
        return pd.Series([hits_of(p or "", c, compiled) if c else [] for p, c in zip(paths, contents)], dtype=object)

    rows = files.select("file", F.explode(run("file", "content")).alias("h")).select("file", "h.*")
    return rows.withColumn("fingerprint", fingerprint(F.col("rule_id"), F.col("file"), F.col("snippet")))


def shaping_functions(config: dict) -> tuple[str, ...]:
    r"""A configuration's shapingFunctions: names, in which \w and * may stand; anything else is left out."""
    names = [x for x in config.get("shapingFunctions") or [] if isinstance(x, str) and re.fullmatch(r"[\w\\*]+", x, re.A)]
    out = []
    for name in names:
        try:
            re.compile(name)
        except re.error:
            continue
        out.append(name)
    return tuple(out)


def with_shaping(rules: Iterable[Rule], names: tuple[str, ...]) -> list[Rule]:
    """Rules whose filters for leaks know further shaping functions."""
    return [replace(r, shaping=(*r.shaping, *names)) if names and r.filter in LEAKS else r for r in rules]


def custom_rules(config: dict) -> list[Rule]:
    """Rules of a configuration's customRules; ids are cleaned, unknown severities high, patterns that don't compile skipped."""
    out = []
    for r in config.get("customRules") or []:
        if not isinstance(r, dict) or not isinstance(r.get("id"), str) or not isinstance(r.get("re"), str) or not r["re"]:
            continue
        try:
            re.compile(r["re"])
        except re.error:
            continue
        severity = r.get("severity") if r.get("severity") in ("critical", "high", "medium", "low") else "high"
        out.append(Rule(re.sub(r"[^A-Za-z0-9._-]", "-", r["id"][:64]), severity, r["re"], str(r.get("title") or r["id"]), r.get("confidence") or "medium", str(r.get("cwe") or "CWE-710"), True, skip_comments=False))
    return out


# -- file rules ------------------------------------------------------------------------------------------------

#: Rules of infrastructure files, by line: id, severity, path, line's pattern, pattern that excuses it.
FILE_LINE_RULES = [
    ("iac.dockerfile", "high", r"(?i)(?:^|/)dockerfile$|\.dockerfile$", r"(?i)^\s*(?:ENV|ARG)\s+\w*(?:PASSWORD|SECRET|TOKEN|API_?KEY|PRIVATE_KEY|CREDENTIAL)\w*\s*[=\s]", None),
    ("iac.dockerfile", "medium", r"(?i)(?:^|/)dockerfile$|\.dockerfile$", r"(?i)^\s*ADD\s+https?:\/\/", None),
    ("iac.dockerfile", "low", r"(?i)(?:^|/)dockerfile$|\.dockerfile$", r"(?i)^\s*FROM\s+(?:\S+:latest(?=\s|$)|[^\s:@]+(?=\s|$))", None),
    ("iac.github-actions", "high", r"\.github/workflows/.+\.(?:yml|yaml)$", r"\$\{\{\s*github\.(?:event|head_ref|pull_request)[^}]*\}\}", r"\benv\s*:"),
    ("iac.github-actions", "medium", r"\.github/workflows/.+\.(?:yml|yaml)$", r"(?i)permissions:\s*write-all", None),
    ("iac.github-actions", "high", r"\.github/workflows/.+\.(?:yml|yaml)$", r"(?i)pull_request_target", None),
    ("iac.github-actions", "medium", r"\.github/workflows/.+\.(?:yml|yaml)$", r"(?i)curl[^|\n]*\|\s*(?:bash|sh)\b|wget[^|\n]*-O-[^|\n]*\|\s*(?:bash|sh)\b", None),
    ("iac.github-actions", "low", r"\.github/workflows/.+\.(?:yml|yaml)$", r"^\s*-?\s*uses:\s*[\w.\-]+\/[\w.\-]+@[\w.\-]+\s*$", r"@[0-9a-f]{40}\s*$"),
    ("iac.terraform", "high", r"\.(?:tf|hcl)$", r"cidr_blocks?\s*=\s*\[?\s*\"0\.0\.0\.0\/0\"", None),
    ("iac.terraform", "high", r"\.(?:tf|hcl)$", r"acl\s*=\s*\"public-read(?:-write)?\"", None),
    ("iac.terraform", "medium", r"\.(?:tf|hcl)$", r"\"(?:Action|Resource)\"\s*:\s*\"\*\"|actions?\s*=\s*\[\s*\"\*\"\s*\]", None),
    ("iac.docker-compose", "high", r"(?:^|/)(?:docker-)?compose\.(?:ya?ml)$", r"(?i)docker\.sock", None),
    ("iac.docker-compose", "medium", r"(?:^|/)(?:docker-)?compose\.(?:ya?ml)$", r"(?i)network_mode:\s*[\"']?host[\"']?", None),
    ("iac.docker-compose", "high", r"(?:^|/)(?:docker-)?compose\.(?:ya?ml)$", r"\b(?:[A-Z_]*?(?:PASSWORD|SECRET|TOKEN|API_?KEY|PRIVATE_?KEY|CREDENTIAL)[A-Z_]*?)\s*[:=]\s*[^$\"'*\s]", r"^\s*#"),
]
#: Files of Kubernetes, and what must not stand in them.
KUBERNETES = r"\b(?:apiVersion|kind):\s*(?:Deployment|Pod|StatefulSet|DaemonSet|Job|CronJob)\b"
KUBERNETES_LINES = [
    ("high", r"(?i)privileged:\s*true"), ("medium", r"(?i)runAsUser:\s*0\b"), ("medium", r"(?i)hostNetwork:\s*true|hostPID:\s*true|hostIPC:\s*true"), ("medium", r"(?i)allowPrivilegeEscalation:\s*true"),
    ("medium", r"(?i)default-token|automountServiceAccountToken:\s*true"), ("medium", r"capabilities:.{0,80}?add:.{0,40}?(?:ALL|SYS_ADMIN|NET_ADMIN)|add:\s*\[\s*(?:ALL|SYS_ADMIN|NET_ADMIN)"),
]
#: A line that needs a guard somewhere in its file: id, severity, what must be in the file, the line, the guard.
UNGUARDED = [
    ("ratelimit.missing-on-auth", "medium", None, r"(?i)\bapp\.(?:post|put)\s*\(\s*['\"]([^'\"]*(?:login|signin|sign-in|auth|register|signup|sign-up|password|reset|token|otp)[^'\"]*)['\"]", r"(?i)rate[-\s]?limit|ratelimit|express-rate-limit|slow[-\s]?down|slowDown|\blimiter\b|throttle|express-brute|bruteforce"),
    ("upload.unrestricted-multer", "medium", None, r"\bmulter\s*\(", r"fileFilter|limits\s*:"),
]


def file_rules(files: DataFrame) -> DataFrame:
    """rule_id, severity, file, line of rules that look at whole files (file, content): infrastructure, missing guards, missing headers."""
    f, c, t = F.col("file"), F.col("content"), F.col("text")
    docker = r"(?i)(?:^|/)dockerfile$|\.dockerfile$"
    # What holds for a file as a whole is found once; lines carry these flags, and no content.
    paths = list(dict.fromkeys(path for _, _, path, _, _ in FILE_LINE_RULES))
    flags = {f"p{i}": f.rlike(p) for i, p in enumerate(paths)} | {"k": f.rlike(r"\.ya?ml$") & c.rlike(KUBERNETES)} | {f"g{i}": c.rlike(guard) for i, (*_, guard) in enumerate(UNGUARDED)}
    flagged = files.select("file", F.struct(*[v.alias(k) for k, v in flags.items()]).alias("flags"), F.split("content", "\r?\n", -1).alias("texts"))
    lines = flagged.select("file", "flags", F.posexplode("texts").alias("_p", "text")).withColumn("line", F.col("_p") + 1)
    item = lambda test, i, s: F.when(test, F.struct(F.lit(i).alias("rule_id"), F.lit(s).alias("severity")))
    has = lambda name: F.col(f"flags.{name}")
    found = [item(has(f"p{paths.index(path)}") & t.rlike(p) & (~t.rlike(excuse) if excuse else F.lit(True)), i, s) for i, s, path, p, excuse in FILE_LINE_RULES]
    found += [item(has("k") & t.rlike(p), "iac.kubernetes", s) for s, p in KUBERNETES_LINES]
    found += [item(~has(f"g{n}") & t.rlike(p), i, s) for n, (i, s, _, p, _) in enumerate(UNGUARDED)]
    by_line = lines.select("file", "line", F.explode(F.array_compact(F.array(*found))).alias("h")).select("h.rule_id", "h.severity", "file", "line")
    root = f.rlike(docker) & ~c.rlike(r"(?im)^\s*USER\s+(?!root\b)\S+")
    headers = f.rlike(r"^next\.config\.(?:js|mjs|ts|cjs)$") & ~(c.rlike(r"headers\s*\(|async\s+headers") & c.rlike(r"(?i)Strict-Transport-Security|Content-Security-Policy|X-Frame-Options|X-Content-Type-Options|Referrer-Policy|Permissions-Policy"))
    whole = F.array_compact(F.array(item(root, "iac.dockerfile", "medium"), item(headers, "nextjs.missing-security-headers", "low")))
    by_file = files.select("file", F.lit(1).alias("line"), F.explode(whole).alias("h")).select("h.rule_id", "h.severity", "file", "line")
    return by_line.unionByName(by_file)
