"""Calls of JavaScript and TypeScript files by their structure: tokens and brackets instead of lines.

A file is cut into tokens (comments, strings, templates and regular expressions are told from
code) and its brackets are paired. Calls over several lines are seen whole, and nothing is seen
in comments and strings. A file whose tokens or brackets don't come out (JSX text, broken code) is
not read: it has no findings here, and the line rules stay responsible for it.

Cases: null contents and files of other kinds give no rows; equal rows are analysed once each;
a text is read in one pass, whatever its length.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, functions as F

FILES = re.compile(r"\.(?:js|jsx|mjs|cjs|ts|tsx|mts|cts)$", re.I)
HIT = "struct<parsed:boolean,hits:array<struct<rule_id:string,severity:string,confidence:string,cwe:string,line:int,column:int,snippet:string>>>"

#: Rules with severity and weakness; line rules that these replace in files that could be read.
RULES = {
    "ast.eval-dynamic": ("critical", "CWE-95"),
    "ast.function-constructor": ("critical", "CWE-95"),
    "ast.command-injection": ("high", "CWE-78"),
    "ast.path-traversal": ("high", "CWE-22"),
    "ast.ssrf": ("high", "CWE-918"),
    "ast.mass-assignment": ("high", "CWE-915"),
    "ast.nosql-injection": ("high", "CWE-943"),
    "taint.interprocedural": ("high", "CWE-20"),
}
REPLACED = ["validation.mass-assignment", "injection.nosql", "code.eval", "code.command-injection", "upload.path-traversal", "web.ssrf"]
#: Methods by what they do, and constructors that don't make records.
SHELL = {"exec", "execSync", "spawn", "spawnSync", "execFile", "execFileSync"}
FILE_METHODS = {"readFile", "readFileSync", "writeFile", "writeFileSync", "createReadStream", "createWriteStream", "unlink", "unlinkSync", "appendFile", "sendFile"}
WRITES = {"create", "save", "build", "insert", "insertOne", "insertMany", "update", "updateOne", "updateMany", "findOneAndUpdate"}
READS = {"find", "findOne", "findOneAndUpdate", "findOneAndDelete", "updateOne", "updateMany", "deleteOne", "deleteMany", "count", "countDocuments"}
REQUESTS = {"get", "post", "put", "delete", "request"}
BUILT_IN = re.compile(
    r"(?:Function|Boolean|Number|String|RegExp|Date|Array|Object|(?:Weak)?(?:Map|Set)|Promise|(?:Type|Range|Eval|Syntax|Reference|URI)?Error|Symbol|BigInt|DataView|(?:Shared)?ArrayBuffer|Buffer|Blob|FormData|Headers"
    r"|URL|URLSearchParams|Text(?:En|De)coder|AbortController|AbortSignal|Uint8ClampedArray|(?:Ui|I)nt(?:8|16|32)Array|Float(?:32|64)Array|Big(?:Ui|I)nt64Array)$"
)

_TOKEN = re.compile(
    r"(?P<space>\s+|//[^\n\r]*|/\*.*?\*/|\A\#![^\n]*)|(?P<str>\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*')|(?P<num>\d[\w.]*|\.\d[\w]*)|(?P<word>\#?[^\W\d][\w$]*|\$[\w$]*)"
    r"|(?P<sign>=>|\?\.(?!\d)|\.\.\.|[-+*/%&|^<>=!?]=+|&&|\|\||\?\?|[-+*/%&|^~<>=!?:;,.@\\])|(?P<open>[(\[{])|(?P<close>[)\]}])",
    re.S,
)
_REGEX = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*")
#: After these words a slash opens a regular expression, and a bracket doesn't call.
KEYWORDS = set("if for while switch catch with return typeof instanceof in of new delete void throw case do else yield await function async import super".split())
PAIRS = {"(": ")", "[": "]", "{": "}", "${": "}", "`": "`"}


class Unread(ValueError):
    """A file whose tokens or brackets don't come out."""


@dataclass
class Source:
    """Tokens (kind, text, offset), and for each bracket the place of its partner."""

    tokens: list[tuple[str, str, int]]
    partner: dict[int, int]
    starts: list[int]

    def place(self, i: int) -> tuple[int, int]:
        """Line and column, from 1, of a token."""
        at = self.tokens[i][2]
        line = bisect_right(self.starts, at)
        return line, at - self.starts[line - 1] + 1


def read(content: str) -> Source:
    """The tokens of a text with their brackets paired; raises Unread."""
    tokens: list[tuple[str, str, int]] = []
    partner: dict[int, int] = {}
    stack: list[int] = []
    at, size = 0, len(content)

    def put(kind, text):
        tokens.append((kind, text, at))

    def close(text):
        if not stack or PAIRS[tokens[stack[-1]][1]] != text:
            raise Unread(text)
        i = stack.pop()
        partner[i], partner[len(tokens)] = len(tokens), i
        put("close", text)

    def template(begin):
        """From a place within a template to its end or to its next expression."""
        end = begin
        while end < size:
            c = content[end]
            if c == "\\":
                end += 2
            elif c == "`":
                return end, "`"
            elif c == "$" and content.startswith("{", end + 1):
                return end, "${"
            else:
                end += 1
        raise Unread("`")

    while at < size:
        c = content[at]
        if c == "`":
            end, what = template(at + 1)
            if what == "`":
                put("str", content[at : end + 1])
                at = end + 1
            else:
                stack.append(len(tokens))
                put("open", "`")
                at = end
                stack.append(len(tokens))
                put("open", "${")
                at += 2
            continue
        if c == "}" and stack and tokens[stack[-1]][1] == "${":
            close("}")
            at, what = template(at + 1)
            if what == "`":
                close("`")
                at += 1
            else:
                stack.append(len(tokens))
                put("open", "${")
                at += 2
            continue
        if c == "/" and not content.startswith(("//", "/*"), at):
            kind, text, _ = tokens[-1] if tokens else ("", "", 0)
            if kind in ("", "open", "sign") or kind == "word" and text in KEYWORDS:
                if not (m := _REGEX.match(content, at)):
                    raise Unread("/")
                put("regex", m[0])
                at = m.end()
                continue
        m = _TOKEN.match(content, at)
        if not m:
            raise Unread(c)
        if m.lastgroup == "open":
            stack.append(len(tokens))
            put("open", c)
        elif m.lastgroup == "close":
            close(c)
        elif m.lastgroup != "space":
            put(m.lastgroup, m[0])
        at = m.end()
    if stack:
        raise Unread("end")
    return Source(tokens, partner, [0, *(m.end() for m in re.finditer(r"\n", content))])


@dataclass
class Call:
    start: int  # where the callee, or new, begins
    opened: int  # the bracket of the arguments
    name: str  # callee as object.method, or a name alone; empty for anything else
    method: str  # the last name if it is a member's
    new: bool
    arguments: list[tuple[int, int]]  # tokens of each, end exclusive


def pieces(s: Source, begin: int, end: int, sign: str = ",") -> list[tuple[int, int]]:
    """The parts between signs that aren't within brackets; none for no tokens."""
    out, last, i = [], begin, begin
    while i < end:
        kind, text, _ = s.tokens[i]
        if kind == "open":
            i = s.partner[i]
        elif kind == "sign" and text == sign:
            out.append((last, i))
            last = i + 1
        i += 1
    return out + [(last, end)] if last < end else out


def _chain_start(s: Source, i: int) -> int:
    """Where a chain of members, calls and indices that ends at a token begins."""
    while True:
        kind, text, _ = s.tokens[i]
        if kind == "close":
            i = s.partner[i]
            before = s.tokens[i - 1] if i else ("", "", 0)
            if before[0] == "close" or before[0] == "word" and before[1] not in KEYWORDS or before == "?.":
                i -= 1
                continue
        if i >= 2 and s.tokens[i - 1][1] in (".", "?."):
            i -= 2
            continue
        return i


def calls(s: Source) -> list[Call]:
    """Calls and constructions in the order of their brackets."""
    out = []
    for i, (kind, text, _) in enumerate(s.tokens):
        if kind != "open" or text != "(" or i == 0:
            continue
        k = i - 1 - (s.tokens[i - 1][1] == "?.")
        if k < 0 or s.tokens[k][0] != "word" or s.tokens[k][1] in KEYWORDS:
            continue
        word, before = s.tokens[k][1], s.tokens[k - 1][1] if k else ""
        end = s.partner[i]
        if before in ("function", "*") or before not in (".", "?.") and s.tokens[end + 1 : end + 2] and s.tokens[end + 1][1] in ("{", "=>"):
            continue  # a definition
        name, method = word, ""
        if before in (".", "?."):
            owner = s.tokens[k - 2] if k >= 2 else ("", "", 0)
            name, method = f"{owner[1] if owner[0] == 'word' and owner[1] != 'this' else ''}.{word}", word
        start = _chain_start(s, k)
        new = start > 0 and s.tokens[start - 1][1] == "new"
        out.append(Call(start - new, i, name, method, new, pieces(s, i + 1, end)))
    return out


def dynamic(s: Source, arg: tuple[int, int]) -> bool:
    """Whether an argument is anything but a literal."""
    begin, end = arg
    return end - begin != 1 or not (s.tokens[begin][0] in ("str", "num", "regex") or s.tokens[begin][1] in ("true", "false", "null"))


def from_request(s: Source, arg: tuple[int, int]) -> bool:
    """Whether an argument is req or a member of it, at any depth."""
    i, end = arg
    if i >= end or s.tokens[i][1] != "req":
        return False
    i += 1
    while i < end:
        if s.tokens[i][1] == "[":
            i = s.partner[i] + 1
        elif s.tokens[i][1] in (".", "?.") and i + 1 < end and s.tokens[i + 1][0] == "word":
            i += 2
        else:
            return False
    return True


def properties(s: Source, arg: tuple[int, int]) -> list[tuple[str, tuple[int, int]]]:
    """Keys and values of an argument that is an object in braces."""
    begin, end = arg
    if begin >= end or s.tokens[begin][1] != "{" or s.partner[begin] != end - 1:
        return []
    out = []
    for a, b in pieces(s, begin + 1, end - 1):
        if a < b:
            kind, key, _ = s.tokens[a]
            value = (a + 2, b) if b - a > 2 and s.tokens[a + 1][1] == ":" else (a, b)
            out.append((key[1:-1] if kind == "str" else key, value))
    return out


def mentions(s: Source, arg: tuple[int, int], name: str) -> bool:
    """Whether a name goes into an argument's value: not by way of an object, an index or a member of that name."""
    i, end = arg
    while i < end:
        kind, text, _ = s.tokens[i]
        if kind == "open" and text in ("{", "["):
            i = s.partner[i]
        elif kind == "word" and text == name and s.tokens[i - 1][1] not in (".", "?."):
            return True
        i += 1
    return False


def _last(name: str) -> str:
    return name.rpartition(".")[2]


def call_rules(s: Source, c: Call) -> list[tuple[str, str]]:
    """Rules that a call breaks, with what is shown of it."""
    out: list[tuple[str, str]] = []
    args = c.arguments
    first = args[0] if args else (0, 0)
    request_first = bool(args) and from_request(s, first)
    if c.new:
        if c.name == "Function" and any(dynamic(s, a) for a in args):
            out.append(("ast.function-constructor", "new Function(...)"))
        if not c.method and c.name[:1].isupper() and request_first and not BUILT_IN.match(c.name):
            out.append(("ast.mass-assignment", f"new {c.name}(req.*)"))
        return out
    if c.name == "eval" and args and dynamic(s, first):
        out.append(("ast.eval-dynamic", "eval(...)"))
    if _last(c.name) in SHELL and args and dynamic(s, first):
        out.append(("ast.command-injection", f"{c.name}(...)"))
    if (c.method in FILE_METHODS or c.name in ("path.join", "path.resolve")) and any(from_request(s, a) for a in args):
        out.append(("ast.path-traversal", f"{c.name}(req.*)"))
    if request_first and (_last(c.name) in ("fetch", "got") or c.method in REQUESTS and re.search("axios|http|got", c.name)):
        out.append(("ast.ssrf", f"{c.name}(req.*)"))
    if c.name == "Object.assign" and any(from_request(s, a) for a in args[1:]) or c.method in WRITES and request_first:
        out.append(("ast.mass-assignment", f"{c.name}(req.*)"))
    if c.method in READS and (request_first or any(from_request(s, v) for _, v in properties(s, first))) or any(k == "$where" for a in args for k, _ in properties(s, a)):
        out.append(("ast.nosql-injection", f"{c.name}(...)"))
    return out


def reaches_sink(s: Source, c: Call, name: str) -> bool:
    """Whether a call is dangerous and a name goes into one of its arguments."""
    last = _last(c.name)
    dangerous = (
        c.name == "eval" or last in SHELL | {"fetch"} or c.method in ("query", "raw", "execute", "join", "resolve") or last in ("get", "request")
        or c.method == "post" and re.search("axios|http|got", c.name) or re.search("readFile|writeFile|sendFile", c.method)
    )
    return bool(dangerous) and any(mentions(s, a, name) for a in c.arguments)


def functions(s: Source) -> list[tuple[str, str, int, int]]:
    """Name, first parameter, and the body's tokens of functions whose first parameter is a plain name."""
    out = []
    word = lambda i: s.tokens[i][1] if 0 <= i < len(s.tokens) else ""
    for i, (kind, text, _) in enumerate(s.tokens):
        name = ""
        if text == "function" and kind == "word":
            at = i + 1 + (word(i + 1) == "*")
            if at < len(s.tokens) and s.tokens[at][0] == "word":
                name, at = word(at), at + 1
            else:
                k = i - (word(i - 1) == "async")
                name = word(k - 2) if word(k - 1) == "=" and word(k - 3) in ("const", "let", "var") else ""
            if not name or word(at) != "(":
                continue
            params, after = pieces(s, at + 1, s.partner[at]), s.partner[at] + 1
        elif text == "=>" and kind == "sign":
            close = s.tokens[i - 1][0] == "close"
            begin = s.partner[i - 1] if close else i - 1
            k = begin - (word(begin - 1) == "async")
            if word(k - 1) != "=" or word(k - 3) not in ("const", "let", "var"):
                continue
            name, after = word(k - 2), i + 1
            params = pieces(s, begin + 1, i - 1) if close else [(begin, i)]
        else:
            continue
        if not params or params[0][0] + 1 != params[0][1] and word(params[0][0] + 1) != ":" or s.tokens[params[0][0]][0] != "word":
            continue
        if word(after) == "{":
            end = s.partner[after]
        elif text == "=>":
            end = _enclosing(s, after)
            for sign in (";", ","):
                end = pieces(s, after, end, sign)[0][1] if after < end else end
            # without a semicolon the body ends with its line, brackets apart
            line = s.place(after)[0] if after < end else 0
            k = after
            while k < end and (s.place(k)[0] == line or word(k - 1) in ("=>", ".", "+", "&&", "||", "?", ":") or word(k) in (".", "?.", "+", "&&", "||", "?", ":")):
                k = s.partner[k] if s.tokens[k][0] == "open" else k
                line = s.place(k)[0]
                k += 1
            end = k
        else:
            continue
        out.append((name, word(params[0][0]), after, end))
    return out


def _enclosing(s: Source, i: int) -> int:
    """The bracket that closes around a token, or the end."""
    while i < len(s.tokens):
        kind = s.tokens[i][0]
        if kind == "close":
            return i
        i = s.partner[i] + 1 if kind == "open" else i + 1
    return len(s.tokens)


def findings_of(content: str) -> tuple[bool, list[dict]]:
    """Whether a text could be read, and what its calls break."""
    try:
        s = read(content)
    except Unread:
        return False, []
    found = calls(s)
    out = [(c, rule, "high", shown) for c in found for rule, shown in call_rules(s, c)]
    opened = [c.opened for c in found]
    passes_on = set()
    for name, param, begin, end in functions(s):
        if any(reaches_sink(s, c, param) for c in found[bisect_right(opened, begin - 1) : bisect_right(opened, end - 1)]):
            passes_on.add(name)
    out += [(c, "taint.interprocedural", "medium", f"{c.name}(req.*)") for c in found if not c.new and not c.method and c.name in passes_on and any(from_request(s, a) for a in c.arguments)]
    hits = []
    for c, rule, confidence, shown in out:
        line, column = s.place(c.start)
        severity, cwe = RULES[rule]
        hits.append({"rule_id": rule, "severity": severity, "confidence": confidence, "cwe": cwe, "line": line, "column": column, "snippet": shown})
    return True, hits


def analysed(files: DataFrame) -> DataFrame:
    """file, parsed, hits of files (file, content) of the kinds that are read."""

    @F.pandas_udf(HIT)
    def run(contents: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([findings_of(c) for c in contents], columns=["parsed", "hits"])

    chosen = files.where(F.col("content").isNotNull() & F.col("file").rlike(f"(?i){FILES.pattern}"))
    return chosen.select("file", run("content").alias("a")).select("file", "a.parsed", "a.hits")


def structural(files: DataFrame) -> DataFrame:
    """Findings of files (file, content) by structure: file, rule_id, severity, confidence, cwe, line, column, snippet."""
    return analysed(files).select("file", F.inline("hits"))


def replace_line_rules(found: DataFrame, read_files: DataFrame) -> DataFrame:
    """found without the line rules in REPLACED where the file (file, parsed) could be read."""
    parsed = read_files.where("parsed").select("file").distinct()
    return found.where(~F.col("rule_id").isin(*REPLACED)).unionByName(found.where(F.col("rule_id").isin(*REPLACED)).join(parsed, "file", "left_anti"))
