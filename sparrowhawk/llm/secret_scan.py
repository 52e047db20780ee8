"""Secret scans: fixed patterns, and assignment-aware lexing with constant propagation.

Base spans, leftmost and non-overlapping for each kind: ``assign``, ``access``, ``hex``. The
method adds spans of kind ``literal``, in three steps:

1. A lexer cuts a text into comments, string literals (with prefixes, in triple quotes, in
   backticks), names and signs. What it doesn't know is passed over; comments are left out.
2. A parser takes assignments from the tokens: ``name = ..``, ``name: ..``, ``"name": ..``,
   ``map['name'] = ..``, ``name: type = ..``, named arguments; values of literals and names
   joined by ``+``, by standing side by side, or in brackets over several lines; bare words
   after a name that starts a line; YAML blocks; ``<name>x</name>``.
3. Constants are propagated: a name stands for its last assignment before, or else its first
   one after. A literal that flows into a name is scored by how sensitive the name is and by
   how much the whole value looks like a secret.

A value of more than MOST_PARTS literals, or joined to more than MOST_CHARS characters, is not
carried on or joined: the literals that stand in such an assignment are scored one by one. Time and
memory are in proportion to the text. A literal inside a base span is not reported again.

Spans are of code points, end exclusive. Cases: a null text counts as empty and has no
spans; every row is scanned by itself, so repeated rows give repeated results, rows with a
null doc_id too; texts of any length are scanned whole; empty tables give empty results; other
columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter, deque
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import slices

KINDS = ("assign", "access", "hex", "literal")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # leftmost maximal runs of [0-9a-f]+ with 24 characters or more
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: Bytes to "x" for hex digits and "." for others: a run of 24 is then a substring.
HEX_MAP = bytes(ord("x") if chr(b) in "0123456789abcdef" else ord(".") for b in range(256))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end), sorted."""
    found = []
    low = text.lower()
    if any(n in low for n in NAMES):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LEAST]
    if b"x" * HEX_LEAST in text.encode("utf-8", "replace").translate(HEX_MAP):
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


# -- names and values ------------------------------------------------------------------------

#: Words of a name and how sensitive they make it; the highest counts.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "secret": 1.0, "token": 0.9, "apikey": 1.0, "bearer": 0.9,
    "credential": 0.9, "credentials": 0.9, "private": 0.7, "signing": 0.7, "encryption": 0.7, "auth": 0.7, "access": 0.6, "key": 0.6, "pass": 0.7, "salt": 0.6,
}
#: Literals that only stand for a secret.
PLACEHOLDER = re.compile(r"(?i)^(?:change.?me|example|sample|placeholder|your[-_ ].*|x{3,}|\*{3,}|todo|none|null|true|false|undefined|<.*>|\$\{.*\}|\{\{.*\}\}|%\(.*\)s|\{[A-Za-z_][\w.]*\}|process\.env.*|os\.environ.*)$")
THRESHOLD, LITERAL_LEAST = 0.5, 8
MOST_PARTS, MOST_CHARS = 64, 4096

WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
JOINTS = str.maketrans("", "", "_-.")


@lru_cache(20_000)
def sensitivity(name: str) -> float:
    flat = name.translate(JOINTS).lower()
    return max([0.0, *(SENSITIVE.get(w.lower(), 0.0) for w in WORD.findall(name)), *(s for k, s in SENSITIVE.items() if len(k) > 5 and k in flat)])


def likeness(value: str) -> float:
    """0 to 1: how much a literal looks like a secret, by length, alphabet and entropy."""
    n = len(value)
    if n < LITERAL_LEAST or PLACEHOLDER.match(value) or any(c.isspace() for c in value):
        return 0.0
    entropy = -sum(k / n * math.log2(k / n) for k in Counter(value).values())
    classes = sum(bool(re.search(p, value)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    return min(1.0, entropy / 4.0) * (0.55 + 0.15 * classes)


# -- the lexer --------------------------------------------------------------------------------

LEX = re.compile(
    r"""
    (?P<comment> (?:(?<=\s)|\A) (?:\#|//) [^\n]* )
  | (?P<long> /\* | <!-- | (?<!\w)[rRbBuUfF]{0,2} (?:\"{3}|'{3}) | ` )
  | (?P<text> (?<!\w)[rRbBuUfF]{0,2} (?: "(?:[^"\\\n]|\\.)*" | '(?:[^'\\\n]|\\.)*' ) )
  | (?P<name> [A-Za-z_$][\w$]* (?:[.-][A-Za-z_][\w$]*)* )
  | (?P<sign> [=!]==? | := | => | \+= | [=:+,;()\[\]{}] )
  | (?P<line> \n )
    """,
    re.VERBOSE | re.ASCII,
)
CLOSES = {"/*": "*/", "<!--": "-->", "`": "`", '"""': '"""', "'''": "'''"}
#: kind, start, end; of a string literal its contents' start and end.
Token = tuple[str, int, int]


def lex(text: str):
    """Tokens of kinds text, name, sign and line. An opening mark that is never closed is passed over."""
    at, unclosed = 0, set()
    while m := LEX.search(text, at):
        kind, at = m.lastgroup, m.end()
        if kind == "long":
            mark = m[0].lstrip("rRbBuUfF")
            close = -1 if mark in unclosed else text.find(CLOSES[mark], at)
            if close < 0:
                unclosed.add(mark)
                continue
            if mark not in ("/*", "<!--"):
                yield "text", at, close
            at = close + len(CLOSES[mark])
        elif kind == "text":
            quote = m.start() + len(m[0]) - len(m[0].lstrip("rRbBuUfF"))
            yield kind, quote + 1, at - 1
        elif kind != "comment":
            yield kind, m.start(), at


class Stream:
    """Tokens with one to look ahead at, and the last ones taken."""

    def __init__(self, text: str):
        self.tokens, self.before = lex(text), deque(maxlen=4)
        self.ahead: Token | None = next(self.tokens, None)

    def take(self) -> Token:
        token, self.ahead = self.ahead, next(self.tokens, None)
        self.before.append(token)
        return token


# -- assignments ------------------------------------------------------------------------------

Part = tuple[int, int]


class Binding(NamedTuple):
    name: str
    #: Spans of literals, and names.
    terms: tuple[Part | str, ...]
    #: What stands for a name that isn't bound: a word without quotes.
    bare: Part | None
    #: Lines of a block; they are one value.
    block: tuple[Part, ...] = ()


BARE = re.compile(r"[^\s\"'`,;#<>(){}\[\]]+")
LEADS = {"", "-", "export", "set", "env", "ENV", "ARG", "const", "let", "var"}
BLOCK = re.compile(r"[ \t]*[|>][+\-0-9]*[ \t]*\n")
XML = re.compile(r"<([A-Za-z_][\w.\-]*)>([^<>\n]*)</\1>", re.ASCII)


def _target(text: str, before) -> tuple[str, int] | None:
    """Name and start of what stands before a binding sign."""
    now = list(before)
    if not now:
        return None
    kind, s, e = now[-1]
    if kind == "name":
        return text[s:e], s
    if kind == "text" and 0 < e - s <= 200:
        return text[s:e], s - 1
    if text[s:e] == "]" and len(now) == 4 and [k for k, *_ in now[:3]] == ["name", "sign", "text"] and text[now[1][1]] == "[":
        return f"{text[now[0][1] : now[0][2]]}.{text[now[2][1] : now[2][2]]}", now[0][1]
    return None


def _terms(text: str, stream: Stream) -> list[Part | str]:
    """Literals and names joined by + or side by side, as far as they go."""
    terms: list[Part | str] = []
    depth, joined = 0, True
    while ahead := stream.ahead:
        kind, s, e = ahead
        sign = text[s:e] if kind == "sign" else ""
        if kind == "line" and (depth or joined and terms) or sign == "(" and joined:
            depth += sign == "("
        elif kind == "text":
            terms.append((s, e))
            joined = False
        elif kind == "name" and joined:
            stream.take()
            if stream.ahead and stream.ahead[0] == "sign" and text[stream.ahead[1]] in "([" and stream.ahead[1] == e:
                break  # a call or an element: unknown
            terms.append(text[s:e])
            joined = False
            continue
        elif sign == "+" and terms and not joined:
            joined = True
        elif sign == ")" and depth:
            depth -= 1
        else:
            break
        stream.take()
    return terms


def _block(text: str, start: int, at: int) -> tuple[Part, ...]:
    """Spans of the lines that are indented more than the line of start."""
    line = text.rfind("\n", 0, start) + 1
    indent = len(text[line:start]) - len(text[line:start].lstrip(" "))
    found = []
    while at < len(text):
        end = text.find("\n", at)
        end = len(text) if end < 0 else end
        own = text[at:end]
        if own.strip():
            if len(own) - len(own.lstrip(" ")) <= indent:
                break
            left = at + len(own) - len(own.lstrip())
            found.append((left, at + len(own.rstrip())))
        at = end + 1
    return tuple(found)


def bindings(text: str):
    """Every assignment in the order of the text."""
    stream = Stream(text)
    while stream.ahead:
        kind, s, e = stream.ahead
        sign = text[s:e] if kind == "sign" else ""
        target = _target(text, stream.before) if sign in ("=", ":", ":=", "=>", "+=") else None
        stream.take()
        if target is None:
            continue
        name, start = target
        if sign == ":" and (m := BLOCK.match(text, e)):
            if block := _block(text, start, m.end()):
                yield Binding(name, (), None, block)
            continue
        terms = _terms(text, stream)
        if sign == ":" and len(terms) == 1 and isinstance(terms[0], str) and stream.ahead and text[stream.ahead[1] : stream.ahead[2]] == "=":
            stream.take()  # name: type = value
            terms = _terms(text, stream)
        bare = None
        if sign != "=>" and not any(isinstance(t, tuple) for t in terms):
            lead = text[text.rfind("\n", max(0, start - 200), start) + 1 : start] if start else ""
            while e < len(text) and text[e] in " \t":
                e += 1
            m = BARE.match(text, e)
            if m and lead.strip().strip("\"'") in LEADS:
                bare = m.span()
        yield Binding(name, tuple(terms), bare)
    for m in XML.finditer(text):
        yield Binding(m[1], (m.span(2),), None)


def resolved(text: str, found: list[Binding]) -> list[tuple[Part, ...] | None]:
    """The literals that each assignment's value is made of; None where it is unknown or too much.

    Three passes, in the order of the text and back: names bound later, and chains of them.
    """
    values: list[tuple[Part, ...] | None] = [None] * len(found)
    places: dict[str, list[int]] = {}
    for i, b in enumerate(found):
        places.setdefault(b.name, []).append(i)

    def value_of(name: str, i: int):
        own = places.get(name)
        if own is None:
            return None
        k = bisect_left(own, i)
        if k:
            return values[own[k - 1]]
        later = own[0] if own[0] != i else own[1] if len(own) > 1 else None
        return None if later is None else values[later]

    def value(i: int, b: Binding):
        if b.block:
            return b.block
        parts: list[Part] = []
        for t in b.terms:
            more = (t,) if isinstance(t, tuple) else value_of(t, i)
            if more is None:
                return None
            parts += more
            if len(parts) > MOST_PARTS:
                return None
        return tuple(parts) if parts and (len(parts) == 1 or sum(e - s for s, e in parts) <= MOST_CHARS) else None

    every = range(len(found))
    for order in (every, reversed(every), every):
        for i in order:
            if values[i] is None:
                values[i] = value(i, found[i])
    return [v if v is not None else (b.bare,) if b.bare else None for v, b in zip(values, found)]


def _looks_secret(name: str, value: str) -> bool:
    return sensitivity(name) * likeness(value) >= THRESHOLD


def literal_spans(text: str) -> list[Part]:
    """Spans of literals that flow into a sensitive name and look like a secret."""
    if "=" not in text and ":" not in text and "</" not in text:
        return []
    flat = text.translate(JOINTS).lower()
    if not any(k in flat for k in SENSITIVE):
        return []
    bound = list(bindings(text))
    found: set[Part] = set()
    for b, parts in zip(bound, resolved(text, bound)):
        if not sensitivity(b.name):
            continue
        if parts is not None:
            lines = [text[s:e] for s, e in parts]
            value = "".join(x for x in lines if not b.block or not x.startswith("-----"))
            if _looks_secret(b.name, value):
                found.update(parts)
        else:
            found.update(t for t in b.terms if isinstance(t, tuple) and _looks_secret(b.name, text[t[0] : t[1]]))
    return sorted(p for p in found if p[1] > p[0])


def _outside(base: list[tuple[int, int, int]], spans: list[Part]) -> list[Part]:
    """The spans that no base span holds. Those of a kind don't overlap: only the last that begins before can."""
    kinds = [[(s, e) for s, k, e in base if k == kind] for kind in range(3)]
    held = lambda s, e: any((i := bisect_left(own, (s + 1,))) and own[i - 1][1] >= e for own in kinds)
    return [p for p in spans if not held(*p)]


def scan_text(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans and all spans, as (start, kind's number, end), sorted."""
    text = text or ""
    base = base_spans(text)
    more = [(s, 3, e) for s, e in _outside(base, literal_spans(text))]
    return base, sorted(base + more)


def joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


RESULT = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def _run(batches):
    for batch in slices(batches):
        rows = []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            base, every = scan_text(text)
            n = Counter(k for _, k, _ in base)
            rows.append((doc, n[0], n[1], n[2], hashlib.sha256(joined(base).encode()).hexdigest(), joined(every)))
        columns = list(zip(*rows)) or [()] * 6
        kinds = [pa.int64()] * 4 + [pa.string()] * 2
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_run, RESULT)
