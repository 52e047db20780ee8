"""Chat requests and replies: scan, block, redact or report what texts and JSON hold."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from . import pii
from .prompts import PHRASE

VIOLATION = "array<struct<type:string,rule_id:string,severity:string,start:int,end:int>>"
LEAF = "array<struct<path:string,value:string>>"
#: Instructions in texts that a model reads, and attempts to have its own shown.
INJECTIONS = [
    ("ai.prompt-injection-marker", "high", re.compile(PHRASE, re.I | re.A)),
    ("ai.system-prompt-reveal", "high", re.compile(r"(?:reveal|show|print|repeat|output)\s+(?:me\s+)?(?:your|the)\s+(?:system\s+)?(?:prompt|instructions)", re.I | re.A)),
]


def _secret_rules():
    from ..operators.rules import CORE, Compiled

    return [Compiled(r) for r in CORE if r.id.startswith("secret.")]


def scan(text: str | None, rules=None) -> list[dict]:
    """Injections, secrets (by the catalogue's rules with their filters) and personal data of a text, with places."""
    if not text:
        return []
    item = lambda kind, rule, severity, s, e: {"type": kind, "rule_id": rule, "severity": severity, "start": s, "end": e}
    out = [item("prompt-injection", i, s, m.start(), m.end()) for i, s, p in INJECTIONS for m in p.finditer(text)]
    for c in rules if rules is not None else _secret_rules():
        for m in c.pattern.finditer(text):
            start = text.rfind("\n", 0, m.start()) + 1
            line = text[start : (text.find("\n", m.end()) + 1 or len(text) + 1) - 1]
            if not c.keep or c.keep(line, c.pattern.search(text, m.start(), m.end()) or m):
                out.append(item("secret", c.rule.id, c.rule.severity, m.start(), m.end()))
    out += [item("pii", f"pii.{x['type']}", x["severity"], x["start"], x["end"]) for x in pii.detect(text)]
    return out


def redact(text: str | None, rules=None) -> str | None:
    """Secrets and personal data replaced by their rule's name; of overlapping ones the earlier, then the longer."""
    spans = sorted((x for x in scan(text, rules) if x["type"] != "prompt-injection"), key=lambda x: (x["start"], -x["end"]))
    out, at = [], 0
    for x in spans:
        if x["start"] >= at:
            out += [text[at : x["start"]], f"[REDACTED:{x['rule_id']}]"]
            at = x["end"]
    return "".join([*out, text[at:]]) if out else text


def walk(value, path: str = "$"):
    """(path, text) of every text in a JSON value."""
    if isinstance(value, str):
        yield path, value
    elif isinstance(value, dict):
        for k, v in value.items():
            yield from walk(v, f"{path}.{k}")
    elif isinstance(value, list):
        for i, v in enumerate(value):
            yield from walk(v, f"{path}[{i}]")


def mapped(value, f):
    """A JSON value with f applied to every text."""
    if isinstance(value, str):
        return f(value)
    if isinstance(value, dict):
        return {k: mapped(v, f) for k, v in value.items()}
    return [mapped(v, f) for v in value] if isinstance(value, list) else value


def _parsed(text):
    try:
        return json.loads(text)
    except (TypeError, ValueError):
        return None


def json_leaves(text: Column) -> Column:
    """array<struct<path, value>> of the texts in a JSON column; empty for what isn't JSON."""

    @F.pandas_udf(LEAF)
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"path": p, "value": v} for p, v in walk(_parsed(t))] for t in texts], dtype=object)

    return run(text)


def scan_text(text: Column) -> Column:
    @F.pandas_udf(VIOLATION)
    def run(texts: pd.Series) -> pd.Series:
        rules = _secret_rules()
        return pd.Series([scan(t, rules) for t in texts], dtype=object)

    return run(text)


def redact_text(text: Column) -> Column:
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        rules = _secret_rules()
        return texts.map(lambda t: redact(t, rules))

    return run(text)


def redact_json(text: Column) -> Column:
    """A JSON text with its texts redacted, also within texts that are JSON (tool calls' arguments); other texts are redacted whole."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        rules = _secret_rules()

        def one(t):
            value = _parsed(t)
            if isinstance(value, (dict, list)):
                return json.dumps(mapped(value, one), ensure_ascii=False)
            return redact(t, rules)

        return texts.map(lambda t: one(t) if isinstance(t, str) else t)

    return run(text)


def guard(df: DataFrame, text: str, mode: str = "block") -> DataFrame:
    """df with violations, blocked and forwarded (null if blocked) of a request's text: block, redact or report."""
    if mode not in ("block", "redact", "report"):
        raise ValueError(f"no such mode: {mode}")
    t = F.col(text)
    df = df.withColumn("violations", scan_text(t))
    some = F.size("violations") > 0
    injected = F.exists("violations", lambda v: v["type"] == "prompt-injection")
    blocked = some if mode == "block" else injected if mode == "redact" else F.lit(False)
    out = redact_text(t) if mode == "redact" else t
    return df.withColumn("blocked", blocked).withColumn("forwarded", F.when(~F.col("blocked"), out))
