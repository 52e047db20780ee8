"""Personal data in text: detection with offsets, overlap resolution and redaction."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, functions as F

SPAN = "array<struct<type:string,severity:string,value:string,start:int,end:int,token:string>>"

#: Type, severity and pattern of each detector.
DETECTORS = [
    ("email", "high", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"),
    ("credit-card", "critical", r"(?<![\d])(?:\d[ -]?){12,18}\d(?![\d])"),
    ("ssn", "critical", r"(?<![\d-])\d{3}[ -]\d{2}[ -]\d{4}(?![\d-])"),
    ("phone", "medium", r"(?<![\w.])(?:\+?\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?)?\d{2,4}[ .-]\d{2,4}[ .-]\d{2,4}(?:[ .-]\d{2,4})?(?![\w])"),
    ("ipv4", "low", r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d.])"),
    ("ipv6", "low", r"\b(?:[A-Fa-f0-9]{1,4}:){7}[A-Fa-f0-9]{1,4}\b"),
    ("jwt", "high", r"\beyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{5,}\b"),
    ("aws-access-key", "critical", r"\b(?:AKIA|ASIA|AGPA|AIDA|AROA|ANPA|ANVA)[A-Z0-9]{16}\b"),
    ("private-key", "critical", r"-----BEGIN (?:RSA |EC |OPENSSH |DSA |PGP )?PRIVATE KEY-----"),
    ("iban", "high", r"\b[A-Z]{2}\d{2}[ ]?(?:[A-Z0-9]{4}[ ]?){2,7}[A-Z0-9]{1,4}\b"),
    ("mac-address", "low", r"\b(?:[0-9A-Fa-f]{2}:){5}[0-9A-Fa-f]{2}\b"),
]
#: What must be in a text for a detector to be tried on it.
HINTS = {"email": "@", "ipv4": ".", "ipv6": ":", "jwt": "eyJ", "private-key": "-----BEGIN", "mac-address": ":"}
TYPES = [d[0] for d in DETECTORS]
RANK = {"critical": 4, "high": 3, "medium": 2, "low": 1}
_COMPILED = [(t, s, re.compile(p, re.ASCII)) for t, s, p in DETECTORS]


def luhn(digits: str) -> bool:
    total = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits)))
    return total % 10 == 0


def valid(kind: str, value: str) -> bool:
    digits = re.sub(r"[^0-9]", "", value)
    if kind == "credit-card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    if kind == "ssn":
        return digits[:3] not in ("000", "666") and digits[0] != "9" and digits[3:5] != "00" and digits[5:] != "0000"
    if kind == "phone":
        return 10 <= len(digits) <= 15
    if kind == "iban":
        return 15 <= len(re.sub(r"\s", "", value)) <= 34
    return True


def token(kind: str, value: str) -> str:
    """What a redacted value leaves: cards and phones keep their last four digits."""
    last = re.sub(r"[^0-9]", "", value)[-4:]
    return {"credit-card": f"****{last}", "phone": f"[REDACTED_PHONE_{last}]"}.get(kind, f"[REDACTED_{kind.upper()}]")


def detect(text: str | None, types=None) -> list[dict]:
    """Valid matches without overlaps: the earlier start wins, then the more severe, then the longer."""
    found = []
    digit = bool(text) and any(c in text for c in "0123456789")
    for kind, severity, pattern in _COMPILED if text else ():
        if types and kind not in types or HINTS.get(kind, "") not in text or not digit and kind in ("credit-card", "ssn", "phone", "ipv4", "iban"):
            continue
        for m in pattern.finditer(text):
            if valid(kind, m[0]):
                found.append({"type": kind, "severity": severity, "value": m[0], "start": m.start(), "end": m.end(), "token": token(kind, m[0])})
    found.sort(key=lambda x: (x["start"], -RANK[x["severity"]], -(x["end"] - x["start"])))
    kept, end = [], -1
    for x in found:
        if x["start"] >= end:
            kept.append(x)
            end = x["end"]
    return kept


def redact(text: str | None, types=None) -> str | None:
    out, at = [], 0
    for x in detect(text, types):
        out += [text[at : x["start"]], x["token"]]
        at = x["end"]
    return text if not out else "".join([*out, text[at:]])


def detect_pii(text: Column, types: list[str] | None = None) -> Column:
    """array<struct> of the matches of a text column."""

    @F.pandas_udf(SPAN)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: detect(t, types))

    return run(text)


def redact_pii(text: Column, types: list[str] | None = None) -> Column:
    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: redact(t, types))

    return run(text)


# -- single types in DataFrame functions ---------------------------------------------------------

EMAIL = r"[A-Za-z0-9_%+-][A-Za-z0-9._%+-]*@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
OCTET = r"(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
IPV4 = rf"^(?:{OCTET}\.){{3}}{OCTET}$"


def ipv4s(text: Column) -> Column:
    """Addresses of a text: whole runs of digits and dots."""
    return F.filter(F.regexp_extract_all(text, F.lit("[0-9.]+"), F.lit(0)), lambda v: v.rlike(IPV4))


def cards(text: Column) -> Column:
    """Card numbers written without separators: whole runs of 13 to 19 digits that pass Luhn."""
    runs = F.regexp_extract_all(text, F.lit("[0-9]+"), F.lit(0))
    return F.filter(runs, lambda v: F.length(v).between(13, 19) & F.call_function("luhn_check", v))
