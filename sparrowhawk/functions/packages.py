"""Package names, versions, licences and install scripts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..schema import choose
from .text import matches

#: Malicious names, known misspellings, permitted and risky licences, dangerous scripts.
MALICIOUS = [
    ("Known crypto miner package", r"(?:cryptominer|xmrig|coinhive|crypto-?loot)"),
    ("Malware package name", r"(?:stealer|exfil|backdoor|trojan|keylog|botnet|ratware)"),
    ("Piracy tool package", r"(?:hack|crack|pirate|warez|serial|keygen)"),
]
TYPOSQUATS = {
    "reactt": "react", "reacct": "react", "lodahs": "lodash", "loadash": "lodash", "expres": "express", "exress": "express",
    "axioss": "axios", "mognoose": "mongoose", "mongose": "mongoose", "moongose": "mongoose", "nextt": "next", "vuue": "vue",
    "angullar": "angular", "sveltte": "svelte", "tailwindcsss": "tailwindcss", "dottie": "dotenv", "envee": "dotenv",
    "chalkk": "chalk", "momment": "moment",
}
LICENSE_RISKS = {"GPL": "high", "AGPL": "critical", "SSPL": "critical", "BUSL": "high", "CC-BY-NC": "high", "UNLICENSED": "high"}
PERMITTED_LICENSES = ["MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause", "Apache-2.0", "0BSD", "Unlicensed", "CC0-1.0", "Python-2.0"]
DANGEROUS_SCRIPTS = [
    r"(?:curl|wget)\s+[^|]+\|\s*(?:bash|sh|sh -c)", r"(?:eval|exec)\s*\(", r"node\s+-e\s+['\"]", r"python\s+-c\s+['\"]", r"rm\s+-rf",
    r"chmod\s+777", r"nc\s+-", r"\/dev\/tcp", r"base64\s+-d\s*\|", r"mkfifo",
]


def package_risks(name: Column) -> Column:
    """array<struct<type, severity, action>> of a package name."""
    low = F.lower(name)
    item = lambda kind, severity, action: F.struct(F.lit(kind).alias("type"), F.lit(severity).alias("severity"), F.lit(action).alias("action"))
    found = [F.when(matches(name, p), item("malicious", "critical", "block")) for _, p in MALICIOUS]
    found.append(F.when(low.isin(*TYPOSQUATS), item("typosquat", "high", "warn")))
    found.append(F.when(low.rlike(r"^[a-z]{1,2}$"), item("suspicious_short", "medium", "warn")))
    found.append(F.when(low.rlike(r"[0-9]$") & ~low.rlike(r"(?:[a-z]2[a-z]|es[0-9]|v[0-9])"), item("suspicious_number_suffix", "low", "warn")))
    return F.array_compact(F.array(*found))


def meant(name: Column) -> Column:
    """The package that a misspelt name resembles, or null."""
    return choose(F.lower(name), TYPOSQUATS)


def pin_risk(version: Column) -> Column:
    """unpinned (*, latest, empty, x), range (^ or ~), or null."""
    v = F.trim(F.coalesce(version, F.lit("")))
    return F.when(v.isin("*", "latest", "") | v.rlike(r"^[xX](?:\.|$)"), "unpinned").when(v.rlike(r"^[\^~]"), "range")


def version_tuple(version: Column) -> Column:
    """struct(major, minor, patch) of the first number.number.number in a version; missing parts are 0."""
    return F.transform(F.array(version), lambda v: F.struct(*[F.coalesce(F.regexp_extract(v, r"([0-9]+)(?:\.([0-9]+))?(?:\.([0-9]+))?", i).try_cast("int"), F.lit(0)).alias(n) for i, n in ((1, "major"), (2, "minor"), (3, "patch"))]))[0]


def is_vulnerable(version: Column, below: Column) -> Column:
    """Whether a version is below a bound (``<a.b.c``), or the bound is ``*``."""
    return (below == "*") | (version_tuple(version) < version_tuple(F.regexp_replace(below, r"^<\s*", "")))


def license_risk(license_: Column) -> Column:
    """Severity of the last risky licence named; medium if none is given; null if there is no risk."""
    out = F.when(license_.isNull() | (license_ == ""), "medium")
    for key, severity in reversed(LICENSE_RISKS.items()):
        out = out.when(F.upper(license_).contains(key), severity)
    return out


def license_compliant(license_: Column) -> Column:
    return F.coalesce(license_.isin(*PERMITTED_LICENSES), F.lit(False))


def dangerous_script(script: Column) -> Column:
    out = F.lit(False)
    for p in DANGEROUS_SCRIPTS:
        out = out | matches(script, p)
    return out
