"""Tokens of high entropy near names of credentials."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import is_public_key, looks_like_placeholder, matches, shannon_entropy
from .lines import explode_lines, near

LEAST, LONG = 4.0, 2000
KEY_CONTEXT = r"api[_-]?key|secret|token|password|passwd|credential|auth|bearer|private[_-]?key|access[_-]?key|client[_-]?secret|session[_-]?id"
CHECKSUM = r"^(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64})$"
UUID = r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
TOKEN = r"(?<![A-Za-z0-9_])[A-Za-z0-9_][A-Za-z0-9_\-]{22,78}[A-Za-z0-9_](?![A-Za-z0-9_])"
#: Header, payload and signature; a rule of its own reports these.
JWT = r"^[A-Za-z0-9_\-]{4,}\.[A-Za-z0-9_\-]{4,}\.[A-Za-z0-9_\-]{4,}"
#: Files that are full of random strings, and prefixes that rules of their own report.
SKIPPED_FILE = r"(?:package-lock\.json|yarn\.lock|pnpm-lock\.yaml|Cargo\.lock|poetry\.lock|composer\.lock|\.min\.js|\.map|\.lock)$"
SKIPPED_PREFIX = r"^(?:sk-|sk_live_|sk_test_|rk_live_|pk_live_|pk_test_|AKIA|ASIA|AIza|eyJ|ghp_|gho_|xox[baprs]-)"


def _prose(run: Column) -> Column:
    """Whether a base64 run decodes to text: printable for the most part, and of low entropy."""
    bare = F.regexp_replace(run, "=+$", "")
    padded = F.concat(bare, F.repeat(F.lit("="), F.pmod(-F.length(bare), F.lit(4))))
    plain = F.decode(F.try_to_binary(padded, F.lit("base64")), "ISO-8859-1")
    printable = F.length(F.regexp_replace(plain, r"[^\x09\x0a\x0d\x20-\x7e]", ""))
    return F.coalesce((F.length(run) >= 16) & (F.length(plain) >= 8) & (printable >= 0.9 * F.length(plain)) & (shannon_entropy(plain) < 3.5), F.lit(False))


def high_entropy_tokens(files: DataFrame, file: str = "file", content: str = "content") -> DataFrame:
    """file, line, column, token, entropy of random-looking tokens (24 to 80 characters) within two lines of a credential's name.

    Checksums, UUIDs, parts of signed tokens, base64 of prose, and what lies in urls or paths are left out. A token is taken out of
    the lines before they are searched for names, so that it isn't its own context.
    """
    rows = explode_lines(files, file, content).where(F.length("text") <= LONG)
    t = F.col("text")
    outside = F.regexp_replace(t, r"https?://\S+", " ")  # a token within a url isn't one
    tokens = F.array_distinct(F.regexp_extract_all(outside, F.lit(TOKEN), F.lit(0)))
    jwts = F.filter(F.regexp_extract_all(t, F.lit(r"[A-Za-z0-9_\-.]+"), F.lit(0)), lambda r: matches(r, JWT))
    prose = F.filter(F.regexp_extract_all(t, F.lit(r"[A-Za-z0-9+/]{16,}={0,2}"), F.lit(0)), _prose)
    within = lambda runs, v: F.exists(runs, lambda r: r.contains(v))
    real = F.filter(tokens, lambda v: (shannon_entropy(v) >= LEAST) & ~matches(v, CHECKSUM) & ~matches(v, UUID) & ~within(jwts, v) & ~within(prose, v))
    bare = F.aggregate(real, t, lambda a, v: F.replace(a, v, F.lit("")))
    rows = rows.withColumns({"_tokens": real, "_near": near(matches(bare, KEY_CONTEXT), file, 2, 2)})
    hit = rows.where("_near").select(file, "line", "text", F.explode("_tokens").alias("token"))
    at = F.instr(F.col("text"), F.col("token"))
    before, after = F.substring("text", at - 1, F.lit(1)), F.substring("text", at + F.length("token"), F.lit(1))
    hit = hit.where(~(F.when(at > 1, before).otherwise("").isin("/", "\\") | after.isin("/", "\\")) & ~is_public_key(F.col("text"), F.col("token")))
    return hit.select(file, "line", at.alias("column"), "token", F.round(shannon_entropy(F.col("token")), 6).alias("entropy"))


def quoted_high_entropy(files: DataFrame, file: str = "file", content: str = "content") -> DataFrame:
    """file, line, column, value of quoted random-looking strings (24 to 120 characters) with digits and letters."""
    rows = explode_lines(files.where(~matches(F.col(file), SKIPPED_FILE)), file, content).where(F.length("text") <= LONG)
    hit = rows.select(file, "line", "text", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"['\"`]([A-Za-z0-9+/=_\-]{24,120})['\"`]"), F.lit(1)))).alias("value"))
    v = F.col("value")
    keep = ~matches(v, SKIPPED_PREFIX, False) & ~looks_like_placeholder(v) & ~is_public_key(F.col("text"), v) & ~matches(v, UUID) & ~matches(v, CHECKSUM) & v.rlike("[0-9]") & v.rlike("[A-Za-z]")
    return hit.where(keep & (shannon_entropy(v) >= LEAST)).select(file, "line", F.instr("text", v).alias("column"), "value")


def without_known(tokens: DataFrame, findings: DataFrame) -> DataFrame:
    """Tokens on lines that no rule for secrets has reported."""
    known = findings.where(F.col("rule_id").startswith("secret.")).select("file", "line").distinct()
    return tokens.join(known, ["file", "line"], "left_anti")
