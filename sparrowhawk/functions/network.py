"""Hosts, known domains and HTTP headers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .text import matches, sql_matches

#: This machine, private networks, metadata services, and domains that services commonly call.
LOCAL_HOST = r"^(?:localhost|127\.0\.0\.1|0\.0\.0\.0|::1|\[::1\])$"
PRIVATE_IP = r"^(?:10\.|192\.168\.|172\.(?:1[6-9]|2\d|3[01])\.)"
METADATA_HOST = r"^(?:169\.254\.169\.254|metadata\.google\.internal|metadata\.goog)$"
KNOWN_DOMAINS = [
    "localhost", "127.0.0.1", "0.0.0.0", "api.openai.com", "api.anthropic.com", "generativelanguage.googleapis.com",
    "api.stripe.com", "connect.stripe.com", "api.github.com", "github.com", "api.supabase.co", ".googleapis.com",
    "firestore.googleapis.com", "identitytoolkit.googleapis.com", "api.resend.com", "api.postmarkapp.com", "api.upstash.com",
    "api.pinecone.io", "api.telegram.org", "api.slack.com", "registry.npmjs.org", "api.osv.dev", "api.cloudflare.com",
    "api.datadoghq.com", "sentry.io", "api.mapbox.com", "api.mapbox.ai",
]
KNOWN_SUFFIXES = [".supabase.co", ".sentry.io"]
KNOWN_LOCAL = r"^(?:localhost|127\.|10\.|192\.168\.|172\.(?:1[6-9]|2[0-9]|3[01])\.|0\.0\.0\.0|::1|::)"
EXAMPLE_DOMAIN = r"example\.(com|org|net|io)$"
PLAIN_DOMAIN = r"^(?:www\.|api\.)?[a-z0-9-]+\.(?:com|org|net|io|dev|app|co|ai)$"
URL_PARTS = r"^[A-Za-z][A-Za-z0-9+.-]*:\/\/([^/?#]+)"


def host_of(url: Column) -> Column:
    """A url's host in lower case without its port; null if there is none."""
    host = F.regexp_extract(url, URL_PARTS, 1)
    return F.when(host != "", F.lower(F.regexp_replace(host, r":\d+$", "")))


def is_metadata(host: Column) -> Column:
    return matches(host, METADATA_HOST)


def is_external(host: Column) -> Column:
    """Not this machine and not a private network; metadata services are the worst of the external ones."""
    return F.coalesce(is_metadata(host) | ~(matches(host, LOCAL_HOST) | matches(host, PRIVATE_IP)), F.lit(False))


def is_known(domain: Column) -> Column:
    known = domain.isin(*KNOWN_DOMAINS)
    for suffix in KNOWN_SUFFIXES:
        known = known | domain.endswith(suffix)
    return known | matches(domain, KNOWN_LOCAL, False) | matches(domain, EXAMPLE_DOMAIN, False)


def is_suspicious(domain: Column) -> Column:
    return ~is_known(domain) & ~matches(domain, PLAIN_DOMAIN)


def sql_known(d: str) -> str:
    listed = ", ".join(f"'{x}'" for x in KNOWN_DOMAINS)
    return f"({d} IN ({listed}) OR {' OR '.join(f'ends_with({d}, {chr(39)}{s}{chr(39)})' for s in KNOWN_SUFFIXES)} OR {sql_matches(d, KNOWN_LOCAL, False)} OR {sql_matches(d, EXAMPLE_DOMAIN, False)})"


#: Headers that every response should have.
REQUIRED_HEADERS = [("strict-transport-security", "medium"), ("content-security-policy", "medium"), ("x-content-type-options", "low"), ("x-frame-options", "low")]
LEAKY_HEADERS = ["server", "x-powered-by"]


def header_findings(df: DataFrame) -> DataFrame:
    """url, rule_id, severity, confidence, detail of responses (url, status, headers map of lower-case names; cookies array)."""
    url, h = F.col("url"), F.col("headers")
    https = url.startswith("https://")
    item = lambda test, rule, severity, confidence="high", detail=F.lit(None).cast("string"): F.when(test, F.struct(F.lit(rule).alias("rule_id"), F.lit(severity).alias("severity"), F.lit(confidence).alias("confidence"), detail.alias("detail")))
    value = lambda name: F.coalesce(F.try_element_at(h, F.lit(name)), F.lit(""))
    framed = matches(value("content-security-policy"), "frame-ancestors")
    found = [item(~https, "url.no-https", "high")]
    for name, severity in REQUIRED_HEADERS:
        needed = https if name == "strict-transport-security" else ~framed if name == "x-frame-options" else F.lit(True)
        found.append(item(needed & (value(name) == ""), f"url.missing-{name}", severity))
    found += [item(value(n).rlike("[0-9]"), "url.version-leak", "low", "medium", F.concat(F.lit(f"{n}: "), value(n))) for n in LEAKY_HEADERS]
    weak = lambda c: (https & ~matches(c, r";\s*secure")) | ~matches(c, r";\s*httponly")
    cookie = lambda c: F.struct(F.lit("url.insecure-cookie").alias("rule_id"), F.lit("medium").alias("severity"), F.lit("high").alias("confidence"), F.trim(F.split(c, "=")[0]).alias("detail"))
    cookies = F.transform(F.filter(F.coalesce("cookies", F.array().cast("array<string>")), weak), cookie)
    return df.select("url", F.explode(F.concat(F.array_compact(F.array(*found)), cookies)).alias("f")).select("url", "f.*")
