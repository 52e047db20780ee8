"""Inventories of a code base: network, privacy, data sent to models, routes, threats, compliance, deployment gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.network import is_known, is_suspicious
from ..functions.text import java, matches
from .lines import near

# -- network ---------------------------------------------------------------------------------------------------

#: Patterns of calls, of personal data and of routes that results depend on.
URL_LITERAL = r"['\"]https?:\/\/([^'\"/]+)([^'\"]*)['\"]"
WEB_SOCKET = r"new\s+WebSocket\s*\(\s*['\"]wss?:\/\/([^'\"/]+)"
BEACON = r"sendBeacon\s*\(\s*['\"]https?:\/\/([^'\"/]+)"
FETCH = r"(?:fetch|axios\.(?:get|post|put|patch|delete)|axios|http\.get|https\.get|http\.request|https\.request)\s*\(\s*['\"]https?:\/\/([^'\"/\s]+)"


def endpoints(lines: DataFrame) -> DataFrame:
    """file, line, domain, path, method, known, suspicious; url literals and calls count once for the whole code base."""
    t = F.col("text")

    def of(pattern: str, method: str, path: Column | None = None):
        hits = F.arrays_zip(F.regexp_extract_all(t, F.lit(f"(?i){pattern}"), F.lit(1)).alias("domain"), (path if path is not None else F.array().cast("array<string>")).alias("path"))
        return lines.select("file", "line", F.explode(hits).alias("h")).select("file", "line", "h.domain", "h.path", F.lit(method).alias("method"))

    urls = of(URL_LITERAL, "url", F.regexp_extract_all(t, F.lit(f"(?i){URL_LITERAL}"), F.lit(2)))
    urls = urls.withColumn("path", F.when(F.col("path") == "", "/").otherwise(F.col("path")))
    once = urls.unionByName(of(FETCH, "fetch").withColumn("path", F.lit("/")))
    first = once.groupBy("method", "domain", "path").agg(F.min(F.struct("file", "line")).alias("at")).select("at.file", "at.line", "domain", "path", "method")
    more = of(WEB_SOCKET, "websocket").withColumn("path", F.lit("/ws")).unionByName(of(BEACON, "beacon").withColumn("path", F.lit("/beacon")))
    every = first.unionByName(more)
    plain = is_suspicious(F.col("domain"))
    return every.withColumns({"known": is_known(F.col("domain")), "suspicious": F.when(F.col("method") == "url", plain).otherwise(~is_known(F.col("domain")))})


def network_summary(found: DataFrame) -> DataFrame:
    return found.agg(
        F.count("*").alias("endpoints"), F.count_if("known").alias("known"), F.count_if(~F.col("known")).alias("unknown"), F.count_if("suspicious").alias("suspicious"), F.countDistinct("domain").alias("domains")
    )


# -- privacy ---------------------------------------------------------------------------------------------------

#: Names of personal fields, and where they are stored or sent.
PII_FIELDS = r"\b(?:email|phone|ssn|social_security|creditcard|credit_card|card_number|cvv|cvc|passport|dob|date_of_birth|bank_account|routing_number|address|zip|postal|first_name|last_name|fullname|birth|gender|nationality|ip_address|mac_address|device_id|biometric|fingerprint|location|latitude|longitude|avatar|profile_pic)\b"
STORAGE = [
    ("localStorage", "high", r"localStorage\.setItem\s*\(\s*['\"]([^'\"]+)['\"]"),
    ("sessionStorage", "high", r"sessionStorage\.setItem\s*\(\s*['\"]([^'\"]+)['\"]"),
    ("cookie", "medium", r"document\.cookie\s*=\s*['\"]?([^=;'\"]+)"),
    ("IndexedDB", "medium", r"IndexedDB|indexedDB\.open"),
    ("SharedPreferences (Android)", "high", r"SharedPreferences|getSharedPreferences"),
    ("UserDefaults (iOS)", "high", r"UserDefaults\.standard"),
    ("AsyncStorage (React Native)", "high", r"AsyncStorage\.setItem"),
    ("file", "medium", r"fs\.writeFile|fs\.writeFileSync|fs\.appendFile"),
    ("database", "medium", r"CREATE\s+TABLE|createCollection|createTable|schema\.model|schema\.define"),
]
TRANSMISSION = [
    ("fetch", r"fetch\s*\(\s*['\"]https?:\/\/(?!localhost|127\.0\.0\.1)"),
    ("axios", r"axios\.(?:get|post|put|patch|delete)\s*\(\s*['\"]https?:\/\/(?!localhost|127\.0\.0\.1)"),
    ("XHR", r"XMLHttpRequest|xhr\.open"),
    ("beacon", r"(?:sendBeacon|navigator\.sendBeacon)\s*\("),
    ("AI API", r"https?:\/\/api\.(?:openai|anthropic|googleapis|gemini)\.com"),
    ("Google Analytics", r"https?:\/\/www\.google-analytics\.com|gtag\(|dataLayer\.push"),
    ("Mixpanel", r"https?:\/\/api\.mixpanel\.com|mixpanel\.(?:track|identify)"),
    ("Social tracking", r"https?:\/\/t\.co|https?:\/\/connect\.facebook\.net|fbq\("),
    ("Sentry", r"https?:\/\/sentry\.io|Sentry\.capture"),
    ("Amplitude", r"https?:\/\/api\.amplitude\.com|amplitude\.(?:logEvent|setUserId)"),
    ("Segment", r"https?:\/\/api\.segment\.com|analytics\.(?:track|identify|page)"),
    ("PostHog", r"posthog\.(?:capture|identify)"),
]
CLIENT_STORAGE = ["localStorage", "sessionStorage", "AsyncStorage (React Native)", "SharedPreferences (Android)"]
ANALYTICS = ["Google Analytics", "Mixpanel", "Amplitude", "Segment", "PostHog"]
CONSENT = r"consent|gdpr|ccpa|opt.?in|opt.?out|cookie.?banner|privacy.?policy|do.?not.?track|dnt|permission"
ENCRYPTION = r"encrypt|decrypt|cipher|aes|rsa|bcrypt|argon2|scrypt|pbkdf2|crypto\.(?:createCipher|createDecipher|randomBytes)"
RETENTION = r"retention|ttl|expire|expir(?:e|ation|y)|purge|cleanup|delete\s+after|drop\s+after|max.?age"


def _count(t: Column, pattern: str) -> Column:
    return F.size(F.regexp_extract_all(t, F.lit(java(pattern)), F.lit(0)))


def privacy_audit(lines: DataFrame) -> DataFrame:
    """One row: pii_fields (sorted), counts of storage, transmission, consent, encryption and retention points, risks, overall_risk."""
    t = F.col("text")
    fields = F.transform(F.regexp_extract_all(t, F.lit(java(PII_FIELDS)), F.lit(0)), lambda x: F.lower(x))
    total = lambda items: sum((_count(t, p) for *_, p in items), F.lit(0))
    some = lambda items, names: F.max(F.greatest(*[_count(t, p) for n, *_, p in items if n in names], F.lit(0)))
    a = lines.agg(
        F.sort_array(F.array_distinct(F.flatten(F.collect_set(F.when(F.size(fields) > 0, fields))))).alias("pii_fields"),
        F.coalesce(F.sum(total(STORAGE)), F.lit(0)).alias("storage"), F.coalesce(F.sum(total(TRANSMISSION)), F.lit(0)).alias("transmission"),
        F.count_if(matches(t, CONSENT)).alias("consent"), F.count_if(matches(t, ENCRYPTION)).alias("encryption"), F.count_if(matches(t, RETENTION)).alias("retention"),
        some(STORAGE, CLIENT_STORAGE).alias("_client"), some(TRANSMISSION, ["AI API"]).alias("_ai"), some(TRANSMISSION, ANALYTICS).alias("_analytics"),
    )
    pii = F.size("pii_fields") > 0
    tests = [
        (pii & (F.col("encryption") == 0), "high", "no encryption"), (pii & (F.col("consent") == 0), "high", "no consent"), (pii & (F.col("retention") == 0), "medium", "no retention"),
        (F.col("_client") > 0, "high", "client-side storage"), ((F.col("_ai") > 0) & (F.col("encryption") == 0), "high", "sent to models"), ((F.col("_analytics") > 0) & (F.col("consent") == 0), "high", "analytics without consent"),
    ]
    risks = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(s).alias("severity"), F.lit(m).alias("risk"))) for c, s, m in tests]))
    has = lambda s: F.exists("risks", lambda r: r["severity"] == s)
    return a.withColumn("risks", risks).withColumn("overall_risk", F.when(has("high"), "HIGH").when(has("medium"), "MEDIUM").otherwise("LOW")).drop("_client", "_ai", "_analytics")


# -- data sent to models ----------------------------------------------------------------------------------------

#: Calls of providers.
AI_CALLS = [
    ("OpenAI", r"openai\.(?:chat\.completions|completions|embeddings|images|audio)"), ("OpenAI", r"https?:\/\/api\.openai\.com\/v1\/"),
    ("Anthropic", r"anthropic\.(?:messages|completions)"), ("Anthropic", r"https?:\/\/api\.anthropic\.com\/v1\/"),
    ("Google Gemini", r"(?:google\.generativeai|genai|gemini)\.(?:generateContent|generate)"), ("Google Gemini", r"https?:\/\/generativelanguage\.googleapis\.com"),
    ("Cohere", r"https?:\/\/api\.cohere\.com"), ("Mistral", r"https?:\/\/api\.mistral\.ai"), ("Together AI", r"https?:\/\/api\.together\.xyz"), ("Groq", r"https?:\/\/api\.groq\.com"),
    ("Perplexity", r"https?:\/\/api\.perplexity\.ai"), ("xAI (Grok)", r"https?:\/\/api\.x\.ai"), ("DeepSeek", r"https?:\/\/api\.deepseek\.com"), ("Replicate", r"https?:\/\/api\.replicate\.com"),
]
#: Patterns of calls, of personal data and of routes that results depend on.
USER_DATA = r"\b(?:req\.body|req\.query|req\.params|request\.body|request\.query|request\.data|userInput|userText|userMessage)\b"
PII_WORDS = r"\b(?:email|phone|ssn|address|password|credit.?card|cvv|dob|name|ip.?address)\b"
REDACTION = r"redact|anonym|mask|scrub|sanitize|detectPII|redactText"


def ai_data(lines: DataFrame) -> DataFrame:
    """file, line, provider, severity, has_redaction: calls of models with user or personal data within five lines."""
    t = F.col("text")
    provider = F.coalesce(*[F.when(matches(t, p), F.lit(n)) for n, p in AI_CALLS])
    df = lines.withColumns({"provider": provider, "_data": near(matches(t, USER_DATA) | matches(t, PII_WORDS), "file", 5, 5), "has_redaction": near(matches(t, REDACTION), "file", 5, 5)})
    hit = df.where("provider is not null and _data")
    return hit.select("file", "line", "provider", F.when(F.col("has_redaction"), "low").otherwise("high").alias("severity"), "has_redaction")


# -- routes ---------------------------------------------------------------------------------------------------------

#: Patterns of calls, of personal data and of routes that results depend on.
ROUTE = r"(?:app|router|server)\.(?:get|post|put|delete|patch|all|use)\s*\(\s*['\"`]([^'\"`]+)['\"`]"
GUARD = r"(?:requireAuth|withAuth|protect|guard|authMiddleware|isAuthenticated|verifyToken|authenticate|clerkMiddleware|auth\(\)|getServerSession|getSession)"


def routes(lines: DataFrame) -> DataFrame:
    """file, line, path, protected of the routes on each line; protected: a guard follows on the line."""
    hit = F.regexp_extract_all("text", F.lit(f"(?i){ROUTE}"), F.lit(1))
    after = F.expr("substring_index(text, path, -1)")
    rows = lines.select("file", "line", "text", F.explode(hit).alias("path"))
    return rows.select("file", "line", "path", matches(after, GUARD).alias("protected"))


def auth_coverage(found: DataFrame) -> DataFrame:
    """routes, protected, unprotected (of /api/), coverage percent (100 without routes)."""
    a = found.agg(F.count("*").alias("routes"), F.count_if("protected").alias("protected"), F.count_if(~F.col("protected") & F.col("path").startswith("/api/")).alias("unprotected"))
    return a.withColumn("coverage", F.when(F.col("routes") > 0, F.floor(F.col("protected") / F.col("routes") * 100 + 0.5)).otherwise(100).cast("int"))


# -- compliance -------------------------------------------------------------------------------------------------------

def compliance(findings: DataFrame, rules: DataFrame, controls: DataFrame) -> DataFrame:
    """framework, control, n_findings, rules: controls that findings fail, by their rules' weakness (rules: rule_id, cwe; controls: framework, cwe, control)."""
    j = findings.join(rules.select("rule_id", F.col("cwe").alias("_cwe")), "rule_id", "left")
    cwe = F.regexp_extract(F.coalesce(F.col("cwe") if "cwe" in findings.columns else F.lit(None).cast("string"), "_cwe"), r"CWE-[0-9]+", 0)
    hit = j.withColumn("_k", cwe).join(controls.withColumnRenamed("cwe", "_k"), "_k")
    return hit.groupBy("framework", "control").agg(F.count("*").alias("n_findings"), F.sort_array(F.collect_set("rule_id")).alias("rules"))


def compliance_summary(failing: DataFrame) -> DataFrame:
    return failing.groupBy("framework").agg(F.countDistinct("control").alias("failing"), F.sum("n_findings").alias("n_findings"))


# -- threats and gates ----------------------------------------------------------------------------------------------

#: Facts of a code base: name, pattern of content.
FACTS = [
    ("api", r"app\.(?:get|post|put|delete)\s*\(|router\."), ("database", r"(?:SELECT|INSERT|UPDATE|DELETE)\s|mongoose|prisma|sequelize|knex"), ("auth", r"login|signin|session|jwt|passport"),
    ("uploads", r"multer|upload|formidable"), ("models", r"openai|anthropic|llm|langchain"), ("secrets", r"process\.env|os\.environ|secret"), ("external", r"fetch\(|axios|https?://"),
]
THREATS = {"api": "injection", "database": "data theft", "auth": "account takeover", "uploads": "malicious files", "models": "prompt injection", "secrets": "leaked credentials", "external": "request forgery"}


def threat_model(files: DataFrame) -> DataFrame:
    """surface, threat, present, n_files of a code base (file, content)."""
    c = F.col("content")
    found = files.select(F.explode(F.array(*[F.struct(F.lit(n).alias("surface"), F.lit(THREATS[n]).alias("threat"), matches(c, p).alias("hit")) for n, p in FACTS])).alias("f")).select("f.*")
    return found.groupBy("surface", "threat").agg(F.bool_or("hit").alias("present"), F.count_if("hit").alias("n_files"))


def deploy_gates(gates: DataFrame) -> DataFrame:
    """n_gates, ready, failed, unknown of gates (gate, passed: null is unknown); unknown gates hold a deployment back, and so do none at all."""
    return gates.agg(
        F.count("*").alias("n_gates"),
        F.coalesce(F.bool_and(F.coalesce("passed", F.lit(False))), F.lit(False)).alias("ready"),
        F.sort_array(F.collect_list(F.when(~F.col("passed"), F.col("gate")))).alias("failed"),
        F.sort_array(F.collect_list(F.when(F.col("passed").isNull(), F.col("gate")))).alias("unknown"),
    )


def rls_missing(files: DataFrame) -> DataFrame:
    """file, line, table: tables that are created in any SQL file and for which none enables row-level security."""
    sql = files.where(matches(F.col("file"), r"\.sql$"))
    bare = lambda c: F.lower(F.regexp_replace(c, r"(?i)^public\.", ""))
    on = sql.select(F.explode(F.regexp_extract_all("content", F.lit(r"(?i)alter\s+table\s+(?:public\.)?[\"'`]?([A-Za-z0-9_.]+)[\"'`]?\s+enable\s+row\s+level\s+security"), F.lit(1))).alias("t")).select(bare(F.col("t")).alias("table")).distinct()
    lines = sql.select("file", F.posexplode(F.split("content", "\r?\n", -1)).alias("pos", "text"))
    made = lines.select("file", (F.col("pos") + 1).alias("line"), bare(F.regexp_extract("text", r"(?i)create\s+table\s+(?:if\s+not\s+exists\s+)?[\"'`]?([A-Za-z0-9_.]+)", 1)).alias("table")).where("table <> ''")
    return made.join(on, "table", "left_anti").select("file", "line", "table")


def project_files(paths: DataFrame, ignored: bool) -> DataFrame:
    """rule_id, file, severity of a project's list of paths: environment files not ignored or served, no lockfile."""
    p = F.col("path")
    env = paths.where(p.isin(".env", ".env.local", ".env.production", ".env.development") & F.lit(not ignored)).select(F.lit("project.env-not-ignored").alias("rule_id"), p.alias("file"), F.lit("critical").alias("severity"))
    served = paths.where(p.rlike(r"^(?:public|static|dist|www)/\.env(?:\.local)?$")).select(F.lit("project.env-exposed").alias("rule_id"), p.alias("file"), F.lit("critical").alias("severity"))
    a = paths.agg(F.coalesce(F.bool_or(p == "package.json"), F.lit(False)).alias("m"), F.coalesce(F.bool_or(p.isin("package-lock.json", "yarn.lock", "pnpm-lock.yaml", "npm-shrinkwrap.json")), F.lit(False)).alias("l"))
    lock = a.where("m and not l").select(F.lit("package.no-lockfile").alias("rule_id"), F.lit("package.json").alias("file"), F.lit("low").alias("severity"))
    return env.unionByName(served).unionByName(lock)


#: What hooks and settings of agents may not do.
DOCTOR = [("hook-remote-code", r"(?:curl|wget)[^|]*\|\s*(?:sh|bash)|rm\s+-rf|base64\s+-d"), ("base-url-override", r"_BASE_URL|baseURL|base_url"), ("raw-shell-server", r"\"command\"\s*:\s*\"(?:sh|bash|zsh|cmd|powershell)\"")]


def doctor(files: DataFrame) -> DataFrame:
    """file, check of agents' settings (file, content)."""
    c = F.col("content")
    return files.select("file", F.explode(F.array_compact(F.array(*[F.when(matches(c, p), F.lit(n)) for n, p in DOCTOR]))).alias("check"))
