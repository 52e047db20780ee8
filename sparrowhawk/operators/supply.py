"""Dependencies, lockfiles, components, advisories and server configurations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.commands import secrets_in
from ..functions.packages import dangerous_script, is_vulnerable, license_compliant, license_risk, meant, package_risks, pin_risk
from ..functions.prompts import config_injection
from ..functions.text import matches
from ..schema import choose

MANIFEST = "struct<name:string,version:string,license:string,scripts:map<string,string>,dependencies:map<string,string>,devDependencies:map<string,string>,optionalDependencies:map<string,string>>"
LOCKED = "struct<version:string,resolved:string,integrity:string,license:string>"
LOCKFILE = f"struct<packages:map<string,{LOCKED}>,dependencies:map<string,{LOCKED}>>"
#: Built into the runtime; imports of these are not packages.
BUILTINS = [
    "assert", "buffer", "child_process", "cluster", "console", "crypto", "dgram", "dns", "events", "fs", "http", "http2", "https", "module", "net",
    "os", "path", "perf_hooks", "process", "punycode", "querystring", "readline", "stream", "string_decoder", "timers", "tls", "tty", "url", "util", "v8", "vm", "worker_threads", "zlib",
]
IMPORT = r"""(?:require\(\s*|from\s+|import\s+|import\(\s*)['"]([^'"]+)['"]"""


def dependencies(files: DataFrame) -> DataFrame:
    """file, package, version of manifests (file, content); where a package is listed twice the later section counts."""
    m = F.from_json("content", MANIFEST)
    empty = F.create_map().cast("map<string,string>")
    part = lambda n: F.coalesce(m[n], empty)
    dev, opt = part("devDependencies"), part("optionalDependencies")
    only = lambda a, *over: F.map_filter(a, lambda k, _: ~F.coalesce(sum((F.map_contains_key(o, k).cast("int") for o in over), F.lit(0)) > 0, F.lit(False)))
    every = F.map_concat(only(part("dependencies"), dev, opt), only(dev, opt), opt)
    return files.select("file", F.explode(every).alias("package", "version"))


def lock_components(files: DataFrame) -> DataFrame:
    """file, package, version, resolved, integrity, license of lockfiles; nested copies are skipped."""
    lock = F.from_json("content", LOCKFILE)
    rows = files.select("file", F.explode(F.coalesce(lock["packages"], lock["dependencies"])).alias("path", "info"))
    name = F.regexp_replace("path", "^node_modules/", "")
    return rows.where((F.col("path") != "") & ~name.contains("node_modules/")).select("file", name.alias("package"), "info.*")


def lock_audit(components: DataFrame) -> DataFrame:
    """package, type, severity: no integrity hash, or resolved outside the registry."""
    local = F.coalesce(F.col("resolved").contains("file:"), F.lit(False))
    kinds = F.array_compact(
        F.array(
            F.when(F.coalesce(F.col("integrity"), F.lit("")).eqNullSafe("") & ~local, F.struct(F.lit("missing_integrity").alias("type"), F.lit("high").alias("severity"))),
            F.when(~F.col("resolved").contains("registry.npmjs.org"), F.struct(F.lit("non_registry").alias("type"), F.lit("medium").alias("severity"))),
        )
    )
    return components.select("package", F.explode(kinds).alias("k")).select("package", "k.*")


def dependency_totals(files: DataFrame) -> DataFrame:
    """file, packages, with_integrity, dev of lockfiles (file, content), of whichever section they have; nested copies count."""
    entry = "struct<version:string,integrity:string,dev:boolean>"
    lock = F.from_json("content", f"struct<packages:map<string,{entry}>,dependencies:map<string,{entry}>>")
    every = F.filter(F.map_entries(F.coalesce(lock["dependencies"], lock["packages"])), lambda e: e["key"] != "")
    rows = files.select("file", every.alias("e")).where("e is not null")
    n = lambda test: F.size(F.filter("e", test)).cast("long")
    return rows.select("file", F.size("e").cast("long").alias("packages"), n(lambda e: F.coalesce(e["value"]["integrity"], F.lit("")) != "").alias("with_integrity"), n(lambda e: F.coalesce(e["value"]["dev"], F.lit(False))).alias("dev"))


def npm_audit(files: DataFrame) -> DataFrame:
    """file, package, severity, title of npm's audit reports (file, content); a package's title is that of its first advisory, or the package it comes by."""
    report = F.from_json("content", "struct<vulnerabilities:map<string,struct<name:string,severity:string,via:array<string>>>>")
    rows = files.select("file", F.explode(report["vulnerabilities"]).alias("package", "v")).select("file", "package", "v.severity", F.try_element_at("v.via", F.lit(1)).alias("first"))
    return rows.select("file", "package", F.coalesce(choose(F.col("severity"), EXTERNAL_SEVERITY), F.lit("medium")).alias("severity"), F.coalesce(F.get_json_object("first", "$.title"), F.concat(F.lit("by "), "first")).alias("title"))


def pip_audit(files: DataFrame) -> DataFrame:
    """file, package, version, id, fix of pip's audit reports (file, content): fix is the first version without the fault, if there is one."""
    item = "struct<name:string,version:string,vulns:array<struct<id:string,fix_versions:array<string>>>>"
    report = F.coalesce(F.from_json("content", f"struct<dependencies:array<{item}>>")["dependencies"], F.from_json("content", f"array<{item}>"))
    rows = files.select("file", F.explode(report).alias("d")).select("file", F.col("d.name").alias("package"), F.col("d.version").alias("version"), F.explode("d.vulns").alias("v"))
    return rows.select("file", "package", "version", F.col("v.id").alias("id"), F.try_element_at("v.fix_versions", F.lit(1)).alias("fix"))


def dependency_findings(deps: DataFrame) -> DataFrame:
    """deps (package, version) with type and severity of each risk of name and version."""
    pin = pin_risk(F.col("version"))
    item = lambda t, s: F.struct(t.alias("type"), s.alias("severity"), F.lit("warn").alias("action"))
    risks = F.concat(package_risks(F.col("package")), F.array_compact(F.array(F.when(pin.isNotNull(), item(pin, F.when(pin == "unpinned", "high").otherwise("medium"))))))
    return deps.withColumn("r", F.explode(risks)).select(*deps.columns, "r.*")


def advisories(deps: DataFrame, cves: DataFrame) -> DataFrame:
    """deps joined to advisories (package, cve, severity, below: array of bounds) that their version falls under."""
    hit = F.exists("below", lambda b: is_vulnerable(F.col("version"), b))
    return deps.join(cves, "package").where(hit).drop("below")


def reachability(vulnerable: DataFrame, imports: DataFrame) -> DataFrame:
    """vulnerable (package, ...) with reachable: whether any file imports the package."""
    used = imports.select("package").distinct().withColumn("_used", F.lit(True))
    return vulnerable.join(used, "package", "left").withColumn("reachable", F.coalesce("_used", F.lit(False))).drop("_used")


def imports(files: DataFrame) -> DataFrame:
    """file, package of imports and requires; relative paths and built-in modules are left out, scoped names kept whole."""
    raw = F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(IMPORT), F.lit(1))))
    rows = files.select("file", raw.alias("target")).where(~F.col("target").rlike(r"^[./]|^node:"))
    name = F.when(F.col("target").startswith("@"), F.regexp_extract("target", r"^(@[^/]+/[^/]+)", 1)).otherwise(F.split("target", "/")[0])
    return rows.select("file", name.alias("package")).where((F.col("package") != "") & ~F.col("package").isin(*BUILTINS)).distinct()


def unknown_packages(imported: DataFrame, known: DataFrame) -> DataFrame:
    """Distinct imported packages that a registry (package) doesn't have, with what they may have meant."""
    return imported.select("package").distinct().join(known.select("package").distinct(), "package", "left_anti").withColumn("meant", meant(F.col("package")))


def manifest_audit(files: DataFrame) -> DataFrame:
    """file, subject, type, severity: dangerous scripts, licences, versions that are not pinned."""
    m = F.from_json("content", MANIFEST)
    parsed = files.select("file", m.alias("m"))
    scripts = parsed.select("file", F.explode("m.scripts").alias("subject", "script")).where(dangerous_script(F.col("script")))
    scripts = scripts.select("file", "subject", F.lit("dangerous_script").alias("type"), F.when(F.col("subject") == "postinstall", "critical").otherwise("high").alias("severity"))
    lic = F.col("m.license")
    licences = parsed.where(license_risk(lic).isNotNull()).select("file", lic.alias("subject"), F.when(F.coalesce(lic, F.lit("")) == "", "no_license").otherwise("license").alias("type"), license_risk(lic).alias("severity"))
    loose = dependencies(files).where(F.col("version").isin("*", "latest", "")).select("file", F.col("package").alias("subject"), F.lit("unpinned").alias("type"), F.lit("high").alias("severity"))
    return scripts.unionByName(licences).unionByName(loose)


def license_report(components: DataFrame) -> DataFrame:
    """components with compliant; licences that are not known are not."""
    return components.withColumn("compliant", license_compliant(F.col("license")))


def sbom(components: DataFrame, imported: DataFrame | None = None, by: list[str] = ()) -> DataFrame:
    """CycloneDX documents (by, sbom: JSON text) of the components (package, version, license), sorted by name.

    by: columns that tell projects apart, as file does; without them all components are one
    document, which a single task must hold. A component that is listed twice is told once.
    """
    c = components.dropDuplicates([*by, "package", "version"])
    if imported is not None:
        used = imported.groupBy("package").agg(F.sort_array(F.collect_set("file")).alias("used_by"))
        c = c.join(used, "package", "left")
    item = F.struct(
        F.lit("library").alias("type"), F.col("package").alias("name"), "version", F.concat(F.lit("pkg:npm/"), F.col("package"), F.lit("@"), F.col("version")).alias("purl"), *(["used_by"] if imported is not None else [])
    )
    rows = F.sort_array(F.collect_list(F.struct("package", item.alias("c"))))
    return c.groupBy(*by).agg(F.to_json(F.struct(F.lit("CycloneDX").alias("bomFormat"), F.lit("1.5").alias("specVersion"), F.lit(1).alias("version"), F.transform(rows, lambda r: r["c"]).alias("components"))).alias("sbom"))


# -- configurations of agents' servers ------------------------------------------------------------------------

SERVER = "struct<command:string,args:array<string>,env:map<string,string>,description:string>"


def servers(files: DataFrame) -> DataFrame:
    """file, server, command, args, env, description, hash of configurations (file, content)."""
    cfg = F.from_json("content", f"struct<mcpServers:map<string,{SERVER}>,servers:map<string,{SERVER}>>")
    rows = files.select("file", F.explode(F.coalesce(cfg["mcpServers"], cfg["servers"])).alias("server", "cfg"))
    return rows.select("file", "server", "cfg.*", F.left(F.sha2(F.to_json("cfg"), 256), F.lit(16)).alias("hash"))


def server_audit(rows: DataFrame) -> DataFrame:
    """server, id, severity, detail of what is wrong with servers' definitions."""
    args = F.coalesce("args", F.array().cast("array<string>"))
    text, command = F.array_join(args, " "), F.coalesce("command", F.lit(""))
    item = lambda i, s, d=F.lit(None).cast("string"): F.struct(F.lit(i).alias("id"), (s if isinstance(s, Column) else F.lit(s)).alias("severity"), d.alias("detail"))
    poisoned = F.transform(config_injection(F.concat_ws("\n", "server", text, F.coalesce("description", F.lit("")))), lambda k: item("mcp.tool-poisoning", "critical", k))
    package = F.try_element_at(F.filter(args, lambda a: (a != "") & ~a.startswith("-") & (a != "dlx")), F.lit(1))
    pinned = F.when(package.startswith("@"), F.substring(package, 2, 10_000).contains("@")).otherwise(package.contains("@"))
    auto = F.exists(args, lambda a: a.isin("-y", "--yes"))
    broad = F.try_element_at(F.filter(args, lambda a: a.isin("/", "~") | a.rlike(r"^[A-Za-z]:[\\/]$")), F.lit(1))
    single = F.array_compact(
        F.array(
            F.when(matches(command, r"^(?:sh|bash|zsh|cmd|powershell)$") | text.rlike(r"\|\s*(?:sh|bash|zsh)(?![A-Za-z0-9_])"), item("mcp.remote-code", "critical")),
            F.when(text.rlike("https?://") & matches(F.concat_ws(" ", command, text), r"(?:curl|wget|node|deno|bun)\b"), item("mcp.remote-fetch-exec", "critical")),
            F.when(matches(command, r"^(?:npx|bunx|pnpm)$") & ~pinned, item("mcp.unpinned-install", F.when(auto, "high").otherwise("medium"), package)),
            F.when(broad.isNotNull() & matches(F.concat_ws(" ", "server", text), "file|fs|filesystem"), item("mcp.broad-filesystem", "high", broad)),
        )
    )
    leaked = F.transform(F.filter(F.map_entries(F.coalesce("env", F.create_map().cast("map<string,string>"))), lambda e: F.size(secrets_in(e["value"])) > 0), lambda e: item("mcp.secret-in-config", "critical", e["key"]))
    return rows.select("server", F.explode(F.concat(poisoned, single, leaked)).alias("f")).select("server", "f.*")


def drifted(rows: DataFrame, pins: DataFrame) -> DataFrame:
    """Servers (server, hash) whose definition differs from the pinned one (server, hash)."""
    return rows.join(pins.select("server", F.col("hash").alias("pinned")), "server").where("hash <> pinned").select("server", "pinned", "hash")


# -- results of other tools --------------------------------------------------------------------------------------

#: Other tools' severities.
EXTERNAL_SEVERITY = {"ERROR": "high", "WARNING": "medium", "INFO": "low", "HIGH": "high", "MEDIUM": "medium", "LOW": "low", "CRITICAL": "critical", "moderate": "medium", "critical": "critical", "high": "high", "low": "low", "info": "low"}


def external_findings(rows: DataFrame, tool: str, rule: str, severity: str, file: str, line: str, message: str) -> DataFrame:
    """Findings of another tool's rows, by the columns that hold them; unknown severities are medium."""
    s = F.coalesce(choose(F.col(severity), EXTERNAL_SEVERITY), F.lit("medium"))
    return rows.select(
        F.concat(F.lit(f"{tool}."), F.col(rule)).alias("rule_id"), s.alias("severity"), F.lit("medium").alias("confidence"), F.col(file).alias("file"), F.col(line).cast("int").alias("line"), F.lit(1).alias("column"), F.col(message).alias("message")
    )
