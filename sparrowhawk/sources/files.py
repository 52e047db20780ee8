"""Readers: trees of files, line-wise JSON, transcripts, patches, other tools' reports, rule packs."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions.text import strip
from ..operators.catalog import CORE, Rule
from ..operators.lines import MAX_FILE, is_binary, scannable


def _env_files(spark: SparkSession, root: str) -> DataFrame | None:
    """path, length, content of environment files at any depth. They are hidden files, which Spark's listings leave out; they are few and small, and come through the driver's file system."""
    jvm = spark._jvm
    fs = jvm.org.apache.hadoop.fs.Path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    every, found = fs.listFiles(jvm.org.apache.hadoop.fs.Path(root), True), []
    while every.hasNext():
        x = every.next()
        if x.getPath().getName().startswith(".env") and x.getLen() <= MAX_FILE:
            found.append(x)
    rows = []
    for x in found:
        stream = fs.open(x.getPath())
        try:
            rows.append((str(x.getPath()), x.getLen(), bytearray(jvm.org.apache.commons.io.IOUtils.toByteArray(stream))))
        finally:
            stream.close()
    return spark.createDataFrame(rows, "path string, length long, content binary") if rows else None


def file_tree(spark: SparkSession, root: str) -> DataFrame:
    """file, content of the text files below root that are scanned; paths and lengths are looked at before contents."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length", "content")
    hidden = _env_files(spark, root)
    raw = raw if hidden is None else raw.unionByName(hidden)
    base = root.rstrip("/").split("://")[-1].removeprefix("file:")
    rel = F.regexp_replace("path", f"^.*{re.escape(base)}/", "")
    kept = raw.select(rel.alias("file"), "length", "content").where(scannable(F.col("file"), F.col("length")) & ~is_binary(F.col("content")))
    return kept.select("file", F.decode("content", "UTF-8").alias("content"))


def file_stream(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """The same as a stream of new files: a watch."""
    schema = T.StructType([T.StructField("path", T.StringType()), T.StructField("modificationTime", T.TimestampType()), T.StructField("length", T.LongType()), T.StructField("content", T.BinaryType())])
    raw = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(root)
    return raw.select("path", F.col("modificationTime").alias("ts"), F.decode("content", "UTF-8").alias("content"))


def config(spark: SparkSession, path: str) -> dict:
    """A configuration file as a dict; {} if it is missing or malformed. It is a small file."""
    try:
        text = "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())
        out = json.loads(text)
    except Exception as e:  # a malformed configuration means the defaults
        if not isinstance(e, ValueError) and "PATH_NOT_FOUND" not in str(e):
            raise
        return {}
    return out if isinstance(out, dict) else {}


MESSAGE = "role string, type string, content string, message string, text string"


def transcripts(files: DataFrame) -> DataFrame:
    """file, turn, role, text of chat files (file, content): JSON by line, a JSON array, or text with User:/Assistant: markers.

    Lines that don't parse are left out.
    """
    c = F.col("content")
    read = lambda rows, x: rows.select("file", "_n", F.from_json(x, MESSAGE).alias("m")).select("file", F.col("_n").alias("turn"), F.coalesce("m.role", "m.type").alias("role"), F.coalesce("m.content", "m.message", "m.text").alias("text")).where("role is not null or text is not null")
    by_line = read(files.where(F.col("file").endswith(".jsonl")).select("file", F.posexplode(F.split(c, "\n")).alias("_n", "x")), F.col("x"))
    arrays = files.where(F.col("file").endswith(".json")).select("file", F.posexplode(F.from_json(c, f"array<struct<{MESSAGE.replace(' string', ':string')}>>")).alias("_n", "m"))
    arrays = arrays.select("file", F.col("_n").alias("turn"), F.coalesce("m.role", "m.type").alias("role"), F.coalesce("m.content", "m.message", "m.text").alias("text"))
    plain = files.where(~F.col("file").rlike(r"\.jsonl?$")).select("file", F.posexplode(F.split(c, r"(?m)^(?:User|Human|Assistant|AI|>>>)[:\s]")).alias("_n", "x"))
    plain = plain.where(strip(F.col("x")) != "").select("file", F.col("_n").alias("turn"), F.when(F.col("_n") % 2 == 0, "user").otherwise("assistant").alias("role"), strip(F.col("x")).alias("text"))
    return by_line.unionByName(arrays).unionByName(plain)


# -- patches -----------------------------------------------------------------------------------------------

def added_lines(logs: DataFrame) -> DataFrame:
    """commit, file, line, text of the lines that patches (id, content: output of a log with patches) add.

    Each commit is a row of its own after a split, so that a long history is spread.
    """
    commit = F.explode(F.split("content", r"(?m)^(?=commit [0-9a-f]{7,})"))
    rows = logs.select("id", commit.alias("c")).select("id", F.regexp_extract("c", r"^commit ([0-9a-f]{10})", 1).alias("commit"), "c")
    part = rows.select("id", "commit", F.explode(F.split("c", r"(?m)^\+\+\+ b/")).alias("p")).where(F.col("p").rlike(r"(?m)^@@ "))
    named = part.select("id", "commit", F.regexp_extract("p", r"^([^\n]*)", 1).alias("file"), F.explode(F.split("p", r"(?m)^(?=@@ )")).alias("h")).where(F.col("h").startswith("@@ "))
    first = F.regexp_extract("h", r"^@@ [^+]*\+(\d+)", 1).cast("int")
    lines = F.filter(F.split(F.regexp_replace("h", r"^[^\n]*\n", ""), "\n"), lambda x: x.startswith("+") | x.startswith(" "))
    out = named.select("id", "commit", "file", first.alias("_first"), F.posexplode(lines).alias("_n", "x")).where(F.col("x").startswith("+"))
    return out.select("id", "commit", "file", (F.col("_first") + F.col("_n")).alias("line"), F.expr("substring(x, 2)").alias("text"))


def earliest_commit(blobs: DataFrame) -> DataFrame:
    """path, commit of the first commit (path, commit, ts) that has each path."""
    return blobs.groupBy("path").agg(F.min_by("commit", F.struct("ts", "commit")).alias("commit"))


# -- other tools ---------------------------------------------------------------------------------------------

def semgrep(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema("results array<struct<check_id:string,path:string,start:struct<line:int,col:int>,extra:struct<severity:string,message:string>>>").json(path, multiLine=True)
    return raw.select(F.explode("results").alias("r")).select(F.col("r.check_id").alias("rule"), F.col("r.extra.severity").alias("severity"), F.col("r.path").alias("file"), F.col("r.start.line").alias("line"), F.col("r.extra.message").alias("message"))


def gitleaks(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema("RuleID string, File string, StartLine int, Description string").json(path, multiLine=True)
    return raw.select(F.col("RuleID").alias("rule"), F.lit("critical").alias("severity"), F.col("File").alias("file"), F.col("StartLine").alias("line"), F.col("Description").alias("message"))


def bandit(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema("results array<struct<test_id:string,filename:string,line_number:int,issue_severity:string,issue_text:string>>").json(path, multiLine=True)
    return raw.select(F.explode("results").alias("r")).select(F.col("r.test_id").alias("rule"), F.col("r.issue_severity").alias("severity"), F.col("r.filename").alias("file"), F.col("r.line_number").alias("line"), F.col("r.issue_text").alias("message"))


def image_scan(spark: SparkSession, path: str) -> DataFrame:
    """target, package, version, cve, severity of a container image's report."""
    raw = spark.read.schema("Results array<struct<Target:string,Vulnerabilities:array<struct<VulnerabilityID:string,PkgName:string,InstalledVersion:string,Severity:string>>>>").json(path, multiLine=True)
    v = raw.select(F.explode("Results").alias("r")).select(F.col("r.Target").alias("target"), F.explode("r.Vulnerabilities").alias("v"))
    return v.select("target", F.col("v.PkgName").alias("package"), F.col("v.InstalledVersion").alias("version"), F.col("v.VulnerabilityID").alias("cve"), F.lower("v.Severity").alias("severity"))


# -- rule packs --------------------------------------------------------------------------------------------------

_OBJECT = re.compile(r"\{\s*id:\s*(['\"])(?P<id>[^'\"]+)\1(?P<rest>.*?)\n?\s*\}\s*,?\s*(?=\n|\{|\]|$)", re.S)
_FIELD = re.compile(r"\b(severity|confidence|title|cwe):\s*(['\"])((?:\\.|(?!\2).)*)\2", re.S)
_REGEX = re.compile(r"\bre:\s*/((?:\\.|\[(?:\\.|[^\]\\])*\]|[^/\\\n\[])+)/([a-z]*)")
_TEST = r"/((?:\\.|\[(?:\\.|[^\]\\])*\]|[^/\\\n\[])+)/([a-z]*)\.test\((\w+)\)"
_UNLESS_LINE, _UNLESS_FILE = re.compile(r"\bfilter:\s*\(\w+[^)]*\)\s*=>\s*!" + _TEST), re.compile(r"\bfilter:\s*\([^)]*\)\s*=>\s*!\w+\.some\(\w+\s*=>\s*" + _TEST)
_FILE = re.compile(r"\bfileFilter:\s*/((?:\\.|\[(?:\\.|[^\]\\])*\]|[^/\\\n\[])+)/")


def rule_pack(spark: SparkSession, path: str, dead: tuple[str, ...] = ()) -> list[Rule]:
    """Rules of a pack given by path: JSON lines with Rule's fields, or source text of object literals ``{ id: '...', severity: '...', re: /.../i }``.

    A pack is a small file of rules; it is read through Spark, so that it may lie in any store.
    Rules without a pattern are left out; ids in dead are kept but not enabled. Filters of the
    forms ``(line) => !/../.test(line)`` and ``(..) => !lines.some(l => /../.test(l))`` are kept as
    patterns that excuse a line or a file; a rule whose filter is a function's body is matched
    without it.
    """
    text = "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())
    if path.endswith((".json", ".jsonl")):
        rows = [json.loads(x) for x in text.splitlines() if x.strip()]
        return [Rule(**{k: tuple(v) if isinstance(v, list) else v for k, v in r.items() if k in Rule.__dataclass_fields__}) for r in rows if r.get("pattern")]
    out = []
    for m in _OBJECT.finditer(text):
        body = m["rest"]
        fields = {f[0]: re.sub(r"\\(.)", r"\1", f[2]) for f in _FIELD.findall(body)}
        pattern, files = _REGEX.search(body), _FILE.search(body)
        if not pattern or fields.get("severity") not in ("critical", "high", "medium", "low"):
            continue
        source = pattern[1].replace("[^]", r"[\s\S]").replace(r"\/", "/")
        try:
            re.compile(source)
        except re.error:
            continue
        comments = "skipComments: true" in body
        unless = [m and ("(?i)" if "i" in m[2] else "") + m[1].replace(r"\/", "/") for m in (_UNLESS_LINE.search(body), _UNLESS_FILE.search(body))]
        out.append(Rule(m["id"], fields["severity"], source, fields.get("title", m["id"]), fields.get("confidence"), fields.get("cwe"), "i" in pattern[2], files[1] if files else None, comments, "skipInString: true" in body, enabled=m["id"] not in dead, unless_line=unless[0], unless_file=unless[1]))
    return out


#: The setting that names a pack by path.
PACK_KEY = "sparrowhawk.rules.pack"


def catalogue(spark: SparkSession, path: str | None = None) -> list[Rule]:
    """The core's rules and those of a pack: path, or else what the session's setting PACK_KEY names; rules of the core keep their ids."""
    path = path or spark.conf.get(PACK_KEY, None)
    own = {r.id for r in CORE}
    return [*CORE, *(r for r in rule_pack(spark, path) if r.id not in own)] if path else list(CORE)


def rules_table(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """The catalogue as a DataFrame."""
    names = [n for n in Rule.__dataclass_fields__ if n != "shaping"]
    kinds = [T.BooleanType() if n in ("ignore_case", "skip_comments", "skip_in_string", "enabled") else T.StringType() for n in names]
    return spark.createDataFrame([tuple(getattr(r, n) for n in names) for r in rules], T.StructType([T.StructField(n, k) for n, k in zip(names, kinds)]))
