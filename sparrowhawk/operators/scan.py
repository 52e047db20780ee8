"""A whole scan: every pass over files, brought together, superseded, suppressed, configured, deduplicated and graded."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, functions as F

from ..functions.text import fingerprint
from . import entropy, findings as ops
from .catalog import CORE, Rule
from .lines import explode_lines
from .plugins import Plugins, run_plugins
from .propagation import propagated
from .rules import custom_rules, file_rules, match_rules, shaping_functions, with_shaping
from .structure import analysed, replace_line_rules, structural
from .taint import JS_SINKS, cross_file_flows, flows

COLUMNS = ["pass_rank", "rule_id", "severity", "confidence", "title", "cwe", "file", "line", "column", "snippet"]
#: Findings on one place by two passes are told as the first pass's.
PASSES = ("line", "file", "propagation", "structure", "flow", "cross-file", "entropy", "plugin")


def _pass(df: DataFrame, name: str, **given) -> DataFrame:
    """df with the columns of findings; what a pass doesn't know is null, and its line and column 1."""
    known = {"pass_rank": F.lit(PASSES.index(name)), "title": F.col("rule_id"), "confidence": F.lit("medium"), "column": F.lit(1), "line": F.lit(1), "cwe": F.lit(None).cast("string"), "snippet": F.lit("")}
    has = lambda c: given[c] if c in given else F.col(c) if c in df.columns else known[c]
    return df.select(*[has(c).cast("int" if c in ("pass_rank", "line", "column") else "string").alias(c) for c in COLUMNS])


def passes(files: DataFrame, rules: Iterable[Rule] = CORE, shaping: tuple[str, ...] = (), plugins: Plugins | None = None) -> DataFrame:
    """The union of all passes over files (file, content): COLUMNS. shaping: further functions that take secrets out."""
    lines = _pass(match_rules(files, rules), "line")
    severity = {rule: s for rule, s, _, _ in JS_SINKS}
    cross = cross_file_flows(files)
    cross = cross.withColumn("severity", ops.choose(F.col("rule_id"), severity, "high")).withColumn("snippet", F.concat("target", F.lit("(...)")))
    quoted = entropy.quoted_high_entropy(files).select("file", "line", "column", F.lit("secret.high-entropy").alias("rule_id"), F.lit("high").alias("severity"), F.lit("low").alias("confidence"))
    tokens = entropy.high_entropy_tokens(files).select("file", "line", "column", F.lit("secret.high-entropy-token").alias("rule_id"), F.lit("high").alias("severity"))
    added = [_pass(x, "plugin") for x in run_plugins(files, plugins)] if plugins else []
    return ops.union_all(
        [
            lines,
            _pass(file_rules(files), "file"),
            _pass(propagated(files, shaping), "propagation"),
            _pass(structural(files), "structure"),
            _pass(flows(files), "flow"),
            _pass(cross, "cross-file"),
            _pass(quoted, "entropy"),
            _pass(tokens, "entropy"),
            *added,
        ]
    )


def generic_entropy(found: DataFrame) -> DataFrame:
    """Without random-looking values on lines where a rule for secrets has spoken."""
    from pyspark.sql import Window

    random = F.col("rule_id").startswith("secret.high-entropy")
    named = F.bool_or(F.col("rule_id").startswith("secret.") & ~random).over(Window.partitionBy("file", "line"))
    return found.withColumn("_named", named).where(~(random & F.col("_named"))).drop("_named")


def scan(files: DataFrame, rules: Iterable[Rule] = CORE, config: dict | None = None, name: str = "sparrowhawk", plugins: Plugins | None = None) -> DataFrame:
    """Findings of a whole scan of files (file, content), with fingerprint and suppressed.

    config: customRules, shapingFunctions, ignoreRules, ignorePaths, ignore (pairs), severityOverrides, minConfidence.
    plugins: what plugins.load gives; a configuration does not name any, as that would run code of the files that are scanned.
    Null files are left out; equal rows of files are scanned once each and told once.
    """
    config = config or {}
    shaping = shaping_functions(config)
    more = plugins.rules if plugins else []
    found = passes(files, with_shaping([*rules, *more, *custom_rules(config)], shaping), shaping, plugins)
    found = replace_line_rules(found, analysed(files))
    found = ops.dedupe(ops.supersede(generic_entropy(found)))
    found = ops.suppress_docs(found)
    found = ops.config_ignore(found, config.get("ignoreRules") or (), config.get("ignorePaths") or (), config.get("ignore") or ())
    found = ops.override_severity(found, config.get("severityOverrides") or {})
    if config.get("minConfidence"):
        found = ops.min_confidence(found, config["minConfidence"])
    kept, gone = ops.suppress_inline(found, ops.directives(explode_lines(files), name))
    out = kept.withColumn("suppressed", F.lit(False)).unionByName(gone.withColumn("suppressed", F.lit(True)))
    return out.withColumn("fingerprint", fingerprint(F.col("rule_id"), F.col("file"), F.col("snippet")))


def scan_grade(found: DataFrame) -> DataFrame:
    """Counts by severity and the grade of what a scan left unsuppressed."""
    return ops.grade(found.where(~F.col("suppressed")))


def corpus_scores(found: DataFrame, expected: DataFrame) -> DataFrame:
    """tp, fp, fn, precision, recall, f1 by category and over all, of a labelled corpus.

    expected: category, file, rule_id; a null rule_id is a clean file. Rules found are told once
    a file. What was not expected counts against precision unless its confidence is low.
    """
    hit = found.where(~F.col("suppressed")).groupBy("file", "rule_id").agg(F.max((F.col("confidence") != "low").cast("int")).alias("_sure"))
    files = expected.select("category", "file").distinct()
    wanted = expected.where("rule_id is not null").select("file", "rule_id").distinct().withColumn("_wanted", F.lit(True))
    both = hit.join(wanted, ["file", "rule_id"], "full_outer").join(files, "file")
    truth, fired = F.coalesce("_wanted", F.lit(False)), F.col("_sure").isNotNull()
    scored = both.select("category", truth.alias("truth"), F.when(truth, fired).otherwise(F.coalesce(F.col("_sure") == 1, F.lit(False))).alias("predicted"))
    return ops.precision_recall(scored, "category")
