"""The gates that a deployment passes: counts of what audits have found become pass, warn or fail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: From how many on frameworks' failing controls, unknown packages and ignored rules count.
FRAMEWORK_CONTROLS, UNKNOWN_PACKAGES, IGNORED_RULES = 3, 5, 20

#: gate, what fails it, what warns of it (conditions on facts; null facts are unknown), and whether strict turns the warning into a failure.
GATES = [
    ("static-scan", "criticals > 0", "highs > 0", True),
    ("secret-scan", "secrets > 0", None, False),
    ("history-scan", "env_tracked or history_secrets > 0", None, True),
    ("dependency-audit", "critical_advisories > 0", f"advisories > 0 or unknown_packages > {UNKNOWN_PACKAGES}", False),
    ("supply-chain", "supply_criticals > 0", "supply_risks > 0", False),
    ("privacy-audit", "privacy_highs > 0", "privacy_risks > 0", False),
    ("network-audit", "suspicious_domains > 0", "unknown_domains > 0", False),
    ("model-data", "model_criticals > 0", "model_highs > 0", False),
    ("compliance", None, "failing_frameworks > 0", False),
    ("configuration", "not env_ignored", None, False),
    ("self-check", "modified_modules > 0", "not manifest_known", False),
    ("tampering", None, f"ignored_rules > {IGNORED_RULES} or lowered_rules > 0", False),
    ("behaviour", "behaviour_criticals > 0", "behaviour_highs > 0", False),
]
#: Facts that are counts, and those that are flags.
COUNTS = ["criticals", "highs", "secrets", "history_secrets", "critical_advisories", "advisories", "unknown_packages", "supply_criticals", "supply_risks", "privacy_highs", "privacy_risks", "suspicious_domains", "unknown_domains", "model_criticals", "model_highs", "failing_frameworks", "modified_modules", "ignored_rules", "lowered_rules", "behaviour_criticals", "behaviour_highs"]
FLAGS = ["env_tracked", "env_ignored", "manifest_known"]


def gate_results(facts: DataFrame, key: list[str] = (), strict: bool = False) -> DataFrame:
    """key, gate, status (pass, warn, fail, unknown) of every row of facts; columns that are missing, and nulls, are unknown."""
    missing = [F.lit(None).cast("long").alias(c) for c in COUNTS if c not in facts.columns] + [F.lit(None).cast("boolean").alias(c) for c in FLAGS if c not in facts.columns]
    rows = facts.select("*", *missing)

    def status(fails: str | None, warns: str | None, hard: bool) -> Column:
        f, w = (F.expr(x) if x else F.lit(False) for x in (fails, warns))
        worst = F.when(f, "fail").when(w, "fail" if strict and hard else "warn")
        return worst.when(f.isNull() | w.isNull(), "unknown").otherwise("pass")

    each = F.array(*[F.struct(F.lit(g).alias("gate"), status(f, w, hard).alias("status")) for g, f, w, hard in GATES])
    return rows.select(*key, F.explode(each).alias("g")).select(*key, "g.*")


def ready(results: DataFrame, key: list[str] = ()) -> DataFrame:
    """key, passed, warnings, failed, unknown, ready: nothing failed, and nothing is unknown."""
    n = {s: F.count_if(F.col("status") == s).alias(a) for s, a in (("pass", "passed"), ("warn", "warnings"), ("fail", "failed"), ("unknown", "unknown"))}
    return results.groupBy(*key).agg(*n.values()).withColumn("ready", (F.col("failed") == 0) & (F.col("unknown") == 0))


def scan_facts(found: DataFrame, key: list[str] = ()) -> DataFrame:
    """criticals, highs, secrets of a scan's findings that are not suppressed."""
    rows = found.where(~F.col("suppressed")) if "suppressed" in found.columns else found
    is_ = lambda s: F.count_if(F.col("severity") == s)
    return rows.groupBy(*key).agg(is_("critical").alias("criticals"), is_("high").alias("highs"), F.count_if(F.col("rule_id").startswith("secret.")).alias("secrets"))
