"""What plans must look like: pruned scans, pushed filters, no Python where Columns do."""

import re

from sparrowhawk import registry


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scans_read_only_what_is_used(spark, small):
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", df := registry.QUERIES["session_risk"](spark, small)._jdf.queryExecution().simpleString())
    assert schemas and all("props" not in s and "value" not in s for s in schemas), df


def test_filters_reach_the_scan(spark, small):
    text = registry.QUERIES["osv_join"](spark, small)._jdf.queryExecution().simpleString()
    assert "GreaterThanOrEqual(p_size,45)" in text.split("PushedFilters: ", 1)[1]


def test_findings_stay_in_the_jvm(spark, small):
    for name in ("findings_report", "grade", "supersede", "firewall", "classify_prompt", "secure_prompt", "behavior_patterns", "named_secrets", "token_entropy"):
        assert not re.search("Python|Pandas|Arrow", plan(registry.QUERIES[name](spark, small))), name


def test_no_cartesian_products(spark, small):
    for name in sorted(registry.QUERIES):
        if name not in ("trace_prompts", "risk_score", "scorecard"):  # a stated set of snippets; single rows
            assert not re.search("CartesianProduct|BroadcastNestedLoopJoin", plan(registry.QUERIES[name](spark, small))), name
