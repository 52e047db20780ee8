"""Plugins: modules that bring rules of their own to a scan.

A plugin is an importable module with any of

* ``RULES``: line rules, as Rule or as dicts of its fields;
* ``FILE_RULES``: functions ``(path, content) -> iterable of dicts`` with rule_id, severity, line and, if they like, confidence,
  title, cwe, column, snippet; they run in one Arrow pass;
* ``CROSS_FILE_RULES``: functions of the DataFrame files (file, content) that give a DataFrame of findings.

A plugin that can't be loaded is told in ``errors`` and the others are loaded.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from importlib.metadata import entry_points

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .catalog import Rule

#: Installed packages tell their plugins under this group of entry points.
GROUP = "sparrowhawk.rules"
HIT = "array<struct<rule_id:string,severity:string,confidence:string,title:string,cwe:string,line:int,column:int,snippet:string>>"
DEFAULTS = {"severity": "medium", "confidence": "medium", "title": None, "cwe": None, "line": 1, "column": 1, "snippet": ""}


@dataclass
class Plugins:
    rules: list[Rule] = field(default_factory=list)
    file_rules: list[Callable] = field(default_factory=list)
    cross_file_rules: list[Callable] = field(default_factory=list)
    errors: list[str] = field(default_factory=list)


def _rule(value) -> Rule:
    rule = value if isinstance(value, Rule) else Rule(**value)
    if rule.severity not in ("critical", "high", "medium", "low"):
        raise ValueError(f"{rule.id}: no such severity: {rule.severity}")
    return rule


def load(names: Iterable[str] = (), installed: bool = False) -> Plugins:
    """The plugins of modules by name, each once, and with installed also those of installed packages."""
    found = [e.value for e in entry_points(group=GROUP)] if installed else []
    out = Plugins()
    for name in dict.fromkeys([*found, *names]):
        try:
            module = importlib.import_module(name)
            rules = [_rule(r) for r in getattr(module, "RULES", ())]
            whole, across = [*getattr(module, "FILE_RULES", ())], [*getattr(module, "CROSS_FILE_RULES", ())]
        except Exception as e:  # whatever a plugin does, the scan goes on
            out.errors.append(f"{name}: {e}")
            continue
        out.rules += rules
        out.file_rules += whole
        out.cross_file_rules += across
    return out


def run_plugins(files: DataFrame, plugins: Plugins) -> list[DataFrame]:
    """Findings of the plugins' functions over files (file, content); null contents are left out of the file rules."""
    out = [run(files) for run in plugins.cross_file_rules]
    if chosen := list(plugins.file_rules):

        @F.pandas_udf(HIT)
        def run_all(paths: pd.Series, contents: pd.Series) -> pd.Series:
            return pd.Series([[DEFAULTS | dict(h) for run in chosen for h in run(p or "", c)] for p, c in zip(paths, contents)], dtype=object)

        some = files.where(F.col("content").isNotNull())
        out.append(some.select("file", F.inline(run_all("file", "content"))))
    return out
