"""Protected lines in texts: one pass of an Aho-Corasick automaton over each text."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, functions as F

LEAST = 16
#: Characters of protected lines in one automaton; more are looked for in further passes.
BLOCK_CHARS = 2_000_000
FOUND = "array<struct<item_id:long,line:string>>"


def flat(text: str | None) -> str:
    return re.sub(r"[ \t\n\x0b\f\r]+", " ", text or "")


def protected_lines(texts: DataFrame, key: str, text: str, items: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """key, item_id, line of the items' lines (of LEAST characters or more, white space collapsed) that texts hold.

    The items (item_id, text) are a stated set. Their size is looked at first; each block of
    them is one automaton, sent to the tasks, and one pass over the texts.
    """
    spark = texts.sparkSession
    total = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-int(total) // block_chars))
    out = None
    for b in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).select("item_id", "text").collect()
        wanted: dict[str, list[int]] = {}
        for r in rows:
            for line in {flat(x).strip(" ") for x in (r["text"] or "").split("\n")}:
                if len(line) >= LEAST:
                    wanted.setdefault(line, []).append(r["item_id"])
        hit = texts.select(key, F.inline(_finder(spark.sparkContext.broadcast(wanted))(F.col(text))))
        out = hit if out is None else out.unionByName(hit)
    return out


def _finder(wanted):
    @F.pandas_udf(FOUND)
    def run(values: pd.Series) -> pd.Series:
        return pd.Series([search(wanted.value, v) for v in values], dtype=object)

    return run


_built: dict[int, tuple] = {}


def search(wanted: dict[str, list[int]], text: str | None) -> list[dict]:
    """Each (item, line) of wanted that a text holds, once."""
    if not wanted or not text:
        return []
    known = _built.get(id(wanted))
    if known is None:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for line, ids in wanted.items():
            automaton.add_word(line, (line, ids))
        automaton.make_automaton()
        _built.clear()
        known = _built[id(wanted)] = (automaton, wanted)  # wanted is kept, so that its id stays its own
    found = {line: ids for _, (line, ids) in known[0].iter(flat(text))}
    return [{"item_id": i, "line": line} for line, ids in found.items() for i in ids]
