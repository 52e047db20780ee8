"""Structured Streaming: sessions of agents' actions, and texts that arrive in pieces."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.sessions import risk_level
from ..operators.catalog import CORE

#: Events kept of a session for pattern analysis; the risk total isn't lowered when old ones go.
MAX_EVENTS, REPORT_EVERY = 10_000, 20


def totals_of(acts: DataFrame) -> DataFrame:
    """events, risk_score, risk_level by user; the same over a stream, in update or complete mode."""
    out = acts.groupBy("user_id").agg(F.count("*").alias("events"), F.sum("risk").cast("long").alias("risk_score"))
    return out.withColumn("risk_level", risk_level(F.col("risk_score")))


def windowed_sessions(acts: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """user_id, start, end, events, risk_score of sessions that end with a gap; late events within the watermark count."""
    w = acts.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w"))
    out = w.agg(F.count("*").alias("events"), F.sum("risk").cast("long").alias("risk_score"))
    return out.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events", "risk_score")


def _timeout(minutes: int | None) -> str:
    return GroupStateTimeout.NoTimeout if minutes is None else GroupStateTimeout.ProcessingTimeTimeout


def _idle(state: GroupState, minutes: int | None) -> bool:
    """Whether a key has been silent for too long; its state is dropped then, and else kept for as many minutes more (None: for good)."""
    if minutes is None:
        return False
    if state.hasTimedOut:
        state.remove()
        return True
    state.setTimeoutDuration(minutes * 60_000)
    return False


def running_reports(acts: DataFrame, idle_minutes: int | None = None) -> DataFrame:
    """user_id, events, risk_score, blocks at every twentieth event of a user, by keyed state; a user idle for so long starts anew."""

    def update(key, batches: Iterator[pd.DataFrame], state: GroupState):
        if _idle(state, idle_minutes):
            return
        n, risk, blocks = state.get if state.exists else (0, 0, 0)
        out = []
        for pdf in batches:
            for kind, r in pdf.sort_values(["ts", "event_id"])[["type", "risk"]].itertuples(index=False):
                n, risk, blocks = n + 1, risk + int(r), blocks + (kind == "blocked")
                if n % REPORT_EVERY == 0:
                    out.append((key[0], n, risk, blocks))
        state.update((n, risk, blocks))
        yield pd.DataFrame(out, columns=["user_id", "events", "risk_score", "blocks"])

    schema = "user_id long, events long, risk_score long, blocks long"
    return acts.groupBy("user_id").applyInPandasWithState(update, schema, "n long, risk long, blocks long", "append", _timeout(idle_minutes))


def recent_events(acts: DataFrame, most: int = MAX_EVENTS, idle_minutes: int | None = None) -> DataFrame:
    """user_id, events, kept, risk_score, types after each micro-batch: a buffer of the last `most` events, and totals that don't fall when old ones go."""

    def update(key, batches: Iterator[pd.DataFrame], state: GroupState):
        if _idle(state, idle_minutes):
            return
        n, risk, kept = state.get if state.exists else (0, 0, [])
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        n, risk = n + len(rows), risk + int(rows["risk"].sum())
        kept = [*kept, *rows["type"]][-most:]
        state.update((n, risk, kept))
        yield pd.DataFrame({"user_id": [key[0]], "events": [n], "kept": [len(kept)], "risk_score": [risk], "types": [kept]})

    schema = "user_id long, events long, kept long, risk_score long, types array<string>"
    return acts.groupBy("user_id").applyInPandasWithState(update, schema, "n long, risk long, kept array<string>", "append", _timeout(idle_minutes))


#: Where a match may still be open at the end of a text: a value without its closing quote, an address without its host, any run of characters.
OPEN = [re.compile(r"(?:password|passwd|secret|key|token)\s*(?:[:=]\s*(?:['\"][^'\"]*)?)?\Z", re.I), re.compile(r"[a-z+]+:\/\/[^\s@/]*\Z"), re.compile(r"\S*\Z"), re.compile(r"-----BEGIN[A-Z -]*\Z")]
#: Characters kept of an open match at most.
MOST_OPEN = 1 << 16


def open_from(text: str, tail: int) -> int:
    """From where on a text must be kept, so that no match that the next piece may complete is cut."""
    last = text[-MOST_OPEN:]
    starts = [len(text) - len(last) + m.start() for p in OPEN if (m := p.search(last))]
    return max(len(text) - MOST_OPEN, min([max(0, len(text) - tail), *starts]))


def delta_violations(deltas: DataFrame, tail: int = 256, keys: list[str] = ("stream_id",), idle_minutes: int | None = None) -> DataFrame:
    """keys, rule_id, at, first of secrets in texts that arrive in pieces (keys, seq, delta).

    The rules are the core's for secrets with their predicates. State holds the text from the
    earliest place where a match may be open (`tail` characters at least, MOST_OPEN at most),
    the number of characters before it, and what was reported, so that a secret cut in two is
    found, and once. first marks what a stream is to be cut off at. A stream idle for so long is
    forgotten (None: never). With keys of a stream and a tool call the same serves the calls' arguments.
    """
    from ..operators.rules import Compiled

    rules = [r for r in CORE if r.id.startswith("secret.")]
    columns = [*keys, "rule_id", "at", "first"]

    def update(key, batches: Iterator[pd.DataFrame], state: GroupState):
        if _idle(state, idle_minutes):
            return
        compiled = [Compiled(r) for r in rules]
        rest, before, seen, any_ = state.get if state.exists else ("", 0, "", False)
        known, out = set(seen.split(",")) if seen else set(), []
        for pdf in batches:
            for delta in pdf.sort_values("seq")["delta"]:
                text = rest + (delta or "")
                for c in compiled:
                    for m in c.pattern.finditer(text):
                        line = text[text.rfind("\n", 0, m.start()) + 1 :].partition("\n")[0]
                        name = f"{c.rule.id}@{before + m.start()}"
                        if name not in known and (c.keep is None or c.keep(line, m)):
                            known.add(name)
                            out.append((*key, c.rule.id, before + m.start(), not any_))
                            any_ = True
                start = open_from(text, tail)
                before += start
                rest = text[start:]
        known = {k for k in known if int(k.rpartition("@")[2]) >= before}  # older ones can't be met again
        state.update((rest, before, ",".join(sorted(known)), any_))
        yield pd.DataFrame(out, columns=columns)

    schema = ", ".join(f"{k} {deltas.schema[k].dataType.simpleString()}" for k in keys)
    return deltas.groupBy(*keys).applyInPandasWithState(
        update, f"{schema}, rule_id string, at long, first boolean", "rest string, before long, seen string, any boolean", "append", _timeout(idle_minutes)
    )


def tool_arguments(deltas: DataFrame, idle_minutes: int | None = None) -> DataFrame:
    """stream_id, call, arguments: a tool call's JSON arguments once their fragments (stream_id, call, seq, delta) are whole, and once."""

    def update(key, batches: Iterator[pd.DataFrame], state: GroupState):
        if _idle(state, idle_minutes):
            return
        (raw, done) = state.get if state.exists else ("", False)
        out = []
        for pdf in batches:
            for delta in pdf.sort_values("seq")["delta"]:
                raw += delta or ""
                if not done and raw.rstrip().endswith(("}", "]")):
                    try:
                        json.loads(raw)
                    except ValueError:
                        continue
                    done = True
                    out.append((*key, raw))
        state.update(("" if done else raw, done))
        yield pd.DataFrame(out, columns=["stream_id", "call", "arguments"])

    schema = "stream_id long, call int, arguments string"
    return deltas.groupBy("stream_id", "call").applyInPandasWithState(update, schema, "raw string, done boolean", "append", _timeout(idle_minutes))


def changed_paths(events: DataFrame, late: str = "1 minute") -> DataFrame:
    """Distinct (path, ts) of file events within a watermark, as a debounce."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["path"])


def to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Starts writing a stream to a Parquet table, a folder for each micro-batch; a batch that is run again replaces its own folder."""

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={n}")

    return stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(write).start()
