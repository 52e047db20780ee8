"""Queries over events, conversations and audit trails."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import diff, sessions
from ..schema import sql_case
from .base import table

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


_KIND = sql_case("event_type", sessions.EVENT_ACTIONS)
_ACTS = f"""a AS (SELECT user_id, event_id, ts, type, coalesce({sql_case('type', sessions.ACTION_RISK)}, 0)::INT AS risk FROM (SELECT *, {_KIND} AS type FROM events)),
g AS (SELECT *, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) > 86400000000, false)::INT AS fresh FROM a),
s AS (SELECT * EXCLUDE (fresh), sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id)::INT AS session FROM g)"""
KEY = ["user_id", "session"]


def _acts(spark, d):
    return sessions.gap_sessions(sessions.actions(table(spark, d, "events")))


@query("auto_sessions", f"WITH {_ACTS} SELECT user_id, session, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM s GROUP BY user_id, session")
def auto_sessions(spark, d):
    return _acts(spark, d).groupBy(*KEY).agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


_LEVEL = "CASE WHEN risk_score = 0 THEN 'NONE' WHEN risk_score < 20 THEN 'LOW' WHEN risk_score < 50 THEN 'MEDIUM' WHEN risk_score < 100 THEN 'HIGH' ELSE 'CRITICAL' END"


@query("session_risk", f"WITH {_ACTS}, r AS (SELECT user_id, session, count(*) AS events, sum(risk)::BIGINT AS risk_score, count(*) FILTER (type = 'blocked') AS blocked FROM s GROUP BY user_id, session) SELECT *, {_LEVEL} AS risk_level, floor(blocked / events * 100 + 0.5)::INT AS blocked_percent FROM r")
def session_risk(spark, d):
    return sessions.session_risk(_acts(spark, d), KEY)


_PATTERNS = """b AS (SELECT *, row_number() OVER (PARTITION BY user_id, session ORDER BY ts DESC, event_id DESC) AS k, risk - lag(risk) OVER (PARTITION BY user_id, session ORDER BY ts, event_id) AS jump FROM s),
x AS (SELECT user_id, session, count(*) AS n, max(risk) FILTER (k > 5) AS early, max(risk) FILTER (k <= 5) AS late, count(*) FILTER (k <= 15 AND type = 'file_read') AS reads, count(*) FILTER (k <= 15 AND type = 'network') AS nets,
  count(*) FILTER (type = 'network') AS all_nets, max(epoch_us(ts)) FILTER (type = 'network') - min(epoch_us(ts)) FILTER (type = 'network') AS net_us, max(jump) FILTER (k < 10) AS jump, count(*) FILTER (type = 'blocked') AS blocks,
  count(*) FILTER (type = 'tamper') AS tampers, hour(arg_min(ts, (ts, event_id)) FILTER (type IN ('secret_access', 'env_access'))) AS h, max(epoch_us(ts)) - min(epoch_us(ts)) AS span FROM b GROUP BY user_id, session),
p AS (SELECT user_id, session, coalesce(n >= 10 AND early <= 2 AND late >= 8, false) AS trust_building, reads >= 5 AND nets >= 1 AND reads > nets * 3 AS data_gathering, coalesce(all_nets > 5 AND net_us > 30000000, false) AS slow_exfil,
  coalesce(n >= 5 AND jump > 2, false) AS privilege_escalation, blocks >= 3 AS repeated_blocks, tampers > 0 AS tamper_detected, coalesce(h < 6 OR h > 22, false) AS off_hours, n > 20 AND span < 5000000 AS rapid_fire FROM x)"""


@query("behavior_patterns", f"WITH {_ACTS}, {_PATTERNS} SELECT * FROM p")
def behavior_patterns(spark, d):
    return sessions.behavior_patterns(_acts(spark, d), KEY)


@query(
    "behavior_advice",
    f"WITH {_ACTS}, {_PATTERNS} SELECT user_id, session, CASE WHEN privilege_escalation OR repeated_blocks OR tamper_detected THEN 'IMMEDIATE' WHEN trust_building OR data_gathering OR slow_exfil THEN 'WARNING' WHEN off_hours OR rapid_fire THEN 'CAUTION' ELSE 'NONE' END AS recommendation FROM p",
)
def behavior_advice(spark, d):
    return sessions.recommendation(sessions.behavior_patterns(_acts(spark, d), KEY)).select(*KEY, "recommendation")


@query("user_risk", f"WITH {_ACTS}, r AS (SELECT user_id, count(*) AS events, sum(risk)::BIGINT AS risk_score, count(*) FILTER (type = 'blocked') AS blocked FROM s GROUP BY user_id) SELECT *, {_LEVEL} AS risk_level, floor(blocked / events * 100 + 0.5)::INT AS blocked_percent FROM r")
def user_risk(spark, d):
    return sessions.session_risk(_acts(spark, d), ["user_id"])


@query("last_events", f"WITH {_ACTS} SELECT user_id, event_id, type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM s) WHERE k <= 15")
def last_events(spark, d):
    w = __import__("pyspark.sql", fromlist=["Window"]).Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return _acts(spark, d).withColumn("k", F.row_number().over(w)).where("k <= 15").select("user_id", "event_id", "type")


@query("every_twenty", f"WITH {_ACTS}, c AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, sum(risk) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS total FROM s) SELECT user_id, event_id, n, total::BIGINT AS total FROM c WHERE n % 20 = 0")
def every_twenty(spark, d):
    """Every twentieth event of a user, with the risk so far: when a running analysis is due."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    c = _acts(spark, d).withColumns({"n": F.count("*").over(w), "total": F.sum("risk").over(w)})
    return c.where("n % 20 = 0").select("user_id", "event_id", "n", F.col("total").cast("long").alias("total"))


_ENTRY = "concat_ws('|', event_id::VARCHAR, event_type, user_id::VARCHAR)"


_CHAIN = f"""RECURSIVE o AS (SELECT user_id, event_id, {_ENTRY} AS c, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
chain AS (SELECT user_id, event_id, i, 'GENESIS' AS previous_hash, sha256('GENESIS' || chr(10) || c) AS hash FROM o WHERE i = 1
UNION ALL SELECT o.user_id, o.event_id, o.i, chain.hash, sha256(chain.hash || chr(10) || o.c) FROM chain JOIN o ON o.user_id = chain.user_id AND o.i = chain.i + 1)"""


@query("hash_chain", f"WITH {_CHAIN} SELECT user_id, event_id, hash, previous_hash FROM chain")
def hash_chain(spark, d):
    """Users' events as audit logs; the SQL walks each log entry by entry."""
    e = table(spark, d, "events")
    return diff.hash_chain(e, ["user_id"], ["ts", "event_id"], F.concat_ws("|", "event_id", "event_type", "user_id")).select("user_id", "event_id", "hash", "previous_hash")


@query("hash_chain_verify", f"WITH {_CHAIN} SELECT user_id, event_id, event_id % 97 <> 0 AS link_ok, event_id % 97 <> 0 AND event_id % 89 <> 0 AS hash_ok FROM chain")
def hash_chain_verify(spark, d):
    """Every 97th entry's link is broken first, and every 89th entry's content."""
    content = F.concat_ws("|", "event_id", "event_type", "user_id")
    c = diff.hash_chain(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], content)
    c = c.withColumns({"previous_hash": F.when(F.col("event_id") % 97 == 0, "forged").otherwise(F.col("previous_hash")), "event_type": F.when(F.col("event_id") % 89 == 0, "forged").otherwise(F.col("event_type"))})
    return diff.verify_chain(c, ["user_id"], ["ts", "event_id"], content).select("user_id", "event_id", "link_ok", "hash_ok")


@query("audit_summary", "SELECT event_type, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts, epoch_us(max(ts)) - epoch_us(min(ts)) AS duration_us FROM events GROUP BY event_type")
def audit_summary(spark, d):
    return diff.audit_summary(table(spark, d, "events"), "event_type", "ts")


@query("audit_last", "SELECT event_id, event_type FROM events ORDER BY event_id DESC LIMIT 20")
def audit_last(spark, d):
    return diff.last_entries(table(spark, d, "events"), "event_id", 20).select("event_id", "event_type")


@query("transcript_messages", "SELECT conv_id, count(*) AS n, count(*) FILTER (role = 'user') AS n_user, string_agg(role, ',' ORDER BY turn) AS roles FROM conversations GROUP BY conv_id")
def transcript_messages(spark, d):
    c = table(spark, d, "conversations")
    return c.groupBy("conv_id").agg(F.count("*").alias("n"), F.count_if(F.col("role") == "user").alias("n_user"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]), ",").alias("roles"))


@query(
    "trace_prompts",
    """WITH f AS (SELECT doc_id, left(text, 30) AS s FROM documents WHERE text <> ''), m AS (SELECT conv_id, turn, text FROM conversations UNION ALL SELECT 1000000 + doc_id, 0, 'as you wrote: ' || text FROM documents WHERE doc_id % 10 = 3)
SELECT DISTINCT doc_id AS line, conv_id, turn FROM f JOIN m ON contains(m.text, f.s)""",
)
def trace_prompts(spark, d):
    """The beginnings of all documents stand for the snippets of a scan's findings; every tenth document is quoted in a message."""
    docs = table(spark, d, "documents")
    f = docs.where("text is not null").select(F.lit("r").alias("rule_id"), F.lit("f").alias("file"), F.col("doc_id").alias("line"), F.left("text", F.lit(60)).alias("snippet"), F.lit("").alias("title"))
    quoted = docs.where("doc_id % 10 = 3").select((F.col("doc_id") + 1_000_000).alias("conv_id"), F.lit(0).cast("long").alias("turn"), F.concat(F.lit("as you wrote: "), "text").alias("text"))
    return sessions.trace_findings(f, table(spark, d, "conversations").select("conv_id", "turn", "text").unionByName(quoted)).select("line", "conv_id", "turn")


@query("behavior_stream", f"WITH {_ACTS}, r AS (SELECT user_id, count(*) AS events, sum(risk)::BIGINT AS risk_score FROM a GROUP BY user_id) SELECT *, {_LEVEL} AS risk_level FROM r")
def behavior_stream(spark, d):
    """Session totals as the streaming operator gives them, over the events table as one micro-batch."""
    from ..streaming.sessions import totals_of

    return totals_of(sessions.actions(table(spark, d, "events")))
