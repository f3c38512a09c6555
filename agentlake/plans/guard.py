"""Queries: guardian replay and loop signatures."""

from __future__ import annotations

from pyspark.sql import functions as F

from agentlake.functions.jsonsig import with_loop_signature
from agentlake.operators import folds
from agentlake.operators.ordered import range_count
from agentlake.plans.registry import query
from agentlake.sources import views as V

_G = "SELECT *, json_extract_string(arguments, '$.q') AS sig FROM v_guard_calls"

# Oracle for the exact guardian: the storm fold per session, then the loop fold
# per (session, tool, signature) over storm-accepted requests (one call per request).
GUARD_ORACLE = f"""
WITH RECURSIVE g AS (
  SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY sec, event_id) AS rn FROM ({_G})
),
storm(session_id, rn, event_id, cnt, last, blocked) AS (
  SELECT session_id, rn, event_id, 1, sec, false FROM g WHERE rn = 1
  UNION ALL
  SELECT g.session_id, g.rn, g.event_id,
         CASE WHEN nc > 20 THEN s.cnt ELSE nc END,
         CASE WHEN nc > 20 THEN s.last ELSE g.sec END,
         nc > 20
  FROM storm s JOIN g ON g.session_id = s.session_id AND g.rn = s.rn + 1,
       LATERAL (SELECT (CASE WHEN g.sec - s.last < 60 THEN s.cnt ELSE 0 END) + 1 AS nc)
),
acc AS (
  SELECT g.*, row_number() OVER (PARTITION BY g.session_id, g.tool_name, g.sig ORDER BY g.sec, g.event_id) AS lrn
  FROM g JOIN storm s USING (session_id, rn) WHERE NOT s.blocked
),
lp(session_id, tool_name, sig, lrn, event_id, cnt, last, blocked) AS (
  SELECT session_id, tool_name, sig, lrn, event_id, 1, sec, false FROM acc WHERE lrn = 1
  UNION ALL
  SELECT a.session_id, a.tool_name, a.sig, a.lrn, a.event_id,
         CASE WHEN nc > 5 THEN l.cnt ELSE nc END,
         CASE WHEN nc > 5 THEN l.last ELSE a.sec END,
         nc > 5
  FROM lp l JOIN acc a ON a.session_id = l.session_id AND a.tool_name = l.tool_name AND a.sig = l.sig
                       AND a.lrn = l.lrn + 1,
       LATERAL (SELECT (CASE WHEN a.sec - l.last < 60 THEN l.cnt ELSE 0 END) + 1 AS nc)
),
decided AS (
  SELECT g.event_id, g.session_id, g.tool_name,
         CASE WHEN s.blocked THEN 'storm_blocked' WHEN l.blocked THEN 'loop_blocked' ELSE 'accepted' END AS decision
  FROM g JOIN storm s USING (session_id, rn) LEFT JOIN lp l ON l.event_id = g.event_id
)
"""


def _guard_input(spark, sf_dir):
    g = with_loop_signature(V.guard_calls(spark, sf_dir), "arguments")
    return g.select("session_id", "sec", "event_id",
                    F.array("tool_name").alias("tools"),
                    F.array("sig").alias("sigs"),
                    "tool_name")


def _replayed(spark, sf_dir):
    return folds.guardian_replay(_guard_input(spark, sf_dir), ("tool_name",))


@query("loop_replay", bench=True, sql=GUARD_ORACLE + """
SELECT event_id, session_id, tool_name, decision FROM decided
""")
def loop_replay(spark, sf_dir):
    return _replayed(spark, sf_dir).select("event_id", "session_id", "tool_name", "decision")


@query("storm_replay", sql=GUARD_ORACLE + """
SELECT session_id, decision, count(*) AS requests FROM decided GROUP BY ALL
""")
def storm_replay(spark, sf_dir):
    return (_replayed(spark, sf_dir).groupBy("session_id", "decision")
            .agg(F.count(F.lit(1)).alias("requests")))


@query("loop_signature", sql=f"""
SELECT tool_name, count(*) AS calls, min(event_id) AS first_event_id FROM ({_G}) GROUP BY tool_name, sig
""")
def loop_signature_q(spark, sf_dir):
    g = with_loop_signature(V.guard_calls(spark, sf_dir), "arguments")
    return (g.groupBy("tool_name", "sig")
            .agg(F.count(F.lit(1)).alias("calls"), F.min("event_id").alias("first_event_id"))
            .drop("sig"))


@query("storm_window", sql="""
SELECT event_id, session_id,
       count(*) OVER (PARTITION BY session_id ORDER BY sec RANGE BETWEEN 59 PRECEDING AND CURRENT ROW) AS window_count,
       count(*) OVER (PARTITION BY session_id ORDER BY sec RANGE BETWEEN 59 PRECEDING AND CURRENT ROW) > 20 AS flagged
FROM v_guard_calls
""")
def storm_window(spark, sf_dir):
    g = V.guard_calls(spark, sf_dir).select("event_id", "session_id", "sec")
    c = range_count(g, ["session_id"], "sec", "event_id", 60)
    return c.select("event_id", "session_id", "window_count", (F.col("window_count") > 20).alias("flagged"))


@query("loop_window", sql=f"""
SELECT event_id, session_id, tool_name,
       count(*) OVER (PARTITION BY session_id, tool_name, sig ORDER BY sec
                      RANGE BETWEEN 59 PRECEDING AND CURRENT ROW) AS window_count,
       count(*) OVER (PARTITION BY session_id, tool_name, sig ORDER BY sec
                      RANGE BETWEEN 59 PRECEDING AND CURRENT ROW) > 5 AS flagged
FROM ({_G})
""")
def loop_window(spark, sf_dir):
    g = with_loop_signature(V.guard_calls(spark, sf_dir), "arguments")
    g = g.select("event_id", "session_id", "tool_name", "sec", "sig")
    c = range_count(g, ["session_id", "tool_name", "sig"], "sec", "event_id", 60)
    return c.select("event_id", "session_id", "tool_name", "window_count",
                    (F.col("window_count") > 5).alias("flagged"))
