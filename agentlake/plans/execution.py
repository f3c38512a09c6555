"""Queries: recorded tool executions."""

from __future__ import annotations

from pyspark.sql import functions as F

from agentlake.functions.classify import is_read_only
from agentlake.operators import execution as X
from agentlake.operators import ordered
from agentlake.plans.registry import query
from agentlake.sources import views as V


def recorded(spark, sf_dir):
    """The log of claims and completions with the ledger's verdict on each key."""
    rows = V.execution_log(spark, sf_dir)
    tools = F.element_at(F.array(*[F.lit(t) for t in V.EXECUTION_TOOLS]), (F.col("tool_class") + 1).cast("int"))
    return rows.select("idempotency_key", "event_id", "kind", "at_sec", "version", "outcome", is_read_only(tools).alias("read_only"),
                       F.when(F.col("ledger_class") == 0, "committed").when(F.col("ledger_class") == 1, "absent").alias("ledger"))


def replayed(spark, sf_dir):
    return X.replay(recorded(spark, sf_dir))


# The rules once more, as a fold of each key's rows by recursion.
_LOG = f"""
WITH RECURSIVE l AS (
  SELECT *, tool_class = 1 AS read_only,
         row_number() OVER (PARTITION BY idempotency_key ORDER BY at_sec, CASE WHEN kind = 'claim' THEN 1 ELSE 0 END, event_id) AS rn
  FROM v_execution_log
), f(idempotency_key, rn, event_id, kind, at_sec, version, outcome, decision, s, v, lease, written) AS (
  SELECT DISTINCT idempotency_key, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT),
         CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), 'none', CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM l
  UNION ALL
  SELECT l.idempotency_key, l.rn, l.event_id, l.kind, l.at_sec, l.version, l.outcome, d.decision,
         CASE d.decision WHEN 'new_claim' THEN 'claimed' WHEN 'reclaim_after_failed' THEN 'claimed' WHEN 'lease_expired_reclaim' THEN 'claimed'
              WHEN 'read_only_retry' THEN 'claimed' WHEN 'reconciled_succeeded' THEN 'succeeded' WHEN 'reconciliation_failed' THEN 'failed'
              WHEN 'applied' THEN CASE l.outcome WHEN 'success' THEN 'succeeded' WHEN 'error' THEN 'failed' ELSE 'unknown' END ELSE e.s END,
         CASE WHEN d.decision = 'new_claim' THEN 1 WHEN d.decision IN ('reclaim_after_failed', 'lease_expired_reclaim') THEN f.v + 1
              WHEN e.s = 'none' THEN 0 ELSE f.v END,
         CASE WHEN d.decision IN ('new_claim', 'reclaim_after_failed', 'lease_expired_reclaim') THEN l.at_sec + {X.LEASE_SEC} ELSE f.lease END,
         CASE WHEN d.decision IN ('replayed_result', 'already_in_flight', 'no_entry', 'fenced_stale', 'kept_unknown', 'kept_succeeded') THEN f.written ELSE l.at_sec END
  FROM f JOIN l ON l.idempotency_key = f.idempotency_key AND l.rn = f.rn + 1,
       LATERAL (SELECT CASE WHEN f.s <> 'none' AND l.at_sec - f.written < {X.ENTRY_TTL_SEC} THEN f.s ELSE 'none' END AS s) e,
       LATERAL (SELECT CASE
         WHEN l.kind = 'completion' AND e.s = 'none' THEN 'no_entry'
         WHEN l.kind = 'completion' AND l.version <> f.v THEN 'fenced_stale'
         WHEN l.kind = 'completion' AND l.outcome = 'success' AND e.s = 'unknown' THEN 'kept_unknown'
         WHEN l.kind = 'completion' AND l.outcome <> 'success' AND e.s = 'succeeded' THEN 'kept_succeeded'
         WHEN l.kind = 'completion' THEN 'applied'
         WHEN e.s = 'none' THEN 'new_claim'
         WHEN e.s = 'succeeded' THEN 'replayed_result'
         WHEN e.s = 'failed' THEN 'reclaim_after_failed'
         WHEN e.s = 'claimed' AND l.at_sec <= f.lease THEN 'already_in_flight'
         WHEN e.s = 'claimed' THEN 'lease_expired_reclaim'
         WHEN l.read_only THEN 'read_only_retry'
         WHEN l.ledger_class = 0 THEN 'reconciled_succeeded'
         WHEN l.ledger_class = 1 THEN 'reconciliation_failed'
         ELSE 'previous_attempt_unknown' END AS decision) d
), log AS (
  SELECT event_id, idempotency_key, kind, at_sec, CASE WHEN kind = 'claim' THEN v ELSE version END AS version, outcome, decision FROM f WHERE rn > 0
)
"""


@query("execution_replay", bench=True, sql=_LOG + "SELECT * FROM log")
def execution_replay(spark, sf_dir):
    return replayed(spark, sf_dir)


@query("execution_branches", sql=_LOG + "SELECT kind, decision, count(*) AS events FROM log GROUP BY ALL")
def execution_branches(spark, sf_dir):
    return replayed(spark, sf_dir).groupBy("kind", "decision").agg(F.count(F.lit(1)).alias("events"))


@query("fence_completions", sql=_LOG + """
SELECT event_id, idempotency_key, at_sec, version, decision = 'applied' AS accepted, decision FROM log WHERE kind = 'completion'
""")
def fence_completions(spark, sf_dir):
    r = replayed(spark, sf_dir).filter(F.col("kind") == "completion")
    return r.select("event_id", "idempotency_key", "at_sec", "version", (F.col("decision") == "applied").alias("accepted"), "decision")


@query("attempt_sequence", sql=_LOG + """
SELECT event_id, idempotency_key, row_number() OVER (PARTITION BY idempotency_key ORDER BY at_sec, event_id) AS attempt, version,
       version IS NOT NULL AND decision IN ('new_claim', 'reclaim_after_failed', 'lease_expired_reclaim') AS raised
FROM log WHERE kind = 'claim'
""")
def attempt_sequence(spark, sf_dir):
    """The number of each claim of an operation, the version it got or met, and whether
    it raised it. The number is a running count per key, bin-local."""
    c = replayed(spark, sf_dir).filter(F.col("kind") == "claim").withColumn("one", F.lit(1).cast("bigint"))
    c = ordered.running_sums(c, ["idempotency_key"], "at_sec", "event_id", ["one"], X.ENTRY_TTL_SEC)
    return c.select("event_id", "idempotency_key", F.col("one_running").cast("bigint").alias("attempt"), "version",
                    F.col("decision").isin("new_claim", "reclaim_after_failed", "lease_expired_reclaim").alias("raised"))


@query("lease_expiry", sql=_LOG + """
SELECT event_id, idempotency_key, at_sec, version, decision FROM log WHERE decision IN ('lease_expired_reclaim', 'already_in_flight')
""")
def lease_expiry(spark, sf_dir):
    """Claims that met a claim without a completion: its lease still held or had run out."""
    r = replayed(spark, sf_dir)
    return r.filter(F.col("decision").isin("lease_expired_reclaim", "already_in_flight")).select("event_id", "idempotency_key", "at_sec", "version", "decision")


@query("reconcile", sql=_LOG + """
SELECT event_id, idempotency_key, decision, version FROM log
WHERE decision IN ('reconciled_succeeded', 'reconciliation_failed', 'previous_attempt_unknown')
""")
def reconcile(spark, sf_dir):
    """Unknown outcomes joined to the ledger."""
    r = replayed(spark, sf_dir).filter(F.col("decision").isin(
        "reconciled_succeeded", "reconciliation_failed", "previous_attempt_unknown"))
    return r.select("event_id", "idempotency_key", "decision", "version")


@query("retry_amplification", sql=_LOG + f"""
SELECT idempotency_key, count(*) AS attempts,
       count(*) FILTER (decision IN {X.EXECUTED}) AS executions,
       count(*) FILTER (decision IN ('replayed_result', 'already_in_flight', 'previous_attempt_unknown')) AS duplicates_prevented,
       max(version) AS final_version
FROM log WHERE kind = 'claim' GROUP BY idempotency_key
""")
def retry_amplification(spark, sf_dir):
    r = replayed(spark, sf_dir).filter(F.col("kind") == "claim")
    prevented = F.col("decision").isin("replayed_result", "already_in_flight", "previous_attempt_unknown")
    return r.groupBy("idempotency_key").agg(
        F.count(F.lit(1)).alias("attempts"), F.count_if(F.col("decision").isin(*X.EXECUTED)).alias("executions"),
        F.count_if(prevented).alias("duplicates_prevented"), F.max("version").alias("final_version"))
