"""Queries: unified security alerts."""

from __future__ import annotations

from pyspark.sql import functions as F

from agentlake.plans import guard, pii, tools
from agentlake.plans.registry import query

# Fixed values (ours): severity per alert kind.
SEVERITY = {"loop_blocked": "high", "storm_blocked": "high", "prompt_injection": "critical",
            "policy_denied": "medium", "residency_block": "high"}
_INJ = "ignore previous instructions|you are now acting as|jailbreak|system prompt bypass"


@query("security_alerts", sql=guard.GUARD_ORACLE + f"""
, alerts AS (
  SELECT decision AS kind, count(*) AS events FROM decided WHERE decision <> 'accepted' GROUP BY decision
  UNION ALL
  SELECT 'prompt_injection', count(*) FROM (
    SELECT text FROM documents UNION ALL SELECT text FROM conversations WHERE role = 'user')
  WHERE regexp_matches(lower(text), '{_INJ}')
  UNION ALL
  SELECT 'policy_denied', count(*) FROM (
    SELECT c.payload_id FROM {tools._CALLS} c LEFT JOIN {tools._POL} p
      ON p.tenant_id = c.tenant_id AND p.tool_name = c.tool_name
    GROUP BY c.payload_id HAVING bool_or(NOT coalesce(p.allow, {str(tools.FAIL_OPEN).upper()})))
  UNION ALL
  SELECT 'residency_block', count(*) FROM ({pii._RESIDENCY_SQL}) WHERE blocked
)
SELECT kind, CASE kind {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SEVERITY.items())} END AS severity,
       events FROM alerts
""")
def security_alerts(spark, sf_dir):
    """loop/storm blocks (replayed, since blocked requests leave no
    telemetry), prompt injection, policy denials and residency blocks as one
    table with a severity."""
    g = (guard.loop_replay(spark, sf_dir).filter(F.col("decision") != "accepted")
         .groupBy(F.col("decision").alias("kind")).agg(F.count(F.lit(1)).alias("events")))
    inj = (pii.injection_flag(spark, sf_dir).agg(F.sum("flagged").cast("bigint").alias("events"))
           .select(F.lit("prompt_injection").alias("kind"), F.coalesce("events", F.lit(0)).alias("events")))
    pol = (tools.policy_check(spark, sf_dir).filter("denied").agg(F.count(F.lit(1)).alias("events"))
           .select(F.lit("policy_denied").alias("kind"), "events"))
    res = (pii.residency(spark, sf_dir).filter("blocked").agg(F.count(F.lit(1)).alias("events"))
           .select(F.lit("residency_block").alias("kind"), "events"))
    u = g.unionByName(inj).unionByName(pol).unionByName(res)
    sev = F.create_map(*[x for k, v in SEVERITY.items() for x in (F.lit(k), F.lit(v))])
    return u.select("kind", F.element_at(sev, F.col("kind")).alias("severity"), "events")
