"""Queries: tenant / session resolution and deterministic ids."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from agentlake.functions import identity as I
from agentlake.functions.classify import key_class
from agentlake.functions.jsonsig import canonical_json
from agentlake.plans.registry import query
from agentlake.sources import views as V

Z = I.ZERO_TENANT
_TENANT = f"coalesce(tenant_claim, trim(tenant_header), '{Z}')"
_LE = " || ".join(f"lpad(hex(((1704067200 + sec) >> {8 * i}) & 255), 2, '0')" for i in range(8))
_NULLISH = "lower(trim({x})) IN ('', 'null', 'none', 'undefined')"


def _calls(spark, sf_dir):
    c = V.calls(spark, sf_dir)
    c = c.withColumn("tenant_id", I.resolve_tenant(F.col("tenant_claim"), F.col("tenant_header")))
    # batch = one execution's calls: bounded by a request's tool calls, never by traffic
    w = Window.partitionBy("execution_id")
    c = c.withColumn("batch_size", F.count(F.lit(1)).over(w))
    c = c.withColumn("tool_index", F.row_number().over(w.orderBy("event_id")) - 1)
    return c.withColumn("canonical_args", canonical_json(F.col("arguments")))


@query("tenant_default", sql=f"SELECT event_id, {_TENANT} AS tenant_id FROM v_calls")
def tenant_default(spark, sf_dir):
    c = V.calls(spark, sf_dir)
    return c.select("event_id", I.resolve_tenant(F.col("tenant_claim"), F.col("tenant_header")).alias("tenant_id"))


@query("resolve_session", sql=f"""
SELECT event_id,
       CASE WHEN provided_session IS NOT NULL AND NOT {_NULLISH.format(x='provided_session')} THEN trim(provided_session)
            WHEN idem_header IS NOT NULL AND NOT {_NULLISH.format(x='idem_header')} THEN {_TENANT} || '_' || trim(idem_header)
            ELSE sha256(encode({_TENANT}) || encode(api_key) || unhex({_LE}) || encode(arguments)) END
           AS session_id
FROM v_calls
""")
def resolve_session(spark, sf_dir):
    c = V.calls(spark, sf_dir)
    tenant = I.resolve_tenant(F.col("tenant_claim"), F.col("tenant_header"))
    epoch = F.col("sec") + 1704067200
    return c.select("event_id", I.resolve_session(F.col("provided_session"), F.col("idem_header"), tenant,
                                                  F.col("api_key"), epoch, F.col("arguments")).alias("session_id"))


_BATCH = """(SELECT *, count(*) OVER (PARTITION BY execution_id) AS batch_size,
                 row_number() OVER (PARTITION BY execution_id ORDER BY event_id) - 1 AS tool_index FROM v_calls)"""


@query("operation_id", sql=f"""
SELECT event_id, CASE WHEN batch_size = 1 AND trace_op_id IS NOT NULL THEN trace_op_id
                      ELSE sha256(execution_id || '::' || call_id) END AS operation_id
FROM {_BATCH}
""")
def operation_id(spark, sf_dir):
    c = _calls(spark, sf_dir)
    return c.select("event_id", I.operation_id(F.col("trace_op_id"), F.col("batch_size"), F.col("execution_id"),
                                               F.col("call_id")).alias("operation_id"))


@query("idempotency_key", sql=f"""
SELECT event_id,
       CASE WHEN idem_header IS NOT NULL
            THEN sha256({_TENANT} || '::' || idem_header || '::' || tool_index || '::' || tool_name || '::' || canonical_args)
            ELSE sha256({_TENANT} || '::' || execution_id || '::' || call_id) END AS idempotency_key
FROM {_BATCH}
""")
def idempotency_key(spark, sf_dir):
    c = _calls(spark, sf_dir)
    return c.select("event_id", I.idempotency_key(F.col("tenant_id"), F.col("idem_header"), F.col("tool_index"),
                                                  F.col("tool_name"), F.col("canonical_args"),
                                                  F.col("execution_id"), F.col("call_id")).alias("idempotency_key"))


@query("content_key", sql=f"""
SELECT sha256({_TENANT} || '::' || tool_name || '::' || canonical_args) AS content_key, count(*) AS calls,
       min(event_id) AS first_event_id
FROM v_calls GROUP BY 1
""")
def content_key(spark, sf_dir):
    c = _calls(spark, sf_dir)
    return (c.groupBy(I.content_key(F.col("tenant_id"), F.col("tool_name"), F.col("canonical_args")).alias("content_key"))
            .agg(F.count(F.lit(1)).alias("calls"), F.min("event_id").alias("first_event_id")))


@query("canonical_json", sql="SELECT event_id, canonical_args FROM v_calls")
def canonical_json_q(spark, sf_dir):
    c = V.calls(spark, sf_dir)
    return c.select("event_id", canonical_json(F.col("arguments")).alias("canonical_args"))


@query("key_pseudonym", sql="""
SELECT sha256(api_key) AS key_hash,
       CASE WHEN starts_with(api_key, 'ke_live_') THEN 'ke_live' WHEN starts_with(api_key, 'ke_test_') THEN 'ke_test'
            WHEN starts_with(api_key, 're_live_') THEN 're_live' WHEN starts_with(api_key, 're_test_') THEN 're_test'
            ELSE 'unknown' END AS key_class,
       count(*) AS calls
FROM v_calls GROUP BY ALL
""")
def key_pseudonym(spark, sf_dir):
    c = V.calls(spark, sf_dir)
    return (c.select(I.key_hash(F.col("api_key")).alias("key_hash"), key_class(F.col("api_key")).alias("key_class"))
            .groupBy("key_hash", "key_class").agg(F.count(F.lit(1)).alias("calls")))


@query("key_owner", sql="""
WITH keys AS (
  SELECT DISTINCT sha256(api_key) AS key_hash, 't-' || (user_id % 8) AS owner_tenant,
         (['free', 'pro', 'enterprise'])[user_id % 3 + 1] AS plan
  FROM v_calls WHERE user_id % 10 <> 0
)
SELECT coalesce(k.owner_tenant, 'unauthorised') AS owner_tenant, coalesce(k.plan, 'none') AS plan, count(*) AS calls
FROM v_calls c LEFT JOIN keys k ON k.key_hash = sha256(c.api_key) GROUP BY ALL
""")
def key_owner(spark, sf_dir):
    """Only key hashes are stored; calls are matched by hashing the presented key."""
    c = V.calls(spark, sf_dir)
    keys = (c.filter(F.col("user_id") % 10 != 0)
            .select(I.key_hash(F.col("api_key")).alias("key_hash"),
                    F.concat(F.lit("t-"), (F.col("user_id") % 8).cast("string")).alias("owner_tenant"),
                    F.element_at(F.array(F.lit("free"), F.lit("pro"), F.lit("enterprise")),
                                 (F.col("user_id") % 3 + 1).cast("int")).alias("plan"))
            .dropDuplicates(["key_hash"]))
    j = c.select(I.key_hash(F.col("api_key")).alias("key_hash")).join(keys, "key_hash", "left")
    return (j.select(F.coalesce("owner_tenant", F.lit("unauthorised")).alias("owner_tenant"),
                     F.coalesce("plan", F.lit("none")).alias("plan"))
            .groupBy("owner_tenant", "plan").agg(F.count(F.lit(1)).alias("calls")))
