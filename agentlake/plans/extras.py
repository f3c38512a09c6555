"""Queries: target order, fastest target, usage tokens, workflow rollup, trace
ingest contract (T-1, T-4, P21, J13, S2)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from agentlake.functions import identity as I
from agentlake.operators import responses as RS
from agentlake.plans import identity as ID
from agentlake.plans import windows as W
from agentlake.plans.joins import _RESOLVE_SQL, _resolved
from agentlake.plans.registry import query
from agentlake.sources import views as V
from agentlake.sources.responses import responses
from agentlake.sources.tables import read


@query("target_order", sql=_RESOLVE_SQL + """
SELECT t.tenant_id, t.model, t.key_alias,
       row_number() OVER (PARTITION BY t.tenant_id, t.model ORDER BY t.priority, t.position) AS target_rank,
       count(c.event_id) AS requests
FROM d_routing t LEFT JOIN cand c ON c.map_tenant = t.tenant_id AND c.route_model = t.model AND c.position = t.position
WHERE t.position IS NOT NULL GROUP BY t.tenant_id, t.model, t.key_alias, t.priority, t.position
""")
def target_order(spark, sf_dir):
    """T-1: targets sorted by priority, stable on configuration position (weight ignored),
    with the traffic each one is eligible for."""
    from agentlake.operators import routing as R
    rt = R.routing(spark).filter(F.col("position").isNotNull())
    w = Window.partitionBy("tenant_id", "model").orderBy("priority", "position")
    ranked = rt.withColumn("target_rank", F.row_number().over(w).cast("bigint"))
    cand = R.candidates(spark, _resolved(spark, sf_dir)).select(
        F.col("map_tenant").alias("tenant_id"), F.col("route_model").alias("model"), "position", "event_id")
    n = cand.groupBy("tenant_id", "model", "position").agg(F.count("event_id").alias("requests"))
    return (ranked.join(n, ["tenant_id", "model", "position"], "left")
            .select("tenant_id", "model", "key_alias", "target_rank",
                    F.coalesce("requests", F.lit(0).cast("bigint")).alias("requests")))


@query("fastest_target", sql=W._EMA_ORACLE + ", " + _RESOLVE_SQL.strip()[5:] + """
, last AS (SELECT provider, arg_max(ema, tick) AS ema FROM e GROUP BY provider),
tg AS (SELECT DISTINCT map_tenant, route_model, key_alias, provider_name, position FROM cand)
SELECT map_tenant, route_model, key_alias, round(ema, 6) AS ema FROM (
  SELECT tg.*, l.ema, row_number() OVER (PARTITION BY map_tenant, route_model
                                         ORDER BY l.ema NULLS LAST, position) AS rn
  FROM tg LEFT JOIN last l ON l.provider = tg.provider_name) WHERE rn = 1
""")
def fastest_target(spark, sf_dir):
    """T-4: per route with traffic, the target whose provider has the lowest latest latency EMA."""
    from agentlake.operators import routing as R
    ema = W.ema_table(spark, sf_dir)
    last = ema.groupBy(F.col("provider").alias("provider_name")).agg(F.max_by("ema", "tick").alias("ema"))
    tg = R.candidates(spark, _resolved(spark, sf_dir)).select(
        "map_tenant", "route_model", "key_alias", "provider_name", "position").distinct()
    w = Window.partitionBy("map_tenant", "route_model").orderBy(F.col("ema").asc_nulls_last(), "position")
    return (tg.join(last, "provider_name", "left").withColumn("rn", F.row_number().over(w)).filter("rn = 1")
            .select("map_tenant", "route_model", "key_alias", F.round("ema", 6).alias("ema")))


@query("usage_tokens", sql="""
WITH pb AS (SELECT conv_id, strlen(text) AS prompt_bytes FROM conversations WHERE turn = 0)
SELECT c.conv_id * 10 + c.turn AS response_id,
       CAST(CASE WHEN c.conv_id % 5 IN (0, 1) THEN 10 + c.turn + len(string_split(c.text, ' '))
                 WHEN c.conv_id % 5 = 2 THEN 0
                 ELSE greatest(1, coalesce(pb.prompt_bytes, 0) // 4) + strlen(c.text) // 4 END AS BIGINT) AS total_tokens,
       c.conv_id % 5 IN (0, 1, 2) AS from_usage
FROM conversations c LEFT JOIN pb USING (conv_id) WHERE c.role = 'assistant'
""")
def usage_tokens(spark, sf_dir):
    """Usage.total_tokens of the unified response, else the byte estimate
    max(1, prompt/4) + completion/4 (prompt = the conversation's first turn)."""
    r = responses(spark, sf_dir)
    conv = read(spark, sf_dir, "conversations")
    pb = conv.filter("turn = 0").select("conv_id", F.octet_length("text").alias("prompt_bytes"))
    r = r.withColumn("conv_id", F.floor(F.col("response_id") / 10)).join(pb, "conv_id", "left")
    u = RS.unified_fields(F.col("body"), F.col("provider"))
    v = F.try_parse_json("body")
    text = F.coalesce(F.try_variant_get(v, "$.text", "string"),
                      F.try_variant_get(v, "$.output.message.content[0].text", "string"))
    est = (F.greatest(F.lit(1), F.floor(F.coalesce("prompt_bytes", F.lit(0)) / 4))
           + F.floor(F.octet_length(text) / 4)).cast("bigint")
    return r.select("response_id", F.coalesce(u["total_tokens"], est).alias("total_tokens"),
                    u["total_tokens"].isNotNull().alias("from_usage"))


@query("workflow_rollup", sql=f"""
WITH s AS (
  SELECT *, coalesce(tenant_claim, trim(tenant_header), '{I.ZERO_TENANT}') AS tenant_id,
         count(*) OVER (PARTITION BY execution_id) AS batch_size FROM v_calls
), c AS (
  SELECT *, CASE WHEN provided_session IS NOT NULL AND NOT {ID._NULLISH.format(x='provided_session')} THEN trim(provided_session) ELSE 'user-' || user_id END AS session_id,
         'wf-' || user_id || '-' || CAST(floor(event_id / 500) AS BIGINT) AS workflow_id,
         CASE WHEN batch_size = 1 AND trace_op_id IS NOT NULL THEN trace_op_id ELSE sha256(execution_id || '::' || call_id) END AS operation_id FROM s
), o AS (
  SELECT tenant_id, session_id, workflow_id, execution_id, operation_id, count(*) AS attempts FROM c GROUP BY ALL
)
SELECT tenant_id, session_id, workflow_id, execution_id, CAST(grouping(tenant_id, session_id, workflow_id, execution_id) AS BIGINT) AS level,
       count(*) AS operations, CAST(sum(attempts) AS BIGINT) AS attempts, max(attempts) AS most_attempts
FROM o GROUP BY ROLLUP (tenant_id, session_id, workflow_id, execution_id)
""")
def workflow_rollup(spark, sf_dir):
    """Tenant -> session -> workflow -> execution -> operation -> attempt as a rollup. The
    operations of an execution are counted first, so the levels above add up small rows."""
    c = ID._calls(spark, sf_dir)
    u = F.col("user_id").cast("string")
    c = c.withColumn("session_id", I.given_session(F.col("provided_session"), F.concat(F.lit("user-"), u))) \
        .withColumn("workflow_id", F.concat(F.lit("wf-"), u, F.lit("-"), F.floor(F.col("event_id") / 500).cast("string"))) \
        .withColumn("operation_id", I.operation_id(F.col("trace_op_id"), F.col("batch_size"), F.col("execution_id"), F.col("call_id")))
    levels = ["tenant_id", "session_id", "workflow_id", "execution_id"]
    o = c.groupBy(*levels, "operation_id").agg(F.count(F.lit(1)).alias("attempts"))
    return o.rollup(*levels).agg(F.grouping_id().cast("bigint").alias("level"), F.count(F.lit(1)).alias("operations"),
                                 F.sum("attempts").cast("bigint").alias("attempts"), F.max("attempts").alias("most_attempts"))


# Required fields of a trace ingest record.
TRACE_REQUIRED = ["trace_id", "session_id", "tenant_id", "model", "status", "latency_ms", "total_tokens",
                  "cache_hit", "prompt_content", "response_content"]
TRACE_SCHEMA = ("trace_id string, session_id string, parent_trace_id string, tenant_id string, model string, "
                "status int, latency_ms int, total_tokens bigint, cache_hit boolean, prompt_content string, "
                "response_content string")


def trace_records(spark, sf_dir):
    """Trace ingest records as JSON; every 17th lacks response_content, every 19th lacks model."""
    r = V.requests(spark, sf_dir, with_parent=True)
    rec = F.struct("trace_id", "session_id", "parent_trace_id", "tenant_id",
                   F.when(F.col("event_id") % 19 != 0, F.col("model")).alias("model"), "status", "latency_ms",
                   "total_tokens", "cache_hit", F.concat(F.lit("prompt "), F.col("event_id")).alias("prompt_content"),
                   F.when(F.col("event_id") % 17 != 0, F.concat(F.lit("response "), F.col("event_id")))
                   .alias("response_content"))
    return r.select("event_id", F.to_json(rec).alias("json"))


@query("ingest_traces", sql="""
SELECT 'tr-' || event_id AS trace_id,
       CASE WHEN event_id % 17 = 0 OR event_id % 19 = 0 THEN 'quarantine' ELSE 'valid' END AS status,
       concat_ws(',', CASE WHEN event_id % 19 = 0 THEN 'model' END,
                      CASE WHEN event_id % 17 = 0 THEN 'response_content' END) AS missing
FROM events
""")
def ingest_traces(spark, sf_dir):
    """Parse against the record contract (PERMISSIVE); a record missing a
    required field goes to quarantine with the list of missing fields."""
    t = trace_records(spark, sf_dir)
    p = t.select(F.from_json("json", TRACE_SCHEMA).alias("r")).select("r.*")
    missing = F.concat_ws(",", *[F.when(F.col(c).isNull(), F.lit(c)) for c in TRACE_REQUIRED])
    return p.select("trace_id", F.when(missing == "", "valid").otherwise("quarantine").alias("status"),
                    missing.alias("missing"))
