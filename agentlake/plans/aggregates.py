"""Queries: aggregations over the request log and tool results (A1–A10, A16–A19, T-5)
and classification scalars (P11–P17)."""

from __future__ import annotations

from pyspark.sql import functions as F

from agentlake.functions import classify as C
from agentlake.operators.quantiles import exact_quantiles
from agentlake.plans.registry import query
from agentlake.sources import views as V

BLOCKED_SENTINEL = r"^__.*_blocked$"


@query("live_metrics", sql="""
SELECT count(*) AS total_requests,
       CAST(sum(latency_ms) AS BIGINT) AS total_latency_ms,
       CAST(sum(total_tokens) AS BIGINT) AS total_tokens,
       CASE WHEN count(*) > 0 THEN round(sum(latency_ms) / count(*), 6) ELSE 0 END AS avg_latency_ms,
       count(*) FILTER (WHERE cache_hit) AS cache_hits
FROM v_requests
""")
def live_metrics(spark, sf_dir):
    r = V.requests(spark, sf_dir)
    n = F.count(F.lit(1))
    return r.agg(
        n.alias("total_requests"),
        F.sum("latency_ms").cast("bigint").alias("total_latency_ms"),
        F.sum("total_tokens").cast("bigint").alias("total_tokens"),
        F.when(n > 0, F.round(F.sum("latency_ms") / n, 6)).otherwise(F.lit(0.0)).alias("avg_latency_ms"),
        F.count_if("cache_hit").alias("cache_hits"),
    )


@query("tool_metrics", sql="""
SELECT tenant_id, tool_name, count(*) AS calls, CAST(sum(latency_ms) AS BIGINT) AS total_latency_ms,
       CAST(sum(latency_ms) // count(*) AS BIGINT) AS avg_latency_ms
FROM v_tool_results GROUP BY tenant_id, tool_name
""")
def tool_metrics(spark, sf_dir):
    t = V.tool_results(spark, sf_dir)
    g = t.groupBy("tenant_id", "tool_name").agg(
        F.count(F.lit(1)).alias("calls"), F.sum("latency_ms").cast("bigint").alias("total_latency_ms"))
    return g.withColumn("avg_latency_ms", F.expr("CAST(total_latency_ms div calls AS BIGINT)"))


@query("fan_out_batches", sql="""
SELECT batch_id, tenant_id, count(*) AS fan_out_count,
       count(*) FILTER (WHERE success) AS success_count,
       count(*) FILTER (WHERE contains(content, 'ALREADY_IN_FLIGHT')) AS already_in_flight_count,
       count(*) FILTER (WHERE contains(content, 'PREVIOUS_ATTEMPT_UNKNOWN')) AS unknown_retry_blocked_count,
       CAST(max(end_ms) - min(start_ms) AS BIGINT) AS total_latency_ms,
       array_to_string(list(tool_name ORDER BY tool_name), ',') AS tools
FROM v_tool_results GROUP BY batch_id, tenant_id
""")
def fan_out_batches(spark, sf_dir):
    t = V.tool_results(spark, sf_dir)
    return t.groupBy("batch_id", "tenant_id").agg(
        F.count(F.lit(1)).alias("fan_out_count"),
        F.count_if("success").alias("success_count"),
        F.count_if(F.col("content").contains("ALREADY_IN_FLIGHT")).alias("already_in_flight_count"),
        F.count_if(F.col("content").contains("PREVIOUS_ATTEMPT_UNKNOWN")).alias("unknown_retry_blocked_count"),
        (F.max("end_ms") - F.min("start_ms")).cast("bigint").alias("total_latency_ms"),
        F.array_join(F.array_sort(F.collect_list("tool_name")), ",").alias("tools"),
    )


@query("usage", sql=r"""
SELECT tenant_id, team_id, api_key_alias, model, requested_provider, strftime(ts, '%Y-%m-%d') AS day,
       count(*) AS requests, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens,
       CAST(sum(total_tokens) AS BIGINT) AS total_tokens
FROM v_requests WHERE NOT regexp_matches(model, '^__.*_blocked$')
GROUP BY ALL
""")
def usage(spark, sf_dir):
    r = V.requests(spark, sf_dir).filter(~F.col("model").rlike(BLOCKED_SENTINEL))
    return (r.withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
            .groupBy("tenant_id", "team_id", "api_key_alias", "model", "requested_provider", "day")
            .agg(F.count(F.lit(1)).alias("requests"),
                 F.sum("prompt_tokens").cast("bigint").alias("prompt_tokens"),
                 F.sum("total_tokens").cast("bigint").alias("total_tokens")))


@query("usage_rollup", bench=True, sql="""
SELECT tenant_id, team_id, api_key_alias, model,
       CAST(grouping(tenant_id, team_id, api_key_alias, model) AS BIGINT) AS level,
       count(*) AS requests, CAST(sum(total_tokens) AS BIGINT) AS total_tokens
FROM v_requests GROUP BY ROLLUP (tenant_id, team_id, api_key_alias, model)
""")
def usage_rollup(spark, sf_dir):
    r = V.requests(spark, sf_dir)
    return (r.rollup("tenant_id", "team_id", "api_key_alias", "model")
            .agg(F.grouping_id().cast("bigint").alias("level"),
                 F.count(F.lit(1)).alias("requests"),
                 F.sum("total_tokens").cast("bigint").alias("total_tokens")))


@query("usage_cube", sql="""
SELECT tenant_id, model, requested_provider,
       CAST(grouping(tenant_id, model, requested_provider) AS BIGINT) AS level,
       count(*) AS requests, CAST(sum(total_tokens) AS BIGINT) AS total_tokens
FROM v_requests GROUP BY CUBE (tenant_id, model, requested_provider)
""")
def usage_cube(spark, sf_dir):
    r = V.requests(spark, sf_dir)
    return (r.cube("tenant_id", "model", "requested_provider")
            .agg(F.grouping_id().cast("bigint").alias("level"),
                 F.count(F.lit(1)).alias("requests"),
                 F.sum("total_tokens").cast("bigint").alias("total_tokens")))


@query("cache_metrics", sql="""
SELECT tenant_id, count(*) AS requests,
       count(*) FILTER (WHERE cache_hit) AS hits,
       round(count(*) FILTER (WHERE cache_hit) / count(*), 6) AS hit_ratio,
       CAST(coalesce(sum(prompt_tokens) FILTER (WHERE cache_hit), 0) AS BIGINT) AS tokens_saved,
       CAST(coalesce(sum(latency_ms) FILTER (WHERE cache_hit), 0) AS BIGINT) AS hit_latency_ms,
       CAST(coalesce(sum((CAST(prompt_tokens AS DECIMAL(12,0)) * in_rate + CAST(completion_tokens AS DECIMAL(12,0)) * out_rate) * CAST(0.000001 AS DECIMAL(7,6)))
                     FILTER (WHERE cache_hit), 0) AS DECIMAL(38,12)) AS cost_saved_usd
FROM v_priced GROUP BY tenant_id
""")
def cache_metrics(spark, sf_dir):
    from agentlake.plans.billing import priced_requests
    r = priced_requests(spark, sf_dir)
    hit = F.col("cache_hit")
    tokens = lambda c: F.col(c).cast("decimal(12,0)")
    # what the provider would have charged at its uncached rates
    saved = (tokens("prompt_tokens") * F.col("in_rate") + tokens("completion_tokens") * F.col("out_rate")) * F.lit("0.000001").cast("decimal(7,6)")
    return r.groupBy("tenant_id").agg(
        F.count(F.lit(1)).alias("requests"),
        F.count_if(hit).alias("hits"),
        F.round(F.count_if(hit) / F.count(F.lit(1)), 6).alias("hit_ratio"),
        F.coalesce(F.sum(F.when(hit, F.col("prompt_tokens"))), F.lit(0)).cast("bigint").alias("tokens_saved"),
        F.coalesce(F.sum(F.when(hit, F.col("latency_ms"))), F.lit(0)).cast("bigint").alias("hit_latency_ms"),
        F.coalesce(F.sum(F.when(hit, saved)), F.lit(0)).cast("decimal(38,12)").alias("cost_saved_usd"),
    )


@query("hot_swaps", sql="""
SELECT requested_provider, executed_provider, count(*) AS swaps,
       round(count(*) / any_value(n_req), 6) AS swap_rate
FROM v_requests r JOIN (SELECT requested_provider AS rp, count(*) AS n_req FROM v_requests GROUP BY 1) t
  ON t.rp = r.requested_provider
WHERE is_hot_swapped GROUP BY requested_provider, executed_provider
""")
def hot_swaps(spark, sf_dir):
    r = V.requests(spark, sf_dir)
    totals = r.groupBy("requested_provider").agg(F.count(F.lit(1)).alias("n_req"))
    swaps = (r.filter("is_hot_swapped").groupBy("requested_provider", "executed_provider")
             .agg(F.count(F.lit(1)).alias("swaps")))
    # totals has one row per provider: small by construction, AQE broadcasts it.
    return (swaps.join(totals, "requested_provider")
            .select("requested_provider", "executed_provider", "swaps",
                    F.round(F.col("swaps") / F.col("n_req"), 6).alias("swap_rate")))


@query("flow_edges", sql="""
SELECT stage, source, target, count(*) AS requests, CAST(sum(total_tokens) AS BIGINT) AS tokens FROM (
  SELECT 'model_to_requested' AS stage, model AS source, requested_provider AS target, total_tokens FROM v_requests
  UNION ALL
  SELECT 'requested_to_executed', requested_provider,
         CASE WHEN executed_provider = '' THEN 'none' ELSE executed_provider END, total_tokens FROM v_requests
  UNION ALL
  SELECT 'executed_to_outcome', CASE WHEN executed_provider = '' THEN 'none' ELSE executed_provider END,
         CASE WHEN cache_hit THEN 'cache_hit' WHEN status = 200 THEN 'ok' ELSE 'error_' || status END,
         total_tokens FROM v_requests
) GROUP BY ALL
""")
def flow_edges(spark, sf_dir):
    r = V.requests(spark, sf_dir)
    executed = F.when(F.col("executed_provider") == "", "none").otherwise(F.col("executed_provider"))
    outcome = (F.when(F.col("cache_hit"), "cache_hit").when(F.col("status") == 200, "ok")
               .otherwise(F.concat(F.lit("error_"), F.col("status").cast("string"))))
    # One pass: each request emits its three edges through a 3-element array.
    edges = F.explode(F.array(
        F.struct(F.lit("model_to_requested").alias("stage"), F.col("model").alias("source"),
                 F.col("requested_provider").alias("target")),
        F.struct(F.lit("requested_to_executed").alias("stage"), F.col("requested_provider").alias("source"),
                 executed.alias("target")),
        F.struct(F.lit("executed_to_outcome").alias("stage"), executed.alias("source"),
                 outcome.alias("target"))))
    e = r.select(edges.alias("e"), "total_tokens").select("e.*", "total_tokens")
    return e.groupBy("stage", "source", "target").agg(
        F.count(F.lit(1)).alias("requests"), F.sum("total_tokens").cast("bigint").alias("tokens"))


@query("latency_quantiles", sql="""
SELECT executed_provider AS provider, count(*) AS requests,
       round(quantile_cont(latency_ms, 0.5), 6) AS p50, round(quantile_cont(latency_ms, 0.9), 6) AS p90,
       round(quantile_cont(latency_ms, 0.95), 6) AS p95, round(quantile_cont(latency_ms, 0.99), 6) AS p99
FROM v_requests WHERE status = 200 AND executed_provider <> '' GROUP BY executed_provider
""")
def latency_quantiles(spark, sf_dir):
    """A10: exact, by histogram refinement; no buffer holds a provider's values."""
    r = V.requests(spark, sf_dir).filter((F.col("status") == 200) & (F.col("executed_provider") != ""))
    names = {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}
    q = exact_quantiles(r.select(F.col("executed_provider").alias("provider"), "latency_ms"), ["provider"], "latency_ms", names)
    return q.select("provider", F.col("n").alias("requests"), *[F.round(n, 6).alias(n) for n in names])


@query("latency_quantiles_approx")
def latency_quantiles_approx(spark, sf_dir):
    r = V.requests(spark, sf_dir).filter((F.col("status") == 200) & (F.col("executed_provider") != ""))
    return r.groupBy(F.col("executed_provider").alias("provider")).agg(
        F.percentile_approx("latency_ms", [0.5, 0.9, 0.95, 0.99], 10000).alias("quantiles"))


@query("exact_duplicates", sql="""
SELECT tenant_id, sha256(body) AS body_hash, count(*) AS copies, min(doc_id) AS first_doc_id,
       max(doc_id) AS last_doc_id
FROM v_cache_log GROUP BY tenant_id, sha256(body) HAVING count(*) > 1
""")
def exact_duplicates(spark, sf_dir):
    c = V.cache_log(spark, sf_dir)
    return (c.groupBy("tenant_id", F.sha2("body", 256).alias("body_hash"))
            .agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_doc_id"),
                 F.max("doc_id").alias("last_doc_id"))
            .filter(F.col("copies") > 1))


@query("distinct_sessions", sql="""
SELECT tenant_id, count(DISTINCT session_id) AS sessions, count(DISTINCT api_key_alias) AS api_keys,
       count(DISTINCT model) AS models, count(DISTINCT user_id) AS agents, any_value(t.tools) AS tools
FROM v_requests LEFT JOIN (SELECT 't-' || (user_id % 8) AS tenant_id, count(DISTINCT tool_name) AS tools FROM v_calls GROUP BY 1) t USING (tenant_id)
GROUP BY tenant_id
""")
def distinct_sessions(spark, sf_dir):
    """Distinct sessions, keys, models, agents (a user's agent) and tools by tenant."""
    r = V.requests(spark, sf_dir)
    tools = (V.calls(spark, sf_dir).groupBy(F.concat(F.lit("t-"), F.col("user_id") % 8).alias("tenant_id"))
             .agg(F.countDistinct("tool_name").alias("tools")))
    return r.groupBy("tenant_id").agg(
        F.countDistinct("session_id").alias("sessions"),
        F.countDistinct("api_key_alias").alias("api_keys"),
        F.countDistinct("model").alias("models"), F.countDistinct("user_id").alias("agents")).join(tools, "tenant_id", "left")


@query("approx_sessions")
def approx_sessions(spark, sf_dir):
    r = V.requests(spark, sf_dir)
    return r.groupBy("tenant_id").agg(F.approx_count_distinct("session_id", 0.01).alias("sessions_approx"))


@query("top_models", sql="""
SELECT model, CAST(sum(total_tokens) AS BIGINT) AS tokens, count(*) AS requests
FROM v_requests GROUP BY model ORDER BY tokens DESC, model LIMIT 3
""")
def top_models(spark, sf_dir):
    r = V.requests(spark, sf_dir)
    return (r.groupBy("model").agg(F.sum("total_tokens").cast("bigint").alias("tokens"),
                                   F.count(F.lit(1)).alias("requests"))
            .orderBy(F.desc("tokens"), "model").limit(3))


@query("tool_policy", sql="""
SELECT tool_name,
       CASE WHEN ro THEN 'safe' ELSE 'unsafe' END AS retry_policy,
       CASE WHEN ro THEN 'read_only' ELSE 'irreversible' END AS side_effect_class,
       CASE WHEN ro THEN 'none' ELSE 'required' END AS idempotency_requirement,
       5 AS timeout_seconds, count(*) AS calls
FROM (SELECT tool_name,
        (regexp_matches(lower(tool_name), '^(get|list|read|describe|search|query|select|show)')
         AND NOT regexp_matches(lower(tool_name), 'create|charge|pay|update|delete|mutate|insert|transfer')) AS ro
      FROM v_tool_results) GROUP BY ALL
""")
def tool_policy(spark, sf_dir):
    t = V.tool_results(spark, sf_dir)
    pol = C.tool_policy(F.col("tool_name"))
    return (t.select("tool_name", pol.alias("p")).select("tool_name", "p.*")
            .groupBy("tool_name", "retry_policy", "side_effect_class", "idempotency_requirement",
                     "timeout_seconds")
            .agg(F.count(F.lit(1)).alias("calls")))


@query("classify_outcome", sql="""
SELECT tool_name,
       CASE WHEN success THEN 'succeeded'
            WHEN contains(content, 'MCP_TIMEOUT') OR contains(content, 'unreachable')
              OR contains(content, 'not configured') OR contains(content, 'timed out')
              OR contains(content, 'timeout') THEN 'unknown' ELSE 'failed' END AS outcome,
       CASE WHEN success THEN NULL WHEN contains(content, 'TIMEOUT') THEN 'timeout'
            ELSE 'execution_error' END AS error_category,
       count(*) AS calls
FROM v_tool_results GROUP BY ALL
""")
def classify_outcome(spark, sf_dir):
    t = V.tool_results(spark, sf_dir)
    return (t.select("tool_name", C.classify_outcome(F.col("success"), F.col("content")).alias("outcome"),
                     F.when(~F.col("success"), C.error_category(F.col("content"))).alias("error_category"))
            .groupBy("tool_name", "outcome", "error_category").agg(F.count(F.lit(1)).alias("calls")))


@query("result_flags", sql="""
SELECT contains(content, 'ALREADY_IN_FLIGHT') AS in_flight,
       contains(content, 'PREVIOUS_ATTEMPT_UNKNOWN') AS unknown_retry_blocked, count(*) AS calls
FROM v_tool_results GROUP BY ALL
""")
def result_flags(spark, sf_dir):
    t = V.tool_results(spark, sf_dir)
    return (t.select(F.col("content").contains("ALREADY_IN_FLIGHT").alias("in_flight"),
                     F.col("content").contains("PREVIOUS_ATTEMPT_UNKNOWN").alias("unknown_retry_blocked"))
            .groupBy("in_flight", "unknown_retry_blocked").agg(F.count(F.lit(1)).alias("calls")))


@query("retryable_status", sql="""
SELECT status, status IN (401, 403, 404, 408, 429, 500, 502, 503, 504) AS retryable, count(*) AS requests
FROM v_requests GROUP BY ALL
""")
def retryable_status(spark, sf_dir):
    r = V.requests(spark, sf_dir)
    return (r.select("status", C.is_retryable_status(F.col("status")).alias("retryable"))
            .groupBy("status", "retryable").agg(F.count(F.lit(1)).alias("requests")))


@query("model_family", sql="""
SELECT model,
       CASE WHEN starts_with(lower(trim(model)), 'gpt-') THEN 'gpt-4o'
            WHEN starts_with(lower(trim(model)), 'claude-') THEN 'claude-3-5-sonnet'
            WHEN starts_with(lower(trim(model)), 'gemini-') THEN 'gemini-1.5-pro'
            WHEN starts_with(lower(trim(model)), 'deepseek-') THEN 'deepseek-r1'
            WHEN starts_with(lower(trim(model)), 'cohere-') OR starts_with(lower(trim(model)), 'command-')
                 THEN 'cohere-command-r'
            WHEN starts_with(lower(trim(model)), 'llama-') THEN 'llama-3.3-70b-versatile' END AS family_default,
       count(*) AS requests
FROM v_requests GROUP BY ALL
""")
def model_family(spark, sf_dir):
    r = V.requests(spark, sf_dir)
    return (r.select("model", C.family_default(F.col("model")).alias("family_default"))
            .groupBy("model", "family_default").agg(F.count(F.lit(1)).alias("requests")))


@query("provider_format", sql="""
SELECT requested_provider,
       CASE lower(requested_provider) WHEN 'anthropic' THEN 'anthropic' WHEN 'gemini' THEN 'gemini'
            WHEN 'google' THEN 'gemini' WHEN 'cohere' THEN 'cohere' ELSE 'openai' END AS schema_format,
       CASE lower(requested_provider) WHEN 'anthropic' THEN 'x_api_key' WHEN 'gemini' THEN 'google_api_key'
            WHEN 'google' THEN 'google_api_key' ELSE 'bearer' END AS auth_scheme,
       count(*) AS requests
FROM v_requests GROUP BY ALL
""")
def provider_format(spark, sf_dir):
    r = V.requests(spark, sf_dir)
    fmt = C.provider_format(F.col("requested_provider"))
    auth = (F.when(fmt == "anthropic", "x_api_key").when(fmt == "gemini", "google_api_key")
            .otherwise("bearer"))
    return (r.select("requested_provider", fmt.alias("schema_format"), auth.alias("auth_scheme"))
            .groupBy("requested_provider", "schema_format", "auth_scheme")
            .agg(F.count(F.lit(1)).alias("requests")))
