"""Queries: telemetry split and latest trace."""

from __future__ import annotations

from pyspark.sql import functions as F

from agentlake.plans.registry import query
from agentlake.sources.telemetry import telemetry


def classify(tel):
    v = F.try_parse_json("json")
    typ = F.try_variant_get(v, "$.type", "string")
    kind = (F.when(typ.isNotNull(), typ)
            .when(F.try_variant_get(v, "$.trace_id", "string").isNotNull(), "trace")
            .when(F.try_variant_get(v, "$.id", "string").isNotNull(), "request_log")
            .otherwise("unknown"))
    return tel.select("seq", v.alias("v"), kind.alias("kind"))


#: Columns of the target table of each kind: name, path, type (S3).
TABLES = {
    "request_log": [("id", "$.id", "string"), ("tenant_id", "$.tenant_id", "string"), ("model", "$.model", "string"), ("status", "$.status", "bigint"),
                    ("latency_ms", "$.latency_ms", "bigint"), ("total_tokens", "$.total_tokens", "bigint")],
    "trace": [("trace_id", "$.trace_id", "string"), ("session_id", "$.session_id", "string"), ("tenant_id", "$.tenant_id", "string"),
              ("executed_provider", "$.executed_provider", "string"), ("cache_hit", "$.cache_hit", "boolean"), ("latency_ms", "$.latency_ms", "bigint"),
              ("total_tokens", "$.total_tokens", "bigint")],
    "tool_execution_event": [("idempotency_key", "$.idempotency_key", "string"), ("tool_name", "$.tool_name", "string"), ("tenant_id", "$.tenant_id", "string")],
    "mcp_fan_out": [("tenant_id", "$.tenant_id", "string"), ("fan_out_count", "$.fan_out_count", "bigint"), ("total_latency_ms", "$.total_latency_ms", "bigint"),
                    ("success_count", "$.success_count", "bigint")],
    "mcp_tool_results": [("tenant_id", "$.tenant_id", "string"), ("tool_messages", "$.tool_messages", "array<variant>")],
    "agentic_loop_detection": [("session_id", "$.session_id", "string"), ("tenant_id", "$.tenant_id", "string"),
                               ("agentic_requests_total", "$.agentic_requests_total", "bigint"), ("loop_limit_hits", "$.loop_limit_hits", "bigint")],
}


def table(classified, kind):
    """The typed rows of one kind."""
    cols = [F.try_variant_get("v", path, of).alias(name) for name, path, of in TABLES[kind]]
    return classified.filter(F.col("kind") == kind).select("seq", *cols, F.try_variant_get("v", "$.ts", "bigint").alias("ts"))


@query("telemetry_split", sql="""
SELECT event_id * 6 AS seq, 'request_log' AS kind, trace_id AS key, tenant_id, CAST(latency_ms AS BIGINT) AS latency_ms, CAST(total_tokens AS BIGINT) AS amount, sec AS ts FROM v_requests
UNION ALL SELECT event_id * 6 + 1, 'trace', trace_id, tenant_id, CAST(latency_ms AS BIGINT), CAST(total_tokens AS BIGINT), sec FROM v_requests
UNION ALL SELECT event_id * 6 + 2, 'tool_execution_event', idempotency_key, tenant_id, NULL, NULL, claim_sec FROM v_attempts
UNION ALL SELECT event_id * 6 + 3, 'mcp_fan_out', NULL, tenant_id, delay_sec * 100, op % 7, claim_sec FROM v_attempts WHERE event_id % 6 = 0
UNION ALL SELECT event_id * 6 + 3, 'mcp_tool_results', NULL, tenant_id, NULL, 2, claim_sec FROM v_attempts WHERE event_id % 6 = 2
UNION ALL SELECT event_id * 6 + 3, 'agentic_loop_detection', idempotency_key, tenant_id, NULL, op % 2, claim_sec FROM v_attempts WHERE event_id % 6 = 4
""")
def telemetry_split(spark, sf_dir):
    """S3: one parse, route by discriminator; the rows of all six tables, brought to common columns."""
    c = classify(telemetry(spark, sf_dir))
    get = lambda path, of: F.try_variant_get("v", path, of)
    key = F.coalesce(get("$.trace_id", "string"), get("$.id", "string"), get("$.idempotency_key", "string"), get("$.session_id", "string"))
    amount = F.coalesce(get("$.total_tokens", "bigint"), get("$.success_count", "bigint"), F.nullif(F.size(get("$.tool_messages", "array<variant>")), F.lit(-1)).cast("bigint"),
                        get("$.loop_limit_hits", "bigint"))
    return c.select("seq", "kind", key.alias("key"), get("$.tenant_id", "string").alias("tenant_id"),
                    F.coalesce(get("$.latency_ms", "bigint"), get("$.total_latency_ms", "bigint")).alias("latency_ms"), amount.alias("amount"), get("$.ts", "bigint").alias("ts"))


@query("latest_trace", sql="""
SELECT trace_id AS trace_key, 'trace' AS kind, CAST(2 AS BIGINT) AS versions, executed_provider FROM v_requests
""")
def latest_trace(spark, sf_dir):
    """key = trace_id else id, last write wins by (ts, seq); keyless events dropped."""
    c = classify(telemetry(spark, sf_dir))
    return latest_by_key(c).drop("o")


def latest_by_key(c):
    """(seq, v, kind) -> trace_key, kind, versions, executed_provider of the last
    write by (ts, seq), and that order as ``o``; keyless events are dropped."""
    key = F.coalesce(F.try_variant_get("v", "$.trace_id", "string"), F.try_variant_get("v", "$.id", "string"))
    order = F.struct(F.try_variant_get("v", "$.ts", "bigint").alias("ts"), F.col("seq"))
    k = c.select(key.alias("trace_key"), "kind", order.alias("o"),
                 F.try_variant_get("v", "$.executed_provider", "string").alias("executed_provider"))
    k = k.filter(F.col("trace_key").isNotNull())
    return k.groupBy("trace_key").agg(
        F.max_by("kind", "o").alias("kind"), F.count(F.lit(1)).alias("versions"),
        F.max_by("executed_provider", "o").alias("executed_provider"), F.max("o").alias("o"))
