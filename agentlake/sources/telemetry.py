"""Mixed telemetry events as one JSON string column (FIXTURES C8).

Each request yields a compact event keyed ``id`` and, one sequence step
later, a deep trace keyed ``trace_id``; each attempt claim yields a
``tool_execution_event`` (no id at all). Of every six events the first yields an
``mcp_fan_out`` (the batch of all six), the third the ``mcp_tool_results`` and the
fifth an ``agentic_loop_detection``. ``seq`` orders writes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agentlake.sources import views as V
from agentlake.sources.tables import memo


@memo
def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = V.requests(spark, sf_dir)
    compact = r.select((F.col("event_id") * 6).alias("seq"), F.to_json(F.struct(
        F.col("trace_id").alias("id"), "tenant_id", "model", "status", "latency_ms", "total_tokens",
        F.col("sec").alias("ts"))).alias("json"))
    deep = r.select((F.col("event_id") * 6 + 1).alias("seq"), F.to_json(F.struct(
        "trace_id", "session_id", "tenant_id", "requested_provider", "executed_provider", "is_hot_swapped",
        "cache_hit", "latency_ms", "total_tokens", F.col("sec").alias("ts"))).alias("json"))
    a = V.attempts(spark, sf_dir)
    tool = a.select((F.col("event_id") * 6 + 2).alias("seq"), F.to_json(F.struct(
        F.lit("tool_execution_event").alias("type"), "idempotency_key", "tool_name", "tenant_id",
        F.col("claim_sec").alias("ts"))).alias("json"))
    slot = F.col("event_id") % 6
    fan = F.struct(F.lit("mcp_fan_out").alias("type"), "tenant_id", F.lit(6).alias("fan_out_count"), (F.col("delay_sec") * 100).alias("total_latency_ms"),
                   (F.col("op") % 7).alias("success_count"), F.col("claim_sec").alias("ts"))
    message = F.struct(F.lit("tool").alias("role"), F.concat(F.lit("call_"), "event_id").alias("tool_call_id"), "tool_name")
    results = F.struct(F.lit("mcp_tool_results").alias("type"), "tenant_id", F.array(message, message).alias("tool_messages"), F.col("claim_sec").alias("ts"))
    loop = F.struct(F.lit("agentic_loop_detection").alias("type"), F.col("idempotency_key").alias("session_id"), "tenant_id", F.lit(1).alias("agentic_requests_total"),
                    (F.col("op") % 2).alias("loop_limit_hits"), F.col("claim_sec").alias("ts"))
    more = a.where(slot.isin(0, 2, 4)).select((F.col("event_id") * 6 + 3).alias("seq"), F.when(slot == 0, F.to_json(fan)).when(slot == 2, F.to_json(results)).otherwise(F.to_json(loop)).alias("json"))
    return compact.unionByName(deep).unionByName(tool).unionByName(more)
