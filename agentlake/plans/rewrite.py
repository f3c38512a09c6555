"""Queries: model rewrite and policy soft-steer."""

from __future__ import annotations


import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from agentlake.operators import responses as RS
from agentlake.operators.dims import bounded
from agentlake.plans.registry import query
from agentlake.plans.tools import FAIL_OPEN, POLICY
from agentlake.sources import dimensions as D
from agentlake.sources.payloads import payloads
from agentlake.sources.responses import responses

# Fixed value (ours, unbranded): content of a soft-steered (denied) response.
DENY_CONTENT = '{"error":"Policy Denied. Use read-only tools."}'
REWRITE_SUFFIX = "-latest"


def rewrite_model_text(body: str | None, target: str | None) -> str | None:
    """Replace the value of the first top-level ``"model"`` string, leaving every
    other byte as is; None when the body has no top-level model string."""
    if body is None or target is None:
        return None
    depth, i, n = 0, 0, len(body)
    while i < n:
        c = body[i]
        if c == '"':
            if depth == 1 and body.startswith('"model"', i):
                j = i + 7
                while j < n and body[j] in " \t\r\n":
                    j += 1
                if j < n and body[j] == ":":
                    j += 1
                    while j < n and body[j] in " \t\r\n":
                        j += 1
                    if j < n and body[j] == '"':
                        k = j + 1
                        while k < n:
                            if body[k] == "\\":
                                k += 2
                                continue
                            if body[k] == '"':
                                return body[:j + 1] + target + body[k:]
                            k += 1
            # skip the string
            k = i + 1
            while k < n:
                if body[k] == "\\":
                    k += 2
                    continue
                if body[k] == '"':
                    break
                k += 1
            i = k + 1
            continue
        if c == "{":
            depth += 1
        elif c == "}":
            depth -= 1
        i += 1
    return None


@pandas_udf(StringType())
def _rewrite_udf(body: pd.Series, target: pd.Series) -> pd.Series:
    return pd.Series([rewrite_model_text(b, t) for b, t in zip(body, target)])


@query("rewrite_model", sql=f"""
SELECT DISTINCT conv_id AS payload_id,
       CASE WHEN conv_id % 37 = 0 THEN 'INVALID_JSON' WHEN conv_id % 41 = 0 THEN 'MISSING_MODEL' ELSE 'rewritten' END
           AS status,
       CASE WHEN conv_id % 37 <> 0 AND conv_id % 41 <> 0
            THEN (['gpt-4o', 'claude-3-5-sonnet', 'gemini-1.5-pro', 'command-r', 'anthropic.claude-3-sonnet'])[conv_id % 5 + 1]
                 || '{REWRITE_SUFFIX}' END AS new_model
FROM conversations
""")
def rewrite_model(spark, sf_dir):
    """Payload migration — each valid body's model becomes ``<model>-latest``;
    all other bytes are kept."""
    from agentlake.operators.payloads import extract_model, ingest_status
    p = payloads(spark, sf_dir)
    st = ingest_status(F.col("body"))
    target = F.concat(extract_model(F.col("body")), F.lit(REWRITE_SUFFIX))
    out = p.select("payload_id", st.alias("status"),
                   F.when(st == "valid", _rewrite_udf(F.col("body"), target)).alias("out"))
    status = F.when(F.col("out").isNotNull(), F.lit("rewritten")).otherwise(F.col("status"))
    return out.select("payload_id", status.alias("status"), extract_model(F.col("out")).alias("new_model"))


@query("steer_denied", sql=f"""
WITH calls AS (
  SELECT conv_id * 10 + turn AS response_id, 't-' || (conv_id % 8) AS tenant_id, 'tool_' || (turn % 4) AS tool_name
  FROM conversations
  WHERE role = 'assistant' AND conv_id % 5 = 0 AND (conv_id + turn) % 3 = 0 AND (conv_id * 10 + turn) % 13 <> 0
), pol AS (SELECT * FROM (VALUES {", ".join(f"('{a}', '{b}', {str(c).upper()})" for a, b, c in POLICY)})
           AS p(tenant_id, tool_name, allow)),
denied AS (
  SELECT c.response_id FROM calls c LEFT JOIN pol p USING (tenant_id, tool_name)
  GROUP BY c.response_id HAVING bool_or(NOT coalesce(p.allow, {str(FAIL_OPEN).upper()}))
)
SELECT r.conv_id * 10 + r.turn AS response_id, d.response_id IS NOT NULL AS denied,
       CASE WHEN d.response_id IS NOT NULL THEN '{DENY_CONTENT}' ELSE r.text END AS content,
       CASE WHEN d.response_id IS NOT NULL THEN 'stop'
            WHEN (r.conv_id + r.turn) % 3 = 0 THEN 'tool_calls' ELSE 'stop' END AS finish_reason
FROM conversations r LEFT JOIN denied d ON d.response_id = r.conv_id * 10 + r.turn
WHERE r.role = 'assistant' AND r.conv_id % 5 = 0
""")
def steer_denied(spark, sf_dir):
    """An OpenAI response with any denied tool call gets its message
    replaced by the compact deny content and finish_reason ``stop``."""
    r = responses(spark, sf_dir).filter(F.col("provider") == "openai")
    r = r.withColumn("tenant_id", F.concat(F.lit("t-"), (F.floor(F.col("response_id") / 10) % 8).cast("string")))
    calls = RS.response_tool_calls(r, "openai").join(r.select("response_id", "tenant_id"), "response_id")
    pol = bounded(D.to_df(spark, POLICY, ["tenant_id", "tool_name", "allow"], ["string", "string", "boolean"]))
    denied = (calls.join(pol, ["tenant_id", "tool_name"], "left")
              .groupBy("response_id").agg(F.bool_or(~F.coalesce("allow", F.lit(FAIL_OPEN))).alias("denied")))
    j = r.join(denied, "response_id", "left").withColumn("denied", F.coalesce("denied", F.lit(False)))
    steered = F.to_json(F.struct(F.array(F.struct(
        F.struct(F.lit("tool").alias("role"), F.lit(DENY_CONTENT).alias("content")).alias("message"),
        F.lit("stop").alias("finish_reason"))).alias("choices")))
    body = F.when(F.col("denied"), steered).otherwise(F.col("body"))
    u = RS.unified_fields(body, F.lit("openai"))
    return j.select("response_id", "denied", u["content"].alias("content"), u["finish_reason"].alias("finish_reason"))



