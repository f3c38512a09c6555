"""Queries: request payload jobs on VARIANT.

Oracles never parse JSON: they derive the expected values straight from
``conversations``, the base columns the payloads were built from.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from agentlake.operators import payloads as PL
from agentlake.plans.registry import query
from agentlake.sources import payloads as SP

_EXPECTED_CALLS = """
SELECT conv_id AS payload_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS call_index,
       CASE WHEN conv_id % 5 IN (0, 1) THEN 'call_' || conv_id || '_' || turn END AS call_id,
       'tool_' || (turn % 4) AS tool_name,
       '{"conv":' || conv_id || ',"turn":' || turn || '}' AS args_canonical,
       (['openai', 'anthropic', 'gemini', 'cohere', 'bedrock'])[conv_id % 5 + 1] AS format
FROM conversations
WHERE role = 'assistant' AND (conv_id + turn) % 3 = 0 AND conv_id % 5 <> 4 AND conv_id % 37 <> 0
"""


def _payloads(spark, sf_dir):
    return SP.payloads(spark, sf_dir)


@query("request_tool_calls", bench=True, sql=f"""
SELECT payload_id, call_index, call_id, tool_name, args_canonical FROM ({_EXPECTED_CALLS})
""")
def request_tool_calls(spark, sf_dir):
    return PL.request_tool_calls(_payloads(spark, sf_dir))


@query("unify_tool_call", sql=f"""
SELECT format, tool_name, count(*) AS calls, count(DISTINCT args_canonical) AS distinct_args
FROM ({_EXPECTED_CALLS}) GROUP BY ALL
""")
def unify_tool_call(spark, sf_dir):
    p = _payloads(spark, sf_dir)
    c = PL.request_tool_calls(p, keep=("format",))
    return c.groupBy("format", "tool_name").agg(F.count(F.lit(1)).alias("calls"),
                                                F.countDistinct("args_canonical").alias("distinct_args"))


@query("ingest_quarantine", sql="""
SELECT DISTINCT conv_id AS payload_id,
       CASE WHEN conv_id % 37 = 0 THEN 'INVALID_JSON' WHEN conv_id % 41 = 0 THEN 'MISSING_MODEL' ELSE 'valid' END AS status
FROM conversations
""")
def ingest_quarantine(spark, sf_dir):
    """One pass, two outputs — rows with status 'valid' feed the silver
    table, the rest go to quarantine with their error code."""
    p = _payloads(spark, sf_dir)
    return p.select("payload_id", PL.ingest_status(F.col("body")).alias("status"))


@query("extract_model", sql="""
SELECT DISTINCT conv_id AS payload_id,
       CASE WHEN conv_id % 37 = 0 OR conv_id % 41 = 0 THEN NULL
            ELSE (['gpt-4o', 'claude-3-5-sonnet', 'gemini-1.5-pro', 'command-r', 'anthropic.claude-3-sonnet'])[conv_id % 5 + 1]
       END AS model
FROM conversations
""")
def extract_model(spark, sf_dir):
    p = _payloads(spark, sf_dir)
    return p.select("payload_id", PL.extract_model(F.col("body")).alias("model"))


@query("is_agentic", sql="""
SELECT DISTINCT conv_id AS payload_id, (conv_id % 37 <> 0 AND conv_id % 2 = 0 AND conv_id % 5 IN (0, 1)) AS agentic
FROM conversations
""")
def is_agentic(spark, sf_dir):
    p = _payloads(spark, sf_dir)
    return p.select("payload_id", PL.is_agentic(F.col("body"), F.lit("application/json")).alias("agentic"))


@query("has_tools", sql="""
WITH calls AS (
  SELECT conv_id, bool_or(role = 'assistant' AND (conv_id + turn) % 3 = 0) AS any_call FROM conversations GROUP BY conv_id
), p AS (SELECT DISTINCT conv_id, conv_id % 5 AS fmt FROM conversations)
SELECT p.conv_id AS payload_id,
       CASE WHEN p.conv_id % 2 = 0 AND p.fmt IN (0, 1) THEN true
            WHEN p.fmt IN (0, 3) THEN calls.any_call
            ELSE false END AS has_tools
FROM p JOIN calls USING (conv_id)
""")
def has_tools(spark, sf_dir):
    p = _payloads(spark, sf_dir)
    return p.select("payload_id", PL.has_tools(F.col("body")).alias("has_tools"))


_TRIM = "regexp_replace({x}, '^[[:space:]]+|[[:space:]]+$', '', 'g')"


@query("last_user_text", sql=f"""
WITH lu AS (
  SELECT conv_id, max(turn) FILTER (WHERE role = 'user') AS u,
         max(turn) FILTER (WHERE role IN ('user', 'system')) AS gu
  FROM conversations GROUP BY conv_id
), blocked AS (
  SELECT c.conv_id,
         bool_or(c.role = 'assistant' AND (c.conv_id + c.turn) % 3 = 0 AND c.turn > lu.u) AS after_user,
         bool_or(c.role = 'assistant' AND (c.conv_id + c.turn) % 3 = 0) AS anywhere
  FROM conversations c JOIN lu USING (conv_id) GROUP BY c.conv_id
), pick AS (
  SELECT lu.conv_id,
         CASE WHEN lu.conv_id % 37 = 0 THEN NULL
              WHEN lu.conv_id % 5 IN (0, 1) AND NOT b.after_user THEN (SELECT text FROM conversations x
                   WHERE x.conv_id = lu.conv_id AND x.turn = lu.u AND x.role = 'user')
              WHEN lu.conv_id % 5 = 2 AND NOT b.anywhere THEN (SELECT text FROM conversations x
                   WHERE x.conv_id = lu.conv_id AND x.turn = lu.gu AND x.role IN ('user', 'system'))
         END AS t
  FROM lu JOIN blocked b USING (conv_id)
)
SELECT conv_id AS payload_id, CASE WHEN {_TRIM.format(x='t')} = '' THEN NULL ELSE {_TRIM.format(x='t')} END
       AS last_user_text
FROM pick
""")
def last_user_text(spark, sf_dir):
    p = _payloads(spark, sf_dir)
    return p.select("payload_id", PL.last_user_text(F.col("body")).alias("last_user_text"))
