"""Queries: provider response parsing (X3a–e, X7, P24)."""

from __future__ import annotations

from pyspark.sql import functions as F

from agentlake.operators import responses as RS
from agentlake.plans.registry import query
from agentlake.sources.responses import responses

_FMT = {"openai": 0, "anthropic": 1, "gemini": 2, "cohere": 3, "bedrock": 4}


def _calls_sql(provider: str) -> str:
    f = _FMT[provider]
    cid = ("'call_' || conv_id || '_' || turn" if provider in ("openai", "anthropic", "bedrock")
           else "'tool_' || (turn % 4)")
    broken_kept = "true" if provider == "cohere" else "(conv_id * 10 + turn) % 13 <> 0"
    return f"""
SELECT conv_id * 10 + turn AS response_id, CAST(0 AS INTEGER) AS call_index, {cid} AS call_id,
       'tool_' || (turn % 4) AS tool_name, '{{"conv":' || conv_id || ',"turn":' || turn || '}}' AS arguments
FROM conversations
WHERE role = 'assistant' AND (conv_id + turn) % 3 = 0 AND conv_id % 5 = {f} AND {broken_kept}
"""


def _make(provider: str):
    def build(spark, sf_dir):
        r = responses(spark, sf_dir).filter(F.col("provider") == provider)
        return RS.response_tool_calls(r, provider)
    build.__name__ = f"calls_{provider}"
    build.__doc__ = f"X3: tool calls of {provider}-shaped responses (one broken call voids the response)."
    return build


for _p in _FMT:
    query(f"calls_{_p}", sql=_calls_sql(_p))(_make(_p))


_WORDS = "CAST(len(string_split(text, ' ')) AS BIGINT)"


@query("unify_response", sql=f"""
WITH r AS (
  SELECT conv_id * 10 + turn AS response_id, conv_id % 5 AS fmt, CAST(to_json(text) AS VARCHAR) AS j, (conv_id + turn) % 3 = 0 AS has_call,
         'call_' || conv_id || '_' || turn AS cid, 'tool_' || (turn % 4) AS tool, '{{"conv":' || conv_id || ',"turn":' || turn || '}}' AS args,
         CAST(10 + turn AS BIGINT) AS p, {_WORDS} AS n
  FROM conversations WHERE role = 'assistant'
)
SELECT response_id, fmt IN (1, 2) AS rewritten,
  CASE fmt
    WHEN 1 THEN '{{"id":"resp-' || response_id || '","object":"chat.completion","created":0,"model":"claude-3-5-sonnet","choices":[{{"index":0,"message":{{"role":"assistant","content":'
      || j || CASE WHEN has_call THEN ',"tool_calls":[{{"id":"' || cid || '","type":"function","function":{{"name":"' || tool || '","arguments":' || CAST(to_json(args) AS VARCHAR) || '}}}}]' ELSE '' END
      || '}},"finish_reason":"' || CASE WHEN has_call THEN 'tool_calls' ELSE 'stop' END || '"}}],"usage":{{"prompt_tokens":' || p || ',"completion_tokens":' || n || ',"total_tokens":' || (p + n) || '}}}}'
    WHEN 2 THEN '{{"id":"chatcmpl-gemini","object":"chat.completion","created":0,"model":"gemini","choices":[{{"index":0,"message":{{"role":"assistant","content":' || j
      || '}},"finish_reason":"stop"}}],"usage":{{"prompt_tokens":0,"completion_tokens":0,"total_tokens":0}}}}' END AS payload
FROM r
""")
def unify_response(spark, sf_dir):
    r = responses(spark, sf_dir)
    u = RS.unify_response(F.col("body"), F.col("provider"))
    return r.select("response_id", (u != F.col("body")).alias("rewritten"), F.when(u != F.col("body"), u).alias("payload"))


@query("response_content", sql="""
SELECT conv_id * 10 + turn AS response_id, conv_id % 5 = 0 AS from_message,
       CASE WHEN conv_id % 5 = 0 THEN text END AS content
FROM conversations WHERE role = 'assistant'
""")
def response_content(spark, sf_dir):
    r = responses(spark, sf_dir)
    c = RS.response_content(F.col("body"))
    return r.select("response_id", (c != F.col("body")).alias("from_message"),
                    F.when(c != F.col("body"), c).alias("content"))
