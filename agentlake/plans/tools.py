"""Queries: tool registry, endpoints and policy joins (S6, S7, J7–J9, T-7, T-8, A19).

Registry, endpoint map and policy are operator configuration (bounded, so
broadcast); the calls side is the request tool-call table (X1).
"""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from agentlake.operators import payloads as PL
from agentlake.operators.dims import bounded
from agentlake.plans.payloads import _EXPECTED_CALLS
from agentlake.plans.registry import query
from agentlake.sources import dimensions as D
from agentlake.sources import payloads as SP

# Fixed values (ours): the tool registry document (JSON array of descriptors).
TOOL_REGISTRY = [
    {"name": "tool_0", "summary": "Look up a conversation turn",
     "schema": {"type": "object", "title": "Lookup", "description": "Find a turn",
                "properties": {"turn": {"type": "integer", "description": "Turn number"},
                               "conv": {"type": "integer", "examples": [1, 2]}}}},
    {"name": "tool_1", "summary": "Summarise a conversation",
     "schema": {"type": "object", "properties": {"conv": {"type": "integer", "title": "Conversation"}}}},
    {"name": "tool_2", "summary": "Charge a card"},
]
# Fixed values (ours): tool -> endpoint URL (several tools per URL); tool_3 has none.
TOOL_ENDPOINTS = {"tool_0": "http://mcp-a:7000", "tool_1": "http://mcp-a:7000", "tool_2": "http://mcp-b:7000"}
# Fixed values (ours): per-tenant allow rows; absent rows are undecided.
POLICY = ([(f"t-{i}", "tool_0", True) for i in range(8)] + [(f"t-{i}", "tool_1", True) for i in range(8)]
          + [(f"t-{i}", "tool_2", i != 1) for i in range(8)])
FAIL_OPEN = False


def registry_df(spark):
    doc = spark.range(1).select(F.lit(json.dumps(TOOL_REGISTRY)).alias("doc"))
    parsed = F.from_json("doc", "array<struct<name:string, summary:string, schema:string>>")
    # (a descriptor without "schema" parses to NULL there)
    return bounded(doc.select(F.explode(parsed).alias("t")).select("t.*"))


def endpoints_df(spark):
    doc = spark.range(1).select(F.lit(json.dumps(TOOL_ENDPOINTS)).alias("doc"))
    return bounded(doc.select(F.explode(F.from_json("doc", "map<string,string>")).alias("tool_name", "url")))


def _calls(spark, sf_dir):
    p = SP.payloads(spark, sf_dir)
    return PL.request_tool_calls(p, keep=("tenant_id",))


_REG = ("(SELECT * FROM (VALUES " + ", ".join(f"('{t['name']}', '{t['summary']}')" for t in TOOL_REGISTRY)
        + ") AS r(name, summary))")
_EP = ("(SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in TOOL_ENDPOINTS.items())
       + ") AS e(tool_name, url))")
_POL = ("(SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', {str(c).upper()})" for a, b, c in POLICY)
        + ") AS p(tenant_id, tool_name, allow))")
_CALLS = f"(SELECT *, 't-' || (payload_id % 8) AS tenant_id FROM ({_EXPECTED_CALLS}))"


@query("tool_registry", sql=f"""
SELECT r.name, r.summary, count(c.payload_id) AS calls FROM {_REG} r LEFT JOIN {_CALLS} c ON c.tool_name = r.name
GROUP BY ALL
""")
def tool_registry(spark, sf_dir):
    """The registry document parsed (bad JSON -> empty) and joined to traffic."""
    reg = registry_df(spark)
    calls = _calls(spark, sf_dir).groupBy("tool_name").agg(F.count(F.lit(1)).alias("calls"))
    return (reg.join(calls, reg["name"] == calls["tool_name"], "left")
            .select("name", "summary", F.coalesce("calls", F.lit(0)).cast("bigint").alias("calls")))


@query("tool_endpoints", sql=f"""
SELECT e.tool_name, e.url, count(c.payload_id) AS calls FROM {_EP} e LEFT JOIN {_CALLS} c USING (tool_name)
GROUP BY ALL
""")
def tool_endpoints(spark, sf_dir):
    ep = endpoints_df(spark)
    calls = _calls(spark, sf_dir).groupBy("tool_name").agg(F.count(F.lit(1)).alias("calls"))
    return (ep.join(calls, "tool_name", "left")
            .select("tool_name", "url", F.coalesce("calls", F.lit(0)).cast("bigint").alias("calls")))


@query("registered_tools", sql=f"""
SELECT DISTINCT payload_id FROM {_CALLS} WHERE tool_name IN (SELECT name FROM {_REG})
""")
def registered_tools(spark, sf_dir):
    """Requests that mention at least one registered tool (left semi)."""
    reg = registry_df(spark).select(F.col("name").alias("tool_name"))
    return _calls(spark, sf_dir).join(reg, "tool_name", "left_semi").select("payload_id").distinct()


@query("unregistered_calls", sql=f"""
SELECT payload_id, call_index, tool_name, 'unknown' AS outcome FROM {_CALLS}
WHERE tool_name NOT IN (SELECT tool_name FROM {_EP})
""")
def unregistered_calls(spark, sf_dir):
    """Calls without an endpoint end 'not configured' -> Unknown (left anti)."""
    from agentlake.functions.classify import classify_outcome
    c = _calls(spark, sf_dir).join(endpoints_df(spark).select("tool_name"), "tool_name", "left_anti")
    return c.select("payload_id", "call_index", "tool_name",
                    classify_outcome(F.lit(False), F.lit("tool not configured")).alias("outcome"))


@query("policy_check", sql=f"""
SELECT c.payload_id,
       bool_or(NOT coalesce(p.allow, {str(FAIL_OPEN).upper()})) AS denied,
       count(*) AS calls
FROM {_CALLS} c LEFT JOIN {_POL} p ON p.tenant_id = c.tenant_id AND p.tool_name = c.tool_name
GROUP BY c.payload_id
""")
def policy_check(spark, sf_dir):
    """One denied (or undecided, when failing closed) tool denies the whole response."""
    pol = bounded(D.to_df(spark, POLICY, ["tenant_id", "tool_name", "allow"], ["string", "string", "boolean"]))
    c = _calls(spark, sf_dir).withColumn("tool_name", F.coalesce("tool_name", F.lit("unknown_tool")))
    j = c.join(pol, ["tenant_id", "tool_name"], "left")
    return j.groupBy("payload_id").agg(F.bool_or(~F.coalesce("allow", F.lit(FAIL_OPEN))).alias("denied"),
                                       F.count(F.lit(1)).alias("calls"))


@query("tools_intersect", sql=f"""
SELECT tool_name FROM {_CALLS} INTERSECT SELECT name FROM {_REG}
""")
def tools_intersect(spark, sf_dir):
    reg = registry_df(spark).select(F.col("name").alias("tool_name"))
    return _calls(spark, sf_dir).select("tool_name").intersect(reg)


@query("tools_except", sql=f"""
SELECT tool_name FROM {_CALLS} EXCEPT ALL SELECT name FROM {_REG}
""")
def tools_except(spark, sf_dir):
    reg = registry_df(spark).select(F.col("name").alias("tool_name"))
    return _calls(spark, sf_dir).select("tool_name").exceptAll(reg)


@query("endpoint_fanin", sql=f"""
SELECT e.url, count(DISTINCT e.tool_name) AS tools, count(c.payload_id) AS calls
FROM {_EP} e LEFT JOIN {_CALLS} c USING (tool_name) GROUP BY e.url
""")
def endpoint_fanin(spark, sf_dir):
    ep = endpoints_df(spark)
    calls = _calls(spark, sf_dir).groupBy("tool_name").agg(F.count("payload_id").alias("n"))
    return (ep.join(calls, "tool_name", "left").groupBy("url")
            .agg(F.countDistinct("tool_name").alias("tools"), F.coalesce(F.sum("n"), F.lit(0).cast("bigint")).alias("calls")))
