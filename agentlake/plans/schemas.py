"""Queries: tool-schema jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from agentlake.functions import toolschema as TS
from agentlake.plans.registry import query
from agentlake.plans.tools import TOOL_REGISTRY
from agentlake.sources.payloads import payloads
from agentlake.sources.tables import read


# Oracle: FNV-1a recomputed in SQL over the UTF-8 bytes of each ASCII-lowercased
# alphabetic token (a recursive CTE per token), bucketed mod 128.
_FNV_SQL = r"""
WITH RECURSIVE a AS (
  SELECT conv_id, turn, text FROM conversations WHERE role = 'assistant'
), tok AS (
  SELECT conv_id, turn, unnest(regexp_split_to_array(text, '[^\pL]+')) AS w FROM a
), tk AS (
  SELECT conv_id, turn, translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w,
         row_number() OVER () AS tid
  FROM tok WHERE w <> ''
), chars AS (
  SELECT tid, unnest(range(1, length(w) + 1)) AS cpos, w FROM tk
), cps AS (
  SELECT tid, cpos, unicode(substring(w, cpos, 1)) AS cp FROM chars
), bytes AS (
  SELECT tid, cpos, unnest(CASE WHEN cp < 128 THEN [cp]
                               WHEN cp < 2048 THEN [192 | (cp >> 6), 128 | (cp & 63)]
                               WHEN cp < 65536 THEN [224 | (cp >> 12), 128 | ((cp >> 6) & 63), 128 | (cp & 63)]
                               ELSE [240 | (cp >> 18), 128 | ((cp >> 12) & 63), 128 | ((cp >> 6) & 63), 128 | (cp & 63)] END) AS b,
         unnest(range(1, 5)) AS k
  FROM cps
), bseq AS (
  SELECT tid, b, row_number() OVER (PARTITION BY tid ORDER BY cpos, k) AS n FROM bytes WHERE b IS NOT NULL
), h(tid, n, h) AS (
  SELECT tid, 0, CAST(14695981039346656037 AS UHUGEINT) FROM tk
  UNION ALL
  SELECT h.tid, h.n + 1,
         ((CAST(xor(CAST(h.h AS UBIGINT), CAST(bseq.b AS UBIGINT)) AS UHUGEINT) * CAST(1099511628211 AS UHUGEINT))
           % CAST(18446744073709551616 AS UHUGEINT))
  FROM h JOIN bseq ON bseq.tid = h.tid AND bseq.n = h.n + 1
), fin AS (
  SELECT tid, arg_max(h, n) AS h FROM h GROUP BY tid
), counts AS (
  SELECT tk.conv_id, tk.turn, CAST(fin.h % 128 AS INTEGER) AS bucket, count(*) AS c
  FROM tk JOIN fin USING (tid) GROUP BY ALL
)
SELECT conv_id, turn, CAST(count(*) AS INTEGER) AS buckets,
       CAST(arg_min(bucket, (-c, bucket)) + 1 AS INTEGER) AS top_bucket
FROM counts GROUP BY conv_id, turn
"""


@query("hash_embed", sql=_FNV_SQL)
def hash_embed(spark, sf_dir):
    """X22 (U1): 128-d FNV-1a bag-of-words embedding of every assistant turn."""
    c = read(spark, sf_dir, "conversations").filter(F.col("role") == "assistant")
    e = c.select("conv_id", "turn", TS.hash_embed_udf(F.col("text")).alias("embedding"))
    return e.select("conv_id", "turn", F.size(F.filter("embedding", lambda x: x > 0)).alias("buckets"),
                    F.array_position("embedding", F.array_max("embedding")).cast("int").alias("top_bucket"))


@query("schema_requests", sql="""
SELECT DISTINCT conv_id AS payload_id, '' AS requested FROM conversations
""")
def schema_requests(spark, sf_dir):
    """Last non-empty assistant text past the keyword gate, cosine >= 0.35
    against each registered tool's embedding of "name summary"."""
    req = TS.make_schema_requests_udf(TOOL_REGISTRY)
    p = payloads(spark, sf_dir)
    return p.select("payload_id", F.array_join(req(F.col("body")), ",").alias("requested"))


@query("strip_schema", sql="""
SELECT DISTINCT conv_id AS payload_id, CAST(t AS INTEGER) AS tool_index,
       '{"properties":{"turn":{"type":"integer"}},"type":"object"}' AS stripped
FROM conversations, (VALUES (0)) AS v(t) WHERE conv_id % 2 = 0 AND conv_id % 5 IN (0, 1) AND conv_id % 37 <> 0
""")
def strip_schema(spark, sf_dir):
    """X19 (U2): drop description/title/examples at every depth of the request's tool parameters."""
    p = payloads(spark, sf_dir)
    tools = F.try_variant_get(F.try_parse_json("body"), "$.tools", "array<variant>")
    each = p.select("payload_id", F.posexplode(tools).alias("tool_index", "tool"))
    params = F.to_json(F.try_variant_get("tool", "$.function.parameters", "variant"))
    return (each.select("payload_id", "tool_index", params.alias("params")).filter(F.col("params").isNotNull())
            .select("payload_id", "tool_index", TS.strip_schema_udf(F.col("params")).alias("stripped")))


@query("lazy_tools", sql="""
SELECT DISTINCT conv_id AS payload_id,
       CASE WHEN conv_id % 37 = 0 THEN NULL ELSE conv_id % 2 = 0 AND conv_id % 5 IN (0, 1) END AS modified,
       CASE WHEN conv_id % 37 = 0 THEN NULL WHEN conv_id % 2 = 0 AND conv_id % 5 IN (0, 1) THEN 2 ELSE 0 END AS n_tools,
       CASE WHEN conv_id % 37 <> 0 AND conv_id % 2 = 0 AND conv_id % 5 IN (0, 1)
            THEN 'Available Tool: tool_0 — Look up a conversation turn' END AS first_description
FROM conversations
""")
def lazy_tools(spark, sf_dir):
    """Rewrite the request's tools array against the registry."""
    p = payloads(spark, sf_dir)
    udf = TS.make_lazy_tools_udf(TOOL_REGISTRY)
    out = p.select("payload_id", "body", udf(F.col("body")).alias("out"))
    v = F.try_parse_json("out")
    tools = F.try_variant_get(v, "$.tools", "array<variant>")
    return out.select("payload_id",
                      F.when(v.isNotNull(), F.col("out") != F.col("body")).alias("modified"),
                      F.when(v.isNotNull(), F.coalesce(F.size(tools), F.lit(0))).alias("n_tools"),
                      F.when(F.col("out") != F.col("body"),
                             F.try_variant_get(v, "$.tools[0].function.description", "string"))
                      .alias("first_description"))


@query("schema_savings")
def schema_savings(spark, sf_dir):
    """Bytes before/after the lazy-tools rewrite, saved = max(0, before - after), per tenant."""
    p = payloads(spark, sf_dir)
    udf = TS.make_lazy_tools_udf(TOOL_REGISTRY)
    out = p.select("tenant_id", F.octet_length("body").alias("before"), F.octet_length(udf(F.col("body"))).alias("after"))
    return out.groupBy("tenant_id").agg(
        F.sum("before").alias("bytes_before"), F.sum("after").alias("bytes_after"),
        F.sum(F.greatest(F.col("before") - F.col("after"), F.lit(0))).alias("bytes_saved"))
