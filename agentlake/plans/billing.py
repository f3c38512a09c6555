"""Queries: pricing, cost and token metering."""

from __future__ import annotations

from pyspark.sql import functions as F

from agentlake.functions import pricing as P
from agentlake.operators import billing as B
from agentlake.plans import oracle_views as OV
from agentlake.plans.registry import query
from agentlake.sources import dimensions as D
from agentlake.sources import views as V
from agentlake.sources.tables import memo


@memo
def priced_requests(spark, sf_dir):
    return B.price(V.requests(spark, sf_dir), D.pricing_df(spark))


@query("billing_breakdown", bench=True, sql="""
SELECT tenant_id, model, count(*) AS requests,
       CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens,
       CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens,
       CAST(sum(cost_usd) AS DECIMAL(38,14)) AS cost_usd,
       count(*) FILTER (WHERE cache_hit) AS cache_hits,
       count(*) FILTER (WHERE is_hot_swapped) AS hot_swaps
FROM v_priced GROUP BY tenant_id, model
""")
def billing_breakdown(spark, sf_dir):
    return B.billing_breakdown(priced_requests(spark, sf_dir), ["tenant_id", "model"])


@query("lookup_rate", sql="""
SELECT requested_provider, model, in_rate, out_rate, count(*) AS requests
FROM (SELECT requested_provider, model,
             CAST(({in_}) AS DECIMAL(12,6)) AS in_rate, CAST(({out}) AS DECIMAL(12,6)) AS out_rate
      FROM v_requests) GROUP BY ALL
""".format(in_=OV.rate_case(OV.RATE_CASE_IN, "requested_provider", "model"),
           out=OV.rate_case(OV.RATE_CASE_OUT, "requested_provider", "model")))
def lookup_rate(spark, sf_dir):
    r = V.requests(spark, sf_dir)
    rate = P.lookup_rate(F.col("requested_provider"), F.col("model"))
    return (r.select("requested_provider", "model", rate["in_rate"].alias("in_rate"),
                     rate["out_rate"].alias("out_rate"))
            .groupBy("requested_provider", "model", "in_rate", "out_rate")
            .agg(F.count(F.lit(1)).alias("requests")))


@query("request_cost", sql="""
SELECT event_id, in_eff AS in_rate, out_rate, completion_tokens, cost_usd FROM v_priced
""")
def request_cost(spark, sf_dir):
    return priced_requests(spark, sf_dir).select(
        "event_id", F.col("in_eff").alias("in_rate"), "out_rate", "completion_tokens", "cost_usd")


@query("estimate_tokens", sql="""
SELECT doc_id, CAST(greatest(1, octet_length(encode(text)) // 4) AS BIGINT) AS prompt_est,
       CAST(octet_length(encode(text)) AS BIGINT) AS n_bytes
FROM documents
""")
def estimate_tokens(spark, sf_dir):
    from agentlake.functions.tokens import estimate_prompt_tokens
    from agentlake.sources.tables import read
    d = read(spark, sf_dir, "documents")
    return d.select("doc_id", estimate_prompt_tokens(F.col("text")).alias("prompt_est"),
                    F.octet_length("text").cast("bigint").alias("n_bytes"))
