"""Pricing and cost of requests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agentlake.functions import pricing as P
from agentlake.operators.dims import bounded
from agentlake.sources import dimensions as D


def price(requests: DataFrame, pricing: DataFrame, provider_col: str = "requested_provider",
          model_col: str = "model", target_col: str | None = None) -> DataFrame:
    """Attach rates and ``cost_usd``.

    Rate resolution: dynamic map by target model, else by virtual model, else
    the static table on (provider, target model).
    """
    pm = bounded(pricing)
    df = requests
    lookup_model = F.col(target_col) if target_col else F.col(model_col)
    tgt = pm.select(*[F.col(c).alias(f"_t_{c}") for c in D.PRICING_COLS])
    df = df.join(tgt, lookup_model == F.col("_t_model"), "left")
    if target_col:
        vir = pm.select(*[F.col(c).alias(f"_v_{c}") for c in D.PRICING_COLS])
        df = df.join(vir, F.col(model_col) == F.col("_v_model"), "left")

        def pick(c):
            return F.coalesce(F.col(f"_t_{c}"), F.col(f"_v_{c}"))
    else:
        def pick(c):
            return F.col(f"_t_{c}")
    df = df.withColumn("_rule", P.rule_index(F.col(provider_col), lookup_model))
    static = P.lookup_rate_by_index(F.col("_rule"))
    in_rate = F.coalesce(pick("in_rate"), static["in_rate"])
    out_rate = F.coalesce(pick("out_rate"), static["out_rate"])
    df = df.withColumns({
        "in_rate": in_rate,
        "out_rate": out_rate,
        "buffer": F.coalesce(pick("buffer"), F.lit(0).cast(P.RATE)),
        "mcp_fee": F.coalesce(pick("mcp_fee"), F.lit(0).cast(P.RATE)),
        "loop_mult": F.coalesce(pick("loop_mult"), F.lit(1).cast(P.MULT)),
    })
    df = df.drop("_rule", *[c for c in df.columns if c.startswith("_t_") or c.startswith("_v_")])
    df = df.withColumn("completion_tokens", P.completion_tokens(F.col("total_tokens"), F.col("prompt_tokens")))
    df = df.withColumn("in_eff", P.effective_input_rate(F.col("in_rate"), F.col("cache_hit")))
    return df.withColumn("cost_usd", P.request_cost(
        F.col("prompt_tokens"), F.col("completion_tokens"), F.col("in_eff"), F.col("out_rate"),
        F.col("buffer"), F.col("mcp_fee"), F.col("mcp_calls"), F.col("loop_mult"), F.col("agent_loops")))


def billing_breakdown(priced: DataFrame, keys: list[str]) -> DataFrame:
    """Cost and tokens by the given keys, with cache and hot-swap columns.

    Partial aggregation happens map-side; only one row per key and partition
    crosses the shuffle, so a hot tenant costs no more than a cold one.
    """
    return priced.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("requests"),
        F.sum("prompt_tokens").alias("prompt_tokens"),
        F.sum("completion_tokens").alias("completion_tokens"),
        F.sum("cost_usd").cast(P.COST).alias("cost_usd"),
        F.count_if(F.col("cache_hit")).alias("cache_hits"),
        F.count_if(F.col("is_hot_swapped")).alias("hot_swaps"),
    )
