"""P22 ``lookup_rate`` and P23 ``request_cost`` as Catalyst expressions.

Money stays DECIMAL end to end (double sums are order dependent). Casts are
placed so no intermediate exceeds precision 38, which would make Spark drop
scale and round.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

RATE = "decimal(12,6)"
MULT = "decimal(6,2)"
COST = "decimal(38,14)"

# Static fallback price table, USD per 1M tokens, first match
# wins. Columns: provider substrings (any), model substrings (any; empty =
# every model), input rate, output rate. Both names are lower-cased first.
RATE_RULES = [
    (("openai",), ("o1-mini",), "15.00", "60.00"),
    (("openai",), ("o1",), "15.00", "60.00"),
    (("openai",), ("gpt-4o-mini",), "0.15", "0.60"),
    (("openai",), ("gpt-4o", "gpt-4-turbo"), "5.00", "15.00"),
    (("anthropic",), ("claude-3-5-sonnet", "claude-3.5-sonnet"), "3.00", "15.00"),
    (("anthropic",), ("claude-3-opus",), "15.00", "75.00"),
    (("anthropic",), ("claude-3-haiku",), "0.25", "1.25"),
    (("google", "gemini"), ("gemini-1.5-pro",), "3.50", "10.50"),
    (("google", "gemini"), ("gemini-1.5-flash", "gemini-flash"), "0.075", "0.30"),
    (("deepseek",), ("deepseek-r1",), "0.55", "2.19"),
    (("deepseek",), (), "0.14", "0.28"),
    (("groq",), (), "0.00", "0.00"),
    ((), ("llama", "mistral", "mixtral", "qwen", "phi", "falcon", "gemma"), "0.50", "1.50"),
]
# Unknown / zero-day models are billed at the ceiling.
CEILING_RATE = ("20.00", "60.00")
# Cache-hit input discounts (standard input rate -> hit rate).
CACHE_HIT_INPUT = (("0.14", "0.014"), ("0.55", "0.14"))


def _any_contains(col: Column, needles: tuple[str, ...]) -> Column:
    if not needles:
        return F.lit(True)
    return reduce(lambda a, b: a | b, [col.contains(n) for n in needles])


def rule_index(provider: Column, model: Column) -> Column:
    """1-based index of the first matching rule; len(RATE_RULES) + 1 = ceiling."""
    p, m = F.lower(provider), F.lower(model)
    expr = F.lit(len(RATE_RULES) + 1)
    for i in range(len(RATE_RULES), 0, -1):
        provs, models, _, _ = RATE_RULES[i - 1]
        expr = F.when(_any_contains(p, provs) & _any_contains(m, models), F.lit(i)).otherwise(expr)
    return expr


def lookup_rate(provider: Column, model: Column) -> Column:
    """Static rate struct ``<in_rate, out_rate>`` for (provider, model).

    The rule chain yields a small integer once; rates come from two literal
    arrays, so the plan carries one compact CASE instead of one per rate."""
    return lookup_rate_by_index(rule_index(provider, model))


def lookup_rate_by_index(idx: Column) -> Column:
    ins = F.array(*[F.lit(r[2]).cast(RATE) for r in RATE_RULES], F.lit(CEILING_RATE[0]).cast(RATE))
    outs = F.array(*[F.lit(r[3]).cast(RATE) for r in RATE_RULES], F.lit(CEILING_RATE[1]).cast(RATE))
    return F.struct(F.element_at(ins, idx).alias("in_rate"), F.element_at(outs, idx).alias("out_rate"))


def effective_input_rate(in_rate: Column, cache_hit: Column) -> Column:
    out = in_rate
    for std, hit in reversed(CACHE_HIT_INPUT):
        out = F.when(cache_hit & (in_rate == F.lit(std).cast(RATE)), F.lit(hit).cast(RATE)).otherwise(out)
    return out


def completion_tokens(total: Column, prompt: Column) -> Column:
    return F.greatest(total - prompt, F.lit(0).cast("bigint"))


def request_cost(prompt: Column, completion: Column, in_rate: Column, out_rate: Column,
                 buffer: Column, mcp_fee: Column, mcp_calls: Column, loop_mult: Column,
                 agent_loops: Column) -> Column:
    """USD cost of one request, exact DECIMAL(38,14)."""
    tok = (prompt.cast("decimal(12,0)") * in_rate.cast(RATE)
           + completion.cast("decimal(12,0)") * out_rate.cast(RATE))
    base = (tok * F.lit("0.000001").cast("decimal(7,6)")
            + buffer.cast(RATE)
            + mcp_fee.cast(RATE) * mcp_calls.cast("decimal(10,0)")).cast("decimal(30,12)")
    looped = F.when(agent_loops > 0, base * loop_mult.cast(MULT)).otherwise(base)
    return looped.cast(COST)
