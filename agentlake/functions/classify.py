"""Classification expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tool-name prefixes treated as reads, and words that mark a
# mutation anywhere in the name (a mutation word wins over a read prefix).
READ_PREFIXES = ["get", "list", "read", "describe", "search", "query", "select", "show"]
MUTATION_WORDS = ["create", "charge", "pay", "update", "delete", "mutate", "insert", "transfer"]
# Result substrings that mean the outcome is unknown (case-sensitive).
UNKNOWN_MARKERS = ["MCP_TIMEOUT", "unreachable", "not configured", "timed out", "timeout"]
# Upstream HTTP statuses that trigger failover and open the breaker.
RETRYABLE_STATUS = [401, 403, 404, 408, 429, 500, 502, 503, 504]
# Quoted literals that mark an error chunk in a stream.
ERROR_SIGNATURES = ['"error"', '"rate_limit"', '"insufficient_funds"', '"billing_limit"']
# Model-name prefix -> family default model.
FAMILY_DEFAULTS = [
    (("gpt-",), "gpt-4o"),
    (("claude-",), "claude-3-5-sonnet"),
    (("gemini-",), "gemini-1.5-pro"),
    (("deepseek-",), "deepseek-r1"),
    (("cohere-", "command-"), "cohere-command-r"),
    (("llama-",), "llama-3.3-70b-versatile"),
]
# API key prefixes (live/test keys of the two key families).
KEY_PREFIXES = ["ke_live_", "ke_test_", "re_live_", "re_test_"]
# Prompt-injection phrases (matched case-insensitively).
INJECTION_PHRASES = ["ignore previous instructions", "you are now acting as", "jailbreak",
                     "system prompt bypass"]


def _any(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, cols)


def is_read_only(tool: Column) -> Column:
    low = F.lower(tool)
    return _any([low.startswith(p) for p in READ_PREFIXES]) & ~_any([low.contains(w) for w in MUTATION_WORDS])


def tool_policy(tool: Column) -> Column:
    ro = is_read_only(tool)
    return F.struct(
        F.when(ro, "safe").otherwise("unsafe").alias("retry_policy"),
        F.when(ro, "read_only").otherwise("irreversible").alias("side_effect_class"),
        F.when(ro, "none").otherwise("required").alias("idempotency_requirement"),
        F.lit(5).alias("timeout_seconds"),
    )


def is_unknown_content(content: Column) -> Column:
    return _any([content.contains(m) for m in UNKNOWN_MARKERS])


def classify_outcome(success: Column, content: Column) -> Column:
    return (F.when(success, "succeeded").when(is_unknown_content(content), "unknown")
            .otherwise("failed"))


def error_category(content: Column) -> Column:
    return F.when(content.contains("TIMEOUT"), "timeout").otherwise("execution_error")


def is_retryable_status(status: Column) -> Column:
    return status.isin(*RETRYABLE_STATUS)


def has_error_signature(chunk: Column) -> Column:
    return _any([chunk.contains(s) for s in ERROR_SIGNATURES])


def family_default(model: Column) -> Column:
    m = F.lower(F.trim(model))
    out = F.lit(None).cast("string")
    for prefixes, default in reversed(FAMILY_DEFAULTS):
        out = F.when(_any([m.startswith(p) for p in prefixes]), F.lit(default)).otherwise(out)
    return out


def provider_format(provider: Column) -> Column:
    p = F.lower(provider)
    return (F.when(p == "anthropic", "anthropic")
            .when(p.isin("gemini", "google"), "gemini")
            .when(p == "cohere", "cohere")
            .otherwise("openai"))


def key_class(key: Column) -> Column:
    out = F.lit("unknown")
    for p in reversed(KEY_PREFIXES):
        out = F.when(key.startswith(p), F.lit(p.rstrip("_"))).otherwise(out)
    return out


def injection_flag(text: Column) -> Column:
    return F.lower(text).rlike("|".join(INJECTION_PHRASES))
