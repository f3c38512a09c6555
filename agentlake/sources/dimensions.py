"""Static configuration dimensions (FIXTURES.md §C9).

These are gateway *configuration* — routing maps, price overrides, budgets,
tool registry, policies — whose size is bounded by what an operator types in,
not by traffic. That bound is what makes them safe to broadcast; every join
against them still goes through :func:`agentlake.operators.joins.small_side`
which checks the row count before hinting a broadcast.

The same rows are rendered as DuckDB ``VALUES`` for the oracle, so both
engines read identical inputs.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

ZERO_TENANT = "00000000-0000-0000-0000-000000000000"

# Routing config: tenant -> virtual model -> rate limit and ordered targets.
# Target tuple: (priority, weight, provider_name, api_key_alias, target_model,
# schema_format). Weight is carried but, as in the gateway, not used.
ROUTING = {
    ZERO_TENANT: {
        "gpt-4o": {"rate_limit_rpm": 120, "targets": [
            (1, 100, "openai", "oa-main", "gpt-4o", "openai"),
            (2, 100, "anthropic", "an-main", "claude-3-5-sonnet", "anthropic")]},
        "claude-3-5-sonnet": {"rate_limit_rpm": None, "targets": [
            (1, 100, "anthropic", "an-main", "claude-3-5-sonnet", "anthropic")]},
        "gemini-1.5-pro": {"rate_limit_rpm": None, "targets": [
            (1, 100, "gemini", "gm-main", "gemini-1.5-pro", "gemini"),
            (2, 50, "openai", "oa-main", "gpt-4o", "openai")]},
        "deepseek-r1": {"rate_limit_rpm": 30, "targets": [
            (1, 100, "deepseek", "ds-main", "deepseek-r1", "openai")]},
        "llama-3.3-70b-versatile": {"rate_limit_rpm": 0, "targets": [
            (1, 100, "groq", "gq-main", "llama-3.3-70b-versatile", "openai")]},
        "cohere-command-r": {"rate_limit_rpm": None, "targets": []},
    },
    "t-1": {
        "gpt-4o": {"rate_limit_rpm": 1, "targets": [
            (2, 100, "openai", "oa-t1", "gpt-4o", "openai"),
            (1, 100, "openai", "oa-t1b", "gpt-4o-2024-08-06", "openai")]},
        "claude-3-5-sonnet": {"rate_limit_rpm": None, "targets": []},
    },
    "t-2": {
        "claude-3-5-sonnet": {"rate_limit_rpm": 2, "targets": [
            (1, 100, "anthropic", "an-t2", "claude-3-5-sonnet-20241022", "anthropic")]},
    },
    "t-3": {
        "gpt-4o": {"rate_limit_rpm": None, "targets": [
            (1, 100, "openai", "oa-t3", "gpt-4o", "openai"),
            (1, 100, "anthropic", "an-t3", "claude-3-5-sonnet", "anthropic")]},
    },
}

# Dynamic price overrides keyed by model (checked before the static table).
# (model, pricing_type, in_rate, out_rate, per_request_buffer, mcp_flat_fee, agent_loop_multiplier)
PRICING_MAP = [
    ("gpt-4o", "hybrid", "5.000000", "15.000000", "0.001000", "0.000500", "1.50"),
    ("claude-3-5-sonnet", "token_based", "3.000000", "15.000000", "0.000000", "0.000200", "1.25"),
    ("gpt-4o-2024-08-06", "token_based", "2.500000", "10.000000", "0.000000", "0.000000", "1.00"),
]
PRICING_COLS = ["model", "pricing_type", "in_rate", "out_rate", "buffer", "mcp_fee", "loop_mult"]
PRICING_TYPES = ["string", "string", "decimal(12,6)", "decimal(12,6)", "decimal(12,6)",
                 "decimal(12,6)", "decimal(6,2)"]


def routing_json() -> str:
    """The routing config as the JSON document the gateway loads."""
    doc = {}
    for tenant, models in ROUTING.items():
        doc[tenant] = {}
        for model, cfg in models.items():
            doc[tenant][model] = {
                "rate_limit_rpm": cfg["rate_limit_rpm"],
                "targets": [dict(zip(["priority", "weight", "provider_name", "api_key_alias",
                                      "target_model", "schema_format"], t)) for t in cfg["targets"]],
            }
    return json.dumps(doc, sort_keys=True)


def routing_rows() -> list[tuple]:
    """Flat routing rows; a model without targets yields one row with NULL target."""
    rows = []
    for tenant, models in ROUTING.items():
        for model, cfg in models.items():
            if not cfg["targets"]:
                rows.append((tenant, model, cfg["rate_limit_rpm"], None, None, None, None, None, None, None))
            for pos, t in enumerate(cfg["targets"]):
                rows.append((tenant, model, cfg["rate_limit_rpm"], pos) + tuple(t))
    return rows


ROUTING_COLS = ["tenant_id", "model", "rate_limit_rpm", "position", "priority", "weight",
                "provider_name", "key_alias", "target_model", "schema_format"]
ROUTING_TYPES = ["string", "string", "int", "int", "int", "int", "string", "string", "string", "string"]


def _sql_lit(v, t: str) -> str:
    if v is None:
        return f"CAST(NULL AS {duck_type(t)})"
    if t == "string":
        return "'" + str(v).replace("'", "''") + "'"
    if t == "boolean":
        return "TRUE" if v else "FALSE"
    return f"CAST({v!s} AS {duck_type(t)})" if t.startswith("decimal") else str(v)


def duck_type(t: str) -> str:
    return {"string": "VARCHAR", "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE",
            "boolean": "BOOLEAN"}.get(t, t.upper())


def values_sql(rows: list[tuple], cols: list[str], types: list[str]) -> str:
    """DuckDB ``SELECT`` over a VALUES list with explicit column types."""
    body = ",\n    ".join("(" + ", ".join(_sql_lit(v, t) for v, t in zip(r, types)) + ")" for r in rows)
    casts = ", ".join(f"CAST({c} AS {duck_type(t)}) AS {c}" for c, t in zip(cols, types))
    return f"SELECT {casts} FROM (VALUES\n    {body}) AS v({', '.join(cols)})"


def to_df(spark: SparkSession, rows: list[tuple], cols: list[str], types: list[str]) -> DataFrame:
    """A literal relation built in the JVM (``inline`` of an array of structs):
    no Python worker is involved and Catalyst sees the rows as constants."""
    from pyspark.sql import functions as F

    def lit(v, t):
        return F.lit(None if v is None else str(v)).cast(t)

    structs = [F.struct(*[lit(v, t).alias(c) for v, c, t in zip(r, cols, types)]) for r in rows]
    return spark.range(1).select(F.inline(F.array(*structs)))


def pricing_df(spark: SparkSession) -> DataFrame:
    return to_df(spark, PRICING_MAP, PRICING_COLS, PRICING_TYPES)


def routing_df(spark: SparkSession) -> DataFrame:
    return to_df(spark, routing_rows(), ROUTING_COLS, ROUTING_TYPES)
