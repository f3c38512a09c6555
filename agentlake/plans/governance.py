"""Queries: tenant config, budgets, burn rate, wallet, token bucket, error
taxonomy, cache admission, audit export and alerts (J16, A12–A15, W5, P25,
P26, S9, T-3, X24, X27)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from agentlake.operators.dims import bounded
from agentlake.operators.folds import BucketFold, run_fold
from agentlake.plans.registry import query
from agentlake.sources import dimensions as D
from agentlake.sources import views as V

# Tenant configuration defaults when a tenant has no row.
CONFIG_DEFAULTS = {"pii_masking_enabled": False, "semantic_cache_enabled": True, "routing_fallback_enabled": True,
                   "fallback_timeout_ms": 30000, "semantic_cache_threshold": 0.85, "max_agent_loops": 20,
                   "max_identical_tool_calls": 5, "context_window_budget": 128000, "burn_rate_limit": 10.0}
CONFIG_COLS = ["tenant_id", "pii_masking_enabled", "semantic_cache_enabled", "max_agent_loops",
               "max_identical_tool_calls", "burn_rate_limit", "free_tier"]
CONFIG_TYPES = ["string", "boolean", "boolean", "int", "int", "double", "boolean"]
# Fixed values (ours): configured tenants.
CLIENT_CONFIGS = [("t-1", True, False, 10, 3, 0.002, False), ("t-4", False, True, 40, 8, 1.0, True),
                  ("t-6", True, True, None, None, None, False)]
# Fixed values (ours): scoped budgets (scope_type, scope_id, limit USD, alert_80, alert_100_projected, kill switch).
BUDGETS = [("global", "*", "15.00", True, True, False), ("tenant", "t-1", "1.50", True, True, False),
           ("team", "team-0", "100.00", True, True, False), ("apikey", "key-3", "2.00", True, True, True),
           ("route", "gpt-4o", "50.00", False, True, False)]
BUDGET_COLS = ["scope_type", "scope_id", "limit_usd", "alert_80_enabled", "alert_100_projected_enabled",
               "emergency_kill_switch"]
BUDGET_TYPES = ["string", "string", "decimal(18,2)", "boolean", "boolean", "boolean"]
BUDGET_PERIOD_SEC = 30 * 86400


def _config_df(spark):
    return bounded(D.to_df(spark, CLIENT_CONFIGS, CONFIG_COLS, CONFIG_TYPES))


def _cfg_sql():
    return D.values_sql(CLIENT_CONFIGS, CONFIG_COLS, CONFIG_TYPES)


def effective_config(spark, df):
    """The tenant's config row, defaults where absent (a missing row or a NULL field)."""
    c = df.join(_config_df(spark), "tenant_id", "left")
    for k in ("pii_masking_enabled", "semantic_cache_enabled", "max_agent_loops", "max_identical_tool_calls",
              "burn_rate_limit"):
        c = c.withColumn(k, F.coalesce(F.col(k), F.lit(CONFIG_DEFAULTS[k])))
    return c.withColumn("free_tier", F.coalesce("free_tier", F.lit(False)))


@query("tenant_config", sql=f"""
SELECT r.tenant_id, coalesce(c.pii_masking_enabled, false) AS pii_masking_enabled,
       coalesce(c.semantic_cache_enabled, true) AS semantic_cache_enabled,
       coalesce(c.max_agent_loops, 20) AS max_agent_loops,
       coalesce(c.max_identical_tool_calls, 5) AS max_identical_tool_calls,
       coalesce(c.burn_rate_limit, 10.0) AS burn_rate_limit, count(*) AS requests
FROM v_requests r LEFT JOIN ({_cfg_sql()}) c USING (tenant_id) GROUP BY ALL
""")
def tenant_config(spark, sf_dir):
    r = effective_config(spark, V.requests(spark, sf_dir).select("tenant_id"))
    return r.groupBy("tenant_id", "pii_masking_enabled", "semantic_cache_enabled", "max_agent_loops",
                     "max_identical_tool_calls", "burn_rate_limit").agg(F.count(F.lit(1)).alias("requests"))


def _priced(spark, sf_dir):
    from agentlake.plans.billing import priced_requests
    return priced_requests(spark, sf_dir)


@query("budget_status", sql=f"""
WITH obs AS (SELECT max(sec) - min(sec) + 1 AS observed FROM v_priced),
sp AS (
  SELECT 'global' AS scope_type, '*' AS scope_id, sum(cost_usd) AS spend FROM v_priced
  UNION ALL SELECT 'tenant', tenant_id, sum(cost_usd) FROM v_priced GROUP BY 2
  UNION ALL SELECT 'team', team_id, sum(cost_usd) FROM v_priced GROUP BY 2
  UNION ALL SELECT 'apikey', api_key_alias, sum(cost_usd) FROM v_priced GROUP BY 2
  UNION ALL SELECT 'route', model, sum(cost_usd) FROM v_priced GROUP BY 2
)
SELECT b.scope_type, b.scope_id, CAST(coalesce(sp.spend, 0) AS DECIMAL(38,14)) AS spend,
       b.alert_80_enabled AND coalesce(sp.spend, 0) * 10 >= b.limit_usd * 8 AS alert_80,
       b.alert_100_projected_enabled AND coalesce(sp.spend, 0) * {BUDGET_PERIOD_SEC} >= b.limit_usd * obs.observed
           AS alert_100_projected,
       CASE WHEN b.emergency_kill_switch THEN 'killed' WHEN coalesce(sp.spend, 0) >= b.limit_usd THEN 'exhausted'
            ELSE 'ok' END AS status
FROM ({D.values_sql(BUDGETS, BUDGET_COLS, BUDGET_TYPES)}) b
LEFT JOIN sp ON sp.scope_type = b.scope_type AND sp.scope_id = b.scope_id, obs
""")
def budget_status(spark, sf_dir):
    """Spend per budget scope. Requests are aggregated to (tenant, team,
    key, model) first, so the scope expansion (5 rows per group) runs on a
    table the size of the key space, not of the traffic."""
    p = _priced(spark, sf_dir)
    g = p.groupBy("tenant_id", "team_id", "api_key_alias", "model").agg(
        F.sum("cost_usd").alias("spend"), F.min("sec").alias("lo"), F.max("sec").alias("hi"))
    scopes = g.select(F.explode(F.array(
        F.struct(F.lit("global").alias("scope_type"), F.lit("*").alias("scope_id")),
        F.struct(F.lit("tenant").alias("scope_type"), F.col("tenant_id").alias("scope_id")),
        F.struct(F.lit("team").alias("scope_type"), F.col("team_id").alias("scope_id")),
        F.struct(F.lit("apikey").alias("scope_type"), F.col("api_key_alias").alias("scope_id")),
        F.struct(F.lit("route").alias("scope_type"), F.col("model").alias("scope_id")))).alias("s"), "spend")
    spend = scopes.groupBy("s.scope_type", "s.scope_id").agg(F.sum("spend").alias("spend"))
    observed = g.agg(F.max("hi") - F.min("lo") + 1).scalar()  # scalar subquery, evaluated once
    b = bounded(D.to_df(spark, BUDGETS, BUDGET_COLS, BUDGET_TYPES))
    j = b.join(spend, ["scope_type", "scope_id"], "left").withColumn("observed", observed)
    s = F.coalesce(F.col("spend"), F.lit(0).cast("decimal(38,14)"))
    return j.select(
        "scope_type", "scope_id", s.cast("decimal(38,14)").alias("spend"),
        (F.col("alert_80_enabled") & (s * 10 >= F.col("limit_usd") * 8)).alias("alert_80"),
        (F.col("alert_100_projected_enabled") & (s * BUDGET_PERIOD_SEC >= F.col("limit_usd") * F.col("observed")))
        .alias("alert_100_projected"),
        F.when(F.col("emergency_kill_switch"), "killed").when(s >= F.col("limit_usd"), "exhausted")
        .otherwise("ok").alias("status"))


@query("burn_rate", sql=f"""
SELECT r.session_id, r.sec // 60 AS minute, CAST(sum(cost_usd) AS DECIMAL(38,14)) AS spend,
       sum(cost_usd) > any_value(coalesce(c.burn_rate_limit, 10.0)) AS exceeded
FROM v_priced r LEFT JOIN ({_cfg_sql()}) c USING (tenant_id)
GROUP BY r.session_id, r.sec // 60
""")
def burn_rate(spark, sf_dir):
    """Session spend per minute against the tenant's burn-rate limit."""
    p = effective_config(spark, _priced(spark, sf_dir).select("session_id", "tenant_id", "sec", "cost_usd"))
    return (p.groupBy("session_id", F.floor(F.col("sec") / 60).cast("bigint").alias("minute"))
            .agg(F.sum("cost_usd").cast("decimal(38,14)").alias("spend"),
                 (F.sum("cost_usd") > F.first("burn_rate_limit")).alias("exceeded")))


@query("wallet_balance", sql=f"""
WITH tops AS (
  SELECT 't-' || (user_id % 8) AS tenant_id, CAST((k - 10) AS DECIMAL(18,2)) * CAST(0.01 AS DECIMAL(4,2)) AS amount
  FROM v_requests WHERE event_type = 'purchase'
), t AS (
  SELECT tenant_id, sum(amount) FILTER (WHERE amount > 0) AS topups, count(*) FILTER (WHERE amount <= 0) AS rejected
  FROM tops GROUP BY tenant_id
), s AS (SELECT tenant_id, sum(cost_usd) AS spend, bool_or(in_rate > 0) AS paid FROM v_priced
         WHERE event_type <> 'purchase' GROUP BY tenant_id)
SELECT s.tenant_id, CAST(coalesce(t.topups, 0) AS DECIMAL(38,14)) AS topups, coalesce(t.rejected, 0) AS rejected_topups,
       CAST(s.spend AS DECIMAL(38,14)) AS spend,
       CAST(coalesce(t.topups, 0) - s.spend AS DECIMAL(38,14)) AS balance,
       coalesce(t.topups, 0) - s.spend <= 0 AND s.paid AND NOT coalesce(c.free_tier, false) AS insufficient_funds
FROM s LEFT JOIN t USING (tenant_id) LEFT JOIN ({_cfg_sql()}) c USING (tenant_id)
""")
def wallet_balance(spark, sf_dir):
    """Top-ups (amount <= 0 rejected) minus spend per tenant; free tier exempt."""
    p = _priced(spark, sf_dir)
    tops = (p.filter(F.col("event_type") == "purchase")
            .select("tenant_id", ((F.col("k") - 10).cast("decimal(18,2)") * F.lit("0.01").cast("decimal(4,2)")).alias("amount"))
            .groupBy("tenant_id").agg(F.sum(F.when(F.col("amount") > 0, F.col("amount"))).alias("topups"),
                                      F.count_if(F.col("amount") <= 0).alias("rejected_topups")))
    spend = (p.filter(F.col("event_type") != "purchase").groupBy("tenant_id")
             .agg(F.sum("cost_usd").alias("spend"), F.bool_or(F.col("in_rate") > 0).alias("paid")))
    j = effective_config(spark, spend.join(tops, "tenant_id", "left"))
    top = F.coalesce(F.col("topups"), F.lit(0))
    bal = top - F.col("spend")
    return j.select("tenant_id", top.cast("decimal(38,14)").alias("topups"),
                    F.coalesce("rejected_topups", F.lit(0)).alias("rejected_topups"),
                    F.col("spend").cast("decimal(38,14)").alias("spend"), bal.cast("decimal(38,14)").alias("balance"),
                    ((bal <= 0) & F.col("paid") & ~F.col("free_tier")).alias("insufficient_funds"))


# ------------------------------------------------------------------ W5 token bucket

@query("token_bucket", sql="""
WITH RECURSIVE r AS (
  SELECT r.event_id, r.tenant_id, r.model, r.sec,
         CAST(coalesce(rt.rate_limit_rpm, 60) AS DOUBLE) AS cap,
         row_number() OVER (PARTITION BY r.tenant_id, r.model ORDER BY r.sec, r.event_id) AS rn
  FROM v_requests r LEFT JOIN (SELECT DISTINCT tenant_id, model, rate_limit_rpm FROM d_routing) rt USING (tenant_id, model)
), b(tenant_id, model, rn, event_id, sec, cap, tokens, allowed) AS (
  SELECT tenant_id, model, rn, event_id, sec, cap, CASE WHEN cap <= 0 THEN cap ELSE cap - 1 END, true FROM r WHERE rn = 1
  UNION ALL
  SELECT r.tenant_id, r.model, r.rn, r.event_id, r.sec, r.cap,
         CASE WHEN r.cap <= 0 THEN r.cap WHEN t >= 1 THEN t - 1 ELSE t END,
         r.cap <= 0 OR t >= 1
  FROM b JOIN r ON r.tenant_id = b.tenant_id AND r.model = b.model AND r.rn = b.rn + 1,
       LATERAL (SELECT least(r.cap, b.tokens + (r.sec - b.sec) * (r.cap / 60.0)) AS t)
)
SELECT event_id, allowed, round(tokens, 6) AS tokens_left FROM b
""")
def token_bucket(spark, sf_dir):
    """Bucket of ``rpm`` tokens refilled rpm/60 per second per (tenant, model).

    After 60 s without requests the bucket is full whatever came before, so the
    key is split there into independent segments; longer ones are folded by bins."""
    from agentlake.plans.windows import rate_capacity
    r = rate_capacity(spark, V.requests(spark, sf_dir).select("event_id", "tenant_id", "model", "sec"))
    out = run_fold(r, ["tenant_id", "model"], "sec", ["sec", "event_id"], 60, BucketFold, ["event_id"])
    return out.select("event_id", "allowed", F.round("tokens_left", 6).alias("tokens_left"))


# ------------------------------------------------------------------ P25, P26

# Error variant -> (HTTP status, code) as the gateway reports them.
ERROR_TAXONOMY = [("InvalidJSON", 400, "INVALID_JSON"), ("MissingModel", 400, "MISSING_MODEL"),
                  ("ModelNotConfigured", 400, "MODEL_NOT_CONFIGURED"), ("NoActiveKeys", 503, "ALL_KEYS_EXHAUSTED"),
                  ("RateLimitExceeded", 429, "RATE_LIMITED"), ("AgentRunawayLoop", 429, "AGENT_RUNAWAY_LOOP"),
                  ("AgentToolStorm", 429, "AGENT_TOOL_STORM"), ("BurnRateExceeded", 429, "BURN_RATE_EXCEEDED"),
                  ("InsufficientFunds", 402, "INSUFFICIENT_FUNDS"), ("Unauthorized", 401, "UNAUTHORIZED"),
                  ("Forbidden", 403, "FORBIDDEN"), ("TenantNotFound", 404, "TENANT_NOT_FOUND"),
                  ("InvalidTenantId", 400, "INVALID_TENANT_ID"), ("DatabaseError", 500, "DATABASE_ERROR"),
                  ("ResponseBuild", 500, "INTERNAL_ERROR"), ("UpstreamTimeout", 504, "GATEWAY_TIMEOUT"),
                  ("UpstreamUnreachable", 503, "UPSTREAM_ERROR"), ("ComplianceFailure", 503, "COMPLIANCE_ERROR"),
                  ("SecurityTimeout", 503, "SECURITY_TIMEOUT"), ("LoopDetected", 429, "AGENT_LOOP_DETECTED"),
                  ("Proxy", 500, "INTERNAL_ERROR"), ("RoutingStateMissing", 500, "ROUTING_STATE_MISSING"),
                  ("BillingAnomaly", 500, "BILLING_ANOMALY"), ("BillingUnavailable", 503, "BILLING_UNAVAILABLE"),
                  ("ConfigurationError", 500, "CONFIGURATION_ERROR"), ("InternalError", 500, "INTERNAL_ERROR")]


@query("error_taxonomy", sql="""
WITH tax AS (SELECT * FROM (VALUES """ + ", ".join(f"('{a}', {b}, '{c}')" for a, b, c in ERROR_TAXONOMY) + """)
             AS t(variant, http_status, code)),
ev AS (
  SELECT CASE WHEN status = 429 THEN 'RateLimitExceeded' ELSE 'NoActiveKeys' END AS variant
  FROM v_requests WHERE status <> 200
  UNION ALL
  SELECT CASE WHEN conv_id % 37 = 0 THEN 'InvalidJSON' ELSE 'MissingModel' END
  FROM (SELECT DISTINCT conv_id FROM conversations) WHERE conv_id % 37 = 0 OR conv_id % 41 = 0
)
SELECT t.code, CAST(t.http_status AS INTEGER) AS http_status, count(*) AS events FROM ev JOIN tax t USING (variant)
GROUP BY ALL
""")
def error_taxonomy(spark, sf_dir):
    """P25: error events mapped to (HTTP status, code) by a broadcast dimension join."""
    from agentlake.operators.payloads import ingest_status
    from agentlake.sources.payloads import payloads
    tax = bounded(D.to_df(spark, ERROR_TAXONOMY, ["variant", "http_status", "code"], ["string", "int", "string"]))
    up = (V.requests(spark, sf_dir).filter(F.col("status") != 200)
          .select(F.when(F.col("status") == 429, "RateLimitExceeded").otherwise("NoActiveKeys").alias("variant")))
    st = payloads(spark, sf_dir).select(ingest_status(F.col("body")).alias("s")).filter(F.col("s") != "valid")
    ing = st.select(F.when(F.col("s") == "INVALID_JSON", "InvalidJSON").otherwise("MissingModel").alias("variant"))
    # an unknown variant is an internal error, never a lost event
    return (up.unionByName(ing).join(tax, "variant", "left")
            .groupBy(F.coalesce("code", F.lit("INTERNAL_ERROR")).alias("code"), F.coalesce("http_status", F.lit(500)).alias("http_status"))
            .agg(F.count(F.lit(1)).alias("events")))


# Fixed value: cache admission limit of the first tier.
L1_MAX_TOKENS = 1000


def admission(l1_max_tokens: int = L1_MAX_TOKENS, semantic_max_bytes: int | None = None):
    """P26 as (tier, semantic_ok) columns over status, cache_hit, total_tokens. A
    200, non-hit, non-empty response is stored: under ``l1_max_tokens`` in L1,
    else L2 only. ``semantic_max_bytes`` keeps longer responses (4 bytes a token)
    out of the semantic tier (off by default)."""
    storable = (F.col("status") == 200) & ~F.col("cache_hit") & (F.col("total_tokens") > 0)
    tier = F.when(~storable, "none").when(F.col("total_tokens") < l1_max_tokens, "l1").otherwise("l2")
    fits = F.lit(True) if semantic_max_bytes is None else F.col("total_tokens") * 4 <= semantic_max_bytes
    return tier, storable & fits


@query("cache_admission", sql="""
SELECT CASE WHEN status <> 200 OR cache_hit OR total_tokens = 0 THEN 'none'
            WHEN total_tokens < 1000 THEN 'l1' ELSE 'l2' END AS tier,
       (status = 200 AND NOT cache_hit AND total_tokens > 0) AS semantic_ok,
       count(*) AS requests
FROM v_requests GROUP BY ALL
""")
def cache_admission(spark, sf_dir):
    """Tier of every response."""
    r = V.requests(spark, sf_dir)
    tier, sem = admission()
    return r.groupBy(tier.alias("tier"), sem.alias("semantic_ok")).agg(F.count(F.lit(1)).alias("requests"))


# ------------------------------------------------------------------ S9, T-3

AUDIT_COLS = ["event_id", "tenant_id", "session_id", "sec", "region", "model", "action", "reason"]


def audit_records(spark, sf_dir):
    """One audit row per compliance decision — ids, region, action,
    reason; never text, prompts or matched PII values."""
    from agentlake.plans.pii import residency
    res = residency(spark, sf_dir)
    r = V.requests(spark, sf_dir).select("event_id", "tenant_id", "session_id", "sec")
    return (res.join(r, "event_id")
            .select("event_id", "tenant_id", "session_id", "sec", "region", "model",
                    F.when(F.col("blocked"), "blocked").when(F.col("strict"), "sovereign_routed")
                    .otherwise("allowed").alias("action"), "reason"))


def export_audit(df, path: str):
    """Append-only audit export partitioned by tenant."""
    df.select(*AUDIT_COLS).write.mode("append").partitionBy("tenant_id").parquet(path)


@query("compliance_audit", sql="""
SELECT action, count(*) AS records, count(DISTINCT tenant_id) AS tenants FROM (
  SELECT r.tenant_id, CASE WHEN x.blocked THEN 'blocked' WHEN x.strict THEN 'sovereign_routed' ELSE 'allowed' END AS action
  FROM (""" + "{RES}" + """) x JOIN v_requests r USING (event_id)) GROUP BY action
""")
def compliance_audit(spark, sf_dir):
    a = audit_records(spark, sf_dir)
    return a.groupBy("action").agg(F.count(F.lit(1)).alias("records"), F.countDistinct("tenant_id").alias("tenants"))


@query("audit_topn", sql="""
SELECT tenant_id, event_id, action, rank FROM (
  SELECT r.tenant_id, r.event_id,
         CASE WHEN x.blocked THEN 'blocked' WHEN x.strict THEN 'sovereign_routed' ELSE 'allowed' END AS action,
         row_number() OVER (PARTITION BY r.tenant_id ORDER BY r.sec DESC, r.event_id DESC) AS rank
  FROM (""" + "{RES}" + """) x JOIN v_requests r USING (event_id)) WHERE rank <= 50
""")
def audit_topn(spark, sf_dir):
    """T-3: newest 50 audit records per tenant (per-partition group limit before the shuffle)."""
    a = audit_records(spark, sf_dir)
    w = Window.partitionBy("tenant_id").orderBy(F.desc("sec"), F.desc("event_id"))
    return (a.withColumn("rank", F.row_number().over(w).cast("bigint")).filter(F.col("rank") <= 50)
            .select("tenant_id", "event_id", "action", "rank"))


def _patch():
    from agentlake.plans.pii import _RESIDENCY_SQL
    from agentlake.plans.registry import REGISTRY
    for k in ("compliance_audit", "audit_topn"):
        REGISTRY[k].sql = REGISTRY[k].sql.replace("{RES}", _RESIDENCY_SQL)


_patch()
