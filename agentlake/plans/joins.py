"""Queries: routing joins and target selection (J1–J3, J15, J17, S5, A16, T-1, T-4)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from agentlake.operators import billing as B
from agentlake.operators import routing as R
from agentlake.plans.registry import query
from agentlake.sources import dimensions as D
from agentlake.sources import views as V

Z = D.ZERO_TENANT

_RESOLVE_SQL = f"""
WITH routes AS (SELECT tenant_id, model, count(position) AS n_targets FROM d_routing GROUP BY ALL),
rq AS (
  SELECT r.*, CASE WHEN r.tenant_id IN (SELECT tenant_id FROM d_routing) THEN r.tenant_id ELSE '{Z}' END AS map_tenant,
         CASE WHEN starts_with(lower(trim(model)), 'gpt-') THEN 'gpt-4o'
              WHEN starts_with(lower(trim(model)), 'claude-') THEN 'claude-3-5-sonnet'
              WHEN starts_with(lower(trim(model)), 'gemini-') THEN 'gemini-1.5-pro'
              WHEN starts_with(lower(trim(model)), 'deepseek-') THEN 'deepseek-r1'
              WHEN starts_with(lower(trim(model)), 'cohere-') OR starts_with(lower(trim(model)), 'command-')
                   THEN 'cohere-command-r'
              WHEN starts_with(lower(trim(model)), 'llama-') THEN 'llama-3.3-70b-versatile' END AS fam
  FROM v_requests r
),
resolved AS (
  SELECT rq.*, coalesce(e.model, f.model) AS route_model,
         CASE WHEN e.model IS NOT NULL THEN e.n_targets ELSE f.n_targets END AS n_targets,
         CASE WHEN coalesce(e.model, f.model) IS NULL THEN 'MODEL_NOT_CONFIGURED'
              WHEN (CASE WHEN e.model IS NOT NULL THEN e.n_targets ELSE f.n_targets END) = 0 THEN 'ALL_KEYS_EXHAUSTED'
              ELSE 'ok' END AS route_status
  FROM rq LEFT JOIN routes e ON e.tenant_id = rq.map_tenant AND e.model = rq.model
          LEFT JOIN routes f ON f.tenant_id = rq.map_tenant AND f.model = rq.fam
),
cand AS (
  SELECT r.*, t.position, t.priority, t.provider_name, t.key_alias, t.target_model
  FROM resolved r JOIN d_routing t ON t.tenant_id = r.map_tenant AND t.model = r.route_model
  WHERE t.position IS NOT NULL
),
fails AS (
  SELECT tenant_id, key_alias, sec FROM (
    SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY priority, position) AS rn FROM cand
    WHERE status IN (401, 403, 404, 408, 429, 500, 502, 503, 504)) WHERE rn = 1
),
iv AS (
  SELECT tenant_id, key_alias, min(sec) AS open_sec, max(sec) + 60 AS close_sec FROM (
    SELECT *, sum(CASE WHEN prev IS NULL OR sec - prev >= 60 THEN 1 ELSE 0 END)
                OVER (PARTITION BY tenant_id, key_alias ORDER BY sec) AS island
    FROM (SELECT *, lag(sec) OVER (PARTITION BY tenant_id, key_alias ORDER BY sec) AS prev FROM fails))
  GROUP BY tenant_id, key_alias, island
),
healthy AS (
  SELECT c.* FROM cand c WHERE NOT EXISTS (
    SELECT 1 FROM iv WHERE iv.tenant_id = c.tenant_id AND iv.key_alias = c.key_alias
      AND iv.open_sec < c.sec AND c.sec < iv.close_sec)
),
chain AS (
  SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY priority, position) AS target_rank,
         count(*) OVER (PARTITION BY event_id) AS n_healthy
  FROM healthy
)
"""


def _resolved(spark, sf_dir):
    r = V.requests(spark, sf_dir).select("event_id", "sec", "tenant_id", "model", "status", "is_hot_swapped",
                                         "requested_provider", "prompt_tokens", "total_tokens", "cache_hit",
                                         "mcp_calls", "agent_loops")
    return R.resolve(spark, r)


def _healthy(spark, sf_dir):
    return R.healthy(spark, _resolved(spark, sf_dir))


def _chain(spark, sf_dir):
    """One row per (request, healthy target) with its rank."""
    h = _healthy(spark, sf_dir)
    keep = [c for c in h.columns if c not in ("targets", "healthy")]
    return (h.select(*keep, F.size("healthy").cast("bigint").alias("n_healthy"), F.posexplode("healthy").alias("_p", "_h"))
            .select(*keep, "n_healthy", (F.col("_p") + 1).cast("bigint").alias("target_rank"), "_h.*"))


@query("resolve_route", sql=_RESOLVE_SQL + """
SELECT event_id, map_tenant, route_model, route_status,
       CAST(CASE WHEN route_status = 'ok' THEN 200 WHEN route_status = 'MODEL_NOT_CONFIGURED' THEN 400 ELSE 503 END
            AS INTEGER) AS http_status
FROM resolved
""")
def resolve_route(spark, sf_dir):
    r = _resolved(spark, sf_dir)
    http = (F.when(F.col("route_status") == "ok", 200).when(F.col("route_status") == "MODEL_NOT_CONFIGURED", 400)
            .otherwise(503).cast("int"))
    return r.select("event_id", "map_tenant", "route_model", "route_status", http.alias("http_status"))


@query("healthy_targets", sql=_RESOLVE_SQL + """
SELECT event_id, key_alias, provider_name, target_rank FROM chain
""")
def healthy_targets(spark, sf_dir):
    return _chain(spark, sf_dir).select("event_id", "key_alias", "provider_name", "target_rank")


@query("breaker_open_skips", sql=_RESOLVE_SQL + """
SELECT c.tenant_id, c.key_alias, count(*) AS skipped
FROM cand c LEFT JOIN healthy h ON h.event_id = c.event_id AND h.key_alias = c.key_alias
WHERE h.event_id IS NULL GROUP BY ALL
""")
def breaker_open_skips(spark, sf_dir):
    h = _healthy(spark, sf_dir)
    skipped = h.select("tenant_id", F.explode(F.array_except("targets", "healthy")).alias("t"))
    return skipped.groupBy("tenant_id", F.col("t.key_alias").alias("key_alias")).agg(F.count(F.lit(1)).alias("skipped"))


@query("failover_chain", sql=_RESOLVE_SQL + """
SELECT event_id,
       max(CASE WHEN target_rank = 1 THEN key_alias END) AS primary_key_alias,
       CAST(max(n_healthy) - 1 AS BIGINT) AS fallbacks,
       coalesce(max(CASE WHEN target_rank = 2 AND is_hot_swapped THEN provider_name END),
                max(CASE WHEN target_rank = 1 THEN provider_name END)) AS executed_provider,
       bool_or(is_hot_swapped) AND max(n_healthy) > 1 AS hot_swapped
FROM chain GROUP BY event_id
""")
def failover_chain(spark, sf_dir):
    h = _healthy(spark, sf_dir).filter(F.size("healthy") > 0)
    first, second, n = F.col("healthy")[0], F.try_element_at("healthy", F.lit(2)), F.size("healthy")
    return h.select("event_id", first["key_alias"].alias("primary_key_alias"), (n - 1).cast("bigint").alias("fallbacks"),
                    F.coalesce(F.when(F.col("is_hot_swapped"), second["provider_name"]), first["provider_name"]).alias("executed_provider"),
                    (F.col("is_hot_swapped") & (n > 1)).alias("hot_swapped"))


@query("routing_flat", sql=_RESOLVE_SQL + """
SELECT t.tenant_id, t.model, t.position, t.priority, t.provider_name, t.key_alias, t.target_model,
       count(c.event_id) AS requests
FROM d_routing t LEFT JOIN cand c
  ON c.map_tenant = t.tenant_id AND c.route_model = t.model AND c.position = t.position
WHERE t.position IS NOT NULL GROUP BY ALL
""")
def routing_flat(spark, sf_dir):
    """The routing document flattened (two map explodes + posexplode of
    targets), with the traffic each configured target is eligible for."""
    doc = spark.range(1).select(F.lit(D.routing_json()).alias("doc"))
    schema = ("map<string, map<string, struct<rate_limit_rpm:int, targets:array<struct<priority:int, weight:int, "
              "provider_name:string, api_key_alias:string, target_model:string, schema_format:string>>>>>")
    flat = (doc.select(F.explode(F.from_json("doc", schema)).alias("tenant_id", "models"))
            .select("tenant_id", F.explode("models").alias("model", "cfg"))
            .select("tenant_id", "model", F.posexplode("cfg.targets").alias("position", "t"))
            .select("tenant_id", "model", "position", "t.priority", "t.provider_name",
                    F.col("t.api_key_alias").alias("key_alias"), "t.target_model"))
    cand = R.candidates(spark, _resolved(spark, sf_dir)).select(
        F.col("map_tenant").alias("tenant_id"), F.col("route_model").alias("model"), "position", "event_id")
    # traffic is counted by config key first; what is joined is two small tables
    n = cand.groupBy("tenant_id", "model", "position").agg(F.count("event_id").alias("requests"))
    return (flat.join(n, ["tenant_id", "model", "position"], "left")
            .withColumn("requests", F.coalesce("requests", F.lit(0).cast("bigint"))))


@query("routing_summary", sql=_RESOLVE_SQL + """
SELECT t.tenant_id, t.model, arg_min(t.provider_name, t.position) AS first_provider,
       arg_min(t.target_model, t.position) AS first_target_model, count(t.position) AS n_keys,
       (SELECT count(*) FROM resolved r WHERE r.map_tenant = t.tenant_id AND r.route_model = t.model) AS requests
FROM d_routing t GROUP BY t.tenant_id, t.model
""")
def routing_summary(spark, sf_dir):
    rt = R.routing(spark)
    summ = rt.groupBy("tenant_id", "model").agg(
        F.min_by("provider_name", "position").alias("first_provider"),
        F.min_by("target_model", "position").alias("first_target_model"),
        F.count("position").alias("n_keys"))
    traffic = (_resolved(spark, sf_dir).groupBy(F.col("map_tenant").alias("tenant_id"),
                                                F.col("route_model").alias("model"))
               .agg(F.count(F.lit(1)).alias("requests")))
    return (summ.join(traffic, ["tenant_id", "model"], "left")
            .withColumn("requests", F.coalesce("requests", F.lit(0)).cast("bigint")))


@query("price_requests", sql=_RESOLVE_SQL + """
, primary_t AS (SELECT * FROM chain WHERE target_rank = 1),
p AS (
  SELECT x.*, coalesce(pt.in_rate, pv.in_rate, CAST((""" + "{IN}" + """) AS DECIMAL(12,6))) AS in_rate,
         coalesce(pt.out_rate, pv.out_rate, CAST((""" + "{OUT}" + """) AS DECIMAL(12,6))) AS out_rate
  FROM primary_t x LEFT JOIN d_pricing pt ON pt.model = x.target_model LEFT JOIN d_pricing pv ON pv.model = x.model
)
SELECT event_id, target_model, in_rate, out_rate FROM p
""")
def price_requests(spark, sf_dir):
    """Rate of the primary healthy target: map by target model, else by
    virtual model, else the static table on (provider, target model)."""
    prim = _chain(spark, sf_dir).filter(F.col("target_rank") == 1)
    priced = B.price(prim, D.pricing_df(spark), provider_col="provider_name", model_col="model",
                     target_col="target_model")
    return priced.select("event_id", "target_model", "in_rate", "out_rate")


@query("cheapest_target", sql=_RESOLVE_SQL + """
, rated AS (
  SELECT DISTINCT c.map_tenant, c.route_model, c.key_alias, c.provider_name, c.target_model, c.position,
         coalesce(pm.in_rate + pm.out_rate,
                  CAST((""" + "{IN2}" + """) AS DECIMAL(12,6)) + CAST((""" + "{OUT2}" + """) AS DECIMAL(12,6))) AS rate
  FROM cand c LEFT JOIN d_pricing pm ON pm.model = c.target_model
)
SELECT map_tenant, route_model, key_alias, rate FROM (
  SELECT *, row_number() OVER (PARTITION BY map_tenant, route_model ORDER BY rate, position) AS rn FROM rated)
WHERE rn = 1
""")
def cheapest_target(spark, sf_dir):
    """T-4: per route with traffic, the target with the lowest input+output rate."""
    from agentlake.functions import pricing as P
    cand = R.candidates(spark, _resolved(spark, sf_dir)).select(
        "map_tenant", "route_model", "key_alias", "provider_name", "target_model", "position").distinct()
    pm = D.pricing_df(spark).select(F.col("model").alias("_pm"),
                                    (F.col("in_rate") + F.col("out_rate")).alias("_r"))
    static = P.lookup_rate(F.col("provider_name"), F.col("target_model"))
    rated = (cand.join(pm, F.col("target_model") == F.col("_pm"), "left")
             .withColumn("rate", F.coalesce(F.col("_r"), static["in_rate"] + static["out_rate"])))
    w = Window.partitionBy("map_tenant", "route_model").orderBy("rate", "position")
    return (rated.withColumn("rn", F.row_number().over(w)).filter("rn = 1")
            .select("map_tenant", "route_model", "key_alias", "rate"))


def _fill(sql: str) -> str:
    from agentlake.plans import oracle_views as OV
    return (sql.replace("{IN}", OV.rate_case(OV.RATE_CASE_IN, "x.provider_name", "x.target_model"))
            .replace("{OUT}", OV.rate_case(OV.RATE_CASE_OUT, "x.provider_name", "x.target_model"))
            .replace("{IN2}", OV.rate_case(OV.RATE_CASE_IN, "c.provider_name", "c.target_model"))
            .replace("{OUT2}", OV.rate_case(OV.RATE_CASE_OUT, "c.provider_name", "c.target_model")))


def _patch():
    from agentlake.plans.registry import REGISTRY
    for k in ("price_requests", "cheapest_target"):
        q = REGISTRY[k]
        q.sql = _fill(q.sql)


_patch()
