"""Queries: windows, ordered replay on aggregates, lineage (W4, W6–W8, W11, W14, J12, T-2)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from agentlake.operators import lineage, ordered
from agentlake.operators.dims import bounded
from agentlake.plans.registry import query
from agentlake.sources import dimensions as D
from agentlake.sources import views as V

# Default per-minute capacity when a (tenant, model) has none.
DEFAULT_RPM = 60
# EMA smoothing of the latency ranking and staleness horizon.
EMA_ALPHA = 0.3
RANKING_STALE_SEC = 30
TICK_SEC = 60
# Bin width of the bin-local windows: one task holds at most one bin of one key.
BIN_SEC = 60


def rate_capacity(spark, requests):
    """(tenant, model) rpm from routing (tenant must be configured itself), else default."""
    rt = (D.routing_df(spark).select("tenant_id", "model", "rate_limit_rpm")
          .dropDuplicates(["tenant_id", "model"]))
    rt = bounded(rt)
    return (requests.join(rt, ["tenant_id", "model"], "left")
            .withColumn("capacity", F.coalesce(F.col("rate_limit_rpm"), F.lit(DEFAULT_RPM)).cast("int"))
            .drop("rate_limit_rpm"))


@query("rate_limit", sql=f"""
SELECT event_id, tenant_id, model, capacity, n_in_window, capacity > 0 AND n_in_window > capacity AS blocked
FROM (
  SELECT r.event_id, r.tenant_id, r.model,
         CAST(coalesce(rt.rate_limit_rpm, {DEFAULT_RPM}) AS INTEGER) AS capacity,
         row_number() OVER (PARTITION BY r.tenant_id, r.model, r.sec // 60 ORDER BY r.sec, r.event_id) AS n_in_window
  FROM v_requests r
  LEFT JOIN (SELECT DISTINCT tenant_id, model, rate_limit_rpm FROM d_routing) rt
    ON rt.tenant_id = r.tenant_id AND rt.model = r.model
)
""")
def rate_limit(spark, sf_dir):
    # Fixed 60 s windows; the window partition is (tenant, model, minute),
    # bounded by one minute of one key's traffic.
    r = rate_capacity(spark, V.requests(spark, sf_dir).select("event_id", "tenant_id", "model", "sec"))
    # position inside the (tenant, model, minute) window as a bin-local running
    # count over 1 s bins: no task holds more than one second of one key
    r = r.withColumn("minute", F.floor(F.col("sec") / 60)).withColumn("one", F.lit(1).cast("bigint"))
    r = ordered.running_sums(r, ["tenant_id", "model", "minute"], "sec", "event_id", ["one"], 1)
    r = r.withColumn("n_in_window", F.col("one_running").cast("bigint"))
    return r.select("event_id", "tenant_id", "model", "capacity", "n_in_window",
                    ((F.col("capacity") > 0) & (F.col("n_in_window") > F.col("capacity"))).alias("blocked"))


@query("breaker_intervals", sql="""
SELECT tenant_id, api_key_alias, min(sec) AS open_sec, max(sec) + 60 AS close_sec, count(*) AS events
FROM (
  SELECT *, sum(CASE WHEN prev IS NULL OR sec - prev >= 60 THEN 1 ELSE 0 END)
              OVER (PARTITION BY tenant_id, api_key_alias ORDER BY sec, event_id) AS island
  FROM (SELECT *, lag(sec) OVER (PARTITION BY tenant_id, api_key_alias ORDER BY sec, event_id) AS prev
        FROM v_requests WHERE status IN (401, 403, 404, 408, 429, 500, 502, 503, 504))
) GROUP BY tenant_id, api_key_alias, island
""")
def breaker_intervals(spark, sf_dir):
    from agentlake.functions.classify import is_retryable_status
    f = V.requests(spark, sf_dir).filter(is_retryable_status(F.col("status")))
    return ordered.islands(f.select("tenant_id", "api_key_alias", "sec"), ["tenant_id", "api_key_alias"],
                           "sec", 60)


@query("session_timeline", sql="""
SELECT event_id, session_id,
       row_number() OVER w AS turn,
       sec - lag(sec) OVER w AS gap_sec,
       CAST(sum(total_tokens) OVER w AS BIGINT) AS running_tokens,
       CAST(sum(cost_usd) OVER w AS DECIMAL(38,14)) AS running_cost_usd
FROM v_priced WINDOW w AS (PARTITION BY session_id ORDER BY sec, event_id)
""")
def session_timeline(spark, sf_dir):
    from agentlake.operators.billing import price
    r = price(V.requests(spark, sf_dir), D.pricing_df(spark)).select("event_id", "session_id", "sec", "total_tokens", "cost_usd")
    r = r.withColumn("one", F.lit(1).cast("bigint"))
    r = ordered.running_sums(r, ["session_id"], "sec", "event_id", ["one", "total_tokens", "cost_usd"], BIN_SEC)
    r = ordered.previous_value(r, ["session_id"], "sec", "event_id", "sec", "prev_sec", BIN_SEC)
    return r.select("event_id", "session_id", F.col("one_running").cast("bigint").alias("turn"),
                    (F.col("sec") - F.col("prev_sec")).alias("gap_sec"),
                    F.col("total_tokens_running").cast("bigint").alias("running_tokens"),
                    F.col("cost_usd_running").cast("decimal(38,14)").alias("running_cost_usd"))


def _tick_p95(spark, sf_dir):
    r = V.requests(spark, sf_dir).filter((F.col("status") == 200) & (F.col("executed_provider") != ""))
    return (r.groupBy(F.col("executed_provider").alias("provider"),
                      F.floor(F.col("sec") / TICK_SEC).cast("bigint").alias("tick"))
            .agg(F.percentile(F.col("latency_ms"), 0.95).alias("p95")))


def ema_table(spark, sf_dir):
    """provider, tick, p95, ema: the average composed over bins of ticks."""
    return ordered.ema(_tick_p95(spark, sf_dir), ["provider"], "tick", "p95", EMA_ALPHA)


_EMA_ORACLE = f"""
WITH RECURSIVE t AS (
  SELECT executed_provider AS provider, sec // {TICK_SEC} AS tick, quantile_cont(latency_ms, 0.95) AS p95
  FROM v_requests WHERE status = 200 AND executed_provider <> '' GROUP BY ALL
), tn AS (SELECT *, row_number() OVER (PARTITION BY provider ORDER BY tick) AS rn FROM t),
e(provider, rn, tick, p95, ema) AS (
  SELECT provider, rn, tick, p95, p95 FROM tn WHERE rn = 1
  UNION ALL
  SELECT tn.provider, tn.rn, tn.tick, tn.p95, {EMA_ALPHA} * tn.p95 + {1 - EMA_ALPHA} * e.ema
  FROM e JOIN tn ON tn.provider = e.provider AND tn.rn = e.rn + 1
)
"""


@query("ema_latency", bench=True, sql=_EMA_ORACLE + """
SELECT provider, tick, round(p95, 6) AS p95, round(ema, 6) AS ema FROM e
""")
def ema_latency(spark, sf_dir):
    e = ema_table(spark, sf_dir)
    return e.select("provider", "tick", F.round("p95", 6).alias("p95"), F.round("ema", 6).alias("ema"))


@query("provider_ranking", sql=_EMA_ORACLE + f"""
, last AS (SELECT provider, arg_max(ema, tick) AS ema, max(tick) AS tick FROM e GROUP BY provider),
pri AS (SELECT provider_name, min(priority) AS priority FROM d_routing WHERE provider_name IS NOT NULL GROUP BY 1),
flag AS (SELECT l.*, l.tick * {TICK_SEC} < max(l.tick) OVER () * {TICK_SEC} - {RANKING_STALE_SEC} AS stale,
                coalesce(p.priority, 1000) AS priority
         FROM last l LEFT JOIN pri p ON p.provider_name = l.provider)
SELECT provider, round(ema, 6) AS ema, stale,
       row_number() OVER (ORDER BY stale, CASE WHEN NOT stale THEN ema END, priority, provider) AS rank
FROM flag
""")
def provider_ranking(spark, sf_dir):
    e = ema_table(spark, sf_dir)
    last = e.groupBy("provider").agg(F.max_by("ema", "tick").alias("ema"), F.max("tick").alias("tick"))
    pri = (D.routing_df(spark).filter(F.col("provider_name").isNotNull())
           .groupBy(F.col("provider_name").alias("provider")).agg(F.min("priority").alias("priority")))
    newest = last.agg(F.max("tick")).scalar()
    flag = (last.join(pri, "provider", "left")
            .withColumn("priority", F.coalesce("priority", F.lit(1000)))
            .withColumn("stale", F.col("tick") * TICK_SEC < newest * TICK_SEC - RANKING_STALE_SEC))
    # one row a provider; their order is an aggregate of that table, not a window over traffic
    key = F.struct("stale", F.when(~F.col("stale"), F.col("ema")).alias("by_ema"), "priority", "provider", "ema")
    ranked = flag.agg(F.array_sort(F.collect_list(key)).alias("all")).select(F.posexplode("all").alias("at", "p"))
    return ranked.select("p.provider", F.round("p.ema", 6).alias("ema"), "p.stale", (F.col("at") + 1).cast("bigint").alias("rank"))


_TREE_ORACLE = """
WITH RECURSIVE walk(trace_id, node, depth) AS (
  SELECT trace_id, trace_id, 0 FROM v_requests
  UNION ALL
  SELECT w.trace_id, r.parent_trace_id, w.depth + 1
  FROM walk w JOIN v_requests r ON r.trace_id = w.node WHERE r.parent_trace_id IS NOT NULL
), tree AS (SELECT trace_id, arg_max(node, depth) AS root_trace_id, max(depth) AS depth FROM walk GROUP BY trace_id)
"""


@query("trace_tree", sql="""
WITH RECURSIVE walk(trace_id, node, depth, path) AS (
  SELECT trace_id, trace_id, 0, trace_id FROM v_requests
  UNION ALL
  SELECT w.trace_id, r.parent_trace_id, w.depth + 1, r.parent_trace_id || '/' || w.path
  FROM walk w JOIN v_requests r ON r.trace_id = w.node WHERE r.parent_trace_id IS NOT NULL
), tops AS (SELECT trace_id, arg_max(node, depth) AS root_trace_id, max(depth) AS depth, arg_max(path, depth) AS path FROM walk GROUP BY trace_id),
sums AS (SELECT w.node AS trace_id, count(*) AS subtree_nodes, sum(p.latency_ms) AS subtree_latency_ms, sum(p.total_tokens) AS subtree_total_tokens, sum(p.cost_usd) AS subtree_cost_usd
         FROM walk w JOIN v_priced p ON p.trace_id = w.trace_id GROUP BY w.node)
SELECT trace_id, root_trace_id, CAST(depth AS BIGINT) AS depth, path, subtree_nodes, CAST(subtree_latency_ms AS BIGINT) AS subtree_latency_ms,
       CAST(subtree_total_tokens AS BIGINT) AS subtree_total_tokens, CAST(subtree_cost_usd AS DECIMAL(38,14)) AS subtree_cost_usd
FROM tops JOIN sums USING (trace_id)
""")
def trace_tree(spark, sf_dir):
    """Root, depth and path of every trace, and latency, tokens and cost of all below it."""
    from agentlake.operators.billing import price
    r = price(V.requests(spark, sf_dir, with_parent=True), D.pricing_df(spark))
    r = r.select("trace_id", "parent_trace_id", F.col("latency_ms").cast("bigint").alias("latency_ms"), F.col("total_tokens").cast("bigint").alias("total_tokens"), "cost_usd")
    t = lineage.tree(r, "trace_id", "parent_trace_id", ["latency_ms", "total_tokens", "cost_usd"])
    return t.select("trace_id", "root_trace_id", "depth", F.array_join("path", "/").alias("path"), "subtree_nodes", "subtree_latency_ms", "subtree_total_tokens",
                    F.col("subtree_cost_usd").cast("decimal(38,14)").alias("subtree_cost_usd"))


@query("trace_roots", sql=_TREE_ORACLE + """
SELECT root_trace_id, count(*) AS nodes, CAST(max(depth) AS BIGINT) AS max_depth,
       CAST(sum(r.latency_ms) AS BIGINT) AS subtree_latency_ms, CAST(sum(r.total_tokens) AS BIGINT) AS subtree_tokens
FROM tree JOIN v_requests r USING (trace_id) GROUP BY root_trace_id
""")
def trace_roots(spark, sf_dir):
    r = V.requests(spark, sf_dir, with_parent=True)
    t = lineage.roots(r.select("trace_id", "parent_trace_id"), "trace_id", "parent_trace_id")
    return (t.join(r.select("trace_id", "latency_ms", "total_tokens"), "trace_id")
            .groupBy("root_trace_id")
            .agg(F.count(F.lit(1)).alias("nodes"), F.max("depth").cast("bigint").alias("max_depth"),
                 F.sum("latency_ms").cast("bigint").alias("subtree_latency_ms"),
                 F.sum("total_tokens").cast("bigint").alias("subtree_tokens")))


@query("traces_topn", sql="""
SELECT session_id, trace_id, sec, rank FROM (
  SELECT session_id, trace_id, sec, row_number() OVER (PARTITION BY session_id ORDER BY sec DESC, event_id DESC) AS rank
  FROM v_requests) WHERE rank <= 50
""")
def traces_topn(spark, sf_dir):
    # rank <= 50 per session: Catalyst inserts a per-partition group limit
    # before the shuffle, so a hot session ships at most 50 rows per task.
    r = V.requests(spark, sf_dir).select("session_id", "trace_id", "sec", "event_id")
    w = Window.partitionBy("session_id").orderBy(F.desc("sec"), F.desc("event_id"))
    return (r.withColumn("rank", F.row_number().over(w).cast("bigint")).filter(F.col("rank") <= 50)
            .select("session_id", "trace_id", "sec", "rank"))
