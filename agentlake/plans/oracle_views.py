"""DuckDB definitions of the derived views and dimensions (oracle side).

Written independently of the Spark builders in ``agentlake.sources`` so the
oracle checks them rather than repeating them. Tables ``events``,
``documents`` … are the driver's pre-registered parquet views.
"""

from __future__ import annotations

from agentlake.sources import dimensions as D

V_REQUESTS = """
SELECT event_id, ts, user_id, event_type, value, k,
       event_id * 2 AS sec,
       'tr-' || event_id AS trace_id,
       CASE WHEN k % 3 <> 0 THEN lag('tr-' || event_id) OVER (PARTITION BY user_id ORDER BY event_id) END
           AS parent_trace_id,
       's-' || user_id AS session_id,
       't-' || (user_id % 8) AS tenant_id,
       'team-' || (user_id % 3) AS team_id,
       'key-' || (k % 5) AS api_key_alias,
       CASE WHEN k >= 98 THEN 'openai' WHEN k >= 96 THEN 'acme' WHEN k % 6 IN (0, 1) THEN 'openai' WHEN k % 6 = 2 THEN 'anthropic'
            WHEN k % 6 = 3 THEN 'gemini' WHEN k % 6 = 4 THEN 'deepseek' ELSE 'groq' END AS requested_provider,
       CASE WHEN k >= 98 THEN 'o1-mini' WHEN k >= 96 THEN 'zero-day-1' WHEN k % 6 = 0 THEN 'gpt-4o' WHEN k % 6 = 1 THEN 'gpt-4o-mini'
            WHEN k % 6 = 2 THEN 'claude-3-5-sonnet' WHEN k % 6 = 3 THEN 'gemini-1.5-pro'
            WHEN k % 6 = 4 THEN 'deepseek-r1' ELSE 'llama-3.3-70b-versatile' END AS model,
       CAST(CASE WHEN event_type = 'error' AND k < 30 THEN 429
                 WHEN event_type = 'error' AND k < 60 THEN 503 ELSE 200 END AS INTEGER) AS status,
       (event_type = 'error' AND k >= 60) AS is_hot_swapped,
       (event_type = 'view' AND k % 4 = 0) AS cache_hit,
       CAST(floor(value * 10) AS INTEGER) AS latency_ms,
       CAST(50 + k * 3 AS BIGINT) AS prompt_tokens,
       CAST(CASE WHEN event_type = 'view' AND k % 4 = 0 THEN 0
                 ELSE 50 + k * 3 + CAST(floor(value) AS BIGINT) END AS BIGINT) AS total_tokens,
       CAST(CASE WHEN event_type = 'click' THEN 1 + k % 3 ELSE 0 END AS INTEGER) AS mcp_calls,
       CAST(CASE WHEN event_type = 'error' THEN k % 2 ELSE 0 END AS INTEGER) AS agent_loops,
       CASE user_id % 4 WHEN 0 THEN 'IN' WHEN 1 THEN 'US' WHEN 2 THEN 'EU' END AS user_region,
       CASE WHEN NOT (event_type <> 'error' OR k >= 60) THEN ''
            WHEN event_type = 'error' AND k >= 60 THEN
                 CASE WHEN k >= 98 OR (k < 96 AND k % 6 IN (0, 1)) THEN 'anthropic' ELSE 'openai' END
            ELSE CASE WHEN k >= 98 THEN 'openai' WHEN k >= 96 THEN 'acme' WHEN k % 6 IN (0, 1) THEN 'openai' WHEN k % 6 = 2 THEN 'anthropic'
                      WHEN k % 6 = 3 THEN 'gemini' WHEN k % 6 = 4 THEN 'deepseek' ELSE 'groq' END
       END AS executed_provider
FROM (SELECT *, TRY_CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events) e
"""

# Static rate table as a CASE chain over lower-cased provider p / model m.
RATE_CASE_IN = """CASE
  WHEN {p} LIKE '%openai%' AND {m} LIKE '%o1-mini%' THEN 15.00
  WHEN {p} LIKE '%openai%' AND {m} LIKE '%o1%' THEN 15.00
  WHEN {p} LIKE '%openai%' AND {m} LIKE '%gpt-4o-mini%' THEN 0.15
  WHEN {p} LIKE '%openai%' AND ({m} LIKE '%gpt-4o%' OR {m} LIKE '%gpt-4-turbo%') THEN 5.00
  WHEN {p} LIKE '%anthropic%' AND ({m} LIKE '%claude-3-5-sonnet%' OR {m} LIKE '%claude-3.5-sonnet%') THEN 3.00
  WHEN {p} LIKE '%anthropic%' AND {m} LIKE '%claude-3-opus%' THEN 15.00
  WHEN {p} LIKE '%anthropic%' AND {m} LIKE '%claude-3-haiku%' THEN 0.25
  WHEN ({p} LIKE '%google%' OR {p} LIKE '%gemini%') AND {m} LIKE '%gemini-1.5-pro%' THEN 3.50
  WHEN ({p} LIKE '%google%' OR {p} LIKE '%gemini%') AND ({m} LIKE '%gemini-1.5-flash%' OR {m} LIKE '%gemini-flash%') THEN 0.075
  WHEN {p} LIKE '%deepseek%' AND {m} LIKE '%deepseek-r1%' THEN 0.55
  WHEN {p} LIKE '%deepseek%' THEN 0.14
  WHEN {p} LIKE '%groq%' THEN 0
  WHEN {m} LIKE '%llama%' OR {m} LIKE '%mistral%' OR {m} LIKE '%mixtral%' OR {m} LIKE '%qwen%' OR {m} LIKE '%phi%'
       OR {m} LIKE '%falcon%' OR {m} LIKE '%gemma%' THEN 0.50
  ELSE 20.00 END"""

RATE_CASE_OUT = """CASE
  WHEN {p} LIKE '%openai%' AND {m} LIKE '%o1-mini%' THEN 60.00
  WHEN {p} LIKE '%openai%' AND {m} LIKE '%o1%' THEN 60.00
  WHEN {p} LIKE '%openai%' AND {m} LIKE '%gpt-4o-mini%' THEN 0.60
  WHEN {p} LIKE '%openai%' AND ({m} LIKE '%gpt-4o%' OR {m} LIKE '%gpt-4-turbo%') THEN 15.00
  WHEN {p} LIKE '%anthropic%' AND ({m} LIKE '%claude-3-5-sonnet%' OR {m} LIKE '%claude-3.5-sonnet%') THEN 15.00
  WHEN {p} LIKE '%anthropic%' AND {m} LIKE '%claude-3-opus%' THEN 75.00
  WHEN {p} LIKE '%anthropic%' AND {m} LIKE '%claude-3-haiku%' THEN 1.25
  WHEN ({p} LIKE '%google%' OR {p} LIKE '%gemini%') AND {m} LIKE '%gemini-1.5-pro%' THEN 10.50
  WHEN ({p} LIKE '%google%' OR {p} LIKE '%gemini%') AND ({m} LIKE '%gemini-1.5-flash%' OR {m} LIKE '%gemini-flash%') THEN 0.30
  WHEN {p} LIKE '%deepseek%' AND {m} LIKE '%deepseek-r1%' THEN 2.19
  WHEN {p} LIKE '%deepseek%' THEN 0.28
  WHEN {p} LIKE '%groq%' THEN 0
  WHEN {m} LIKE '%llama%' OR {m} LIKE '%mistral%' OR {m} LIKE '%mixtral%' OR {m} LIKE '%qwen%' OR {m} LIKE '%phi%'
       OR {m} LIKE '%falcon%' OR {m} LIKE '%gemma%' THEN 1.50
  ELSE 60.00 END"""


def rate_case(template: str, provider: str, model: str) -> str:
    return template.replace("{p}", f"lower({provider})").replace("{m}", f"lower({model})")


def cost_sql(prompt: str, completion: str, in_rate: str, out_rate: str, buffer: str, fee: str,
             calls: str, mult: str, loops: str) -> str:
    base = (f"CAST((CAST({prompt} AS DECIMAL(12,0)) * CAST({in_rate} AS DECIMAL(12,6)) "
            f"+ CAST({completion} AS DECIMAL(12,0)) * CAST({out_rate} AS DECIMAL(12,6))) "
            f"* CAST(0.000001 AS DECIMAL(7,6)) + CAST({buffer} AS DECIMAL(12,6)) "
            f"+ CAST({fee} AS DECIMAL(12,6)) * CAST({calls} AS DECIMAL(10,0)) AS DECIMAL(30,12))")
    return (f"CAST(CASE WHEN {loops} > 0 THEN {base} * CAST({mult} AS DECIMAL(6,2)) ELSE {base} END "
            f"AS DECIMAL(38,14))")


# Requests priced with the dynamic map (by virtual model) before the static table.
V_PRICED = f"""
SELECT r.*, completion_tokens,
       {cost_sql('prompt_tokens', 'completion_tokens', 'in_eff', 'out_rate', 'buffer', 'mcp_fee',
                 'mcp_calls', 'loop_mult', 'agent_loops')} AS cost_usd
FROM (
  SELECT r.*, greatest(total_tokens - prompt_tokens, 0) AS completion_tokens,
         CASE WHEN cache_hit AND in_rate = 0.14 THEN CAST(0.014 AS DECIMAL(12,6))
              WHEN cache_hit AND in_rate = 0.55 THEN CAST(0.14 AS DECIMAL(12,6))
              ELSE in_rate END AS in_eff
  FROM (
    SELECT r.*,
           coalesce(pm.in_rate, CAST(({rate_case(RATE_CASE_IN, 'r.requested_provider', 'r.model')}) AS DECIMAL(12,6))) AS in_rate,
           coalesce(pm.out_rate, CAST(({rate_case(RATE_CASE_OUT, 'r.requested_provider', 'r.model')}) AS DECIMAL(12,6))) AS out_rate,
           coalesce(pm.buffer, CAST(0 AS DECIMAL(12,6))) AS buffer,
           coalesce(pm.mcp_fee, CAST(0 AS DECIMAL(12,6))) AS mcp_fee,
           coalesce(pm.loop_mult, CAST(1 AS DECIMAL(6,2))) AS loop_mult
    FROM v_requests r LEFT JOIN d_pricing pm ON pm.model = r.model
  ) r
) r
"""


def view_defs() -> dict[str, str]:
    from agentlake.plans import oracle_more
    defs = {
        "v_requests": V_REQUESTS,
        "v_priced": V_PRICED,
        "d_pricing": D.values_sql(D.PRICING_MAP, D.PRICING_COLS, D.PRICING_TYPES),
        "d_routing": D.values_sql(D.routing_rows(), D.ROUTING_COLS, D.ROUTING_TYPES),
    }
    defs.update(oracle_more.defs())
    return defs
