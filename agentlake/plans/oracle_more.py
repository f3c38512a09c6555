"""More DuckDB oracle views (tool results, guard calls, cache log, attempts)."""

from __future__ import annotations

V_TOOL_RESULTS = """
SELECT l_orderkey AS batch_id, l_linenumber AS call_index,
       't-' || (l_orderkey % 8) AS tenant_id,
       (['get_balance', 'list_orders', 'charge_card', 'search_docs', 'update_record', 'read_file',
         'query_db', 'create_ticket', 'transfer_funds', 'describe_table', 'show_logs',
         'get_payment'])[l_partkey % 12 + 1] AS tool_name,
       CAST(CAST(floor(l_quantity) AS BIGINT) * 37 + l_linenumber * 11 AS BIGINT) AS latency_ms,
       CAST(l_linenumber * 5 AS BIGINT) AS start_ms,
       CAST(l_linenumber * 5 + CAST(floor(l_quantity) AS BIGINT) * 37 + l_linenumber * 11 AS BIGINT) AS end_ms,
       (l_partkey % 10 >= 7 AND l_returnflag <> 'R') AS success,
       CASE l_partkey % 10
            WHEN 0 THEN 'MCP_TIMEOUT: tool call exceeded deadline'
            WHEN 1 THEN 'endpoint unreachable'
            WHEN 2 THEN 'tool not configured'
            WHEN 3 THEN 'ALREADY_IN_FLIGHT: operation is running'
            WHEN 4 THEN 'PREVIOUS_ATTEMPT_UNKNOWN: retry blocked'
            WHEN 5 THEN 'request timed out upstream'
            WHEN 6 THEN 'error: HTTP TIMEOUT from tool'
            ELSE '{"ok":true,"rows":' || l_suppkey || '}' END AS content
FROM lineitem
"""

V_GUARD_CALLS = """
SELECT event_id, event_id * 2 AS sec, 'g-' || (user_id % 8) AS session_id, event_type AS tool_name,
       '{"q":"' || event_type || '","nonce":' || TRY_CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) || '}'
           AS arguments
FROM events
"""

V_CACHE_LOG = """
SELECT doc_id, 't-' || (doc_id % 4) AS tenant_id, text AS body, doc_id AS sec, source FROM documents
"""

V_ATTEMPTS = """
SELECT event_id, CAST(floor(event_id / 6) AS BIGINT) AS op,
       'op-' || CAST(floor(event_id / 6) AS BIGINT) AS idempotency_key,
       't-' || (CAST(floor(event_id / 6) AS BIGINT) % 8) AS tenant_id,
       (['charge_card', 'get_balance', 'update_record'])[CAST(floor(event_id / 6) AS BIGINT) % 3 + 1] AS tool_name,
       event_id * 4 AS claim_sec,
       CAST(floor(value) AS BIGINT) % 15 AS delay_sec,
       CASE WHEN event_type IN ('click', 'view') THEN 'success' WHEN event_type = 'signup' THEN 'error'
            WHEN event_type = 'error' THEN 'timeout' ELSE 'none' END AS outcome,
       CAST(CAST(floor(event_id / 6) AS BIGINT) % 4 AS INTEGER) AS ledger_class
FROM events
"""


def _execution_log() -> str:
    from agentlake.sources.views import EXECUTION_PATTERNS, execution_patterns
    text = lambda x: "NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x)
    values = ", ".join("(" + ", ".join(map(text, r)) + ")" for r in execution_patterns())
    n = len(EXECUTION_PATTERNS)
    op, turn = "CAST(floor(event_id / 6) AS BIGINT)", f"CAST(floor(floor(event_id / 6) / {n}) AS BIGINT)"
    return f"""
SELECT event_id, 'op-' || {op} AS idempotency_key, p.kind, {op} * 24 + p.off AS at_sec, CAST(p.version AS BIGINT) AS version, p.outcome,
       {turn} % 3 AS tool_class, CAST(floor({turn} / 3) AS BIGINT) % 4 AS ledger_class
FROM events JOIN (VALUES {values}) p(pattern, slot, kind, off, version, outcome) ON p.pattern = {op} % {n} AND p.slot = event_id % 6
"""


def defs() -> dict[str, str]:
    d = {
        "v_tool_results": V_TOOL_RESULTS,
        "v_guard_calls": V_GUARD_CALLS,
        "v_cache_log": V_CACHE_LOG,
        "v_attempts": V_ATTEMPTS,
        "v_execution_log": _execution_log(),
    }
    d.update(_more())
    return d

V_CALLS = """
SELECT event_id, user_id, k, event_id * 2 AS sec, 'call_' || event_id AS call_id,
       CASE WHEN k % 7 = 0 THEN 'c-' || (user_id % 5) END AS tenant_claim,
       CASE WHEN k % 4 = 1 THEN '  t-' || (user_id % 8) || ' ' WHEN k % 4 = 2 THEN '   ' END AS tenant_header,
       CASE WHEN k % 6 = 0 THEN ' sess-' || user_id || ' ' WHEN k % 6 = 1 THEN 'null' WHEN k % 6 = 2 THEN ' None '
            WHEN k % 6 = 3 THEN 'undefined' WHEN k % 6 = 4 THEN '' END AS provided_session,
       CASE WHEN k % 4 = 0 THEN 'idem-' || user_id END AS idem_header,
       (['ke_live_', 'ke_test_', 're_live_', 're_test_', 'sk-'])[user_id % 5 + 1] || lpad(CAST(user_id AS VARCHAR), 6, '0')
           AS api_key,
       (['get_balance', 'list_orders', 'charge_card', 'search_docs', 'update_record', 'read_file',
         'query_db', 'create_ticket', 'transfer_funds', 'describe_table', 'show_logs', 'get_payment'])[k % 12 + 1]
           AS tool_name,
       '{"amount":' || k || ',"meta":{"a":' || (k % 3) || ',"b":' || (k % 7) || '},"price":' || (k % 10)
           || '.0,"user":"u' || user_id || '"}' AS canonical_args,
       '{"user":"u' || user_id || '","amount":' || k || ',"meta":{"b":' || (k % 7) || ',"a":' || (k % 3)
           || '},"price":' || (k % 10) || '.0}' AS arguments,
       'exec-' || user_id || '-' || CAST(floor(event_id / 50) AS BIGINT) AS execution_id,
       CASE WHEN k % 5 = 0 THEN 'op-' || event_id END AS trace_op_id
FROM (SELECT *, TRY_CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events)
"""


def _more():
    return {"v_calls": V_CALLS}
