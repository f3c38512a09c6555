"""Derived fact tables over the driver's parquet (FIXTURES.md §C).

Each view is a lazy projection of one driver table, so Catalyst prunes the
columns a query does not use and pushes its filters into the parquet scan.
The compressed clock ``sec = event_id * 2`` gives the 60 s rules of the
gateway something to fire on (raw per-user gaps are hours).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from agentlake.sources.tables import memo, read

EPOCH_2024 = 1704067200  # 2024-01-01T00:00:00Z, origin of the compressed clock


def _k() -> Column:
    return F.expr("try_cast(regexp_extract(props, '([0-9]+)', 1) AS INT)")


def _provider_model(k: Column) -> tuple[Column, Column]:
    m6 = k % 6
    provider = (F.when(k >= 98, "openai").when(k >= 96, "acme").when(m6.isin(0, 1), "openai")
                .when(m6 == 2, "anthropic").when(m6 == 3, "gemini")
                .when(m6 == 4, "deepseek").otherwise("groq"))
    model = (F.when(k >= 98, "o1-mini").when(k >= 96, "zero-day-1").when(m6 == 0, "gpt-4o")
             .when(m6 == 1, "gpt-4o-mini").when(m6 == 2, "claude-3-5-sonnet")
             .when(m6 == 3, "gemini-1.5-pro").when(m6 == 4, "deepseek-r1")
             .otherwise("llama-3.3-70b-versatile"))
    return provider, model


@memo
def requests(spark: SparkSession, sf_dir: str, with_parent: bool = False) -> DataFrame:
    """C1 ``v_requests``: the request log (M11) derived from ``events``."""
    ev = read(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value", "props")
    ev = ev.withColumn("k", _k())
    k = F.col("k")
    provider, model = _provider_model(k)
    is_error = F.col("event_type") == "error"
    status = F.when(is_error & (k < 30), 429).when(is_error & (k < 60), 503).otherwise(200)
    hot = is_error & (k >= 60)
    cache_hit = (F.col("event_type") == "view") & (k % 4 == 0)
    prompt = (F.lit(50) + k * 3).cast("bigint")
    df = ev.select(
        "event_id", "ts", "user_id", "event_type", "value", "k",
        (F.col("event_id") * 2).alias("sec"),
        F.concat(F.lit("tr-"), F.col("event_id")).alias("trace_id"),
        F.concat(F.lit("s-"), F.col("user_id")).alias("session_id"),
        F.concat(F.lit("t-"), F.col("user_id") % 8).alias("tenant_id"),
        F.concat(F.lit("team-"), F.col("user_id") % 3).alias("team_id"),
        F.concat(F.lit("key-"), k % 5).alias("api_key_alias"),
        provider.alias("requested_provider"),
        model.alias("model"),
        status.cast("int").alias("status"),
        hot.alias("is_hot_swapped"),
        cache_hit.alias("cache_hit"),
        F.floor(F.col("value") * 10).cast("int").alias("latency_ms"),
        prompt.alias("prompt_tokens"),
        F.when(cache_hit, F.lit(0).cast("bigint"))
         .otherwise(prompt + F.floor("value").cast("bigint")).alias("total_tokens"),
        F.when(F.col("event_type") == "click", 1 + k % 3).otherwise(0).cast("int").alias("mcp_calls"),
        F.when(is_error, k % 2).otherwise(0).cast("int").alias("agent_loops"),
        F.element_at(F.array(F.lit("IN"), F.lit("US"), F.lit("EU"), F.lit(None).cast("string")),
                     (F.col("user_id") % 4 + 1).cast("int")).alias("user_region"),
    )
    df = df.withColumn(
        "executed_provider",
        F.when(F.col("status") != 200, F.lit(""))
         .when(F.col("is_hot_swapped"),
               F.when(F.col("requested_provider") == "openai", "anthropic").otherwise("openai"))
         .otherwise(F.col("requested_provider")))
    if with_parent:
        # Lineage edge: previous request of the same user, unless k % 3 == 0.
        # Bin-local lag: no window spans a whole user.
        from agentlake.operators.ordered import previous_value
        df = previous_value(df, ["user_id"], "sec", "event_id", "trace_id", "_prev_trace", 60)
        df = df.withColumn("parent_trace_id", F.when(k % 3 != 0, F.col("_prev_trace"))).drop("_prev_trace")
    return df


@memo
def guard_calls(spark: SparkSession, sf_dir: str, sessions: int = 8) -> DataFrame:
    """C2 ``v_guard_calls``: one tool call per request, ordered by (sec, event_id)."""
    ev = read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "props")
    k = _k()
    return ev.select(
        "event_id",
        (F.col("event_id") * 2).alias("sec"),
        F.concat(F.lit("g-"), F.col("user_id") % sessions).alias("session_id"),
        F.col("event_type").alias("tool_name"),
        F.concat(F.lit('{"q":"'), F.col("event_type"), F.lit('","nonce":'), k.cast("string"),
                 F.lit("}")).alias("arguments"),
    )


@memo
def cache_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C6 ``v_cache_log``: request bodies keyed by tenant, clock = doc_id seconds."""
    d = read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return d.select(
        "doc_id",
        F.concat(F.lit("t-"), F.col("doc_id") % 4).alias("tenant_id"),
        F.col("text").alias("body"),
        F.col("doc_id").alias("sec"),
        "source",
    )


@memo
def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C3 ``v_attempts`` — one claim per event, six claims per operation 4 s apart."""
    ev = read(spark, sf_dir, "events").select("event_id", "event_type", "value")
    op = F.floor(F.col("event_id") / 6).cast("bigint")
    tools = F.element_at(F.array(F.lit("charge_card"), F.lit("get_balance"), F.lit("update_record")),
                         (op % 3 + 1).cast("int"))
    outcome = (F.when(F.col("event_type").isin("click", "view"), "success")
               .when(F.col("event_type") == "signup", "error")
               .when(F.col("event_type") == "error", "timeout")
               .otherwise("none"))
    return ev.select(
        "event_id",
        op.alias("op"),
        F.concat(F.lit("op-"), op).alias("idempotency_key"),
        F.concat(F.lit("t-"), op % 8).alias("tenant_id"),
        tools.alias("tool_name"),
        (F.col("event_id") * 4).alias("claim_sec"),
        (F.floor("value").cast("bigint") % 15).alias("delay_sec"),
        outcome.alias("outcome"),
        (op % 4).cast("int").alias("ledger_class"),
    )


# Fixed values (ours): what is recorded for an operation, six rows each. "c@5" is a claim
# five seconds in, "s1@3" the success of the attempt with version 1, "e" an error, "u" an unknown outcome.
EXECUTION_PATTERNS = [
    "c@0 s1@3 c@5 c@9 c@14 c@200",       # five claims, one execution
    "c@0 c@4 s1@6 c@8 e1@9 c@12",        # a claim in flight does not fence the live attempt; a success stays
    "c@0 c@9 c@11 s1@12 s2@14 c@15",     # a refused claim does not renew the lease
    "c@0 e1@2 c@3 s1@4 s2@6 c@7",        # a success of the attempt before is fenced
    "c@0 u1@5 c@6 c@7 s1@8 c@9",         # an unknown outcome, by ledger and kind of tool
    "c@0 u1@4 s1@5 c@6 e1@7 c@8",        # a success does not overwrite an unknown outcome
    "c@0 e1@3 s1@4 c@5 u1@6 c@7",        # a success overwrites an error
    "c@0 s1@5 c@304 c@305 s1@306 c@307", # the entry ends 300 s after its last write
    "s1@0 c@1 c@12 c@23 e3@24 c@25",     # a completion without an entry; leases run out
    "c@0 c@5 c@10 c@11 c@21 c@22",       # a lease holds to its last second
    "c@0 e1@1 c@2 e2@3 c@4 u3@5",        # errors raise the version
    "c@0 e1@2 c@3 u2@6 c@7 c@400",       # an unknown outcome is forgotten too
]
EXECUTION_TOOLS = ("charge_card", "get_balance", "update_record")


def execution_patterns() -> list[tuple]:
    """(pattern, slot, kind, offset, version, outcome) of all patterns."""
    outcomes = {"s": "success", "e": "error", "u": "timeout"}
    out = []
    for p, line in enumerate(EXECUTION_PATTERNS):
        for slot, item in enumerate(line.split()):
            what, at = item.split("@")
            out.append((p, slot, "claim", int(at), None, None) if what == "c" else (p, slot, "completion", int(at), int(what[1:]), outcomes[what[0]]))
    return out


def execution_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C3 ``v_execution_log`` — six recorded rows per operation: claims, and completions of attempts that ran."""
    ev = read(spark, sf_dir, "events").select("event_id")
    op = F.floor(F.col("event_id") / 6).cast("bigint")
    n = len(EXECUTION_PATTERNS)
    patterns = spark.createDataFrame(execution_patterns(), "pattern long, slot long, kind string, off long, version long, outcome string")
    rows = ev.select("event_id", op.alias("op"), (op % n).alias("pattern"), (F.col("event_id") % 6).alias("slot")).join(F.broadcast(patterns), ["pattern", "slot"])
    turn = F.floor(F.col("op") / n).cast("bigint")
    return rows.select("event_id", F.concat(F.lit("op-"), "op").alias("idempotency_key"), "kind", (F.col("op") * 24 + F.col("off")).alias("at_sec"), "version", "outcome",
                       (turn % 3).alias("tool_class"), (F.floor(turn / 3).cast("bigint") % 4).alias("ledger_class"))


# Fixed values (ours): tool catalogue used to label tool-call facts.
TOOL_NAMES = ["get_balance", "list_orders", "charge_card", "search_docs", "update_record", "read_file",
              "query_db", "create_ticket", "transfer_funds", "describe_table", "show_logs", "get_payment"]
# Fixed values (ours): result bodies by outcome class (p = l_partkey % 10).
RESULT_CONTENT = {
    0: "MCP_TIMEOUT: tool call exceeded deadline",
    1: "endpoint unreachable",
    2: "tool not configured",
    3: "ALREADY_IN_FLIGHT: operation is running",
    4: "PREVIOUS_ATTEMPT_UNKNOWN: retry blocked",
    5: "request timed out upstream",
    6: "error: HTTP TIMEOUT from tool",
}


@memo
def tool_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tool-call results (M6) from ``lineitem``: one order = one fan-out batch.

    ``(l_orderkey, l_linenumber)`` is not unique in the driver data, so no
    operator treats it as a key.
    """
    li = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
                                                "l_quantity", "l_returnflag")
    p = F.col("l_partkey") % 10
    content = F.concat(F.lit('{"ok":true,"rows":'), F.col("l_suppkey").cast("string"), F.lit("}"))
    for code in sorted(RESULT_CONTENT, reverse=True):
        content = F.when(p == code, F.lit(RESULT_CONTENT[code])).otherwise(content)
    latency = (F.floor("l_quantity").cast("bigint") * 37 + F.col("l_linenumber") * 11).cast("bigint")
    start = (F.col("l_linenumber") * 5).cast("bigint")
    return li.select(
        F.col("l_orderkey").alias("batch_id"),
        F.col("l_linenumber").alias("call_index"),
        F.concat(F.lit("t-"), F.col("l_orderkey") % 8).alias("tenant_id"),
        F.element_at(F.array(*[F.lit(t) for t in TOOL_NAMES]), (F.col("l_partkey") % 12 + 1).cast("int"))
         .alias("tool_name"),
        latency.alias("latency_ms"),
        start.alias("start_ms"),
        (start + latency).alias("end_ms"),
        ((p >= 7) & (F.col("l_returnflag") != "R")).alias("success"),
        content.alias("content"),
    )


# Fixed values (ours): API-key prefixes assigned by user_id % 5 (the last one is not a gateway key).
KEY_PREFIX_BY_USER = ["ke_live_", "ke_test_", "re_live_", "re_test_", "sk-"]


@memo
def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tool calls with their trace context and request headers, from ``events``.

    Arguments are written with unsorted keys and a float literal so the
    canonical form has work to do; execution batches group 50 events of a user.
    """
    ev = read(spark, sf_dir, "events").select("event_id", "user_id", "props")
    k = _k()
    ev = ev.withColumn("k", k)
    k = F.col("k")
    u = F.col("user_id").cast("string")
    args = F.concat(F.lit('{"user":"u'), u, F.lit('","amount":'), k.cast("string"), F.lit(',"meta":{"b":'),
                    (k % 7).cast("string"), F.lit(',"a":'), (k % 3).cast("string"), F.lit('},"price":'),
                    (k % 10).cast("string"), F.lit('.0}'))
    session = (F.when(k % 6 == 0, F.concat(F.lit(" sess-"), u, F.lit(" "))).when(k % 6 == 1, "null")
               .when(k % 6 == 2, " None ").when(k % 6 == 3, "undefined").when(k % 6 == 4, ""))
    return ev.select(
        "event_id", "user_id", "k",
        (F.col("event_id") * 2).alias("sec"),
        F.concat(F.lit("call_"), F.col("event_id")).alias("call_id"),
        F.when(k % 7 == 0, F.concat(F.lit("c-"), (F.col("user_id") % 5).cast("string"))).alias("tenant_claim"),
        F.when(k % 4 == 1, F.concat(F.lit("  t-"), (F.col("user_id") % 8).cast("string"), F.lit(" ")))
         .when(k % 4 == 2, F.lit("   ")).alias("tenant_header"),
        session.alias("provided_session"),
        F.when(k % 4 == 0, F.concat(F.lit("idem-"), u)).alias("idem_header"),
        F.concat(F.element_at(F.array(*[F.lit(p) for p in KEY_PREFIX_BY_USER]),
                              (F.col("user_id") % 5 + 1).cast("int")), F.lpad(u, 6, "0")).alias("api_key"),
        F.element_at(F.array(*[F.lit(t) for t in TOOL_NAMES]), (k % 12 + 1).cast("int")).alias("tool_name"),
        args.alias("arguments"),
        F.concat(F.lit("exec-"), u, F.lit("-"), F.floor(F.col("event_id") / 50).cast("string")).alias("execution_id"),
        F.when(k % 5 == 0, F.concat(F.lit("op-"), F.col("event_id"))).alias("trace_op_id"),
    )
