"""Queries: tool-result formatting, result attachment, stream-chunk unification."""

from __future__ import annotations

from pyspark.sql import functions as F

from agentlake.operators import responses as RS
from agentlake.plans.registry import query
from agentlake.sources.chunks import chunks
from agentlake.sources.responses import responses

# Fixed values (ours): result content per tool; tool_3 is not configured, tool_2's
# previous attempt is unknown.
_RESULT = {"tool_3": "tool not configured", "tool_2": '{"error":"PREVIOUS_ATTEMPT_UNKNOWN"}'}
PROVIDERS = ["openai", "anthropic", "gemini", "cohere", "bedrock"]


def tool_results_for_calls(spark, sf_dir):
    """One result per extracted response call (X3), in call order."""
    r = responses(spark, sf_dir)
    parts = [RS.response_tool_calls(r.filter(F.col("provider") == p), p).withColumn("provider", F.lit(p))
             for p in PROVIDERS]
    calls = parts[0]
    for p in parts[1:]:
        calls = calls.unionByName(p)
    content = F.coalesce(F.element_at(F.create_map(*[x for k, v in _RESULT.items() for x in (F.lit(k), F.lit(v))]),
                                      F.col("tool_name")),
                         F.concat(F.lit("result of "), F.col("tool_name"), F.lit(" for "), F.col("call_id")))
    ok = ~F.col("tool_name").isin("tool_3")
    return calls.withColumn("content", content).withColumn("success", ok)


def _shape(provider: str):
    cid, c, ok = F.col("call_id"), F.col("content"), F.col("success")
    if provider == "openai":
        return F.struct(F.lit("tool").alias("role"), cid.alias("tool_call_id"), c.alias("content"))
    if provider == "anthropic":
        return F.struct(F.lit("tool_result").alias("type"), cid.alias("tool_use_id"), c.alias("content"),
                        (~ok).alias("is_error"))
    if provider == "gemini":
        return F.struct(F.struct(cid.alias("name"), F.struct(cid.alias("name"), c.alias("content")).alias("response"))
                        .alias("functionResponse"))
    if provider == "cohere":
        return F.struct(F.struct(cid.alias("name"), F.create_map().cast("map<string,string>").alias("parameters"))
                        .alias("call"), F.array(F.struct(c.alias("result"))).alias("outputs"))
    return F.struct(F.struct(cid.alias("toolUseId"), F.array(F.struct(c.alias("text"))).alias("content"),
                             F.when(ok, "success").otherwise("error").alias("status")).alias("toolResult"))


def _duck_shape(provider: str) -> str:
    c = "replace(content, '\"', '\\\"')"
    if provider == "openai":
        return "'{\"role\":\"tool\",\"tool_call_id\":\"' || call_id || '\",\"content\":\"' || " + c + " || '\"}'"
    if provider == "anthropic":
        return ("'{\"type\":\"tool_result\",\"tool_use_id\":\"' || call_id || '\",\"content\":\"' || " + c
                + " || '\",\"is_error\":' || CASE WHEN success THEN 'false' ELSE 'true' END || '}'")
    if provider == "gemini":
        return ("'{\"functionResponse\":{\"name\":\"' || call_id || '\",\"response\":{\"name\":\"' || call_id"
                " || '\",\"content\":\"' || " + c + " || '\"}}}'")
    if provider == "cohere":
        return ("'{\"call\":{\"name\":\"' || call_id || '\",\"parameters\":{}},\"outputs\":[{\"result\":\"' || "
                + c + " || '\"}]}'")
    return ("'{\"toolResult\":{\"toolUseId\":\"' || call_id || '\",\"content\":[{\"text\":\"' || " + c
            + " || '\"}],\"status\":\"' || CASE WHEN success THEN 'success' ELSE 'error' END || '\"}}'")


_CALLS_SQL = """
WITH calls AS (
  SELECT conv_id * 10 + turn AS response_id,
         (['openai', 'anthropic', 'gemini', 'cohere', 'bedrock'])[conv_id % 5 + 1] AS provider,
         CASE WHEN conv_id % 5 IN (0, 1, 4) THEN 'call_' || conv_id || '_' || turn ELSE 'tool_' || (turn % 4) END
             AS call_id,
         'tool_' || (turn % 4) AS tool_name
  FROM conversations
  WHERE role = 'assistant' AND (conv_id + turn) % 3 = 0 AND (conv_id % 5 = 3 OR (conv_id * 10 + turn) % 13 <> 0)
), res AS (
  SELECT *, CASE tool_name WHEN 'tool_3' THEN 'tool not configured'
                           WHEN 'tool_2' THEN '{"error":"PREVIOUS_ATTEMPT_UNKNOWN"}'
                           ELSE 'result of ' || tool_name || ' for ' || call_id END AS content,
         tool_name <> 'tool_3' AS success
  FROM calls
)
"""


@query("format_results", sql=_CALLS_SQL + """
SELECT response_id, provider, '[' || CASE provider """ + " ".join(
    f"WHEN '{p}' THEN {_duck_shape(p)}" for p in PROVIDERS) + """ END || ']' AS results_json
FROM res
""")
def format_results(spark, sf_dir):
    """The tool results of each response in its provider's shape, one JSON array per response."""
    t = tool_results_for_calls(spark, sf_dir)
    shaped = None
    for p in PROVIDERS:
        part = (t.filter(F.col("provider") == p)
                .select("response_id", "provider", "call_index", F.to_json(_shape(p)).alias("item")))
        shaped = part if shaped is None else shaped.unionByName(part)
    # one response's results: bounded by its tool calls
    g = shaped.groupBy("response_id", "provider").agg(F.array_sort(F.collect_list(F.struct("call_index", "item")))
                                                      .alias("items"))
    return g.select("response_id", "provider",
                    F.concat(F.lit("["), F.array_join(F.transform("items", lambda x: x["item"]), ","), F.lit("]"))
                    .alias("results_json"))


def _body_sql() -> str:
    """The provider's whole response, from the base columns."""
    opt = lambda c, x: f"CASE WHEN {c} THEN {x} ELSE '' END"
    openai = ("""'{"id":"resp-' || response_id || '","model":"gpt-4o","choices":[{"index":0,"message":{"role":"assistant","content":' || j || """
              + opt("has_call", """',"tool_calls":[{"id":"' || cid || '","type":"function","function":{"name":"' || tool || '","arguments":' || CAST(to_json(args) AS VARCHAR) || '}}' || """
                    + opt("broken", """',{"id":"' || cid || '_b","type":"function"}'""") + " || ']'")
              + """ || '},"finish_reason":"' || CASE WHEN has_call THEN 'tool_calls' ELSE 'stop' END || '"}],"usage":{"prompt_tokens":' || p || ',"completion_tokens":' || n || ',"total_tokens":' || (p + n) || '}}'""")
    anthropic = ("""'{"id":"resp-' || response_id || '","type":"message","role":"assistant","model":"claude-3-5-sonnet","content":[{"type":"text","text":' || j || '}' || """
                 + opt("has_call", """',{"type":"tool_use","id":"' || cid || '","name":"' || tool || '","input":' || args || '}' || """ + opt("broken", """',{"type":"tool_use","name":"' || tool || '","input":{}}'"""))
                 + """ || '],"stop_reason":"' || CASE WHEN has_call THEN 'tool_use' ELSE 'end_turn' END || '","usage":{"input_tokens":' || p || ',"output_tokens":' || n || '}}'""")
    gemini = ("""'{"candidates":[{"content":{"role":"model","parts":[{"text":' || j || '}' || """
              + opt("has_call", """',{"functionCall":{"name":"' || tool || '","args":' || args || '}}' || """ + opt("broken", """',{"functionCall":{"args":{}}}'"""))
              + """ || ']},"finishReason":"STOP"}]}'""")
    cohere = ("""'{"text":' || j || """ + opt("has_call", """',"tool_calls":[{"name":"' || tool || '","parameters":' || args || '}' || """ + opt("broken", """',{"parameters":{}}'""") + " || ']'")
              + """ || ',"finish_reason":"' || CASE WHEN has_call THEN 'TOOL_CALL' ELSE 'COMPLETE' END || '"}'""")
    bedrock = ("""'{"output":{"message":{"role":"assistant","content":[{"text":' || j || '}' || """
               + opt("has_call", """',{"toolUse":{"toolUseId":"' || cid || '","name":"' || tool || '","input":' || args || '}}' || """ + opt("broken", """',{"toolUse":{"name":"' || tool || '","input":{}}}'"""))
               + """ || ']}},"stopReason":"' || CASE WHEN has_call THEN 'tool_use' ELSE 'end_turn' END || '"}'""")
    return f"""
SELECT response_id, CASE fmt WHEN 0 THEN {openai} WHEN 1 THEN {anthropic} WHEN 2 THEN {gemini} WHEN 3 THEN {cohere} ELSE {bedrock} END AS body
FROM (SELECT conv_id * 10 + turn AS response_id, conv_id % 5 AS fmt, CAST(to_json(text) AS VARCHAR) AS j, (conv_id + turn) % 3 = 0 AS has_call,
             (conv_id + turn) % 3 = 0 AND (conv_id * 10 + turn) % 13 = 0 AS broken, 'call_' || conv_id || '_' || turn AS cid, 'tool_' || (turn % 4) AS tool,
             '{{"turn":' || turn || ',"conv":' || conv_id || '}}' AS args, 10 + turn AS p, len(string_split(text, ' ')) AS n
      FROM conversations WHERE role = 'assistant')"""


@query("attach_results", sql=_CALLS_SQL + f""", b AS ({_body_sql()}),
g AS (SELECT response_id, count(*) FILTER (WHERE NOT contains(content, 'PREVIOUS_ATTEMPT_UNKNOWN')) AS attached,
             count(*) FILTER (WHERE contains(content, 'PREVIOUS_ATTEMPT_UNKNOWN')) AS dropped,
             string_agg(CASE provider {' '.join(f"WHEN '{p}' THEN {_duck_shape(p)}" for p in PROVIDERS)} END, ',') FILTER (WHERE NOT contains(content, 'PREVIOUS_ATTEMPT_UNKNOWN')) AS items
      FROM res GROUP BY response_id)
SELECT b.response_id, coalesce(attached, 0) AS attached, coalesce(dropped, 0) AS dropped,
       CASE WHEN items IS NULL THEN body ELSE left(body, length(body) - 1) || ',"tool_results":[' || items || ']}}' END AS body
FROM b LEFT JOIN g USING (response_id)
""")
def attach_results(spark, sf_dir):
    """Every response with its tool results, in the provider's shape, added as
    ``tool_results``; PREVIOUS_ATTEMPT_UNKNOWN results are dropped, and a response without
    results stays as it is."""
    t = tool_results_for_calls(spark, sf_dir)
    flagged = F.col("content").contains("PREVIOUS_ATTEMPT_UNKNOWN")
    item = F.coalesce(*[F.when(F.col("provider") == p, F.to_json(_shape(p))) for p in PROVIDERS])
    # one response's results: bounded by its tool calls
    g = t.groupBy("response_id").agg(F.count_if(~flagged).alias("attached"), F.count_if(flagged).alias("dropped"),
                                     F.array_sort(F.collect_list(F.when(~flagged, F.struct("call_index", item.alias("item"))))).alias("items"))
    joined = responses(spark, sf_dir).select("response_id", "body").join(g, "response_id", "left")
    results = F.concat(F.lit("["), F.array_join(F.transform("items", lambda x: x["item"]), ","), F.lit("]"))
    return joined.select("response_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("attached", "dropped")],
                         F.when(F.size("items") > 0, RS.with_field(F.col("body"), "tool_results", results)).otherwise(F.col("body")).alias("body"))


def raw_anthropic_events(spark, sf_dir):
    """Anthropic SSE lines for the odd streams: deltas, a ping after every 5th
    piece, message_stop at the end; ``[DONE]``/usage lines are not Anthropic's."""
    c = chunks(spark, sf_dir).filter((F.col("stream_id") % 2 == 1) & F.col("data").startswith('{"delta"'))
    text = F.try_variant_get(F.try_parse_json("data"), "$.delta.text", "string")
    delta = F.concat(F.lit("data: "), F.to_json(F.struct(
        F.lit("content_block_delta").alias("type"), F.lit(0).alias("index"),
        F.struct(F.lit("text_delta").alias("type"), text.alias("text")).alias("delta"))))
    ev = c.select("stream_id", (F.col("seq") * 2).alias("seq"), delta.alias("line"))
    ping = c.filter(F.col("seq") % 5 == 4).select("stream_id", (F.col("seq") * 2 + 1).alias("seq"),
                                                  F.lit('data: {"type":"ping"}').alias("line"))
    stop = c.groupBy("stream_id").agg((F.max("seq") * 2 + 2).alias("seq")).select(
        "stream_id", "seq", F.lit('data: {"type":"message_stop"}').alias("line"))
    return ev.unionByName(ping).unionByName(stop)


def unify_anthropic_chunk(line):
    """content_block_delta -> OpenAI delta chunk, message_stop -> [DONE], other events -> ''."""
    body = F.trim(F.regexp_replace(line, "^data: ", ""))
    v = F.try_parse_json(body)
    typ = F.try_variant_get(v, "$.type", "string")
    chunk = F.concat(F.lit("data: "), F.to_json(F.struct(
        F.lit("chatcmpl-stream").alias("id"), F.lit("chat.completion.chunk").alias("object"), F.lit(0).alias("created"),
        F.lit("claude").alias("model"),
        F.array(F.struct(F.lit(0).alias("index"),
                         F.struct(F.coalesce(F.try_variant_get(v, "$.delta.text", "string"), F.lit("")).alias("content"))
                         .alias("delta"), F.lit(None).cast("string").alias("finish_reason"))).alias("choices")),
        {"ignoreNullFields": "false"}))
    return (F.when(~line.startswith("data: ") | (line == "data: [DONE]"), line)
            .when(body == "", line)
            .when(v.isNull(), F.lit(""))
            .when(typ == "content_block_delta", chunk)
            .when(typ == "message_stop", F.lit("data: [DONE]"))
            .otherwise(F.lit("")))


def unify_gemini_chunk(line):
    """Data lines pass, everything else (event names, comments) is dropped."""
    return F.when(line.startswith("data: "), line).otherwise(F.lit(""))


@query("unify_chunk", sql="""
WITH a AS (SELECT conv_id * 10 + turn AS stream_id, text, string_split(text, ' ') AS toks
           FROM conversations WHERE role = 'assistant' AND (conv_id * 10 + turn) % 2 = 1),
p AS (SELECT stream_id, unnest(toks) AS tok, unnest(range(1, len(toks) + 1)) AS i, len(toks) AS n,
             (stream_id % 11 = 0 AND len(toks) >= 2) AS err FROM a),
s AS (SELECT stream_id, i, n, err, CASE WHEN i < n THEN tok || ' ' ELSE tok END AS piece,
             (i - 1) + CASE WHEN err AND i - 1 >= n // 2 THEN 1 ELSE 0 END AS seq FROM p)
SELECT stream_id, seq * 2 AS seq,
       'data: {"id":"chatcmpl-stream","object":"chat.completion.chunk","created":0,"model":"claude","choices":[{"index":0,"delta":{"content":"'
       || replace(piece, chr(10), '\\n') || '"},"finish_reason":null}]}' AS unified
FROM s
UNION ALL SELECT stream_id, seq * 2 + 1, '' FROM s WHERE seq % 5 = 4
UNION ALL SELECT stream_id, max(seq) * 2 + 2, 'data: [DONE]' FROM s GROUP BY stream_id
""")
def unify_chunk(spark, sf_dir):
    e = raw_anthropic_events(spark, sf_dir)
    return e.select("stream_id", F.col("seq").cast("bigint").alias("seq"), unify_anthropic_chunk(F.col("line")).alias("unified"))
