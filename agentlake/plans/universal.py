"""Queries: universal conversation conversion (X5, X6a–c) and schema lookup.

``to_universal`` turns an OpenAI chat payload into the universal struct
(system prompt lifted, roles mapped, text / image / tool-call content, tool
role collapsed into a tool result, empty messages dropped; an unknown role or
unparsable tool arguments make the whole payload an error row). The
``from_universal_*`` jobs render that struct for OpenAI, Anthropic and Gemini.
All of it is array / struct expressions over VARIANT — row-local, no shuffle.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from agentlake.operators.payloads import _arr, _get
from agentlake.plans.registry import query
from agentlake.sources.payloads import payloads

CONTENT = "struct<type:string, text:string, url:string, id:string, name:string, arguments:string, tool_id:string>"
ROLES = ["system", "user", "assistant", "tool", "function"]
# Anthropic defaults and the filler message between equal roles.
ANTHROPIC_DEFAULT_MAX_TOKENS = 4096
DUMMY_TEXT = "<dummy>"


def _c(type_, text=None, url=None, id_=None, name=None, args=None, tool_id=None):
    def s(x):
        return x if x is not None else F.lit(None).cast("string")
    return F.struct(F.lit(type_).alias("type"), s(text).alias("text"), s(url).alias("url"), s(id_).alias("id"),
                    s(name).alias("name"), s(args).alias("arguments"), s(tool_id).alias("tool_id"))


def to_universal(body):
    v = F.try_parse_json(body)
    msgs = _arr(v, "$.messages")
    role = lambda m: _get(m, "$.role", "string")

    def sys_text(m):
        s = F.when(F.schema_of_variant(_get(m, "$.content")) == "STRING", _get(m, "$.content", "string"))
        first = F.try_element_at(F.filter(_arr(m, "$.content"), lambda p: _get(p, "$.type", "string") == "text"),
                                 F.lit(1))
        return F.coalesce(s, _get(first, "$.text", "string"))

    systems = F.filter(F.transform(F.filter(msgs, lambda m: role(m) == "system"), sys_text), lambda x: x.isNotNull())
    system_prompt = F.try_element_at(systems, F.lit(-1))

    def contents(m):
        s = F.when(F.schema_of_variant(_get(m, "$.content")) == "STRING", _get(m, "$.content", "string"))
        text_s = F.when(s.isNotNull() & (s != ""), F.array(_c("text", text=s))).otherwise(F.array().cast(f"array<{CONTENT}>"))
        parts = F.transform(_arr(m, "$.content"), lambda p: F.when(
            (_get(p, "$.type", "string") == "text") & _get(p, "$.text", "string").isNotNull(),
            _c("text", text=_get(p, "$.text", "string")))
            .when((_get(p, "$.type", "string") == "image_url") & _get(p, "$.image_url.url", "string").isNotNull(),
                  _c("image_url", url=_get(p, "$.image_url.url", "string"))))
        parts = F.filter(parts, lambda x: x.isNotNull())
        calls = F.transform(_arr(m, "$.tool_calls"), lambda tc: _c(
            "tool_call", id_=_get(tc, "$.id", "string"), name=_get(tc, "$.function.name", "string"),
            args=F.to_json(F.try_parse_json(_get(tc, "$.function.arguments", "string")))))
        cs = F.concat(text_s, parts, calls)
        is_tool = role(m).isin("tool", "function")
        tid = _get(m, "$.tool_call_id", "string")
        collapsed = F.array(_c("tool_result", text=F.array_join(F.transform(
            F.filter(cs, lambda x: x["type"] == "text"), lambda x: x["text"]), ""), tool_id=tid))
        return F.when(is_tool & tid.isNotNull(), collapsed).otherwise(cs)

    mapped = F.transform(F.filter(msgs, lambda m: role(m) != "system"), lambda m: F.struct(
        F.when(role(m).isin("tool", "function"), F.lit("tool")).otherwise(role(m)).alias("role"),
        contents(m).alias("content")))
    mapped = F.filter(mapped, lambda m: F.size(m["content"]) > 0)
    bad_role = F.exists(msgs, lambda m: ~F.coalesce(role(m).isin(*ROLES), F.lit(False)))
    bad_args = F.exists(msgs, lambda m: F.exists(_arr(m, "$.tool_calls"), lambda tc: F.try_parse_json(
        F.coalesce(_get(tc, "$.function.arguments", "string"), F.lit(""))).isNull()))
    ok = v.isNotNull() & ~bad_role & ~bad_args
    stop = _get(v, "$.stop")
    stops = F.when(F.schema_of_variant(stop) == "STRING", F.array(_get(v, "$.stop", "string"))).otherwise(_get(v, "$.stop", "array<string>"))
    conv = F.struct(system_prompt.alias("system_prompt"), _get(v, "$.model", "string").alias("model"),
                    mapped.alias("messages"), _get(v, "$.tools", "array<variant>").alias("tools"),
                    _get(v, "$.temperature", "double").alias("temperature"), _get(v, "$.top_p", "double").alias("top_p"),
                    _get(v, "$.max_tokens", "int").alias("max_tokens"), stops.alias("stop"), _get(v, "$.stream", "boolean").alias("stream"))
    return F.when(ok, conv)


def _roles(msgs):
    return F.array_join(F.transform(msgs, lambda m: m["role"]), ",")


def _some(array):
    """The array, or NULL if it is empty (the field is then left out)."""
    return F.when(F.size(array) > 0, array)


def _of(m, kind):
    return F.filter(m["content"], lambda c: c["type"] == kind)


def from_universal_openai(u):
    """The request as a struct; ``to_json`` leaves out what is NULL."""
    def message(m):
        texts = F.transform(F.filter(m["content"], lambda c: c["type"].isin("text", "tool_result")), lambda c: c["text"])
        text = F.array_join(texts, "\n")
        calls = F.transform(_of(m, "tool_call"), lambda c: F.struct(
            c["id"].alias("id"), F.lit("function").alias("type"),
            F.struct(c["name"].alias("name"), c["arguments"].alias("arguments")).alias("function")))
        return F.struct(m["role"].alias("role"), F.when(text != "", text).alias("content"), _some(calls).alias("tool_calls"),
                        F.try_element_at(F.transform(_of(m, "tool_result"), lambda c: c["tool_id"]), F.lit(-1)).alias("tool_call_id"))

    body = F.transform(u["messages"], message)
    empty = "array<struct<role:string,content:string,tool_calls:array<struct<id:string,type:string,function:struct<name:string,arguments:string>>>,tool_call_id:string>>"
    system = F.when(u["system_prompt"].isNotNull(), F.from_json(F.to_json(F.array(F.struct(
        F.lit("system").alias("role"), u["system_prompt"].alias("content")))), empty)).otherwise(F.array().cast(empty))
    return F.when(u.isNotNull(), F.struct(F.concat(system, body).alias("messages"), *[u[c].alias(c) for c in (
        "tools", "temperature", "top_p", "max_tokens", "stop", "stream", "model")]))


_BLOCK = ("array<struct<type:string,text:string,source:struct<type:string,media_type:string,data:string>,id:string,name:string,"
          "input:variant,tool_use_id:string,content:string>>")


def _blocks(m):
    """Anthropic content blocks of a universal message."""
    def block(c):
        kind = F.element_at(F.create_map(*[F.lit(x) for x in ("text", "text", "image_url", "image", "tool_call", "tool_use", "tool_result", "tool_result")]), c["type"])
        image = F.when(c["type"] == "image_url", F.struct(F.lit("url").alias("type"), F.lit("image/jpeg").alias("media_type"), c["url"].alias("data")))
        return F.struct(kind.alias("type"), F.when(c["type"] == "text", c["text"]).alias("text"), image.alias("source"),
                        F.when(c["type"] == "tool_call", c["id"]).alias("id"), F.when(c["type"] == "tool_call", c["name"]).alias("name"),
                        F.when(c["type"] == "tool_call", F.try_parse_json(c["arguments"])).alias("input"),
                        F.when(c["type"] == "tool_result", c["tool_id"]).alias("tool_use_id"), F.when(c["type"] == "tool_result", c["text"]).alias("content"))
    return F.transform(m["content"], block)


def from_universal_anthropic(u):
    """System as a field, tool -> user, a filler message between equal
    consecutive roles, tools as name / description / input_schema, max_tokens
    4096 unless given."""
    msgs = F.filter(u["messages"], lambda m: m["role"] != "system")
    roles = F.transform(msgs, lambda m: F.when(m["role"] == "assistant", "assistant").otherwise("user"))
    filler = F.array(F.struct(*[x.alias(n) for n, x in {
        "type": F.lit("text"), "text": F.lit(DUMMY_TEXT), "source": F.lit(None).cast("struct<type:string,media_type:string,data:string>"),
        "id": F.lit(None).cast("string"), "name": F.lit(None).cast("string"), "input": F.lit(None).cast("variant"),
        "tool_use_id": F.lit(None).cast("string"), "content": F.lit(None).cast("string")}.items()]))

    def emit(i):
        r = F.element_at(roles, i)
        real = F.struct(r.alias("role"), _blocks(F.element_at(msgs, i)).alias("content"))
        dummy = F.struct(F.when(r == "user", "assistant").otherwise("user").alias("role"), filler.alias("content"))
        return F.when((i > 1) & (F.element_at(roles, F.greatest(i - 1, F.lit(1))) == r), F.array(dummy, real)).otherwise(F.array(real))

    messages = F.when(F.size(msgs) > 0, F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(F.size(msgs), F.lit(1))), emit))) \
        .otherwise(F.array().cast(f"array<struct<role:string,content:{_BLOCK}>>"))
    usable = F.filter(u["tools"], lambda t: (_get(t, "$.type", "string") == "function") & _get(t, "$.function.name", "string").isNotNull())
    tools = F.transform(usable, lambda t: F.struct(
        _get(t, "$.function.name", "string").alias("name"), F.coalesce(_get(t, "$.function.description", "string"), F.lit("")).alias("description"),
        F.coalesce(_get(t, "$.function.parameters"), F.parse_json(F.lit('{"type":"object","properties":{}}'))).alias("input_schema")))
    return F.when(u.isNotNull(), F.struct(
        u["system_prompt"].alias("system"), messages.alias("messages"), _some(tools).alias("tools"), u["temperature"].alias("temperature"),
        u["top_p"].alias("top_p"), F.coalesce(u["max_tokens"], F.lit(ANTHROPIC_DEFAULT_MAX_TOKENS)).alias("max_tokens"),
        u["stop"].alias("stop_sequences"), u["stream"].alias("stream"), u["model"].alias("model")))


def from_universal_gemini(u):
    """Assistant / tool -> model, others -> user, text parts only,
    systemInstruction, generationConfig only when it has a field."""
    contents = F.transform(u["messages"], lambda m: F.struct(
        F.when(m["role"].isin("assistant", "tool"), "model").otherwise("user").alias("role"),
        F.transform(_of(m, "text"), lambda c: F.struct(c["text"].alias("text"))).alias("parts")))
    system = F.when(u["system_prompt"].isNotNull(), F.struct(F.array(F.struct(u["system_prompt"].alias("text"))).alias("parts")))
    given = u["temperature"].isNotNull() | u["top_p"].isNotNull() | u["max_tokens"].isNotNull() | u["stop"].isNotNull()
    config = F.when(given, F.struct(u["temperature"].alias("temperature"), u["top_p"].alias("topP"),
                                    u["max_tokens"].alias("maxOutputTokens"), u["stop"].alias("stopSequences")))
    return F.when(u.isNotNull(), F.struct(contents.alias("contents"), system.alias("systemInstruction"), config.alias("generationConfig")))


def _openai_payloads(spark, sf_dir):
    return payloads(spark, sf_dir).filter(F.col("format") == "openai")


_EXPECT = """
WITH c AS (SELECT * FROM conversations WHERE conv_id % 5 = 0),
u AS (
  SELECT conv_id,
         arg_max(CASE WHEN role = 'system' THEN text END, CASE WHEN role = 'system' THEN turn END) AS system_prompt,
         string_agg(CASE WHEN role <> 'system' THEN role END, ',' ORDER BY turn) AS roles,
         count(*) FILTER (WHERE role <> 'system') AS n_messages,
         count(*) FILTER (WHERE role = 'assistant' AND (conv_id + turn) % 3 = 0) AS n_tool_calls,
         arg_max(text, turn) FILTER (WHERE role <> 'system') AS last_content
  FROM c GROUP BY conv_id
)
"""


@query("to_universal", sql=_EXPECT + """
SELECT conv_id AS payload_id, CASE WHEN conv_id % 37 = 0 THEN 'error' ELSE 'ok' END AS status,
       CASE WHEN conv_id % 37 <> 0 THEN system_prompt END AS system_prompt,
       CASE WHEN conv_id % 37 <> 0 THEN roles END AS roles,
       CASE WHEN conv_id % 37 <> 0 THEN n_tool_calls END AS n_tool_calls
FROM u
""")
def to_universal_q(spark, sf_dir):
    p = _openai_payloads(spark, sf_dir)
    u = to_universal(F.col("body"))
    n_calls = F.aggregate(F.transform(u["messages"], lambda m: F.size(F.filter(
        m["content"], lambda c: c["type"] == "tool_call"))), F.lit(0), lambda a, b: a + b)
    return p.select("payload_id", F.when(u.isNotNull(), "ok").otherwise("error").alias("status"),
                    u["system_prompt"].alias("system_prompt"), _roles(u["messages"]).alias("roles"),
                    n_calls.cast("bigint").alias("n_tool_calls"))


# The fixture's one tool, keys sorted as VARIANT keeps them.
_PARAMS = ('{"examples":[{"turn":1}],"properties":{"title":{"type":"string"},"turn":{"description":"Turn number","type":"integer"}},'
           '"title":"Lookup","type":"object"}')
_TOOL = '{"function":{"description":"First tool","name":"tool_0","parameters":' + _PARAMS + '},"type":"function"}'
_MODEL = "CASE WHEN conv_id % 41 = 0 THEN '' ELSE ',\"model\":\"gpt-4o\"' END"
# Every payload rebuilt in full from the base columns.
_FULL = _EXPECT + """
, m AS (
  SELECT *, CAST(to_json(text) AS VARCHAR) AS j, role = 'assistant' AND (conv_id + turn) % 3 = 0 AS has_call,
         'call_' || conv_id || '_' || turn AS call_id, 'tool_' || (turn % 4) AS tool, '{"conv":' || conv_id || ',"turn":' || turn || '}' AS args
  FROM c WHERE role <> 'system' AND (text <> '' OR (role = 'assistant' AND (conv_id + turn) % 3 = 0))
)
"""


@query("from_universal_openai", sql=_FULL + f"""
, b AS (SELECT conv_id, string_agg('{{"role":"' || role || '"' || CASE WHEN text <> '' THEN ',"content":' || j ELSE '' END ||
    CASE WHEN has_call THEN ',"tool_calls":[{{"id":"' || call_id || '","type":"function","function":{{"name":"' || tool || '","arguments":'
         || CAST(to_json(args) AS VARCHAR) || '}}}}]' ELSE '' END || '}}', ',' ORDER BY turn) AS msgs FROM m GROUP BY conv_id)
SELECT conv_id AS payload_id, '{{"messages":[' || concat_ws(',', '{{"role":"system","content":' || CAST(to_json(system_prompt) AS VARCHAR) || '}}', msgs) || ']'
  || CASE WHEN conv_id % 2 = 0 THEN ',"tools":[{_TOOL}]' ELSE '' END || {_MODEL} || '}}' AS payload
FROM u LEFT JOIN b USING (conv_id) WHERE conv_id % 37 <> 0
""")
def from_universal_openai_q(spark, sf_dir):
    return _rendered(spark, sf_dir, from_universal_openai)


@query("from_universal_anthropic", sql=_FULL + f"""
, r AS (SELECT *, CASE WHEN role = 'assistant' THEN 'assistant' ELSE 'user' END AS ar,
               lag(CASE WHEN role = 'assistant' THEN 'assistant' ELSE 'user' END) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM m),
b AS (SELECT conv_id, string_agg(
    CASE WHEN prev = ar THEN '{{"role":"' || CASE WHEN ar = 'user' THEN 'assistant' ELSE 'user' END || '","content":[{{"type":"text","text":"{DUMMY_TEXT}"}}]}},' ELSE '' END
    || '{{"role":"' || ar || '","content":[' || concat_ws(',', CASE WHEN text <> '' THEN '{{"type":"text","text":' || j || '}}' END,
       CASE WHEN has_call THEN '{{"type":"tool_use","id":"' || call_id || '","name":"' || tool || '","input":' || args || '}}' END) || ']}}', ',' ORDER BY turn) AS msgs
  FROM r GROUP BY conv_id)
SELECT conv_id AS payload_id, '{{' || CASE WHEN system_prompt IS NULL THEN '' ELSE '"system":' || CAST(to_json(system_prompt) AS VARCHAR) || ',' END
  || '"messages":[' || coalesce(msgs, '') || ']'
  || CASE WHEN conv_id % 2 = 0 THEN ',"tools":[{{"name":"tool_0","description":"First tool","input_schema":{_PARAMS}}}]' ELSE '' END
  || ',"max_tokens":{ANTHROPIC_DEFAULT_MAX_TOKENS}' || {_MODEL} || '}}' AS payload
FROM u LEFT JOIN b USING (conv_id) WHERE conv_id % 37 <> 0
""")
def from_universal_anthropic_q(spark, sf_dir):
    return _rendered(spark, sf_dir, from_universal_anthropic)


@query("from_universal_gemini", sql=_FULL + """
, b AS (SELECT conv_id, string_agg('{"role":"' || CASE WHEN role IN ('assistant', 'tool') THEN 'model' ELSE 'user' END || '","parts":['
    || CASE WHEN text <> '' THEN '{"text":' || j || '}' ELSE '' END || ']}', ',' ORDER BY turn) AS msgs FROM m GROUP BY conv_id)
SELECT conv_id AS payload_id, '{"contents":[' || coalesce(msgs, '') || ']'
  || CASE WHEN system_prompt IS NULL THEN '' ELSE ',"systemInstruction":{"parts":[{"text":' || CAST(to_json(system_prompt) AS VARCHAR) || '}]}' END || '}' AS payload
FROM u LEFT JOIN b USING (conv_id) WHERE conv_id % 37 <> 0
""")
def from_universal_gemini_q(spark, sf_dir):
    return _rendered(spark, sf_dir, from_universal_gemini)


def _rendered(spark, sf_dir, form):
    """The full JSON payload of every convertible request."""
    p = _openai_payloads(spark, sf_dir).select("payload_id", to_universal(F.col("body")).alias("u")).filter(F.col("u").isNotNull())
    return p.select("payload_id", F.to_json(form(F.col("u"))).alias("payload"))



# ------------------------------------------------------------------ X23

def lookup_responses(spark, sf_dir):
    """Responses that ask for a tool's schema: assistant turns with
    ``(conv_id + turn) % 3 == 1`` call get_tool_details for ``tool_<turn % 4>``."""
    from agentlake.sources.tables import read
    c = read(spark, sf_dir, "conversations").filter(
        (F.col("role") == "assistant") & ((F.col("conv_id") + F.col("turn")) % 3 == 1))
    rid = F.col("conv_id") * 10 + F.col("turn")
    args = F.concat(F.lit('{"tool_name":"tool_'), (F.col("turn") % 4).cast("string"), F.lit('"}'))
    body = F.to_json(F.struct(
        F.concat(F.lit("resp-"), rid.cast("string")).alias("id"),
        F.array(F.struct(F.lit(0).alias("index"), F.struct(
            F.lit("assistant").alias("role"),
            F.array(F.struct(F.concat(F.lit("call_"), rid.cast("string"), F.lit("_p")).alias("id"),
                             F.lit("function").alias("type"),
                             F.struct(F.lit("get_tool_details").alias("name"), args.alias("arguments"))
                             .alias("function"))).alias("tool_calls")).alias("message"))).alias("choices")))
    return c.select(rid.alias("response_id"), body.alias("body"))


def _schema_answers():
    import json as _json
    from agentlake.plans.tools import TOOL_REGISTRY
    return {d["name"]: (_json.dumps(d["schema"], sort_keys=True, separators=(",", ":")) if d.get("schema")
                        else _json.dumps({"summary": d["summary"]}, separators=(",", ":"))) for d in TOOL_REGISTRY}


@query("schema_lookup", sql="""
WITH l AS (SELECT conv_id * 10 + turn AS response_id, 'tool_' || (turn % 4) AS tool
           FROM conversations WHERE role = 'assistant' AND (conv_id + turn) % 3 = 1),
a AS (SELECT * FROM (VALUES """ + ", ".join(
    "('{}', '{}')".format(k, v.replace("'", "''")) for k, v in _schema_answers().items()) + """) AS a(tool, content))
SELECT l.response_id, a.tool IS NOT NULL AS intercepted,
       CASE WHEN a.tool IS NOT NULL THEN 'call_' || l.response_id || '_p' END AS tool_call_id, a.content
FROM l LEFT JOIN a USING (tool)
""")
def schema_lookup(spark, sf_dir):
    """When a response's first tool call is get_tool_details for a
    registered tool, answer it from the registry (schema JSON, or the summary
    when there is none) with a synthetic tool message."""
    from agentlake.plans.tools import registry_df
    r = lookup_responses(spark, sf_dir)
    v = F.try_parse_json("body")
    name = F.try_variant_get(v, "$.choices[0].message.tool_calls[0].function.name", "string")
    args = F.try_parse_json(F.coalesce(F.try_variant_get(
        v, "$.choices[0].message.tool_calls[0].function.arguments", "string"), F.lit("{}")))
    q = r.select("response_id", name.alias("called"),
                 F.try_variant_get(args, "$.tool_name", "string").alias("tool"),
                 F.coalesce(F.try_variant_get(v, "$.choices[0].message.tool_calls[0].id", "string"),
                            F.lit("call_phantom")).alias("call_id"))
    reg = registry_df(spark).select(
        F.col("name").alias("tool"),
        F.when(F.col("schema").isNotNull(), F.to_json(F.parse_json("schema")))
         .otherwise(F.to_json(F.struct("summary"))).alias("content"))
    j = q.join(reg, "tool", "left")
    hit = (F.col("called") == "get_tool_details") & F.col("content").isNotNull()
    return j.select("response_id", F.coalesce(hit, F.lit(False)).alias("intercepted"),
                    F.when(hit, F.col("call_id")).alias("tool_call_id"), F.when(hit, F.col("content")).alias("content"))
