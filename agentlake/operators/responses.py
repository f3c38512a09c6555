"""Provider response jobs (X3a–e, X4, X7, P24).

Each provider extractor yields, per candidate call, a status ``ok`` /
``skip`` / ``error``; a single ``error`` turns the whole response into an
empty call list (the gateway swallows the parse error). Argument text is
reported in canonical (key-sorted) form for object arguments and parsed
string arguments, so equal arguments compare equal whatever the order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agentlake.operators.payloads import _arr, _get

CALL = "struct<status:string, call_id:string, tool_name:string, arguments:string>"


def _args_text(a: Column) -> Column:
    """String arguments as given (canonicalised when they parse), objects as JSON, absent '{}'."""
    s = F.when(F.schema_of_variant(a) == "STRING", _get(a, "$", "string"))
    canon_s = F.coalesce(F.to_json(F.try_parse_json(s)), s)
    return F.when(a.isNull(), F.lit("{}")).when(s.isNotNull(), canon_s).otherwise(F.to_json(a))


def _mk(status, cid=None, name=None, args=None) -> Column:
    return F.struct(F.lit(status).alias("status") if isinstance(status, str) else status.alias("status"),
                    (cid if cid is not None else F.lit(None).cast("string")).alias("call_id"),
                    (name if name is not None else F.lit(None).cast("string")).alias("tool_name"),
                    (args if args is not None else F.lit(None).cast("string")).alias("arguments"))


def _finish(calls: Column) -> Column:
    ok = F.filter(calls, lambda x: x["status"] == "ok")
    return F.when(F.exists(calls, lambda x: x["status"] == "error"), F.array().cast(f"array<{CALL}>")).otherwise(ok)


def _is_array(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith("ARRAY"), F.lit(False))


def _first_array(*cands: Column) -> Column:
    out = F.lit(None).cast("array<variant>")
    for c in reversed(cands):
        out = F.when(c.isNotNull(), c).otherwise(out)
    return out


def openai_calls(v: Column) -> Column:
    def parse(tc):
        fid = _get(tc, "$.id", "string")
        fn = _get(tc, "$.function")
        name = _get(tc, "$.function.name", "string")
        st = F.when(fid.isNull(), "skip").when(fn.isNull() | name.isNull(), "error").otherwise("ok")
        return _mk(st, fid, name, _args_text(_get(tc, "$.function.arguments")))

    first = _get(v, "$.choices[0]")
    msg = F.coalesce(_get(first, "$.message"), _get(first, "$.delta"))
    in_choice = F.when(first.isNotNull(), F.try_variant_get(msg, "$.tool_calls", "array<variant>"))
    root = F.coalesce(F.try_variant_get(v, "$.tool_calls", "array<variant>"),
                      F.try_variant_get(v, "$.message.tool_calls", "array<variant>"))
    whole = F.when(_is_array(v), F.try_variant_get(v, "$", "array<variant>"))
    arr = _first_array(in_choice, root, whole, F.array(v))
    return _finish(F.transform(arr, parse))


def anthropic_calls(v: Column) -> Column:
    def parse(b):
        t = _get(b, "$.type", "string")
        req = _get(b, "$.id", "string").isNull() | _get(b, "$.name", "string").isNull() | _get(b, "$.input").isNull()
        st = F.when(F.coalesce(t, F.lit("")) != "tool_use", "skip").when(req, "error").otherwise("ok")
        return _mk(st, _get(b, "$.id", "string"), _get(b, "$.name", "string"), _args_text(_get(b, "$.input")))

    is_obj = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    content = F.try_variant_get(v, "$.content", "array<variant>")
    single = F.when(is_obj & content.isNull() & (_get(v, "$.type", "string") == "tool_use"), F.array(v))
    arr = F.when(is_obj, F.coalesce(content, single, F.array().cast("array<variant>"))) \
        .when(_is_array(v), F.try_variant_get(v, "$", "array<variant>"))
    bad_root = ~is_obj & ~_is_array(v)
    return F.when(bad_root | v.isNull(), F.array().cast(f"array<{CALL}>")).otherwise(_finish(F.transform(arr, parse)))


def gemini_calls(v: Column) -> Column:
    def parse(p):
        fc = _get(p, "$.functionCall")
        name = _get(p, "$.functionCall.name", "string")
        cid = F.coalesce(_get(p, "$.functionCall.id", "string"), _get(p, "$.id", "string"), name)
        st = F.when(fc.isNull(), "skip").when(name.isNull(), "error").otherwise("ok")
        return _mk(st, cid, name, _args_text(_get(p, "$.functionCall.args")))

    in_cand = F.when(_get(v, "$.candidates[0]").isNotNull(),
                     F.try_variant_get(v, "$.candidates[0].content.parts", "array<variant>"))
    parts = F.coalesce(F.try_variant_get(v, "$.parts", "array<variant>"),
                       F.try_variant_get(v, "$.content.parts", "array<variant>"))
    whole = F.when(_is_array(v), F.try_variant_get(v, "$", "array<variant>"))
    return _finish(F.transform(_first_array(in_cand, parts, whole, F.array(v)), parse))


def cohere_calls(v: Column) -> Column:
    def parse(tc):
        name = _get(tc, "$.name", "string")
        cid = F.coalesce(_get(tc, "$.id", "string"), name)
        args = F.coalesce(_get(tc, "$.parameters"), _get(tc, "$.arguments"))
        return _mk(F.when(name.isNull(), F.lit("skip")).otherwise(F.lit("ok")), cid, name, _args_text(args))

    tc = F.coalesce(F.try_variant_get(v, "$.tool_calls", "array<variant>"),
                    F.try_variant_get(v, "$.response.tool_calls", "array<variant>"))
    whole = F.when(_is_array(v), F.try_variant_get(v, "$", "array<variant>"))
    return _finish(F.transform(_first_array(tc, whole, F.array(v)), parse))


def bedrock_calls(v: Column) -> Column:
    def parse(b):
        tu = _get(b, "$.toolUse")
        req = (_get(b, "$.toolUse.toolUseId", "string").isNull() | _get(b, "$.toolUse.name", "string").isNull()
               | _get(b, "$.toolUse.input").isNull())
        st = F.when(tu.isNull(), "skip").when(req, "error").otherwise("ok")
        return _mk(st, _get(b, "$.toolUse.toolUseId", "string"), _get(b, "$.toolUse.name", "string"),
                   _args_text(_get(b, "$.toolUse.input")))

    content = F.coalesce(F.try_variant_get(v, "$.output.message.content", "array<variant>"),
                         F.try_variant_get(v, "$.message.content", "array<variant>"),
                         F.try_variant_get(v, "$.content", "array<variant>"))
    whole = F.when(_is_array(v), F.try_variant_get(v, "$", "array<variant>"))
    return _finish(F.transform(_first_array(content, whole, F.array(v)), parse))


EXTRACTORS = {"openai": openai_calls, "anthropic": anthropic_calls, "gemini": gemini_calls,
              "cohere": cohere_calls, "bedrock": bedrock_calls}


def response_tool_calls(df: DataFrame, provider: str, id_col: str = "response_id") -> DataFrame:
    v = F.try_parse_json(F.col("body"))
    calls = F.when(v.isNull(), F.array().cast(f"array<{CALL}>")).otherwise(EXTRACTORS[provider](v))
    return (df.select(id_col, F.posexplode(calls).alias("call_index", "c"))
            .select(id_col, F.col("call_index").cast("int").alias("call_index"), "c.call_id", "c.tool_name",
                    "c.arguments"))


def unify_response(body: Column, provider: Column) -> Column:
    """The OpenAI-shaped response as JSON text. Anthropic maps its first text
    block, complete tool_use blocks and usage; Gemini its first part with zero
    usage; OpenAI, Cohere and Bedrock pass through unchanged."""
    v = F.try_parse_json(body)
    none = F.lit(None).cast("array<struct<id:string,type:string,function:struct<name:string,arguments:string>>>")

    def completion(id_, model, text, calls, prompt, out):
        message = F.struct(F.lit("assistant").alias("role"), text.alias("content"), calls.alias("tool_calls"))
        reason = F.when(calls.isNotNull(), "tool_calls").otherwise("stop")
        choice = F.struct(F.lit(0).alias("index"), message.alias("message"), reason.alias("finish_reason"))
        usage = F.struct(prompt.alias("prompt_tokens"), out.alias("completion_tokens"), (prompt + out).alias("total_tokens"))
        return F.to_json(F.struct(id_.alias("id"), F.lit("chat.completion").alias("object"), F.lit(0).alias("created"), model.alias("model"),
                                  F.array(choice).alias("choices"), usage.alias("usage")))

    blocks = _arr(v, "$.content")
    whole = F.filter(blocks, lambda b: (_get(b, "$.type", "string") == "tool_use") & _get(b, "$.id", "string").isNotNull()
                     & _get(b, "$.name", "string").isNotNull() & F.coalesce(F.schema_of_variant(_get(b, "$.input")).startswith("OBJECT"), F.lit(False)))
    calls = F.transform(whole, lambda b: F.struct(
        _get(b, "$.id", "string").alias("id"), F.lit("function").alias("type"),
        F.struct(_get(b, "$.name", "string").alias("name"), F.to_json(_get(b, "$.input")).alias("arguments")).alias("function")))
    first_text = F.try_element_at(F.filter(blocks, lambda b: _get(b, "$.type", "string") == "text"), F.lit(1))
    zero = F.lit(0).cast("bigint")
    anthropic = completion(F.coalesce(_get(v, "$.id", "string"), F.lit("chatcmpl-fallback")), F.coalesce(_get(v, "$.model", "string"), F.lit("claude")),
                           F.coalesce(_get(first_text, "$.text", "string"), F.lit("")), F.when(F.size(calls) > 0, calls),
                           F.coalesce(_get(v, "$.usage.input_tokens", "bigint"), zero), F.coalesce(_get(v, "$.usage.output_tokens", "bigint"), zero))
    gemini = completion(F.lit("chatcmpl-gemini"), F.lit("gemini"), F.coalesce(_get(v, "$.candidates[0].content.parts[0].text", "string"), F.lit("")), none, zero, zero)
    return F.when(provider == "anthropic", anthropic).when(provider == "gemini", gemini).otherwise(body)


def unified_fields(body: Column, provider: Column) -> Column:
    """<content, finish_reason, total_tokens> of the unified response."""
    v = F.try_parse_json(unify_response(body, provider))
    return F.struct(_get(v, "$.choices[0].message.content", "string").alias("content"),
                    _get(v, "$.choices[0].finish_reason", "string").alias("finish_reason"),
                    _get(v, "$.usage.total_tokens", "bigint").alias("total_tokens"))


def response_content(body: Column) -> Column:
    """choices[0].message.content, else the raw text."""
    return F.coalesce(_get(F.try_parse_json(body), "$.choices[0].message.content", "string"), body)


def with_field(body: Column, name: str, value: Column) -> Column:
    """The text of a JSON object with one more field at its end; ``value`` is JSON. Null if
    the body is no JSON object, or has the field already. All other bytes stay."""
    v = F.try_parse_json(body)
    whole = F.rtrim(body)
    inside = F.substr(whole, F.lit(1), F.char_length(whole) - 1)
    comma = F.when(inside.rlike(r"\{\s*$") & (F.size(F.map_keys(F.try_variant_get(v, "$", "map<string,variant>"))) == 0), "").otherwise(",")
    is_object = F.schema_of_variant(v).startswith("OBJECT") & F.try_variant_get(v, f"$.{name}", "variant").isNull()
    return F.when(is_object, F.concat(inside, comma, F.lit(f'"{name}":'), value, F.lit("}")))
