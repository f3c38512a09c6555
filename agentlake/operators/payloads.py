"""Payload jobs on VARIANT.

Bodies are parsed once with ``try_parse_json``; every extraction is a
``try_variant_get`` path or an array transform over ``array<variant>`` —
JVM-side, row-local, no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _arr(v: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.array().cast("array<variant>"))


def _get(v: Column, path: str, t: str = "variant") -> Column:
    return F.try_variant_get(v, path, t)


def request_call_variants(v: Column) -> Column:
    """Every tool-call object of a request, in the gateway's walk order:
    messages[].tool_calls and tool_use content blocks, contents[].parts with
    functionCall, root tool_calls, then choices[].message|delta tool_calls."""
    def from_msg(m):
        blocks = F.filter(_arr(m, "$.content"), lambda b: _get(b, "$.type", "string") == "tool_use")
        single = F.when((_get(m, "$.content.type", "string") == "tool_use"),
                        F.array(_get(m, "$.content"))).otherwise(F.array().cast("array<variant>"))
        return F.concat(_arr(m, "$.tool_calls"), blocks, single)

    msgs = F.flatten(F.transform(_arr(v, "$.messages"), from_msg))
    gem = F.flatten(F.transform(_arr(v, "$.contents"),
                                lambda c: F.filter(_arr(c, "$.parts"), lambda p: _get(p, "$.functionCall").isNotNull())))
    root = _arr(v, "$.tool_calls")
    choices = F.flatten(F.transform(_arr(v, "$.choices"), lambda ch: F.when(
        _get(ch, "$.message").isNotNull(), _arr(ch, "$.message.tool_calls")).otherwise(_arr(ch, "$.delta.tool_calls"))))
    return F.concat(msgs, gem, root, choices)


def unify_call(c: Column) -> Column:
    """<name, args VARIANT, id> from function / functionCall / name+input|parameters; NULL if none."""
    fn = _get(c, "$.function")
    fc = _get(c, "$.functionCall")
    nm = _get(c, "$.name")
    args_openai = F.try_parse_json(F.coalesce(_get(c, "$.function.arguments", "string"), F.lit("")))
    name = (F.when(fn.isNotNull(), F.coalesce(_get(c, "$.function.name", "string"), F.lit("")))
            .when(fc.isNotNull(), F.coalesce(_get(c, "$.functionCall.name", "string"), F.lit("")))
            .when(nm.isNotNull(), F.coalesce(_get(c, "$.name", "string"), F.lit(""))))
    args = (F.when(fn.isNotNull(), args_openai)
            .when(fc.isNotNull(), _get(c, "$.functionCall.args"))
            .when(nm.isNotNull(), F.coalesce(_get(c, "$.input"), _get(c, "$.parameters"))))
    return F.when(name.isNotNull(), F.struct(name.alias("name"), args.alias("args"),
                                             _get(c, "$.id", "string").alias("id")))


def request_tool_calls(payloads: DataFrame, id_col: str = "payload_id", body_col: str = "body",
                       keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per unified tool call of each request, in walk order; ``keep``
    carries further columns of the payload along."""
    v = F.try_parse_json(F.col(body_col))
    calls = payloads.select(id_col, *keep, F.posexplode(F.filter(F.transform(request_call_variants(v), unify_call),
                                                          lambda x: x.isNotNull())).alias("call_index", "c"))
    return calls.select(id_col, *keep, F.col("call_index").cast("int").alias("call_index"),
                        F.col("c.id").alias("call_id"), F.col("c.name").alias("tool_name"),
                        F.to_json(F.col("c.args")).alias("args_canonical"))


def ingest_status(body: Column) -> Column:
    """INVALID_JSON / MISSING_MODEL / valid."""
    v = F.try_parse_json(body)
    return (F.when(v.isNull(), "INVALID_JSON")
            .when(_get(v, "$.model").isNull(), "MISSING_MODEL").otherwise("valid"))


def extract_model(body: Column) -> Column:
    """Top-level ``model``, trimmed."""
    return F.trim(_get(F.try_parse_json(body), "$.model", "string"))


def is_agentic(body: Column, content_type: Column, max_bytes: int | None = None) -> Column:
    """JSON content type, root has ``tools`` or ``tool_choice``. ``max_bytes``
    reproduces a gateway's size limit (off by default)."""
    v = F.try_parse_json(body)
    fits = F.lit(True) if max_bytes is None else F.octet_length(body) <= max_bytes
    return (F.lower(content_type).startswith("application/json") & fits
            & F.coalesce(_get(v, "$.tools").isNotNull() | _get(v, "$.tool_choice").isNotNull(), F.lit(False)))


def has_tools(body: Column, scan_bytes: int | None = None) -> Column:
    """P5: quoted ``tools`` / ``tool_calls`` keys anywhere in the body (no parse).
    ``scan_bytes`` looks at that many bytes only, as a gateway may (off by default)."""
    seen = F.encode(body, "UTF-8")
    if scan_bytes is not None:
        seen = F.substring(seen, 1, scan_bytes)
    return F.contains(seen, F.lit(b'"tools"')) | F.contains(seen, F.lit(b'"tool_calls"'))


def _strip_ws(s: Column) -> Column:
    return F.regexp_replace(s, r"^\s+|\s+$", "")


def _msg_text(m: Column) -> Column:
    """User text of one message: string content, or string / {type:text} blocks, '\\n'-joined."""
    s = _get(m, "$.content", "string")
    is_str = F.coalesce(F.schema_of_variant(_get(m, "$.content")) == "STRING", F.lit(False))
    blocks = _arr(m, "$.content")
    pieces = F.transform(blocks, lambda b: F.when(F.schema_of_variant(b) == "STRING", _get(b, "$", "string"))
                         .when(_get(b, "$.type", "string") == "text", _get(b, "$.text", "string")))
    from_blocks = F.array_join(F.filter(pieces, lambda x: x.isNotNull()), "\n")
    return F.when(is_str, s).otherwise(from_blocks)


def last_user_text(body: Column) -> Column:
    """X11: the newest user message's text, NULL when a tool turn comes first
    (walking newest to oldest), legacy ``prompt`` between Human/Assistant
    markers, Gemini NULL when any functionCall/functionResponse exists."""
    v = F.try_parse_json(body)
    msgs = _arr(v, "$.messages")
    n = F.size(msgs)
    idx = F.sequence(F.lit(0), n - 1)
    role = lambda i: _get(F.element_at(msgs, i + 1), "$.role", "string")
    user_pos = F.array_max(F.filter(F.transform(idx, lambda i: F.when(role(i) == "user", i)), lambda x: x.isNotNull()))
    start = F.coalesce(user_pos, F.lit(0))

    def blocks_of_type(m, t):
        return F.exists(_arr(m, "$.content"), lambda b: _get(b, "$.type", "string") == t)

    def blocker(i):
        m = F.element_at(msgs, i + 1)
        r = role(i)
        tool_role = r.isin("tool", "function")
        assistant = (r == "assistant") & ((F.size(_arr(m, "$.tool_calls")) > 0) | _get(m, "$.function_call").isNotNull()
                                          | blocks_of_type(m, "tool_use"))
        result = (F.coalesce(r, F.lit("")) != "assistant") & blocks_of_type(m, "tool_result")
        return F.coalesce(tool_role | assistant | result, F.lit(False))

    blocked = F.exists(F.filter(idx, lambda i: i >= start), blocker)
    msg_text = F.when(user_pos.isNotNull(), _msg_text(F.element_at(msgs, user_pos + 1)))
    from_msgs = F.when(~blocked, msg_text)

    prompt = _get(v, "$.prompt", "string")
    after_h = F.substring_index(prompt, "\n\nHuman:", -1)
    legacy = F.when(F.locate("\n\nHuman:", prompt) > 0,
                    F.when(F.locate("\n\nAssistant:", after_h) > 0, F.substring_index(after_h, "\n\nAssistant:", 1))
                    .otherwise(after_h)).otherwise(prompt)

    contents = _arr(v, "$.contents")
    gem_block = F.exists(contents, lambda c: F.exists(
        _arr(c, "$.parts"), lambda p: _get(p, "$.functionCall").isNotNull() | _get(p, "$.functionResponse").isNotNull()))
    user_contents = F.filter(contents, lambda c: _get(c, "$.role", "string") == "user")
    last_c = F.try_element_at(user_contents, F.lit(-1))
    gem_text = F.array_join(F.filter(F.transform(_arr(last_c, "$.parts"), lambda p: _get(p, "$.text", "string")),
                                     lambda x: x.isNotNull()), "\n")
    from_gem = F.when(~gem_block & (F.size(user_contents) > 0), gem_text)

    raw = (F.when(_get(v, "$.messages").isNotNull() & (F.schema_of_variant(_get(v, "$.messages")).startswith("ARRAY")),
                  from_msgs)
           .when(prompt.isNotNull(), legacy)
           .when(_get(v, "$.contents").isNotNull() & (F.schema_of_variant(_get(v, "$.contents")).startswith("ARRAY")),
                 from_gem))
    t = _strip_ws(raw)
    return F.when(t != "", t)
