"""Golden payload vectors for paths the generated tables do not exercise."""

import json

from pyspark.sql import functions as F

from agentlake.operators import payloads as PL
from agentlake.operators import responses as RS
from agentlake.plans.universal import (
    from_universal_anthropic, from_universal_gemini, from_universal_openai, to_universal,
)


def _df(spark, bodies):
    return spark.createDataFrame([(i, json.dumps(b) if not isinstance(b, str) else b)
                                  for i, b in enumerate(bodies)], "payload_id long, body string")


def test_request_walk_paths(spark):
    bodies = [
        {"choices": [{"message": {"tool_calls": [{"id": "a", "function": {"name": "f", "arguments": "{\"x\":1}"}}]}}]},
        {"choices": [{"delta": {"tool_calls": [{"id": "b", "function": {"name": "g", "arguments": "{}"}}]}}]},
        {"messages": [{"role": "assistant", "content": {"type": "tool_use", "id": "c", "name": "h", "input": {"y": 2}}}]},
        {"tool_calls": [{"name": "k", "parameters": {"z": 3}}]},
        {"messages": [{"role": "user", "content": "hi"}]},
    ]
    rows = PL.request_tool_calls(_df(spark, bodies)).orderBy("payload_id", "call_index").collect()
    got = [(r["payload_id"], r["tool_name"], r["args_canonical"]) for r in rows]
    assert got == [(0, "f", '{"x":1}'), (1, "g", "{}"), (2, "h", '{"y":2}'), (3, "k", '{"z":3}')]


def test_last_user_text_vectors(spark):
    bodies = [
        {"messages": [{"role": "user", "content": "first"}, {"role": "assistant", "content": "ok"},
                      {"role": "user", "content": [{"type": "text", "text": "a"}, "b"]}]},
        {"messages": [{"role": "user", "content": "q"}, {"role": "tool", "content": "r"}]},
        {"messages": [{"role": "user", "content": [{"type": "tool_result", "content": "x"}]}]},
        {"messages": [{"role": "user", "content": "q"},
                      {"role": "assistant", "content": None, "function_call": {"name": "f"}}]},
        {"prompt": "\n\nHuman: hello there\n\nAssistant:"},
        {"contents": [{"role": "user", "parts": [{"text": "hi"}]},
                      {"role": "model", "parts": [{"functionResponse": {"name": "f"}}]}]},
        {"contents": [{"role": "user", "parts": [{"text": "hi"}, {"text": "you"}]}]},
        "{broken",
    ]
    out = {r["payload_id"]: r["t"] for r in _df(spark, bodies).select(
        "payload_id", PL.last_user_text(F.col("body")).alias("t")).collect()}
    assert out == {0: "a\nb", 1: None, 2: None, 3: None, 4: "hello there", 5: None, 6: "hi\nyou", 7: None}


def test_to_universal_errors_and_dummy(spark):
    bodies = [
        {"model": "m", "messages": [{"role": "system", "content": "s1"}, {"role": "system", "content": "s2"},
                                    {"role": "user", "content": "a"}, {"role": "user", "content": "b"},
                                    {"role": "tool", "tool_call_id": "t1", "content": "res"}]},
        {"messages": [{"role": "wizard", "content": "x"}]},
        {"messages": [{"role": "assistant", "tool_calls": [{"id": "1", "function": {"name": "f",
                                                                                   "arguments": "{bad"}}]}]},
    ]
    df = _df(spark, bodies).select("payload_id", to_universal(F.col("body")).alias("u"))
    rows = {r["payload_id"]: r["u"] for r in df.collect()}
    assert rows[1] is None and rows[2] is None
    u = rows[0]
    assert u["system_prompt"] == "s2"
    assert [m["role"] for m in u["messages"]] == ["user", "user", "tool"]
    assert u["messages"][2]["content"][0]["type"] == "tool_result"
    a = df.filter("payload_id = 0").select(F.to_json(from_universal_anthropic(F.col("u"))).alias("a")).first()["a"]
    filler = {"role": "assistant", "content": [{"type": "text", "text": "<dummy>"}]}
    assert json.loads(a) == {"system": "s2", "model": "m", "max_tokens": 4096, "messages": [
        {"role": "user", "content": [{"type": "text", "text": "a"}]}, filler,
        {"role": "user", "content": [{"type": "text", "text": "b"}]}, filler,
        {"role": "user", "content": [{"type": "tool_result", "tool_use_id": "t1", "content": "res"}]}]}


def test_all_fields_reach_all_providers(spark):
    body = {"model": "m", "temperature": 0.5, "top_p": 0.9, "max_tokens": 7, "stop": "END", "stream": True,
            "tools": [{"type": "function", "function": {"name": "f"}}, {"type": "other"}],
            "messages": [{"role": "user", "content": [{"type": "text", "text": "see"}, {"type": "image_url", "image_url": {"url": "http://i"}}]},
                         {"role": "assistant", "content": "ok", "tool_calls": [{"id": "c1", "function": {"name": "f", "arguments": "{\"x\":[1,{\"y\":2}]}"}}]},
                         {"role": "tool", "tool_call_id": "c1", "content": "42"}]}
    u = to_universal(F.col("body"))
    row = _df(spark, [body]).select(*[F.to_json(f(u)).alias(f.__name__) for f in (from_universal_openai, from_universal_anthropic, from_universal_gemini)]).first()
    common = {"temperature": 0.5, "top_p": 0.9, "max_tokens": 7, "stream": True, "model": "m"}
    assert json.loads(row[0]) == common | {"stop": ["END"], "tools": body["tools"], "messages": [
        {"role": "user", "content": "see"},
        {"role": "assistant", "content": "ok", "tool_calls": [{"id": "c1", "type": "function", "function": {"name": "f", "arguments": '{"x":[1,{"y":2}]}'}}]},
        {"role": "tool", "content": "42", "tool_call_id": "c1"}]}
    assert json.loads(row[1]) == common | {"stop_sequences": ["END"], "tools": [{"name": "f", "description": "", "input_schema": {"type": "object", "properties": {}}}], "messages": [
        {"role": "user", "content": [{"type": "text", "text": "see"}, {"type": "image", "source": {"type": "url", "media_type": "image/jpeg", "data": "http://i"}}]},
        {"role": "assistant", "content": [{"type": "text", "text": "ok"}, {"type": "tool_use", "id": "c1", "name": "f", "input": {"x": [1, {"y": 2}]}}]},
        {"role": "user", "content": [{"type": "tool_result", "tool_use_id": "c1", "content": "42"}]}]}
    assert json.loads(row[2]) == {"contents": [{"role": "user", "parts": [{"text": "see"}]}, {"role": "model", "parts": [{"text": "ok"}]}, {"role": "model", "parts": []}],
                                  "generationConfig": {"temperature": 0.5, "topP": 0.9, "maxOutputTokens": 7, "stopSequences": ["END"]}}


def test_openai_response_error_voids_all_calls(spark):
    good = {"choices": [{"message": {"tool_calls": [{"id": "1", "function": {"name": "f", "arguments": {"a": 1}}}]}}]}
    bad = {"choices": [{"message": {"tool_calls": [{"id": "1", "function": {"name": "f"}}, {"id": "2"}]}}]}
    noid = {"choices": [{"message": {"tool_calls": [{"function": {"name": "f"}}]}}]}
    df = spark.createDataFrame([(0, json.dumps(good)), (1, json.dumps(bad)), (2, json.dumps(noid))],
                               "response_id long, body string")
    rows = RS.response_tool_calls(df, "openai").collect()
    assert [(r["response_id"], r["tool_name"], r["arguments"]) for r in rows] == [(0, "f", '{"a":1}')]


def test_has_tools_reads_the_whole_body(spark):
    inside = '{"a":"' + "x" * (16384 - 6 - 14) + '","tool_calls":[]}'     # key ends at byte 16384
    outside = '{"a":"' + "x" * (16384 - 6 - 13) + '","tool_calls":[]}'    # key ends at byte 16385
    multibyte = '{"a":"' + "é" * 8200 + '","tools":[]}'                   # 16400 bytes before the key
    df = spark.createDataFrame([(0, inside), (1, outside), (2, multibyte)], "payload_id long, body string")
    got = {r["payload_id"]: r["h"] for r in df.select("payload_id", PL.has_tools(F.col("body")).alias("h")).collect()}
    assert got == {0: True, 1: True, 2: True}
    # a gateway's byte window is an explicit argument
    got = {r["payload_id"]: r["h"] for r in df.select("payload_id", PL.has_tools(F.col("body"), 16384).alias("h")).collect()}
    assert got == {0: True, 1: False, 2: False}


def test_limits_are_off_unless_given(spark):
    from agentlake.functions.identity import resolve_session
    from agentlake.operators.streams import reassemble
    big = '{"tools":[],"pad":"' + "x" * (6 * 1024 * 1024) + '"}'
    df = spark.createDataFrame([(big,)], "body string")
    row = df.select(PL.is_agentic(F.col("body"), F.lit("application/json")).alias("a"),
                    PL.is_agentic(F.col("body"), F.lit("application/json"), 5 << 20).alias("b")).first()
    assert (row["a"], row["b"]) == (True, False)
    same = "p" * 300
    ids = spark.createDataFrame([(same + "1",), (same + "2",)], "p string").select(
        resolve_session(F.lit(None), F.lit(None), F.lit("t"), F.lit("k"), F.lit(5).cast("long"), F.col("p")).alias("s")).distinct()
    assert ids.count() == 2
    piece = "y" * 1000
    chunks = spark.createDataFrame([(1, i, '{"delta":{"text":"%s"}}' % piece, 4) for i in range(400)], "stream_id long, seq long, data string, prompt_bytes long")
    assert len(reassemble(chunks).first()["text"]) == 400_000


def test_gemini_chunks_keep_data_lines(spark):
    from agentlake.plans.results import unify_gemini_chunk
    lines = ['data: {"candidates":[]}', "event: done", "", ": ping"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, line string")
    assert [r["c"] for r in df.orderBy("i").select(unify_gemini_chunk(F.col("line")).alias("c")).collect()] == [lines[0], "", "", ""]
