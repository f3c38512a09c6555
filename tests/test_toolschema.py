"""Tool-schema helpers: FNV-1a embedding, strip, lazy rewrite, schema-request gate."""

import json
import math

from agentlake.functions import toolschema as TS


def test_fnv1a_known_values():
    # FNV-1a 64 test vectors: empty string and "a"
    assert TS.fnv1a(b"") == 0xCBF29CE484222325
    assert TS.fnv1a(b"a") == 0xAF63DC4C8601EC8C


def test_embed_bag_of_words():
    e = TS.embed("Search the DOCS, search docs!")
    assert len(e) == 128 and abs(math.sqrt(sum(x * x for x in e)) - 1) < 1e-9
    assert TS.embed("search") == TS.embed("SEARCH")       # ASCII lower-casing
    assert TS.embed("") == [0.0] * 128


def test_strip_removes_keys_at_every_depth_including_properties_named_so():
    s = {"type": "object", "title": "T", "properties": {"title": {"type": "string"}, "a": {"description": "x"}}}
    assert TS.strip(s) == {"type": "object", "properties": {"a": {}}}


def test_lazy_rewrite_and_phantom_once():
    reg = [{"name": "search", "summary": "Search documents", "schema": {"type": "object"}}]
    body = {"tools": [{"type": "function", "function": {"name": "search", "parameters": {"type": "object",
                                                                                       "description": "d"}}}]}
    out = json.loads(TS.lazy_tools_text(json.dumps(body), reg))
    assert out["tools"][0]["function"]["description"] == "Available Tool: search — Search documents"
    assert out["tools"][0]["function"]["parameters"] == {"type": "object"}
    assert [t["function"]["name"] for t in out["tools"]] == ["search", "get_tool_details"]
    again = json.loads(TS.lazy_tools_text(json.dumps(out), reg))
    assert [t["function"]["name"] for t in again["tools"]] == ["search", "get_tool_details"]
    untouched = json.dumps({"tools": [{"type": "function", "function": {"name": "other"}}]})
    assert TS.lazy_tools_text(untouched, reg) == untouched


def test_schema_request_gate():
    reg = [{"name": "search_docs", "summary": "search docs schema parameters"}]
    asks = {"messages": [{"role": "assistant", "content": "What does search_docs take? show the schema parameters"}]}
    assert TS.requested_tools(asks, reg) == {"search_docs"}
    assert TS.requested_tools({"messages": [{"role": "assistant", "content": "hello"}]}, reg) == set()
