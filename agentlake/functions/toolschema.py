"""Tool-schema helpers (X19–X22; U1, U2).

Small per-row Python helpers behind Arrow-batched pandas UDFs, used where the
semantics need recursion over arbitrary JSON (schema stripping, tools-array
rewrite) or wrapping 64-bit arithmetic (FNV-1a embedding), which the JVM
expressions cannot express under ANSI mode.
"""

from __future__ import annotations

import json
import math

import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, FloatType, StringType

# Embedding size and FNV-1a 64-bit parameters.
EMB_DIM = 128
FNV_OFFSET = 14695981039346656037
FNV_PRIME = 1099511628211
MASK64 = (1 << 64) - 1
# Schema keys dropped at every depth when stripping.
STRIP_KEYS = ("description", "title", "examples")
# Schema-request gate keywords and similarity threshold.
SCHEMA_KEYWORDS = ["parameter", "schema", "details", "definition", "arguments", "inputs", "how to use", "what does"]
SCHEMA_THRESHOLD = 0.35
# The on-demand schema tool added to rewritten tool lists.
PHANTOM_TOOL_NAME = "get_tool_details"
PHANTOM_TOOL = {
    "type": "function",
    "function": {
        "name": PHANTOM_TOOL_NAME,
        "description": "Returns the complete parameter schema for an MCP tool. Call this when you need exact "
                       "parameter types and required fields.",
        "parameters": {"type": "object",
                       "properties": {"tool_name": {"type": "string", "description": "Exact name of the MCP tool"}},
                       "required": ["tool_name"]},
    },
}


def fnv1a(data: bytes) -> int:
    h = FNV_OFFSET
    for b in data:
        h ^= b
        h = (h * FNV_PRIME) & MASK64
    return h


def embed(text: str | None) -> list[float] | None:
    """128-d bag of words: split on non-alphabetic characters, ASCII-lowercase,
    FNV-1a mod 128, counts, L2-normalised (float32)."""
    if text is None:
        return None
    vec = [0.0] * EMB_DIM
    tok = []
    for ch in text + " ":
        if ch.isalpha():
            tok.append(ch)
        elif tok:
            word = "".join(tok).encode("utf-8")
            low = bytes(b + 32 if 65 <= b <= 90 else b for b in word)
            vec[fnv1a(low) % EMB_DIM] += 1.0
            tok = []
    norm = math.sqrt(sum(x * x for x in vec))
    if norm > 0:
        vec = [x / norm for x in vec]
    return [float(x) for x in vec]


def strip(v):
    if isinstance(v, dict):
        return {k: strip(x) for k, x in v.items() if k not in STRIP_KEYS}
    if isinstance(v, list):
        return [strip(x) for x in v]
    return v


def strip_text(s: str | None) -> str | None:
    if s is None:
        return None
    try:
        return json.dumps(strip(json.loads(s)), separators=(",", ":"), ensure_ascii=False)
    except ValueError:
        return s


def requested_tools(body: dict, registry: list[dict]) -> set[str]:
    """Tools whose embedding is close to the last non-empty assistant text,
    once that text passes the keyword gate."""
    msgs = body.get("messages") if isinstance(body, dict) else None
    if not isinstance(msgs, list):
        return set()
    content = None
    for m in reversed(msgs):
        if isinstance(m, dict) and m.get("role") == "assistant" and isinstance(m.get("content"), str) and m["content"]:
            content = m["content"].lower()
            break
    if content is None or not any(k in content for k in SCHEMA_KEYWORDS):
        return set()
    q = embed(content)
    out = set()
    for d in registry:
        e = embed(f"{d['name']} {d['summary']}")
        if sum(a * b for a, b in zip(q, e)) >= SCHEMA_THRESHOLD:
            out.add(d["name"])
    return out


def lazy_tools_text(body: str | None, registry: list[dict]) -> str | None:
    """Registered tools get a one-line summary and stripped parameters;
    requested tools get the full schema; the schema tool is added once; a body
    with nothing changed is returned as is."""
    if body is None:
        return None
    try:
        v = json.loads(body)
    except ValueError:
        return body
    tools = v.get("tools") if isinstance(v, dict) else None
    if not isinstance(tools, list) or not registry:
        return body
    index = {d["name"]: d for d in registry}
    full = requested_tools(v, registry)
    modified = False
    for t in tools:
        f = t.get("function") if isinstance(t, dict) else None
        if not isinstance(f, dict) or not isinstance(f.get("name"), str):
            continue
        d = index.get(f["name"])
        if d is None:
            continue
        if f["name"] in full:
            if d.get("schema") is not None:
                f["parameters"] = d["schema"]
            modified = True
            continue
        had = "parameters" in f
        if had:
            f["parameters"] = strip(f["parameters"])
        f["description"] = f"Available Tool: {f['name']} — {d['summary']}"
        modified = modified or had
    if not modified:
        return body
    if not any(isinstance(t, dict) and isinstance(t.get("function"), dict)
               and t["function"].get("name") == PHANTOM_TOOL_NAME for t in tools):
        tools.append(PHANTOM_TOOL)
    return json.dumps(v, separators=(",", ":"), ensure_ascii=False)


@pandas_udf(ArrayType(FloatType()))
def hash_embed_udf(s: pd.Series) -> pd.Series:
    return s.map(embed)


@pandas_udf(StringType())
def strip_schema_udf(s: pd.Series) -> pd.Series:
    return s.map(strip_text)


def make_lazy_tools_udf(registry: list[dict]):
    reg = [dict(d) for d in registry]

    @pandas_udf(StringType())
    def lazy_tools_udf(s: pd.Series) -> pd.Series:
        return s.map(lambda b: lazy_tools_text(b, reg))

    return lazy_tools_udf


def make_schema_requests_udf(registry: list[dict]):
    reg = [dict(d) for d in registry]

    def one(b):
        try:
            return sorted(requested_tools(json.loads(b), reg))
        except (ValueError, TypeError, AttributeError):
            return []

    @pandas_udf(ArrayType(StringType()))
    def schema_requests_udf(s: pd.Series) -> pd.Series:
        return s.map(one)

    return schema_requests_udf
