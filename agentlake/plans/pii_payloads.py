"""Queries: PII scan of user text in payloads and JSON-leaf redaction.

Payloads are built from ``documents`` (which carry PII): a system message, the
document as the user message (string content, text blocks, or Gemini parts by
``doc_id % 3``), an assistant line holding a card-like number, and a 12-digit
numeric ``max_tokens``. Detection reads only user text, in its escaped JSON
form (as the gateway's byte scanner sees it); when it fires, every string
leaf of the payload is redacted — keys and numbers never are.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from agentlake.functions import pii as PII
from agentlake.operators.payloads import _arr, _get
from agentlake.plans.registry import query
from agentlake.sources.payloads import _q
from agentlake.sources.tables import read

# Fixed values (ours): the assistant line (its number looks like a card) and the numeric field.
ASSISTANT_LINE = "Ticket 4111111111111111 noted"
MAX_TOKENS = 123456789012


def doc_payloads(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", "text")
    t = _q(F.col("text"))
    a = F.lit(json.dumps(ASSISTANT_LINE))
    shape = F.col("doc_id") % 3
    openai = F.concat(F.lit('{"model":"gpt-4o","max_tokens":' + str(MAX_TOKENS) + ',"messages":['
                            '{"role":"system","content":"You are a helpful assistant."},{"role":"user","content":'),
                      t, F.lit('},{"role":"assistant","content":'), a, F.lit("}]}"))
    blocks = F.concat(F.lit('{"model":"claude-3-5-sonnet","max_tokens":' + str(MAX_TOKENS) + ',"messages":['
                            '{"role":"user","content":[{"type":"text","text":'),
                      t, F.lit('}]},{"role":"assistant","content":[{"type":"text","text":'), a, F.lit("}]}]}"))
    gemini = F.concat(F.lit('{"model":"gemini-1.5-pro","generationConfig":{"maxOutputTokens":' + str(MAX_TOKENS)
                            + '},"contents":[{"role":"user","parts":[{"text":'),
                      t, F.lit('}]},{"role":"model","parts":[{"text":'), a, F.lit("}]}]}"))
    body = F.when(shape == 0, openai).when(shape == 1, blocks).otherwise(gemini)
    return d.select(F.col("doc_id").alias("payload_id"), body.alias("body"))


def _escaped(s):
    """The string as it sits inside the JSON body (quotes stripped)."""
    return F.regexp_extract(F.to_json(F.struct(s.alias("v"))), r'^\{"v":"(.*)"\}$', 1)


def pii_scan_text(body):
    """User-role text only — string content, text blocks, Gemini user
    parts, or a legacy prompt — in escaped form, joined by newlines. The whole
    text is scanned (no byte budget)."""
    v = F.try_parse_json(body)
    users = F.filter(_arr(v, "$.messages"), lambda m: _get(m, "$.role", "string") == "user")

    def texts(m):
        s = _get(m, "$.content", "string")
        is_str = F.coalesce(F.schema_of_variant(_get(m, "$.content")) == "STRING", F.lit(False))
        blk = F.transform(F.filter(_arr(m, "$.content"), lambda b: _get(b, "$.type", "string") == "text"),
                          lambda b: _get(b, "$.text", "string"))
        return F.when(is_str, F.array(s)).otherwise(blk)

    from_msgs = F.flatten(F.transform(users, texts))
    gem_users = F.filter(_arr(v, "$.contents"), lambda c: _get(c, "$.role", "string") == "user")
    from_gem = F.flatten(F.transform(gem_users, lambda c: F.transform(_arr(c, "$.parts"),
                                                                      lambda p: _get(p, "$.text", "string"))))
    prompt = F.when(_get(v, "$.prompt", "string").isNotNull(), F.array(_get(v, "$.prompt", "string")))
    parts = F.concat(from_msgs, from_gem, F.coalesce(prompt, F.array().cast("array<string>")))
    parts = F.filter(parts, lambda x: x.isNotNull())
    return F.array_join(F.transform(parts, lambda x: _escaped(x)), "\n")


_PY_PII = re.compile(PII.PII_PATTERN)


def _redact_value(v):
    if isinstance(v, str):
        return _PY_PII.sub(PII.REDACTED, v)
    if isinstance(v, list):
        return [_redact_value(x) for x in v]
    if isinstance(v, dict):
        return {k: _redact_value(x) for k, x in v.items()}
    return v


def redact_json_text(body: str | None) -> str | None:
    if body is None:
        return None
    try:
        v = json.loads(body)
    except ValueError:
        return body
    return json.dumps(_redact_value(v), ensure_ascii=False, separators=(",", ":"))


@pandas_udf(StringType())
def _redact_json_udf(body: pd.Series) -> pd.Series:
    return body.map(redact_json_text)


def redact_json(body, gate):
    """X13 (U2): every string leaf at any depth, keys and numbers untouched; only where
    ``gate``: the UDF is handed NULL for all other rows."""
    return F.when(gate, _redact_json_udf(F.when(gate, body))).otherwise(body)


_DUCK = PII.PII_PATTERN
_ESC = "replace(replace(text, '\\', '\\\\'), chr(10), '\\n')"


@query("pii_scan_text", sql=f"""
SELECT doc_id AS payload_id, regexp_matches({_ESC}, '{_DUCK}') AS has_pii FROM documents
""")
def pii_scan_text_q(spark, sf_dir):
    p = doc_payloads(spark, sf_dir)
    return p.select("payload_id", PII.has_pii(pii_scan_text(F.col("body"))).alias("has_pii"))


@query("redact_payloads", sql=f"""
SELECT doc_id AS payload_id, has_pii AS redacted,
       CASE WHEN has_pii THEN len(regexp_extract_all(text, '{_DUCK}')) + 1 ELSE 0 END AS redactions,
       CASE WHEN has_pii THEN regexp_replace(text, '{_DUCK}', '[REDACTED_PII]', 'g') ELSE text END AS user_text,
       CAST({MAX_TOKENS} AS BIGINT) AS max_tokens
FROM (SELECT *, regexp_matches({_ESC}, '{_DUCK}') AS has_pii FROM documents)
""")
def redact_payloads(spark, sf_dir):
    p = doc_payloads(spark, sf_dir)
    gate = PII.has_pii(pii_scan_text(F.col("body")))
    r = p.select("payload_id", gate.alias("redacted"), redact_json(F.col("body"), gate).alias("out"))
    v = F.try_parse_json("out")
    user = F.coalesce(_get(v, "$.messages[0].content[0].text", "string"), _get(v, "$.messages[1].content", "string"),
                      _get(v, "$.contents[0].parts[0].text", "string"))
    mx = F.coalesce(_get(v, "$.max_tokens", "bigint"), _get(v, "$.generationConfig.maxOutputTokens", "bigint"))
    n = (F.size(F.split("out", r"\[REDACTED_PII\]", -1)) - 1).cast("bigint")
    return r.select("payload_id", "redacted", n.alias("redactions"), user.alias("user_text"), mx.alias("max_tokens"))
