"""Deterministic identities.

All ids are SHA-256 hex of documented byte strings, computed by Catalyst's
``sha2`` — never ``uuid()``/``now()``: replaying a log yields the same ids.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: tenant used when neither claims nor header name one.
ZERO_TENANT = "00000000-0000-0000-0000-000000000000"
# Provided ids treated as absent (case-insensitive, after trim).
NULLISH_IDS = ["", "null", "none", "undefined"]
SEP = "::"


def resolve_tenant(claim: Column, header: Column) -> Column:
    """Claims tenant as is, else the header trimmed (an all-blank header gives ''), else zero UUID."""
    return F.coalesce(claim, F.trim(header), F.lit(ZERO_TENANT))


def _usable(x: Column) -> Column:
    return x.isNotNull() & ~F.lower(F.trim(x)).isin(*NULLISH_IDS)


def given_session(provided: Column, otherwise: Column) -> Column:
    """The provided session id (trimmed) unless nullish."""
    return F.when(_usable(provided), F.trim(provided)).otherwise(otherwise)


def le_u64_hex(x: Column) -> Column:
    """8-byte little-endian hex of a non-negative BIGINT."""
    return F.concat(*[F.lpad(F.hex(F.shiftright(x, 8 * i).bitwiseAND(255)), 2, "0") for i in range(8)])


def resolve_session(provided: Column, idem: Column, tenant: Column, api_key: Column,
                    epoch_sec: Column, payload: Column, payload_bytes: int | None = None) -> Column:
    """Provided id (trimmed) unless nullish; else tenant_idem; else SHA-256 of
    tenant, api key, epoch seconds (u64 LE) and the whole payload (or its first
    ``payload_bytes``, off by default). The entropy is the *event* time, so a
    replay is deterministic."""
    body = F.encode(payload, "UTF-8")
    if payload_bytes is not None:
        body = F.substring(body, 1, payload_bytes)
    raw = F.concat(F.encode(tenant, "UTF-8"), F.encode(api_key, "UTF-8"), F.unhex(le_u64_hex(epoch_sec)), body)
    return (F.when(_usable(provided), F.trim(provided))
            .when(_usable(idem), F.concat(tenant, F.lit("_"), F.trim(idem)))
            .otherwise(F.sha2(raw, 256)))


def _joined(*parts: Column) -> Column:
    """The parts with a separator; a NULL part makes the id NULL instead of
    dropping out, so ids of different field sets cannot collide."""
    out = parts[0]
    for p in parts[1:]:
        out = F.concat(out, F.lit(SEP), p)
    return out


def operation_id(explicit: Column, batch_size: Column, execution_id: Column, call_id: Column) -> Column:
    return F.when((batch_size == 1) & explicit.isNotNull(), explicit).otherwise(
        F.sha2(_joined(execution_id, call_id), 256))


def idempotency_key(tenant: Column, idem: Column, index: Column, tool: Column, canonical_args: Column,
                    execution_id: Column, call_id: Column) -> Column:
    explicit = F.sha2(_joined(tenant, idem, index.cast("string"), tool, canonical_args), 256)
    implicit = F.sha2(_joined(tenant, execution_id, call_id), 256)
    return F.when(idem.isNotNull(), explicit).otherwise(implicit)


def content_key(tenant: Column, tool: Column, canonical_args: Column) -> Column:
    return F.sha2(_joined(tenant, tool, canonical_args), 256)


def key_hash(api_key: Column) -> Column:
    return F.sha2(api_key, 256)
