"""Registry of named queries: a Spark builder plus, where one can be written,
an independent DuckDB oracle over the same parquet tables.

Oracle bodies refer to derived views (``v_requests`` …) and dimensions
(``d_pricing`` …) by name; :func:`oracle_sql` prepends exactly the CTEs a body
needs, resolving dependencies between views.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass
class Query:
    key: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    bench: bool = False


REGISTRY: dict[str, Query] = {}


def query(key: str, sql: str | None = None, bench: bool = False):
    def deco(fn):
        if key in REGISTRY:
            raise ValueError(f"duplicate query key {key}")
        REGISTRY[key] = Query(key, fn, sql, bench)
        return fn
    return deco


def _needed(body: str, defs: dict[str, str]) -> list[str]:
    order: list[str] = []
    seen: set[str] = set()

    def visit(name: str):
        if name in seen:
            return
        seen.add(name)
        for dep in defs:
            if dep != name and re.search(rf"\b{dep}\b", defs[name]):
                visit(dep)
        order.append(name)

    for name in defs:
        if re.search(rf"\b{name}\b", body):
            visit(name)
    return order


def with_views(body: str) -> str:
    from agentlake.plans.oracle_views import view_defs
    defs = view_defs()
    names = _needed(body, defs)
    if not names:
        return body
    ctes = ",\n".join(f"{n} AS (\n{defs[n]}\n)" for n in names)
    body = body.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes},\n{body[15:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"


def load_all() -> dict[str, Query]:
    # Import for side effects: each module registers its queries.
    from agentlake.plans import (  # noqa: F401
        aggregates, billing, guard, identity, joins, payloads, pii, similarity, windows, execution,
        streams_batch, telemetry, tools, governance, responses, toon, alerts, pii_payloads, schemas, rewrite, extras, results, universal,
    )
    return REGISTRY
