"""Canonical JSON forms of tool arguments (P9, P10; U2).

``canonical_json`` (idempotency / content keys) keeps number text as written
and sorts keys at every depth; ``loop_signature`` additionally drops
ephemeral keys at every depth and compares numbers as doubles (5 == 5.0).
Values of unknown depth run as Arrow-batched pandas UDFs returning a canonical
string; flat argument objects, the common case, are signed in the JVM. Hashing
stays in the JVM (``xxhash64`` / ``sha2``).
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

# Keys ignored at every depth when comparing tool arguments.
EPHEMERAL_KEYS = ["timestamp", "nonce", "uuid", "stream", "session_id", "time"]
_EPHEMERAL = frozenset(EPHEMERAL_KEYS)


def _unique(pairs):
    out = dict(pairs)
    if len(out) != len(pairs):
        raise ValueError("repeated key")  # no VARIANT either: both engines see text that does not parse
    return out


def signature_text(args: str | None) -> str | None:
    """Canonical text of the loop signature: keys sorted, ephemeral keys dropped
    at every depth, numbers as doubles. Built from the parsed value piece by
    piece (strings carry their length), never by editing JSON text, and without
    recursion, so depth has no limit but the parser's. Arguments that do not
    parse sign like JSON ``null``."""
    if args is None:
        return None
    try:
        v = json.loads(args, object_pairs_hook=_unique)
    except (ValueError, RecursionError):
        v = None
    out, todo = [], [v]
    while todo:
        v = todo.pop()
        if isinstance(v, _Text):
            out.append(v)
        elif isinstance(v, bool):
            out.append(f"b{int(v)};")
        elif v is None:
            out.append("z;")
        elif isinstance(v, (int, float)):
            out.append(f"d{_double(v)!r};")
        elif isinstance(v, str):
            out.append(f"s{len(v)}:{v};")
        elif isinstance(v, list):
            out.append("[")
            todo += [_Text("]"), *reversed(v)]
        else:
            kept = sorted((k, x) for k, x in ((k, _Held(x)) for k, x in v.items() if k not in _EPHEMERAL))
            out.append("{")
            todo.append(_Text("}"))
            for k, x in reversed(kept):
                todo += [x.value, _Text(f"s{len(k)}:{k};")]
    return "".join(out)


class _Text(str):
    """A finished piece of the signature."""


class _Held:
    """A value beside its key; keys are distinct, so values are never compared."""

    __slots__ = ("value",)

    def __init__(self, value):
        self.value = value


def _double(v) -> float:
    try:
        return float(v) + 0.0  # -0.0 equals 0.0
    except OverflowError:
        return float("inf") if v > 0 else float("-inf")


class _Num(float):
    """Float subclass that re-serialises with the original number text."""

    text: str

    def __new__(cls, text: str):
        obj = super().__new__(cls, float(text))
        obj.text = text
        return obj

    def __repr__(self) -> str:
        return self.text


def canonical_text(args: str | None) -> str | None:
    """Sorted-key JSON with number literals kept as written; invalid JSON -> raw text."""
    if args is None:
        return None
    try:
        v = json.loads(args, parse_float=_Num, parse_int=_Num)
    except (ValueError, RecursionError):
        return args
    return _dump_canonical(v)


def _dump_canonical(v) -> str:
    if isinstance(v, dict):
        return "{" + ",".join(json.dumps(k, ensure_ascii=False) + ":" + _dump_canonical(v[k])
                              for k in sorted(v)) + "}"
    if isinstance(v, list):
        return "[" + ",".join(_dump_canonical(x) for x in v) + "]"
    if isinstance(v, _Num):
        return v.text
    return json.dumps(v, ensure_ascii=False)


@pandas_udf(StringType())
def _signature_udf(s: pd.Series) -> pd.Series:
    return s.map(signature_text)


@pandas_udf(StringType())
def _canonical_udf(s: pd.Series) -> pd.Series:
    return s.map(canonical_text)


def canonical_json(args: Column) -> Column:
    return _canonical_udf(args)


def _entries(v: Column) -> Column:
    """The entries of an object without ephemeral keys: key, type, value. Type and
    value are taken once an entry, for all that reads them later."""
    pairs = F.map_entries(F.try_variant_get(v, "$", "map<string,variant>"))
    kept = F.filter(pairs, lambda e: ~e["key"].isin(EPHEMERAL_KEYS))
    return F.transform(kept, lambda e: F.struct(e["key"].alias("k"), F.coalesce(F.schema_of_variant(e["value"]), F.lit("VOID")).alias("t"), e["value"].alias("x")))


def _flat_text(entries: Column) -> Column:
    """The signature of an object whose values, ephemeral ones aside, are all
    scalars; NULL for anything else. Two equal signatures are both flat in this
    sense or both not, so the two ways below never meet in one class."""
    nested = F.exists(entries, lambda e: e["t"].startswith("OBJECT") | e["t"].startswith("ARRAY"))
    held = lambda s: F.concat(F.lit("s"), F.char_length(s).cast("string"), F.lit(":"), s, F.lit(";"))
    text = lambda e: F.try_variant_get(e["x"], "$", "string")

    def scalar(e: Column) -> Column:
        return (F.when(e["t"] == "STRING", held(text(e))).when(e["t"] == "VOID", "z;").when(e["t"] == "BOOLEAN", F.concat(F.lit("b"), text(e), F.lit(";")))
                .otherwise(F.concat(F.lit("d"), (F.try_variant_get(e["x"], "$", "double") + 0.0).cast("string"), F.lit(";"))))

    lines = F.array_sort(F.transform(entries, lambda e: F.struct(e["k"].alias("k"), F.concat(held(e["k"]), scalar(e)).alias("line"))))
    return F.when(~nested, F.concat(F.lit("{"), F.array_join(F.transform(lines, lambda x: x["line"]), ""), F.lit("}")))


def with_loop_signature(df, args_col: str, out_col: str = "sig"):
    """Add the loop signature of ``args_col``: a 64-bit equivalence-class id of a tool
    call's arguments, in one pass over the rows. Flat objects are signed in the JVM, all
    others go to the Arrow UDF, which is handed NULL for the flat ones. Each step is a
    column of its own, so that the parse is done once a row."""
    rows = df.withColumn("_entries", _entries(F.try_parse_json(F.col(args_col)))).withColumn("_flat", _flat_text(F.col("_entries")))
    rows = rows.withColumn("_rest", _signature_udf(F.when(F.col("_flat").isNull(), F.col(args_col))))
    signed = F.when(F.col("_flat").isNotNull(), F.xxhash64(F.lit(1), "_flat")).when(F.col("_rest").isNotNull(), F.xxhash64(F.lit(2), "_rest"))
    return rows.withColumn(out_col, signed).drop("_entries", "_flat", "_rest")
