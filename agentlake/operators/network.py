"""The longest network prefix that holds an address, for IPv4 and IPv6.

Addresses of both families are one key, 32 hex digits (IPv4 as ``::ffff:a.b.c.d``),
whose text order is the order of addresses. Prefixes are nested or apart, never
overlapping otherwise, so they flatten to disjoint ranges, each with the value of the
longest prefix over it. The lookup is an equality join by bucket, then a range test
inside it: prefixes that lie inside a bucket of the fine level (IPv4 /16, IPv6 /32) are
flattened there; shorter ones by their first eight bits. The fine level is the longer
prefix, so it wins. No prefix is expanded to more than 256 rows, and no address meets
ranges of another bucket.

Text that is no address, like a null, belongs to no prefix; of equal prefixes the least
value counts.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agentlake.operators.dims import bounded

# Where IPv4 stands among 128-bit addresses; bits of a fine bucket by family.
V4_KEY = "0" * 20 + "ffff"
FINE_BITS = {4: 16, 6: 32}
COARSE_BITS = 8

_OCTET = r"(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_V4 = rf"^{_OCTET}(\.{_OCTET}){{3}}$"
_V4_END = rf"{_OCTET}(\.{_OCTET}){{3}}$"
_GROUPS = r"^([0-9a-f]{1,4}(:[0-9a-f]{1,4})*)?$"


def _octets(v4: Column) -> Column:
    return F.transform(F.split(v4, r"\."), lambda o: F.lower(F.lpad(F.hex(o.cast("int")), 2, "0")))


def address_key(address: Column) -> Column:
    """32 hex digits, or null if the text is no IPv4 or IPv6 address."""
    a = F.lower(F.trim(address))
    v4 = F.concat(F.lit(V4_KEY), F.array_join(_octets(a), ""))
    # a dotted end is two groups more
    tail = F.regexp_extract(a, _V4_END, 0)
    two = F.regexp_replace(F.array_join(_octets(tail), ""), "^(.{4})", "$1:")
    v6 = F.when((tail != "") & F.contains(a, F.lit(":")), F.concat(F.substr(a, F.lit(1), F.char_length(a) - F.char_length(tail)), two)).otherwise(a)
    halves = F.split(v6, "::", -1)
    groups = lambda h: F.filter(F.split(h, ":"), lambda g: g != "")
    left = groups(halves[0])
    right = F.when(F.size(halves) == 2, groups(F.try_element_at(halves, F.lit(2)))).otherwise(F.array().cast("array<string>"))
    n = F.size(left) + F.size(right)
    valid = F.forall(halves, lambda h: h.rlike(_GROUPS)) & (((F.size(halves) == 1) & (n == 8)) | ((F.size(halves) == 2) & (n <= 7)))
    full = F.concat(left, F.array_repeat(F.lit("0"), F.greatest(8 - n, F.lit(0))), right)
    return F.when(a.rlike(_V4), v4).when(valid, F.array_join(F.transform(full, lambda g: F.lpad(g, 4, "0")), ""))


def _bucket(key: Column, fine: bool) -> Column:
    is_v4 = key.startswith(V4_KEY)
    bits = FINE_BITS if fine else dict.fromkeys(FINE_BITS, COARSE_BITS)
    return F.when(is_v4, F.substr(key, F.lit(1), F.lit(len(V4_KEY) + bits[4] // 4))).otherwise(F.substr(key, F.lit(1), F.lit(bits[6] // 4)))


def _ranges(prefixes: DataFrame) -> DataFrame:
    """(cidr, value) -> fine, bits, lo, hi, value."""
    parts = [F.try_element_at(F.split("cidr", "/"), F.lit(i)) for i in (1, 2)]
    dotted = parts[0].rlike(_V4)
    rows = prefixes.select(address_key(parts[0]).alias("key"), F.when(dotted, F.try_add(F.lit(96), parts[1].try_cast("int"))).otherwise(parts[1].try_cast("int")).alias("bits"), dotted.alias("dotted"), "value")
    rows = rows.where("key IS NOT NULL AND bits <= 128 AND bits >= IF(dotted, 96, 0)")
    v4 = F.col("key").startswith(V4_KEY) & (F.col("bits") >= 96)
    whole, rest = F.floor(F.col("bits") / 4).cast("int"), F.col("bits") % 4
    digit = F.conv(F.substr("key", whole + 1, F.lit(1)), 16, 10).cast("int")
    step = F.pow(F.lit(2), 4 - rest).cast("int")
    first = digit - digit % step
    head = F.substr("key", F.lit(1), whole)

    def edge(d: Column, fill: str) -> Column:
        middle = F.when(rest > 0, F.lower(F.hex(d))).otherwise("")
        return F.rpad(F.concat(head, middle), 32, fill)

    fine = F.col("bits") >= F.when(v4, 96 + FINE_BITS[4]).otherwise(FINE_BITS[6])
    return rows.select(fine.alias("fine"), "bits", edge(first, "0").alias("lo"), edge(first + step - 1, "f").alias("hi"), "value")


def _sweep(pdf: pd.DataFrame) -> pd.DataFrame:
    """The prefixes of a bucket -> disjoint ranges with the innermost value."""
    out, open_, at = [], [], 0  # open prefixes (end, bits, value), the innermost last; up to where ranges are written
    rows = [(int(lo, 16), bits, int(hi, 16) + 1, value) for lo, hi, bits, value in zip(pdf["lo"], pdf["hi"], pdf["bits"], pdf["value"])]
    for lo, bits, end, value in [*sorted(rows, key=lambda r: r[:2] + r[3:]), (1 << 129, 0, 0, None)]:
        if open_ and at == lo and (end, bits) == open_[-1][:2]:
            continue  # the same prefix once more
        while open_ and at < lo:
            stop = min(open_[-1][0], lo)
            if at < stop:
                out.append((at, stop - 1, open_[-1][2]))
                at = stop
            if open_[-1][0] <= lo:
                open_.pop()
            else:
                break
        at = lo
        open_.append((end, bits, value))
    bucket = pdf["bucket"].iloc[0]
    return pd.DataFrame([(bucket, f"{a:032x}", f"{z:032x}", value) for a, z, value in out], columns=["bucket", "lo", "hi", "value"])


def flattened(prefixes: DataFrame, fine: bool) -> DataFrame:
    """(cidr, value) -> bucket, lo, hi, value of one level: disjoint ranges. A bucket's
    group is as long as there are prefixes in it."""
    rows = _ranges(prefixes).where(F.col("fine") if fine else ~F.col("fine"))
    if not fine:
        # a prefix of under eight bits covers some of the 256 buckets (of its family)
        first, last = (F.conv(F.substr(c, F.lit(1), F.lit(2)), 16, 10).cast("int") for c in ("lo", "hi"))
        two = lambda i: F.lower(F.lpad(F.hex(i), 2, "0"))
        v4 = F.col("lo").startswith(V4_KEY)
        octet = lambda c: F.conv(F.substr(c, F.lit(len(V4_KEY) + 1), F.lit(2)), 16, 10).cast("int")
        parts = F.when(v4, F.transform(F.sequence(octet("lo"), octet("hi")), lambda i: F.concat(F.lit(V4_KEY), two(i)))).otherwise(F.transform(F.sequence(first, last), two))
        rows = rows.withColumn("bucket", F.explode(parts))
        rows = rows.withColumn("lo", F.greatest("lo", F.rpad("bucket", 32, "0"))).withColumn("hi", F.least("hi", F.rpad("bucket", 32, "f")))
    else:
        rows = rows.withColumn("bucket", _bucket(F.col("lo"), True))
    kind = prefixes.schema["value"].dataType.simpleString()
    return rows.groupBy("bucket").applyInPandas(_sweep, f"bucket string, lo string, hi string, value {kind}")


def with_network(rows: DataFrame, address: str, prefixes: DataFrame, out: str) -> DataFrame:
    """Add the value of the longest prefix over ``address`` as ``out``; null without one."""
    rows = rows.withColumn("_key", address_key(F.col(address)))
    for fine, name in ((True, "_fine"), (False, "_coarse")):
        table = flattened(prefixes, fine).select(F.col("bucket").alias("_b"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), F.col("value").alias(name))
        near = (_bucket(F.col("_key"), fine) == F.col("_b")) & F.col("_key").between(F.col("_lo"), F.col("_hi"))
        rows = rows.join(bounded(table), near, "left").drop("_b", "_lo", "_hi")
    return rows.withColumn(out, F.coalesce("_fine", "_coarse")).drop("_key", "_fine", "_coarse")
