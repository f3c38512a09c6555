"""Ordered per-key computations that never put a whole key in one task.

A window ``PARTITION BY key`` sorts every row of a key inside one task; with
one hot session or tenant holding a third of the traffic that is a third of
the data in one sort. These helpers split each key by a time bin instead:

* per-(key, bin) aggregates are tiny (one row per key and bin) and carry the
  cross-bin state (offsets, previous values);
* the row-level work is a window over ``(key, bin)``, bounded by the traffic of
  one bin, not by the lifetime of the key.

Results are exact; only the partitioning differs from the textbook window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agentlake.session import written


def _bin(ts: Column, width: int) -> Column:
    return F.floor(ts / width).cast("bigint")


def running_sums(df: DataFrame, keys: list[str], ts: str, tiebreak: str, values: list[str],
                 width: int, suffix: str = "_running") -> DataFrame:
    """Running (inclusive) sums of ``values`` per key ordered by (ts, tiebreak)."""
    b = "_bin"
    df = df.withColumn(b, _bin(F.col(ts), width))
    per_bin = df.groupBy(*keys, b).agg(*[F.sum(v).alias(f"_bs_{v}") for v in values])
    wb = Window.partitionBy(*keys).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bin.select(*keys, b, *[F.coalesce(F.sum(f"_bs_{v}").over(wb), F.lit(0)).alias(f"_off_{v}")
                                         for v in values])
    w = Window.partitionBy(*keys, b).orderBy(ts, tiebreak).rowsBetween(Window.unboundedPreceding, 0)
    out = df.join(offsets, [*keys, b], "left")
    for v in values:
        out = out.withColumn(f"{v}{suffix}", F.col(f"_off_{v}") + F.sum(v).over(w))
    return out.drop(b, *[f"_off_{v}" for v in values])


def previous_value(df: DataFrame, keys: list[str], ts: str, tiebreak: str, col: str, out: str,
                   width: int) -> DataFrame:
    """``lag(col)`` per key ordered by (ts, tiebreak), computed bin-locally.

    The first row of a bin takes the last value of the nearest earlier
    non-empty bin (found on the per-bin table).
    """
    b = "_bin"
    df = df.withColumn(b, _bin(F.col(ts), width))
    last_in_bin = (df.groupBy(*keys, b)
                   .agg(F.max_by(F.col(col), F.struct(F.col(ts), F.col(tiebreak))).alias("_last")))
    wb = Window.partitionBy(*keys).orderBy(b)
    carry = last_in_bin.select(*keys, b, F.lag("_last").over(wb).alias("_carry"))
    w = Window.partitionBy(*keys, b).orderBy(ts, tiebreak)
    res = (df.join(carry, [*keys, b], "left")
           .withColumn(out, F.when(F.row_number().over(w) > 1, F.lag(col).over(w))
                       .otherwise(F.col("_carry"))))
    return res.drop(b, "_carry")


def range_count(df: DataFrame, keys: list[str], ts: str, tiebreak: str, width: int,
                out: str = "window_count") -> DataFrame:
    """Count of rows of the same key with ts in (t - width, t], up to the row
    itself in (ts, tiebreak) order — a sliding ``RANGE`` window.

    Each row is copied once into the next bin as context, so a (key, bin)
    partition sees everything within ``width`` before any of its rows: two bins
    of traffic per task at most, whatever the size of the key.
    """
    b = "_bin"
    base = df.withColumn(b, _bin(F.col(ts), width)).withColumn("_real", F.lit(True))
    ctx = base.withColumn(b, F.col(b) + 1).withColumn("_real", F.lit(False))
    both = base.unionByName(ctx)
    # rows of the key with ts in (t - width, t] (RANGE frame on integer seconds)
    wr = Window.partitionBy(*keys, b).orderBy(F.col(ts)).rangeBetween(-(width - 1), 0)
    counted = both.withColumn("_in_range", F.count(F.lit(1)).over(wr))
    # ties on ts: RANGE counts all peers; subtract peers that come after this row.
    wp = Window.partitionBy(*keys, b, ts).orderBy(F.col(tiebreak)).rowsBetween(0, Window.unboundedFollowing)
    counted = counted.withColumn(out, (F.col("_in_range") - F.count(F.lit(1)).over(wp) + 1).cast("bigint"))
    return counted.filter("_real").drop(b, "_real", "_in_range")


def islands(events: DataFrame, keys: list[str], ts: str, gap: int) -> DataFrame:
    """Merge events into intervals [first, last + gap): a new interval starts
    when an event comes ``gap`` or more after the previous one of the key.

    Works on per-(key, bin) min/max first (bin = gap, so gaps inside a bin are
    always shorter than ``gap``), then on the small bin table.
    """
    b = "_bin"
    per_bin = (events.withColumn(b, _bin(F.col(ts), gap))
               .groupBy(*keys, b).agg(F.min(ts).alias("_lo"), F.max(ts).alias("_hi"),
                                      F.count(F.lit(1)).alias("_n")))
    wb = Window.partitionBy(*keys).orderBy(b)
    flagged = per_bin.withColumn(
        "_new", F.when(F.lag("_hi").over(wb).isNull() | (F.col("_lo") - F.lag("_hi").over(wb) >= gap), 1)
        .otherwise(0))
    flagged = flagged.withColumn("_island", F.sum("_new").over(wb.rowsBetween(Window.unboundedPreceding, 0)))
    return (flagged.groupBy(*keys, "_island")
            .agg(F.min("_lo").alias("open_sec"), (F.max("_hi") + gap).alias("close_sec"),
                 F.sum("_n").cast("bigint").alias("events"))
            .drop("_island"))


def affine_prefix(df: DataFrame, keys: list[str], pos: str, a: str, b: str, width: int = 256) -> DataFrame:
    """Adds y, the value of y = a * y + b after each row of a key in the order of ``pos``
    (a long >= 0, unique in the key); before the first row y is 0.

    Such steps compose: (a2, b2) after (a1, b1) is (a2 a1, a2 b1 + b2). Bins of ``width``
    positions are composed in parallel, the bins of a key likewise, level by level, until one
    bin is left; no task holds more than ``width`` rows of a key."""
    types = ["struct<a:double,b:double>", "array<struct<pos:long,a:double,b:double>>"]
    step = F.struct(F.col(pos).alias("pos"), F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b"))
    bins = df.groupBy(*keys, _bin(F.col(pos), width).alias("_bin")).agg(F.array_sort(F.collect_list(step)).alias("_steps"))

    def after(acc: Column, r: Column) -> Column:
        made = F.struct((r["a"] * acc["now"]["a"]).alias("a"), (r["a"] * acc["now"]["b"] + r["b"]).alias("b"))
        entry = F.struct(r["pos"].alias("pos"), made["a"].alias("a"), made["b"].alias("b"))
        return F.struct(made.alias("now"), F.concat(acc["done"], F.array(entry)).alias("done"))

    zero = F.struct(F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b")).cast(types[0]).alias("now"), F.array().cast(types[1]).alias("done"))
    bins = bins.withColumn("_x", F.aggregate("_steps", zero, after)).select(*keys, "_bin", "_x.now.a", "_x.now.b", F.col("_x.done").alias("_done"))
    bins = written(bins, "affine")  # read by the level above and again on the way back
    top = bins.agg(F.max("_bin")).collect()[0][0]
    if top:
        upto = affine_prefix(bins.select(*keys, "_bin", "a", "b"), keys, "_bin", "a", "b", width).select(*keys, "_bin", "y")
        entering = upto.withColumn("_enter", F.lag("y").over(Window.partitionBy(*keys).orderBy("_bin"))).drop("y")
        bins = bins.join(entering, [*keys, "_bin"])
    else:
        bins = bins.withColumn("_enter", F.lit(0.0))
    rows = bins.withColumn("_s", F.explode("_done"))
    y = F.col("_s.a") * F.coalesce("_enter", F.lit(0.0)) + F.col("_s.b")
    return df.join(rows.select(*keys, F.col("_s.pos").alias(pos), y.alias("y")), [*keys, pos])


def ema(df: DataFrame, keys: list[str], pos: str, value: str, alpha: float, out: str = "ema", width: int = 256) -> DataFrame:
    """Adds the exponential moving average of ``value`` in the order of ``pos``: the first
    value of a key, then alpha * value + (1 - alpha) * average before."""
    df = written(df, "ema")
    first = df.groupBy(*keys).agg(F.min(pos).alias("_first"))
    rows = df.join(first, keys).withColumn("_a", F.when(F.col(pos) == F.col("_first"), 0.0).otherwise(1 - alpha))
    rows = rows.withColumn("_b", F.when(F.col(pos) == F.col("_first"), F.col(value)).otherwise(F.lit(alpha) * F.col(value)))
    return affine_prefix(rows, keys, pos, "_a", "_b", width).withColumnRenamed("y", out).drop("_a", "_b", "_first")
