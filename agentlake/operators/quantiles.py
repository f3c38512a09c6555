"""A10: exact quantiles of any number of rows per key, by histogram refinement.

``percentile`` keeps every distinct value of a group in one buffer. Here a rank is
found by descending: the range of a key's values is cut into buckets, rows are counted by
bucket (map-side combined), and each rank goes on in the one bucket that holds it. When a
range holds at most ``few`` rows, or one value, its values are counted one by one and the
rank is read off. Every round is one scan and one aggregation of ``buckets`` rows a range;
a range shrinks by about that factor, so a few rounds do for any input. Ranges always
split where they hold two values, so it ends for skewed values too.

Between two ranks the result is interpolated linearly. Rows with a null key, or a null or
NaN value, are left out; a key without rows has no result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from agentlake.operators.dims import bounded
from agentlake.session import written


def exact_quantiles(df: DataFrame, keys: list[str], value: str, quantiles: dict[str, float], buckets: int = 1024, few: int = 1 << 16) -> DataFrame:
    """keys, n (rows) and a double for each named quantile."""
    v = F.col(value).cast("double")
    rows = df.select(*keys, v.alias("v")).where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys], F.col("v").isNotNull() & ~F.isnan("v")))
    whole = written(rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")), "quantile-keys")
    at = F.array(*[F.lit(float(q)) * (F.col("n") - 1) for q in quantiles.values()])
    ranks = F.explode(F.array_distinct(F.flatten(F.transform(at, lambda p: F.array(F.floor(p), F.ceil(p))))))
    # a range: values lo to hi, ``size`` of them, ``before`` smaller ones
    open_ = whole.select(*keys, ranks.alias("rank"), "lo", "hi", F.lit(0).cast("long").alias("before"), F.col("n").alias("size"))
    span = [*keys, "lo", "hi"]
    while not (wide := open_.where((F.col("size") > few) & (F.col("lo") < F.col("hi")))).isEmpty():
        counts = _within(rows, wide, keys, span).withColumn("bucket", F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * buckets), F.lit(buckets - 1))) \
            .groupBy(*span, "bucket").agg(F.count("*").alias("c"), F.min("v").alias("blo"), F.max("v").alias("bhi"))
        earlier = Window.partitionBy(*span).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.withColumn("below", F.coalesce(F.sum("c").over(earlier), F.lit(0)))
        inner = wide.join(counts, span).where((F.col("rank") - F.col("before")).between(F.col("below"), F.col("below") + F.col("c") - 1))
        inner = inner.select(*keys, "rank", F.col("blo").alias("lo"), F.col("bhi").alias("hi"), (F.col("before") + F.col("below")).alias("before"), F.col("c").alias("size"))
        open_ = written(open_.where((F.col("size") <= few) | (F.col("lo") == F.col("hi"))).unionByName(inner), "quantile-ranges")
    narrow = open_.where(F.col("lo") < F.col("hi"))
    upto = Window.partitionBy(*span).orderBy("v")
    counted = _within(rows, narrow, keys, span).groupBy(*span, "v").agg(F.count("*").alias("c")).withColumn("upto", F.sum("c").over(upto))
    found = narrow.join(counted, span).where((F.col("rank") - F.col("before")).between(F.col("upto") - F.col("c"), F.col("upto") - 1)).select(*keys, "rank", "v")
    found = found.unionByName(open_.where(F.col("lo") == F.col("hi")).select(*keys, "rank", F.col("lo").alias("v")))
    # a key has two ranks a quantile at most
    by_rank = found.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("at"))
    out = whole.join(by_rank, keys)

    def between(q: float):
        p = F.lit(float(q)) * (F.col("n") - 1)
        low, high = (F.element_at("at", f(p)) for f in (F.floor, F.ceil))
        return low + (high - low) * (p - F.floor(p))

    return out.select(*keys, "n", *[between(q).alias(name) for name, q in quantiles.items()])


def _within(rows: DataFrame, ranges: DataFrame, keys: list[str], span: list[str]) -> DataFrame:
    """Rows once for each of the ranges they stand in (ranges of a key do not overlap)."""
    some = bounded(ranges.select(*span).distinct().toDF(*[f"_{k}" for k in keys], "lo", "hi"))
    same = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"_{k}") for k in keys], F.col("v").between(F.col("lo"), F.col("hi")))
    return rows.join(some, same).drop(*[f"_{k}" for k in keys])
