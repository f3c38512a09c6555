"""Connected components by alternating large-star and small-star rounds.

Every round is two group-by-minimum joins over the edges; the edge list never
grows, the number of rounds is logarithmic in practice, and no adjacency list is
ever gathered: minima are combined map-side and a hub's edges are an ordinary
(splittable) join side. Each round ends in the shared checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agentlake.llm.common import cut


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One round over edges (u, v), u <> v, each in one direction."""
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    if not large:
        both = both.where("v < u")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
    joined = both.join(least, F.col("u") == F.col("k"))
    out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")) if large \
        else joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select(F.col("k").alias("u"), F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """Edges (u, v) of longs, any order, repeats and loops allowed -> (node,
    component): the least node reachable, for every node that has an edge to
    another. Null ends are dropped; no edges give an empty frame."""
    e = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())

    def state(df: DataFrame) -> tuple:
        r = df.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"), F.bit_xor(F.xxhash64("v", "u")).alias("y")).collect()[0]
        return r["n"], r["x"], r["y"]

    before = state(e)
    while before[0]:
        e = cut(_star(_star(e, True), False))
        now = state(e)
        if now == before:
            break
        before = now
    # every edge now leads from a node to the least of its component
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
