"""Exact top-k by inner product with block-at-a-time pruning.

Candidates stand in blocks of neighbouring ids. A block keeps, for each term
(vector component), its greatest and least value, and a forward index: the rows
themselves. For a query the sum over terms of the greater of q * max and q * min
bounds every score in the block. Blocks are visited by falling bound and scored
as a whole through their forward index until the bound lies below the k-th best
score; ties go to the smaller id, so a block whose bound equals it is visited.

Queries are a stated set, compared with all rows in blocks: rows and queries are
cut into *tiles* of bounded size, every tile of rows meets every tile of queries
in a task of its own, and only k rows for each query leave a meeting. Scores are
integers; products are taken in float64 where all sums stay below 2 ** 53 and in
Python integers where they do not, so they are exact always.

Defined results: vectors that are null, empty or hold null or non-finite
components take no part, nor do rows without an id; a vector shorter than the
query's counts as padded with zeros; repeated candidate rows count each; a
repeated query id is one query (its least vector); fewer than k candidates give
all of them; empty tables give an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BLOCK, TILE_ROWS, TILE_QUERIES = 256, 1 << 14, 1 << 10


def quantised(vec: Column, scale: int) -> Column:
    """floor(scale * x) of every component; null if one is null or not finite."""
    x = F.transform(vec, lambda v: v.cast("double"))
    usable = (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return F.when(usable, F.transform(x, lambda v: F.floor(v * F.lit(float(scale)))))


def _matrix(rows, width: int) -> np.ndarray:
    lens = np.array([len(r) for r in rows])
    flat = np.concatenate(list(rows)).astype(np.int64)
    if (lens == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(lens), width), np.int64)
    for i, r in enumerate(rows):
        out[i, :len(r)] = r
    return out


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T, exact: float64, or objects where sums could pass 2 ** 53."""
    top = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * a.shape[1]
    if top < 1 << 53:
        return a.astype(np.float64) @ b.astype(np.float64).T
    return a.astype(object) @ b.astype(object).T


def tile_topk(q_ids, queries: np.ndarray, ids, rows: np.ndarray, k: int, block: int = BLOCK) -> tuple[list, int]:
    """(query id, row id, score) of each query's k best rows of a tile, and how
    many blocks were scored. ``ids`` must be sorted."""
    starts = np.arange(0, len(ids), block)
    most, least = np.maximum.reduceat(rows, starts), np.minimum.reduceat(rows, starts)
    bounds = _products(np.maximum(queries, 0), most) + _products(np.minimum(queries, 0), least)
    order = np.argsort(-bounds, axis=1, kind="stable")
    out, scored = [], 0
    for i, q in enumerate(q_ids):
        best_s, best_i = np.empty(0, bounds.dtype), np.empty(0, np.int64)
        for b in order[i]:
            if len(best_s) == k and bounds[i, b] < best_s[-1]:
                break
            scored += 1
            part = slice(int(starts[b]), int(starts[b]) + block)
            keep = ids[part] != q
            s = np.concatenate([best_s, _products(queries[i:i + 1], rows[part])[0][keep]])
            n = np.concatenate([best_i, ids[part][keep]])
            first = np.lexsort((n, -s))[:k]
            best_s, best_i = s[first], n[first]
        out += [(q, int(n), int(s)) for s, n in zip(best_s, best_i)]
    return out, scored


def top_k(queries: DataFrame, rows: DataFrame, k: int = 10, tile_rows: int = TILE_ROWS, tile_queries: int = TILE_QUERIES, block: int = BLOCK) -> DataFrame:
    """queries, rows: (id long, vec array<long>) -> query_id, rank, vec_id, score."""
    spark = rows.sparkSession
    rows = rows.where("id IS NOT NULL AND vec IS NOT NULL")
    queries = queries.where("id IS NOT NULL AND vec IS NOT NULL").groupBy("id").agg(F.min("vec").alias("vec"))
    sizes = rows.agg(F.count("*")).unionAll(queries.agg(F.count("*"))).collect()
    n_rows, n_queries = -(-sizes[0][0] // tile_rows), -(-sizes[1][0] // tile_queries)
    schema = "query_id long, vec_id long, score long"
    if not n_rows or not n_queries:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    # tiles by hash are even whatever the ids; within a tile, blocks are ranges of ids
    left = rows.withColumn("tile", F.pmod(F.xxhash64("id"), F.lit(n_rows)).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(n_queries - 1))))
    right = queries.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(n_queries)).cast("int")).withColumn("tile", F.explode(F.sequence(F.lit(0), F.lit(n_rows - 1))))

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        a = a.sort_values("id", kind="stable")
        width = max(a["vec"].map(len).max(), b["vec"].map(len).max())
        found, _ = tile_topk(b["id"].tolist(), _matrix(b["vec"], width), a["id"].to_numpy(), _matrix(a["vec"], width), k, block)
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"])

    best = left.groupBy("tile", "part").cogroup(right.groupBy("tile", "part")).applyInPandas(meet, schema)
    by_query = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return best.withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
