import numpy as np

from agentlake.llm import topk as T


def brute(q_ids, queries, ids, rows, k):
    out = []
    for q, v in zip(q_ids, queries):
        scores = sorted(((-sum(int(x) * int(y) for x, y in zip(v, r)), n) for n, r in zip(ids, rows) if n != q))[:k]
        out += [(q, i + 1, n, -s) for i, (s, n) in enumerate(scores)]
    return sorted(out)


def collect(df):
    return sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in df.collect())


def test_tiles_ties_and_small_tables(spark):
    rng = np.random.default_rng(8)
    rows = rng.integers(-30, 30, (700, 6))
    rows[100:400] = rows[100]  # one very common vector
    ids = [int(x) for x in rng.permutation(10 ** 6)[:700]]
    df = spark.createDataFrame([(i, [int(x) for x in r], "z") for i, r in zip(ids, rows)], "id long, vec array<long>, score string").select("id", "vec")
    q = sorted(ids)[::40]
    want = brute(q, [rows[ids.index(x)] for x in q], ids, rows, 10)
    for tiles in ((1 << 14, 1 << 10), (60, 5)):
        assert collect(T.top_k(df.where(df.id.isin(q)), df, 10, *tiles, block=16)) == want
    few = df.limit(3).collect()
    small = spark.createDataFrame(few, df.schema)
    assert len(collect(T.top_k(small.limit(1), small, 10))) == 2
    assert T.top_k(df.limit(0), df).count() == 0 and T.top_k(df, df.limit(0)).count() == 0


def test_pruning_skips_blocks_and_large_products_are_exact():
    rng = np.random.default_rng(5)
    centre = np.repeat(rng.integers(-900, 900, (40, 16)), 64, axis=0)
    rows = centre + rng.integers(-20, 20, centre.shape)
    ids = np.arange(len(rows))
    found, scored = T.tile_topk([5], rows[5:6], ids, rows, 10, block=64)
    assert [(q, i + 1, n, s) for i, (q, n, s) in enumerate(found)] == brute([5], rows[5:6], ids.tolist(), rows, 10) and scored < 20
    big = rng.integers(-(1 << 40), 1 << 40, (50, 4))
    found, _ = T.tile_topk([3], big[3:4], np.arange(50), big, 5, block=8)
    assert [(q, i + 1, n, s) for i, (q, n, s) in enumerate(found)] == brute([3], big[3:4], list(range(50)), big, 5)


def test_unusable_vectors_take_no_part(spark):
    rows = [(100, [0.5, -0.25]), (1, None), (2, []), (3, [float("nan"), 1.0]), (4, [None, 1.0]), (5, [float("inf"), 0.0]), (None, [1.0, 1.0]), (6, [1.0, 1.0]), (7, [1.0, 1.0]), (7, [1.0, 1.0]), (8, [1.0])]
    df = spark.createDataFrame(rows, "id long, v array<float>")
    v = df.select("id", T.quantised(df.v, 1024).alias("vec"))
    assert collect(T.top_k(v.where("id % 100 = 0"), v)) == [(100, 1, 8, 512 * 1024), (100, 2, 6, 256 * 1024), (100, 3, 7, 256 * 1024), (100, 4, 7, 256 * 1024)]
