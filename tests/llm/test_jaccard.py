import random
import re

import numpy as np
import pytest

from agentlake.llm import components as C
from agentlake.llm import jaccard as J
from agentlake.llm import queries


def shingles(text, k):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return frozenset()
    return frozenset([tuple(words)] if len(words) < k else [tuple(words[i:i + k]) for i in range(len(words) - k + 1)])


def brute(docs, k, num, den):
    sets = {d: shingles(t, k) for d, t in docs}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, x in enumerate(ids):
        for y in ids[:i]:
            a, b = sets[x], sets[y]
            if a and b and den * min(len(a), len(b)) >= num * max(len(a), len(b)) and den * len(a & b) >= num * len(a | b):
                p, q = sorted((find(x), find(y)))
                root[q] = p
    return {d: (len(s), find(d)) for d, s in sets.items()}


def as_dict(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


def test_all_documents_equal_brute_force(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    want = brute(docs, 4, 85, 100)
    assert as_dict(queries.QUERIES["op7_jaccard"](spark, "/root/testdata/sf0.01")) == want
    assert sum(c != d for d, (_, c) in want.items()) > 30


@pytest.mark.parametrize("frequent,small,together,block", [(1000, 8, 20000, 1 << 21), (3, 2, 5, 600), (12, 1, 40, 3000)])
def test_frequent_classes_hot_lists_and_blocks(spark, monkeypatch, frequent, small, together, block):
    """Near copies at all distances around the threshold, with common passages,
    so that pairs of frequent shingles, stars and several blocks are all needed."""
    monkeypatch.setattr(J, "FREQUENT", frequent)
    rnd = random.Random(4)
    base = [[f"w{rnd.randrange(400)}" for _ in range(n)] for n in (25, 60, 61, 140, 300)]
    common = [f"c{i}" for i in range(40)]
    docs = []
    for i in range(260):
        words = list(base[i % 5])
        for _ in range(rnd.randrange(0, 1 + len(words) // 25)):
            words[rnd.randrange(len(words))] = f"x{rnd.randrange(10 ** 6)}"
        docs.append((1000 - i, " ".join(words + common if i % 3 == 0 else words)))
    docs += [(2000 + i, docs[i % 40][1].upper()) for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    got = as_dict(J.join(df, 4, 85, 100, small=small, together=together, block_shingles=block))
    assert got == brute(docs, 4, 85, 100)


def test_nulls_short_long_ties_repeated_rows_and_empty_table(spark):
    long = " ".join(f"v{i}" for i in range(60000))
    docs = [(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "One  two"), (6, "one two three"), (7, long), (8, long + " tail"), (9, "a b c d"), (9, "a b c d"), (10, "one two\xa0")]
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, node string, n int")
    got = as_dict(J.join(df))
    assert got == brute(docs, 4, 85, 100) and got[5] == (1, 4) and got[8][1] == 7 and got[1] == (0, 1)
    assert J.join(df.limit(0)).count() == 0


def test_a_doc_id_with_several_texts(spark):
    """One of its texts counts, whatever the order of rows; a null one does no harm."""
    base = " ".join(f"w{i}" for i in range(40))
    for rows in ([(1, None), (1, base), (2, base + " x")], [(1, base), (1, None), (2, base + " x")], [(1, base), (1, "other words " * 9), (2, base + " x"), (3, base + " y")]):
        got = [as_dict(J.join(spark.createDataFrame(r, "doc_id long, text string"))) for r in (rows, rows[::-1])]
        assert got[0] == got[1] and set(got[0]) == {d for d, _ in rows}
        for d, (n, c) in got[0].items():
            assert any(len(shingles(t, 4)) == n for e, t in rows if e == d)
        chosen = {d: next(t for e, t in rows if e == d and len(shingles(t, 4)) == n) for d, (n, _) in got[0].items()}
        assert got[0] == brute(list(chosen.items()), 4, 85, 100)


def test_sketch_and_signatures_lose_no_link():
    rng = np.random.default_rng(3)
    freq = np.sort(rng.integers(0, 1 << 63, 300).astype(np.uint64))
    signer = J.Signer(85, 100, freq)
    for n in [1, 2, 3, 7, 19, 20, 40, 41, 100, 333, 1000]:
        for _ in range(30):
            a = np.unique(np.concatenate([rng.choice(freq, min(n // 2, 250), replace=False), rng.integers(0, 1 << 63, n - min(n // 2, 250)).astype(np.uint64)]))
            b = a[rng.permutation(len(a))[:max(1, int(np.ceil(len(a) * rng.uniform(0.85, 1))))]]
            b = np.unique(np.concatenate([b, rng.integers(0, 1 << 63, int(len(a) * rng.uniform(0, 0.16))).astype(np.uint64)]))
            if J.similar(a, b, 85, 100):
                assert len(np.intersect1d(signer.signatures(a), signer.signatures(b)))
                assert J.may_link([len(a)], [J.sketch(a)], [len(b)], [J.sketch(b)], 85, 100)[0]


def test_components_against_union_find(spark):
    rnd = random.Random(9)
    edges = [(i, i + 1) for i in range(0, 300)] + [(5000, i) for i in range(1000, 1400)] + [(rnd.randrange(6000, 7000), rnd.randrange(6000, 7000)) for _ in range(700)] + [(3, 3), (9000, 9000)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for u, v in edges:
        p, q = sorted((find(u), find(v)))
        root[q] = p
    got = {r["node"]: r["component"] for r in C.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for u, v in edges if u != v for x in (u, v)}
    assert C.components(spark.createDataFrame([], "u long, v long")).count() == 0
