"""Ranks against scoring every document, pruning, the codec, edge cases."""

import random
import re
from collections import Counter
from math import floor, log

import numpy as np
import pytest

from agentlake.llm import ranked_search as R
from agentlake.llm.queries import QUERIES


def terms_of(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def plain(docs, items, k=10):
    bags = [(d, Counter(terms_of(t))) for d, t in docs if d is not None]
    bags = [(d, b) for d, b in bags if b]
    n_docs, n_terms = len(bags), sum(b.total() for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    asked = {}
    for i, t in items:
        if i is not None:
            asked.setdefault(i, set()).update(terms_of(t))
    out = []
    for i, ts in asked.items():
        scores = []
        for d, b in bags:
            m = 10 + 90 * b.total() * n_docs // n_terms
            s = sum(floor(1000 * log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * b[t] // (1000 * b[t] + 8 * m)) for t in ts if b[t])
            if s > 0:
                scores.append((-s, d))
        out += [(i, r + 1, d, -s) for r, (s, d) in enumerate(sorted(scores)[:k])]
    return sorted(out)


def rows_of(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(6)
    words = [f"w{i}" for i in range(400)]
    weights = [1 / (i + 1) for i in range(400)]
    docs = [(i, " ".join(rng.choices(words, weights, k=rng.choice([3, 20, 80, 600])))) for i in range(3000)]
    docs += [(3000 + i, docs[7][1]) for i in range(40)]  # ties
    items = [(i, " ".join(rng.choices(words, weights, k=6)) + " " + " ".join(docs[rng.randrange(3000)][1].split()[:4])) for i in range(60)]
    return docs, items


@pytest.mark.parametrize(("shard_bytes", "block", "span"), [(1 << 24, 128, 1024), (20000, 8, 64), (1, 128, 1024)])
def test_all_ranks(spark, corpus, monkeypatch, shard_bytes, block, span):
    docs, items = corpus
    docs = docs[:300] + docs[-40:] if shard_bytes == 1 else docs
    lists = R.index(spark.createDataFrame(docs, "doc_id long, text string").repartition(3, "doc_id"), shard_bytes)
    assert rows_of(R.search(lists, spark.createDataFrame(items, "item_id long, text string"))) == plain(docs, items)


def built(docs):
    held = R.Builder()
    for d, t in docs:
        held.add(d, t.encode().lower())
    rows = held.rows(0)
    return rows, int(rows["df"][0]), int(rows["n_terms"][0])


def shard_of(rows, n_docs, n_terms):
    first = rows.iloc[0]
    shard = R.Shard(first["data"], first["head"], n_docs, n_terms)
    for r in rows.iloc[1:].itertuples():
        shard.add(r.term, r.df, r.head, r.frontier, r.data)
    return shard


def test_codec_and_block_maxima(corpus):
    docs, _ = corpus
    docs = [*docs, (9000, "w0 " * 70000), (9001, "w399")]  # wide numbers
    rows, n_docs, n_terms = built(docs)
    shard = shard_of(rows, n_docs, n_terms)
    bags = [Counter(terms_of(t)) for _, t in docs]
    for term in ("w0", "w5", "w399"):
        p = shard.lists[term]
        want = [(i, b[term]) for i, b in enumerate(bags) if b[term]]
        got = [(int(d), int(s)) for b in range(len(p.last)) for d, s in zip(*p.block(b))]
        assert got == [(i, int(R.impact(np.int64(f), shard.eight_m[i]))) for i, f in want]
        for b in range(len(p.last)):
            assert p.most[b] == p.block(b)[1].max() and p.last[b] == p.block(b)[0][-1]


def test_blocks_stay_closed(corpus, monkeypatch):
    """With a bound from earlier shards, most blocks are not decompressed, and the result is that of an open search."""
    docs, _ = corpus
    monkeypatch.setattr(R, "BLOCK", 16)
    rows, n_docs, n_terms = built(docs)
    asked = [(t, R.weight(n_docs, int(rows.loc[rows["term"] == t, "df"].iloc[0]))) for t in ("w0", "w1", "w2", "w250", "w399")]
    nothing = (np.empty(0, np.int64), np.empty(0, np.int64))
    first = shard_of(rows, n_docs, n_terms)
    heap = first.search(asked, 10, nothing)
    # ten earlier documents as good as this shard's best: none of its own can enter
    full = np.full(10, heap[0][0]), np.arange(-10, 0)
    again = shard_of(rows, n_docs, n_terms)
    assert [x.tolist() for x in again.search(asked, 10, full)] == [x.tolist() for x in full]
    total = sum(len(again.lists[t].last) for t, _ in asked)
    assert again.opened < total / 3 and again.opened < first.opened, (again.opened, first.opened, total)
    # no list can beat a high bound: nothing is opened at all
    shut = shard_of(rows, n_docs, n_terms)
    shut.search(asked, 1, (np.array([10**12]), np.array([1])))
    assert shut.opened == 0


def test_huge_lengths():
    assert R.length_terms(np.array([10**9, 5]), 10**12, 10**15).tolist() == [8 * (10 + 90 * 10**9 * 10**12 // 10**15), 80]


def test_edge_cases(spark):
    docs = [(1, None), (2, ""), (3, " .,; "), (None, "apple pear"), (4, "Apple pear"), (4, "Apple pear"), (5, "apple " * 50000), (6, "ÄPFEL äpfel Äpfel"), (7, "日本語 apple"), (0, "apple pear")]
    items = [(1, "apple"), (1, "PEAR pear"), (2, None), (3, ""), (None, "apple"), (4, "missing"), (5, "äpfel 日本語"), (6, "Äpfel")]
    d = spark.createDataFrame([(*r, 1, "t") for r in docs], "doc_id long, text string, shard long, term string")
    i = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, rank int")
    got = R.search(R.index(d), i, 3)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert rows_of(got) == plain(docs, items, 3)
    assert rows_of(R.search(R.index(d), i, 3, part_terms=1)) == plain(docs, items, 3)


@pytest.mark.parametrize(("docs", "items"), [([], [(1, "a")]), ([(1, "a")], []), ([], []), ([(1, "")], [(1, "a")])])
def test_empty(spark, docs, items):
    lists = R.index(spark.createDataFrame(docs, "doc_id long, text string"))
    assert R.search(lists, spark.createDataFrame(items, "item_id long, text string")).collect() == []


def test_query(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs, items = ([tuple(r) for r in spark.read.parquet(f"{sf_dir}/{t}.parquet").select(i, "text").collect()] for t, i in (("documents", "doc_id"), ("benchmark", "item_id")))
    assert rows_of(QUERIES["op12_ranked_search"](spark, sf_dir)) == plain(docs, items)
