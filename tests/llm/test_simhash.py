"""Fingerprints and classes against a plain recomputation, the long-list path, edge cases."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from agentlake.llm import simhash
from agentlake.llm.queries import QUERIES


def plain_fingerprint(text, k=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    grams = [" ".join(words[i:i + k]) for i in range(len(words) - k + 1)] if len(words) >= k else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_classes(prints, ids, most=3):
    """Least id that is reachable from each row."""
    x = np.array(prints, np.uint64)
    root = np.arange(len(x))
    for i in range(len(x)):
        for j in np.flatnonzero(np.bitwise_count(x ^ x[i]) <= most):
            if root[i] != root[j]:
                root[root == root[j]] = root[i]
    named = {}
    for r, d in zip(root.tolist(), ids):
        if d is not None:
            named[r] = min(named.get(r, d), d)
    return [named.get(r) for r in root.tolist()]


@pytest.mark.parametrize("text", [None, "", " \t\n", "one", "One two", "a b c", "A b C d e f", "Ää  x y z", "x " * 5000, "a b c\x0bd\x0ce"])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_fingerprint_of_long_text_is_that_of_its_words(monkeypatch):
    rng = random.Random(1)
    text = " ".join("".join(rng.choices("abcde", k=rng.randint(1, 9))) for _ in range(3000))
    monkeypatch.setattr(simhash, "SLICE", 50)
    monkeypatch.setattr(simhash, "ROWS", 7)
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_spark_hash_is_the_same(spark):
    got = spark.range(1).select(F.xxhash64(F.lit("one two three"))).collect()[0][0]
    assert got & simhash.ALL == plain_fingerprint("one two three") == simhash.fingerprint("one two three")


def test_variants_of_linked_prints_agree():
    rng = random.Random(2)
    first = simhash.variant_masks(simhash.ALL, 3)
    assert len(first) == 64 and all(m.bit_count() == 31 for m in first)
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a ^ sum(1 << p for p in rng.sample(range(64), rng.randint(0, 3)))
        shared = [m for m in first if a & m == b & m]
        assert shared
        second = simhash.variant_masks(simhash.ALL ^ shared[0], 3)
        assert any(a & m == b & m for m in second)


@pytest.fixture(scope="module")
def clouds():
    """Prints around some centres, chained by small steps, and far ones."""
    rng = random.Random(3)
    out = [rng.getrandbits(64) for _ in range(200)] + [0]
    for size in (400, 60, 7):
        x = rng.getrandbits(64)
        for _ in range(size):
            out.append(x)
            x ^= sum(1 << p for p in rng.sample(range(64), rng.randint(1, 4)))
    centre = rng.getrandbits(64)
    out += [centre ^ sum(1 << p for p in rng.sample(range(20), rng.randint(0, 5))) for _ in range(500)]
    return sorted(set(out))


@pytest.mark.parametrize("together", [4096, 40, 3])
def test_links_give_the_classes(spark, clouds, together):
    """Also where lists are too long for a task and are indexed again."""
    signed = np.array(clouds, np.uint64).view(np.int64).tolist()
    edges = simhash.links(spark.createDataFrame([(x,) for x in signed], "fingerprint long"), 3, together).collect()
    assert all((u & simhash.ALL ^ v & simhash.ALL).bit_count() <= 3 for u, v in edges)
    root = {x: x for x in signed}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x
    for u, v in edges:
        root[top(u)] = top(v)
    want = plain_classes(clouds, range(len(clouds)))
    classes = {}
    for x, w in zip(signed, want):
        classes.setdefault(top(x), set()).add(w)
    assert all(len(c) == 1 for c in classes.values()) and len(classes) == len(set(want))


def test_long_list_by_flipped_bits():
    rng = random.Random(4)
    prints = np.array(sorted({rng.getrandbits(11) << 5 for _ in range(300)}), np.uint64)
    got = {(int(a), int(b)) for u, v in simhash.list_links(prints, 2, 10) for a, b in zip(u, v)}
    want = {(int(a), int(b)) for a in prints for b in prints if a < b and (int(a) ^ int(b)).bit_count() <= 2}
    assert got == want


def test_rows(spark):
    long = "word " * 20000
    rows = [(3, "a b c d"), (1, "A B c d"), (1, "A B c d"), (None, "a b c d"), (7, None), (8, ""), (None, "lonely text stands here"), (9, long), (5, long)]
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, fingerprint string, component_id string")
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()), key=str)
    prints = [plain_fingerprint(t) for _, t in rows]
    names = plain_classes(prints, [d for d, _ in rows])
    want = [(d, int(np.array([p], np.uint64).view(np.int64)[0]), n) for (d, _), p, n in zip(rows, prints, names)]
    assert got == sorted(want, key=str)
    assert {n for (d, _), n in zip(rows, names) if d in (7, 8)} == {7}


def test_empty(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_query_on_all_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op13_simhash"](spark, "/root/testdata/sf0.01").collect()}
    prints = [plain_fingerprint(t) for _, t in docs]
    names = plain_classes(prints, [d for d, _ in docs])
    assert got == {d: (f"{p:016x}", n) for (d, _), p, n in zip(docs, prints, names)}
    assert len(set(names)) < len(names)
