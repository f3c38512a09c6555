"""Pruned nearest entries against a scan of all pairs, skipped meetings, edge cases."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from agentlake.operators import similarity as S

ENTRY = "tenant string, vec_id long, vec array<double>, intent string, seq long"
PROBE = "tenant string, probe_id long, vec array<double>, intent string, short boolean, max_seq long"


def data(n, seed):
    rnd = random.Random(seed)
    centres = np.random.default_rng(seed).normal(size=(12, 8))
    entries, probes = [], []
    for i in range(n):
        c = centres[rnd.randrange(12)]
        v = (c + 0.25 * np.array([rnd.gauss(0, 1) for _ in range(8)])) * rnd.choice([0.5, 1, 3])
        tenant, intent = rnd.choice(["a", "a", "b", "c"]), rnd.choice(["what", "how", None])
        entries.append((tenant, i, v.tolist(), intent, i))
        if i % 3 == 0:
            w = v + 0.1 * np.array([rnd.gauss(0, 1) for _ in range(8)])
            probes.append((rnd.choice([tenant, "b"]), i, w.tolist(), rnd.choice([intent, "what", None]), i % 2 == 0, rnd.randrange(n)))
    entries += [("a", n, [0.0] * 8, None, 0), ("a", n + 1, entries[5][2], entries[5][3], 1), ("a", n + 2, entries[5][2], entries[5][3], 2)]
    probes += [("a", 10 ** 6, [0.0] * 8, None, False, n), ("nobody", 10 ** 6 + 1, entries[0][2], None, False, n)]
    return entries, probes


def scan(entries, probes, ring=None):
    out = {}
    for tenant, i, v, intent, short, upto in probes:
        best = None
        for t, e, w, other, seq in entries:
            if t != tenant or seq > upto or (ring is not None and seq <= upto - ring) or (intent and other and intent != other):
                continue
            v_, w_ = np.array(v), np.array(w)
            if not v_.any() or not w_.any():
                continue
            d = 1 - float(v_ @ w_) / float(np.linalg.norm(v_) * np.linalg.norm(w_))
            if d < (S.SHORT_THRESHOLD if short else S.LONG_THRESHOLD) and (best is None or (round(d, 9), e) < best):
                best = (round(d, 9), e)
        if best:
            out[i] = best
    return out


@pytest.mark.parametrize(("ring", "block", "pivots"), [(None, 16, 12), (None, 4096, None), (200, 16, 5), (None, 7, 1)])
def test_nearest_equals_a_scan(spark, ring, block, pivots):
    entries, probes = data(900, 1)
    counts = {}
    got = S.nearest(spark.createDataFrame(probes, PROBE), spark.createDataFrame(entries, ENTRY), ring, block, pivots, counts)
    want = scan(entries, probes, ring)
    assert {r["probe_id"]: (round(r["distance"], 9), r["vec_id"]) for r in got.collect()} == want and len(want) > 100
    if (block, pivots) == (16, 12):
        met = counts["first"] + counts["second"]
        assert 0 < met < counts["all"] / 3, counts  # most balls are never met


def test_no_rows(spark):
    entries, probes = data(30, 2)
    none = lambda s: spark.createDataFrame([], s)
    assert S.nearest(none(PROBE), spark.createDataFrame(entries, ENTRY)).collect() == []
    assert S.nearest(spark.createDataFrame(probes, PROBE), none(ENTRY)).collect() == []


def test_vectors_travel_once_for_each_ball_of_their_group(spark):
    """Vectors in all directions, where no ball is ruled out: the entries of a group fit one ball,
    whatever the other groups hold, so that each probe is met once."""
    rng = np.random.default_rng(3)
    vecs = rng.normal(size=(12900, 16))
    entries = [("abc"[i % 3], i, v.tolist(), None, i) for i, v in enumerate(vecs)]
    probes = [("abc"[i % 3], i, (v + 0.05).tolist(), None, False, i) for i, v in enumerate(vecs) if i % 40 == 0]
    counts = {}
    got = S.nearest(spark.createDataFrame(probes, PROBE), spark.createDataFrame(entries, ENTRY), counts=counts).collect()
    assert counts == {"all": len(probes), "first": len(probes), "second": 0}
    unit = vecs / np.linalg.norm(vecs, axis=1, keepdims=True)
    want = {}
    for _, i, v, *_ in probes:
        d = 1 - unit[i % 3:i + 1:3] @ np.array(v) / np.linalg.norm(v)
        if d.min() < S.LONG_THRESHOLD:
            want[i] = int(d.argmin()) * 3 + i % 3
    assert {r["probe_id"]: r["vec_id"] for r in got} == want and len(want) > 300


def test_intents_and_lengths_equal_lists_of_words(spark):
    import re
    texts = ["", " ", "What is it", "...how?", "somewhat; whatever", "a.WHY-b", "is how", "Do", "x can", "wh who", "éwhat what", "what  why", "\U0001d400how why",
             "a b c d e f g h", " a b c d e f g h \n", "a b c d e f g h i", "a\tb c\nd e f g h, i j", "show how_when", "the when"]
    rows = spark.createDataFrame([(t,) for t in [*texts, None]], "t string").select(S.primary_interrogative(F.col("t")), S.short_prompt(F.col("t"))).collect()
    for t, (intent, short) in zip(texts, rows[:-1], strict=True):
        words = [w for w in re.split(r"[!-/:-@\[-`{-~ \t\n\x0b\f\r]+", t.lower()) if w]
        strong = [w for w in words if w in S.STRONG_INTERROGATIVES]
        want = words[0] if words and words[0] in S.STRONG_INTERROGATIVES + S.WEAK_INTERROGATIVES else strong[0] if strong else None
        assert (intent, short) == (want, len([w for w in re.split(r"[ \t\n\x0b\f\r]+", t) if w]) <= 8), t
    assert tuple(rows[-1]) == (None, None)
