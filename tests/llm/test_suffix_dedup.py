import hashlib
import random

import numpy as np
import pytest

from agentlake.llm import queries
from agentlake.llm import suffix_dedup as S


def brute(docs, length):
    """doc_id -> (bytes, removed spans, kept), by a table of all strings in order."""
    seen, out = set(), {}
    for doc, text in sorted(docs, key=lambda d: d[0]):
        b = (text or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            w = b[i:i + length]
            if w in seen:
                gone[i:i + length] = b"\1" * length
            seen.add(w)
        n_spans = sum(gone[i] and not (i and gone[i - 1]) for i in range(len(b)))
        out[doc] = (len(b), sum(gone), n_spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest())
    return out


def as_dict(df):
    return {r["doc_id"]: (r["n_bytes"], sum(x["stop"] - x["start"] for x in r["removed"]), len(r["removed"]), hashlib.sha256(r["kept"]).hexdigest()) for r in df.collect()}


def test_transform_is_the_transform():
    strings = [b"banana", b"ananas", b"", b"banana", b"\x00\xff\x00"]
    shard = S.Shard(strings, 100)
    text = [(c + 1,) for s in strings for c in s]
    rows = sorted((tuple(c + 1 for c in s[i:]) + (0, k), k, i) for k, s in enumerate(strings) for i in range(len(s) + 1))
    want = [strings[k][i - 1] + 1 if i else 0 for _, k, i in sorted(rows, key=lambda r: [(0, r[1]) if j == len(r[0]) - 2 else (1, c) for j, c in enumerate(r[0][:-1])])]
    assert shard.transform.tolist() == want and len(text) + len(strings) == len(want)


@pytest.mark.parametrize("shard", [1, 40, 10 ** 6])
def test_merge_gives_all_repeats_and_common_prefixes(shard):
    rnd = random.Random(6)
    for _ in range(30):
        strings = [bytes(rnd.choices(b"ab\x00\xff", k=rnd.randrange(0, 60))) for _ in range(rnd.randrange(1, 12))]
        strings += [strings[0][3:] + b"abab"]
        for length in (1, 3, 8):
            block, which, offset = S.repeated(strings, length, shard)
            got = {}
            for x, w, o in zip(block, which, offset):
                got.setdefault(int(x), set()).add((int(w), int(o)))
            places = {}
            for w, s in enumerate(strings):
                for o in range(len(s) - length + 1):
                    places.setdefault(s[o:o + length], set()).add((w, o))
            assert sorted(map(sorted, got.values())) == sorted(sorted(p) for p in places.values() if len(p) > 1)


def test_runs_hold_equal_windows_under_equal_anchors():
    rng = np.random.default_rng(3)
    raw = rng.integers(97, 100, 5000).astype(np.uint8)
    raw[3000:3400] = raw[100:500]
    anchor, first, count, _ = S.runs(raw, 60, 16)
    assert count.sum() == len(raw) - 59 and first.tolist() == np.concatenate([[0], np.cumsum(count)[:-1]]).tolist()
    of = np.repeat(anchor, count)
    assert (of[100:441] == of[3000:3341]).all()
    plain = np.array([S.gram_hashes(raw[i:i + 16], 16)[0] for i in range(200)])
    assert (S.gram_hashes(raw, 16)[:200] == plain).all()


def cases():
    rnd = random.Random(12)
    word = lambda: "".join(rnd.choices("abcdeé", k=rnd.randrange(1, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    line, passage = text(30), text(120)
    docs = [(5, None), (6, ""), (7, "short"), (8, "ab" * 400), (9, "x" * 99), (10, "x" * 101), (11, "x" * 300)]
    base = [text(200) for _ in range(6)]
    for i in range(90):
        t = base[i % 6]
        if i % 3 == 1:
            p = rnd.randrange(len(t))
            t = t[:p] + word() + t[p + 3:]
        if i % 4 == 0:
            t = text(10) + " " + line + " " + t
        if i % 5 == 0:
            t = t + " " + passage + " " + text(20) + (" " + passage) * (i % 10 == 0)
        docs.append((1000 - 7 * i, t))
    docs += [(2000 + i, docs[20 + i % 3][1]) for i in range(20)]
    return docs


@pytest.mark.parametrize("sizes", [{}, {"shard_bytes": 500, "batch_bytes": 4000}, {"most_bytes": 3000}, {"most_bytes": 0}])
def test_cases_equal_brute_force(spark, sizes):
    docs = cases()
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, anchor string, a int").repartition(5)
    got = as_dict(S.dedup(df, 100, 24, **sizes))
    want = brute(docs, 100)
    assert got == want and sum(x[1] for x in want.values()) > 10000


def test_all_documents_equal_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in queries.QUERIES["op2_suffix_dedup"](spark, sf).collect()}
    assert got == brute(docs, 100)


def test_repeated_rows_missing_ids_and_empty_table(spark):
    t = "some text that is long enough to hold a window of one hundred bytes, which it does, as one can count " * 2
    df = spark.createDataFrame([(1, t), (1, t), (2, t), (None, t)], "doc_id long, text string")
    rows = S.dedup(df).collect()
    by = sorted(((r["doc_id"] or 0), len(r["kept"])) for r in rows)
    assert by == [(0, len(t)), (1, 101), (1, 101), (2, 0)]
    assert S.dedup(df.limit(0)).count() == 0
