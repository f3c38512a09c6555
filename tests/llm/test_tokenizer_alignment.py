"""Alignment against a plain recomputation by ranges, both ways of joining counts, edge cases."""

import hashlib
import json
import random
from collections import Counter

import pyarrow.parquet as pq
import pytest

from agentlake.llm import tokenizer_alignment as T
from agentlake.llm.queries import QUERIES, TOKENIZERS

A_PATH, B_PATH = f"{TOKENIZERS}/byte_bpe_50k.json", f"{TOKENIZERS}/piece_bpe_32k.model"


@pytest.fixture(scope="module")
def aligner():
    with open(A_PATH, encoding="utf-8") as a, open(B_PATH, "rb") as b:
        return T.Aligner(a.read(), b.read())


def plain_tokens(text):
    """[(id, bytes)] of both, or None."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer, decoders
    a = Tokenizer.from_file(A_PATH)
    a.encode_special_tokens = True
    sp = SentencePieceProcessor(model_file=B_PATH)
    letters = {c: b for c, b in T.byte_alphabet().items()}
    one = [(i, bytes(letters[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    two = []
    for i in sp.encode(text):
        p = sp.id_to_piece(i)
        two.append((i, bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode()))
    assert decoders is not None
    whole = (" " + text).encode()
    return (one, two) if b"".join(t for _, t in one) == whole == b"".join(t for _, t in two) else None


def ranges(tokens):
    out, at = [], 0
    for i, t in tokens:
        out.append((i, at, at + len(t)))
        at += len(t)
    return out


def plain(text):
    """(n_a, n_b, n_groups, n_links, group string, Counter of pairs) or None."""
    found = plain_tokens(text) if text else None
    if not found:
        return None
    a, b = map(ranges, found)
    links, j = Counter(), 0
    for i, s, e in a:
        while b[j][2] <= s:
            j += 1
        k = j
        while k < len(b) and b[k][1] < e:
            links[i, b[k][0]] += 1
            k += 1
    cuts = sorted({e for _, _, e in a} & {e for _, _, e in b})
    groups, lo = [], 0
    for hi in cuts:
        groups.append("|".join(",".join(str(i) for i, s, e in side if lo < e <= hi) for side in (a, b)))
        lo = hi
    return len(a), len(b), len(cuts), sum(links.values()), ";".join(groups), links


TEXTS = ["a", " ", "hello world", "<|endoftext|> </s><s> [INST] ok", "Größe naïve 東京タワー 🎉🎉", "x\n\n\ty  z", "don't  stop 12345678", "▁ hidden", "a▁b", "\x00\x01", "é  　x",
         "tab\tand   spaces   ", "  lead"]


def digest(line):
    return hashlib.sha256(line.encode()).hexdigest()


def test_align(aligner):
    got = aligner.align(TEXTS)
    for text, found in zip(TEXTS, got):
        want = plain(text)
        assert (found is None) == (want is None), text
        if want:
            assert found[:5] == (*want[:4], digest(want[4])), text
            size = len(aligner.bytes_b)
            assert {(int(p) // size, int(p) % size): int(n) for p, n in zip(found[5], found[6])} == dict(want[5])
    assert got[TEXTS.index("a▁b")] is None


def test_tokens_of_a_text_cut_are_those_of_the_whole(aligner, monkeypatch):
    rng = random.Random(5)
    words = ["a", "word", "don't", "x1y2", "東京", "naïve", "...", "\n", "\t", "", "", "<s>", "1234", " ", "ab▁c", "🎉"]
    texts = [" ".join(rng.choices(words, k=400)) for _ in range(30)]
    lists = lambda found: [[x.tolist() for x in side] for side in found]
    whole = lists(aligner.ids(texts))
    assert all(T.slices(t, 20) != [t] and "".join(T.slices(t, 20)) == t for t in texts)
    monkeypatch.setattr(T, "SLICE", 20)
    assert not aligner.crosses
    assert lists(aligner.ids(texts)) == whole


def test_both_engines_of_a_agree(aligner):
    """On every token of the vocabulary alone, on whole documents and on odd texts."""
    rng = random.Random(6)
    texts = [b.decode() for b in aligner.bytes_a if _decodes(b)]
    texts += ["".join(rng.choices(texts, k=rng.randint(2, 60))) for _ in range(3000)]
    texts += ["".join(chr(rng.choice([rng.randrange(0x377), rng.randrange(0x3a3, 0x523), rng.randrange(0x4e00, 0x9fa5), 32, 10])) for _ in range(80)) for _ in range(1500)]
    texts += [r["text"] for r in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).to_pylist() if r["text"]]
    own = aligner.a.encode_batch_fast(texts, add_special_tokens=False)
    fast = [t for t in texts if T._SETTLED.fullmatch(t)]
    assert len(fast) > 40000
    assert [x.tolist() for x in aligner.ids_a(texts)] == [e.ids for e in own]


def test_every_merge_is_the_last_of_its_token(aligner):
    """Ranking merges by their result is ranking them by pair: under the merges before it,
    a token's bytes come to exactly the two parts that its own merge joins."""
    model = json.loads(aligner.a.to_str())["model"]
    letters, ranks = T.byte_alphabet(), {}
    as_bytes = lambda t: bytes(letters[c] for c in t)
    for pair in model["merges"]:
        x, y = map(as_bytes, pair if isinstance(pair, list) else pair.split(" "))
        parts = [bytes([c]) for c in x + y]
        while len(parts) > 2:
            best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], 1 << 30))
            assert parts[best] + parts[best + 1] in ranks
            parts[best:best + 2] = [parts[best] + parts[best + 1]]
        assert parts == [x, y]
        ranks[x + y] = model["vocab"]["".join(pair) if isinstance(pair, list) else pair.replace(" ", "")]
    assert list(ranks.values()) == sorted(ranks.values())


def _decodes(b):
    try:
        return bool(b.decode())
    except UnicodeDecodeError:
        return False


def expected(rows):
    each = [plain(t) for _, t in rows]
    total = Counter()
    for x in each:
        total.update(x[5] if x else {})
    top = {}
    for (_, b), n in total.items():
        top[b] = max(top.get(b, 0), n)
    out = []
    for (doc, _), x in zip(rows, each):
        if not x:
            out.append((doc, 0, 0, 0, 0, 0, 0, ""))
        else:
            best = sum(n for p, n in x[5].items() if total[p] == top[p[1]])
            out.append((doc, *x[:4], best, sum(n * total[p] for p, n in x[5].items()), digest(x[4])))
    return out


@pytest.mark.parametrize("limit", [T.BROADCAST_PAIRS, 0])
def test_rows(spark, limit):
    """Counts broadcast, and joined by a shuffle."""
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(100, None), (101, ""), (None, "hello world"), (2, "hello world"), (2, "hello world"), (102, "word " * 30000)]
    docs = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, copies long, key string")
    got = T.measure(docs, A_PATH, B_PATH, limit)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(expected(rows), key=str)


def test_empty(spark):
    assert T.measure(spark.createDataFrame([], "doc_id long, text string"), A_PATH, B_PATH).collect() == []


def test_query_on_all_documents(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, QUERIES["op11_token_alignment"](spark, sf_dir).collect())) == sorted(expected(docs))
