"""Quality classifier: supervised subword embeddings.

Words, pairs of neighbouring words and byte n-grams are hashed into buckets;
every bucket has a small learned vector, a document is the mean of the vectors of all its
features, and a softmax layer turns that into class probabilities. Vectors and
layer are trained together by plain stochastic gradient descent in numpy.

Training takes at most ``max_rows`` labelled rows, those with the smallest hash
of doc_id (a bounded, documented sample); it runs in one task, and what leaves
it is one row of fixed size. Scoring reads every whole text once: since mean
and softmax layer are linear before the last step, the trained model folds into
one number for each bucket, kept as an integer so that sums are exact and a
score does not depend on how rows are batched.

Defined results: null and empty texts have no features and get the score of the
learned bias; rows without a label, with a null label or a null doc_id are
never trained on; a doc_id with several labels counts as the lowest; with no
labelled rows every score is 0.5; an empty table gives an empty result; extra
columns and clashing names are ignored (only doc_id and text are read).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agentlake.llm.common import small_batches

BITS, DIM, GRAMS = 18, 8, (3, 5)
MAX_ROWS, EPOCHS, RATE, SEED = 3000, 4, 1.0, 11
#: Bytes handled at once; longer texts are cut at white space (at this length if there is none).
CHUNK = 1 << 20
SCALE = 1 << 20

_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)
_BASE = 0x5851F42D4C957F2D
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0], k = 1, 1
    while k < n:
        m = min(k, n - k)
        out[k:k + m] = out[:m] * np.uint64(pow(base, k, 1 << 64))
        k += m
    return out


class Hasher:
    """Bucket ids of all features of a byte buffer."""

    def __init__(self, bits: int = BITS, grams: tuple[int, ...] = GRAMS):
        self.shift, self.grams, self.size = np.uint64(64 - bits), grams, 0

    def _grow(self, n: int) -> None:
        if n > self.size:
            self.size = max(n, 1 << 16)
            self.up, self.down = _powers(_BASE, self.size + 1), _powers(pow(_BASE, -1, 1 << 64), self.size + 1)

    def ngrams(self, b: np.ndarray, n: int) -> np.ndarray:
        """Bucket of the n-gram that starts at each byte but the last n - 1."""
        if len(b) < n:
            return np.empty(0, np.int64)
        h = b[:len(b) - n + 1] * np.uint64(_ODD[0])
        for i in range(1, n):
            h += b[i:len(b) - n + 1 + i] * np.uint64(_ODD[i % 5] + 2 * i)
        h ^= h >> np.uint64(29)
        h *= np.uint64(_ODD[4] + 2 * n)
        return (h >> self.shift).astype(np.int64)

    def words(self, raw: np.ndarray, b: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, bucket) of each word; words end at white space and at ``ends`` of pieces."""
        self._grow(len(b) + 1)
        cut = _SPACE[raw]
        inside = ~cut
        first = inside.copy()
        first[1:] &= cut[:-1]
        heads = ends[:-1][ends[:-1] < len(b)]
        first[heads] = inside[heads]
        last = inside.copy()
        last[:-1] &= cut[1:]
        tails = ends[1:][ends[1:] > 0] - 1
        last[tails] = inside[tails]
        s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
        c = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(b * self.down[:len(b)], out=c[1:])
        h = (c[e] - c[s]) * self.up[s]
        h ^= h >> np.uint64(31)
        h *= np.uint64(_ODD[1])
        return s, (h >> self.shift).astype(np.int64)


    def pairs(self, words: np.ndarray) -> np.ndarray:
        """Bucket of each word with the one before it; 0 for the first. A word that stands
        twice in a row is one feature, whichever word it is (bucket 1)."""
        out = np.zeros(len(words), np.int64)
        w = words.astype(np.uint64)
        h = w[:-1] * np.uint64(_ODD[2]) + w[1:] * np.uint64(_ODD[3])
        h ^= h >> np.uint64(31)
        h *= np.uint64(_ODD[0])
        out[1:] = np.where(w[:-1] == w[1:], 1, (h >> self.shift).astype(np.int64))
        return out


def pieces(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Groups of whole texts, or parts of a long one: (bytes, ends, index of the text of each piece)."""
    parts, owner, size = [], [], 0
    for i, t in enumerate(texts):
        at = 0
        while at < len(t):
            stop = min(len(t), at + CHUNK)
            if stop < len(t):
                gap = max(t.rfind(b" ", at + 1, stop), t.rfind(b"\n", at + 1, stop))
                stop = gap if gap > at else stop
            if size + stop - at > CHUNK and parts:
                yield _joined(parts, owner)
                parts, owner, size = [], [], 0
            parts.append(t[at:stop])
            owner.append(i)
            size += stop - at
            at = stop
    if parts:
        yield _joined(parts, owner)


def _joined(parts: list[bytes], owner: list[int]):
    return np.frombuffer(b"".join(parts), np.uint8), np.cumsum([0, *map(len, parts)]), np.array(owner)


def _sums(values: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    c = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=c[1:])
    return c[stops] - c[starts]


def totals(texts: list[bytes], table: np.ndarray, hasher: Hasher) -> tuple[np.ndarray, np.ndarray]:
    """For each text the sum of the table's integers over all its features, and their number."""
    sums, counts = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    for raw, ends, owner in pieces(texts):
        b = raw.astype(np.uint64)
        for n in hasher.grams:
            v = table[hasher.ngrams(b, n)]
            a = np.minimum(ends[:-1], len(v))
            e = np.maximum(np.minimum(ends[1:] - n + 1, len(v)), a)
            np.add.at(sums, owner, _sums(v, a, e))
            np.add.at(counts, owner, e - a)
        s, w = hasher.words(raw, b, ends)
        at = np.searchsorted(s, ends)
        pair = hasher.pairs(w)
        pair[at[:-1][at[:-1] < at[1:]]] = 0  # a piece's first word has none before
        np.add.at(sums, owner, _sums(table[w].astype(np.int64) + table[pair], at[:-1], at[1:]))
        np.add.at(counts, owner, 2 * (at[1:] - at[:-1]))
    return sums, counts


def buckets(text: bytes, hasher: Hasher) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and how often each occurs."""
    found = []
    for raw, ends, _ in pieces([text]):
        b = raw.astype(np.uint64)
        w = hasher.words(raw, b, ends)[1]
        found += [*(hasher.ngrams(b, n) for n in hasher.grams), w, hasher.pairs(w)]
    ids, counts = np.unique(np.concatenate([np.empty(0, np.int64), *found]), return_counts=True)
    return ids.astype(np.int32), counts.astype(np.int32)


def _train(rows: list[tuple[int, np.ndarray, np.ndarray]], bits: int, dim: int, epochs: int, rate: float, seed: int) -> tuple[np.ndarray, float]:
    """Stochastic gradient descent over (label, ids, counts): the folded table and bias."""
    rng = np.random.default_rng(seed)
    vec = rng.uniform(-1 / dim, 1 / dim, (1 << bits, dim)).astype(np.float32)
    out, bias = np.zeros((2, dim), np.float32), np.zeros(2, np.float32)
    steps, done = epochs * len(rows), 0
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            y, ids, counts = rows[k]
            lr = rate * (1 - done / steps)
            done += 1
            share = (counts / max(counts.sum(), 1)).astype(np.float32)
            h = share @ vec[ids]
            z = out @ h + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            back = p @ out
            out -= lr * np.outer(p, h)
            bias -= lr * 0.1 * p
            np.clip(out, -50, 50, out=out)
            # a feature's step is its share of the mean; scaled so that a typical feature moves
            vec[ids] -= lr * np.minimum(share * 50, 1)[:, None] * back
    fold = vec @ (out[1] - out[0])
    return np.rint(np.clip(fold.astype(np.float64), -1000, 1000) * SCALE).astype(np.int32), float(bias[1] - bias[0])


def sample(docs: DataFrame, labels: DataFrame, label: str, allowed, max_rows: int) -> DataFrame:
    """doc_id, text, y of the labelled rows to train on; ``allowed``: a condition on doc_id."""
    one = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & allowed).groupBy("doc_id").agg(F.min(label).cast("int").alias("y"))
    chosen = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)  # at most max_rows ids are broadcast
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", allowed=None, max_rows: int = MAX_ROWS, bits: int = BITS, dim: int = DIM,
        epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> tuple[bytes, float]:
    """Trains in one task; returns the folded model (4 bytes a bucket) and its bias."""
    small_batches(docs.sparkSession)

    def hashed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = Hasher(bits)
        for pdf in frames:
            found = [buckets((t or "").encode(), hasher) for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "y": pdf["y"], "ids": [i.tobytes() for i, _ in found], "counts": [c.tobytes() for _, c in found]})

    def learn(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = sorted(((int(r.doc_id), int(r.y), r.ids, r.counts) for pdf in frames for r in pdf.itertuples()), key=lambda r: r[:3])
        if rows:
            table, bias = _train([(y, np.frombuffer(i, np.int32), np.frombuffer(c, np.int32)) for _, y, i, c in rows], bits, dim, epochs, rate, seed)
            yield pd.DataFrame({"model": [table.tobytes()], "bias": [bias]})

    rows = sample(docs, labels, label, F.lit(True) if allowed is None else allowed, max_rows)
    model = rows.mapInPandas(hashed, "doc_id long, y int, ids binary, counts binary").repartition(1).mapInPandas(learn, "model binary, bias double").collect()
    return (bytes(model[0]["model"]), model[0]["bias"]) if model else (bytes(4 << bits), 0.0)


def scored(docs: DataFrame, model: tuple[bytes, float], name: str = "score") -> DataFrame:
    """Adds the probability of class 1 for every row; other columns stay."""
    blob, bias = model
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(blob)  # 4 bytes a bucket, whatever the input

    @F.pandas_udf("double")
    def prob(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        table = np.frombuffer(shared.value, np.int32)
        hasher = Hasher(int(len(table)).bit_length() - 1)
        for s in texts:
            out = np.empty(len(s))
            data, at = [], 0
            for i, t in enumerate(s):  # at most a few MB of a batch are encoded at once
                data.append((t or "").encode())
                if sum(map(len, data[-1:])) >= CHUNK or len(data) >= 512 or i == len(s) - 1:
                    sums, counts = totals(data, table, hasher)
                    z = sums / (np.maximum(counts, 1) * float(SCALE)) + bias
                    out[at:at + len(data)] = 1 / (1 + np.exp(-z))
                    at, data = at + len(data), []
            yield pd.Series(out)

    return docs.withColumn(name, prob(F.coalesce(F.col("text"), F.lit(""))))
