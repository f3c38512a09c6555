"""Ranked lexical search with Block-Max MaxScore over shards.

Documents are indexed in *shards*: a task turns each run of about ``SHARD_BYTES`` of
its texts into posting lists of its own, without a shuffle. A list is cut into blocks
of ``BLOCK`` postings, written with as few bytes a number as the block needs. Beside a
block stand its last document and its *frontier*: the pairs (tf, length) that no other
posting of the block beats in both. Scores rise with tf and fall with length, so the
frontier gives the block's exact maximum for any corpus statistics; an index need not
know them, and shards can be added later.

A search adds up the statistics of all shards (documents, terms, document frequencies),
then runs every shard through Block-Max MaxScore. Lists stand in order of their global
bound (the largest block maximum times the term's weight). Those whose bounds together
stay below the k-th best score so far are non-essential: a document in no other list
cannot enter. Ranges of documents are taken in turn: essential lists give candidates
and their scores; then the non-essential lists, largest bound first, are looked into
only for candidates that the bounds of the rest still let in, and only where the maximum
of the block the candidate would stand in does so too, so most blocks are never
decompressed. A task carries its heaps, and so the bound, from shard to shard; the heaps
of all tasks are merged by a rank over k rows a task.

All numbers are integers: a term weighs floor(1000 ln((2 N + 2) / (2 df + 1))), a document
of length n has m = 10 + (90 n N) div L, and a term scores weight * ((10^9 tf) div (1000 tf + 8 m)).

Memory: a task holds one shard's lists of the query's terms. Queries go to the tasks in
parts of about ``QUERY_TERMS`` (item, term) pairs (an item is not divided), each part one
pass over the index's rows of its terms.

Defined results: null, empty or term-less texts are not among the documents; rows without
a doc_id are left out; each row is a document, repeated ones too; items that stand in
several rows ask for the terms of all of them, items without terms or id give no rows;
equal scores rank by doc_id; documents with score 0 are not returned; an empty table gives
an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from math import floor, log

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from agentlake.llm.common import arrow_batches, ascii_lower, stored

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SHARD_BYTES, BLOCK, RANGE = 1 << 24, 128, 1024
QUERY_TERMS = 1 << 20
TEXTS, ROWS = 256, 1 << 10

INDEX = "shard long, term string, df long, n_terms long, head binary, frontier binary, data binary"
#: A block: last document, where its bytes begin, bytes of a gap and of a tf, size of its frontier.
HEAD = np.dtype([("last", "<u4"), ("at", "<u4"), ("gap", "u1"), ("tf", "u1"), ("front", "<u2")])
_FIND = re.compile(TERM.encode())


# -- the index --------------------------------------------------------------------------------------------------------------

def _widths(most: np.ndarray) -> np.ndarray:
    return np.where(most < 1 << 8, 1, np.where(most < 1 << 16, 2, 4))


def _encode(gaps: np.ndarray, tfs: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all blocks one behind the other (gaps, then tfs, of each), where each
    block begins (one more than there are), and the widths of both."""
    firsts = np.flatnonzero(np.diff(block, prepend=-1))
    size = np.diff(np.append(firsts, len(block)))
    wide_g, wide_t = _widths(np.maximum.reduceat(gaps, firsts)), _widths(np.maximum.reduceat(tfs, firsts))
    starts = np.concatenate([[0], np.cumsum(size * (wide_g + wide_t))])
    out = np.empty(starts[-1], np.uint8)
    rank = np.arange(len(block)) - firsts[block]
    for values, wide, begin in ((gaps, wide_g, starts[:-1]), (tfs, wide_t, starts[:-1] + size * wide_g)):
        raw = values.astype("<u4").view(np.uint8).reshape(-1, 4)
        for w in (1, 2, 4):
            rows = np.flatnonzero(wide[block] == w)
            to = begin[block[rows]] + rank[rows] * w
            for byte in range(w):
                out[to + byte] = raw[rows, byte]
    return out, starts, wide_g, wide_t


def _frontiers(tfs: np.ndarray, lengths: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(tf, length) pairs that no posting of the same block beats, by block, and how many each has."""
    order = np.lexsort((lengths, -tfs, block))
    b, t, n = block[order], tfs[order], lengths[order]
    low = n - b * (int(n.max()) + 1)  # falls from block to block: running minima start anew
    best = np.minimum.accumulate(low)
    kept = np.concatenate([[True], low[1:] < best[:-1]])
    return np.stack([t[kept], n[kept]], 1).astype("<u4"), np.bincount(b[kept])


class Builder:
    """The shard that a task is writing: its documents as term numbers and frequencies."""

    def __init__(self):
        self.ids, self.number, self.terms, self.tfs, self.lengths, self.size = [], {}, [], [], [], 0

    def add(self, doc: int, raw: bytes) -> None:
        found = Counter(_FIND.findall(raw))
        if found:
            number = self.number
            self.ids.append(doc)
            self.terms.append(np.array([number.setdefault(t, len(number)) for t in found], np.int64))
            self.tfs.append(np.array(list(found.values()), np.int64))
            self.lengths.append(found.total())
            self.size += len(raw)

    def rows(self, shard: int) -> pd.DataFrame:
        return shard_rows(shard, np.array(self.ids, np.int64), np.array(self.lengths, np.int64), list(self.number),
                          np.concatenate(self.terms), np.concatenate(self.tfs), np.repeat(np.arange(len(self.ids)), [len(t) for t in self.terms]))


def shard_rows(shard: int, ids: np.ndarray, lengths: np.ndarray, names: list[bytes], terms: np.ndarray, tfs: np.ndarray, at: np.ndarray) -> pd.DataFrame:
    """Index rows of a shard: its documents (term null: df, n_terms, lengths in head,
    ids in data) and one row for each of its terms. ``terms``, ``tfs`` and ``at`` are
    the numbers of the postings' terms, their frequencies and their documents, in order of documents."""
    order = np.argsort(terms, kind="stable")
    terms, tfs, at = terms[order], tfs[order], at[order]
    df = np.bincount(terms)
    first = np.concatenate([[0], np.cumsum(df)])
    rank = np.arange(len(terms)) - first[terms]
    blocks = -(-df // BLOCK)
    block_of = np.concatenate([[0], np.cumsum(blocks)])
    block = block_of[terms] + rank // BLOCK
    gaps = np.diff(at, prepend=-1)
    gaps[first[:-1]] = at[first[:-1]] + 1  # the first of a list counts from before document 0
    data, starts, wide_g, wide_t = _encode(gaps, tfs, block)
    frontier, sizes = _frontiers(tfs, lengths[at], block)
    head = np.empty(len(starts) - 1, HEAD)
    ends = np.append(np.flatnonzero(np.diff(block)), len(block) - 1)
    head["last"], head["gap"], head["tf"], head["front"] = at[ends], wide_g, wide_t, sizes
    list_at = starts[block_of]
    head["at"] = starts[:-1] - np.repeat(list_at[:-1], blocks)
    fronts = np.concatenate([[0], np.cumsum(sizes)])[block_of]
    raw, front, heads = data.tobytes(), frontier.tobytes(), head.tobytes()
    cut = lambda x, c, w: [x[a * w:b * w] for a, b in zip(c[:-1].tolist(), c[1:].tolist())]
    rows = pd.DataFrame({"shard": shard, "term": [t.decode() for t in names], "df": df, "n_terms": 0, "head": cut(heads, block_of, HEAD.itemsize),
                         "frontier": cut(front, fronts, 8), "data": cut(raw, list_at, 1)})
    docs = pd.DataFrame({"shard": [shard], "term": [None], "df": [len(ids)], "n_terms": [int(lengths.sum())],
                         "head": [lengths.astype("<i8").tobytes()], "frontier": [b""], "data": [ids.astype("<i8").tobytes()]})
    return pd.concat([docs, rows], ignore_index=True)


def index(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The index of all documents, written to the shared folder."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, held = TaskContext.get().partitionId() << 32, Builder()
        for pdf in frames:
            for doc, text in zip(pdf["doc_id"].tolist(), pdf["text"]):
                held.add(doc, text.encode().lower())  # bytes: A-Z only
                if held.size >= shard_bytes:
                    yield held.rows(shard)
                    shard, held = shard + 1, Builder()
        if held.ids:
            yield held.rows(shard)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id IS NOT NULL AND text IS NOT NULL")
    with arrow_batches(docs.sparkSession, TEXTS):
        return stored(rows.mapInPandas(run, INDEX), "search-index")


# -- search in a shard --------------------------------------------------------------------------------------------------------

def weight(n_docs: int, df: int) -> int:
    return floor(1000 * log((2 * n_docs + 2) / (2 * df + 1)))


def length_terms(lengths: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """8 m of documents of these lengths."""
    if int(lengths.max(initial=0)) * n_docs * 90 >= 1 << 63:
        lengths = lengths.astype(object)
    return (8 * (10 + 90 * lengths * n_docs // n_terms)).astype(np.int64)


def impact(tf: np.ndarray, eight_m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + eight_m)


class Postings:
    """One list of a shard. Blocks are decompressed when asked for, once."""

    def __init__(self, df: int, head: bytes, frontier: bytes, data: bytes, shard: Shard):
        self.df, self.data, self.shard = df, data, shard
        self.head = np.frombuffer(head, HEAD)
        self.last = self.head["last"].astype(np.int64)
        tf, n = np.frombuffer(frontier, "<u4").reshape(-1, 2).astype(np.int64).T
        sizes = self.head["front"].astype(np.int64)
        self.most = np.maximum.reduceat(impact(tf, length_terms(n, shard.n_docs, shard.n_terms)), np.cumsum(sizes) - sizes)
        self.bound = int(self.most.max())
        self.open: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def block(self, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and impacts of a block."""
        if b not in self.open:
            self.shard.opened += 1
            _, at, gap, tf, _ = self.head[b].tolist()
            n = min(BLOCK, self.df - b * BLOCK)
            gaps = np.frombuffer(self.data, f"<u{gap}", n, at)
            tfs = np.frombuffer(self.data, f"<u{tf}", n, at + n * gap).astype(np.int64)
            docs = np.cumsum(gaps, dtype=np.int64) + (self.last[b - 1] if b else -1)
            self.open[b] = docs, impact(tfs, self.shard.eight_m[docs])
        return self.open[b]

    def between(self, lo: int, hi: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Postings of documents lo to hi - 1."""
        for b in range(int(np.searchsorted(self.last, lo)), len(self.last)):
            docs, scores = self.block(b)
            x, y = np.searchsorted(docs, (lo, hi))
            if x < y:
                yield docs[x:y], scores[x:y]
            if self.last[b] >= hi:
                break


class Shard:
    """Documents and wanted lists of a shard under the statistics of the whole corpus."""

    def __init__(self, ids: bytes, lengths: bytes, n_docs: int, n_terms: int):
        self.ids, self.n_docs, self.n_terms, self.opened = np.frombuffer(ids, "<i8"), n_docs, n_terms, 0
        self.eight_m = length_terms(np.frombuffer(lengths, "<i8"), n_docs, n_terms)
        self.lists: dict[str, Postings] = {}

    def add(self, term: str, df: int, head: bytes, frontier: bytes, data: bytes) -> None:
        self.lists[term] = Postings(df, head, frontier, data, self)

    def search(self, terms: list[tuple[str, int]], k: int, heap: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The heap (scores, falling, and doc_ids) of (term, weight) pairs with this shard's documents."""
        found = [(w, self.lists[t]) for t, w in terms if w > 0 and t in self.lists]
        found.sort(key=lambda x: x[0] * x[1].bound)
        upto = np.cumsum([w * p.bound for w, p in found])  # bounds of a list and all smaller ones, together
        for lo in range(0, len(self.ids), RANGE):
            hi = min(lo + RANGE, len(self.ids))
            # what a document needs at least; an equal score may still enter by its doc_id
            need = max(int(heap[0][-1]) if len(heap[0]) == k else 1, 1)
            essential = int(np.searchsorted(upto, need))
            if essential == len(found):
                break
            scores = np.zeros(hi - lo, np.int64)
            for w, p in found[essential:]:
                for docs, values in p.between(lo, hi):
                    scores[docs - lo] += w * values
            docs = lo + np.flatnonzero(scores)
            scores = scores[docs - lo]
            for i in range(essential - 1, -1, -1):
                docs, scores = self._more(found[i], docs, scores, need, int(upto[i]), int(upto[i - 1]) if i else 0)
            heap = self._pushed(heap, scores[scores >= need], self.ids[docs[scores >= need]], k)
        return heap

    @staticmethod
    def _more(part: tuple[int, Postings], docs: np.ndarray, scores: np.ndarray, need: int, upto: int, below: int) -> tuple[np.ndarray, np.ndarray]:
        """Candidates with a non-essential list's scores added; without those that its
        bound, or the maximum of the block they would stand in, rules out."""
        w, p = part
        open_ = scores + upto >= need
        docs, scores = docs[open_], scores[open_]
        at = np.searchsorted(p.last, docs)
        most = w * np.append(p.most, 0)[at]
        open_ = scores + most + below >= need
        docs, scores, at = docs[open_], scores[open_], at[open_]
        cuts = np.flatnonzero(np.diff(at, prepend=-1))
        for x, y in zip(cuts, np.append(cuts[1:], len(at))):
            if at[x] < len(p.last):
                inside, values = p.block(int(at[x]))
                place = np.minimum(np.searchsorted(inside, docs[x:y]), len(inside) - 1)
                scores[x:y] += w * np.where(inside[place] == docs[x:y], values[place], 0)
        return docs, scores

    @staticmethod
    def _pushed(heap: tuple[np.ndarray, np.ndarray], scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        if not len(scores):
            return heap
        scores, ids = np.concatenate([heap[0], scores]), np.concatenate([heap[1], ids])
        first = np.lexsort((ids, -scores))[:k]
        return scores[first], ids[first]


# -- search over all shards ---------------------------------------------------------------------------------------------------

def _best(rows: DataFrame, asked: dict[int, list[tuple[str, int]]], n_docs: int, n_terms: int, k: int) -> DataFrame:
    """Index rows of the asked terms, and of all documents, -> each task's heaps (item_id, doc_id, score)."""
    shared = rows.sparkSession.sparkContext.broadcast(asked)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        nothing = np.empty(0, np.int64)
        heaps, shard, number = {}, None, None

        def done() -> None:
            for item, terms in shared.value.items():
                heaps[item] = shard.search(terms, k, heaps.get(item, (nothing, nothing)))

        for pdf in frames:
            for s, term, df, head, frontier, data in pdf.itertuples(index=False, name=None):
                if s != number:
                    if shard is not None:
                        done()
                    shard, number = Shard(data, head, n_docs, n_terms), s  # the documents' row comes first
                else:
                    shard.add(term, df, head, frontier, data)
        if shard is not None:
            done()
        for item, (scores, ids) in heaps.items():
            if len(ids):
                yield pd.DataFrame({"item_id": item, "doc_id": ids, "score": scores})

    dealt = rows.repartition("shard").sortWithinPartitions("shard", F.col("term").asc_nulls_first())
    return dealt.select("shard", "term", "df", "head", "frontier", "data").mapInPandas(run, "item_id long, doc_id long, score long")


def query_terms(items: DataFrame) -> DataFrame:
    """(item_id, text) -> distinct (item_id, term)."""
    found = F.regexp_extract_all("low", F.lit(TERM), 0)
    rows = items.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), ascii_lower(F.col("text")).alias("low"))
    return rows.select("item_id", F.explode(found).alias("term")).distinct()


def search(lists: DataFrame, items: DataFrame, k: int = 10, part_terms: int = QUERY_TERMS) -> DataFrame:
    """item_id, rank, doc_id, score of the k best documents of an index for each item."""
    spark = lists.sparkSession
    n_docs, n_terms = lists.where("term IS NULL").agg(F.coalesce(F.sum("df"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).collect()[0]
    terms = stored(query_terms(items), "search-terms")
    parts = max(1, -(-terms.count() // part_terms))
    heaps = []
    for part in range(parts if n_docs else 0):
        asked = terms.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part)
        wanted = lists.join(F.broadcast(asked.select("term").distinct()), "term", "left_semi")
        df = wanted.groupBy("term").agg(F.sum("df").alias("df"))
        weights: dict[int, list[tuple[str, int]]] = {}
        for item, term, n in asked.join(df, "term").select("item_id", "term", "df").toPandas().itertuples(index=False, name=None):
            weights.setdefault(item, []).append((term, weight(n_docs, n)))
        rows = lists.where("term IS NULL").unionByName(wanted.select(lists.columns))
        with arrow_batches(spark, ROWS):
            heaps.append(stored(_best(rows, weights, n_docs, n_terms, k), "search-heaps"))
    if not heaps:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    by_item = Window.partitionBy("item_id").orderBy(F.col("score").desc(), "doc_id")
    every = reduce(DataFrame.unionAll, heaps)
    return every.withColumn("rank", F.row_number().over(by_item)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
