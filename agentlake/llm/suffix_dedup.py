"""Suffix-array dedup: removes every byte covered by a string of ``length``
bytes that also starts earlier, by merging shard Burrows-Wheeler transforms.

1. Equal texts are one text: all but the least doc_id are covered whole.
2. Every window of ``length`` bytes has an *anchor*, the least hash of the k-byte
   strings in it. Equal windows have equal anchors, so the windows of a document
   fall into runs of one anchor, and only runs whose anchor occurs elsewhere too
   (or twice in one document) can hold a repeat. This loses nothing.
3. Such runs meet by anchor. A task sends a run's string once; further equal
   ones of the task, later by order, are covered already and leave as marks, so
   a passage that a third of all documents share is a row for each task.
4. A task holds the runs of its anchors in shards of bounded size, each with its
   suffix order, Burrows-Wheeler transform and LF mapping. The shards are merged
   by iterative interleave refinement: round h turns the interleave by the first
   h symbols into that by h + 1, by one stable sort of the transforms' symbols.
   Places where neighbours part in round h are common prefixes of h - 1 symbols;
   rows that are alone stay alone and leave the refinement. After ``length``
   rounds what is left are the intervals of repeated strings. No suffix is
   compared or sorted again.
5. In each interval all but the first (doc_id, start) cover their bytes.

Anchors with more than ``most_bytes`` of distinct strings would not fit a task:
their windows go one by one to tasks by a 128-bit hash of the window.

Defined results: null and empty texts have no bytes and nothing removed;
repeated rows of a doc_id are one document and give equal results; ties cannot
be, as (doc_id, start) is unique; rows without a doc_id are compared with
nothing and stay whole; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from agentlake.llm.common import small_batches, stored

LENGTH, GRAM = 100, 24
SHARD_BYTES, BATCH_BYTES, MOST_BYTES = 1 << 18, 1 << 21, 1 << 25

_BASE = 0x5851F42D4C957F2D


# -- anchors --------------------------------------------------------------------------------------------------------------

def gram_hashes(raw: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of the k bytes from every place, built by doubling."""
    done, size = None, 0
    part, width, left = raw.astype(np.uint64) + np.uint64(1), 1, k
    while True:
        if left & 1:
            if done is None:
                done, size = part, width
            else:
                n = len(raw) - size - width + 1
                done, size = done[:n] * np.uint64(pow(_BASE, width, 1 << 64)) + part[size:size + n], size + width
        left >>= 1
        if not left:
            break
        n = len(raw) - 2 * width + 1
        part, width = part[:n] * np.uint64(pow(_BASE, width, 1 << 64)) + part[width:width + n], 2 * width
    done = done ^ (done >> np.uint64(29))
    done *= np.uint64(0xD6E8FEB86659FD93)
    return done ^ (done >> np.uint64(32))


def _sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) of every ``width`` neighbours, by doubling."""
    out, span, n = values, 1, len(values) - width + 1
    while span * 2 <= width:
        out, span = pick(out[:-span], out[span:]), span * 2
    return pick(out[:n], out[width - span:width - span + n])


def runs(raw: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first window, number of windows, whether the anchor may stand
    more than once in the run) of the runs of windows with one anchor."""
    if len(raw) < length:
        none = np.empty(0, np.int64)
        return none.view(np.uint64), none, none, none.astype(bool)
    h = gram_hashes(raw, k)
    w, n = length - k + 1, len(raw) - length + 1
    low = _sliding(h, w, np.minimum)
    first = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
    count = np.diff(np.append(first, n))
    anchor = low[first]
    # a place is the least of some window if the greatest least of the windows over it is its own hash
    edge = np.zeros(w - 1, np.uint64)
    places = h[np.flatnonzero(_sliding(np.concatenate([edge, low, edge]), w, np.maximum) == h)]
    again = places[1:][places[1:] == places[:-1]]
    twice = count > w
    if len(again):
        twice |= np.isin(anchor, again)
    return anchor, first, count, twice


# -- transforms and their merge -------------------------------------------------------------------------------------------

class Shard:
    """Strings with end marks: their suffixes in order (by ``length`` symbols and
    more, equal ones by string), the transform, the LF mapping."""

    def __init__(self, strings: list[bytes], length: int):
        lens = np.array([len(s) + 1 for s in strings])
        starts = np.concatenate([[0], np.cumsum(lens)[:-1]])
        symbols = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8).astype(np.uint16) + np.uint16(1)
        marks = starts + lens - 1
        symbols[marks] = 0
        n = len(symbols)
        left = np.repeat(marks, lens) - np.arange(n)  # symbols before the end mark
        padded = np.concatenate([symbols, np.zeros(8, np.uint16)])
        rank, step = np.zeros(n, np.int64), 6  # six symbols of 0..256 in one number
        for i in range(step):
            rank = rank * 257 + np.where(left >= i, padded[i:n + i], 0)
        order = np.argsort(rank, kind="stable")
        while True:
            in_order = rank[order]
            number = np.empty(n, np.int64)
            number[order] = np.cumsum(np.concatenate([[0], in_order[1:] != in_order[:-1]]))
            if step >= length:
                break
            # what follows an end mark does not count: equal short suffixes stay in the order of their strings
            after = np.zeros(n, np.int64)
            after[:-step] = number[step:] + 1
            rank = number * (n + 1) + np.where(left > step, after, 0)
            order, step = np.argsort(rank, kind="stable"), step * 2
        place = np.empty(n, np.int32)
        place[order] = np.arange(n, dtype=np.int32)
        self.suffix = order
        before = order - 1
        self.transform = symbols[before]
        self.transform[place[starts]] = 0
        self.lf = place[before]  # of no meaning where the transform holds an end mark


def merge(shards: list[Shard], length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """After each round (symbols so far, rows in interleaved order, their block):
    only rows that share that many symbols with another one. A round takes two
    symbols if their pairs have 16-bit codes (one for the last of an odd number)."""
    sizes = np.cumsum([0, *(len(s.transform) for s in shards)])
    transform = np.concatenate([s.transform for s in shards])
    lf = np.concatenate([s.lf + np.int32(a) for s, a in zip(shards, sizes)])
    used = np.flatnonzero(np.bincount(transform, minlength=258))
    code = np.zeros(258, np.uint16)
    code[used] = np.arange(len(used)) + (used[0] > 0)  # 0 stays the end mark
    transform = code[transform]
    wide = int(code.max()) < 256
    if wide:
        second = transform[lf]
        pairs = transform * np.uint16(256) + second
        pairs[(transform == 0) | (second == 0)] = 0
        pairs_lf = lf[lf]
    rows, block, depth = np.arange(len(transform), dtype=np.int32), np.zeros(len(transform), np.int32), 0
    while depth < length:
        two = wide and depth + 2 <= length
        depth += 1 + two
        symbol = (pairs if two else transform)[rows]
        inner = np.flatnonzero(symbol)
        order = inner[np.argsort(symbol[inner], kind="stable")]
        symbol, source, rows = symbol[order], block[order], (pairs_lf if two else lf)[rows[order]]
        part = np.ones(len(rows) + 1, bool)
        part[1:-1] = (symbol[1:] != symbol[:-1]) | (source[1:] != source[:-1])
        shared = ~(part[:-1] & part[1:])
        block = np.cumsum(part[:-1], dtype=np.int32)[shared]
        rows = rows[shared]
        yield depth, rows, block
        if not len(rows):
            return


def repeated(strings: list[bytes], length: int, shard_bytes: int = SHARD_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(interval, string, offset) of all places of strings of ``length`` bytes that occur more than once."""
    groups, size = [[]], 0
    for s in strings:
        if size and size + len(s) > shard_bytes:
            groups.append([])
            size = 0
        groups[-1].append(s)
        size += len(s) + 1
    shards = [Shard(g, length) for g in groups if g]
    depth, rows, block = 0, np.empty(0, np.int64), np.empty(0, np.int64)
    for depth, rows, block in merge(shards, length):
        pass
    if depth < length:
        rows, block = rows[:0], block[:0]
    at = np.concatenate([s.suffix + a for s, a in zip(shards, np.cumsum([0, *(len(s.suffix) for s in shards)]))])[rows]
    starts = np.cumsum([0, *(len(s) + 1 for s in strings)])
    which = np.searchsorted(starts, at, "right") - 1
    return block, which, at - starts[which]


def shared_windows(strings: list[bytes], length: int) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(parts, the string of each, where it begins there): runs of windows whose
    64-bit hash occurs more than once in these strings. No window that is repeated
    is left out; windows that only share a hash part in the transforms' merge."""
    lens = np.array([len(s) for s in strings])
    stops = np.cumsum(lens)
    raw = np.frombuffer(b"".join(strings), np.uint8)
    h = gram_hashes(raw, length)
    inside = np.arange(len(h)) + length <= np.repeat(stops, lens)[:len(h)]
    order = np.sort(h[inside])
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return [], np.empty(0, np.int64), np.empty(0, np.int64)
    at = np.minimum(np.searchsorted(twice, h), len(twice) - 1)
    kept = np.concatenate([[False], (twice[at] == h) & inside, [False]]).view(np.int8)
    edge = np.diff(kept)
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)  # no run crosses strings: the windows that would are not inside
    owner = np.searchsorted(stops, begin, "right")
    whole = raw.tobytes()
    return [whole[a:z + length - 1] for a, z in zip(begin, end)], owner, begin - (stops - lens)[owner]


def spans(doc: np.ndarray, start: np.ndarray, length: int) -> pd.DataFrame:
    """Starts of covered strings -> maximal (doc_id, start, stop)."""
    if not len(doc):
        return pd.DataFrame({"doc_id": doc, "start": start, "stop": start})
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order]
    first = np.ones(len(doc), bool)
    first[1:] = (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + length)
    heads = np.flatnonzero(first)
    tails = np.append(heads[1:], len(doc)) - 1
    return pd.DataFrame({"doc_id": doc[heads], "start": start[heads], "stop": start[tails] + length})


# -- jobs -----------------------------------------------------------------------------------------------------------------

_RUN = "anchor long, doc_id long, first long, windows long, twice boolean, s1 long, s2 long, string binary, size long"


def _anchors(docs: DataFrame, length: int, k: int) -> DataFrame:
    """(anchor, a, twice) for every document once; a text that a task meets again is left out."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        met = set()
        for pdf in frames:
            out = [[np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, bool)]]
            for a, t in zip(pdf["a"], pdf["text"]):
                if a in met:
                    continue
                met.add(a)
                anchor, _, _, twice = runs(np.frombuffer(t.encode(), np.uint8), length, k)
                order = np.argsort(anchor, kind="stable")
                anchor, twice = anchor[order], twice[order]
                head = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]])) if len(anchor) else np.empty(0, np.int64)
                many = np.diff(np.append(head, len(anchor))) > 1
                out[0].append(anchor[head].view(np.int64))
                out[1].append(np.full(len(head), a))
                out[2].append(many | np.logical_or.reduceat(twice, head) if len(head) else twice)
            yield pd.DataFrame(dict(zip(("anchor", "a", "twice"), map(np.concatenate, out))))

    return docs.select("a", "text").mapInPandas(run, "anchor long, a long, twice boolean")


def _runs(docs: DataFrame, length: int, k: int) -> DataFrame:
    """Rows of a run of a suspect anchor. Of equal strings a task sends the first;
    the others, later by order, come without a string and are covered."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        met = set()
        for pdf in frames:
            out = []
            for doc, t, suspects in zip(pdf["doc_id"], pdf["text"], pdf["anchors"]):
                b = t.encode()
                anchor, first, count, twice = runs(np.frombuffer(b, np.uint8), length, k)
                for i in np.flatnonzero(np.isin(anchor, np.asarray(suspects, np.int64).view(np.uint64))):
                    s = b[first[i]:first[i] + count[i] + length - 1]
                    s1, s2 = np.frombuffer(hashlib.blake2b(s, digest_size=16).digest(), np.int64)
                    known = (s1, s2) in met
                    met.add((s1, s2))
                    out.append((anchor[i].view(np.int64), doc, first[i], count[i], twice[i], s1, s2, None if known else s, len(s)))
            if out:
                yield pd.DataFrame(out, columns=["anchor", "doc_id", "first", "windows", "twice", "s1", "s2", "string", "size"])

    # in the order of doc_id, so that a task's first is its least
    return docs.sortWithinPartitions("doc_id").mapInPandas(run, _RUN)


def _merged(rows: DataFrame, length: int, shard_bytes: int, batch_bytes: int) -> DataFrame:
    """Runs with strings -> covered spans, for anchors that fit a task."""
    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["anchor", "s1", "s2", "doc_id", "first"], kind="stable")
        same = pdf.duplicated(["anchor", "s1", "s2"]).to_numpy()
        doc, first = pdf["doc_id"].to_numpy(), pdf["first"].to_numpy()
        later = pdf[same]
        out = [pd.DataFrame({"doc_id": later["doc_id"], "start": later["first"], "stop": later["first"] + later["size"]})]
        kept = pdf[~same]
        kept = kept[kept.duplicated("anchor", keep=False) | kept["twice"]]
        if len(kept):
            doc, first = kept["doc_id"].to_numpy(), kept["first"].to_numpy()
            parts, owner, begin = shared_windows(kept["string"].tolist(), length)
            block, which, offset = repeated(parts, length, shard_bytes) if parts else (np.empty(0, np.int64),) * 3
            d, s = doc[owner[which]], first[owner[which]] + begin[which] + offset
            order = np.lexsort((s, d, block))
            again = order[1:][block[order][1:] == block[order][:-1]]
            out.append(spans(d[again], s[again], length))
        return pd.concat(out)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = None, 0
        for pdf in frames:
            held = pdf if held is None else pd.concat([held, pdf])
            size += int(pdf["size"].sum())
            if size >= batch_bytes:
                open_ = (held["anchor"] == held["anchor"].iloc[-1]).to_numpy()
                if not open_.all():
                    yield solve(held[~open_])
                    held = held[open_]
                    size = int(held["size"].sum())
        if held is not None and len(held):
            yield solve(held)

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "anchor").sortWithinPartitions("anchor").mapInPandas(run, "doc_id long, start long, stop long")


def _one_by_one(rows: DataFrame, length: int) -> DataFrame:
    """Runs with strings -> covered spans, window by window, for the other anchors."""
    def cutup(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for r in pdf.itertuples():
                raw = np.frombuffer(r.string, np.uint8)
                keys = [np.frombuffer(hashlib.blake2b(raw[i:i + length].tobytes(), digest_size=16).digest(), np.int64) for i in range(len(raw) - length + 1)]
                yield pd.DataFrame({"w1": [k[0] for k in keys], "w2": [k[1] for k in keys], "doc_id": r.doc_id, "start": r.first + np.arange(len(keys))})

    windows = rows.mapInPandas(cutup, "w1 long, w2 long, doc_id long, start long")
    firsts = windows.groupBy("w1", "w2").agg(F.min(F.struct("doc_id", "start")).alias("least"))
    again = windows.join(firsts, ["w1", "w2"]).where(F.struct("doc_id", "start") > F.col("least"))
    return again.select("doc_id", "start", (F.col("start") + length).alias("stop"))


def covered(docs: DataFrame, length: int = LENGTH, k: int = GRAM, shard_bytes: int = SHARD_BYTES, batch_bytes: int = BATCH_BYTES, most_bytes: int = MOST_BYTES) -> tuple[DataFrame, DataFrame]:
    """(texts: doc_id and the doc_id of the first equal text), (doc_id, start, stop of covered bytes of first texts, spans may overlap)."""
    small_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text").where("doc_id IS NOT NULL AND octet_length(text) >= %d" % length)
    docs = docs.withColumn("a", F.xxhash64("text")).withColumn("m", F.md5("text"))
    texts = docs.groupBy("m", "a").agg(F.min("doc_id").alias("first_id"))
    by_anchor = Window.partitionBy("anchor")
    found = _anchors(docs, length, k).withColumn("lo", F.min("a").over(by_anchor)).withColumn("hi", F.max("a").over(by_anchor)).withColumn("t", F.max("twice").over(by_anchor))
    suspects = found.where("lo <> hi OR t").groupBy("a").agg(F.collect_list("anchor").alias("anchors"))
    wanted = texts.join(suspects, "a").select(F.col("first_id").alias("doc_id"), "anchors")
    rows = docs.select("doc_id", "text").join(wanted, "doc_id").dropDuplicates(["doc_id"])
    rows = stored(_runs(rows, length, k), "runs")
    sent = rows.where("string IS NOT NULL")
    size = sent.groupBy("anchor").agg(F.sum("size").alias("n")).where(F.col("n") > most_bytes).select("anchor")
    big = sent.join(size, "anchor", "left_semi")
    marks = _merged(sent.join(size, "anchor", "left_anti"), length, shard_bytes, batch_bytes)
    marks = marks.unionAll(_one_by_one(big, length)).unionAll(rows.where("string IS NULL").select("doc_id", F.col("first").alias("start"), (F.col("first") + F.col("size")).alias("stop")))
    copies = docs.select("doc_id", "m", "a").join(texts, ["m", "a"]).select("doc_id", "first_id").distinct()
    return copies, marks


def dedup(docs: DataFrame, length: int = LENGTH, k: int = GRAM, **sizes) -> DataFrame:
    """doc_id, text, n_bytes, removed (maximal spans of bytes), kept (what is left, as bytes)."""
    copies, marks = covered(docs, length, k, **sizes)
    by_doc = marks.groupBy("doc_id").agg(F.collect_list(F.struct("start", "stop")).alias("marks"))
    whole = copies.where("first_id <> doc_id").select("doc_id", F.lit(True).alias("whole"))
    info = by_doc.join(whole, "doc_id", "full_outer")

    @F.pandas_udf("n_bytes long, removed array<struct<start:long,stop:long>>, kept binary")
    def applied(texts: pd.Series, marks: pd.Series, whole: pd.Series) -> pd.DataFrame:
        out = []
        for t, m, w in zip(texts, marks, whole):
            b = (t or "").encode()
            found = [(0, len(b))] if w is True or w == True else sorted((int(x["start"]), int(x["stop"])) for x in m) if m is not None else []  # noqa: E712
            joined: list[list[int]] = []
            for a, z in found:
                if joined and a <= joined[-1][1]:
                    joined[-1][1] = max(joined[-1][1], z)
                else:
                    joined.append([a, z])
            kept, at = [], 0
            for a, z in joined:
                kept.append(b[at:a])
                at = z
            out.append((len(b), [{"start": a, "stop": z} for a, z in joined], b"".join([*kept, b[at:]])))
        return pd.DataFrame(out, columns=["n_bytes", "removed", "kept"])

    rows = docs.select("doc_id", "text").join(info, "doc_id", "left")
    return rows.withColumn("x", applied("text", "marks", "whole")).select("doc_id", "text", "x.*")
