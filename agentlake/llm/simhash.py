"""SimHash near duplicates by deletion-variant signatures.

A document's fingerprint sums up the XXH64 values of its word shingles, repeats
included: a bit is 1 if it is set in more than half of them. Two fingerprints
link when at most ``most`` of their 64 bits differ.

The fingerprint is cut into most // 2 + 1 segments, two for three bits: were there
two differing bits in each, there would be more than ``most``, so one segment
differs by one bit at most. Each segment is indexed once for each of its bits with
that bit taken out (a wildcard): segments that differ by at most one bit agree in
the variant without it. The equality join on (variant, value) brings candidates
together, whose whole fingerprints are compared.

How it spreads: equal fingerprints are one node (combined map-side), so copies
never meet. A list of the index is never turned into pairs: the task that holds it
sends a spanning forest of its verified links. A list longer than ``together`` is
not held: its members leave the task as they pass and are indexed a second time by
the same variants of the bits that the first did not fix. With two segments of 32
bits such a second list has 46 fixed bits, so 2 ** 18 members at most; its links
come from looking up each member's neighbours of up to ``most`` flipped bits.
Components of the forests give the classes.

Defined results: texts that are null, empty or blank have fingerprint zero and
link like any other; fewer words than a shingle give one shingle of them all; each
row is a document of its own, repeated rows too; a row without a doc_id has a
fingerprint and links, but gives no component its name (a component of such rows
alone has a null name); an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agentlake.llm.common import arrow_batches, stored
from agentlake.llm.components import components

BITS, SEED = 64, 42
#: Bytes of a text whose words are held at once, shingles whose bits are summed at once.
SLICE, ROWS = 1 << 20, 1 << 14
#: Rows of an Arrow batch: whole texts, and single numbers.
TEXTS, NUMBERS = 256, 1 << 16
#: Lists up to this length are compared by shifts, all lists of a batch at once.
SHORT = 32
#: Nodes that a task remembers as connected before it starts anew (it then sends some edges twice).
REMEMBERED = 1 << 18

_BLANK = re.compile(rb"[\x20\x09-\x0D]")


# -- fingerprints ---------------------------------------------------------------------------------------------------------

def _word_lists(raw: bytes) -> Iterator[list[bytes]]:
    """The words of a text, slice by slice; no word is cut."""
    at = 0
    while at < len(raw):
        blank = _BLANK.search(raw, at + SLICE)
        stop = blank.start() if blank else len(raw)
        yield raw[at:stop].split()  # bytes split at exactly these six characters
        at = stop


def shingle_hashes(text: str | None, k: int) -> Iterator[np.ndarray]:
    """XXH64 values of all shingles, in order, in parts."""
    digest, tail, met = xxhash.xxh64_intdigest, [], False
    for words in _word_lists((text or "").encode().lower()):  # bytes: A-Z only
        words = tail + words
        tail = words[max(len(words) - k + 1, 0):]
        if len(words) < k:
            continue
        met = True
        line = b" ".join(words)
        ends = list(accumulate(map(len, words), lambda a, b: a + b + 1))
        starts = [0, *(e + 1 for e in ends)]
        hashes = [digest(line[a:b], SEED) for a, b in zip(starts, ends[k - 1:])]
        yield np.array(hashes, np.uint64)
    if tail and not met:
        yield np.array([digest(b" ".join(tail), SEED)], np.uint64)


def fingerprint(text: str | None, k: int = 3) -> int:
    ones, n = np.zeros(BITS, np.int64), 0
    for hashes in shingle_hashes(text, k):
        n += len(hashes)
        for at in range(0, len(hashes), ROWS):
            part = hashes[at:at + ROWS].astype("<u8").view(np.uint8)
            ones += np.unpackbits(part, bitorder="little").reshape(-1, BITS).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprint_of(text: Column, k: int = 3) -> Column:
    """The fingerprint as a (signed) long."""
    @F.pandas_udf("long")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series(np.array([fingerprint(t, k) for t in texts], np.uint64).view(np.int64))
    return run(text)


# -- the index --------------------------------------------------------------------------------------------------------------

def segments(bits: int, most: int) -> list[tuple[int, int]]:
    """(first bit, bit behind the last) of most // 2 + 1 segments."""
    n = most // 2 + 1
    cuts = [bits * i // n for i in range(n + 1)]
    return list(zip(cuts[:-1], cuts[1:]))


def variant_masks(free: int, most: int) -> list[int]:
    """The bits that each variant fixes: a segment of the free bits but one."""
    places = [i for i in range(BITS) if free >> i & 1]
    out = []
    for lo, hi in segments(len(places), most):
        whole = sum(1 << p for p in places[lo:hi])
        out += [whole ^ (1 << p) for p in places[lo:hi]]
    return out


ALL = (1 << BITS) - 1


def _distance(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count(a ^ b)


class _Forest:
    """The edges of a task without those that its earlier edges connect."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def top(self, x: int) -> int:
        up = self.up
        while (y := up.get(x, x)) != x:
            up[x] = x = up.get(y, y)
        return x

    def add(self, u: np.ndarray, v: np.ndarray) -> list[tuple[int, int]]:
        if len(self.up) > REMEMBERED:
            self.up = {}
        out = []
        for x, y in zip(u.tolist(), v.tolist()):
            a, b = self.top(x), self.top(y)
            if a != b:
                self.up[max(a, b)] = min(a, b)
                out.append((x, y))
        return out


def list_links(prints: np.ndarray, most: int, together: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links of a list of distinct fingerprints, enough of them to span its components."""
    if len(prints) <= together:
        root = np.arange(len(prints))
        for i in range(len(prints) - 1):
            near = i + 1 + np.flatnonzero(root[i + 1:] != root[i])
            near = near[_distance(prints[near], prints[i]) <= most]
            if len(near):
                root[np.isin(root, root[near])] = root[i]
                yield np.full(len(near), prints[i]), prints[near]
        return
    # too long for pairs: flip up to ``most`` of the bits in which members differ, and look the result up
    prints = np.sort(prints)
    varied = int(np.bitwise_or.reduce(prints ^ prints[0]))
    places = [1 << i for i in range(BITS) if varied >> i & 1]
    for count in range(1, most + 1):
        for flipped in combinations(places, count):
            other = prints ^ np.uint64(sum(flipped))
            at = np.minimum(np.searchsorted(prints, other), len(prints) - 1)
            hit = (prints[at] == other) & (prints < other)
            if hit.any():
                yield prints[hit], other[hit]


def _lists(frames: Iterator[pd.DataFrame], keys: list[str], together: int | None) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(list number of each row, fingerprints, too long) of a partition sorted by
    ``keys``: whole lists together, and rows of lists longer than ``together`` as they pass."""
    def same(a: pd.DataFrame, b) -> np.ndarray:
        return np.logical_and.reduce([a[c].to_numpy() == np.asarray(b[c]) for c in keys])

    held, passing = None, None  # the list not ended yet; a row of the list that passes
    for pdf in frames:
        if passing is not None and len(pdf):
            like = same(pdf, passing)
            n = len(pdf) if like.all() else int(np.argmin(like))
            if n:
                yield np.zeros(n, np.int64), pdf.iloc[:n], True
                pdf = pdf.iloc[n:]
            if len(pdf):
                passing = None
        if not len(pdf):
            continue
        held = pdf if held is None else pd.concat([held, pdf])
        number = np.concatenate([[0], np.cumsum(~same(held.iloc[1:], held.iloc[:-1]))])
        ended = int(np.searchsorted(number, number[-1]))
        if ended:
            yield number[:ended], held.iloc[:ended], False
        held = held.iloc[ended:]
        if together is not None and len(held) > together:
            yield np.zeros(len(held), np.int64), held, True
            passing, held = held.iloc[0], None
    if held is not None and len(held):
        yield np.zeros(len(held), np.int64), held, False


def _search(rows: DataFrame, keys: list[str], most: int, together: int, last: bool) -> DataFrame:
    """Index rows (keys, fingerprint) -> edges (u, v) and, unless this is the last
    index, the rows of too long lists (keys, fingerprint as u, v null)."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forest = _Forest()

        def edges(pairs: list[tuple[int, int]]) -> pd.DataFrame:
            out = pd.DataFrame(pairs, columns=["u", "v"]).astype("Int64")
            return out.assign(**{k: pd.array([0] * len(out), "Int64") for k in keys})[[*keys, "u", "v"]]

        for number, pdf, long in _lists(frames, keys, None if last else together):
            if long:
                yield pdf.rename(columns={"fingerprint": "u"}).assign(v=pd.array([pd.NA] * len(pdf), "Int64"))[[*keys, "u", "v"]]
                continue
            prints = pdf["fingerprint"].to_numpy(np.int64).view(np.uint64)
            size = np.bincount(number)[number]
            out = []
            few = (size > 1) & (size <= SHORT)
            x, at = prints[few], number[few]
            for gap in range(1, min(SHORT, len(x))):
                pair = at[gap:] == at[:-gap]
                if not pair.any():
                    break
                pair &= _distance(x[gap:], x[:-gap]) <= most
                out += forest.add(x[:-gap][pair].view(np.int64), x[gap:][pair].view(np.int64))
            many = size > SHORT
            cuts = np.flatnonzero(np.diff(number[many], prepend=-1))
            for part in np.split(prints[many], cuts[1:]) if many.any() else []:
                for u, v in list_links(part, most, together):
                    out += forest.add(u.view(np.int64), v.view(np.int64))
            if out:
                yield edges(out)

    kinds = ", ".join(f"{k} long" for k in keys)
    dealt = rows.repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInPandas(run, f"{kinds}, u long, v long")


def _index(rows: DataFrame, level: int, most: int) -> DataFrame:
    """Rows (keys of the lists so far, fingerprint) with the variants of the bits
    that these leave free: variant<level>, value<level>."""
    keys = [f"{c}{i}" for i in range(1, level) for c in ("variant", "value")]
    name, value = f"variant{level}", f"value{level}"
    first = variant_masks(ALL, most)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            if level == 1:
                parts = [(pdf, first)]
            else:  # what the first variant fixed is equal in the whole list
                parts = [(part, variant_masks(ALL ^ first[int(v)], most)) for v, part in pdf.groupby("variant1")]
            for part, masks in parts:
                prints = part["fingerprint"].to_numpy(np.int64)
                for at in range(0, len(prints), 1 << 12):
                    x = prints[at:at + (1 << 12)]
                    masked = x[:, None] & np.array(masks, np.uint64).view(np.int64)[None, :]
                    out = {k: np.repeat(part[k].to_numpy()[at:at + (1 << 12)], len(masks)) for k in keys}
                    yield pd.DataFrame(out | {name: np.tile(np.arange(len(masks)), len(x)), value: masked.ravel(), "fingerprint": np.repeat(x, len(masks))})

    schema = ", ".join(f"{c} long" for c in [*keys, name, value, "fingerprint"])
    return rows.select(*keys, "fingerprint").mapInPandas(run, schema)


def links(prints: DataFrame, most: int = 3, together: int = 4096) -> DataFrame:
    """Distinct fingerprints (one long column ``fingerprint``) -> edges (u, v)
    that connect what links of at most ``most`` differing bits connect."""
    keys = ["variant1", "value1"]
    with arrow_batches(prints.sparkSession, NUMBERS):
        found = stored(_search(_index(prints, 1, most), keys, most, together, last=False), "simhash-lists")
        long = found.where("v IS NULL").select(*keys, F.col("u").alias("fingerprint"))
        again = stored(_search(_index(long, 2, most), [*keys, "variant2", "value2"], most, together, last=True), "simhash-long")
    return found.where("v IS NOT NULL").select("u", "v").unionAll(again.select("u", "v"))


def near_duplicates(docs: DataFrame, k: int = 3, most: int = 3, together: int = 4096) -> DataFrame:
    """doc_id, fingerprint (long), component_id (least doc_id that links reach) of every row."""
    spark = docs.sparkSession
    with arrow_batches(spark, TEXTS):
        every = stored(docs.select("doc_id", fingerprint_of(F.col("text"), k).alias("fingerprint")), "simhash")
    nodes = stored(every.groupBy("fingerprint").agg(F.min("doc_id").alias("least")), "simhash-nodes")
    reached = components(links(nodes.select("fingerprint"), most, together)).withColumnRenamed("node", "fingerprint")
    joined = nodes.join(reached, "fingerprint", "left")
    names = joined.where("component IS NOT NULL").groupBy("component").agg(F.min("least").alias("name"))
    named = joined.join(names, "component", "left").select("fingerprint", F.when(F.col("component").isNull(), F.col("least")).otherwise(F.col("name")).alias("component_id"))
    return every.join(named, "fingerprint").select("doc_id", "fingerprint", "component_id")


def as_hex(fingerprint: Column) -> Column:
    """16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))
