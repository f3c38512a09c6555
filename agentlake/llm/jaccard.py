"""n-gram Jaccard join with token-combination prefixes.

A document is the set of its distinct shingles (k consecutive words). Shingles
have one order for all documents: rare before frequent, then by hash. Two sets
of similarity t share at least ceil(t n) shingles, so the heads of both sets
in that order share some; a head extended by g shingles shares at least g + 1.
Rare shingles are indexed one by one. Frequent ones (in about one document of
``FREQUENT`` or more) fall into g classes and are indexed by pairs of one class:
if no rare shingle is shared, g + 1 shared ones in g classes hold such a pair.
g grows with the size of the set, so pairs stay in proportion to it, and is set
by the *size band* under which both documents meet; sizes too far apart for a
link share no band.

Equal sets are one node (grouped by fingerprint with map-side combine). A list
of the index with few sets gives its pairs; a longer one stays together in a task
and gives a spanning forest of the pairs that size and a 128-byte sketch do not
rule out; one too long for that gives a star. So what is emitted is linear in the
index. The components of all this are groups. A group's documents are sent once to
a block (large groups: to the meetings of two blocks), where all that are not
linked yet are compared exactly; what leaves a block is a spanning forest. So a
group of thousands of near copies never becomes pairs, and no link is lost: each
linked pair shares a list, so it is in one group, so it meets in a block.

Which shingles are frequent is decided once by a mergeable summary over all
documents: chunks drop shingles below 1 / (2 FREQUENT) of their documents, so a
sum falls short by at most that share of all documents. At most 2 FREQUENT times
the mean set size of them exist, however large the corpus: that bounds the
broadcast. Their number is no cap: any split into two classes gives all links.

Defined results: null, empty and blank texts have the empty set, no links and
themselves as component; fewer than k words: the whole sequence as one shingle;
rows without a doc_id are left out; repeated rows of a doc_id are one document (of its texts, the one whose set
has the least fingerprint); an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from agentlake.llm.common import groups_of_bytes, small_batches, stored
from agentlake.llm.components import components

FREQUENT = 1000
EXTRA = 0.03  # classes for each shingle of a band's least size
GROUP_BYTES, CHUNK_SHINGLES = 1 << 18, 1 << 20

_BASE = 0x5851F42D4C957F2D
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class Shingler:
    """Sets of shingle hashes (sorted uint64) of texts."""

    def __init__(self, k: int):
        self.k, self.size = k, 0

    def _powers(self, n: int) -> None:
        if n <= self.size:
            return
        self.size = max(n, 1 << 16)
        both = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            out, m = np.ones(self.size, np.uint64), 1
            while m < self.size:
                w = min(m, self.size - m)
                out[m:m + w] = out[:w] * np.uint64(pow(base, m, 1 << 64))
                m += w
            both.append(out)
        self.up, self.down = both

    def words(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, hash) of every word."""
        inside = ~_SPACE[raw]
        padded = np.zeros(len(raw) + 2, bool)
        padded[1:-1] = inside
        s, e = np.flatnonzero(padded[1:] & ~padded[:-1]), np.flatnonzero(padded[:-1] & ~padded[1:])
        self._powers(len(raw) + 1)
        c = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((_FOLD[raw].astype(np.uint64) + np.uint64(1)) * self.down[:len(raw)], out=c[1:])
        return s, _mix((c[e] - c[s]) * self.up[s])

    def sets(self, texts: list[bytes]) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for _, group in groups_of_bytes(texts, GROUP_BYTES):
            raw = np.frombuffer(b"\n".join(group) + b"\n", np.uint8)
            s, w = self.words(raw)
            at = np.searchsorted(s, np.cumsum([0, *(len(t) + 1 for t in group)]))
            grams = np.zeros(max(len(w) - self.k + 1, 0), np.uint64)
            for i in range(self.k):
                grams = grams * np.uint64(_BASE) + w[i:len(w) - self.k + 1 + i]
            grams = _mix(grams)
            for a, b in zip(at[:-1], at[1:]):
                if b - a >= self.k:
                    out.append(np.unique(grams[a:b - self.k + 1]))
                elif b > a:
                    h = np.uint64(b - a)
                    for x in w[a:b]:
                        h = np.uint64((int(h) * _BASE + int(x)) & ((1 << 64) - 1))
                    out.append(_mix(np.array([h], np.uint64) ^ np.uint64(0xA5A5A5A5A5A5A5A5)))
                else:
                    out.append(np.empty(0, np.uint64))
        return out


def bands(num: int, den: int, upto: int) -> np.ndarray:
    """Least sizes of the bands: linked sets are in one band or in neighbours."""
    low = [1]
    while low[-1] <= upto:
        low.append(low[-1] * den // num + 1)
    return np.array(low)


class Signer:
    """The index entries of a set for links of at least num / den."""

    def __init__(self, num: int, den: int, frequent: np.ndarray):
        self.num, self.den, self.frequent, self.low = num, den, frequent, bands(num, den, 1 << 40)

    def signatures(self, s: np.ndarray) -> np.ndarray:
        n = len(s)
        if not n:
            return np.empty(0, np.uint64)
        at = np.minimum(np.searchsorted(self.frequent, s), max(len(self.frequent) - 1, 0))
        often = self.frequent[at] == s if len(self.frequent) else np.zeros(n, bool)
        rare, freq = s[~often], s[often]
        band = int(np.searchsorted(self.low, n, "right")) - 1
        least = n - (self.num * n + self.den - 1) // self.den + 1
        out = [rare[:least + int(EXTRA * self.low[band + 1])]]
        for b in (band, band + 1):
            classes = int(EXTRA * self.low[b])
            mark = np.uint64((b + 1) * 0xC2B2AE3D27D4EB4F & ((1 << 64) - 1))
            tail = freq[:max(min(n, least + classes) - len(rare), 0)]
            if not classes:
                out.append(_mix(tail ^ mark))
            elif len(tail) > 1:
                c = (tail % np.uint64(classes)).astype(np.int64)
                order = np.argsort(c, kind="stable")
                tail, c = tail[order], c[order]
                for gap in range(1, int(np.bincount(c).max())):
                    same = c[gap:] == c[:-gap]
                    out.append(_mix(_mix(tail[:-gap][same] ^ mark) + tail[gap:][same] * np.uint64(3)))
        return np.concatenate(out)


def similar(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    if not len(a) or not len(b) or den * min(len(a), len(b)) < num * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return den * shared >= num * (len(a) + len(b) - shared)


def sketch(s: np.ndarray) -> bytes:
    """Counts of the set's hashes in 128 buckets, at most 255. Their sum of
    differences is a lower bound of the number of shingles that two sets do not share."""
    return np.minimum(np.bincount((s >> np.uint64(57)).astype(np.int64), minlength=128), 255).astype(np.uint8).tobytes()


def may_link(n1, k1, n2, k2, num: int, den: int) -> np.ndarray:
    """For arrays of sizes and sketches: pairs that size and sketch do not rule out (no linked pair is)."""
    n1, n2 = np.asarray(n1, np.int64), np.asarray(n2, np.int64)
    x, y = (np.frombuffer(b"".join(map(bytes, k)), np.uint8).reshape(-1, 128).astype(np.int16) for k in (k1, k2))
    apart = np.abs(x - y).sum(axis=1, dtype=np.int64)
    # |x ^ y| <= (den - num) / (den + num) * (n1 + n2) holds for every linked pair
    return (den * np.minimum(n1, n2) >= num * np.maximum(n1, n2)) & (apart * (den + num) <= (den - num) * (n1 + n2))


def _by_key(frames: Iterator[pd.DataFrame], key: str) -> Iterator[tuple]:
    """(key, rows) of runs of equal keys in a sorted partition."""
    held, parts = None, []
    for pdf in frames:
        if not len(pdf):
            continue
        keys = pdf[key].to_numpy()
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1), len(keys)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if parts and keys[a] != held:
                yield held, pd.concat(parts)
                parts = []
            held = keys[a]
            parts.append(pdf.iloc[a:b])
    if parts:
        yield held, pd.concat(parts)


def _codes(s: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Places in ``common`` of a set's shingles that stand there."""
    if not len(common):
        return np.empty(0, np.int32)
    at = np.minimum(np.searchsorted(common, s), len(common) - 1)
    return at[common[at] == s].astype(np.int32)


def _apart(sketches: np.ndarray, near: np.ndarray, i: int) -> np.ndarray:
    """Differences of the sketches of ``near`` from that of ``i``."""
    out = np.empty(len(near), np.int64)
    for at in range(0, len(near), 4096):
        part = sketches[near[at:at + 4096]].astype(np.int16)
        out[at:at + 4096] = np.abs(part - sketches[i].astype(np.int16)).sum(axis=1, dtype=np.int64)
    return out


def block_links(ids: list[int], sets: list[np.ndarray], left: list[bool], right: list[bool], num: int, den: int) -> list[tuple[int, int]]:
    """Links between the left and the right documents of a block, as a spanning
    forest: a document is not compared with what it is linked to already, nor
    with what size or sketch rules out."""
    if len(ids) < 2:
        return []
    order = np.argsort([len(s) for s in sets], kind="stable")
    sets = [sets[i] for i in order]
    ids, left, right = np.array(ids)[order], np.array(left)[order], np.array(right)[order]
    sizes = np.array([len(s) for s in sets])
    # only shingles that stand in two sets of the block can be shared: the others keep no place
    common = np.concatenate(sets)
    common.sort()
    common = common[1:][common[1:] == common[:-1]]
    common = common[np.concatenate([[True], common[1:] != common[:-1]])] if len(common) else common
    parts = [_codes(s, common) for s in sets]
    ends = np.cumsum([0, *(len(c) for c in parts)])
    codes = np.concatenate(parts)
    del parts
    sketches = np.frombuffer(b"".join(sketch(s) for s in sets), np.uint8).reshape(-1, 128)
    root, seen = np.arange(len(ids)), np.zeros(len(common), bool)
    floor, ceil = np.searchsorted(den * sizes, num * sizes, "left"), np.searchsorted(num * sizes, den * sizes, "right")
    out = []
    for i in range(len(ids)):
        # a pair is met from the left document, or from the first if both are on both sides
        lo = i + 1 if right[i] and left.all() and right.all() else int(floor[i])
        if not left[i] or lo >= ceil[i]:
            continue
        near = np.arange(lo, ceil[i])
        near = near[right[near] & (root[near] != root[i])]
        if not len(near):
            continue
        near = near[_apart(sketches, near, i) * (den + num) <= (den - num) * (sizes[near] + sizes[i])]
        if not len(near):
            continue
        own = codes[ends[i]:ends[i + 1]]
        seen[own] = True
        a, z = ends[near[0]], ends[near[-1] + 1]
        if 2 * (ends[near + 1] - ends[near]).sum() > z - a and len(near) > 8:
            upto = np.concatenate([[0], np.cumsum(seen[codes[a:z]], dtype=np.int32)])
            shared = upto[ends[near + 1] - a] - upto[ends[near] - a]
        else:
            shared = np.array([np.count_nonzero(seen[codes[ends[j]:ends[j + 1]]]) for j in near])
        seen[own] = False
        for j in near[den * shared >= num * (sizes[near] + sizes[i] - shared)]:
            if root[i] != root[j]:
                out.append((int(ids[i]), int(ids[j])))
                root[root == root[j]] = root[i]
    return out


def _print(s: np.ndarray) -> tuple[int, int]:
    """128-bit fingerprint of a set."""
    return tuple(np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64).tolist())


def sets_of(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n (size of the set), a, b (fingerprint of the set), sketch."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sh = Shingler(k)
        for pdf in frames:
            sets = sh.sets([(t or "").encode() for t in pdf["text"]])
            prints = [_print(s) for s in sets]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n": [len(s) for s in sets], "a": [p[0] for p in prints], "b": [p[1] for p in prints], "sketch": [sketch(s) for s in sets]})
    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, n long, a long, b long, sketch binary")


def frequent_shingles(docs: DataFrame, k: int) -> np.ndarray:
    """Sorted hashes of the shingles in about 1 / FREQUENT of the documents or more."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sh, held, size, n = Shingler(k), [], 0, 0

        def flush():
            u, c = np.unique(np.concatenate(held), return_counts=True)
            kept = c * 2 * FREQUENT >= n
            kept &= c > 1
            return pd.DataFrame({"shingle": np.concatenate([u[kept].view(np.int64), [0]]), "c": np.concatenate([c[kept], [n]]), "total": np.concatenate([np.zeros(kept.sum(), bool), [True]])})

        for pdf in frames:
            for s in sh.sets([(t or "").encode() for t in pdf["text"]]):
                held.append(s)
                size, n = size + len(s), n + 1
                if size >= CHUNK_SHINGLES:
                    yield flush()
                    held, size, n = [], 0, 0
        if n:
            yield flush()

    counts = docs.select("text").mapInPandas(run, "shingle long, c long, total boolean").groupBy("shingle", "total").agg(F.sum("c").alias("c"))
    counts = stored(counts, "shingle-counts")
    total = counts.where("total").agg(F.sum("c")).collect()[0][0] or 0
    rows = counts.where((~F.col("total")) & (F.col("c") * 2 * FREQUENT >= total)).select("shingle").toPandas()
    return np.sort(rows["shingle"].to_numpy(np.int64).view(np.uint64))


def postings(docs: DataFrame, k: int, num: int, den: int, frequent: np.ndarray) -> DataFrame:
    """(sig, a) of every document; a set that a task meets again is not indexed again."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent.tobytes())

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sh, signer, met = Shingler(k), Signer(num, den, np.frombuffer(shared.value, np.uint64)), set()
        for pdf in frames:
            sigs, owners = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
            for s in sh.sets([(t or "").encode() for t in pdf["text"]]):
                a = _print(s)[0]
                if a not in met:
                    met.add(a)
                    sigs.append(signer.signatures(s))
                    owners.append(np.full(len(sigs[-1]), a))
            yield pd.DataFrame({"sig": np.concatenate(sigs).view(np.int64), "a": np.concatenate(owners)})

    return docs.select("text").mapInPandas(run, "sig long, a long")


def join(docs: DataFrame, k: int = 4, num: int = 85, den: int = 100, small: int = 8, together: int = 20000, block_shingles: int = 1 << 22) -> DataFrame:
    """doc_id, n_shingles, component_id for links of Jaccard similarity >= num / den.

    Index lists of up to ``small`` sets give their pairs, of up to ``together`` a
    forest of pairs that pass size and sketch, longer ones a star; the components
    are groups, whose documents meet in blocks of about ``block_shingles`` and are
    compared exactly. These sizes say how, not what: all links are found."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select("doc_id", "text").where("doc_id IS NOT NULL")
    every = stored(sets_of(docs, k), "sets")
    rows, ids = every.agg(F.count("*"), F.count_distinct("doc_id")).collect()[0]
    one = every
    if rows > ids:
        one = stored(every.groupBy("doc_id").agg(F.min(F.struct("a", "b", "n", "sketch")).alias("x")).select("doc_id", "x.*"), "first-sets")
        docs = docs.distinct()
    nodes = one.where("n > 0").groupBy("a", "b").agg(F.min("doc_id").alias("node"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    nodes = stored(nodes, "nodes")

    lists = postings(docs, k, num, den, frequent_shingles(docs, k)).repartition("sig").dropDuplicates(["sig", "a"])
    if rows > ids:
        lists = lists.join(nodes.select("a").distinct(), "a", "left_semi").select("sig", "a")
    by_sig = Window.partitionBy("sig")
    lists = stored(lists.withColumn("c", F.count("*").over(by_sig)).withColumn("least", F.min("a").over(by_sig)).where("c > 1"), "lists")
    few = lists.where(F.col("c") <= small)
    pairs = few.alias("x").join(few.alias("y"), "sig").where("x.a < y.a").select(F.col("x.a").alias("a1"), F.col("y.a").alias("a2")).distinct()
    some = lists.where((F.col("c") > small) & (F.col("c") <= together)).select("sig", "a").join(nodes.select("a", "node", "n", "sketch"), "a")
    hot = lists.where((F.col("c") > together) & (F.col("a") != F.col("least"))).select(F.col("least").alias("a1"), F.col("a").alias("a2")).distinct()

    def side(i: int) -> DataFrame:
        return nodes.select(F.col("a").alias(f"a{i}"), F.col("node").alias(f"node{i}"), F.col("n").alias(f"n{i}"), F.col("sketch").alias(f"sketch{i}"))

    @F.pandas_udf("boolean")
    def passes(n1: pd.Series, k1: pd.Series, n2: pd.Series, k2: pd.Series) -> pd.Series:
        return pd.Series(may_link(n1, k1, n2, k2, num, den))

    near = pairs.join(side(1), "a1").join(side(2), "a2").where(passes("n1", "sketch1", "n2", "sketch2"))
    star = hot.join(side(1).drop("sketch1", "n1"), "a1").join(side(2).drop("sketch2", "n2"), "a2")
    ends = [F.col("node1").alias("u"), F.col("node2").alias("v")]
    groups = components(near.select(*ends).unionAll(star.select(*ends)).unionAll(_forests(some, num, den)))
    groups = _placed(groups.join(nodes.select("node", "n"), "node"), bands(num, den, 1 << 40), block_shingles)
    if rows > ids:  # a doc_id has several texts: the node's is known by its fingerprint
        groups = groups.join(nodes.select("node", "a", "b"), "node")
    groups = stored(groups, "groups")

    links = components(_verified(docs, groups, k, num, den))
    final = nodes.select("a", "b", "node").join(links, "node", "left").select("a", "b", F.coalesce("component", "node").alias("component"))
    return one.join(final, ["a", "b"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def _forests(rows: DataFrame, num: int, den: int) -> DataFrame:
    """(sig, node, n, sketch) -> edges (u, v): for each list a spanning forest of
    the pairs that size and sketch leave open. A task sends no edge between nodes
    that its edges connect already, so lists with the same members cost one forest."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        up: dict[int, int] = {}

        def top(x: int) -> int:
            while (y := up.get(x, x)) != x:
                up[x] = x = up.get(y, y)
            return x

        for _, pdf in _by_key(frames, "sig"):
            pdf = pdf.sort_values(["n", "node"], kind="stable")
            ids, sizes = pdf["node"].tolist(), pdf["n"].to_numpy()
            sketches = np.frombuffer(b"".join(map(bytes, pdf["sketch"])), np.uint8).reshape(-1, 128)
            # what the task's earlier lists connect is not compared again
            root, upto = np.unique([top(x) for x in ids], return_inverse=True)[1], np.searchsorted(num * sizes, den * sizes, "right")
            if (root == root[0]).all():
                continue
            out = []
            for i in range(len(ids) - 1):
                near = np.arange(i + 1, upto[i])
                near = near[root[near] != root[i]]
                if not len(near):
                    continue
                for j in near[_apart(sketches, near, i) * (den + num) <= (den - num) * (sizes[near] + sizes[i])]:
                    if root[j] != root[i]:
                        root[root == root[j]] = root[i]
                        a, b = top(ids[i]), top(ids[j])
                        if a != b:
                            up[max(a, b)] = min(a, b)
                            out.append((ids[i], ids[j]))
            if out:
                yield pd.DataFrame(out, columns=["u", "v"])

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "sig").sortWithinPartitions("sig").select("sig", "node", "n", "sketch").mapInPandas(run, "u long, v long")


def _placed(groups: DataFrame, low: np.ndarray, block_shingles: int) -> DataFrame:
    """(node, component, n) -> node, and meetings: array of (key of the meeting,
    is left, is right). A group of up to ``block_shingles`` meets as a whole. A
    larger one is cut by size band and, by hash, into parts of that size; a part
    meets the parts of its own band and those of the next: links reach no further."""
    band = F.lit(0)
    for k in range(1, len(low)):
        band = band + (F.col("n") >= F.lit(int(low[k]))).cast("int")
    rows = groups.withColumn("band", band)
    by_band = rows.groupBy("component", "band").agg(F.sum("n").alias("n_band"))
    order = Window.partitionBy("component").orderBy("band")
    parts = by_band.withColumn("parts", F.ceil(F.col("n_band") / block_shingles).cast("int"))

    def beside(side, step: int):
        return F.when(side("band").over(order) == F.col("band") + step, side("parts").over(order)).otherwise(0)

    parts = parts.withColumn("up", beside(F.lead, 1)).withColumn("down", beside(F.lag, -1)).withColumn("total", F.sum("n_band").over(Window.partitionBy("component")))
    rows = rows.join(parts.select("component", "band", "parts", "up", "down", "total"), ["component", "band"])
    me = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")

    def meeting(b1, p1, b2, p2, left, right):
        return F.struct(F.concat_ws("/", F.col("component").cast("string"), *[x.cast("string") for x in (b1, p1, b2, p2)]).alias("key"), F.lit(left).alias("left"), F.lit(right).alias("right"))

    def each(count, make):
        return F.when(F.col(count) > 0, F.transform(F.sequence(F.lit(0), F.col(count) - 1), make)).otherwise(F.array().cast("array<struct<key:string,left:boolean,right:boolean>>"))

    b = F.col("band")
    same = each("parts", lambda j: F.struct(F.concat_ws("/", F.col("component").cast("string"), b.cast("string"), F.least(me, j).cast("string"), b.cast("string"), F.greatest(me, j).cast("string")).alias("key"),
                                            (me <= j).alias("left"), (me >= j).alias("right")))
    up = each("up", lambda j: meeting(b, me, b + 1, j, True, False))
    down = each("down", lambda j: meeting(b - 1, j, b, me, False, True))
    whole = F.array(F.struct(F.col("component").cast("string").alias("key"), F.lit(True).alias("left"), F.lit(True).alias("right")))
    return rows.select("node", F.when(F.col("total") <= block_shingles, whole).otherwise(F.concat(same, up, down)).alias("meetings"))


def _verified(docs: DataFrame, groups: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """The links found in all meetings, as edges (u, v). If groups have fingerprints (a, b),
    of the texts of a doc_id the one whose set has it takes part."""
    prints = [c for c in ("a", "b") if c in groups.columns]
    rows = docs.join(groups, F.col("doc_id") == F.col("node")).select("doc_id", *prints, "text", F.explode("meetings").alias("m"))
    rows = rows.select("doc_id", *prints, "text", "m.*")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sh = Shingler(k)

        def as_sets() -> Iterator[pd.DataFrame]:
            # texts leave as they come in: a meeting holds sets of hashes only
            for pdf in frames:
                sets = sh.sets([(t or "").encode() for t in pdf["text"]])
                held = pdf.drop(columns=["text", *prints]).assign(set=sets)
                yield held[[_print(s) == (a, b) for s, a, b in zip(sets, pdf["a"], pdf["b"])]] if prints else held

        for _, pdf in _by_key(as_sets(), "key"):
            pdf = pdf.drop_duplicates("doc_id")
            found = block_links(pdf["doc_id"].tolist(), pdf["set"].tolist(), pdf["left"].tolist(), pdf["right"].tolist(), num, den)
            if found:
                yield pd.DataFrame(found, columns=["u", "v"])

    # work goes with the square of a group, not with bytes: as many tasks as the session has partitions
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "key").sortWithinPartitions("key", "doc_id").mapInPandas(run, "u long, v long")
