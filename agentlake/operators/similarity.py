"""Semantic (nearest-neighbour) cache matching.

Exact, distributed and pruned. A probe at sequence s can match the entries of its
group (tenant, and model where that is part of the key) up to s; with ``ring`` only
the newest that many of all groups. On unit vectors the cosine distance is half the
squared distance, so the triangle inequality bounds it:

* entries stand in *balls*: each goes to the nearest of a bounded set of pivots
  (one for ``block`` entries of the largest group, ``PIVOTS`` at most, chosen by hash), and the entries of a group and pivot are cut, in order
  of sequence, into balls of ``block`` entries with a radius around the pivot;
* a probe at distance d from a pivot is at least d - radius from all in a ball, so balls
  beyond the threshold, or younger than the probe, are never met;
* the ball of least bound is met first, and its best distance rules out most of the
  others. What is left is met in a second round.

A meeting is one cogroup task of a ball and the probes that come to it (dealt in
parts of ``block``), with a NumPy distance matrix, ``CELLS`` at a time, that emits the best admissible entry
per probe: pairs are never rows, no candidate list is capped, and the result equals a
brute-force scan. A minimum per probe picks the winner of its meetings.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agentlake.operators.ordered import running_sums
from agentlake.session import checkpoint_dir

# Interrogatives (strong may appear anywhere, weak only first).
STRONG_INTERROGATIVES = ["what", "who", "where", "when", "why", "how"]
WEAK_INTERROGATIVES = ["can", "is", "do", "does"]
# Cosine-distance thresholds (short prompts <= 8 words are stricter).
SHORT_PROMPT_WORDS = 8
SHORT_THRESHOLD = 0.06
LONG_THRESHOLD = 0.14
# Fixed value: entries that a gateway's shared semantic ring keeps (all tenants).
RING_SIZE = 5000
#: Pivots of the balls at most: a bounded sample of the entries.
PIVOTS = 1024
#: Entries of a ball at most, and bytes of their vectors: large balls, as every ball that a probe meets costs a copy of its vector.
BLOCK, BLOCK_BYTES = 16384, 8 << 20
#: Distances that a task computes at a time.
CELLS = 1 << 21
#: Room for rounding in bounds of distances.
SLACK = 1e-9


def primary_interrogative(text: Column) -> Column:
    """By patterns that end at their first match: a text's words are never listed."""
    text, inside = F.lower(text), r"[^\p{Punct}\s]"
    first = F.regexp_extract(text, rf"\A[\p{{Punct}}\s]*+({inside}++)", 1)
    later = F.regexp_extract(text, rf"(?=[{''.join(sorted({w[0] for w in STRONG_INTERROGATIVES}))}])(?<!{inside})({'|'.join(STRONG_INTERROGATIVES)})(?!{inside})", 1)
    return F.when(first.isin(*STRONG_INTERROGATIVES, *WEAK_INTERROGATIVES), first).otherwise(F.nullif(later, F.lit("")))


def short_prompt(text: Column) -> Column:
    """At most SHORT_PROMPT_WORDS words; reads no further than to the next one."""
    return ~text.rlike(rf"\A\s*+(?:\S++\s++){{{SHORT_PROMPT_WORDS}}}\S")


def _best_in_block(probes: pd.DataFrame, entries: pd.DataFrame, ring: int | None = None) -> pd.DataFrame:
    cols = ["probe_id", "vec_id", "distance"]
    if probes.empty or entries.empty:
        return pd.DataFrame({c: pd.Series(dtype="int64" if c != "distance" else "float64") for c in cols})
    # ties broken by the smaller entry id
    entries = entries.sort_values("vec_id", kind="stable")
    P = np.vstack(probes["vec"].to_numpy()).astype(np.float64)
    E = np.vstack(entries["vec"].to_numpy()).astype(np.float64)
    pn = np.linalg.norm(P, axis=1)
    en = np.linalg.norm(E, axis=1)
    numbers = lambda c: np.split(pd.factorize(pd.concat([probes[c], entries[c]]))[0], [len(P)])  # noqa: E731 - null: -1
    pi, ei = numbers("intent")
    tenants = numbers("tenant") if "tenant" in probes and "tenant" in entries else None
    seqs = "max_seq" in probes and "seq" in entries
    es, ps = (entries["seq"].to_numpy(), probes["max_seq"].to_numpy()) if seqs else (None, None)
    thr = np.where(probes["short"].to_numpy(dtype=bool), SHORT_THRESHOLD, LONG_THRESHOLD)
    ids, out, step = entries["vec_id"].to_numpy(), [], max(CELLS // len(E), 1)
    for at in range(0, len(P), step):
        k = slice(at, at + step)
        with np.errstate(divide="ignore", invalid="ignore"):
            dist = 1.0 - (P[k] @ E.T) / np.outer(pn[k], en)
        dist[(pn[k] == 0)[:, None] | (en == 0)[None, :]] = 1.0
        # few pairs are near enough; the other conditions are looked up for those
        i, j = np.nonzero(dist < thr[k][:, None])
        d = dist[i, j]
        i += at
        # intent: a mismatch only when both sides have an interrogative and they differ
        ok = (pi[i] < 0) | (ei[j] < 0) | (pi[i] == ei[j])
        if seqs:
            ok &= es[j] <= ps[i]
            if ring is not None:
                ok &= es[j] > ps[i] - ring
        if tenants is not None:
            ok &= (tenants[0][i] == tenants[1][j]) & (tenants[0][i] >= 0)
        i, j, d = i[ok], j[ok], d[ok]
        order = np.lexsort((j, d, i))
        i, j, d = i[order], j[order], d[order]
        first = np.r_[True, i[1:] != i[:-1]] if len(i) else np.zeros(0, bool)
        out.append((probes["probe_id"].to_numpy()[i[first]], ids[j[first]], d[first]))
    return pd.DataFrame({c: np.concatenate([o[n] for o in out]).astype("int64" if c != "distance" else "float64") for n, c in enumerate(cols)})


def _pivots(entries: DataFrame, n: int) -> np.ndarray:
    """Unit vectors of ``n`` entries, the least by hash."""
    rows = entries.select("vec", F.xxhash64("vec_id").alias("h"), "vec_id").orderBy("h", "vec_id").limit(n).collect()
    return np.array([np.asarray(r["vec"], float) / np.linalg.norm(r["vec"]) for r in rows])


def _cut(df: DataFrame) -> DataFrame:
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _usable(df: DataFrame) -> DataFrame:
    """Rows whose vector has a direction; a zero vector is at distance 1 from all, beyond every threshold."""
    return df.withColumn("vec", F.transform("vec", lambda x: x.cast("double"))).where(F.exists("vec", lambda x: x != 0))


def balls(entries: DataFrame, pivots: np.ndarray, block: int) -> DataFrame:
    """Entries with pivot, ball (its number among the group's and pivot's) and far, the distance from the pivot."""
    @F.pandas_udf("pivot long, far double")
    def place(vecs: pd.Series) -> pd.DataFrame:
        v = np.vstack(vecs.to_numpy())
        cos = (v / np.linalg.norm(v, axis=1, keepdims=True)) @ pivots.T
        at = cos.argmax(axis=1)
        return pd.DataFrame({"pivot": at, "far": np.sqrt(np.maximum(2 - 2 * cos[np.arange(len(v)), at], 0))})

    rows = entries.withColumn("x", place("vec")).select("*", "x.*").drop("x").withColumn("one", F.lit(1).cast("long"))
    # the position among the entries of a group and pivot, without a task that holds them all
    rows = running_sums(rows, ["tenant", "pivot"], "seq", "vec_id", ["one"], block * len(pivots))
    return rows.withColumn("ball", F.floor((F.col("one_running") - 1) / block).cast("long")).drop("one", "one_running")


def meetings(probes: DataFrame, table: DataFrame, pivots: np.ndarray, ring: int | None, fewest: bool) -> DataFrame:
    """(probe_id, pivot, ball, bound) of every ball that may hold an entry below the
    probe's limit; ``fewest``: of the least bound only."""
    reach = np.full(len(pivots), -1.0)
    for r in table.groupBy("pivot").agg(F.max("radius").alias("radius")).collect():  # a row for each pivot at most
        reach[r["pivot"]] = r["radius"]

    def near(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            v = np.vstack(pdf["vec"].to_numpy()) if len(pdf) else np.empty((0, pivots.shape[1]))
            far = np.sqrt(np.maximum(2 - 2 * (v / np.linalg.norm(v, axis=1, keepdims=True)) @ pivots.T, 0))
            most = np.sqrt(2 * pdf["limit"].to_numpy(float)) + SLACK
            i, j = np.nonzero((far - reach[None, :] <= most[:, None]) & (reach >= 0)[None, :])
            yield pd.DataFrame({"probe_id": pdf["probe_id"].to_numpy()[i], "tenant": pdf["tenant"].to_numpy()[i], "max_seq": pdf["max_seq"].to_numpy()[i],
                                "most": most[i], "pivot": j, "far": far[i, j]})

    kind = probes.schema["tenant"].dataType.simpleString()
    rows = probes.select("probe_id", "tenant", "max_seq", "limit", "vec").mapInPandas(near, f"probe_id long, tenant {kind}, max_seq long, most double, pivot long, far double")
    rows = rows.join(table, ["tenant", "pivot"]).withColumn("bound", F.greatest(F.col("far") - F.col("radius"), F.lit(0.0)))
    rows = rows.where((F.col("bound") <= F.col("most")) & (F.col("first") <= F.col("max_seq")))
    if ring is not None:
        rows = rows.where(F.col("last") > F.col("max_seq") - ring)
    rows = rows.select("probe_id", "pivot", "ball", "bound")
    if fewest:
        best = F.min_by(F.struct("pivot", "ball", "bound"), F.struct("bound", "pivot", "ball")).alias("x")
        rows = rows.groupBy("probe_id").agg(best).select("probe_id", "x.*")
    return rows


def _met(probes: DataFrame, entries: DataFrame, meet: DataFrame, ring: int | None, block: int) -> DataFrame:
    """probe_id, vec_id, distance: the best of every meeting."""
    key = ["tenant", "pivot", "ball", "part"]
    # a group's probes in parts of about ``block``: each part costs a copy of the balls it meets
    deal = probes.groupBy("tenant").agg(F.ceil(F.count(F.lit(1)) / block).alias("parts"))
    left = probes.join(meet.select("probe_id", "pivot", "ball"), "probe_id").join(deal, "tenant")
    left = left.withColumn("part", F.pmod(F.xxhash64("probe_id"), F.col("parts"))).drop("parts")
    parts = left.select(*key).distinct().toDF("_t", "_p", "_b", "part")
    right = entries.join(parts, (F.col("tenant") == F.col("_t")) & (F.col("pivot") == F.col("_p")) & (F.col("ball") == F.col("_b"))).drop("_t", "_p", "_b")
    right = right.toDF(*right.columns)  # both sides come from the table of balls: columns of their own

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return _best_in_block(a, b, ring)

    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(best, "probe_id long, vec_id long, distance double")


def _best(found: DataFrame) -> DataFrame:
    return (found.groupBy("probe_id").agg(F.min(F.struct("distance", "vec_id")).alias("b"))
            .select("probe_id", F.col("b.vec_id").alias("vec_id"), F.col("b.distance").alias("distance")))


def nearest(probes: DataFrame, entries: DataFrame, ring: int | None = None, block: int | None = None, pivots: int | None = None, counts: dict | None = None) -> DataFrame:
    """probe_id, vec_id, distance: the exact best among the entries of the probe's
    ``tenant`` with seq <= max_seq (``ring``: and seq > max_seq - ring) below its threshold;
    ties to the smaller vec_id. ``counts``, if given, receives the numbers of meetings:
    of probes and balls that exist, met first, and met in the second round."""
    probes = _usable(probes).withColumn("limit", F.when(F.col("short"), SHORT_THRESHOLD).otherwise(LONG_THRESHOLD))
    entries = _cut(_usable(entries))
    # as many pivots as give the largest group balls of about ``block`` entries
    most, dims = entries.groupBy("tenant").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("d")).agg(F.max("n"), F.max("d")).first()
    block = block or max(min(BLOCK, BLOCK_BYTES // (8 * (dims or 1))), 1)
    centres = _pivots(entries, pivots or min(max((most or 0) // block, 1), PIVOTS))
    if not len(centres):
        return probes.select("probe_id", F.col("probe_id").alias("vec_id"), F.lit(0.0).alias("distance")).limit(0)
    entries = _cut(balls(entries, centres, block))
    table = _cut(entries.groupBy("tenant", "pivot", "ball").agg(F.max("far").alias("radius"), F.min("seq").alias("first"), F.max("seq").alias("last")))
    probes = _cut(probes)
    first = _cut(meetings(probes, table, centres, ring, True))
    found = _cut(_met(probes, entries, first, ring, block))
    so_far = found.groupBy("probe_id").agg(F.min("distance").alias("d"))
    closer = probes.join(so_far, "probe_id", "left").withColumn("limit", F.least("limit", F.coalesce(F.col("d") + SLACK, F.col("limit")))).drop("d")
    second = _cut(meetings(closer, table, centres, ring, False).join(first.select("probe_id", "pivot", "ball"), ["probe_id", "pivot", "ball"], "left_anti"))
    if counts is not None:
        each = table.groupBy("tenant").count().join(probes.groupBy("tenant").agg(F.count("*").alias("n")), "tenant").agg(F.sum(F.col("count") * F.col("n"))).collect()[0][0]
        counts.update(all=each or 0, first=first.count(), second=second.count())
    return _best(found.unionByName(_met(probes, entries, second, ring, block)))
