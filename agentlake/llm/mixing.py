"""Mixing sources to target weights with a time-varying curriculum.

Every source has a weight (its share of the mix) and a *schedule*: how its
sampling rate changes over training time, piecewise linear over [0, 1]. The
schedule is integrated in closed form; a document whose words begin at share p
of its source's demand is trained at the time t where the integral reaches p.
Documents are then range-sorted by that position.

Scale: a source's running sum of words is built from sums for (source, bin),
where the bin is the head of the document's hash, so the largest source is cut
into ``16 ** bin_digits`` windows; only the table of sources is ordered as a whole.

Defined results: a null or empty text has size 0 and is never taken; documents
without a source are one source of their own, ordered last; ties in the hash
order go by doc_id; repeated rows are documents of their own; an empty table
gives an empty result; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from agentlake.llm.common import WORD

#: For weights in turn: knots (time, rate). Broad sources lead, small ones come late.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.25), (0.5, 1.0), (1.0, 1.75)))


def words(text) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def training_time(share: Column, knots: tuple[tuple[float, float], ...]) -> Column:
    """The time at which the integral of the schedule reaches this share of its total."""
    areas = [(b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:])]
    total, before, out = sum(areas), 0.0, F.lit(knots[-1][0])
    parts = []
    for (t0, w0), (t1, w1), area in zip(knots, knots[1:], areas):
        slope, x = (w1 - w0) / (t1 - t0), share * total - before
        dt = x / w0 if slope == 0 else (F.sqrt(F.greatest(F.lit(0.0), w0 * w0 + 2 * slope * x)) - w0) / slope
        parts.append(((before + area) / total, t0 + dt))
        before += area
    for upto, t in reversed(parts):
        out = F.when(share < upto, t).otherwise(out)
    return out


def targets(sources: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size) -> source, source_size, kind (index of its weight), target.

    Sources share ``share`` times all words by weight; none gets more than
    ``cap`` times its own size and what is above is shared again. Sources are
    taken by growing cap / weight: the first that stays below its cap fixes the
    level of all that follow (one ordered pass instead of repeated rounds)."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    s = sources.withColumn("kind", F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))))
    s = s.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("kind") + 1)).withColumn("most", F.col("source_size") * F.lit(cap))
    s = s.withColumn("ratio", F.col("most") / F.col("w"))
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before, rest, every = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumn("level", (F.sum("source_size").over(every) * F.lit(share) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("w").over(rest))
    s = s.withColumn("line", F.first(F.when(F.col("ratio") >= F.col("level"), F.col("level")), ignorenulls=True).over(every))
    target = F.when(F.col("line").isNull() | (F.col("ratio") < F.col("line")), F.col("most")).otherwise(F.col("line") * F.col("w"))
    return s.select("source", "source_size", "kind", target.alias("target"))


def scheduled(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, seed: str = "mix",
              schedules=SCHEDULES, bin_digits: int = 3, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text, source -> one row for each row: doc_id, source, *keep, size,
    source_size, target, uses: an array of (epoch, words, position), one for each time
    the document is taken, the first so many ``words`` of it at ``position`` in [0, 1].

    A source's documents stand in the order of md5(seed:doc_id) and are gone through
    again and again until the target is reached; the last one is cut. The position of a use
    is where the integral of its source's schedule reaches the words taken before it."""
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    sized = docs.select("doc_id", "source", *keep, words(F.col("text")).alias("size"), key.alias("__key"))
    sized = sized.withColumn("__bin", F.substring("__key", 1, bin_digits))
    bins = sized.groupBy("source", "__bin").agg(F.sum("size").alias("n"))
    goal = targets(bins.groupBy("source").agg(F.sum("n").alias("source_size")), weights, share, cap)
    earlier = Window.partitionBy("source").orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.withColumn("offset", F.coalesce(F.sum("n").over(earlier), F.lit(0))).alias("b") \
        .join(goal.alias("g"), F.col("b.source").eqNullSafe(F.col("g.source"))) \
        .select(F.col("b.source").alias("s"), F.col("b.__bin").alias("__b"), "offset", "source_size", "kind", "target")
    rows = sized.join(bins, F.col("source").eqNullSafe(F.col("s")) & (F.col("__bin") == F.col("__b")))
    within = Window.partitionBy("source", "__bin").orderBy("__key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("start", F.col("offset") + F.sum("size").over(within) - F.col("size"))
    goal_words = F.floor("target")
    full = F.floor(goal_words / F.greatest(F.col("source_size"), F.lit(1)))
    left = goal_words - full * F.col("source_size") - F.col("start")
    rows = rows.withColumn("full", full).withColumn("last", F.least(F.greatest(left, F.lit(0)), F.col("size")))

    def use(e: Column) -> Column:
        reached, time = F.try_divide(e * F.col("source_size") + F.col("start"), F.col("target")), F.lit(0.0)
        for k, knots in enumerate(schedules[:len(weights)]):
            time = F.when(F.col("kind") == k, training_time(reached, knots)).otherwise(time)
        return F.struct(e.alias("epoch"), F.when(e < F.col("full"), F.col("size")).otherwise(F.col("last")).alias("words"), time.alias("position"))

    uses = F.filter(F.transform(F.sequence(F.lit(0).cast("long"), F.col("full")), use), lambda u: u["words"] > 0)
    return rows.select("doc_id", "source", *keep, "size", "source_size", "target", uses.alias("uses"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, seed: str = "mix",
        schedules=SCHEDULES, bin_digits: int = 3, keep: tuple[str, ...] = (), untaken: bool = False) -> DataFrame:
    """doc_id, text, source -> one row for each time a document is taken, sorted
    by range of ``position``: doc_id, source, *keep, size, source_size, target,
    epoch, words (the first so many of the document), position.
    ``untaken``: also a row of 0 words for documents that the mix leaves out."""
    rows = scheduled(docs, weights, share, cap, seed, schedules, bin_digits, keep)
    rows = rows.withColumn("u", F.explode_outer("uses") if untaken else F.explode("uses"))
    out = rows.select("doc_id", "source", *keep, "size", "source_size", "target", F.coalesce("u.epoch", F.lit(0)).cast("long").alias("epoch"),
                      F.coalesce("u.words", F.lit(0)).cast("long").alias("words"), F.col("u.position").alias("position"))
    return out.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id", "epoch")
