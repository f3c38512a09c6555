"""Keyed ordered folds: the guardian (W1/W2, R3), the token bucket (W5), the
execution log (W9) and the driver that runs them.

A fold is one key's state machine (:class:`Fold`): rows come in order, each gives
its outputs, and the state can be written as text and read again. The batch driver
streams sorted partitions through it, so a task holds the state of one key, not its
rows; the streaming jobs keep the same text as their state and call the same ``step``.

How a key is split:

* where all that earlier events could have written has expired (``segment``: for the
  guardian, the bucket and executions a quiet gap of the TTL), segments are independent;
* a segment of more than ``long_rows`` rows, of a key that is never quiet, is cut into
  bins of about that many rows, which are folded *speculatively*: all bins at once, the
  first time from an empty state, then again only those whose entering state turned
  out to be another one (the leaving state of the bin before), until none has. A bin is
  right once its entering state is, so the result is that of the serial fold. States forget
  (counters expire, buckets run full, versions are confirmed), so few bins run again;
  if some still change after ``rounds`` rounds, their segments are folded on from
  there in one task, which keeps adversarial input exact as well.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from agentlake.session import checkpoint_dir

# Guardian limits and TTL (seconds) as shipped.
MAX_SESSION_TOOL_CALLS = 20
MAX_IDENTICAL_TOOL_CALLS = 5
GUARD_TTL_SEC = 60


def segment(df: DataFrame, keys: list[str], ts: str, gap: int, out: str = "_seg",
            end: str | None = None) -> DataFrame:
    """Add a segment id per key: a new segment starts at an event that comes
    no earlier than every earlier event's ``end`` (default ``ts + gap``), i.e.
    where all state the earlier events could have written has expired.

    Computed on per-(key, bin) aggregates with bins of ``gap`` seconds: every
    event's end is at least ``gap`` after it, so earlier events of the same
    bin always overlap a later one and boundaries can only fall on a bin's
    first event. No window ever spans a whole key's rows."""
    b = "_sbin"
    end_col = F.col(end) if end else F.col(ts) + gap
    binned = df.withColumn(b, F.floor(F.col(ts) / gap).cast("bigint"))
    per_bin = binned.groupBy(*keys, b).agg(F.min(ts).alias("_lo"), F.max(end_col).alias("_hi"))
    wb = Window.partitionBy(*keys).orderBy(b)
    prev_end = F.max("_hi").over(wb.rowsBetween(Window.unboundedPreceding, -1))
    flags = per_bin.select(*keys, b, F.when(prev_end.isNull() | (F.col("_lo") >= prev_end), 1)
                           .otherwise(0).alias("_new"))
    segs = flags.select(*keys, b, F.sum("_new").over(wb.rowsBetween(Window.unboundedPreceding, 0))
                        .cast("bigint").alias(out))
    return binned.join(segs, [*keys, b], "inner").drop(b)


# ---------------------------------------------------------------- driver

#: Rows of a segment from which it is cut into bins, and rounds of corrections before the serial pass.
LONG_ROWS, ROUNDS = 100_000, 6


class Fold:
    """One key's state machine. ``columns`` are read from the rows, ``outputs`` is the
    schema of what ``step`` returns for each."""

    columns: tuple[str, ...] = ()
    outputs = ""

    def __init__(self, text: str = ""):
        raise NotImplementedError

    def step(self, *row) -> tuple:
        raise NotImplementedError

    def dump(self) -> str:
        """The state without what has expired at the last row: equal states as equal text, the empty one as ''."""
        raise NotImplementedError


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _fold(df: DataFrame, keys: list[str], order: list, fold: type[Fold], carry: list[str], bins: bool) -> DataFrame:
    """Rows dealt by ``keys`` and folded in ``order`` -> carry and outputs. With ``bins``
    a state is entered by ``_enter``, and a row with the leaving state follows each key."""
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    kept = [c for c in [*keys, "_enter"] if c not in carry] if bins else []
    outputs = _names(fold.outputs)
    schema = ", ".join([f"{c} {types[c]}" for c in [*carry, *kept]] + [fold.outputs] + (["_leave string"] if bins else []))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, machine, entered = None, None, None

        def mark() -> pd.DataFrame:
            row = dict.fromkeys([*carry, *kept, *outputs])
            return pd.DataFrame([row | dict(zip(keys, now)) | {"_enter": entered, "_leave": machine.dump()}])

        for pdf in frames:
            out, ends = [], []
            enters = pdf["_enter"].tolist() if bins else [""] * len(pdf)
            for key, enter, row in zip(zip(*[pdf[k].tolist() for k in keys]), enters, zip(*[pdf[c].tolist() for c in fold.columns])):
                if key != now:
                    if bins and machine is not None:
                        ends.append(mark())
                    now, entered, machine = key, enter, fold(enter)
                out.append(machine.step(*row))
            done = pdf[[*carry, *kept]].reset_index(drop=True)
            done[outputs] = pd.DataFrame(out, columns=outputs, dtype=object)
            if not bins:
                yield done
                continue
            yield done.assign(_leave=None)
            yield from ends
        if bins and machine is not None:
            yield mark()

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


def _cut(df: DataFrame) -> DataFrame:
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def run_fold(df: DataFrame, keys: list[str], ts: str, order: list, gap: int, fold: type[Fold], carry: list[str],
             long_rows: int = LONG_ROWS, rounds: int = ROUNDS) -> DataFrame:
    """``carry`` columns and the fold's outputs of every row. State of ``keys`` is known
    to be empty after ``gap`` seconds of ``ts`` without a row; ``order`` begins with ``ts``."""
    rows = segment(df, keys, ts, gap)
    part = [*keys, "_seg"]
    if df.groupBy(*keys).count().where(F.col("count") > long_rows).isEmpty():
        return _fold(rows, part, order, fold, carry, False)
    sizes = _cut(rows.groupBy(*part).agg(F.count("*").alias("_n"), F.min(ts).alias("_lo"), F.max(ts).alias("_hi")))
    plain = rows.join(sizes.where(F.col("_n") <= long_rows).select(*part), part, "left_semi")
    width = F.greatest(F.ceil((F.col("_hi") - F.col("_lo") + 1) * long_rows / F.col("_n")), F.lit(1))
    long = rows.join(sizes.where(F.col("_n") > long_rows), part).withColumn("_bin", F.floor((F.col(ts) - F.col("_lo")) / width).cast("long"))
    return _fold(plain, part, order, fold, carry, False).unionByName(_speculative(long.drop("_n", "_lo", "_hi"), part, order, fold, carry, rounds))


def _speculative(rows: DataFrame, part: list[str], order: list, fold: type[Fold], carry: list[str], rounds: int) -> DataFrame:
    """Rows of long segments with their ``_bin`` -> carry and outputs."""
    rows, key = _cut(rows), [*part, "_bin"]
    before = Window.partitionBy(*part).orderBy("_bin")
    runs, asked, states, ask = [], [], None, None
    todo = rows.withColumn("_enter", F.lit(""))
    while True:
        runs.append(_cut(_fold(todo, key, order, fold, carry, True)))
        marks = runs[-1].where("_leave IS NOT NULL").select(*key, "_enter", "_leave")
        states = marks if states is None else _cut(states.join(ask, key, "left_anti").unionByName(marks))
        due = states.withColumn("_due", F.coalesce(F.lag("_leave").over(before), F.lit(""))).where("_due <> _enter")
        ask = _cut(due.select(*key, F.col("_due").alias("_new")))
        if ask.isEmpty():
            break
        if len(runs) > rounds:
            # the first changed bin of a segment enters with a final state: go on from there, in order
            first = ask.groupBy(*part).agg(F.min(F.struct("_bin", "_new")).alias("x")).select(*part, F.col("x._bin").alias("_first"), F.col("x._new").alias("_enter"))
            todo = rows.join(first, part).where(F.col("_bin") >= F.col("_first")).withColumn("_bin", F.col("_first")).drop("_first")
            asked.append(_cut(states.select(*key).join(first, part).where(F.col("_bin") >= F.col("_first")).select(*key)))
            runs.append(_fold(todo, key, order, fold, carry, True))
            break
        asked.append(ask.select(*key))
        todo = rows.join(ask.withColumnRenamed("_new", "_enter"), key)
    # of each bin the last run counts
    kept = []
    for i, out in enumerate(runs):
        out = out.where("_leave IS NULL")
        later = asked[i:]
        kept.append(out.join(reduce(DataFrame.unionByName, later).distinct(), key, "left_anti") if later else out)
    return reduce(DataFrame.unionByName, kept).select(*carry, *_names(fold.outputs))


# ---------------------------------------------------------------- guardian

class GuardState:
    """Per-session guardian state: storm counter and per-(tool, signature) loop counters,
    each with the time of its last accepted write (TTL re-armed by writes only)."""

    __slots__ = ("storm", "loops")

    def __init__(self):
        self.storm: tuple[int, int] | None = None          # (count, last_write_sec)
        self.loops: dict[tuple, tuple[int, int]] = {}      # (tool, sig) -> (count, last_write_sec)

    def alive(self, entry, now: int, ttl: int) -> int:
        if entry is None or now - entry[1] >= ttl:
            return 0
        return entry[0]


def guard_step(st: GuardState, sec: int, calls: list[tuple], max_calls: int = MAX_SESSION_TOOL_CALLS,
               max_identical: int = MAX_IDENTICAL_TOOL_CALLS, ttl: int = GUARD_TTL_SEC):
    """Apply one request (its tool calls, in order) to the session state.

    Returns (decision, storm_count_after, blocked_tool). Storm test first: a
    blocked request adds nothing. Then each call's loop counter; the first one
    over the limit blocks the request (earlier calls' writes stay).
    """
    storm = st.alive(st.storm, sec, ttl) + len(calls)
    if storm > max_calls:
        return "storm_blocked", st.alive(st.storm, sec, ttl), None
    st.storm = (storm, sec)
    for tool, sig in calls:
        if tool is None:
            continue
        key = (tool, sig)
        c = st.alive(st.loops.get(key), sec, ttl) + 1
        if c > max_identical:
            return "loop_blocked", storm, tool
        st.loops[key] = (c, sec)
    # drop expired entries so state stays bounded by the live window
    if len(st.loops) > 64:
        st.loops = {k: v for k, v in st.loops.items() if sec - v[1] < ttl}
    return "accepted", storm, None


class GuardFold(Fold):
    """W1 + W2: a row is a request with its tool calls."""

    columns = ("sec", "tools", "sigs")
    outputs = "decision string, storm_count long, blocked_tool string"

    def __init__(self, text: str = ""):
        self.state, self.now = GuardState(), 0
        if text:
            storm, loops, self.now = json.loads(text)
            self.state.storm = tuple(storm) if storm else None
            self.state.loops = {(tool, sig): (n, at) for tool, sig, n, at in loops}

    def step(self, sec, tools, sigs) -> tuple:
        self.now = int(sec)
        return guard_step(self.state, self.now, list(zip(tools, sigs)) if tools is not None else [])

    def dump(self) -> str:
        live = [[tool, None if sig is None else int(sig), n, at] for (tool, sig), (n, at) in self.state.loops.items() if self.now - at < GUARD_TTL_SEC]
        storm = self.state.storm if self.state.alive(self.state.storm, self.now, GUARD_TTL_SEC) else None
        return json.dumps([storm, sorted(live, key=str), self.now]) if storm or live else ""


def guardian_replay(requests: DataFrame, carry: tuple[str, ...] = (), **split) -> DataFrame:
    """W1 + W2 exact replay.

    ``requests``: session_id, sec (long), event_id (long, unique tiebreak),
    tools ARRAY<STRING>, sigs ARRAY<LONG> (per call, same order); ``carry`` names
    further columns to return.
    """
    rows = requests.select("session_id", "sec", "event_id", "tools", "sigs", *carry)
    return run_fold(rows, ["session_id"], "sec", ["sec", "event_id"], GUARD_TTL_SEC, GuardFold, ["event_id", "session_id", "sec", *carry], **split)


# ---------------------------------------------------------------- token bucket

class BucketFold(Fold):
    """``capacity`` tokens, refilled capacity / 60 a second; full at a key's first row."""

    columns = ("sec", "capacity")
    outputs = "allowed boolean, tokens_left double"

    def __init__(self, text: str = ""):
        self.tokens, self.last = json.loads(text) if text else (None, None)

    def step(self, sec, capacity) -> tuple:
        sec, cap = int(sec), int(capacity)
        if self.last is None:
            self.tokens, self.last = float(cap), sec
        if cap <= 0:
            return True, float(cap)
        self.tokens = min(float(cap), self.tokens + (sec - self.last) * (cap / 60.0))
        self.last = sec
        if self.tokens < 1.0:
            return False, self.tokens
        self.tokens -= 1.0
        return True, self.tokens

    def dump(self) -> str:
        return json.dumps([self.tokens, self.last])
