"""Structured Streaming forms of the operators.

Event time is the compressed clock (``sec``) as a timestamp. Stateful
operators keep per-key state in the state store (RocksDB provider from the
session conf) and checkpoint to the location the caller passes — on a
cluster a folder under the shared ``spark.checkpoint.dir``.

R3 reuses :func:`agentlake.operators.folds.guard_step`, the same step the
batch replay runs, so stream and batch agree by construction. Rows of a key
inside one micro-batch arrive unordered: they are sorted by (sec, event_id)
before being applied (T11).
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from agentlake.functions.pii import redact_text
from agentlake.operators.folds import GUARD_TTL_SEC, GuardState, guard_step


def with_event_time(df: DataFrame, sec_col: str = "sec") -> DataFrame:
    return df.withColumn("event_time", F.timestamp_seconds(F.col(sec_col) + 1704067200))


# ------------------------------------------------------------------ R3 guardian

_GUARD_OUT = "event_id long, session_id string, sec long, decision string, storm_count long"
_GUARD_STATE = "storm_count long, storm_last long, loops string"


def _load(state: GroupState) -> GuardState:
    st = GuardState()
    if state.exists:
        cnt, last, loops = state.get
        st.storm = (int(cnt), int(last)) if last is not None else None
        st.loops = {tuple(k.split("\u0001", 1)): tuple(v) for k, v in json.loads(loops).items()}
    return st


def _save(state: GroupState, st: GuardState, now: int):
    live = {f"{k[0]}\u0001{k[1]}": list(v) for k, v in st.loops.items() if now - v[1] < GUARD_TTL_SEC}
    cnt, last = st.storm if st.storm else (0, None)
    state.update((cnt, last, json.dumps(live)))


def _guard_func(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        state.remove()
        return
    rows = pd.concat(list(pdfs)).sort_values(["sec", "event_id"])
    st = _load(state)
    out = []
    for ev, sec, tool, sig in zip(rows["event_id"], rows["sec"], rows["tool_name"], rows["sig"]):
        sig_key = "" if sig is None or pd.isna(sig) else str(int(sig))
        dec, cnt, _ = guard_step(st, int(sec), [(tool, sig_key)])
        out.append((int(ev), key[0], int(sec), dec, int(cnt)))
    now = int(rows["sec"].max())
    _save(state, st, now)
    # all state has expired 60 s after the last write: let event time clear it
    expiry_ms = (now + 1704067200 + GUARD_TTL_SEC) * 1000
    state.setTimeoutTimestamp(max(expiry_ms, state.getCurrentWatermarkMs() + 1))
    yield pd.DataFrame(out, columns=["event_id", "session_id", "sec", "decision", "storm_count"])


def guardian_stream(calls: DataFrame, watermark: str = "2 minutes") -> DataFrame:
    """calls: streaming (session_id, sec, event_id, tool_name, sig)."""
    return (with_event_time(calls).withWatermark("event_time", watermark)
            .groupBy("session_id")
            .applyInPandasWithState(_guard_func, _GUARD_OUT, _GUARD_STATE, "append",
                                    GroupStateTimeout.EventTimeTimeout))


# ------------------------------------------------------------------ R12, R6, R8, R1

def redact_stream(docs: DataFrame) -> DataFrame:
    """Stateless redaction of a stream of texts."""
    return docs.select("doc_id", redact_text(F.col("text")).alias("redacted"))


def live_metrics_stream(requests: DataFrame, window: str = "60 seconds", watermark: str = "2 minutes") -> DataFrame:
    """Per-tenant request counters in tumbling event-time windows."""
    r = with_event_time(requests).withWatermark("event_time", watermark)
    return (r.groupBy(F.window("event_time", window), "tenant_id")
            .agg(F.count(F.lit(1)).alias("requests"), F.sum("latency_ms").alias("total_latency_ms"),
                 F.sum("total_tokens").alias("total_tokens")))


def sessions_stream(calls: DataFrame, gap: str = "60 seconds", watermark: str = "2 minutes") -> DataFrame:
    """Activity sessions closed after a 60 s gap."""
    c = with_event_time(calls).withWatermark("event_time", watermark)
    return (c.groupBy(F.session_window("event_time", gap), "session_id")
            .agg(F.count(F.lit(1)).alias("calls"), F.approx_count_distinct("tool_name").alias("tools")))


def dedup_stream(results: DataFrame, key: str = "idempotency_key", watermark: str = "300 seconds") -> DataFrame:
    """First accepted result per idempotency key within the 300 s window."""
    return with_event_time(results).withWatermark("event_time", watermark).dropDuplicatesWithinWatermark([key])
