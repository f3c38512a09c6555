"""Tool executions from their recorded claims and completions.

Both are rows of a log, in order of time, completions before claims of the same
second. A claim asks to run the operation of an idempotency key; a completion
carries the version (fencing token) of the attempt it belongs to and its outcome.
Nothing is scheduled or simulated: the log is what happened, and folding it by key
says what the gateway decided. A key's entry is claimed, succeeded, failed or unknown,
with a version, the end of its lease, and the time of its last write:

* a claim is accepted, and writes, where there is no entry (version 1), where the attempt
  failed, and where a claimed attempt's lease has run out (version + 1). It is refused, and
  writes nothing, where the attempt succeeded (the result is replayed) or its lease holds;
* a claim that meets an unknown outcome runs again under the same version if the tool only
  reads; else the ledger decides: committed makes the entry succeeded, absence failed, and
  without a verdict it stays unknown;
* a completion of another version is fenced. A success never overwrites an unknown outcome,
  an error or an unknown outcome never a success;
* an entry is forgotten an entry TTL after its last write. Refused claims do not renew it.

Keys are split as :mod:`agentlake.operators.folds` describes; the streaming form keeps the
same state and calls the same ``step``.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agentlake.operators.folds import Fold, run_fold

# Lease on a claim, entry TTL since the last write (seconds).
LEASE_SEC = 10
ENTRY_TTL_SEC = 300


def log(claims: DataFrame, completions: DataFrame) -> DataFrame:
    """claims (idempotency_key, event_id, claim_sec, read_only, ledger), completions
    (idempotency_key, event_id, at_sec, version, outcome) -> one log."""
    c = claims.select("idempotency_key", "event_id", F.lit("claim").alias("kind"), F.col("claim_sec").alias("at_sec"), F.lit(None).cast("long").alias("version"),
                      F.lit(None).cast("string").alias("outcome"), "read_only", "ledger")
    d = completions.select("idempotency_key", "event_id", F.lit("completion").alias("kind"), "at_sec", "version", "outcome",
                           F.lit(None).cast("boolean").alias("read_only"), F.lit(None).cast("string").alias("ledger"))
    return c.unionByName(d)


def with_ledger(rows: DataFrame, ledger: DataFrame, coverage: DataFrame) -> DataFrame:
    """J10 input side: attach the ledger verdict per key — found -> committed;
    inside a covered range but missing -> absent (authoritative); else unknown."""
    return (rows.join(ledger.select("idempotency_key", F.lit(True).alias("_found")), "idempotency_key", "left")
            .join(coverage.select("idempotency_key", F.lit(True).alias("_covered")), "idempotency_key", "left")
            .withColumn("ledger", F.when(F.col("_found"), "committed").when(F.col("_covered"), "absent"))
            .drop("_found", "_covered"))


class ExecutionFold(Fold):
    """The entry of one key. ``decided`` is the version of the entry after the row
    (null without one): a claim's own version if it was accepted."""

    columns = ("kind", "at_sec", "version", "outcome", "read_only", "ledger")
    outputs = "decision string, decided long"

    def __init__(self, text: str = ""):
        self.state, self.version, self.lease, self.written, self.now = json.loads(text) if text else (None, None, None, None, None)

    def _write(self, state: str, version: int | None = None) -> None:
        self.state, self.written = state, self.now
        if version is not None:
            self.version, self.lease = version, self.now + LEASE_SEC

    def step(self, kind, at, version, outcome, read_only, ledger) -> tuple:
        self.now = int(at)
        if self.state and self.now - self.written >= ENTRY_TTL_SEC:
            self.state = self.version = self.lease = self.written = None
        decision = self._completed(version, outcome) if kind == "completion" else self._claimed(read_only is not None and bool(read_only), ledger)
        return decision, self.version

    def _completed(self, version, outcome) -> str:
        if not self.state:
            return "no_entry"
        if int(version) != self.version:
            return "fenced_stale"
        if outcome == "success" and self.state == "unknown":
            return "kept_unknown"
        if outcome != "success" and self.state == "succeeded":
            return "kept_succeeded"
        self._write({"success": "succeeded", "error": "failed"}.get(outcome, "unknown"))
        return "applied"

    def _claimed(self, read_only: bool, ledger) -> str:
        if not self.state:
            self._write("claimed", 1)
            return "new_claim"
        if self.state == "succeeded":
            return "replayed_result"
        if self.state == "failed":
            self._write("claimed", self.version + 1)
            return "reclaim_after_failed"
        if self.state == "claimed":
            if self.now <= self.lease:
                return "already_in_flight"
            self._write("claimed", self.version + 1)
            return "lease_expired_reclaim"
        if read_only:
            self._write("claimed")  # the same version, and its old lease
            return "read_only_retry"
        state, decision = {"committed": ("succeeded", "reconciled_succeeded"), "absent": ("failed", "reconciliation_failed")}.get(ledger, ("unknown", "previous_attempt_unknown"))
        self._write(state)
        return decision

    def dump(self) -> str:
        if not self.state:
            return ""
        return json.dumps([self.state, self.version, self.lease, self.written, self.now])


#: Decisions of claims that ran the operation.
EXECUTED = ("new_claim", "reclaim_after_failed", "lease_expired_reclaim", "read_only_retry")


def replay(rows: DataFrame, **split) -> DataFrame:
    """event_id, idempotency_key, kind, at_sec, version, outcome, decision of every
    row of a log. The version of a completion is its own, of a claim that of the entry after it."""
    order = ["at_sec", (F.col("kind") == "claim").cast("int"), "event_id"]
    carry = ["event_id", "idempotency_key", "kind", "at_sec", "version", "outcome"]
    out = run_fold(rows, ["idempotency_key"], "at_sec", order, ENTRY_TTL_SEC, ExecutionFold, carry, **split)
    return out.withColumn("version", F.coalesce("version", "decided")).drop("decided")
