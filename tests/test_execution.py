"""Recorded executions: golden logs by the gateway's rules, busy keys in bins, random logs against a plain fold."""

import random

import pytest

from agentlake.operators import execution as X
from agentlake.operators import folds
from agentlake.operators.folds import segment

ROWS = "idempotency_key string, event_id long, kind string, at_sec long, version long, outcome string, read_only boolean, ledger string"


def rows_of(key, line, ledger=None, read_only=False, first=1):
    """'c@0 s1@3' as rows; see agentlake.sources.views.EXECUTION_PATTERNS."""
    out = []
    for i, item in enumerate(line.split()):
        what, at = item.split("@")
        claim = what == "c"
        out.append((key, first + i, "claim" if claim else "completion", int(at), None if claim else int(what[1:]),
                    None if claim else {"s": "success", "e": "error", "u": "timeout"}[what[0]], read_only if claim else None, ledger if claim else None))
    return out


def decided(spark, rows, **split):
    out = X.replay(spark.createDataFrame(rows, ROWS), **split).collect()
    assert len(out) == len(rows)
    return {r["event_id"]: (r["decision"], r["version"]) for r in out}


def decisions(spark, line, **kind):
    got = decided(spark, rows_of("k", line, **kind))
    return [got[i][0] for i in sorted(got)], [got[i][1] for i in sorted(got)]


def test_a_succeeded_operation_never_runs_again(spark):
    got, versions = decisions(spark, "c@0 s1@1 c@2 c@3 c@20 c@100 c@250")
    assert got == ["new_claim", "applied"] + ["replayed_result"] * 5 and versions == [1] * 7


def test_a_refused_claim_changes_nothing(spark):
    # it neither fences the live attempt nor renews its lease
    got, _ = decisions(spark, "c@0 c@2 s1@3")
    assert got == ["new_claim", "already_in_flight", "applied"]
    got, versions = decisions(spark, "c@0 c@9 c@10 c@11 c@21 c@22")
    assert got == ["new_claim", "already_in_flight", "already_in_flight", "lease_expired_reclaim", "already_in_flight", "lease_expired_reclaim"]
    assert versions == [1, 1, 1, 2, 2, 3]
    # nor does it keep the entry: 300 s after its last write it is forgotten
    got, versions = decisions(spark, "c@0 s1@5 c@290 c@304 c@305")
    assert got[2:] == ["replayed_result", "replayed_result", "new_claim"] and versions[-1] == 1


def test_outcomes_that_do_not_overwrite_each_other(spark):
    assert decisions(spark, "c@0 s1@1 e1@2 u1@3 c@4")[0][2:] == ["kept_succeeded", "kept_succeeded", "replayed_result"]
    assert decisions(spark, "c@0 u1@1 s1@2 c@3")[0][2:] == ["kept_unknown", "previous_attempt_unknown"]
    assert decisions(spark, "c@0 e1@1 s1@2 c@3")[0][2:] == ["applied", "replayed_result"]
    assert decisions(spark, "c@0 e1@1 c@2 s1@3 s2@4 c@5")[0][2:] == ["reclaim_after_failed", "fenced_stale", "applied", "replayed_result"]
    assert decisions(spark, "s1@0 c@0")[0] == ["no_entry", "new_claim"]  # completions first in a second


def test_unknown_outcomes(spark):
    line = "c@0 u1@1 c@2 c@3 c@4"
    assert decisions(spark, line, ledger="committed")[0][2:] == ["reconciled_succeeded", "replayed_result", "replayed_result"]
    got, versions = decisions(spark, line, ledger="absent")
    assert got[2:] == ["reconciliation_failed", "reclaim_after_failed", "already_in_flight"] and versions[2:] == [1, 2, 2]
    assert decisions(spark, line)[0][2:] == ["previous_attempt_unknown"] * 3
    got, versions = decisions(spark, "c@0 u1@1 c@2 c@3 c@11 s1@12", read_only=True)  # same version, old lease
    assert got[2:] == ["read_only_retry", "already_in_flight", "lease_expired_reclaim", "fenced_stale"] and versions[2:5] == [1, 1, 2]


def serial(rows):
    states, out = {}, {}
    for r in sorted(rows, key=lambda r: (r[3], r[2] == "claim", r[1])):
        s = states.setdefault(r[0], X.ExecutionFold())
        decision, version = s.step(*r[2:])
        out[r[1]] = decision, version if r[4] is None else r[4]
    return out


def random_rows(keys, n, steps, seed):
    rnd = random.Random(seed)
    rows, ev = [], 0
    for k in range(keys):
        t, ledger, reads = 0, rnd.choice(["committed", "absent", None]), rnd.random() < 0.3
        for _ in range(n):
            t, ev = t + rnd.choice(steps), ev + 1
            if rnd.random() < 0.5:
                rows.append((f"k{k}", ev, "claim", t, None, None, reads, ledger))
            else:
                rows.append((f"k{k}", ev, "completion", t, rnd.randrange(1, 4), rnd.choice(["success", "error", "timeout"]), None, None))
    return rows


def test_random_logs(spark):
    rows = random_rows(120, 14, [1, 1, 4, 11, 40, 299, 300, 350], 2)
    want = serial(rows)
    assert decided(spark, rows) == want
    assert len({d for d, _ in want.values()}) >= 13


@pytest.mark.parametrize("rounds", [6, 0])
def test_a_key_that_is_never_quiet_runs_in_bins(spark, monkeypatch, rounds):
    """Beside quiet keys; also when the corrections go on too long and the rest runs serially."""
    rows = random_rows(1, 3000, [1, 2, 30, 120], 5) + [(f"q{i}", 10000 + i, "claim", i, None, None, False, None) for i in range(50)]
    tasks = []
    whole = folds._fold
    monkeypatch.setattr(folds, "_fold", lambda df, keys, *a: tasks.append(df.select(*keys).distinct().count()) or whole(df, keys, *a))
    assert decided(spark, rows, long_rows=100, rounds=rounds) == serial(rows)
    assert tasks[0] > 20 and len(tasks) >= 3  # the first round folds all bins, later ones some
    assert all(n < tasks[0] for n in tasks[1:-1])


def test_segments_split_only_at_provable_resets(spark):
    rows = [("k", 0), ("k", 14), ("k", 314), ("k", 330), ("k", 700)]
    df = spark.createDataFrame(rows, "idempotency_key string, at_sec long")
    segs = [r["_seg"] for r in segment(df, ["idempotency_key"], "at_sec", 300).orderBy("at_sec").collect()]
    assert segs == [1, 1, 2, 2, 3]
