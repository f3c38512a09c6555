"""Guardian golden scenarios (loop / storm) and loop-signature equivalences."""


from agentlake.functions.jsonsig import signature_text
from agentlake.operators.folds import GuardState, guard_step, guardian_replay


def test_signature_equivalences():
    base = signature_text('{"city":"Paris","units":"metric","timestamp":1,"nonce":"a"}')
    assert base == signature_text('{"units":"metric","nonce":"zz","city":"Paris","timestamp":99}')
    assert base != signature_text('{"city":"Berlin","units":"metric"}')
    assert signature_text('{"n":5}') == signature_text('{"n":5.0}')
    assert signature_text('{"id":1}') != signature_text('{"id":2}')
    # ephemeral keys are dropped at every depth
    assert signature_text('{"a":{"uuid":"x","b":1}}') == signature_text('{"a":{"b":1,"uuid":"y"}}')
    assert signature_text("not json") == signature_text("null")


def test_guard_steps():
    st = GuardState()
    for i, tool in enumerate(["a", "b", "c"]):
        assert guard_step(st, i, [(tool, 1)])[0] == "accepted"
    st = GuardState()
    decisions = [guard_step(st, i, [("search", 7)])[0] for i in range(6)]
    assert decisions == ["accepted"] * 5 + ["loop_blocked"]
    # after the TTL since the last accepted write, the same call is fine again
    assert guard_step(st, 4 + 60, [("search", 7)])[0] == "accepted"
    st = GuardState()
    assert guard_step(st, 0, [("t%d" % i, i) for i in range(21)])[0] == "storm_blocked"
    assert guard_step(st, 1, [("t", 1)] * 3)[0] == "accepted"


def test_guardian_replay_spark(spark):
    rows = [("s1", i * 2, i, ["search"], [7]) for i in range(7)] + [("s2", 0, 100, ["x"] * 21, list(range(21)))]
    df = spark.createDataFrame(rows, "session_id string, sec long, event_id long, tools array<string>, sigs array<long>")
    out = {r["event_id"]: r["decision"] for r in guardian_replay(df).collect()}
    assert [out[i] for i in range(7)] == ["accepted"] * 5 + ["loop_blocked"] * 2
    assert out[100] == "storm_blocked"


def test_guard_coverage_counts(spark):
    # FIXTURES.md C2 at sf0.01, sessions % 8: 8600 accepted / 119 loop / 1281 storm
    from agentlake.plans.guard import loop_replay
    r = loop_replay(spark, "/root/testdata/sf0.01")
    counts = {x["decision"]: x["count"] for x in r.groupBy("decision").count().collect()}
    assert counts == {"accepted": 8600, "loop_blocked": 119, "storm_blocked": 1281}


CLASSES = [
    ['{"city":"Paris","units":"metric","timestamp":1,"nonce":"a"}', '{"units":"metric","nonce":"zz","city":"Paris","timestamp":99}'],
    ['{"city":"Berlin","units":"metric"}'], ['{"n":5}', '{"n":5.0}'], ['{"id":1}'], ['{"id":2}'],
    ['{"a":1}', '{"a":1,"nonce":{"x":1}}', '{"a":1,"time":[1,2]}', '{"a":1.0,"uuid":null}'],
    ['{"k":100}', '{"k":1e2}', '{"k":100.00}'], ['{"k":"100"}'], ['{"k":[100]}', '{"k":[1e2]}'],
    ['{"q":"x,}"}'], ['{"q":"x}"}'], ['{"q":"x,y}","time":"12:00"}', '{"q":"x,y}"}'],
    ['{"a":{"uuid":"x","b":1}}', '{"a":{"b":1,"uuid":{"deep":[1]}}}'], ['{"a":{"b":1,"c":[]}}'],
    ['not json', 'null', '{"a":1,"a":2}'], ['{}', '{"nonce":{}}'], ['[]'], ['"s"'], ['true'], ['{"k":true}'], ['{"k":1}'],
    ['{"stream":true,"k":"v"}', '{"k":"v"}'], ['{"k":null}'],
    ['{"x":' * 40 + '{"nonce":1,"v":1}' + '}' * 40, '{"x":' * 40 + '{"v":1,"nonce":2}' + '}' * 40], ['{"x":' * 40 + '{"v":2}' + '}' * 40],
]


def test_signature_classes(spark):
    """Classes written by hand: flat beside nested, ephemeral values of any
    shape, number forms, strings that look like JSON, depth."""
    from agentlake.functions.jsonsig import with_loop_signature
    rows = [(c, a) for c, members in enumerate(CLASSES) for a in members]
    df = spark.createDataFrame(rows, "c int, a string")
    by_class = {}
    for r in with_loop_signature(df, "a").collect():
        by_class.setdefault(r["c"], set()).add(r["sig"])
    assert all(len(s) == 1 for s in by_class.values()), {CLASSES[c][0]: s for c, s in by_class.items() if len(s) > 1}
    assert len(set.union(*by_class.values())) == len(CLASSES)
    assert with_loop_signature(spark.createDataFrame([(None,)], "a string"), "a").first()["sig"] is None


def test_signature_is_one_scan(spark):
    from agentlake.plans.guard import loop_signature_q
    plan = loop_signature_q(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1


def _busy(n, seed):
    import random
    rnd = random.Random(seed)
    t, rows = 0, []
    for i in range(n):
        t += rnd.choice([0, 1, 2, 7, 30])
        calls = rnd.choices(["a", "b", "c"], k=rnd.choice([1, 1, 1, 3]))
        rows.append(("busy", t, i, calls, [rnd.randrange(2) for _ in calls]))
    return rows


def test_a_session_that_is_never_quiet_runs_in_bins(spark):
    rows = _busy(4000, 1) + [(f"s{i}", i, 10000 + i, ["a"], [1]) for i in range(30)]
    df = spark.createDataFrame(rows, "session_id string, sec long, event_id long, tools array<string>, sigs array<long>")
    st, want = GuardState(), {}
    for _, sec, ev, tools, sigs in rows[:4000]:
        want[ev] = guard_step(st, sec, list(zip(tools, sigs)))
    split = guardian_replay(df, long_rows=150)
    got = {r["event_id"]: (r["decision"], r["storm_count"], r["blocked_tool"]) for r in split.collect()}
    assert len(got) == len(rows) and {e: got[e] for e in want} == want
    assert {d for d, _, _ in want.values()} == {"accepted", "storm_blocked", "loop_blocked"}


def test_a_bucket_that_is_never_full_runs_in_bins(spark):
    from agentlake.operators.folds import BucketFold, run_fold
    rows = [("k", sec, ev, 4) for _, sec, ev, _, _ in _busy(3000, 2)] + [("free", i, 5000 + i, 0) for i in range(9)]
    df = spark.createDataFrame(rows, "key string, sec long, event_id long, capacity int")
    want, folds = {}, {}
    for key, sec, ev, cap in rows:
        want[ev] = folds.setdefault(key, BucketFold()).step(sec, cap)
    out = run_fold(df, ["key"], "sec", ["sec", "event_id"], 60, BucketFold, ["event_id"], long_rows=100)
    assert {r["event_id"]: (r["allowed"], r["tokens_left"]) for r in out.collect()} == want  # to the last bit
    assert {a for a, _ in want.values()} == {True, False}
