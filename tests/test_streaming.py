"""Streaming drivers over split files with availableNow: stream == batch."""

import os
import tempfile

from pyspark.sql import functions as F

from agentlake.functions.jsonsig import with_loop_signature
from agentlake.operators.folds import guardian_replay
from agentlake.sources import views as V
from agentlake.streaming import drivers as S

SF = "/root/testdata/sf0.001"


def _stage(spark, df, n_files=4, by=None):
    d = tempfile.mkdtemp(prefix="agentlake-stream-")
    src = os.path.join(d, "src")
    # several files; rows inside a file are unordered. With ``by``, files are
    # written one after another over consecutive time ranges, so the file
    # source (oldest file first) replays them in event-time order.
    if not by:
        df.repartition(n_files).write.parquet(src)
        return d, src
    lo, hi = df.agg(F.min(by), F.max(by)).first()
    step = (hi - lo) // n_files + 1
    for i in range(n_files):
        part = df.filter((F.col(by) >= lo + i * step) & (F.col(by) < lo + (i + 1) * step))
        part.orderBy(F.rand(7)).coalesce(1).write.mode("append").parquet(src)
    return d, src


def test_guardian_stream_equals_batch(spark):
    g = with_loop_signature(V.guard_calls(spark, SF), "arguments").select("session_id", "sec", "event_id", "tool_name", "sig")
    d, src = _stage(spark, g, 4, "sec")
    stream = spark.readStream.schema(g.schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = (S.guardian_stream(stream).writeStream.format("memory").queryName("guard_out")
         .option("checkpointLocation", os.path.join(d, "ckpt")).outputMode("append")
         .trigger(availableNow=True).start())
    q.awaitTermination(300)
    got = {r["event_id"]: r["decision"] for r in spark.sql("SELECT * FROM guard_out").collect()}
    batch_in = g.select("session_id", "sec", "event_id", F.array("tool_name").alias("tools"),
                        F.array("sig").alias("sigs"))
    want = {r["event_id"]: r["decision"] for r in guardian_replay(batch_in).collect()}
    diff = [k for k in want if got.get(k) != want[k]]
    assert len(got) == len(want), (len(got), len(want))
    assert not diff, (len(diff), [(k, got.get(k), want[k]) for k in diff[:5]])


def test_redact_and_windows_stream(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    d, src = _stage(spark, docs, 2)
    s = spark.readStream.schema(docs.schema).parquet(src)
    q = (S.redact_stream(s).writeStream.format("memory").queryName("redact_out")
         .option("checkpointLocation", os.path.join(d, "ckpt")).trigger(availableNow=True).start())
    q.awaitTermination(300)
    assert spark.sql("SELECT count(*) c FROM redact_out").first()["c"] == docs.count()

    req = V.requests(spark, SF).select("tenant_id", "sec", "latency_ms", "total_tokens")
    d2, src2 = _stage(spark, req, 2)
    s2 = spark.readStream.schema(req.schema).parquet(src2)
    q2 = (S.live_metrics_stream(s2).writeStream.format("memory").queryName("metrics_out")
          .option("checkpointLocation", os.path.join(d2, "ckpt")).outputMode("update")
          .trigger(availableNow=True).start())
    q2.awaitTermination(300)
    total = spark.sql("SELECT sum(requests) n FROM (SELECT window, tenant_id, max(requests) requests "
                      "FROM metrics_out GROUP BY ALL)").first()["n"]
    assert total == req.count()


def test_execution_stream_equals_batch(spark):
    from agentlake.operators import execution as X
    from agentlake.plans.execution import recorded
    from agentlake.streaming.stateful import execution_stream
    rows = recorded(spark, SF)
    d, src = _stage(spark, rows, 4, "at_sec")
    s = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = (execution_stream(s).writeStream.format("memory").queryName("exec_out")
         .option("checkpointLocation", os.path.join(d, "ckpt")).outputMode("append")
         .trigger(availableNow=True).start())
    q.awaitTermination(300)
    cols = ["event_id", "kind", "at_sec", "version", "outcome", "decision"]
    got = sorted(map(str, spark.sql("SELECT * FROM exec_out").select(*cols).collect()))
    want = sorted(map(str, X.replay(rows).select(*cols).collect()))
    assert got == want and any("fenced_stale" in w for w in want)


def test_cache_and_rate_streams_equal_batch(spark):
    from agentlake.plans.similarity import exact_cache_replay
    from agentlake.plans.windows import rate_capacity, rate_limit
    from agentlake.streaming.stateful import cache_replay_stream, rate_limit_stream
    log = V.cache_log(spark, SF)
    d, src = _stage(spark, log, 3, "sec")
    s = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = (cache_replay_stream(s).writeStream.format("memory").queryName("cache_out")
         .option("checkpointLocation", os.path.join(d, "ckpt")).outputMode("append")
         .trigger(availableNow=True).start())
    q.awaitTermination(300)
    got = {r["doc_id"]: (r["hit"], r["served_from"]) for r in spark.sql("SELECT * FROM cache_out").collect()}
    want = {r["doc_id"]: (r["hit"], r["served_from"]) for r in exact_cache_replay(spark, SF).collect()}
    assert got == want

    req = rate_capacity(spark, V.requests(spark, SF).select("event_id", "tenant_id", "model", "sec"))
    d2, src2 = _stage(spark, req, 3, "sec")
    s2 = spark.readStream.schema(req.schema).option("maxFilesPerTrigger", 1).parquet(src2)
    q2 = (rate_limit_stream(s2).writeStream.format("memory").queryName("rate_out")
          .option("checkpointLocation", os.path.join(d2, "ckpt")).outputMode("append")
          .trigger(availableNow=True).start())
    q2.awaitTermination(300)
    got2 = {r["event_id"]: r["blocked"] for r in spark.sql("SELECT * FROM rate_out").collect()}
    want2 = {r["event_id"]: r["blocked"] for r in rate_limit(spark, SF).collect()}
    assert got2 == want2

    from agentlake.plans.governance import token_bucket
    from agentlake.streaming.stateful import token_bucket_stream
    d3, src3 = _stage(spark, req, 3, "sec")
    s3 = spark.readStream.schema(req.schema).option("maxFilesPerTrigger", 1).parquet(src3)
    q3 = (token_bucket_stream(s3).writeStream.format("memory").queryName("bucket_out")
          .option("checkpointLocation", os.path.join(d3, "ckpt")).outputMode("append").trigger(availableNow=True).start())
    q3.awaitTermination(300)
    rows = lambda df: {r["event_id"]: (r["allowed"], round(r["tokens_left"], 6)) for r in df.collect()}
    assert rows(spark.sql("SELECT * FROM bucket_out")) == rows(token_bucket(spark, SF))


def test_late_completions_are_set_aside(spark, tmp_path):
    from agentlake.operators import execution as X
    from agentlake.streaming.stateful import execution_stream, split_late
    cols = "idempotency_key string, event_id long, kind string, at_sec long, version long, outcome string, read_only boolean, ledger string"
    batches = [[("a", 1, "claim", 0, None, None, False, None), ("b", 2, "claim", 5, None, None, False, None)],
               [("c", 3, "claim", 100, None, None, False, None), ("b", 4, "completion", 101, 1, "success", None, None)],
               [("a", 5, "completion", 20, 1, "success", None, None), ("a", 6, "claim", 21, None, None, False, None), ("c", 7, "completion", 99, 1, "success", None, None)]]
    sink = split_late(str(tmp_path), 30)
    for epoch, rows in [*enumerate(batches), (1, batches[1]), (2, batches[2])]:  # the last two run again
        sink(spark.createDataFrame(rows, cols), epoch)
    ids = lambda name: sorted(r["event_id"] for r in spark.read.parquet(f"{tmp_path}/{name}").collect())
    assert ids("fenced") == [5] and ids("late") == [6] and ids("ontime") == [1, 2, 3, 4, 7]
    assert spark.read.parquet(f"{tmp_path}/fenced").first()["decision"] == "fenced_late"
    schema = spark.read.schema(cols).parquet(f"{tmp_path}/ontime").schema
    s = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 100).parquet(f"{tmp_path}/ontime")
    q = execution_stream(s).writeStream.format("memory").queryName("late_out").option("checkpointLocation", f"{tmp_path}/ckpt").trigger(availableNow=True).start()
    q.awaitTermination(300)
    got = {r["event_id"]: r["decision"] for r in spark.sql("SELECT * FROM late_out").collect()}
    kept = [r for rows in batches for r in rows if r[1] not in (5, 6)]
    assert got == {r["event_id"]: r["decision"] for r in X.replay(spark.createDataFrame(kept, cols)).collect()}


def test_burn_rate_stream(spark):
    from agentlake.plans.governance import _priced, burn_rate, effective_config
    from agentlake.streaming.stateful import burn_rate_stream
    p = effective_config(spark, _priced(spark, SF).select("session_id", "tenant_id", "sec", "event_id", "cost_usd"))
    p = p.select("session_id", "sec", "event_id", "cost_usd", F.when(F.col("event_id") % 2 >= 0, 0.002).otherwise(F.col("burn_rate_limit")).alias("burn_rate_limit"))
    d, src = _stage(spark, p, 3, "sec")
    s = spark.readStream.schema(p.schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = (burn_rate_stream(s).writeStream.format("memory").queryName("burn_out").option("checkpointLocation", os.path.join(d, "ckpt"))
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination(300)
    got = [(r["session_id"], r["minute"]) for r in spark.sql("SELECT * FROM burn_out").collect()]
    want = [(r["session_id"], r["minute"]) for r in burn_rate(spark, SF).where("spend > 0.002").collect()]
    assert sorted(got) == sorted(want) and got


def test_semantic_replay_sink(spark, tmp_path):
    from agentlake.operators.similarity import nearest
    from agentlake.plans.similarity import _entries_probes
    from agentlake.streaming.stateful import semantic_replay_batch
    entries, probes = _entries_probes(spark, SF)
    sink = semantic_replay_batch(entries, str(tmp_path))
    for epoch in (0, 1, 1):
        sink(probes.where(F.col("probe_id") % 2 == epoch), epoch)
    got = sorted((r["probe_id"], r["vec_id"], round(r["distance"], 9)) for r in spark.read.parquet(str(tmp_path)).collect())
    assert got == sorted((r["probe_id"], r["vec_id"], round(r["distance"], 9)) for r in nearest(probes, entries).collect()) and got


def test_breaker_budget_and_split_streams(spark):
    from agentlake.operators.ordered import islands
    from agentlake.plans.governance import _priced
    from agentlake.sources.telemetry import telemetry
    from agentlake.streaming.stateful import breaker_stream, budget_stream, telemetry_split_batch
    f = (V.requests(spark, SF).filter("status IN (429, 503)")
         .select("tenant_id", F.col("api_key_alias").alias("key_alias"), "sec"))
    d, src = _stage(spark, f, 3, "sec")
    s = spark.readStream.schema(f.schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = (breaker_stream(s).writeStream.format("memory").queryName("breaker_out")
         .option("checkpointLocation", os.path.join(d, "ckpt")).outputMode("append")
         .trigger(availableNow=True).start())
    q.awaitTermination(300)
    opens = [r["open_sec"] for r in spark.sql("SELECT * FROM breaker_out WHERE event = 'open'").collect()]
    want = islands(f, ["tenant_id", "key_alias"], "sec", 60).collect()
    assert sorted(opens) == sorted(r["open_sec"] for r in want) and opens
    closes = [tuple(r) for r in spark.sql("SELECT open_sec, close_sec, failures FROM breaker_out WHERE event = 'close'").collect()]
    assert closes and not set(closes) - {(r["open_sec"], r["close_sec"], r["events"]) for r in want}  # intervals still open at the end are not closed

    p = _priced(spark, SF).select(F.col("tenant_id").alias("scope"), "sec", "event_id", "cost_usd")
    d2, src2 = _stage(spark, p, 2, "sec")
    s2 = spark.readStream.schema(p.schema).parquet(src2)
    q2 = (budget_stream(s2, {f"t-{i}": "0.05" for i in range(7)}).writeStream.format("memory")
          .queryName("budget_out").option("checkpointLocation", os.path.join(d2, "ckpt"))
          .outputMode("append").trigger(availableNow=True).start())
    q2.awaitTermination(300)
    rows = spark.sql("SELECT scope, alert, count(*) c FROM budget_out GROUP BY ALL").collect()
    assert rows and all(r["c"] == 1 for r in rows)   # each threshold fires once per scope
    # t-7 has no limit: its costs go by without an alert or an error
    assert "t-7" not in {r["scope"] for r in rows}

    t = telemetry(spark, SF)
    d3, src3 = _stage(spark, t, 2)
    s3 = spark.readStream.schema(t.schema).parquet(src3)
    q3 = (s3.writeStream.foreachBatch(telemetry_split_batch(os.path.join(d3, "out")))
          .option("checkpointLocation", os.path.join(d3, "ckpt")).trigger(availableNow=True).start())
    q3.awaitTermination(300)
    from agentlake.plans.telemetry import classify, latest_trace
    from agentlake.streaming.stateful import latest_traces
    out = os.path.join(d3, "out")
    want3 = {r["kind"]: r["count"] for r in classify(t).groupBy("kind").count().collect()}
    seen = lambda: {r["kind"]: r["count"] for r in spark.read.parquet(f"{out}/events").groupBy("kind").count().collect()}
    assert len(want3) >= 3 and seen() == want3
    # an epoch that runs again leaves everything as it was
    first = spark.read.schema(t.schema).parquet(src3)
    telemetry_split_batch(out + "2")(first, 0)
    telemetry_split_batch(out + "2")(first, 0)
    assert {r["kind"]: r["count"] for r in spark.read.parquet(f"{out}2/events").groupBy("kind").count().collect()} == want3
    cols = ["trace_key", "kind", "versions", "executed_provider"]
    key = lambda df: sorted(map(str, df.select(*cols).collect()))
    assert key(latest_traces(spark, out)) == key(latest_trace(spark, SF))
    # with snapshots: a read takes the newest one and the epochs after it, and a replay changes nothing
    from agentlake.streaming.stateful import _latest_rows
    sink = telemetry_split_batch(out + "3", compact_every=2)
    for epoch in (0, 1, 2, 3, 4, 3, 4):
        sink(first.where(F.col("seq") % 5 == epoch), epoch)
    assert key(latest_traces(spark, out + "3")) == key(latest_trace(spark, SF))
    read = {"/".join(f.split("/")[-3:-1]) for f in _latest_rows(spark, out + "3").inputFiles()}
    assert read == {"snapshot/epoch=3", "latest/epoch=4"}


def test_reassembly_and_latency_streams(spark):
    from agentlake.plans.streams_batch import reassemble_stream
    from agentlake.sources.chunks import chunks
    from agentlake.streaming.stateful import latency_ema_stream, reassembly_stream
    ch = chunks(spark, SF)
    d, src = _stage(spark, ch, 2)
    s = spark.readStream.schema(ch.schema).parquet(src)
    q = (reassembly_stream(s).writeStream.format("memory").queryName("reasm_out")
         .option("checkpointLocation", os.path.join(d, "ckpt")).outputMode("append")
         .trigger(availableNow=True).start())
    q.awaitTermination(300)
    got = {r["stream_id"]: (r["text"], r["total_tokens"]) for r in spark.sql("SELECT * FROM reasm_out").collect()}
    want = {r["stream_id"]: (r["text"], r["total_tokens"]) for r in reassemble_stream(spark, SF).collect()}
    # the last session windows close only once the watermark passes them
    assert got and all(want[k] == v for k, v in got.items())

    req = V.requests(spark, SF).select("sec", "status", "executed_provider", "latency_ms")
    d2, src2 = _stage(spark, req, 3, "sec")
    s2 = spark.readStream.schema(req.schema).option("maxFilesPerTrigger", 1).parquet(src2)
    from agentlake.streaming.stateful import latency_p95_stream
    ticks_dir = os.path.join(d2, "ticks")
    q2 = (latency_p95_stream(s2).writeStream.format("parquet").option("path", ticks_dir)
          .option("checkpointLocation", os.path.join(d2, "ckpt1")).outputMode("append")
          .trigger(availableNow=True).start())
    q2.awaitTermination(300)
    ticks = spark.read.parquet(ticks_dir)
    q3 = (latency_ema_stream(spark.readStream.schema(ticks.schema).parquet(ticks_dir)).writeStream
          .format("memory").queryName("ema_out").option("checkpointLocation", os.path.join(d2, "ckpt2"))
          .outputMode("append").trigger(availableNow=True).start())
    q3.awaitTermination(300)
    got = sorted((r["provider"], r["tick"], round(r["p95"], 6), round(r["ema"], 6)) for r in spark.sql("SELECT * FROM ema_out").collect())
    from agentlake.operators.ordered import ema
    from agentlake.streaming.stateful import EPOCH, latency_ranking_stream, ranking_by_tick
    flat = ticks.select("provider", (F.unix_seconds("window.start") - EPOCH).alias("tick"), "p95")
    folded = ema(flat, ["provider"], "tick", "p95", 0.3)
    assert got == sorted((r["provider"], r["tick"], round(r["p95"], 6), round(r["ema"], 6)) for r in folded.collect()) and len(got) > 50

    # ranking: a provider leaves it 30 s after its last tick
    sparse = ticks.where((F.col("provider") != "openai") | ((F.unix_seconds("window.start") / 10).cast("long") % 7 == 0))
    d4, src4 = _stage(spark, sparse.withColumn("o", F.unix_seconds("window.start")), 3, "o")
    s4 = spark.readStream.schema(spark.read.parquet(src4).schema).option("maxFilesPerTrigger", 1).parquet(src4)
    q4 = (latency_ranking_stream(s4).writeStream.format("memory").queryName("ranking_out").option("checkpointLocation", os.path.join(d4, "ckpt"))
          .outputMode("append").trigger(availableNow=True).start())
    q4.awaitTermination(300)
    flat = sparse.select("provider", (F.unix_seconds("window.start") - EPOCH).alias("tick"), "p95")
    rows = lambda df: sorted((r["tick"], r["rank"], r["provider"], round(r["ema"], 6), r["last_tick"]) for r in df.collect())
    want4 = rows(ranking_by_tick(ema(flat, ["provider"], "tick", "p95", 0.3)))
    assert rows(spark.sql("SELECT * FROM ranking_out")) == want4
    by_tick = {}
    for r in want4:
        by_tick.setdefault(r[0], set()).add(r[2])
    assert any("openai" in p for p in by_tick.values()) and any("openai" not in p for p in by_tick.values())


def test_dedup_and_sessions_streams(spark):
    from agentlake.streaming.drivers import dedup_stream, sessions_stream
    a = V.attempts(spark, SF).select("idempotency_key", "event_id", F.col("claim_sec").alias("sec"))
    d, src = _stage(spark, a, 3, "sec")
    s = spark.readStream.schema(a.schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = (dedup_stream(s).writeStream.format("memory").queryName("dedup_out")
         .option("checkpointLocation", os.path.join(d, "ckpt")).outputMode("append")
         .trigger(availableNow=True).start())
    q.awaitTermination(300)
    got = spark.sql("SELECT idempotency_key, count(*) c FROM dedup_out GROUP BY 1").collect()
    # six claims per key, 4 s apart, inside the 300 s window: exactly one survives per key
    assert all(r["c"] == 1 for r in got) and len(got) == a.select("idempotency_key").distinct().count()

    g = V.guard_calls(spark, SF).select("session_id", "sec", "tool_name")
    d2, src2 = _stage(spark, g, 3, "sec")
    s2 = spark.readStream.schema(g.schema).option("maxFilesPerTrigger", 1).parquet(src2)
    q2 = (sessions_stream(s2).writeStream.format("memory").queryName("sess_out")
          .option("checkpointLocation", os.path.join(d2, "ckpt")).outputMode("append")
          .trigger(availableNow=True).start())
    q2.awaitTermination(300)
    from agentlake.streaming.drivers import with_event_time
    batch = (with_event_time(g).groupBy(F.session_window("event_time", "60 seconds"), "session_id")
             .agg(F.count(F.lit(1)).alias("calls")))
    want = {(r["session_id"], r["session_window"]["start"]): r["calls"] for r in batch.collect()}
    got2 = {(r["session_id"], r["session_window"]["start"]): r["calls"]
            for r in spark.sql("SELECT * FROM sess_out").collect()}
    # sessions still open when the stream ends are not emitted yet (append mode)
    assert got2 and all(want[k] == v for k, v in got2.items())
