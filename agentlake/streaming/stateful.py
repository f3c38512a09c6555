"""Keyed stateful streaming operators.

Every operator is ``groupBy(key).applyInPandasWithState`` with a JSON state
string, event-time timeouts and a watermark, and reuses the batch step
functions. Rows of a key inside one micro-batch arrive unordered, so each
handler sorts them by (event time, tiebreak) before applying (T11).
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from agentlake.operators import execution as X
from agentlake.streaming.drivers import with_event_time

EPOCH = 1704067200
STATE = "s string"


def _ms(sec: int) -> int:
    return (int(sec) + EPOCH) * 1000


def _timeout(state: GroupState, sec: int):
    state.setTimeoutTimestamp(max(_ms(sec), state.getCurrentWatermarkMs() + 1))


# ------------------------------------------------------------------ R2 / R9 execution state machine

_EXEC_OUT = "event_id long, idempotency_key string, kind string, at_sec long, version long, outcome string, decision string"


def _exec_func(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    rows: list = []
    if state.hasTimedOut:  # an entry TTL without a row: the key is forgotten
        state.remove()
    else:
        entry = X.ExecutionFold(state.get[0] if state.exists else "")
        data = pd.concat(list(pdfs))
        data = data.assign(_o=(data["kind"] == "claim").astype(int)).sort_values(["at_sec", "_o", "event_id"])
        for r in data.itertuples():
            own = None if pd.isna(r.version) else int(r.version)
            decision, decided = entry.step(r.kind, r.at_sec, own, r.outcome, None if pd.isna(r.read_only) else r.read_only, r.ledger)
            rows.append((int(r.event_id), key[0], r.kind, int(r.at_sec), decided if own is None else own, r.outcome, decision))
        state.update((entry.dump(),))
        _timeout(state, entry.now + X.ENTRY_TTL_SEC)
    yield pd.DataFrame(rows, columns=["event_id", "idempotency_key", "kind", "at_sec", "version", "outcome", "decision"])


def execution_stream(log: DataFrame, watermark: str = "30 seconds") -> DataFrame:
    """Recorded claims and completions (``operators.execution.log``), late
    ones among them, judged per idempotency key by the batch fold; a completion of
    another version than the entry's is fenced. The state is five values a key and is
    removed an entry TTL after its last row."""
    return (with_event_time(log, "at_sec").withWatermark("event_time", watermark)
            .groupBy("idempotency_key")
            .applyInPandasWithState(_exec_func, _EXEC_OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout))


def _epochs(spark, folder: str) -> list[int]:
    """Epochs that have a finished folder ``epoch=N`` under a path (any file system)."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(conf)
    if not fs.exists(path):
        return []
    dirs = [f.getPath() for f in fs.listStatus(path) if f.getPath().getName().startswith("epoch=")]
    return sorted(int(d.getName().split("=")[1]) for d in dirs if fs.exists(jvm.org.apache.hadoop.fs.Path(d, "_SUCCESS")))


def split_late(out_dir: str, delay_sec: int = 30, ts: str = "at_sec"):
    """A ``foreachBatch`` sink that parts a log by a watermark of its own, ``delay_sec``
    behind the latest event of the epochs before. Rows in time go to ``ontime``, from where
    :func:`execution_stream` reads; completions behind it, which a stateful operator would
    drop without a word, go to ``fenced`` with that decision, other late rows to ``late``.
    All folders belong to an epoch, so a batch that runs again changes nothing."""
    def sink(batch: DataFrame, epoch: int):
        spark = batch.sparkSession
        before = [e for e in _epochs(spark, f"{out_dir}/marks") if e < epoch]
        seen = spark.read.parquet(f"{out_dir}/marks/epoch={before[-1]}").first()["latest"] if before else None
        rows = batch.persist()
        try:
            late = F.col(ts) < (F.lit(seen) - delay_sec if seen is not None else F.lit(None).cast("long"))
            late = F.coalesce(late, F.lit(False))
            done = F.col("kind") == "completion"
            for name, part in (("ontime", rows.where(~late)), ("fenced", rows.where(late & done).withColumn("decision", F.lit("fenced_late"))), ("late", rows.where(late & ~done))):
                part.write.mode("overwrite").parquet(f"{out_dir}/{name}/epoch={epoch}")
            latest = F.greatest(F.max(ts), F.lit(seen).cast("long"))
            rows.agg(latest.alias("latest")).coalesce(1).write.mode("overwrite").parquet(f"{out_dir}/marks/epoch={epoch}")
        finally:
            rows.unpersist()
    return sink


# ------------------------------------------------------------------ R13 cache replay

def _cache_func(ttl: int):
    def func(key, pdfs, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        d = json.loads(state.get[0]) if state.exists else None
        data = pd.concat(list(pdfs)).sort_values(["sec", "doc_id"])
        out = []
        for doc, sec, pii in zip(data["doc_id"], data["sec"], data["pii"]):
            sec = int(sec)
            if pii:
                out.append((int(doc), False, None))
                continue
            if d is not None and sec - d["last"] < ttl:
                out.append((int(doc), True, d["first"]))
                d["last"] = sec
            else:
                d = {"first": int(doc), "last": sec}
                out.append((int(doc), False, None))
        if d is not None:
            state.update((json.dumps(d),))
            _timeout(state, d["last"] + ttl)
        yield pd.DataFrame(out, columns=["doc_id", "hit", "served_from"])
    return func


def cache_replay_stream(log: DataFrame, ttl: int = 3600, watermark: str = "10 minutes") -> DataFrame:
    """Hit / miss per request, keyed by (tenant, body hash), idle TTL refreshed by hits."""
    from agentlake.functions.pii import has_pii
    c = log.select("doc_id", "tenant_id", "sec", F.sha2("body", 256).alias("h"), has_pii(F.col("body")).alias("pii"))
    return (with_event_time(c).withWatermark("event_time", watermark).groupBy("tenant_id", "h")
            .applyInPandasWithState(_cache_func(ttl), "doc_id long, hit boolean, served_from long", STATE, "append",
                                    GroupStateTimeout.EventTimeTimeout))


def semantic_replay_batch(entries: DataFrame, out_dir: str, **search):
    """R13, the semantic half: a ``foreachBatch`` sink that meets the micro-batch's probes with
    the stored entries (``operators.similarity.nearest``, the search of J5) and writes
    probe_id, vec_id, distance of its hits to the folder of its epoch."""
    from agentlake.operators.similarity import nearest

    def sink(batch: DataFrame, epoch: int):
        nearest(batch, entries, **search).write.mode("overwrite").parquet(f"{out_dir}/epoch={epoch}")
    return sink


# ------------------------------------------------------------------ R4 rate limits

def _rate_func(key, pdfs, state: GroupState):
    if state.hasTimedOut:
        state.remove()
        return
    d = json.loads(state.get[0]) if state.exists else {"window": None, "n": 0}
    data = pd.concat(list(pdfs)).sort_values(["sec", "event_id"])
    out = []
    for ev, sec, cap in zip(data["event_id"], data["sec"], data["capacity"]):
        w = int(sec) // 60
        if d["window"] != w:
            d = {"window": w, "n": 0}
        d["n"] += 1
        out.append((int(ev), d["n"], bool(int(cap) > 0 and d["n"] > int(cap))))
    state.update((json.dumps(d),))
    _timeout(state, (d["window"] + 1) * 60)
    yield pd.DataFrame(out, columns=["event_id", "n_in_window", "blocked"])


def rate_limit_stream(requests_with_capacity: DataFrame, watermark: str = "2 minutes") -> DataFrame:
    """Per (tenant, model) fixed 60 s window counter; request n > capacity blocked."""
    r = requests_with_capacity.select("event_id", "tenant_id", "model", "sec", "capacity")
    return (with_event_time(r).withWatermark("event_time", watermark).groupBy("tenant_id", "model")
            .applyInPandasWithState(_rate_func, "event_id long, n_in_window int, blocked boolean", STATE, "append",
                                    GroupStateTimeout.EventTimeTimeout))


def _fold_func(fold, key_cols: list, row_cols: list, order: list, names: list, idle: int):
    """A handler that keeps a batch fold's state text and calls its ``step``."""
    def func(key, pdfs, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        machine = fold(state.get[0] if state.exists else "")
        data = pd.concat(list(pdfs)).sort_values(order)
        out = [(*kept, *machine.step(*row)) for kept, row in zip(zip(*[data[c].tolist() for c in key_cols]), zip(*[data[c].tolist() for c in row_cols]))]
        state.update((machine.dump(),))
        _timeout(state, int(data["sec"].max()) + idle)
        yield pd.DataFrame(out, columns=names)
    return func


def token_bucket_stream(requests_with_capacity: DataFrame, watermark: str = "2 minutes") -> DataFrame:
    """R4, the bucket: the batch fold W5 per (tenant, model). A bucket without a request
    for 60 s is full again, so its state goes then."""
    from agentlake.operators.folds import BucketFold
    r = requests_with_capacity.select("event_id", "tenant_id", "model", "sec", "capacity")
    handler = _fold_func(BucketFold, ["event_id"], list(BucketFold.columns), ["sec", "event_id"], ["event_id", "allowed", "tokens_left"], 60)
    return (with_event_time(r).withWatermark("event_time", watermark).groupBy("tenant_id", "model")
            .applyInPandasWithState(handler, f"event_id long, {BucketFold.outputs}", STATE, "append", GroupStateTimeout.EventTimeTimeout))


# ------------------------------------------------------------------ R7 breaker

def _breaker_func(gap: int):
    def func(key, pdfs, state: GroupState):
        d = json.loads(state.get[0]) if state.exists else None
        if state.hasTimedOut:
            state.remove()
            if d is not None:
                yield pd.DataFrame([("close", d["open"], d["last"] + gap, d["n"])],
                                   columns=["event", "open_sec", "close_sec", "failures"])
            return
        data = pd.concat(list(pdfs)).sort_values(["sec"])
        out = []
        for sec in data["sec"]:
            sec = int(sec)
            if d is not None and sec - d["last"] >= gap:
                out.append(("close", d["open"], d["last"] + gap, d["n"]))
                d = None
            if d is None:
                d = {"open": sec, "last": sec, "n": 1}
                out.append(("open", sec, None, None))
            else:
                d["last"], d["n"] = sec, d["n"] + 1
        state.update((json.dumps(d),))
        _timeout(state, d["last"] + gap)
        yield pd.DataFrame(out, columns=["event", "open_sec", "close_sec", "failures"])
    return func


def breaker_stream(failures: DataFrame, gap: int = 60, watermark: str = "2 minutes") -> DataFrame:
    """Per (tenant, key alias) breaker; emits ``open`` at the first failure and
    ``close`` (with the merged interval) once no failure re-armed it for 60 s."""
    f = failures.select("tenant_id", "key_alias", "sec")
    return (with_event_time(f).withWatermark("event_time", watermark).groupBy("tenant_id", "key_alias")
            .applyInPandasWithState(_breaker_func(gap), "event string, open_sec long, close_sec long, failures long",
                                    STATE, "append", GroupStateTimeout.EventTimeTimeout))


# ------------------------------------------------------------------ R14 budget alerts

def _budget_func(limit_by_scope: dict):
    def func(key, pdfs, state: GroupState):
        if key[0] not in limit_by_scope:  # a scope without a limit has nothing to alert on and keeps no state
            for _ in pdfs:
                pass
            return
        d = json.loads(state.get[0]) if state.exists else {"spend": "0", "alerted": []}
        from decimal import Decimal
        spend = Decimal(d["spend"])
        data = pd.concat(list(pdfs)).sort_values(["sec", "event_id"])
        limit = Decimal(limit_by_scope[key[0]])
        out = []
        for ev, cost in zip(data["event_id"], data["cost_usd"]):
            spend += Decimal(str(cost))
            for name, frac in (("alert_80", Decimal("0.8")), ("alert_100", Decimal("1"))):
                if name not in d["alerted"] and spend >= limit * frac:
                    d["alerted"].append(name)
                    out.append((key[0], name, int(ev), str(spend)))
        d["spend"] = str(spend)
        state.update((json.dumps(d),))
        yield pd.DataFrame(out, columns=["scope", "alert", "event_id", "spend"])
    return func


def budget_stream(scoped_costs: DataFrame, limit_by_scope: dict) -> DataFrame:
    """Running spend per budget scope; each threshold alerts once per scope."""
    s = scoped_costs.select("scope", "sec", "event_id", F.col("cost_usd").cast("string").alias("cost_usd"))
    return (s.groupBy("scope")
            .applyInPandasWithState(_budget_func(limit_by_scope), "scope string, alert string, event_id long, "
                                    "spend string", STATE, "append", GroupStateTimeout.NoTimeout))


def _burn_func(key, pdfs, state: GroupState):
    from decimal import Decimal
    if state.hasTimedOut:
        state.remove()
        return
    spend = {int(m): (Decimal(s), done) for m, (s, done) in json.loads(state.get[0]).items()} if state.exists else {}
    data = pd.concat(list(pdfs)).sort_values(["sec", "event_id"])
    out = []
    for sec, ev, cost, limit in zip(data["sec"], data["event_id"], data["cost_usd"], data["burn_rate_limit"]):
        minute = int(sec) // 60
        total, done = spend.get(minute, (Decimal(0), False))
        total += Decimal(str(cost))
        if not done and total > Decimal(repr(float(limit))):
            done = True
            out.append((key[0], minute, int(ev), str(total)))
        spend[minute] = total, done
    newest = max(spend)
    # a minute that the watermark has passed gets no more rows
    old = state.getCurrentWatermarkMs() // 1000 - EPOCH
    spend = {m: v for m, v in spend.items() if (m + 1) * 60 > old}
    state.update((json.dumps({m: [str(s), done] for m, (s, done) in spend.items()}),))
    _timeout(state, (newest + 1) * 60)
    yield pd.DataFrame(out, columns=["session_id", "minute", "event_id", "spend"])


def burn_rate_stream(costs: DataFrame, watermark: str = "2 minutes") -> DataFrame:
    """R14, burn rate: session_id, sec, event_id, cost_usd, burn_rate_limit -> one alert for
    each session and minute whose spend passes the limit, at the request that does it."""
    c = costs.select("session_id", "sec", "event_id", F.col("cost_usd").cast("string").alias("cost_usd"), "burn_rate_limit")
    return (with_event_time(c).withWatermark("event_time", watermark).groupBy("session_id")
            .applyInPandasWithState(_burn_func, "session_id string, minute long, event_id long, spend string", STATE, "append", GroupStateTimeout.EventTimeTimeout))


# ------------------------------------------------------------------ R10, R11 via foreachBatch

def telemetry_split_batch(out_dir: str, compact_every: int = 16):
    """A ``foreachBatch`` sink that parses the micro-batch once and writes
    every event kind, known or not, to its partition (S3), and the batch's latest
    row of each trace key (S4). Both go to a folder of the epoch that is
    overwritten, so a batch that runs again after a failure changes nothing. Every
    ``compact_every`` epochs the latest rows so far are written as a snapshot, which
    takes in the snapshot before and the epochs since; :func:`latest_traces` reads the
    newest one and what came after it, so a read costs the live keys and a few epochs."""
    def sink(batch: DataFrame, epoch: int):
        from agentlake.plans.telemetry import classify, latest_by_key
        c = classify(batch).persist()
        try:
            (c.select("seq", F.to_json("v").alias("json"), "kind").write.mode("overwrite").partitionBy("kind")
             .parquet(f"{out_dir}/events/epoch={epoch}"))
            latest_by_key(c).write.mode("overwrite").parquet(f"{out_dir}/latest/epoch={epoch}")
        finally:
            c.unpersist()
        if (epoch + 1) % compact_every == 0:
            _newest(_latest_rows(batch.sparkSession, out_dir, epoch)).write.mode("overwrite").parquet(f"{out_dir}/snapshot/epoch={epoch}")
    return sink


def _latest_rows(spark, out_dir: str, upto: int | None = None) -> DataFrame:
    """The newest snapshot before epoch ``upto`` and the epochs after it, up to that."""
    shots = [e for e in _epochs(spark, f"{out_dir}/snapshot") if upto is None or e < upto]
    start = shots[-1] if shots else -1
    parts = [f"{out_dir}/snapshot/epoch={start}"] if shots else []
    parts += [f"{out_dir}/latest/epoch={e}" for e in _epochs(spark, f"{out_dir}/latest") if e > start and (upto is None or e <= upto)]
    return spark.read.parquet(*parts)


def _newest(rows: DataFrame) -> DataFrame:
    return rows.groupBy("trace_key").agg(F.max_by("kind", "o").alias("kind"), F.sum("versions").alias("versions"),
                                         F.max_by("executed_provider", "o").alias("executed_provider"), F.max("o").alias("o"))


def latest_traces(spark, out_dir: str) -> DataFrame:
    """The latest row of each trace key over all epochs written so far."""
    return _newest(_latest_rows(spark, out_dir)).drop("o")


# ------------------------------------------------------------------ R11 reassembly

def reassembly_stream(chunk_stream: DataFrame, idle: str = "30 seconds", watermark: str = "1 minute") -> DataFrame:
    """Stitch (X10) then reassemble (X9) each stream once it has been idle
    for ``idle``: an event-time session window per stream_id gathers its
    forwarded chunks (one response, bounded) and the batch fold expressions run
    on the closed window. Chunk event time = the stream's clock + seq."""
    from agentlake.functions.classify import has_error_signature
    from agentlake.operators.streams import reassemble_columns
    c = chunk_stream.withColumn("sec", F.col("stream_id") * 100 + F.col("seq"))
    c = c.filter(~(has_error_signature(F.col("data")) & (F.col("data") != "[DONE]")))
    g = (with_event_time(c).withWatermark("event_time", watermark)
         .groupBy(F.session_window("event_time", idle), "stream_id")
         .agg(F.collect_list(F.struct("seq", "data")).alias("cs"), F.max("prompt_bytes").alias("prompt_bytes")))
    return g.select("stream_id", *reassemble_columns(F.array_sort("cs"), F.col("prompt_bytes")))


# ------------------------------------------------------------------ R5 latency EMA

def _ema_func(alpha: float):
    def func(key, pdfs, state: GroupState):
        prev = float(state.get[0]) if state.exists else None
        data = pd.concat(list(pdfs)).sort_values("tick")
        out = []
        for tick, p95 in zip(data["tick"], data["p95"]):
            prev = float(p95) if prev is None else alpha * float(p95) + (1 - alpha) * prev
            out.append((key[0], int(tick), float(p95), prev))
        state.update((str(prev),))
        yield pd.DataFrame(out, columns=["provider", "tick", "p95", "ema"])
    return func


def latency_p95_stream(requests: DataFrame, tick: str = "10 seconds", watermark: str = "2 minutes") -> DataFrame:
    """R5 (first stage): per-provider p95 of successful latency in tumbling event-time ticks."""
    r = requests.filter((F.col("status") == 200) & (F.col("executed_provider") != ""))
    return (with_event_time(r).withWatermark("event_time", watermark)
            .groupBy(F.window("event_time", tick), F.col("executed_provider").alias("provider"))
            .agg(F.percentile_approx("latency_ms", 0.95, 10000).cast("double").alias("p95")))


def latency_ema_stream(ticks: DataFrame, alpha: float = 0.3) -> DataFrame:
    """R5 (second query): closed p95 ticks, read as a stream from the sink the
    first query (``latency_p95_stream``) appends to, folded into the EMA with
    state per provider. Spark allows no stateful operator after a streaming
    aggregation in one query, so the two stages are chained through storage;
    the state here is one double per provider."""
    t = ticks.select(F.col("provider"), (F.unix_seconds(F.col("window.start")) - EPOCH).alias("tick"), "p95")
    return (t.groupBy("provider")
            .applyInPandasWithState(_ema_func(alpha), "provider string, tick long, p95 double, ema double",
                                    STATE, "append", GroupStateTimeout.NoTimeout))


#: Seconds after its last tick for which a provider is ranked.
RANKED_SEC = 30


def _ranking_func(alpha: float):
    def func(key, pdfs, state: GroupState):
        last = {p: tuple(x) for p, x in json.loads(state.get[0]).items()} if state.exists else {}
        data = pd.concat(list(pdfs)).sort_values(["tick", "provider"])
        out = []
        for tick, rows in data.groupby("tick"):
            for provider, p95 in zip(rows["provider"], rows["p95"]):
                before = last[provider][0] if provider in last else float(p95)
                last[provider] = (alpha * float(p95) + (1 - alpha) * before, int(tick))
            live = sorted((e, p, t) for p, (e, t) in last.items() if int(tick) - t <= RANKED_SEC)
            out += [(int(tick), i + 1, p, e, t) for i, (e, p, t) in enumerate(live)]
        state.update((json.dumps(last),))
        yield pd.DataFrame(out, columns=["tick", "rank", "provider", "ema", "last_tick"])
    return func


def latency_ranking_stream(ticks: DataFrame, alpha: float = 0.3) -> DataFrame:
    """R5 (second query, ranking): at every tick the providers seen within ``RANKED_SEC``, by
    EMA. The rows are one p95 for each provider and tick, so one key holds all providers."""
    t = ticks.select(F.lit("all").alias("scope"), "provider", (F.unix_seconds(F.col("window.start")) - EPOCH).alias("tick"), "p95")
    return (t.groupBy("scope").applyInPandasWithState(_ranking_func(alpha), "tick long, rank int, provider string, ema double, last_tick long",
                                                      STATE, "append", GroupStateTimeout.NoTimeout))


def ranking_by_tick(ema: DataFrame) -> DataFrame:
    """The batch form: provider, tick (second), ema -> tick, rank, provider, ema, last_tick."""
    bin_ = lambda c: F.floor(F.col(c) / RANKED_SEC)
    seen = ema.select("tick").distinct().withColumn("b", F.explode(F.array(bin_("tick"), bin_("tick") - 1)))
    reach = ema.select("provider", F.col("tick").alias("last_tick"), "ema", bin_("tick").alias("b"))
    live = seen.join(reach, "b").where(F.col("last_tick").between(F.col("tick") - RANKED_SEC, F.col("tick")))
    newest = live.groupBy("tick", "provider").agg(F.max_by(F.struct("ema", "last_tick"), "last_tick").alias("x")).select("tick", "provider", "x.*")
    order = F.struct("ema", "provider", "last_tick")
    # a tick has one row a provider
    ranked = newest.groupBy("tick").agg(F.array_sort(F.collect_list(order)).alias("all")).select("tick", F.posexplode("all").alias("at", "x"))
    return ranked.select("tick", (F.col("at") + 1).cast("int").alias("rank"), "x.provider", "x.ema", "x.last_tick")
