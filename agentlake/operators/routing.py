"""Route resolution and target health.

Routing config is operator-typed (tenants x models x targets), so it is
broadcast; traffic never is. The breaker anti-join is an interval join done
on time bins: each interval is exploded into the 60 s bins it covers, the
request side joins on (tenant, key alias, bin) and filters the exact range —
a request meets only the intervals of its own bin, never every interval of
its key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agentlake.functions.classify import family_default, is_retryable_status
from agentlake.operators.dims import bounded
from agentlake.operators.ordered import islands
from agentlake.sources import dimensions as D

BREAKER_TTL_SEC = 60  # fixed value: breaker stays open 60 s after the last failure


def routing(spark) -> DataFrame:
    return bounded(D.routing_df(spark))


def resolve(spark, requests: DataFrame) -> DataFrame:
    """map_tenant, route_model, n_targets, route_status per request."""
    rt = D.routing_df(spark)
    tenants = bounded(rt.select(F.col("tenant_id").alias("_rt_tenant")).distinct())
    routes = rt.groupBy("tenant_id", "model").agg(F.count("position").alias("n_targets"))
    r = (requests.join(tenants, F.col("tenant_id") == F.col("_rt_tenant"), "left")
         .withColumn("map_tenant", F.when(F.col("_rt_tenant").isNotNull(), F.col("tenant_id"))
                     .otherwise(F.lit(D.ZERO_TENANT)))
         .drop("_rt_tenant"))
    exact = bounded(routes.select(F.col("tenant_id").alias("_et"), F.col("model").alias("_em"),
                                  F.col("n_targets").alias("_en")))
    fam = bounded(routes.select(F.col("tenant_id").alias("_ft"), F.col("model").alias("_fm"),
                                F.col("n_targets").alias("_fn")))
    r = r.join(exact, (F.col("map_tenant") == F.col("_et")) & (F.col("model") == F.col("_em")), "left")
    r = r.withColumn("_fam", family_default(F.col("model")))
    r = r.join(fam, (F.col("map_tenant") == F.col("_ft")) & (F.col("_fam") == F.col("_fm")), "left")
    route_model = F.when(F.col("_em").isNotNull(), F.col("_em")).otherwise(F.col("_fm"))
    n_targets = F.when(F.col("_em").isNotNull(), F.col("_en")).otherwise(F.col("_fn"))
    r = r.withColumn("route_model", route_model).withColumn("n_targets", n_targets)
    status = (F.when(F.col("route_model").isNull(), "MODEL_NOT_CONFIGURED")
              .when(F.col("n_targets") == 0, "ALL_KEYS_EXHAUSTED").otherwise("ok"))
    return r.withColumn("route_status", status).drop("_et", "_em", "_en", "_ft", "_fm", "_fn", "_fam")


def candidates(spark, resolved: DataFrame) -> DataFrame:
    """One row per (request, configured target), with the target's rank by (priority, position)."""
    rt = routing(spark).filter(F.col("position").isNotNull()).select(
        F.col("tenant_id").alias("_t"), F.col("model").alias("_m"), "position", "priority",
        "provider_name", "key_alias", "target_model", "schema_format")
    return resolved.join(rt, (F.col("map_tenant") == F.col("_t")) & (F.col("route_model") == F.col("_m")),
                         "inner").drop("_t", "_m")


def route_targets(spark) -> DataFrame:
    """(tenant, model) -> array of its targets by (priority, position): configuration only."""
    t = F.struct("priority", "position", "key_alias", "provider_name", "target_model", "schema_format")
    rt = D.routing_df(spark).filter(F.col("position").isNotNull())
    return bounded(rt.groupBy(F.col("tenant_id").alias("_t"), F.col("model").alias("_m")).agg(F.array_sort(F.collect_list(t)).alias("targets")))


def with_targets(spark, resolved: DataFrame) -> DataFrame:
    """Requests of configured routes with the route's target array: one join, no row per target."""
    return resolved.join(route_targets(spark), (F.col("map_tenant") == F.col("_t")) & (F.col("route_model") == F.col("_m"))).drop("_t", "_m")


def breaker_intervals(spark, resolved: DataFrame) -> DataFrame:
    """W11 over the routed keys: a retryable failure opens the breaker of the
    request's first-priority target key for 60 s, re-armed by further failures."""
    failed = with_targets(spark, resolved.filter(is_retryable_status(F.col("status"))))
    first = failed.select("tenant_id", F.col("targets")[0]["key_alias"].alias("key_alias"), "sec")
    return islands(first, ["tenant_id", "key_alias"], "sec", BREAKER_TTL_SEC)


def healthy(spark, resolved: DataFrame) -> DataFrame:
    """Requests with ``targets`` (configured) and ``healthy``: those whose
    (tenant, key alias) breaker is not open at the request time (opened strictly
    before it and not yet closed), in order.

    The intervals that touch a minute of a tenant are one small array (a key has
    at most two in a minute), so requests join it once by (tenant, minute) and
    pick their targets by array functions: no row per target, no window."""
    width = BREAKER_TTL_SEC
    iv = breaker_intervals(spark, resolved)
    minute = F.explode(F.sequence(F.floor(F.col("open_sec") / width), F.floor(F.col("close_sec") / width)))
    open_ = (iv.select(F.col("tenant_id").alias("_it"), minute.alias("_ibin"), F.struct("key_alias", "open_sec", "close_sec").alias("i"))
             .groupBy("_it", "_ibin").agg(F.collect_list("i").alias("_open")))
    r = with_targets(spark, resolved).withColumn("_bin", F.floor(F.col("sec") / width))
    r = r.join(open_, (F.col("tenant_id") == F.col("_it")) & (F.col("_bin") == F.col("_ibin")), "left")
    shut = lambda t: F.exists(F.col("_open"), lambda i: (i["key_alias"] == t["key_alias"]) & (i["open_sec"] < F.col("sec")) & (F.col("sec") < i["close_sec"]))
    ok = F.when(F.col("_open").isNull(), F.col("targets")).otherwise(F.filter("targets", lambda t: ~shut(t)))
    return r.withColumn("healthy", ok).drop("_bin", "_it", "_ibin", "_open")
