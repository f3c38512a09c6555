"""Plan shape invariants for every registered query: no cartesian product, no
nested-loop join, no window without a partition key (global aggregates may end
in a single partition after map-side partial aggregation)."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tools.plan_audit import audit, shapes


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_unscalable_plan_shapes(spark):
    found = audit(spark, "/root/testdata/sf0.001")
    bad = {k: [h for h in v if h != "single_partition"] for k, v in found.items()}
    bad = {k: v for k, v in bad.items() if v}
    assert not bad, bad


def test_the_audit_sees_what_it_is_for(spark):
    df = spark.range(100).withColumn("k", F.col("id") % 3)
    for spec in (Window.orderBy("id"), Window.partitionBy(F.lit(0)).orderBy("id")):
        assert "global_window" in shapes(plan(df.withColumn("r", F.row_number().over(spec))))
    assert "global_window" not in shapes(plan(df.withColumn("r", F.row_number().over(Window.partitionBy("k").orderBy("id")))))
    assert "cartesian" in shapes(plan(df.crossJoin(df.hint("shuffle_replicate_nl")))) or "nested_loop" in shapes(plan(df.crossJoin(df)))


def test_payloads_are_read_once(spark):
    from agentlake.plans.registry import load_all
    for key in ("registered_tools", "unregistered_calls", "policy_check", "unify_tool_call", "tools_intersect"):
        p = plan(load_all()[key].build(spark, "/root/testdata/sf0.001"))
        assert p.count("conversations.parquet") <= plan(load_all()["request_tool_calls"].build(spark, "/root/testdata/sf0.001")).count("conversations.parquet"), key


def test_routing_has_no_window_by_event(spark):
    from agentlake.plans.registry import load_all
    for key in ("healthy_targets", "breaker_open_skips", "failover_chain"):
        p = plan(load_all()[key].build(spark, "/root/testdata/sf0.001"))
        assert "partitionBy" not in p and "hashpartitioning(event_id" not in p, key
