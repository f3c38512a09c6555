from pyspark.sql import functions as F

from agentlake.operators import sinks
from agentlake.plans.governance import AUDIT_COLS, audit_records, export_audit
from agentlake.sources import views as V

SF = "/root/testdata/sf0.001"


def test_silver_and_gold_by_date_and_tenant(spark, tmp_path):
    ev = V.requests(spark, SF).select("event_id", "sec", "tenant_id", "model", "total_tokens", "status")
    silver, gold = str(tmp_path / "silver"), str(tmp_path / "gold")
    for _ in range(2):  # a run again replaces its partitions
        sinks.write_silver(ev, silver)
        sinks.write_gold(ev, gold)
    back = spark.read.parquet(silver)
    assert back.select(*ev.columns).exceptAll(ev).count() == 0 and back.count() == ev.count()
    days = {str(r["date"]) for r in sinks.by_day(ev).select("date").distinct().collect()}
    assert {p.name for p in (tmp_path / "silver").iterdir() if p.is_dir()} == {f"date={d}" for d in days}
    total = spark.read.parquet(gold).agg(F.sum("requests"), F.sum("tokens"), F.sum("errors")).first()
    assert tuple(total) == tuple(ev.agg(F.count("*"), F.sum("total_tokens"), F.count_if(F.col("status") != 200)).first())


def test_export_audit_holds_no_text(spark, tmp_path):
    a = audit_records(spark, SF)
    export_audit(a.withColumn("prompt", F.lit("secret")), str(tmp_path / "audit"))
    back = spark.read.parquet(str(tmp_path / "audit"))
    assert set(back.columns) == set(AUDIT_COLS) and back.count() == a.count() > 0
    assert all(p.name.startswith(("tenant_id=", "_", ".")) for p in (tmp_path / "audit").iterdir())
