"""Partitioned sinks (S8): silver event tables and gold aggregates by date and tenant.

Rows are dealt by (date, tenant) and a salt before writing, so a partition gets
a few files of ``rows_per_file`` at most each and a tenant with a third of the
traffic is written by many tasks. Overwriting replaces only the partitions that
are written, so a day that runs again gives the same files' worth of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Second 0 of the event clock.
EPOCH = 1704067200
ROWS_PER_FILE = 5_000_000


def by_day(df: DataFrame, sec: str = "sec") -> DataFrame:
    return df.withColumn("date", F.to_date(F.timestamp_seconds(F.col(sec) + EPOCH)))


def write_partitioned(df: DataFrame, path: str, tenant: str = "tenant_id", files_per_partition: int = 8, rows_per_file: int = ROWS_PER_FILE) -> None:
    """Writes ``df`` (with a ``date``) under date=/tenant= folders."""
    salt = F.pmod(F.xxhash64(*df.columns), F.lit(files_per_partition))  # of the row: the same if a task runs again
    spread = df.repartition(F.col("date"), F.col(tenant), salt)
    (spread.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", rows_per_file)
     .partitionBy("date", tenant).parquet(path))


def write_silver(events: DataFrame, path: str, sec: str = "sec") -> None:
    """Every event with its day, columns as they are."""
    write_partitioned(by_day(events, sec), path)


def write_gold(events: DataFrame, path: str, sec: str = "sec") -> None:
    """Requests, tokens and errors by day, tenant and model."""
    gold = by_day(events, sec).groupBy("date", "tenant_id", "model").agg(
        F.count(F.lit(1)).alias("requests"), F.sum("total_tokens").alias("tokens"), F.count_if(F.col("status") != 200).alias("errors"))
    write_partitioned(gold, path, files_per_partition=1)
