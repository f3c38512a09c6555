"""Joins against configuration dimensions.

A dimension is broadcast only when it has been measured: its rows are counted
up to the bound before the hint. Anything larger goes through a normal shuffle
join and AQE decides at runtime from measured sizes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_BROADCAST_ROWS = 200_000


def bounded(df: DataFrame) -> DataFrame:
    """Hint a broadcast if the frame itself has at most the bound's rows. Literal
    configuration is counted by the optimizer without a job over any table."""
    if df.limit(MAX_BROADCAST_ROWS + 1).count() <= MAX_BROADCAST_ROWS:
        return F.broadcast(df)
    return df
