"""Token metering expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: bytes per token of the gateway's estimate.
BYTES_PER_TOKEN = 4


def estimate_prompt_tokens(text: Column) -> Column:
    """max(1, bytes / 4) — UTF-8 bytes, not characters."""
    return F.greatest(F.lit(1).cast("bigint"),
                      (F.octet_length(text) / BYTES_PER_TOKEN).cast("bigint"))


def estimate_completion_tokens(text: Column) -> Column:
    """max(0, bytes / 4) for a response body."""
    return (F.octet_length(text) / BYTES_PER_TOKEN).cast("bigint")
