"""Stream stitching and reassembly.

Per stream the chunks are gathered in ``seq`` order — one response's chunks,
bounded by the response, not by the table. The whole text is one linear join
of the pieces; only with an explicit buffer limit (order dependent) is it a fold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from agentlake.functions.classify import has_error_signature

# Fixed value: bytes per estimated token.
CHARS_PER_TOKEN = 4


def stitch(chunks: DataFrame) -> DataFrame:
    """Error-signature chunks end a provider segment and are not forwarded.

    Returns the forwarded chunks with their segment number; the segment is a
    running count of earlier error chunks (window per stream, bounded by one
    response)."""
    w = Window.partitionBy("stream_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    c = chunks.withColumn("_err", has_error_signature(F.col("data")) & (F.col("data") != "[DONE]"))
    c = c.withColumn("segment", F.coalesce(F.sum(F.col("_err").cast("int")).over(w), F.lit(0)))
    return c.filter(~F.col("_err")).drop("_err")


def stitch_summary(forwarded: DataFrame) -> DataFrame:
    return forwarded.groupBy("stream_id").agg(
        F.max_by("provider", "seq").alias("executed_provider"),
        (F.max("segment") > 0).alias("is_hot_swapped"),
        F.count(F.lit(1)).alias("forwarded_chunks"))


def reassemble(forwarded: DataFrame) -> DataFrame:
    """Text, total tokens (last usage wins, else estimate) per stream."""
    g = forwarded.groupBy("stream_id").agg(
        F.array_sort(F.collect_list(F.struct("seq", "data"))).alias("cs"),
        F.max("prompt_bytes").alias("prompt_bytes"))
    return g.select("stream_id", *reassemble_columns(F.array_sort("cs"), F.col("prompt_bytes")))


def reassemble_columns(cs, prompt_bytes, max_bytes: int | None = None):
    """X9 over one stream's ``array<struct<seq, data>>`` sorted by seq: (text,
    total_tokens) columns. Shared by the batch and streaming forms. With
    ``max_bytes`` a piece that would pass the buffer limit is left out (off by default)."""
    done_pos = F.array_position(F.transform(cs, lambda x: x["data"]), "[DONE]")
    live = F.when(done_pos > 0, F.slice(cs, 1, (done_pos - 1).cast("int"))).otherwise(cs)
    parsed = F.transform(live, lambda x: F.struct(
        F.try_parse_json(x["data"]).alias("v"), F.octet_length(x["data"]).alias("nbytes")))

    def piece(p):
        v = p["v"]
        c = F.try_variant_get(v, "$.choices[0].delta.content", "string")
        t = F.try_variant_get(v, "$.delta.text", "string")
        return F.coalesce(c, t)

    if max_bytes is None:
        text = F.array_join(F.transform(parsed, piece), "")
    else:
        text = F.aggregate(parsed, F.lit(""), lambda acc, p: F.when(
            piece(p).isNotNull() & (F.octet_length(acc) + F.octet_length(piece(p)) < max_bytes),
            F.concat(acc, piece(p))).otherwise(acc))
    usage = F.element_at(F.filter(F.transform(parsed, lambda p: F.try_variant_get(
        p["v"], "$.usage.total_tokens", "bigint")), lambda x: x.isNotNull()), -1)
    est_bytes = F.aggregate(parsed, F.lit(0).cast("bigint"), lambda acc, p: acc + p["nbytes"] + 1)
    estimate = (F.greatest(F.lit(1).cast("bigint"), (prompt_bytes / CHARS_PER_TOKEN).cast("bigint"))
                + F.greatest(F.lit(1).cast("bigint"), (est_bytes / CHARS_PER_TOKEN).cast("bigint")))
    usage_val = F.when(F.size(F.filter(F.transform(parsed, lambda p: F.try_variant_get(
        p["v"], "$.usage.total_tokens", "bigint")), lambda x: x.isNotNull())) > 0, usage)
    total = F.when(F.coalesce(usage_val, F.lit(0)) > 0, usage_val).otherwise(estimate)
    return [text.alias("text"), total.cast("bigint").alias("total_tokens")]
