"""Streaming response chunks built from assistant turns (FIXTURES C5).

One stream per assistant turn (``stream_id = conv_id * 10 + turn``), one
chunk per space-separated piece of the text (the space kept on all but the
last piece, so the pieces concatenate back to the text). Even streams use
the OpenAI delta shape and end with a usage chunk, odd streams the
``delta.text`` shape without usage; both end with ``[DONE]``. Every stream
with ``stream_id % 11 == 0`` (and at least two pieces) carries an error chunk
in the middle, after which the other provider continues.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agentlake.sources.tables import memo, read

PROVIDERS = ("openai", "anthropic")
# Fixed value (ours): the mid-stream error chunk.
ERROR_CHUNK = '{"error":{"type":"rate_limit","message":"upstream overloaded"}}'


def _json_str(c):
    return F.regexp_extract(F.to_json(F.struct(c.alias("v"))), r'^\{"v":(.*)\}$', 1)


@memo
def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    first = conv.filter(F.col("turn") == 0).select("conv_id", F.octet_length("text").cast("bigint").alias("prompt_bytes"))
    a = conv.filter(F.col("role") == "assistant").join(first, "conv_id", "left")
    a = a.select((F.col("conv_id") * 10 + F.col("turn")).alias("stream_id"), "text",
                 F.coalesce("prompt_bytes", F.lit(0).cast("bigint")).alias("prompt_bytes"),
                 F.split("text", " ").alias("toks"))
    a = a.withColumn("n", F.size("toks"))
    a = a.withColumn("err", ((F.col("stream_id") % 11 == 0) & (F.col("n") >= 2)).cast("int"))
    a = a.withColumn("mid", F.floor(F.col("n") / 2).cast("int"))
    even = F.col("stream_id") % 2 == 0
    t = a.select("stream_id", "prompt_bytes", "n", "err", "mid", F.posexplode("toks").alias("i", "tok"))
    piece = F.when(F.col("i") < F.col("n") - 1, F.concat(F.col("tok"), F.lit(" "))).otherwise(F.col("tok"))
    seq = F.col("i") + F.when((F.col("err") == 1) & (F.col("i") >= F.col("mid")), 1).otherwise(0)
    data = F.when(even, F.concat(F.lit('{"choices":[{"delta":{"content":'), _json_str(piece), F.lit("}}]}"))) \
        .otherwise(F.concat(F.lit('{"delta":{"text":'), _json_str(piece), F.lit("}}")))
    second = (F.col("err") == 1) & (F.col("i") >= F.col("mid"))
    prov = F.when(even != second, F.lit(PROVIDERS[0])).otherwise(F.lit(PROVIDERS[1]))
    pieces = t.select("stream_id", "prompt_bytes", seq.cast("int").alias("seq"), prov.alias("provider"),
                      data.alias("data"))
    ends = a.select("stream_id", "prompt_bytes", "n", "err", F.explode(F.array(
        F.when(F.col("err") == 1, F.struct(F.col("mid").alias("off"), F.lit(ERROR_CHUNK).alias("data"),
                                           F.lit(0).alias("kind"))),
        F.when(even, F.struct(F.lit(0).alias("off"),
                              F.concat(F.lit('{"choices":[{"delta":{}}],"usage":{"total_tokens":'),
                                       (F.col("n") + 10).cast("string"), F.lit("}}")).alias("data"),
                              F.lit(1).alias("kind"))),
        F.struct(F.lit(0).alias("off"), F.lit("[DONE]").alias("data"), F.lit(2).alias("kind")))).alias("e"))
    ends = ends.filter(F.col("e").isNotNull())
    e_seq = (F.when(F.col("e.kind") == 0, F.col("e.off"))
             .when(F.col("e.kind") == 1, F.col("n") + F.col("err"))
             .otherwise(F.col("n") + F.col("err") + F.when(even, 1).otherwise(0)))
    e_prov = F.when(F.col("e.kind") == 0, F.when(even, F.lit(PROVIDERS[0])).otherwise(F.lit(PROVIDERS[1]))) \
        .otherwise(F.when(even != (F.col("err") == 1), F.lit(PROVIDERS[0])).otherwise(F.lit(PROVIDERS[1])))
    ends = ends.select("stream_id", "prompt_bytes", e_seq.cast("int").alias("seq"), e_prov.alias("provider"),
                       F.col("e.data").alias("data"))
    return pieces.unionByName(ends)
