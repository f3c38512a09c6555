"""Provider responses built from assistant turns.

One response per assistant turn (``response_id = conv_id * 10 + turn``) in
the provider shape of ``conv_id % 5``. A turn with ``(conv_id + turn) % 3 == 0``
answers with a tool call; when additionally ``response_id % 13 == 0`` a
second, broken call follows it (missing the field that provider requires:
``function`` / ``id`` / ``name`` / ``name`` / ``toolUseId``).
Usage: prompt = 10 + turn, completion = number of space-separated words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agentlake.sources.payloads import FORMATS, MODELS, _q
from agentlake.sources.tables import memo, read


@memo
def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "conversations").filter(F.col("role") == "assistant").select("conv_id", "turn", "text")
    rid = F.col("conv_id") * 10 + F.col("turn")
    c = c.select(rid.alias("response_id"), (F.col("conv_id") % 5).cast("int").alias("fmt"), "conv_id", "turn", "text",
                 ((F.col("conv_id") + F.col("turn")) % 3 == 0).alias("has_call"))
    c = c.withColumn("broken", F.col("has_call") & (F.col("response_id") % 13 == 0))
    cid = _q(F.concat(F.lit("call_"), F.col("conv_id").cast("string"), F.lit("_"), F.col("turn").cast("string")))
    bid = _q(F.concat(F.lit("call_"), F.col("conv_id").cast("string"), F.lit("_"), F.col("turn").cast("string"),
                      F.lit("_b")))
    tool = _q(F.concat(F.lit("tool_"), (F.col("turn") % 4).cast("string")))
    args = F.concat(F.lit('{"turn":'), F.col("turn").cast("string"), F.lit(',"conv":'), F.col("conv_id").cast("string"),
                    F.lit("}"))
    p = (F.lit(10) + F.col("turn")).cast("string")
    n = F.size(F.split("text", " ")).cast("string")
    tot = (F.lit(10) + F.col("turn") + F.size(F.split("text", " "))).cast("string")
    text = _q(F.col("text"))
    call, broken = F.col("has_call"), F.col("broken")

    def opt(cond, s):
        return F.when(cond, s).otherwise(F.lit(""))

    openai = F.concat(
        F.lit('{"id":"resp-'), F.col("response_id").cast("string"), F.lit('","model":"gpt-4o","choices":[{"index":0,'
                                                                          '"message":{"role":"assistant","content":'),
        text,
        opt(call, F.concat(F.lit(',"tool_calls":[{"id":'), cid, F.lit(',"type":"function","function":{"name":'), tool,
                           F.lit(',"arguments":'), _q(args), F.lit("}}"),
                           opt(broken, F.concat(F.lit(',{"id":'), bid, F.lit(',"type":"function"}'))), F.lit("]"))),
        F.lit('},"finish_reason":'), F.when(call, F.lit('"tool_calls"')).otherwise(F.lit('"stop"')),
        F.lit('}],"usage":{"prompt_tokens":'), p, F.lit(',"completion_tokens":'), n, F.lit(',"total_tokens":'), tot,
        F.lit("}}"))
    anthropic = F.concat(
        F.lit('{"id":"resp-'), F.col("response_id").cast("string"),
        F.lit('","type":"message","role":"assistant","model":"claude-3-5-sonnet","content":[{"type":"text","text":'),
        text, F.lit("}"),
        opt(call, F.concat(F.lit(',{"type":"tool_use","id":'), cid, F.lit(',"name":'), tool, F.lit(',"input":'), args,
                           F.lit("}"), opt(broken, F.concat(F.lit(',{"type":"tool_use","name":'), tool,
                                                            F.lit(',"input":{}}'))))),
        F.lit('],"stop_reason":'), F.when(call, F.lit('"tool_use"')).otherwise(F.lit('"end_turn"')),
        F.lit(',"usage":{"input_tokens":'), p, F.lit(',"output_tokens":'), n, F.lit("}}"))
    gemini = F.concat(
        F.lit('{"candidates":[{"content":{"role":"model","parts":[{"text":'), text, F.lit("}"),
        opt(call, F.concat(F.lit(',{"functionCall":{"name":'), tool, F.lit(',"args":'), args, F.lit("}}"),
                           opt(broken, F.lit(',{"functionCall":{"args":{}}}')))),
        F.lit(']},"finishReason":"STOP"}]}'))
    cohere = F.concat(
        F.lit('{"text":'), text,
        opt(call, F.concat(F.lit(',"tool_calls":[{"name":'), tool, F.lit(',"parameters":'), args, F.lit("}"),
                           opt(broken, F.lit(',{"parameters":{}}')), F.lit("]"))),
        F.lit(',"finish_reason":'), F.when(call, F.lit('"TOOL_CALL"')).otherwise(F.lit('"COMPLETE"')), F.lit("}"))
    bedrock = F.concat(
        F.lit('{"output":{"message":{"role":"assistant","content":[{"text":'), text, F.lit("}"),
        opt(call, F.concat(F.lit(',{"toolUse":{"toolUseId":'), cid, F.lit(',"name":'), tool, F.lit(',"input":'), args,
                           F.lit("}}"), opt(broken, F.concat(F.lit(',{"toolUse":{"name":'), tool,
                                                             F.lit(',"input":{}}}'))))),
        F.lit(']}},"stopReason":'), F.when(call, F.lit('"tool_use"')).otherwise(F.lit('"end_turn"')), F.lit("}"))
    fmt = F.col("fmt")
    body = (F.when(fmt == 0, openai).when(fmt == 1, anthropic).when(fmt == 2, gemini).when(fmt == 3, cohere)
            .otherwise(bedrock))
    return c.select("response_id", "fmt",
                    F.element_at(F.array(*[F.lit(f) for f in FORMATS]), fmt + 1).alias("provider"),
                    F.element_at(F.array(*[F.lit(m) for m in MODELS]), fmt + 1).alias("model"),
                    body.alias("body"))
