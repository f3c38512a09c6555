"""Provider-shaped request payloads built from ``conversations`` (FIXTURES C4).

One payload per conversation, format by ``conv_id % 5`` (openai, anthropic,
gemini, cohere, bedrock), messages in turn order. An assistant turn with
``(conv_id + turn) % 3 == 0`` carries one tool call ``call_<conv>_<turn>`` to
``tool_<turn % 4>`` with arguments ``{"turn": t, "conv": c}``. Every
``conv_id % 37 == 0`` payload is truncated (invalid JSON) and every
``conv_id % 41 == 0`` payload has no ``model``.

A conversation is a handful of turns, so the per-conversation ``collect_list``
is bounded by the conversation, not by the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from agentlake.sources.tables import memo, read

FORMATS = ["openai", "anthropic", "gemini", "cohere", "bedrock"]
MODELS = ["gpt-4o", "claude-3-5-sonnet", "gemini-1.5-pro", "command-r", "anthropic.claude-3-sonnet"]


def _q(s: Column) -> Column:
    """JSON string literal of a column (escaped by to_json)."""
    return F.regexp_extract(F.to_json(F.struct(s.alias("v"))), r'^\{"v":(.*)\}$', 1)


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    has_call = (F.col("role") == "assistant") & ((F.col("conv_id") + F.col("turn")) % 3 == 0)
    return c.select(
        "conv_id", "turn", "role", "text",
        (F.col("conv_id") % 5).cast("int").alias("fmt"),
        has_call.alias("has_call"),
        F.concat(F.lit("call_"), F.col("conv_id").cast("string"), F.lit("_"), F.col("turn").cast("string"))
         .alias("call_id"),
        F.concat(F.lit("tool_"), (F.col("turn") % 4).cast("string")).alias("call_tool"),
        F.concat(F.lit('{"turn":'), F.col("turn").cast("string"), F.lit(',"conv":'),
                 F.col("conv_id").cast("string"), F.lit("}")).alias("call_args"),
    )


def _fragment(t) -> Column:
    """JSON of one turn in its conversation's format."""
    text, role, cid, tool, args = F.col("text"), F.col("role"), F.col("call_id"), F.col("call_tool"), F.col("call_args")
    call = F.col("has_call")
    qt = _q(text)
    openai = F.concat(F.lit('{"role":'), _q(role), F.lit(',"content":'), qt,
                      F.when(call, F.concat(F.lit(',"tool_calls":[{"id":'), _q(cid),
                                            F.lit(',"type":"function","function":{"name":'), _q(tool),
                                            F.lit(',"arguments":'), _q(args), F.lit("}}]"))).otherwise(F.lit("")),
                      F.lit("}"))
    anthropic = F.concat(F.lit('{"role":'), _q(role), F.lit(',"content":[{"type":"text","text":'), qt, F.lit("}"),
                         F.when(call, F.concat(F.lit(',{"type":"tool_use","id":'), _q(cid), F.lit(',"name":'),
                                               _q(tool), F.lit(',"input":'), args, F.lit("}"))).otherwise(F.lit("")),
                         F.lit("]}"))
    gem_role = F.when(role == "assistant", F.lit('"model"')).otherwise(F.lit('"user"'))
    gemini = F.concat(F.lit('{"role":'), gem_role, F.lit(',"parts":[{"text":'), qt, F.lit("}"),
                      F.when(call, F.concat(F.lit(',{"functionCall":{"name":'), _q(tool), F.lit(',"args":'), args,
                                            F.lit("}}"))).otherwise(F.lit("")),
                      F.lit("]}"))
    coh_role = F.when(role == "assistant", F.lit('"CHATBOT"')).when(role == "system", F.lit('"SYSTEM"')) \
        .otherwise(F.lit('"USER"'))
    cohere = F.concat(F.lit('{"role":'), coh_role, F.lit(',"message":'), qt, F.lit("}"))
    bedrock = F.concat(F.lit('{"role":'), _q(role), F.lit(',"content":[{"text":'), qt, F.lit("}"),
                       F.when(call, F.concat(F.lit(',{"toolUse":{"toolUseId":'), _q(cid), F.lit(',"name":'),
                                             _q(tool), F.lit(',"input":'), args, F.lit("}}"))).otherwise(F.lit("")),
                       F.lit("]}"))
    fmt = F.col("fmt")
    return (F.when(fmt == 0, openai).when(fmt == 1, anthropic).when(fmt == 2, gemini)
            .when(fmt == 3, cohere).otherwise(bedrock))


@memo
def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(payload_id, tenant_id, session_id, sec, fmt, format, body)."""
    t = turns(spark, sf_dir)
    anth_system = (F.col("fmt") == 1) & (F.col("role") == "system")
    t = t.withColumn("frag", F.when(anth_system, F.lit(None)).otherwise(_fragment(t)))
    t = t.withColumn("cohere_call", F.when((F.col("fmt") == 3) & F.col("has_call"),
                                           F.concat(F.lit('{"name":'), _q(F.col("call_tool")),
                                                    F.lit(',"parameters":'), F.col("call_args"), F.lit("}"))))
    g = t.groupBy("conv_id", "fmt").agg(
        F.array_sort(F.collect_list(F.struct("turn", "frag"))).alias("frags"),
        F.array_sort(F.collect_list(F.struct("turn", "cohere_call"))).alias("ccalls"),
        F.max(F.when(anth_system, F.col("text"))).alias("system_text"),
        F.max_by(F.col("text"), F.when(F.col("role") == "user", F.col("turn"))).alias("last_user"),
    )
    msgs = F.array_join(F.transform(F.filter("frags", lambda x: x["frag"].isNotNull()), lambda x: x["frag"]), ",")
    ccalls = F.array_join(F.transform(F.filter("ccalls", lambda x: x["cohere_call"].isNotNull()),
                                      lambda x: x["cohere_call"]), ",")
    cid = F.col("conv_id")
    model = F.element_at(F.array(*[F.lit(m) for m in MODELS]), (F.col("fmt") + 1))
    model_part = F.when(cid % 41 == 0, F.lit("")).otherwise(F.concat(F.lit('"model":'), _q(model), F.lit(",")))
    tools_part = F.when((cid % 2 == 0) & F.col("fmt").isin(0, 1),
                        F.lit('"tools":[{"type":"function","function":{"name":"tool_0","description":"First tool",'
                              '"parameters":{"type":"object","title":"Lookup","examples":[{"turn":1}],'
                              '"properties":{"turn":{"type":"integer","description":"Turn number"},'
                              '"title":{"type":"string"}}}}}],'))\
        .otherwise(F.lit(""))
    body_main = (F.when(F.col("fmt").isin(0, 1, 4), F.concat(F.lit('"messages":['), msgs, F.lit("]")))
                 .when(F.col("fmt") == 2, F.concat(F.lit('"contents":['), msgs, F.lit("]")))
                 .otherwise(F.concat(F.lit('"message":'), F.coalesce(_q(F.col("last_user")), F.lit('""')),
                                     F.lit(',"chat_history":['), msgs, F.lit("]"),
                                     F.when(F.length(ccalls) > 0, F.concat(F.lit(',"tool_calls":['), ccalls, F.lit("]")))
                                     .otherwise(F.lit("")))))
    system_part = F.when(F.col("system_text").isNotNull(),
                         F.concat(F.lit('"system":'), _q(F.col("system_text")), F.lit(","))).otherwise(F.lit(""))
    body = F.when(cid % 37 == 0, F.expr("substring(body_tmp, 1, length(body_tmp) - 10)")).otherwise(F.col("body_tmp"))
    out = g.select("conv_id", "fmt", F.concat(F.lit("{"), model_part, tools_part, system_part, body_main,
                                              F.lit("}")).alias("body_tmp"))
    return out.select(
        F.col("conv_id").alias("payload_id"),
        F.concat(F.lit("t-"), (cid % 8).cast("string")).alias("tenant_id"),
        F.concat(F.lit("conv-"), cid.cast("string")).alias("session_id"),
        (cid * 10).alias("sec"),
        "fmt",
        F.element_at(F.array(*[F.lit(f) for f in FORMATS]), F.col("fmt") + 1).alias("format"),
        body.alias("body"),
    )
