"""Queries: MCP result content and TOON compression (X17, X18), security alerts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from agentlake.functions.once import once
from agentlake.plans.registry import query
from agentlake.sources.tables import read


def mcp_responses(spark, sf_dir):
    """One MCP tool response per order: the order's line items as a JSON array
    inside ``result.content[0].text``. Orders with ``l_orderkey % 3 == 0`` get
    a heterogeneous array (the last item lacks ``flag``). An order is a
    handful of lines, so the per-order list is bounded."""
    li = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity",
                                                 "l_returnflag")
    item = F.struct(F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"),
                    F.floor("l_quantity").cast("bigint").alias("qty"), F.col("l_returnflag").alias("flag"))
    g = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(item)).alias("items"))
    het = F.col("l_orderkey") % 3 == 0
    n = F.size("items")
    objs = F.transform("items", lambda x, i: F.when(
        het & (i == n - 1), F.to_json(F.struct(x["line"].alias("line"), x["part"].alias("part"), x["qty"].alias("qty"))))
        .otherwise(F.to_json(x)))
    text = F.concat(F.lit("["), F.array_join(objs, ","), F.lit("]"))
    body = F.to_json(F.struct(F.struct(F.array(F.struct(F.lit("text").alias("type"), text.alias("text")))
                                       .alias("content")).alias("result")))
    return g.select(F.col("l_orderkey").alias("batch_id"), body.alias("body"))


def tool_result_content(body: Column) -> Column:
    """Result.content[0].text, else the result as JSON, else the body."""
    return once(F.try_parse_json(body), lambda v: F.coalesce(
        F.try_variant_get(v, "$.result.content[0].text", "string"),
        F.to_json(F.try_variant_get(v, "$.result", "variant")), body))


def to_toon(text: Column) -> Column:
    """A homogeneous JSON array of objects -> ``array[n]{k1,k2}: \\n v,v \\n v,v``
    (sorted keys, strings raw, null -> ``null``); empty -> ``array[0]{}:``;
    anything else (not an array, heterogeneous keys, non-objects) unchanged.

    Every element is written and read once, so the work grows with the array."""
    def table(text, objs):
        # entries of each object by key: strings unescaped, numbers / nested values as JSON text
        keys = F.transform(F.get(objs, F.lit(0)), lambda kv: kv["key"])
        rows = F.transform(objs, lambda o: F.array_join(F.transform(o, lambda kv: F.coalesce(kv["value"], F.lit("null"))), ","))
        toon = once(keys, lambda k: F.when(
            F.forall(objs, lambda o: F.transform(o, lambda kv: kv["key"]) == k),
            F.concat(F.lit("array["), F.size(objs).cast("string"), F.lit("]{"), F.array_join(k, ","), F.lit("}: \n "),
                     F.array_join(rows, " \n "))))
        return F.coalesce(toon, text)

    def elements(text, elems):
        array = F.from_json(F.concat(F.lit("["), F.array_join(elems, ","), F.lit("]")), "array<map<string,string>>")
        objs = F.transform(array, lambda o: F.sort_array(F.map_entries(o)))
        is_obj = F.forall(elems, lambda e: F.coalesce(e.startswith("{"), F.lit(False)))  # only objects are written so
        return (F.when(elems.isNull(), text).when(F.size(elems) == 0, F.lit("array[0]{}:"))
                .when(is_obj, once(objs, lambda o: table(text, o))).otherwise(text))

    arr = F.try_variant_get(F.try_parse_json(text), "$", "array<variant>")
    return once(text, lambda t: once(F.transform(arr, lambda e: F.to_json(e)), lambda elems: elements(t, elems)))


_ORDERS = """
WITH it AS (SELECT l_orderkey, l_linenumber AS line, l_partkey AS part, CAST(floor(l_quantity) AS BIGINT) AS qty,
                   l_returnflag AS flag FROM lineitem),
g AS (SELECT l_orderkey, count(*) AS n,
             string_agg(flag || ',' || line || ',' || part || ',' || qty, ' \n ' ORDER BY line, part, qty, flag) AS rows
      FROM it GROUP BY l_orderkey)
"""


@query("to_toon", sql=_ORDERS + """
SELECT l_orderkey AS batch_id,
       CASE WHEN l_orderkey % 3 = 0 AND n > 1 THEN NULL
            WHEN l_orderkey % 3 = 0 THEN 'array[1]{line,part,qty}: \n ' || regexp_replace(rows, '^[^,]*,', '')
            ELSE 'array[' || n || ']{flag,line,part,qty}: \n ' || rows END AS toon,
       l_orderkey % 3 = 0 AND n > 1 AS unchanged
FROM g
""")
def to_toon_q(spark, sf_dir):
    m = mcp_responses(spark, sf_dir)
    content = tool_result_content(F.col("body"))
    t = m.select("batch_id", content.alias("content")).withColumn("t", to_toon(F.col("content")))
    unchanged = F.col("t") == F.col("content")
    return t.select("batch_id", F.when(~unchanged, F.col("t")).alias("toon"), unchanged.alias("unchanged"))


@query("tool_result_content", sql=_ORDERS + """
SELECT l_orderkey AS batch_id, CAST(n AS INTEGER) AS items FROM g
""")
def tool_result_content_q(spark, sf_dir):
    m = mcp_responses(spark, sf_dir)
    c = tool_result_content(F.col("body"))
    return m.select("batch_id", F.size(F.try_variant_get(F.try_parse_json(c), "$", "array<variant>")).alias("items"))
