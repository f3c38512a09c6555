"""TOON text of odd arrays, and of arrays long enough to show work that grows with the square."""

import json
import time

from pyspark.sql import functions as F

from agentlake.plans.toon import to_toon, tool_result_content


def toon(spark, *texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", to_toon(F.col("t")).alias("t")).orderBy("i").collect()
    return [r["t"] for r in rows]


def test_arrays(spark):
    cases = [
        ('[{"b":1,"a":"x\\"y, z"},{"a":null,"b":2.50}]', 'array[2]{a,b}: \n x"y, z,1 \n null,2.5'),
        ('[{"n":{"q":[1,"s"]},"k":true}]', 'array[1]{k,n}: \n true,{"q":[1,"s"]}'),
        ("[]", "array[0]{}:"), ("[{},{}]", "array[2]{}: \n  \n "),
    ]
    same = ['[{"a":1},{"b":1}]', '[{"a":1},{"a":1,"b":2}]', "[1,2]", '["{a","{b"]', '[{"a":1},null]', '[null]', '{"a":1}', "oops", "", None]
    assert toon(spark, *[t for t, _ in cases], *same) == [w for _, w in cases] + same


def test_content(spark):
    bodies = ['{"result":{"content":[{"type":"text","text":"[1]"}]}}', '{"result":{"x":1}}', '{"y":2}', "oops", None]
    rows = spark.createDataFrame([(b,) for b in bodies], "b string").select(tool_result_content(F.col("b")).alias("c")).collect()
    assert [r["c"] for r in rows] == ["[1]", '{"x":1}', '{"y":2}', "oops", None]


def test_work_grows_with_the_array(spark):
    n = 4000
    toon(spark, "[]")
    t = time.time()
    got = toon(spark, json.dumps([{"line": i, "flag": "N"} for i in range(n)]))[0]
    assert time.time() - t < 20  # reading the array again for each element takes minutes
    assert got == f"array[{n}]{{flag,line}}: \n " + " \n ".join(f"N,{i}" for i in range(n))
