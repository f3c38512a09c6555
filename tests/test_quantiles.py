"""Exact quantiles against numpy, averages against a loop, in one round and in many."""

import random

import numpy as np
import pytest

from agentlake.operators.ordered import ema
from agentlake.operators.quantiles import exact_quantiles

QS = {"least": 0.0, "p25": 0.25, "p50": 0.5, "p95": 0.95, "p999": 0.999, "most": 1.0}


@pytest.mark.parametrize(("buckets", "few"), [(1024, 1 << 16), (16, 5)])
def test_quantiles(spark, buckets, few):
    rnd = random.Random(1)
    groups = {"ints": [rnd.randrange(50) for _ in range(900)], "skewed": [rnd.random() ** 20 * 1e9 for _ in range(500)] + [0.0] * 300 + [1e12], "one": [7.5], "same": [3] * 400,
              "negative": [rnd.gauss(0, 1) for _ in range(301)]}
    rows = [(k, float(v), "x") for k, vs in groups.items() for v in vs] + [("ints", None, "x"), ("ints", float("nan"), "x"), (None, 1.0, "x"), ("void", None, "x")]
    df = spark.createDataFrame(rows, "k string, value double, lo string")
    got = {r["k"]: r for r in exact_quantiles(df, ["k"], "value", QS, buckets, few).collect()}
    assert set(got) == set(groups)
    for k, vs in groups.items():
        assert got[k]["n"] == len(vs)
        for name, q in QS.items():
            assert got[k][name] == pytest.approx(np.quantile(vs, q), rel=1e-12, abs=1e-12)


def test_no_rows(spark):
    assert exact_quantiles(spark.createDataFrame([], "k string, v int"), ["k"], "v", QS).collect() == []


@pytest.mark.parametrize("width", [64, 3])
def test_ema(spark, width):
    rnd = random.Random(2)
    rows = [(k, t, rnd.random() * 100) for k in ("a", "b") for t in sorted(rnd.sample(range(500), 80))] + [("c", 499, 5.0)]
    got = {(r["k"], r["t"]): r["ema"] for r in ema(spark.createDataFrame(rows, "k string, t long, v double"), ["k"], "t", "v", 0.3, width=width).collect()}
    before = {}
    for k, t, v in rows:
        before[k] = v if k not in before else 0.3 * v + 0.7 * before[k]
        assert got[k, t] == pytest.approx(before[k], rel=1e-12)
    assert len(got) == len(rows)
