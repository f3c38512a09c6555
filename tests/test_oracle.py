"""Every registered query against its DuckDB oracle on the smallest scale."""

import duckdb
import pytest

from agentlake.plans.registry import load_all, with_views
from agentlake.sources.tables import TABLES
from tools.oracle_check import digest

SF = "/root/testdata/sf0.001"
KEYS = sorted(k for k, q in load_all().items() if q.sql)


def _duck_name(t):
    s = t.simpleString()
    if s.startswith("decimal"):
        return "DECIMAL" + s[7:].replace(" ", "")
    return {"int": "INTEGER", "bigint": "BIGINT", "string": "VARCHAR", "boolean": "BOOLEAN",
            "double": "DOUBLE", "float": "FLOAT", "smallint": "SMALLINT"}.get(s, s.upper())


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("key", KEYS)
def test_matches_oracle(spark, con, key):
    q = load_all()[key]
    sdf = q.build(spark, SF)
    srows = [tuple(r) for r in sdf.collect()]
    cur = con.execute(with_views(q.sql))
    dcols = [d[0] for d in cur.description]
    drows = cur.fetchall()
    assert sorted(sdf.columns) == sorted(dcols)
    dtypes = dict(zip(dcols, [str(t).upper().replace(" ", "") for t in con.sql(with_views(q.sql)).types]))
    stypes = {f.name: _duck_name(f.dataType) for f in sdf.schema.fields}
    assert stypes == dtypes
    assert len(srows) == len(drows)
    assert digest(sdf.columns, srows)[0] == digest(dcols, drows)[0]


def test_rows_only_queries_are_near_the_exact_answer(spark):
    reg = load_all()
    assert {k for k, q in reg.items() if not q.sql} == {"approx_sessions", "latency_quantiles_approx", "schema_savings"}
    exact = {tuple(r[:1]): r for r in reg["latency_quantiles"].build(spark, SF).collect()}
    approx = reg["latency_quantiles_approx"].build(spark, SF).collect()
    assert approx and len(approx) == len(exact)
    for r in approx:
        e = exact[tuple(r[:1])].asDict()
        for c, v in r.asDict().items():
            if isinstance(v, float) and c in e:
                assert abs(v - e[c]) <= 0.1 * max(abs(e[c]), 1), (c, v, e[c])
    assert reg["approx_sessions"].build(spark, SF).count() > 0
    for r in reg["schema_savings"].build(spark, SF).collect():
        assert r["bytes_saved"] >= 0 and r["bytes_before"] > 0 and r["bytes_saved"] >= r["bytes_before"] - r["bytes_after"]
