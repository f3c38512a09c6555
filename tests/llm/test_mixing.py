import pytest

from agentlake.llm import mixing as M


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, cap=2.0):
    """Reshare in rounds until no source is above its cap."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    fixed, total = {}, share * sum(sizes.values())
    while True:
        free = [s for s in names if s not in fixed]
        if not free:
            return fixed
        level = (total - sum(fixed.values())) / sum(w[s] for s in free)
        over = [s for s in free if level * w[s] > cap * sizes[s]]
        if not over:
            return fixed | {s: level * w[s] for s in free}
        fixed |= {s: cap * sizes[s] for s in over}


DOCS = [(i, " ".join(["w"] * (7 * i % 23)), s, "x", 0) for i, s in enumerate(["b", "a", None, "é", "b", "a", "zz", "b", "b"] * 12)]
DOCS += [(500, None, "b", "x", 0), (501, "", "empty", "x", 0), (502, "v " * 40000, "a", "x", 0)]
SCHEMA = "doc_id long, text string, source string, start string, size long"


def test_targets_and_taken_words(spark):
    df = spark.createDataFrame(DOCS, SCHEMA)
    sizes = {}
    for _, t, s, *_ in DOCS:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = brute_targets(sizes)
    rows = M.mix(df, untaken=True).collect()
    taken, by_doc = {}, {}
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        taken[r["source"]] = taken.get(r["source"], 0) + r["words"]
        by_doc[r["doc_id"]] = by_doc.get(r["doc_id"], 0) + r["words"]
        assert by_doc[r["doc_id"]] <= 2 * r["size"]
        assert r["position"] is None if r["words"] == 0 else 0 <= r["position"] <= 1
    assert set(by_doc) == {d[0] for d in DOCS}
    for s, n in taken.items():
        assert n == int(want[s] + 1e-9) or abs(n - want[s]) <= 1
    again = M.mix(df.repartition(5), untaken=True).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))


def test_positions_follow_the_schedule_and_are_sorted(spark):
    docs = spark.createDataFrame([(i, "w", "a") for i in range(4000)], "doc_id long, text string, source string")
    rows = M.mix(docs, share=1.0, schedules=(((0.0, 1.5), (1.0, 0.5)),) * 3).collect()
    pos = [r["position"] for r in rows]
    assert pos == sorted(pos) and len(pos) == 4000
    # the integral of 1.5 - t up to 0.5 is 0.625 of the whole
    assert abs(sum(p < 0.5 for p in pos) / 4000 - 0.625) < 0.002


def test_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b", "s"), (1, "a b", "s")], "doc_id long, text string, source string")
    assert sum(r["words"] for r in M.mix(df).collect()) == 6
    assert M.mix(df.limit(0)).count() == 0


def test_query_has_a_row_for_each_row_as_its_sql(spark, tmp_path):
    import duckdb

    from agentlake.llm import queries

    rows = [(1, "a b c", "s"), (1, "a b c", "s"), (None, "d e", "s"), (None, "f g", "s"), (2, "h i", "t"), (None, "j k", "u"), (None, "l m", "v"), (3, None, "s")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(str, (tuple(r) for r in queries.QUERIES["op8_mixing"](spark, str(tmp_path)).collect())))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert got == sorted(map(str, db.execute(queries.ORACLE_SQL["op8_mixing"]).fetchall())) and len(got) == len(rows)
