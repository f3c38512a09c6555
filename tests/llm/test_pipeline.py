import numpy as np
import pytest

import corpus_pipeline as P
from agentlake.llm import decontaminate, pseudonyms
from test_jaccard import brute
from test_mixing import brute_targets

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Rows before and after every stage, each written and read again."""
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs.collect()]
    for name, stage in P.STAGES:
        stage(spark, docs, SF).write.parquet(str(folder / name))
        docs = spark.read.parquet(str(folder / name))
        out.append(docs.collect())
        if name != P.STAGES[-1][0]:
            assert docs.columns == list(P.COLUMNS)
    return out


def ids(rows):
    return {r["doc_id"] for r in rows}


def test_quality_goes_by_the_labels(spark, stages):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = ids(stages[1])
    assert kept <= ids(stages[0]) and {r["text"] for r in stages[1]} <= {r["text"] for r in stages[0]}
    assert np.mean([d in kept for d, q in labels.items() if q == 1]) > 0.99
    assert np.mean([d in kept for d, q in labels.items() if q == 0]) < 0.02


def test_one_document_of_each_group_stays(stages):
    rows = [(r["doc_id"], r["text"]) for r in stages[1][:2500]]
    whole = {d: c for d, (_, c) in brute(rows, 5, 80, 100).items()}
    kept, given = ids(stages[2]), ids(stages[1])
    assert kept <= given and len(kept) < len(given)
    first = {d for d, c in whole.items() if c == d}
    for d, _ in rows:
        if d not in first:
            assert d not in kept  # a duplicate within the part that brute force sees
    texts = {r["doc_id"]: r["text"] for r in stages[2]}
    assert len(set(texts.values())) == len(texts)


def test_no_benchmark_item_is_left_and_clean_documents_stay(spark, stages):
    items = [decontaminate.fold(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = ids(stages[3])
    for r in stages[2]:
        t = decontaminate.fold(r["text"])
        assert (r["doc_id"] in kept) == (not any(decontaminate.search(i, t, int(decontaminate.MAX_RATE * len(i))) for i in items if i[:30] in t or i[-30:] in t or i in t))


def test_values_are_replaced_and_nothing_else(stages):
    before = {r["doc_id"]: r["text"] for r in stages[3]}
    p = pseudonyms.Pseudonymizer(P.PII_KEY)
    assert len(stages[4]) == len(before)
    for r in stages[4]:
        assert r["text"] == p.text(before[r["doc_id"]])[0] and r["n_chars"] == len(r["text"])
    assert any(r["text"] != before[r["doc_id"]] for r in stages[4])


def test_mix_reaches_its_targets_in_order(stages):
    sizes = {}
    for r in stages[4]:
        sizes[r["source"]] = sizes.get(r["source"], 0) + len(r["text"].split())
    want, taken = brute_targets(sizes), {}
    for r in stages[5]:
        taken[r["source"]] = taken.get(r["source"], 0) + r["words"]
    for s in want:
        assert abs(taken[s] - want[s]) <= 1 + 0.01 * want[s]


def test_run_equals_the_stages_and_empty_documents(spark, stages, tmp_path):
    got = P.run(spark, SF).select("doc_id", "epoch", "words", "position").collect()
    assert sorted(map(tuple, got)) == sorted((r["doc_id"], r["epoch"], r["words"], r["position"]) for r in stages[5])
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0


def test_nulls_and_repeated_rows(spark):
    rows = [(1, None, "en", None, None), (2, "", None, "s", 0), (None, "some text here that is plain", "en", "s", 28)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in P.STAGES[1:]:
        docs = stage(spark, docs, SF)
    assert {r["doc_id"] for r in docs.collect()} == {None}


def test_one_row_of_duplicates_stays_whatever_its_id(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(7, text), (None, text), (None, text), (3, text + " more"), (3, text + " more"), (9, "quite another text of some words that is alone"), (None, ""), (None, None), (4, "")]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = sorted(((r["doc_id"], r["text"]) for r in P.near_duplicate_stage(spark, docs, SF).collect()), key=str)
    assert kept == sorted([(3, text + " more"), (9, rows[5][1]), (None, ""), (None, None), (4, "")], key=str)
