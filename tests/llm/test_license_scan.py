import re

from agentlake.llm import license_scan as L
from agentlake.llm import queries

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def test_base_phrases_match_brute_force_on_all_documents(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    got = queries.QUERIES["op4_license_scan"](spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(docs)
    n_hits = 0
    for r in got:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in docs[r["doc_id"]])
        words = WORDS.findall(low)
        places = [(i, label) for phrase, label in (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
                  for i in range(len(words)) if words[i:i + len(phrase.split())] == phrase.split()]
        n_hits += len(places)
        assert r["n_words"] == len(words) and r["n_base"] == len(places)
        assert r["first_word"] == min((p for p, _ in places), default=None) and r["last_word"] == max((p for p, _ in places), default=None)
        assert r["base_labels"] == ",".join(sorted({x for _, x in places}))
        assert set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    assert n_hits > 0


def scan(spark, texts):
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, base int")
    return {r["doc_id"]: r for r in L.scan(df).collect()}


def test_rules_priorities_and_containment(spark):
    got = scan(spark, [
        "This software is released under the terms of the GNU General Public License version 3.",
        "SPDX-License-Identifier: MIT",
        "MIT License / MIT license; see the MIT licence for details",
        "It is not licensed under the Apache License.",
        "CC-BY cc by, cc by cc by 4.0",
        "my driver's license",
        "licenKe all rightsé reserved",
    ])
    spans = {i: [(s["label"], s["start"], s["stop"]) for s in r["detections"]] for i, r in got.items()}
    assert spans[0] == [("gpl-3.0", 0, 15)] and [s["label"] for s in got[0]["base"]] == ["gpl"]
    assert spans[1] == [("spdx", 0, 4)]
    assert spans[2] == [("mit", 0, 2), ("mit", 2, 4), ("mit", 4, 10)]
    assert spans[3] == [] and spans[5] == [] and spans[6] == [] and got[6]["base"] == []
    assert [s["start"] for s in got[4]["base"]] == [0, 2, 4, 6] and ("cc-by-versioned", 6, 10) in spans[4]


def test_nulls_empty_long_repeated_and_empty_table(spark):
    long = "cc by " * 20000
    got = scan(spark, [None, "", "  --", long, "cc by", "cc by"])
    assert [got[i]["n_words"] for i in range(6)] == [0, 0, 0, 40000, 2, 2]
    assert len(got[3]["base"]) == 20000 and got[3]["base"][-1]["start"] == 39998
    assert got[4]["base"] == got[5]["base"]
    assert L.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_hundreds_of_rules_compile(spark):
    assert len(L.RULES) > 250
    for r in L.RULES:
        re.compile(r.regex)


def sample(regex):
    """The shortest plain text of a rule: options left out, the first of alternatives."""
    text = re.sub(r"\(\?:((?:[^()]|\([^()]*\))*)\)\?", "", regex.replace("licen[sc]e", "license"))
    text = re.sub(r"\(\?:([^()|]*)[^()]*\)", r"\1", text)
    return " ".join(re.sub(r" \?", "", text.split("|")[0]).split())


def test_every_further_name_is_found(spark):
    assert len(L.NAMES) + len(L.MORE_NAMES) + len(L.OTHERS) + len(L.BASE) > 220
    assert len({r for _, _, r in L.MORE_NAMES}) == len({x for x, _, _ in L.MORE_NAMES}) == len(L.MORE_NAMES)
    texts = [f"Some words, then the {sample(r)}. More words." for _, _, r in L.MORE_NAMES]
    for (label, keyword, regex), text in zip(L.MORE_NAMES, texts):
        assert re.search(rf"(?<= )(?:{regex})(?= )", " " + " ".join(WORDS.findall(text.lower())) + " "), (label, text)
        assert keyword in text.lower(), (label, text)
    got = scan(spark, [*texts, "We stick to the wine list of the bzip2 and unicode people."])
    for i, (label, _, _) in enumerate(L.MORE_NAMES):
        assert label in {x["label"] for x in got[i]["detections"]}, (label, texts[i])
    assert got[len(texts)]["detections"] == []


def test_extra_columns_of_the_same_names(spark):
    df = spark.createDataFrame([(1, "MIT license", "mine", 5)], "doc_id long, text string, base string, n_words int")
    got = L.scan(df)
    assert got.columns == ["doc_id", "text", "n_words", "base", "detections"]
    assert got.collect()[0]["n_words"] == 2 and got.collect()[0]["base"] == []
