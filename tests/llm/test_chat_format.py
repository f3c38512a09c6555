import json

from pyspark.sql import functions as F

from agentlake.llm import chat_format as C


def turns_of(spark, payloads):
    df = spark.createDataFrame([(1, i, p, "x") for i, p in enumerate(payloads)], "conv_id long, seq long, payload string, role string")
    return [(r["role"], r["text"]) for r in C.canonical_turns(df).orderBy("seq", "pos").collect()], C.unmatched(df.select("conv_id", "seq", "payload")).collect()


def test_layouts_give_the_same_turns(spark):
    want = [("user", "a"), ("assistant", "b")]
    same = [
        {"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}], "id": 3},
        {"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}]},
        {"prompt": "a", "completion": "b"},
        {"instruction": "a", "output": "b", "id": "k"},
    ]
    for record in same:
        got, bad = turns_of(spark, [json.dumps(record)])
        assert got == want and not bad, record
    got, _ = turns_of(spark, [json.dumps({"system": "s", "prompt": "a", "completion": "b"})])
    assert got == [("system", "s"), *want]
    got, _ = turns_of(spark, [json.dumps({"message": {"author": {"role": "tool"}, "content": {"parts": ["z"]}}})])
    assert got == [("tool", "z")]


def test_unknown_null_and_broken_records_are_kept_apart(spark):
    got, bad = turns_of(spark, [None, "", "{", '{"messages": []}', '{"role": "user", "content": null}', '{"surprise": 1}'])
    assert got == [("user", "")]
    assert [b["seq"] for b in bad] == [0, 1, 2, 3, 5]


def test_round_trip_with_control_strings_nulls_ties_and_long_texts(spark):
    nasty = ["", None, "\\", "<|turn|>", "<\\|turn|>", "<", "<<|end|>", "</s>[INST] ok [/INST]", "<<SYS>>x<</SYS>>", "\\\\<|", "é\U0001F600\n" * 30000, "same", "same"]
    rows = [(9, i // 2, 0, "assistant" if i % 3 else None, t) for i, t in enumerate(nasty)]
    df = spark.createDataFrame(rows, "conv_id long, seq long, pos int, role string, text string")
    formatted = C.format_conversations(df)
    back = C.read_back(formatted).collect()[0]
    want = sorted((r[1], r[3] or "", r[4] or "") for r in rows)
    assert [(t["role"], t["text"]) for t in back["turns"]] == [w[1:] for w in want]
    assert back["loss_text"] == "".join(w[2] for w in want if w[1] == "assistant")
    f = formatted.collect()[0]
    for span, (_, role, text) in zip(f["turn_spans"], want):
        piece = f["formatted"][span["text_start"]:span["text_start"] + span["text_len"]]
        assert piece.replace("\\\\", "\0").replace("\\", "").replace("\0", "\\") == text and span["loss"] == (role == "assistant")


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, seq long, payload string")
    assert C.read_back(C.format_conversations(C.canonical_turns(df))).count() == 0


def test_hash_of_declared_shape_is_hash_of_record_shape(spark):
    rec = F.try_parse_json(F.lit('{"role": "a", "content": 5}'))
    got = spark.range(1).select(C.shape(rec).alias("s")).collect()[0]["s"]
    assert got in C.shapes(C.LAYOUTS[0])
