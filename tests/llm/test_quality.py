import numpy as np

from agentlake.llm import quality as Q
from agentlake.llm import queries

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    got = queries.QUERIES["op5_quality"](spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").collect()
    right = [r["predicted"] == r["quality"] for r in got]
    good = [r["predicted"] == 1 for r in got if r["quality"] == 1]
    assert len(got) > 500 and np.mean(right) > 0.97 and np.mean(good) > 0.98


def brute(text, hasher, table):
    """Sum over features found one by one."""
    raw = text.encode()
    total = n = 0
    for k in hasher.grams:
        for i in range(len(raw) - k + 1):
            total += int(table[hasher.ngrams(np.frombuffer(raw[i:i + k], np.uint8).astype(np.uint64), k)[0]])
            n += 1
    before = None
    for w in raw.replace(b"\t", b" ").replace(b"\n", b" ").split(b" "):
        if w:
            b = np.frombuffer(w, np.uint8)
            bucket = hasher.words(b, b.astype(np.uint64), np.array([0, len(b)]))[1][0]
            total += int(table[bucket]) + int(table[0 if before is None else hasher.pairs(np.array([before, bucket]))[1]])
            n, before = n + 2, bucket
    return total, n


def test_vectorised_sums_equal_brute_force():
    hasher, table = Q.Hasher(), np.random.default_rng(1).integers(-9, 9, 1 << Q.BITS).astype(np.int32)
    texts = ["a b b  b\nc", "", " ", "x", "été é\tété  ", "abc", "no no no yes", "\n\nq"]
    sums, counts = Q.totals([t.encode() for t in texts], table, hasher)
    for t, s, n in zip(texts, sums, counts):
        assert (s, n) == brute(t, hasher, table), t
        ids, c = Q.buckets(t.encode(), hasher)
        assert c.sum() == n and int((table[ids].astype(int) * c).sum()) == s


def test_long_texts_are_whole_and_batches_do_not_matter(spark):
    table = np.random.default_rng(2).integers(-9, 9, 1 << Q.BITS).astype(np.int32)
    long = "word another " * 200000 + "z" * (Q.CHUNK + 5)
    texts = ["a b", long, None, ""] * 2
    df = spark.createDataFrame([(i, t, 1.0) for i, t in enumerate(texts)], "doc_id long, text string, label double")
    a = {r["doc_id"]: r["score"] for r in Q.scored(df.coalesce(1), (table.tobytes(), 0.3)).collect()}
    b = {r["doc_id"]: r["score"] for r in Q.scored(df.repartition(4), (table.tobytes(), 0.3)).collect()}
    assert a == b and a[2] == a[3] == a[6] and abs(a[2] - 1 / (1 + np.exp(-0.3))) < 1e-12 and a[1] == a[5] != a[2]


def test_no_labels_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, None), (None, 1), (5, 1)], "doc_id long, quality int")
    model = Q.fit(docs, labels)
    assert Q.scored(docs, model).collect()[0]["score"] == 0.5
    assert Q.scored(docs.limit(0), model).count() == 0


def test_word_pairs_are_hashed_features():
    hasher = Q.Hasher()
    ids = lambda t: set(Q.buckets(t.encode(), hasher)[0].tolist())
    apart, joined = ids("red") | ids("car"), ids("red car")
    assert len(hasher.pairs(np.array([5, 9, 9, 5, 9]))) == 5
    a = hasher.pairs(np.array([5, 9, 9, 5, 9])).tolist()
    assert a[0] == 0 and a[1] == a[4] != a[3] and a[2] == 1 and a[1] > 1
    assert joined - apart
