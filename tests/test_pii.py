import re
import time

from pyspark.sql import functions as F

from agentlake.functions.pii import CATEGORIES, PII_GROUPED, pii_matches, redact_text, token_names, tokenize


def _redact(spark, s):
    return spark.createDataFrame([(s,)], "t string").select(redact_text(F.col("t")).alias("r")).first()["r"]


def test_redaction_vectors(spark):
    assert "[REDACTED_PII]" in _redact(spark, "card 4111 1111 1111 1111 please")
    assert _redact(spark, "mail me at a.b@example.com") == "mail me at [REDACTED_PII]"
    clean = "Send 12 crates of pears to the harbour before 9 tomorrow."
    assert _redact(spark, clean) == clean
    # SSN with dashes is not covered by the pattern
    assert _redact(spark, "ssn 123-45-6789") == "ssn 123-45-6789"
    # the leading parenthesis of a phone number stays
    assert _redact(spark, "call (743) 555-3824") == "call ([REDACTED_PII]"


def test_redaction_idempotent(spark):
    s = "x 4111-1111-1111-1111 y a@b.io"
    once = _redact(spark, s)
    assert _redact(spark, once) == once


def test_categories(spark):
    df = spark.createDataFrame([("a@b.io and 123456789012 and HDFC0ABC123",)], "t string")
    m = df.select(pii_matches(F.col("t")).alias("m")).first()["m"]
    assert [x["category"] for x in m] == ["EMAIL", "AADHAAR", "IFSC"]


def test_one_rule_for_letters_and_digits_of_any_script(spark):
    from agentlake.plans.pii_payloads import redact_json_text
    cases = [
        ("é123456789", "é123456789"), ("ab123456789", "ab123456789"), ("x 123456789 y", "x [REDACTED_PII] y"), ("(123456789)é", "([REDACTED_PII])é"),
        ("\u0661\u0662\u0663\u0664\u0665\u0666\u0667\u0668\u0669", "[REDACTED_PII]"), ("4111\u00a01111\u00a01111\u00a01111", "4111\u00a01111\u00a01111\u00a01111"),
        ("4111\t1111 1111-1111", "[REDACTED_PII]"), ("ü@example.com", "ü@example.com"), ("jo@exämple.com", "jo@exämple.com"),
    ]
    for text, want in cases:
        assert _redact(spark, text) == want, text
        assert redact_json_text('["%s"]' % text.replace("\t", "\\t")) == '["%s"]' % want, text


ODD = ["", "none 12", "a(743) 555-3824 (743) 555-3824 +1 743-555-3824", "\u00e9.foo@bar.com a.b@c.io, a.b@c.io x@y.org", "4111 1111 1111 1111 4111-1111-1111 411111111111",
       "123456789 HDFC0ABC123 123456789 1234567890 HDFC0ABC124", "\u0661\u0662\u0663\u0664\u0665\u0666\u0667\u0668\u0669 123456789", "4111\t1111\n1111 x a@b.io]", "\u00e9 [EMAIL_1] jo@b.io"]


def _expected(text):
    found = [next((CATEGORIES[i], g) for i, g in enumerate(m.groups()) if g) for m in re.finditer(PII_GROUPED.removeprefix("(?U)"), text)]
    seen = {}
    for category, value in found:
        seen.setdefault(category, {}).setdefault(value, len(seen[category]) + 1)
    names = iter([f"[{c}_{seen[c][v]}]" for c, v in found])
    return found, re.sub(PII_GROUPED.removeprefix("(?U)"), lambda _: next(names), text)


def test_matches_and_tokens_equal_a_scan(spark):
    m = pii_matches(F.col("t"))
    df = spark.createDataFrame([(t,) for t in [*ODD, None]], "t string").withColumn("m", m)
    rows = df.select("m", tokenize(F.col("t"), F.col("m"), token_names(F.col("m"))).alias("k")).collect()
    for t, r in zip(ODD, rows[:-1], strict=True):
        found, tokens = _expected(t)
        assert ([(x["category"], x["value"]) for x in r["m"]], [x["idx"] for x in r["m"]], r["k"]) == (found, [*range(1, len(found) + 1)], tokens), t
    assert rows[-1]["m"] is None and rows[-1]["k"] is None


def test_work_grows_with_the_matches(spark, tmp_path):
    from agentlake.plans import pii as P
    n = 3000
    texts = [(0, " ".join(f"user{i}@mail.example.com wrote" for i in range(n))), (1, "a@b.io a@b.io 123456789"), (1, "a@b.io a@b.io 123456789"), (2, "none"), (3, None), (None, "a@b.io")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    P.pii_entities(spark, str(tmp_path)).count()
    t = time.time()
    assert sorted(map(tuple, P.detokenize(spark, str(tmp_path)).collect())) == [(0, n), (1, 6)]
    r = P.tokenize_pii(spark, str(tmp_path)).where("doc_id = 0").first()
    assert (r["matches"], r["tokenized"]) == (n, " ".join(f"[EMAIL_{i + 1}] wrote" for i in range(n)))
    assert time.time() - t < 30  # searching the text again for each match takes minutes
