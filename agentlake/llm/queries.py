"""One query for each operator of this folder, over its whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from agentlake.llm import (chat_format, decontaminate, html_text, jaccard, license_scan, mixing, pseudonyms, quality, ranked_search, simhash, suffix_dedup,
                           tokenizer_alignment, topk)
from agentlake.llm.common import read

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def deco(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn
    return deco


# -- 1: chat formatting -------------------------------------------------------------------------------------------------

def conversation_records(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) -> (conv_id, seq, payload): one JSON record a
    row, in a layout that depends on a hash of the row, as crawled sources mix them."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    said = F.struct(role.alias("role"), text.alias("content"))
    other = {"user": "human", "assistant": "gpt", "system": "system"}
    name = F.coalesce(*[F.when(role == a, b) for a, b in other.items()])
    field = lambda f: F.to_json(F.struct(text.alias(f)))
    k = F.pmod(F.xxhash64("conv_id", "turn"), F.lit(6))
    payload = F.coalesce(
        F.when((k == 0) & name.isNotNull(), F.to_json(F.struct(name.alias("from"), text.alias("value")))),
        F.when(k == 1, F.to_json(F.struct(F.struct(F.struct(role.alias("role")).alias("author"), F.struct(F.array(text).alias("parts")).alias("content")).alias("message")))),
        F.when(k == 2, F.to_json(F.struct(F.array(said).alias("messages")))),
        F.when((k == 3) & (role == "user"), field("prompt")), F.when((k == 4) & (role == "user"), field("instruction")),
        F.when((k == 3) & (role == "assistant"), field("completion")), F.when((k == 4) & (role == "assistant"), field("output")),
        F.when((k == 4) & (role == "system"), field("system")),
        F.to_json(said))
    return rows.select("conv_id", F.col("turn").alias("seq"), payload.alias("payload"))


_OP1_ESC = "replace(replace(replace(replace(replace(replace(replace(replace({}, '\\', '\\\\'), '<|', '<\\|'), '<s>', '<\\s>'), '</s>', '<\\/s>'), '[INST]', '[\\INST]'), '[/INST]', '[\\/INST]'), '<<SYS>>', '<\\<SYS>>'), '<</SYS>>', '<\\</SYS>>')"


@query(sql=f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({len(chat_format.TURN + chat_format.TEXT + chat_format.END)} + length({_OP1_ESC.format('role')}) + length({_OP1_ESC.format('text')})) AS BIGINT) AS formatted_chars
FROM rows GROUP BY conv_id""")
def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -7, formatted and read back."""
    added = spark.sql("SELECT -7L AS conv_id, turn, role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)")
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(added)
    turns = chat_format.canonical_turns(conversation_records(rows))
    back = chat_format.read_back(chat_format.format_conversations(turns))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"),
                       F.char_length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), "formatted_chars")


# -- 8: mixing ------------------------------------------------------------------------------------------------------------

@query(sql=r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
             md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, [5.0::DOUBLE, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w FROM s),
c AS (SELECT *, source_size * 2.0::DOUBLE / w AS ratio FROM r),
l AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE
        - coalesce(sum(source_size * 2.0::DOUBLE) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(w) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM c),
line AS (SELECT arg_min(level, ratio) AS line FROM (SELECT * FROM l WHERE ratio >= level ORDER BY ratio, source NULLS LAST LIMIT 1)),
g AS (SELECT source, source_size, w, CASE WHEN line IS NULL OR ratio < line THEN source_size * 2.0::DOUBLE ELSE line * w END AS target FROM l, line),
p AS (SELECT d.*, g.source_size, g.target, g.w, CAST(floor(g.target) AS BIGINT) AS goal,
        CAST(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS start
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
q AS (SELECT *, goal // greatest(source_size, 1) AS whole, least(greatest(goal - (goal // greatest(source_size, 1)) * source_size - start, 0), size) AS rest FROM p)
SELECT q.doc_id, q.size, q.source_size, q.target, CAST(q.size * q.whole + q.rest AS BIGINT) AS taken, CAST(CASE WHEN q.size > 0 THEN q.whole ELSE 0 END + CASE WHEN q.rest > 0 THEN 1 ELSE 0 END AS BIGINT) AS n_uses,
  CASE WHEN q.size > 0 AND q.whole * q.size + q.rest > 0 THEN
    round(CASE q.w WHEN 2 THEN reached WHEN 5 THEN 1.5 - sqrt(2.25 - 2 * reached)
          ELSE CASE WHEN reached < 0.3125 THEN (sqrt(0.0625 + 3 * reached) - 0.25) / 1.5 ELSE 0.5 + (sqrt(1 + 3 * (reached - 0.3125)) - 1) / 1.5 END END, 6) END AS first_position
FROM (SELECT *, CAST(start AS DOUBLE) / nullif(target, 0) AS reached FROM q) q""")
def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole corpus mixed: the words of each document that its uses take, and where in training the
    first of them stands. Documents are sorted by range of that position, those without a use last."""
    rows = mixing.scheduled(read(spark, sf_dir, "documents"))
    taken = F.aggregate("uses", F.lit(0).cast("long"), lambda n, u: n + u["words"])
    first = F.array_min(F.transform("uses", lambda u: u["position"]))
    rows = rows.select("doc_id", "size", "source_size", "target", taken.alias("taken"), F.size("uses").cast("long").alias("n_uses"), F.round(first, 6).alias("first_position"))
    return rows.repartitionByRange(F.col("first_position").asc_nulls_last(), "doc_id").sortWithinPartitions(F.col("first_position").asc_nulls_last(), "doc_id")


# -- 4: license scans -------------------------------------------------------------------------------------------------------

@query()
def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scanned with all rules."""
    found = license_scan.scan(read(spark, sf_dir, "documents").select("doc_id", "text"))
    starts = F.transform("base", lambda s: s["start"])
    joined = lambda *spans: F.array_join(F.array_sort(F.array_distinct(F.transform(F.concat(*spans), lambda s: s["label"]))), ",")
    return found.select("doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
                        joined(F.col("base")).alias("base_labels"), joined(F.col("base"), F.col("detections")).alias("labels"),
                        license_scan.score(F.col("base"), F.col("detections")).alias("score"))


# -- 5: quality classifier --------------------------------------------------------------------------------------------------

def held_out() -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2


@query()
def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored by a model that never saw the labels held out."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, read(spark, sf_dir, "labels"), allowed=~held_out())
    return quality.scored(docs, model).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


# -- 9: PII -------------------------------------------------------------------------------------------------------------------

#: Stands for the secret that a deployment passes in.
PII_KEY = b"documents-2024"


@query()
def op9_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal values replaced."""
    done = pseudonyms.pseudonymize(read(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY)
    return done.select("doc_id", "text", F.col("pii_found").alias("n_found"), F.array_join(F.array_sort(F.map_keys("pii_kinds")), ",").alias("kinds"))


# -- 3: benchmark decontamination -------------------------------------------------------------------------------------------

@query()
def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every place of a benchmark item in any document: doc_id, item_id, distance, start, stop."""
    return decontaminate.leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


# -- 7: n-gram Jaccard join -------------------------------------------------------------------------------------------------

@query()
def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of 4-word shingles are 85 % alike."""
    return jaccard.join(read(spark, sf_dir, "documents"), k=4, num=85, den=100)


# -- 6: exact top-k search ----------------------------------------------------------------------------------------------------

@query(sql="""
WITH v AS (SELECT vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS q FROM embeddings
           WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum([p[1] * p[2] FOR p IN list_zip(a.q, b.q)]) AS BIGINT) AS score
      FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""")
def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best of all other vectors for every hundredth."""
    rows = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), topk.quantised(F.col("embedding"), 1024).alias("vec"))
    return topk.top_k(rows.where("id % 100 = 0"), rows, 10)


# -- 10: HTML extraction ------------------------------------------------------------------------------------------------------

@query()
def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page, by trees trained on a sample of the pages."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url", "html")
    text = html_text.extract(pages, html_text.fit(pages))
    return text.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


# -- 2: suffix-array dedup ------------------------------------------------------------------------------------------------------

@query()
def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the bytes of strings of 100 bytes that start earlier too."""
    done = suffix_dedup.dedup(read(spark, sf_dir, "documents"))
    length = F.aggregate("removed", F.lit(0).cast("long"), lambda n, x: n + x["stop"] - x["start"])
    return done.select("doc_id", "n_bytes", length.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


# -- 11: cross-tokenizer alignment --------------------------------------------------------------------------------------------

#: Vocabulary files that every machine has.
TOKENIZERS = "/opt/tokenizers"


@query()
def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens under both vocabularies, aligned by bytes, with corpus-wide counts of id pairs."""
    return tokenizer_alignment.measure(read(spark, sf_dir, "documents"), f"{TOKENIZERS}/byte_bpe_50k.json", f"{TOKENIZERS}/piece_bpe_32k.model")


# -- 12: ranked lexical search ------------------------------------------------------------------------------------------------

_OP12_TERMS = f"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{ranked_search.TERM}')"


@query(sql=f"""
WITH q AS (SELECT DISTINCT item_id, unnest({_OP12_TERMS}) AS term FROM benchmark),
d AS (SELECT *, CAST(len(ts) AS BIGINT) AS n FROM (SELECT row_number() OVER () AS r, doc_id, {_OP12_TERMS} AS ts FROM documents) WHERE len(ts) > 0),
g AS (SELECT CAST(count(*) AS BIGINT) AS big_n, CAST(sum(n) AS BIGINT) AS big_l FROM d),
f AS (SELECT r, doc_id, n, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT r, doc_id, n, unnest(ts) AS term FROM d)
      WHERE term IN (SELECT term FROM q) GROUP BY r, doc_id, n, term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * max(big_n) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM f, g GROUP BY term),
s AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * big_n) // big_l)))) AS BIGINT) AS score
      FROM f JOIN w USING (term) JOIN q USING (term), g GROUP BY item_id, r, doc_id),
o AS (SELECT item_id, doc_id, score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM o WHERE rank <= 10""")
def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best documents of the whole corpus for every benchmark item."""
    lists = ranked_search.index(read(spark, sf_dir, "documents"))
    return ranked_search.search(lists, read(spark, sf_dir, "benchmark"), 10)


# -- 13: SimHash near-dedup -----------------------------------------------------------------------------------------------------

@query()
def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and the classes that links of at most 3 bits make."""
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"), k=3, most=3)
    return found.select("doc_id", simhash.as_hex(F.col("fingerprint")).alias("fingerprint"), "component_id")
