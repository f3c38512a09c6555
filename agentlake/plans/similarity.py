"""Queries: exact-cache replay, semantic matching, recency ring, intent."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from agentlake.functions import pii as PII
from agentlake.operators import similarity as S
from agentlake.plans.registry import query
from agentlake.session import checkpoint_dir
from agentlake.sources import views as V
from agentlake.sources.tables import read

# Exact-cache idle TTL (seconds) and probe perturbations by vec_id % 4.
EXACT_IDLE_TTL = 3600
EPS = [0.02, 0.04, 0.06, 0.08]

_DUCK_PII = PII.PII_PATTERN


@query("exact_cache_replay", bench=True, sql=f"""
WITH c AS (
  SELECT doc_id, tenant_id, sec, sha256(body) AS h, regexp_matches(body, '{_DUCK_PII}') AS pii FROM v_cache_log
), s AS (
  SELECT *, lag(sec) OVER (PARTITION BY tenant_id, h ORDER BY sec, doc_id) AS prev FROM c WHERE NOT pii
), i AS (
  SELECT *, sum(CASE WHEN prev IS NULL OR sec - prev >= {EXACT_IDLE_TTL} THEN 1 ELSE 0 END)
              OVER (PARTITION BY tenant_id, h ORDER BY sec, doc_id) AS isl FROM s
), f AS (SELECT *, min(doc_id) OVER (PARTITION BY tenant_id, h, isl) AS first_doc FROM i)
SELECT doc_id, tenant_id, doc_id <> first_doc AS hit, CASE WHEN doc_id <> first_doc THEN first_doc END AS served_from
FROM f
UNION ALL
SELECT doc_id, tenant_id, false, CAST(NULL AS BIGINT) FROM c WHERE pii
""")
def exact_cache_replay(spark, sf_dir):
    """A request hits when an equal (tenant, SHA-256 body) response was
    stored or served less than the idle TTL before it. Bodies with PII are
    stored under their redacted text, so they never hit.

    Runs of a key separated by idle gaps are segments (computed on per-bin
    aggregates, no whole-key window); the stored response of a segment is the
    one of its first request."""
    c = V.cache_log(spark, sf_dir).select("doc_id", "tenant_id", "sec", "body")
    c = c.select("doc_id", "tenant_id", "sec", F.sha2("body", 256).alias("h"), PII.has_pii(F.col("body")).alias("pii"))
    keys = ["tenant_id", "h"]
    b = F.floor(F.col("sec") / EXACT_IDLE_TTL).cast("bigint")
    # per (key, TTL-wide bin): gaps inside a bin are shorter than the TTL, so
    # segments only start at bin starts; the bin table is tiny and carries
    # each segment's first request to every row in one join.
    per_bin = (c.groupBy(*keys, b.alias("_b"))
               .agg(F.min("sec").alias("_lo"), F.max("sec").alias("_hi"),
                    F.min_by("doc_id", F.struct("sec", "doc_id")).alias("_first")))
    wb = Window.partitionBy(*keys).orderBy("_b")
    prev_hi = F.lag("_hi").over(wb)
    per_bin = per_bin.withColumn("_new", F.when(prev_hi.isNull() | (F.col("_lo") - prev_hi >= EXACT_IDLE_TTL), 1)
                                 .otherwise(0))
    per_bin = per_bin.withColumn("_seg", F.sum("_new").over(wb.rowsBetween(Window.unboundedPreceding, 0)))
    ws = Window.partitionBy(*keys, "_seg").orderBy("_b")
    per_bin = per_bin.select(*keys, "_b", F.first("_first").over(ws).alias("first_doc"))
    j = c.withColumn("_b", b).join(per_bin, [*keys, "_b"])
    hit = ~F.col("pii") & (F.col("doc_id") != F.col("first_doc"))
    return j.select("doc_id", "tenant_id", hit.alias("hit"), F.when(hit, F.col("first_doc")).alias("served_from"))


def _entries_probes(spark, sf_dir):
    """Entries and probes of the same vectors. Intent and length are read off the texts once, for both."""
    emb = read(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.col("label").cast("string").alias("tenant"))
    text = F.col("text")
    # read off where the texts lie: no text is shuffled
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), S.primary_interrogative(text).alias("intent"), S.short_prompt(text).alias("short"))
    checkpoint_dir(spark)
    base = emb.join(docs, "vec_id", "left").select("vec_id", "embedding", "tenant", "intent", "short").checkpoint(eager=True)
    entries = base.select("tenant", "vec_id", F.col("embedding").alias("vec"), "intent", F.col("vec_id").alias("seq"))
    eps = F.element_at(F.array(*[F.lit(e) for e in EPS]), (F.col("vec_id") % 4 + 1).cast("int"))
    pvec = F.transform("embedding", lambda x, j: x.cast("double") + eps * ((F.col("vec_id") + j) % 5 - 2))
    probes = base.select("tenant", F.col("vec_id").alias("probe_id"), pvec.alias("vec"), "intent", "short", F.col("vec_id").alias("max_seq"))
    return entries, probes


_SEM_SQL = """
WITH base AS (SELECT e.vec_id, e.embedding, e.label, d.text FROM embeddings e LEFT JOIN documents d ON d.doc_id = e.vec_id),
intent AS (
  SELECT *, CASE WHEN list_contains(['what','who','where','when','why','how','can','is','do','does'], w[1]) THEN w[1]
                 ELSE list_filter(w, lambda x: list_contains(['what','who','where','when','why','how'], x))[1] END AS it
  FROM (SELECT *, list_filter(regexp_split_to_array(lower(txt), '[[:punct:][:space:]]+'), lambda x: x <> '') AS w
        FROM (SELECT *, text AS txt FROM base))
),
pintent AS (
  SELECT *, CASE WHEN list_contains(['what','who','where','when','why','how','can','is','do','does'], w[1]) THEN w[1]
                 ELSE list_filter(w, lambda x: list_contains(['what','who','where','when','why','how'], x))[1] END AS it,
            len(list_filter(regexp_split_to_array(ptxt, '[[:space:]]+'), lambda x: x <> '')) <= 8 AS short
  FROM (SELECT *, list_filter(regexp_split_to_array(lower(ptxt), '[[:punct:][:space:]]+'), lambda x: x <> '') AS w
        FROM (SELECT *, text AS ptxt FROM base))
),
probes AS (
  SELECT vec_id AS probe_id, label, it, short,
         list_transform(embedding, lambda x, j: CAST(x AS DOUBLE) + ([0.02, 0.04, 0.06, 0.08])[vec_id % 4 + 1]
                        * (((vec_id + j - 1) % 5) - 2)) AS v
  FROM pintent
),
pairs AS (
  SELECT p.probe_id, e.vec_id,
         CASE WHEN list_dot_product(p.v, p.v) = 0 OR list_dot_product(e.embedding, e.embedding) = 0 THEN 1.0
              ELSE 1.0 - list_dot_product(p.v, list_transform(e.embedding, lambda x: CAST(x AS DOUBLE)))
                   / (sqrt(list_dot_product(p.v, p.v))
                      * sqrt(list_dot_product(list_transform(e.embedding, lambda x: CAST(x AS DOUBLE)),
                                              list_transform(e.embedding, lambda x: CAST(x AS DOUBLE))))) END AS d,
         p.short, p.it AS pit, e.it AS eit
  FROM probes p JOIN intent e ON e.label = p.label AND e.vec_id <= p.probe_id
)
"""


@query("semantic_match", bench=True, sql=_SEM_SQL + """
SELECT probe_id, arg_min(vec_id, (d, vec_id)) AS vec_id, round(min(d), 6) AS distance
FROM pairs
WHERE d < CASE WHEN short THEN 0.06 ELSE 0.14 END AND NOT (pit IS NOT NULL AND eit IS NOT NULL AND pit <> eit)
GROUP BY probe_id
""")
def semantic_match(spark, sf_dir):
    entries, probes = _entries_probes(spark, sf_dir)
    m = S.nearest(probes, entries)
    return m.select("probe_id", "vec_id", F.round("distance", 6).alias("distance"))


@query("semantic_match_l2", sql=_SEM_SQL.replace("ON e.label = p.label", "ON e.label = p.label AND e.vec_id % 2 = p.probe_id % 2") + """
, top AS (SELECT probe_id, arg_min(vec_id, (d, vec_id)) AS vec_id, min(d) AS d,
                 arg_min(pit, (d, vec_id)) AS pit, arg_min(eit, (d, vec_id)) AS eit
          FROM pairs WHERE d < CASE WHEN short THEN 0.06 ELSE 0.14 END GROUP BY probe_id)
SELECT probe_id, vec_id, round(1 - d, 6) AS similarity_score FROM top
WHERE NOT (pit IS NOT NULL AND eit IS NOT NULL AND pit <> eit)
""")
def semantic_match_l2(spark, sf_dir):
    """Second tier — entries of the same tenant and model; retrieval ignores
    intent, then a mismatching top-1 is a miss."""
    entries, probes = _entries_probes(spark, sf_dir)
    of_model = lambda df, i: df.withColumn("tenant", F.concat("tenant", F.lit("/gpt-"), F.col(i) % 2))
    m = S.nearest(of_model(probes, "probe_id").withColumn("intent", F.lit(None).cast("string")),
                  of_model(entries, "vec_id").withColumn("intent", F.lit(None).cast("string")))
    # a probe and the entry of its number share their text, so one table has both intents
    intents = entries.select("vec_id", "intent")
    j = m.join(intents.select(F.col("vec_id").alias("probe_id"), F.col("intent").alias("pit")), "probe_id").join(intents.withColumnRenamed("intent", "eit"), "vec_id")
    keep = ~(F.col("pit").isNotNull() & F.col("eit").isNotNull() & (F.col("pit") != F.col("eit")))
    return j.filter(keep).select("probe_id", "vec_id", F.round(1 - F.col("distance"), 6).alias("similarity_score"))


@query("semantic_recency", sql="""
SELECT label AS tenant, count(*) FILTER (WHERE vec_id > (SELECT max(vec_id) FROM embeddings) - 5000) AS in_ring,
       count(*) AS entries
FROM embeddings GROUP BY label
""")
def semantic_recency(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings").select("vec_id", "label")
    # the ring bound is a scalar subquery (evaluated once, not joined)
    mx = e.agg(F.max("vec_id")).scalar()
    return (e.groupBy(F.col("label").alias("tenant"))
            .agg(F.count_if(F.col("vec_id") > mx - S.RING_SIZE).alias("in_ring"),
                 F.count(F.lit(1)).alias("entries")))


@query("interrogative", sql="""
SELECT it AS interrogative, count(*) AS prompts FROM (
  SELECT CASE WHEN list_contains(['what','who','where','when','why','how','can','is','do','does'], w[1]) THEN w[1]
              ELSE list_filter(w, lambda x: list_contains(['what','who','where','when','why','how'], x))[1] END AS it
  FROM (SELECT list_filter(regexp_split_to_array(lower(text), '[[:punct:][:space:]]+'), lambda x: x <> '') AS w
        FROM conversations WHERE role = 'user'))
GROUP BY ALL
""")
def interrogative(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").filter(F.col("role") == "user")
    return (c.select(S.primary_interrogative(F.col("text")).alias("interrogative"))
            .groupBy("interrogative").agg(F.count(F.lit(1)).alias("prompts")))
