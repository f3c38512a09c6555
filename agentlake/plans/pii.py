"""Queries: PII scan, redaction, entities, tokenisation, compliance rollups,
region resolution and residency (X14–X16, A11, P28, P29, J11)."""

from __future__ import annotations

import ipaddress

from pyspark.sql import functions as F

from agentlake.functions import pii as PII
from agentlake.operators import network
from agentlake.operators.dims import bounded
from agentlake.plans.registry import query
from agentlake.session import written
from agentlake.sources import dimensions as D
from agentlake.sources import views as V
from agentlake.sources.tables import read

DUCK_PII = PII.PII_PATTERN
DUCK_GROUPED = PII.PII_GROUPED.removeprefix("(?U)")
_CAT_CASE = " ".join(f"WHEN g{i + 1}[i] <> '' THEN '{c}'" for i, c in enumerate(PII.CATEGORIES))
_GROUP_COLS = ", ".join(f"regexp_extract_all(text, '{DUCK_GROUPED}', {i + 1}) AS g{i + 1}"
                        for i in range(len(PII.CATEGORIES)))

ENTITIES_SQL = f"""
SELECT doc_id, CAST(i AS INTEGER) AS idx, CASE {_CAT_CASE} END AS category, m0[i] AS value
FROM (SELECT doc_id, m0, {", ".join(f"g{i + 1}" for i in range(len(PII.CATEGORIES)))},
             unnest(range(1, len(m0) + 1)) AS i
      FROM (SELECT doc_id, regexp_extract_all(text, '{DUCK_GROUPED}', 0) AS m0, {_GROUP_COLS} FROM documents))
"""


def matched(df, text_col="text"):
    """The rows with PII, and their matches as m."""
    return df.where(PII.has_pii(F.col(text_col))).withColumn("m", PII.pii_matches(F.col(text_col)))


def entities(df, text_col="text", id_col="doc_id"):
    rows = df if "m" in df.columns else matched(df, text_col)
    # all rows have matches: the outer form only spares the filter on m, which would search the texts again
    return rows.select(id_col, F.explode_outer("m").alias("m")).select(id_col, F.col("m.idx").cast("int").alias("idx"), "m.category", "m.value")


@query("redact_text", bench=True, sql=f"""
SELECT doc_id, regexp_replace(text, '{DUCK_PII}', '[REDACTED_PII]', 'g') AS redacted,
       regexp_matches(text, '{DUCK_PII}') AS had_pii
FROM documents
""")
def redact_text(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", "text")
    return d.select("doc_id", PII.redact_text(F.col("text")).alias("redacted"),
                    PII.has_pii(F.col("text")).alias("had_pii"))


@query("pii_entities", sql=ENTITIES_SQL)
def pii_entities(spark, sf_dir):
    return entities(read(spark, sf_dir, "documents").select("doc_id", "text"))


@query("tokenize_pii", sql=f"""
WITH e AS ({ENTITIES_SQL}),
f AS (SELECT doc_id, category, value, min(idx) AS first_idx FROM e GROUP BY ALL),
n AS (SELECT *, dense_rank() OVER (PARTITION BY doc_id, category ORDER BY first_idx) AS n FROM f),
tok AS (SELECT e.doc_id, e.idx, '[' || e.category || '_' || n.n || ']' AS token
        FROM e JOIN n USING (doc_id, category, value)),
agg AS (SELECT doc_id, list(token ORDER BY idx) AS tokens FROM tok GROUP BY doc_id)
SELECT d.doc_id, CAST(len(a.tokens) AS INTEGER) AS matches,
       array_to_string(list_transform(a.tokens, lambda t, i: p[i] || t), '') || p[len(p)] AS tokenized
FROM (SELECT doc_id, regexp_split_to_array(text, '{DUCK_PII}') AS p FROM documents) d
JOIN agg a USING (doc_id)
""")
def tokenize_pii(spark, sf_dir):
    """Numbered tokens ``[EMAIL_1]`` per (document, category) by first appearance.

    Computed inside each row with array functions: no shuffle, no Python.
    """
    return tokenized(matched(read(spark, sf_dir, "documents").select("doc_id", "text")))


def tokenized(rows):
    return rows.select("doc_id", F.size("m").alias("matches"), PII.tokenize(F.col("text"), F.col("m"), PII.token_names(F.col("m"))).alias("tokenized"))


@query("detokenize", sql=f"""
WITH e AS ({ENTITIES_SQL})
SELECT doc_id, count(*) AS matches FROM e GROUP BY doc_id
""")
def detokenize(spark, sf_dir):
    """Round trip: tokenised text + token map -> original text; reports matches
    of documents whose round trip restores the original exactly."""
    # the one search of the texts: all steps read the rows with PII and their matches
    d = written(matched(read(spark, sf_dir, "documents").select("doc_id", "text")), "pii")
    t = tokenized(d)
    e = entities(d)
    # token -> value map per document (tokens are unique per value and category)
    tok = tokenize_pii_tokens(d)
    mp = tok.groupBy("doc_id").agg(F.map_from_entries(F.array_distinct(F.collect_list(
        F.struct("token", "value")))).alias("tmap"))
    back = t.join(mp, "doc_id").withColumn(
        "restored", F.aggregate(F.map_entries("tmap"), F.col("tokenized"),
                                lambda acc, kv: F.replace(acc, kv["key"], kv["value"])))
    ok = back.join(d, "doc_id").filter(F.col("restored") == F.col("text")).select("doc_id")
    return e.join(ok, "doc_id", "left_semi").groupBy("doc_id").agg(F.count(F.lit(1)).alias("matches"))


def tokenize_pii_tokens(d):
    e = entities(d)
    first = e.groupBy("doc_id", "category", "value").agg(F.min("idx").alias("first_idx"))
    from pyspark.sql import Window
    w = Window.partitionBy("doc_id", "category").orderBy("first_idx")
    return first.select("doc_id", "value", F.concat(F.lit("["), "category", F.lit("_"),
                                                    F.dense_rank().over(w).cast("string"), F.lit("]")).alias("token"))


@query("compliance_totals", sql=f"""
WITH e AS ({ENTITIES_SQL})
SELECT (SELECT count(*) FROM documents) AS scanned,
       (SELECT count(DISTINCT doc_id) FROM e) AS docs_with_pii,
       (SELECT count(*) FROM e) AS matches,
       (SELECT count(*) FROM documents WHERE regexp_matches(lower(text),
          'ignore previous instructions|you are now acting as|jailbreak|system prompt bypass')) AS injection_flags
""")
def compliance_totals(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", "text")
    m = F.size(PII.pii_matches(F.col("text")))
    return d.agg(F.count(F.lit(1)).alias("scanned"),
                 F.count_if(m > 0).alias("docs_with_pii"),
                 F.sum(m).cast("bigint").alias("matches"),
                 F.count_if(PII.injection_flag(F.col("text"))).alias("injection_flags"))


@query("pii_categories", sql=f"""
WITH e AS ({ENTITIES_SQL})
SELECT category, count(*) AS matches, count(DISTINCT doc_id) AS docs FROM e GROUP BY category
""")
def pii_categories(spark, sf_dir):
    e = entities(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return e.groupBy("category").agg(F.count(F.lit(1)).alias("matches"), F.countDistinct("doc_id").alias("docs"))


@query("pii_timeline", sql=f"""
WITH e AS ({ENTITIES_SQL})
SELECT (doc_id // 600) * 600 AS bucket_sec, count(*) AS matches, count(DISTINCT doc_id) AS docs
FROM e GROUP BY ALL
""")
def pii_timeline(spark, sf_dir):
    # documents carry no time: the cache-log clock (sec = doc_id) buckets them in 10 minutes
    e = entities(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return (e.groupBy((F.floor(F.col("doc_id") / 600) * 600).cast("bigint").alias("bucket_sec"))
            .agg(F.count(F.lit(1)).alias("matches"), F.countDistinct("doc_id").alias("docs")))


@query("injection_flag", sql="""
SELECT 'documents' AS source, count(*) FILTER (WHERE flagged) AS flagged, count(*) AS scanned FROM (
  SELECT regexp_matches(lower(text), 'ignore previous instructions|you are now acting as|jailbreak|system prompt bypass')
         AS flagged FROM documents)
UNION ALL
SELECT 'conversations', count(*) FILTER (WHERE flagged), count(*) FROM (
  SELECT regexp_matches(lower(text), 'ignore previous instructions|you are now acting as|jailbreak|system prompt bypass')
         AS flagged FROM conversations WHERE role = 'user')
""")
def injection_flag(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select(F.lit("documents").alias("source"), "text")
    c = (read(spark, sf_dir, "conversations").filter(F.col("role") == "user")
         .select(F.lit("conversations").alias("source"), "text"))
    u = d.unionByName(c).withColumn("flagged", PII.injection_flag(F.col("text")))
    return u.groupBy("source").agg(F.count_if("flagged").alias("flagged"), F.count(F.lit(1)).alias("scanned"))


# Fixed values (ours): tenant-enforced regions and a table of network prefixes, nested ones among them.
ENFORCED_REGION = [("t-1", "EU"), ("t-5", "IN")]
GEO_PREFIXES = [
    ("0.0.0.0/2", "IN"), ("10.0.0.0/8", "US"), ("10.16.0.0/12", "EU"), ("10.20.0.0/16", "IN"), ("10.20.0.1/32", "US"),
    ("50.0.0.0/7", "US"), ("64.0.0.0/3", "US"), ("96.0.0.0/4", "EU"), ("100.40.0.0/13", "IN"), ("128.0.0.0/4", "EU"),
    ("2001:db8::/32", "US"), ("2001:db8:40::/42", "EU"), ("2001:db8:48::/45", "IN"), ("2001:db8:49::/64", "US"), ("2600::/12", "IN"),
]
# Residency rules (region, regional endpoint, strict isolation).
RESIDENCY = [("IN", "https://in.llm.local", True), ("EU", "https://eu.llm.local", True),
             ("US", "https://us.llm.local", False)]
# Models restricted to US infrastructure (blocked for region IN).
US_ONLY_MODELS = ["o1-preview", "o1-mini"]


def _regions(spark, sf_dir):
    r = V.requests(spark, sf_dir).select("event_id", "tenant_id", "model", "user_region", "user_id", "k")
    net = F.col("user_id") % 200
    v4 = F.concat(net.cast("string"), F.lit("."), F.col("k").cast("string"), F.lit(".0.1"))
    v6 = F.concat(F.lit("2001:DB8:"), F.hex(net), F.lit("::"), F.hex("k"))
    r = r.withColumn("forwarded_for", F.when(F.col("event_id") % 3 == 0, v6).otherwise(v4))
    enf = bounded(D.to_df(spark, ENFORCED_REGION, ["tenant_id", "enforce_region"], ["string", "string"]))
    r = network.with_network(r, "forwarded_for", D.to_df(spark, GEO_PREFIXES, ["cidr", "value"], ["string", "string"]), "geo_region")
    return r.join(enf, "tenant_id", "left").withColumn("region", F.coalesce("user_region", "enforce_region", "geo_region"))


def _geo_sql() -> str:
    """The prefixes as ranges of 128-bit numbers."""
    rows = []
    for cidr, region in GEO_PREFIXES:
        net = ipaddress.ip_network(cidr)
        base = 0xFFFF << 32 if net.version == 4 else 0
        rows.append(f"({base + int(net[0])}::HUGEINT, {base + int(net[-1])}::HUGEINT, {net.prefixlen + (96 if base else 0)}, '{region}')")
    return f"(VALUES {', '.join(rows)}) g(lo, hi, bits, geo_region)"


_REGION_SQL = f"""
SELECT r.*, coalesce(r.user_region, e.enforce_region, g.geo_region) AS region FROM (
  SELECT event_id, tenant_id, model, user_region,
         CASE WHEN event_id % 3 = 0 THEN {0x20010DB8 << 96}::HUGEINT + (user_id % 200)::HUGEINT * {1 << 80}::HUGEINT + k
              ELSE {0xFFFF << 32}::HUGEINT + (user_id % 200) * 16777216 + k * 65536 + 1 END AS address
  FROM v_requests) r
LEFT JOIN ({D.values_sql(ENFORCED_REGION, ["tenant_id", "enforce_region"], ["string", "string"])}) e
  ON e.tenant_id = r.tenant_id
LEFT JOIN (SELECT address, arg_max(geo_region, bits) AS geo_region
           FROM (SELECT DISTINCT CASE WHEN event_id % 3 = 0 THEN {0x20010DB8 << 96}::HUGEINT + (user_id % 200)::HUGEINT * {1 << 80}::HUGEINT + k
                                      ELSE {0xFFFF << 32}::HUGEINT + (user_id % 200) * 16777216 + k * 65536 + 1 END AS address FROM v_requests) a
           JOIN {_geo_sql()} ON a.address BETWEEN g.lo AND g.hi GROUP BY address) g
  ON r.address = g.address
"""


@query("resolve_region", sql=f"""
SELECT region, count(*) AS requests FROM ({_REGION_SQL}) GROUP BY region
""")
def resolve_region(spark, sf_dir):
    return _regions(spark, sf_dir).groupBy("region").agg(F.count(F.lit(1)).alias("requests"))


_RESIDENCY_SQL = f"""
SELECT x.event_id, x.region, x.model,
       coalesce(rr.endpoint, 'default') AS endpoint, coalesce(rr.strict, false) AS strict,
       coalesce(x.region = 'IN' AND x.model IN ('o1-preview', 'o1-mini'), false) AS blocked,
       CASE WHEN x.region = 'IN' AND x.model IN ('o1-preview', 'o1-mini')
            THEN 'Model ''' || x.model || ''' is restricted to US infrastructure and cannot be accessed from region IN (DPDP compliance)'
       END AS reason
FROM ({_REGION_SQL}) x
LEFT JOIN ({D.values_sql(RESIDENCY, ["region", "endpoint", "strict"], ["string", "string", "boolean"])}) rr
  ON rr.region = x.region
"""


def residency(spark, sf_dir):
    x = _regions(spark, sf_dir)
    rr = bounded(D.to_df(spark, RESIDENCY, ["region", "endpoint", "strict"], ["string", "string", "boolean"]))
    blocked = (F.col("region") == "IN") & F.col("model").isin(*US_ONLY_MODELS)
    reason = F.concat(F.lit("Model '"), F.col("model"),
                      F.lit("' is restricted to US infrastructure and cannot be accessed from region IN "
                            "(DPDP compliance)"))
    return (x.join(rr, "region", "left")
            .select("event_id", "region", "model", F.coalesce("endpoint", F.lit("default")).alias("endpoint"),
                    F.coalesce("strict", F.lit(False)).alias("strict"),
                    F.coalesce(blocked, F.lit(False)).alias("blocked"), F.when(blocked, reason).alias("reason")))


@query("residency_check", sql=_RESIDENCY_SQL)
def residency_check(spark, sf_dir):
    return residency(spark, sf_dir)


@query("region_breakdown", sql=f"""
SELECT region, count(*) AS requests, count(*) FILTER (WHERE blocked) AS blocked,
       count(*) FILTER (WHERE strict) AS sovereign_routed
FROM ({_RESIDENCY_SQL}) GROUP BY region
""")
def region_breakdown(spark, sf_dir):
    return residency(spark, sf_dir).groupBy("region").agg(
        F.count(F.lit(1)).alias("requests"), F.count_if("blocked").alias("blocked"),
        F.count_if("strict").alias("sovereign_routed"))


@query("violations", sql=f"""
SELECT 'residency_block' AS kind, count(*) AS events FROM ({_RESIDENCY_SQL}) WHERE blocked
UNION ALL
SELECT 'pii_detected', count(*) FROM documents WHERE regexp_matches(text, '{DUCK_PII}')
""")
def violations(spark, sf_dir):
    res = (residency(spark, sf_dir).filter("blocked")
           .agg(F.count(F.lit(1)).alias("events")).withColumn("kind", F.lit("residency_block")))
    d = read(spark, sf_dir, "documents").select("text")
    pii = (d.filter(PII.has_pii(F.col("text"))).agg(F.count(F.lit(1)).alias("events"))
           .withColumn("kind", F.lit("pii_detected")))
    return res.unionByName(pii).select("kind", "events")
