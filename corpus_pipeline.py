"""The corpus pipeline: raw documents -> a mixed, ordered training corpus.

Every stage takes (spark, docs, sf_dir) and returns a frame; all but the last
return the columns of ``documents``. A stage works on all that the one before
kept. Null and empty texts, repeated rows and empty tables go through as the
operators define them; of documents that are duplicates one row stays, also where
doc_ids are missing or repeated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agentlake.llm import decontaminate, jaccard, mixing, pseudonyms, quality
from agentlake.llm.common import read, stored
from agentlake.llm.queries import PII_KEY
from agentlake.session import ship_package

#: A document goes if it is likelier of low than of high quality.
LEAST_QUALITY = 0.5

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from all labelled ones it is given."""
    ship_package(spark)
    model = quality.fit(docs, read(spark, sf_dir, "labels"))
    return quality.scored(docs.select(*COLUMNS), model, "__score").where(F.col("__score") >= LEAST_QUALITY).drop("__score")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of similar documents, that of the least doc_id (then any):
    five-word shingles, similarity 0.8. Documents without a word are similar to none."""
    ship_package(spark)
    docs = docs.select(*COLUMNS)
    rows, ids = docs.agg(F.count("*"), F.count_distinct("doc_id")).collect()[0]
    if rows == ids:
        found = jaccard.join(docs, k=5, num=80, den=100)
        later = found.where(F.col("component_id") != F.col("doc_id")).select("doc_id")
        return docs.join(later, "doc_id", "left_anti")
    # ids are missing or repeated: rows get numbers of their own, written so that they stay the same
    numbered = stored(docs.withColumn("row", F.monotonically_increasing_id()), "numbered")
    found = jaccard.join(numbered.select(F.col("row").alias("doc_id"), "text"), k=5, num=80, den=100).select(F.col("doc_id").alias("row"), "component_id")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row")
    first = numbered.select("doc_id", "row").join(found, "row").groupBy("component_id").agg(F.min_by("row", order).alias("row"))
    return numbered.join(first.select("row"), "row", "left_semi").select(*COLUMNS)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item stands."""
    ship_package(spark)
    return decontaminate.clean(docs.select(*COLUMNS), read(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal values replaced by pseudonyms."""
    ship_package(spark)
    done = pseudonyms.pseudonymize(docs.select(*COLUMNS), PII_KEY)
    return done.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training corpus: a row for each time a document is taken, sorted by its position."""
    return mixing.mix(docs, keep=("text", "lang", "n_chars"))


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontaminate_stage),
    ("pii", pii_stage),
    ("mixing", mixing_stage),
]

#: A trained model and similarity components have no SQL form; tests/llm/test_pipeline.py checks every stage by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written to the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
