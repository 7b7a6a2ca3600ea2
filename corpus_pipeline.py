"""A corpus pipeline: quality rules, near-duplicates, decontamination, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept;
all but the last return the columns of documents. Between stages the documents
are written as Parquet in the shared folder and read again.

Cases: rows are the same document if they share doc_id, null included, and text;
they share its fate, and of those the near-duplicate stage leaves one. Unlike texts under one
doc_id are documents of their own. A null text fails the quality rules;
an empty table passes through as an empty one; further columns stay up to packing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixmill.llm import decontam, jaccard, packing, pii, quality
from helixmill.llm.common import Tables, table, written


def _key() -> Column:
    """A document's key, by which the stages address it."""
    return F.xxhash64(F.col("doc_id").isNull(), "doc_id", "text")


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with their keys for doc_ids."""
    return docs.withColumn("doc_id", _key())


def _without(docs: DataFrame, bad: DataFrame) -> DataFrame:
    """docs but those whose key is a doc_id in bad."""
    gone = written(bad.select(F.col("doc_id").alias("gone_")).distinct(), "gone")
    return docs.join(gone, _key() == F.col("gone_"), "left_anti")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules and the outlier test keep."""
    return _without(docs, quality.judged(_keyed(docs)).where("NOT kept"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id, null the largest, of each class of the Jaccard join."""
    classes = written(jaccard.jaccard_classes(_keyed(docs)).groupBy(F.col("doc_id").alias("key_"), "component_id").count(), "classes")
    ids = docs.select("doc_id", _key().alias("key_")).distinct().join(classes, "key_")
    first = written(ids.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key_")).alias("first")).select(F.col("first.key_").alias("first_")), "first")
    kept = docs.join(first, _key() == F.col("first_"), "left_semi")
    again = classes.where("count > 1").limit(1).count()
    return kept.dropDuplicates(["doc_id", "text"]) if again else kept


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return _without(docs, decontam.leaks(_keyed(docs), table(spark, sf_dir, "benchmark")))


def masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data masked in their texts."""
    return pii.masked_documents(docs, pii.learned(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 4096 tokens."""
    return packing.packed_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontaminated", decontaminated),
    ("masked", masked),
    ("packed", packed),
]

#: SQL cannot express the models of the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs, tables = table(spark, sf_dir, "documents"), Tables(spark)
    for name, stage in STAGES[:-1]:
        docs, before = tables.put(name, stage(spark, docs, sf_dir)), list(tables.paths)
        tables.drop(*before[:-1])
    return STAGES[-1][1](spark, docs, sf_dir)
