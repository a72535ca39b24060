"""A training-data pipeline: quality rules, quality classifier, near duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir) and works on every row that the stage before kept; all but the
last return the columns of documents. ``run`` writes each stage's result to the shared folder and
reads it again.

Empty tables pass through every stage as empty; null texts fail the quality rules; rows that repeat a
doc_id, or have none, are documents of their own where near duplicates are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvloom.llm import packing, quality, quality_rules, secrets, shingles
from kvloom.llm.common import cut, drop_path, table
from kvloom.llm.queries import tokenizer


def by_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; the raw corpus is this stage's input."""
    ratios = quality_rules.log_ratios(docs, quality_rules.trusted_ids(table(spark, sf_dir, "labels")))
    return quality_rules.keep(docs, ratios)


def by_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores at its threshold or above.

    It is fitted on the raw corpus: the stage before has dropped most documents labelled bad.
    """
    weights = quality.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality.score(docs, weights, name="_score").where(F.col("_score") >= quality.THRESHOLD).select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates.

    Where ids repeat or are null, rows are joined by numbers of their own, and of a group the first
    row by id stays: no row goes unless its own text is a near copy of one that stays. Dropped ids lie
    in a table, so Spark broadcasts them or shuffles by their size.
    """
    ids = docs.groupBy("doc_id").agg(F.count("*").alias("n"))
    if ids.where("n > 1 OR doc_id IS NULL").isEmpty():
        found = shingles.near_duplicates(docs).select("doc_id", "component_id")
        dropped = cut(found.where("doc_id <> component_id").select("doc_id"), "dropped")
        return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)
    rows = cut(docs.withColumn("_row", F.monotonically_increasing_id()), "numbered")
    found = cut(shingles.near_duplicates(rows.select("_row", "text"), key="_row").select(F.col("doc_id").alias("_row"), "component_id"), "duplicates")
    several = found.groupBy("component_id").agg(F.count("*").alias("n")).where("n > 1").select("component_id")
    grouped = cut(found.join(several, "component_id").join(rows.select("_row", "doc_id"), "_row"), "groups")
    first = grouped.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row")).alias("m")).select(F.col("m._row").alias("_row"))
    dropped = cut(grouped.select("_row").join(first, "_row", "left_anti"), "dropped")
    for used in (found, grouped):
        drop_path(spark, used)
    return rows.join(dropped, "_row", "left_anti").select(*docs.columns)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in their texts masked and n_chars brought up to date."""
    masked = secrets.scan_secrets(docs, redacted="text")
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return masked.select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in their sequences."""
    return packing.digest(docs, tokenizer("byte_bpe_50k.json"))


STAGES = [("quality rules", by_rules), ("quality classifier", by_classifier), ("n-gram Jaccard join", one_of_each), ("secret scans", without_secrets), ("packing", packed)]

#: Hashing, learned weights and tokenizers have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
