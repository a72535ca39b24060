"""Held-out marks and bounded samples of labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(key: Column, modulus: int) -> Column:
    """CRC-32 of the key as text, modulo ``modulus``; null for a null key."""
    return F.crc32(key.cast("string").cast("binary")) % modulus


def held_out(key: Column, modulus: int, kept_back: int) -> Column:
    """Whether a row's label is kept back from learning; false for a null key."""
    return F.coalesce(remainder(key, modulus) == kept_back, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, kept_back: int, rows: int) -> DataFrame:
    """(doc_id, text, label) of at most ``rows`` labelled documents that are not held out.

    The rows with the least hash of their id are taken, one a document, so the choice does not
    depend on how the tables are laid out; rows without a label of 0 or 1 are left out. The
    chosen ids are at most ``rows``, which is why they are broadcast. Where documents repeat an
    id, the least of its texts stands for it, so no more than ``rows`` come back.
    """
    chosen = (
        labels.select(F.col("doc_id").alias("doc_id"), F.col(label).cast("int").alias("label"))
        .where(F.col("label").isin(0, 1) & ~held_out(F.col("doc_id"), modulus, kept_back) & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label"))
