"""Counts, checks and access statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from kvloom.functions import capacity as C
from kvloom.operators.read import neighbours


def size_of(column):
    """Bytes of a value as it is stored: text and binary by length, numbers in eight bytes."""
    return F.octet_length(column)


def length(t: DataFrame) -> DataFrame:
    """One row (entries)."""
    return t.agg(F.count("*").alias("entries"))


def is_empty(t: DataFrame) -> DataFrame:
    """One row (empty); reads at most one row."""
    return t.limit(1).agg((F.count("*") == 0).alias("empty"))


def value_bytes(t: DataFrame) -> DataFrame:
    """One row (entries, value_bytes)."""
    return t.agg(F.count("*").alias("entries"), F.coalesce(F.sum(F.octet_length("value")), F.lit(0)).cast("long").alias("value_bytes"))


def stat(t: DataFrame) -> DataFrame:
    """One row: entries, bytes of keys and values, overflow entries and their pages."""
    k, v = F.octet_length("key"), F.octet_length("value")
    over = C.needs_overflow(k, v)
    return t.agg(
        F.count("*").alias("entries"),
        F.coalesce(F.sum(k), F.lit(0)).cast("long").alias("key_bytes"),
        F.coalesce(F.sum(v), F.lit(0)).cast("long").alias("value_bytes"),
        F.coalesce(F.sum(F.when(over, 1).otherwise(0)), F.lit(0)).cast("long").alias("overflow_entries"),
        F.coalesce(F.sum(F.when(over, C.overflow_pages(v)).otherwise(0)), F.lit(0)).cast("long").alias("overflow_pages"),
    )


def unsorted(t: DataFrame) -> DataFrame:
    """Rows (ordered by column ``pos``) whose key is not less than the next one's: the places where a sequence is not sorted."""
    step = neighbours(t.select(F.col("pos").alias("key"), F.col("key").alias("k")), carry="k").where("next_key IS NOT NULL")
    return step.where("NOT k < next_k").select(F.col("key").alias("pos"), F.col("k").alias("key"), F.col("next_k").alias("next_key"))


def repeated(t: DataFrame) -> DataFrame:
    """(key, n) of keys that occur more than once; none in a sound table."""
    return t.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")


def file_ranges(t: DataFrame) -> DataFrame:
    """(file, entries, low, high) of the files behind a table: what a scan can skip by."""
    return t.groupBy(F.input_file_name().alias("file")).agg(F.count("*").alias("entries"), F.min("key").alias("low"), F.max("key").alias("high"))


def leaf_entries(t: DataFrame) -> DataFrame:
    """(file, key, value) in hexadecimal: what the files behind a table hold, as it lies there."""
    return t.select(F.input_file_name().alias("file"), F.hex("key").alias("key"), F.hex("value").alias("value"))


def overlapping_files(t: DataFrame) -> DataFrame:
    """Files whose key range begins inside that of a file before; none in a table written in key order. One row a file is put in order."""
    before = F.max("high").over(W.orderBy("low", "high", "file").rowsBetween(W.unboundedPreceding, -1))
    return file_ranges(t).withColumn("_before", before).where("low <= _before").drop("_before")


def shared_prefix(t: DataFrame) -> DataFrame:
    """(key, prefix_len): bytes that each key shares with the key before it, 0 for the first."""
    n = neighbours(t.select("key"))
    a, b = F.hex("key"), F.hex(F.coalesce("prev_key", F.lit("").cast(t.schema["key"].dataType)))
    both = F.least(F.length(a), F.length(b)) / 2
    same = F.filter(F.sequence(F.lit(0), both.cast("int")), lambda i: F.substr(a, F.lit(1), i * 2) == F.substr(b, F.lit(1), i * 2))
    return n.select("key", F.array_max(same).cast("long").alias("prefix_len"))


def access_pattern(accesses: DataFrame) -> DataFrame:
    """One row (sequential, random, bulk, pattern) of accesses (pos, page, is_bulk).

    A page is sequential if it is next to the page before; bulk accesses are counted apart and do not
    change what came before.
    """
    singles = accesses.where("NOT is_bulk").select(F.col("pos").alias("key"), "page")
    steps = neighbours(singles, carry="page")
    near = F.coalesce(F.abs(F.col("page") - F.col("prev_page")) == 1, F.lit(False))
    counts = steps.agg(F.coalesce(F.sum(F.when(near, 1).otherwise(0)), F.lit(0)).cast("long").alias("sequential"), F.coalesce(F.sum(F.when(near, 0).otherwise(1)), F.lit(0)).cast("long").alias("random"))
    bulk = accesses.agg(F.coalesce(F.sum(F.when(F.col("is_bulk"), 1).otherwise(0)), F.lit(0)).cast("long").alias("bulk"))
    total = F.col("sequential") + F.col("random") + F.col("bulk")
    share = lambda c: F.col(c) / total
    pattern = F.when(total == 0, "mixed").when(share("bulk") > 0.5, "bulk").when(share("sequential") > 0.7, "sequential").when(share("sequential") < 0.3, "random").otherwise("mixed")
    return counts.join(F.broadcast(bulk)).withColumn("pattern", pattern)


def fill_stats(pages: DataFrame) -> DataFrame:
    """One row over pages (used_bytes): pages, mean utilization, full pages (0.9 and more), pages that should split."""
    u = C.utilization(F.col("used_bytes"))
    return pages.agg(
        F.count("*").alias("pages"),
        F.avg(u).alias("avg_utilization"),
        F.coalesce(F.sum(F.when(u >= 0.9, 1).otherwise(0)), F.lit(0)).cast("long").alias("full_pages"),
        F.coalesce(F.sum(F.when(C.should_split(F.col("used_bytes")), 1).otherwise(0)), F.lit(0)).cast("long").alias("split_pages"),
    )


def readers(slots: DataFrame, now: float, stale_seconds: float = 300.0) -> DataFrame:
    """One row over reader slots (pid, txn_id, since): count, oldest transaction, stale readers."""
    age = F.lit(float(now)) - F.col("since")
    return slots.agg(
        F.count("*").alias("readers"),
        F.min("txn_id").alias("oldest_txn"),
        F.coalesce(F.sum(F.when(age > stale_seconds, 1).otherwise(0)), F.lit(0)).cast("long").alias("stale"),
        F.max(age).alias("oldest_age"),
    )


def observed(t: DataFrame, name: str = "reads") -> tuple[DataFrame, Observation]:
    """``t`` and counters (rows, bytes) that are filled by whatever action reads it next."""
    seen = Observation(name)
    counted = t.observe(seen, F.count("*").alias("rows"), F.coalesce(F.sum(F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0))), F.lit(0)).alias("bytes"))
    return counted, seen
