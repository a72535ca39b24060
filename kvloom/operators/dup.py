"""Tables with sorted sets of values per key: rows (key, value), unique as pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from kvloom.operators.read import bounds, part_of
from kvloom.operators.write import BASE


def put_dup(d: DataFrame, rows: DataFrame) -> DataFrame:
    """The pairs of both; a pair that is there stays once."""
    return d.select("key", "value").unionByName(rows.select("key", "value")).distinct()


def new_keys(d: DataFrame, rows: DataFrame) -> DataFrame:
    """(key, is_new) of each key put: whether it had no value before."""
    old = d.select("key").distinct().withColumn("_old", F.lit(True))
    return rows.select("key").distinct().join(old, "key", "left").select("key", F.col("_old").isNull().alias("is_new"))


def get_all(d: DataFrame, key=None) -> DataFrame:
    """Pairs in order: of one key, or of all."""
    d = d.select("key", "value") if key is None else d.where(F.col("key") == F.lit(key)).select("key", "value")
    return d.orderBy("key", "value")


def as_arrays(d: DataFrame) -> DataFrame:
    """(key, values): each key's values as a sorted array; for keys whose sets fit in memory."""
    return d.groupBy("key").agg(F.sort_array(F.collect_set("value")).alias("values"))


def get(d: DataFrame) -> DataFrame:
    """(key, value): the smallest value of every key."""
    return d.groupBy("key").agg(F.min("value").alias("value"))


def delete_dup(d: DataFrame, pairs: DataFrame) -> DataFrame:
    return d.join(pairs.select("key", "value"), ["key", "value"], "left_anti")


def delete_all(d: DataFrame, keys: DataFrame) -> DataFrame:
    return d.join(keys.select("key"), "key", "left_anti")


def count_values(d: DataFrame) -> DataFrame:
    """(key, n_values)."""
    return d.distinct().groupBy("key").agg(F.count("*").alias("n_values"))


def nth(d: DataFrame, n: int) -> DataFrame:
    """The n-th value of every key that has as many, from 1."""
    return numbered(d).where(F.col("rn") == n).select("key", "value")


def numbered(d: DataFrame) -> DataFrame:
    """(key, value, rn): every value with its place in its key's set.

    Pairs are cut into ranges by key and value, so a hot key's set is counted by many tasks; places
    are shifted by the key's rows in the ranges before. Only keys that lie in several ranges, two a
    border at most, are looked up for that.
    """
    pairs = d.select("key", "value").distinct()
    rank = F.struct(F.col("key").alias("o0"), F.col("value").alias("o1"))
    cuts = bounds(pairs.select(rank.alias("rank")), int(d.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = pairs.withColumn("_part", part_of(rank, cuts))
    sizes = dealt.groupBy("_part", "key").agg(F.count("*").alias("n"))
    split = sizes.groupBy("key").agg(F.count("*").alias("k")).where("k > 1").select("key")
    shift = F.sum("n").over(W.partitionBy("key").orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    before = sizes.join(split, "key").select("_part", "key", shift.alias("_before"))
    own = dealt.withColumn("_rn", F.row_number().over(W.partitionBy("_part", "key").orderBy("value")))
    return own.join(F.broadcast(before), ["_part", "key"], "left").select("key", "value", (F.coalesce("_before", F.lit(0)) + F.col("_rn")).cast("long").alias("rn"))


def representation(d: DataFrame) -> DataFrame:
    """(key, kind): ``single`` for one value, ``sub`` for a set."""
    return count_values(d).select("key", F.when(F.col("n_values") == 1, "single").otherwise("sub").alias("kind"))


def lengths(d: DataFrame) -> DataFrame:
    """One row (n_keys, n_pairs)."""
    per_key = count_values(d)
    return per_key.agg(F.count("*").alias("n_keys"), F.coalesce(F.sum("n_values"), F.lit(0)).cast("long").alias("n_pairs"))


def fold(d: DataFrame, log: DataFrame) -> DataFrame:
    """Pairs after a log (seq, op, key, value) of put_dup, delete_dup, delete (all values of a key) and clear."""
    ops = log.select(F.col("seq").cast("long").alias("seq"), "op", "key", "value")
    cleared = ops.where("op = 'clear'").agg(F.coalesce(F.max("seq"), F.lit(BASE - 1)).cast("long").alias("clear_seq"))
    pairs = d.select(F.lit(BASE).cast("long").alias("seq"), F.lit("put_dup").alias("op"), "key", "value").unionByName(ops.where("op IN ('put_dup', 'delete_dup')"))
    last = pairs.groupBy("key", "value").agg(F.max(F.struct("seq", "op")).alias("r")).where("r.op = 'put_dup'").select("key", "value", F.col("r.seq").alias("seq"))
    gone = ops.where("op = 'delete'").groupBy("key").agg(F.max("seq").alias("gone"))
    left = last.join(gone, "key", "left").join(F.broadcast(cleared))
    return left.where("seq > clear_seq AND (gone IS NULL OR seq > gone)").select("key", "value")
