"""Writes as a fold of an operation log over a base table.

A log has rows (seq, op, key, value) with unique seq; op is put, put_no_overwrite, update, delete or
clear. Base rows whose key no operation names pass as they are: where the log's keys are few, Spark
broadcasts them and the base is not shuffled. The state of a named key depends on few facts of its
operations, which are all minima and maxima of sequence numbers, so they are hash-aggregated with
partial sums before the shuffle and a hot key costs one row a task; the rows that won are then joined
back by key and number.

Keys are unique. Rows given to ``put``, ``put_no_overwrite`` and ``update`` may repeat a key only if they
carry a column ``seq``, whose greatest row counts; without it a repeated key is an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kvloom.functions.order import LEXICOGRAPHIC, Order

#: Sequence number of rows that were there before the log.
BASE = -1


def as_log(base: DataFrame) -> DataFrame:
    """Base rows as puts before everything."""
    return base.select(F.lit(BASE).cast("long").alias("seq"), F.lit("put").alias("op"), "key", "value")


#: Operations whose effect depends on the state they meet.
CONDITIONAL = ("put_no_overwrite", "update")


def last_clear(log: DataFrame) -> DataFrame:
    """One row (clear_seq): the last clear, or a number before every row."""
    return log.where("op = 'clear'").agg(F.coalesce(F.max("seq"), F.lit(BASE - 1)).cast("long").alias("clear_seq"))


def fold(base: DataFrame, log: DataFrame, order: Order = LEXICOGRAPHIC, conditional: bool = True, clears: bool = True) -> DataFrame:
    """State (key, value) after the log. A caller that knows it to be without conditional operations, or without clears, gets a shorter plan by saying so.

    Per key: what is before the last delete or clear does not count; the first put or
    put_no_overwrite after it brings the key into being; of that row, later puts and later updates,
    the last one holds. Keys that the order calls equal are one key, spelled as it was last put.
    """
    same = order.same(F.col("key"))
    if clears:
        cleared = F.broadcast(last_clear(log))
        after = lambda rows: rows.join(cleared).where("seq > clear_seq").drop("clear_seq")
        log = log.where("op <> 'clear'")
    else:
        after = lambda rows: rows
    ops = log.select(F.col("seq").cast("long").alias("seq"), "op", "key", "value").withColumn("_same", same)
    named = ops.select("_same").distinct()
    old = after(as_log(base).withColumn("_same", same))
    untouched = old.join(named, "_same", "left_anti").select("key", "value")
    every = after(ops)
    if conditional:
        every = old.join(named, "_same", "left_semi").unionByName(every)
    seq_of = lambda *names: F.when(F.col("op").isin(*names), F.col("seq"))
    facts = every.groupBy("_same").agg(F.max(seq_of("delete")).alias("gone"), F.max(seq_of("put")).alias("put"), F.count(seq_of("put_no_overwrite", "update")).alias("conditional"))
    won = facts.where("conditional = 0 AND put IS NOT NULL AND (gone IS NULL OR put > gone)").select("_same", F.col("put").alias("seq"), F.col("put").alias("spelled"))
    if conditional:
        # keys with conditional operations need the state at their time
        open_ = every.select("_same", "seq", "op").join(facts.where("conditional > 0").select("_same", "gone"), "_same").where("op <> 'delete' AND (gone IS NULL OR seq > gone)")
        born = open_.groupBy("_same").agg(F.min(seq_of("put", "put_no_overwrite")).alias("born"))
        counted = open_.join(born, "_same").where("seq = born OR op = 'put' OR (op = 'update' AND seq > born)")
        held = counted.groupBy("_same").agg(F.max("seq").alias("seq"), F.max(F.when(F.col("op") != "update", F.col("seq"))).alias("spelled"))
        won = won.unionByName(held).where("seq IS NOT NULL")
    rows = every.select("_same", "seq", "key", "value")
    settled = rows.drop("key").join(won, ["_same", "seq"])
    if order.by_key:
        settled = settled.select(F.col("_same").alias("key"), "value")
    else:
        settled = settled.select("_same", F.col("spelled").alias("seq"), "value").join(rows.drop("value"), ["_same", "seq"]).select("key", "value")
    return untouched.unionByName(settled)


def latest(rows: DataFrame) -> DataFrame:
    """(key, value), each key once: the row of the greatest ``seq``, or an error where keys repeat without one."""
    if "seq" in rows.columns:
        return rows.groupBy("key").agg(F.max_by("value", "seq").alias("value"))
    one = rows.groupBy("key").agg(F.count("*").alias("_n"), F.first("value").alias("value"))
    stop = F.raise_error(F.lit("a key is given more than once")).cast(rows.schema["value"].dataType)
    return one.select("key", F.when(F.col("_n") == 1, F.col("value")).otherwise(stop).alias("value"))


def put(base: DataFrame, rows: DataFrame) -> DataFrame:
    """Upsert: the rows, and base rows with other keys."""
    return base.join(rows.select("key"), "key", "left_anti").unionByName(latest(rows))


def put_with_before(base: DataFrame, rows: DataFrame) -> DataFrame:
    """(key, value, old_value, existed) of each row put."""
    old = base.select("key", F.col("value").alias("old_value"), F.lit(True).alias("existed"))
    return rows.join(old, "key", "left").select("key", "value", "old_value", F.coalesce("existed", F.lit(False)).alias("existed"))


def put_no_overwrite(base: DataFrame, rows: DataFrame) -> DataFrame:
    """Base and those rows whose key it does not have; of rows that repeat a key, the first by ``seq``."""
    if "seq" in rows.columns:
        rows = rows.withColumn("seq", -F.col("seq"))
    return base.unionByName(latest(rows).join(base.select("key"), "key", "left_anti"))


def update(base: DataFrame, rows: DataFrame) -> DataFrame:
    """Base with new values for keys that it has; other rows are ignored."""
    new = latest(rows).select("key", F.col("value").alias("_new"), F.lit(True).alias("_met"))
    return base.join(new, "key", "left").select("key", F.when(F.col("_met"), F.col("_new")).otherwise(F.col("value")).alias("value"))


def missing(base: DataFrame, rows: DataFrame) -> DataFrame:
    """Keys of rows that the base does not have; a strict update fails if there is any."""
    return rows.select("key").join(base.select("key"), "key", "left_anti")


def delete(base: DataFrame, keys: DataFrame) -> DataFrame:
    return base.join(keys.select("key"), "key", "left_anti")


def clear(base: DataFrame) -> DataFrame:
    return base.limit(0)


def append_check(base: DataFrame, rows: DataFrame) -> DataFrame:
    """One row (can_append): whether every new key is greater than every key of the base."""
    low = rows.agg(F.min("key").alias("low"))
    high = base.agg(F.max("key").alias("high"))
    ok: Column = F.coalesce(F.col("low") > F.col("high"), F.lit(True))
    return low.join(F.broadcast(high)).select(ok.alias("can_append"))
