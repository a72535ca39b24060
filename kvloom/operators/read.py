"""Lookups and ordered scans of a table (key, value).

A table is never sorted on its own; every operator that returns rows in key order says so by
``order_by`` or carries a rank. Filters are plain predicates on ``key``, so they reach the Parquet
scan, and files written in key order are skipped by their statistics.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from kvloom.functions.order import LEXICOGRAPHIC, Order


def _as_column(key) -> Column:
    return key if isinstance(key, Column) else F.lit(key)


def get(t: DataFrame, key, order: Order = LEXICOGRAPHIC) -> DataFrame:
    """The row of one key, or none."""
    return t.where(order.same(F.col("key")) == order.same(_as_column(key)))


def exists(t: DataFrame, key) -> DataFrame:
    """One row (found)."""
    return get(t, key).limit(1).agg((F.count("*") > 0).alias("found"))


def multi_get(t: DataFrame, keys: DataFrame, misses: bool = False) -> DataFrame:
    """Rows of many keys (distinct column ``key``); with ``misses``, null values for keys not there.

    Spark picks the join: a probe side under the session's broadcast limit is broadcast, a larger one
    is shuffled with the table.
    """
    if misses:
        return keys.select("key").distinct().join(t, "key", "left")
    return t.join(keys.select("key"), "key", "left_semi")  # a semi join needs no distinct keys


def first(t: DataFrame, order: Order = LEXICOGRAPHIC, n: int = 1) -> DataFrame:
    """The first n rows."""
    return t.orderBy(*order.by(F.col("key"))).limit(n)


def last(t: DataFrame, order: Order = LEXICOGRAPHIC, n: int = 1) -> DataFrame:
    """The last n rows, the last one first."""
    return first(t, order.reversed(), n)


def seek(t: DataFrame, key, order: Order = LEXICOGRAPHIC) -> DataFrame:
    """The first row at or after a key; none past the end."""
    return first(t.where(_not_before(key, order)), order)


def next_of(t: DataFrame, key, order: Order = LEXICOGRAPHIC) -> DataFrame:
    """The row after a key."""
    return first(t.where(_not_before(key, order) & (order.rank(F.col("key")) != order.rank(_as_column(key)))), order)


def prev_of(t: DataFrame, key, order: Order = LEXICOGRAPHIC) -> DataFrame:
    """The row before a key."""
    return last(t.where(~_not_before(key, order)), order)


def _not_before(key, order: Order) -> Column:
    k, at = F.col("key"), _as_column(key)
    if len(order.sort(k)) == 1:  # a plain comparison, which the scan can use
        a, b = order.sort(k)[0], order.sort(at)[0]
    else:
        a, b = order.rank(k), order.rank(at)
    return a <= b if order.descending else a >= b


def scan(t: DataFrame, order: Order = LEXICOGRAPHIC) -> DataFrame:
    """All rows in order: a range shuffle, then sorted parts."""
    return t.orderBy(*order.by(F.col("key")))


def range_scan(t: DataFrame, start, end) -> DataFrame:
    """Rows with start <= key < end in order; None leaves a side open."""
    if start is not None:
        t = t.where(F.col("key") >= _as_column(start))
    if end is not None:
        t = t.where(F.col("key") < _as_column(end))
    return t.orderBy("key")


def iter_from(t: DataFrame, start) -> DataFrame:
    """Rows from a key on, that key included."""
    return range_scan(t, start, None)


def prefix_scan(t: DataFrame, prefix) -> DataFrame:
    """Rows whose key starts with a prefix, in order; an empty prefix gives all."""
    return t.where(F.startswith(F.col("key"), _as_column(prefix))).orderBy("key")


def prefix_flags(t: DataFrame, prefix) -> DataFrame:
    """(key, matches) of every row."""
    return t.select("key", F.startswith(F.col("key"), _as_column(prefix)).alias("matches"))


def bounds(ranks: DataFrame, parts: int, each: int = 32) -> list:
    """Values that cut column ``rank`` into about equal parts, from a fixed sample: the rows of least hash."""
    sample = ranks.where("rank IS NOT NULL").select("rank", F.xxhash64("rank").alias("h")).orderBy("h").limit(parts * each)
    values = sorted((tuple(r["rank"]) for r in sample.select("rank").collect()))
    return sorted({values[len(values) * i // parts] for i in range(1, parts)}) if values else []


def part_of(rank: Column, cuts: list) -> Column:
    """How many cuts lie below a rank, by bisection."""
    if not cuts:
        return F.lit(0)
    at = F.array(*[F.struct(*[F.lit(v).alias(f"o{i}") for i, v in enumerate(c)]) for c in cuts])
    steps = [1 << k for k in reversed(range(len(cuts).bit_length()))]
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda found, step: F.when(F.get(at, found + step - 1) < rank, found + step).otherwise(found))


def ranged(t: DataFrame, order: Order = LEXICOGRAPHIC) -> DataFrame:
    """``t`` with the number of each row's key range in ``_part``, rising in the order.

    Ranges are cut at values taken from a sample beforehand, so every use of the result agrees on them;
    there are as many as shuffle partitions. Windows over ``_part`` then shuffle once.
    """
    rank = order.rank(F.col("key"))
    cuts = bounds(t.select(rank.alias("rank")), int(t.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    part = part_of(rank, cuts)
    return t.withColumn("_part", F.lit(len(cuts)) - part if order.descending else part)


def neighbours(t: DataFrame, order: Order = LEXICOGRAPHIC, carry: str | None = None) -> DataFrame:
    """Every row with the keys before and after it, null at the ends; with ``carry``, that column's values there too.

    Windows run inside key ranges; only each range's first and last row are put in one place to fill
    the gaps at the borders.
    """
    row = F.struct(F.col("key").alias("key"), *([F.col(carry).alias("with")] if carry else []))
    d = ranged(t, order).withColumn("_row", row)
    w = W.partitionBy("_part").orderBy(*order.by(F.col("key")))
    inside = d.select("*", F.lag("_row").over(w).alias("_prev"), F.lead("_row").over(w).alias("_next")).drop("_row")
    pick = (F.max_by, F.min_by) if order.descending else (F.min_by, F.max_by)
    rank = order.rank(F.col("key"))
    ends = d.groupBy("_part").agg(pick[0]("_row", rank).alias("_first"), pick[1]("_row", rank).alias("_last"))
    b = W.orderBy("_part")
    borders = ends.select("_part", F.lag("_last").over(b).alias("_before"), F.lead("_first").over(b).alias("_after"))
    out = inside.join(F.broadcast(borders), "_part").withColumns({"_prev": F.coalesce("_prev", "_before"), "_next": F.coalesce("_next", "_after")})
    out = out.withColumns({"prev_key": F.col("_prev.key"), "next_key": F.col("_next.key")})
    if carry:
        out = out.withColumns({f"prev_{carry}": F.col("_prev.with"), f"next_{carry}": F.col("_next.with")})
    return out.drop("_part", "_before", "_after", "_prev", "_next")


def seek_many(t: DataFrame, probes: DataFrame) -> DataFrame:
    """(probe_id, probe, key, value): for every probe the first row at or after it, nulls past the end.

    Distinct probe keys and table keys are put in one sequence, dealt by ranges cut over both; the
    nearest later key is a window inside the range, or else the first key of the next range that has
    one. Answers are then joined to the probes, so a hot probe key is one row of the sequence.
    """
    every = t.select(F.col("key").alias("k"), F.lit(True).alias("there")).unionByName(probes.select(F.col("key").alias("k"), F.lit(False).alias("there")))
    keys = every.groupBy("k").agg(F.max("there").alias("there"))
    rank = F.struct(F.col("k").alias("o0"))
    cuts = bounds(keys.select(rank.alias("rank")), int(t.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    both = keys.withColumn("_part", part_of(rank, cuts)).withColumn("own", F.when(F.col("there"), F.col("k")))
    # from the end backwards, so that the window grows instead of being summed up anew for each row
    w = W.partitionBy("_part").orderBy(F.desc("k")).rowsBetween(W.unboundedPreceding, W.currentRow)
    inside = both.select("*", F.last("own", ignorenulls=True).over(w).alias("_met"))
    firsts = both.groupBy("_part").agg(F.min("own").alias("_row"))
    later = firsts.select("_part", F.last("_row", ignorenulls=True).over(W.orderBy(F.desc("_part")).rowsBetween(W.unboundedPreceding, -1)).alias("_later"))
    met = inside.join(F.broadcast(later), "_part", "left").select(F.col("k").alias("probe"), F.coalesce("_met", "_later").alias("key"))
    found = probes.select("probe_id", F.col("key").alias("probe")).join(met, "probe", "left").join(t.select("key", "value"), "key", "left")
    return found.select("probe_id", "probe", "key", "value")


def positions(t: DataFrame, order: Order = LEXICOGRAPHIC) -> DataFrame:
    """Rows with their place in order (column rn), counted inside key ranges and shifted by the ranges before."""
    dealt = ranged(t, order)
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("n"))
    before = sizes.select("_part", F.coalesce(F.sum("n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    own = dealt.withColumn("_rn", F.row_number().over(W.partitionBy("_part").orderBy(*order.by(F.col("key")))))
    return own.join(F.broadcast(before), "_part").withColumn("rn", (F.col("_before") + F.col("_rn")).cast("long")).drop("_part", "_before", "_rn")
