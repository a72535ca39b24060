"""Bloom filters over keys, built and asked inside Spark.

A filter is a table (word, bits) of 64-bit words. Its bits are set by aggregation, or-ed per task
before the shuffle, and two filters of one shape are merged by or-ing words. Membership of many
probes is a join on words, so a filter of any size works; ``exact`` then settles what the filter
lets through.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Shape:
    """Bits (a power of two) and hashes of a filter."""

    bits: int
    hashes: int

    @staticmethod
    def of(keys: int, wrong: float) -> Shape:
        """Shape for a number of keys and a share of wrong answers."""
        ideal = math.ceil(-keys * math.log(wrong) / math.log(2) ** 2)
        return Shape(1 << max(6, (ideal - 1).bit_length()), min(16, max(1, round(ideal / keys * math.log(2)))))

    def places(self, key: Column) -> Column:
        """Bit numbers of a key."""
        a, b = F.xxhash64(key), F.xxhash64(key, F.lit(1)).bitwiseOR(F.lit(1))
        each = lambda i: F.pmod(F.pmod(a, F.lit(self.bits)) + i * F.pmod(b, F.lit(self.bits)), F.lit(self.bits))
        return F.transform(F.sequence(F.lit(0).cast("long"), F.lit(self.hashes - 1).cast("long")), each)


def _bit(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(place, F.lit(64)).cast("int"))


def build(keys: DataFrame, key: str, shape: Shape) -> DataFrame:
    """(word, bits) of a filter over a key column."""
    each = keys.select(F.explode(shape.places(F.col(key))).alias("p"))
    return each.groupBy(F.floor(F.col("p") / F.lit(64.0)).cast("long").alias("word")).agg(F.bit_or(_bit(F.col("p"))).alias("bits"))


def merge(a: DataFrame, b: DataFrame) -> DataFrame:
    """Filter of both sides' keys; both have one shape."""
    return a.unionByName(b).groupBy("word").agg(F.bit_or("bits").alias("bits"))


def fill_ratio(filter_: DataFrame, shape: Shape) -> DataFrame:
    return filter_.agg((F.coalesce(F.sum(F.bit_count("bits")), F.lit(0)) / F.lit(float(shape.bits))).alias("fill_ratio"))


def maybe(probes: DataFrame, key: str, filter_: DataFrame, shape: Shape) -> DataFrame:
    """Distinct probes that the filter does not rule out."""
    asked = probes.select(F.col(key).alias("_k")).distinct().select("_k", F.explode(F.array_distinct(shape.places(F.col("_k")))).alias("_p"))
    asked = asked.withColumn("word", F.floor(F.col("_p") / F.lit(64.0)).cast("long"))
    met = asked.join(filter_, "word", "left").groupBy("_k").agg(F.min(F.coalesce(F.col("bits"), F.lit(0)).bitwiseAND(_bit(F.col("_p"))) != 0).alias("maybe"))
    return met.where("maybe").select(F.col("_k").alias(key))


def exact(probes: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Distinct probes that are keys."""
    return probes.select(key).distinct().join(keys.select(key), key, "left_semi")


def leaf_filters(keys: DataFrame, key: str, leaf: str, shape: Shape) -> DataFrame:
    """(leaf, word, bits): one filter for each leaf, and under a null leaf the root's, which covers all."""
    each = keys.select(F.col(leaf).alias("leaf"), F.explode(shape.places(F.col(key))).alias("p"))
    both = each.unionByName(each.withColumn("leaf", F.lit(None).cast(each.schema["leaf"].dataType)))
    return both.groupBy("leaf", F.floor(F.col("p") / F.lit(64.0)).cast("long").alias("word")).agg(F.bit_or(_bit(F.col("p"))).alias("bits"))


def maybe_in_leaf(probes: DataFrame, key: str, leaf: str, filters: DataFrame, shape: Shape) -> DataFrame:
    """(key, leaf, maybe) of distinct probes: false where the root or the leaf rules the key out; a leaf without a filter rules nothing out."""
    asked = probes.select(F.col(key).alias("_k"), F.col(leaf).alias("_leaf")).distinct()
    places = asked.select("_k", "_leaf", F.explode(F.array_distinct(shape.places(F.col("_k")))).alias("_p")).withColumn("word", F.floor(F.col("_p") / F.lit(64.0)).cast("long"))
    root = filters.where("leaf IS NULL").select("word", F.col("bits").alias("_root"))
    own = filters.where("leaf IS NOT NULL").select(F.col("leaf").alias("_leaf"), "word", F.col("bits").alias("_own"))
    known = own.select("_leaf").distinct().withColumn("_known", F.lit(True))
    met = places.join(root, "word", "left").join(own, ["_leaf", "word"], "left").join(known, "_leaf", "left")
    has = lambda c: F.coalesce(F.col(c), F.lit(0)).bitwiseAND(_bit(F.col("_p"))) != 0
    found = met.groupBy("_k", "_leaf").agg(F.min(has("_root") & (F.col("_known").isNull() | has("_own"))).alias("maybe"))
    return found.select(F.col("_k").alias(key), F.col("_leaf").alias(leaf), "maybe")


def flat_shape(keys: int) -> Shape:
    """Ten bits a key, rounded up to a power of two, and four hashes."""
    return Shape(1 << max(6, (10 * max(keys, 1) - 1).bit_length()), 4)
