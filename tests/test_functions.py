"""Codecs, orders, capacity and membership."""

import pytest
from pyspark.sql import functions as F

from kvloom.functions import bloom, capacity, codec
from kvloom.functions.order import CASE_INSENSITIVE, NUMERIC, ORDERS
from kvloom.operators import read, stats

NUMBERS = [0, 1, -1, 42, -12345, 2**31, -(2**63), 2**63 - 1]


def test_integer_codecs(spark):
    df = spark.createDataFrame([(n,) for n in NUMBERS], "n long")
    rows = df.select("n", codec.be_raw(F.col("n")).alias("raw"), codec.be_ordered(F.col("n")).alias("ordered")).collect()
    for r in rows:
        assert bytes(r["raw"]) == r["n"].to_bytes(8, "big", signed=True)
    assert [r["n"] for r in sorted(rows, key=lambda r: bytes(r["ordered"]))] == sorted(NUMBERS)
    back = df.select("n", codec.from_be_raw(codec.be_raw(F.col("n"))).alias("a"), codec.from_be_ordered(codec.be_ordered(F.col("n"))).alias("b"))
    assert all(r["n"] == r["a"] == r["b"] for r in back.collect())


def test_wrong_bytes(spark):
    df = spark.createDataFrame([(bytearray(b"abc"),), (bytearray(b"\xff"),)], "b binary")
    assert df.select(codec.from_be_raw(F.col("b"), strict=False).alias("x")).where("x IS NOT NULL").count() == 0
    with pytest.raises(Exception, match="expected bytes"):
        df.select(codec.from_be_raw(F.col("b"))).collect()
    assert [r[0] for r in df.select(codec.utf8_decode(F.col("b"), strict=False)).collect()] == ["abc", None]


def test_unsigned(spark):
    from decimal import Decimal

    df = spark.createDataFrame([(Decimal(2**64 - 1),), (Decimal(0),)], "n decimal(20,0)")
    rows = df.select("n", codec.unsigned_be(F.col("n")).alias("b"), codec.from_unsigned_be(codec.unsigned_be(F.col("n"))).alias("m")).collect()
    assert [bytes(r["b"]) for r in rows] == [b"\xff" * 8, bytes(8)] and all(r["n"] == r["m"] for r in rows)


def test_orders(spark):
    df = spark.createDataFrame([(k,) for k in ("9", "123", "1000", "999", "B", "a")], "key string")
    by = lambda o: [r["key"] for r in read.scan(df, o).collect()]
    assert by(NUMERIC) == ["9", "B", "a", "123", "999", "1000"]
    assert by(CASE_INSENSITIVE)[-2:] == ["a", "B"]
    assert by(ORDERS["reverse_lexicographic"]) == by(ORDERS["lexicographic"])[::-1]
    assert read.get(df.withColumn("value", F.lit(1)), "b", CASE_INSENSITIVE).count() == 1
    assert read.seek(df, "100", NUMERIC).first()["key"] == "123"


def test_navigation_at_the_ends(spark):
    t = spark.createDataFrame([(f"key{i:02}", f"value{i:02}") for i in range(1, 10, 2)], "key string, value string")
    first = lambda d: (d.first() or [None])[0]
    assert [first(read.seek(t, k)) for k in ("key05", "key06", "key00", "key99")] == ["key05", "key07", "key01", None]
    assert first(read.prev_of(t, "key01")) is None and first(read.next_of(t, "key09")) is None
    assert first(read.next_of(t, "key01")) == "key03"
    assert [r["key"] for r in read.iter_from(t, "key05").collect()] == ["key05", "key07", "key09"]
    assert read.prefix_scan(t, "").count() == 5


def test_neighbours_over_many_ranges(spark):
    t = spark.range(1000).select((F.col("id") * 3).alias("key"))
    rows = {r["key"]: (r["prev_key"], r["next_key"]) for r in read.neighbours(t).collect()}
    assert rows[0] == (None, 3) and rows[2997] == (2994, None) and all(rows[k] == (k - 3, k + 3) for k in range(3, 2997, 3))
    down = {r["key"]: r["next_key"] for r in read.neighbours(t, ORDERS["reverse_lexicographic"]).collect()}
    assert down[3] == 0 and down[0] is None
    assert read.neighbours(t.limit(0)).count() == 0


def test_capacity_fixtures(spark):
    one = spark.range(1)
    value = lambda c: one.select(c).first()[0]
    assert value(capacity.map_size(F.lit(100_000), F.lit(16), F.lit(100_000))) > 2 << 30
    row = one.select(*capacity.space_info(F.lit(1000), F.lit(800), F.lit(200), F.lit(1 << 30))).first()
    assert row["percent_used"] == 80.0
    assert value(capacity.overflow_pages(F.lit(0))) == 0 and value(capacity.overflow_pages(F.lit(4057))) == 2
    g = capacity.GROWTH["conservative"]
    assert value(g.next_size(F.lit(200 << 30))) is None and value(g.next_size(F.lit(100 << 20))) == 150 << 20
    assert not value(capacity.GROWTH["default"].needed(F.lit(99), F.lit(100)))
    assert [value(capacity.page_size_of_pattern(F.lit(p))) for p in ("random", "bulk", "none")] == ["small", "huge", None]


def test_bloom(spark):
    keys = spark.createDataFrame([(f"in{i}",) for i in range(500)], "key string")
    probes = keys.unionByName(spark.createDataFrame([(f"out{i}",) for i in range(1000)], "key string"))
    shape = bloom.Shape.of(500, 0.02)
    f = bloom.build(keys, "key", shape)
    met = {r["key"] for r in bloom.maybe(probes, "key", f, shape).collect()}
    assert {f"in{i}" for i in range(500)} <= met and len(met) < 500 + 50
    assert 0 < bloom.fill_ratio(f, shape).first()[0] < 1
    assert bloom.maybe(probes, "key", f.limit(0), shape).count() == 0


def test_access_patterns(spark):
    rows = lambda pages, bulk=False: spark.createDataFrame([(i, p, bulk) for i, p in enumerate(pages)], "pos long, page long, is_bulk boolean")
    pattern = lambda d: stats.access_pattern(d).first()["pattern"]
    assert pattern(rows(range(50))) == "sequential" and pattern(rows([5, 90, 3, 70, 1])) == "random"
    assert pattern(rows(range(5), True)) == "bulk" and pattern(rows(range(5)).limit(0)) == "mixed"


def test_observed_counts(spark):
    t = spark.createDataFrame([("a", "xyz"), ("bc", None)], "key string, value string")
    counted, seen = stats.observed(t)
    counted.collect()
    assert seen.get == {"rows": 2, "bytes": 6}
