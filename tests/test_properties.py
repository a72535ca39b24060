"""Properties over generated keys: scans, seeks and prefixes against sorted Python lists."""

import bisect

import pytest

hypothesis = pytest.importorskip("hypothesis")
from hypothesis import given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from kvloom.functions import codec  # noqa: E402
from kvloom.functions.order import NUMERIC  # noqa: E402
from kvloom.operators import read  # noqa: E402

KEYS = st.lists(st.binary(min_size=1, max_size=6), min_size=1, max_size=40, unique=True)
FEW = settings(max_examples=8, deadline=None, derandomize=True)


def table(spark, keys):
    return spark.createDataFrame([(bytearray(k), i) for i, k in enumerate(keys)], "key binary, value int")


def listed(df):
    return [bytes(r["key"]) for r in df.collect()]


@FEW
@given(keys=KEYS, a=st.binary(max_size=4), b=st.binary(max_size=4))
def test_ranges_and_prefixes(spark, keys, a, b):
    t, want = table(spark, keys), sorted(keys)
    low, high = sorted((a, b))
    assert listed(read.range_scan(t, bytearray(low), bytearray(high))) == [k for k in want if low <= k < high]
    assert listed(read.prefix_scan(t, bytearray(a))) == [k for k in want if k.startswith(a)]
    assert listed(read.scan(t, NUMERIC)) == sorted(keys, key=lambda k: (len(k), k))


@FEW
@given(keys=KEYS, probes=st.lists(st.binary(max_size=6), min_size=1, max_size=20))
def test_seeks_alone_and_together(spark, keys, probes):
    t, want = table(spark, keys), sorted(keys)
    after = lambda p: want[i] if (i := bisect.bisect_left(want, p)) < len(want) else None
    asked = spark.createDataFrame([(i, bytearray(p)) for i, p in enumerate(probes)], "probe_id int, key binary")
    got = {r["probe_id"]: None if r["key"] is None else bytes(r["key"]) for r in read.seek_many(t, asked).collect()}
    assert got == {i: after(p) for i, p in enumerate(probes)}
    one = read.seek(t, bytearray(probes[0])).collect()
    assert (bytes(one[0]["key"]) if one else None) == after(probes[0])


@FEW
@given(numbers=st.lists(st.integers(-(2**63), 2**63 - 1), min_size=1, max_size=50, unique=True))
def test_ordered_codec_keeps_the_order(spark, numbers):
    rows = spark.createDataFrame([(n,) for n in numbers], "n long").select("n", codec.be_ordered(F.col("n")).alias("key")).orderBy("key").collect()
    assert [r["n"] for r in rows] == sorted(numbers)
