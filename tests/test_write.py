"""Folds against a sequential dictionary."""

import random

import pytest

from kvloom.functions.order import CASE_INSENSITIVE
from kvloom.operators import dup, write

LOG = "seq long, op string, key string, value string"


def model(base, ops):
    state = dict(base)
    for op, k, v in ops:
        if op == "put" or op == "put_no_overwrite" and k not in state or op == "update" and k in state:
            state[k] = v
        elif op == "delete":
            state.pop(k, None)
        elif op == "clear":
            state.clear()
    return state


@pytest.mark.parametrize("seed", range(6))
def test_fold_equals_model(spark, seed):
    rng = random.Random(seed)
    base = {f"k{i}": f"b{i}" for i in range(20)}
    kinds = ["put"] * 5 + ["put_no_overwrite", "update", "delete"] * 2 + (["clear"] if seed % 2 else [])
    ops = [(rng.choice(kinds), f"k{rng.randrange(30)}", f"v{i}") for i in range(150)]
    log = spark.createDataFrame([(i, op, None if op == "clear" else k, None if op in ("clear", "delete") else v) for i, (op, k, v) in enumerate(ops)], LOG)
    got = write.fold(spark.createDataFrame(list(base.items()), "key string, value string"), log)
    assert {r["key"]: r["value"] for r in got.collect()} == model(base, ops)
    simple = [o for o in ops if o[0] in ("put", "delete")]
    log = spark.createDataFrame([(i, op, k, None if op == "delete" else v) for i, (op, k, v) in enumerate(simple)], LOG)
    got = write.fold(spark.createDataFrame(list(base.items()), "key string, value string"), log, conditional=False, clears=False)
    assert {r["key"]: r["value"] for r in got.collect()} == model(base, simple)


@pytest.mark.parametrize("seed", range(4))
def test_dup_fold_equals_model(spark, seed):
    rng = random.Random(seed)
    state = {("a", "1"), ("b", "2")}
    d = spark.createDataFrame(sorted(state), "key string, value string")
    rows = []
    for i in range(120):
        op = rng.choice(["put_dup"] * 5 + ["delete_dup", "delete_dup", "delete"] + (["clear"] if seed % 2 and i % 10 == 0 else []))
        k, v = rng.choice("abcd"), str(rng.randrange(6))
        rows.append((i, op, None if op == "clear" else k, v if op.endswith("dup") else None))
        if op == "put_dup":
            state.add((k, v))
        elif op == "delete_dup":
            state.discard((k, v))
        elif op == "delete":
            state = {p for p in state if p[0] != k}
        else:
            state = set()
    got = dup.fold(d, spark.createDataFrame(rows, LOG))
    assert {tuple(r) for r in got.select("key", "value").collect()} == state


def test_case_insensitive_keys_are_one_key(spark):
    base = spark.createDataFrame([("Key", "1")], "key string, value string")
    log = spark.createDataFrame([(0, "put", "KEY", "2")], LOG)
    assert [tuple(r) for r in write.fold(base, log, CASE_INSENSITIVE).collect()] == [("KEY", "2")]


def test_empty_log_and_base(spark):
    base = spark.createDataFrame([], "key string, value string")
    log = spark.createDataFrame([], LOG)
    assert write.fold(base, log).count() == 0
    assert write.append_check(base, base).first()["can_append"]
    assert dup.lengths(base).first() == (0, 0)


def test_repeated_keys_are_settled_or_refused(spark):
    base = spark.createDataFrame([("1", "a"), ("9", "i")], "key string, value string")
    rows = spark.createDataFrame([("1", "x", 0), ("1", "y", 1), ("2", "q", 5), ("2", "z", 4)], "key string, value string, seq long")
    got = lambda d: sorted(tuple(r) for r in d.select("key", "value").collect())
    assert got(write.put(base, rows)) == [("1", "y"), ("2", "q"), ("9", "i")]
    assert got(write.put_no_overwrite(base, rows)) == [("1", "a"), ("2", "z"), ("9", "i")]
    assert got(write.update(base, rows)) == [("1", "y"), ("9", "i")]
    for f in (write.put, write.update):
        with pytest.raises(Exception, match="more than once"):
            f(base, rows.drop("seq")).collect()


def test_rows_that_no_operation_names_are_not_shuffled(spark, tmp_path):
    spark.range(2000).selectExpr("CAST(id AS STRING) AS key", "'v' AS value").write.parquet(f"{tmp_path}/base")
    spark.createDataFrame([(i, "put", str(i), "w") for i in range(5)], LOG).write.parquet(f"{tmp_path}/log")
    out = write.fold(spark.read.parquet(f"{tmp_path}/base"), spark.read.parquet(f"{tmp_path}/log"))
    assert out.count() == 2000
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "BroadcastHashJoin" in plan


@pytest.mark.parametrize("parts", ["1", "4"])
def test_places_in_a_hot_set(spark, parts):
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        rows = [("hot", i * 7 % 500) for i in range(500)] + [(f"k{i}", j) for i in range(20) for j in range(i % 4)]
        got = {(r["key"], r["value"]): r["rn"] for r in dup.numbered(spark.createDataFrame(rows + rows[:50], "key string, value int")).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == {(k, v): sorted(x for q, x in set(rows) if q == k).index(v) + 1 for k, v in set(rows)}
