"""The store: snapshots, commits, catalog, limits, copies, recovery."""

import pytest

from kvloom.functions import errors as E
from kvloom.operators import stats
from kvloom.sources.store import Store
from kvloom.streaming.group_commit import Write, commit_group, sink


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/store")


def items(txn, name="main"):
    return dict(txn.items(name))


def test_put_get_delete_and_reopen(spark, store):
    with store.write_txn() as txn:
        for i in range(5):
            txn.put(b"k%d" % i, b"v%d" % i)
        assert txn.get(b"k3") == b"v3"  # own writes
        assert txn.delete(b"k1") and not txn.delete(b"none")
        assert txn.put_no_overwrite(b"new", b"x") and not txn.put_no_overwrite(b"k0", b"y")
        assert txn.update(b"k0", b"z") and not txn.update(b"k1", b"z")
    again = Store(spark, store.root).read_txn()
    assert items(again) == {b"k0": b"z", b"k2": b"v2", b"k3": b"v3", b"k4": b"v4", b"new": b"x"}
    assert [k for k, _ in again.items()] == sorted(items(again))
    assert again.get(b"k1") is None and again.count() == 5


def test_snapshots_abort_and_versions(store):
    with store.write_txn() as txn:
        txn.put(b"a", b"1")
    reader = store.read_txn()
    txn = store.write_txn()
    txn.put(b"a", b"2")
    txn.abort()
    with store.write_txn() as txn:
        txn.put(b"a", b"3")
    assert reader.get(b"a") == b"1" and store.read_txn().get(b"a") == b"3"
    with pytest.raises(ZeroDivisionError), store.write_txn() as txn:
        txn.clear()
        1 / 0
    assert store.read_txn().get(b"a") == b"3"
    up = reader.upgrade()
    with pytest.raises(E.Conflict):
        store.write_txn(wait=False)
    down = up.downgrade()
    assert down.get(b"a") == b"3"
    with pytest.raises(E.BadTransaction):
        reader.get(b"a")


def test_readers_and_vacuum(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s", max_readers=2, bloom=True)
    for i in range(3):
        with store.write_txn() as txn:
            txn.put(b"k", b"%d" % i)
    old = store.read_txn()
    with store.write_txn() as txn:
        txn.put(b"k", b"last")
    store.read_txn()
    with pytest.raises(E.ReadersFull):
        store.read_txn()
    assert store.reader_table().count() == 2
    gone = store.vacuum()
    assert old.id not in gone and len(gone) >= 2
    assert old.get(b"k") == b"2"
    old.close()
    assert store.vacuum()


def test_catalog_and_limits(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s", max_databases=2)
    store.create("users")
    store.create("tags", dup_sort=True)
    store.create("users", dup_sort=True)  # flags stay
    assert not store.open("users")["dup"]
    with pytest.raises(E.DatabasesFull):
        store.create("more")
    with pytest.raises(E.InvalidDatabase):
        store.open("none")
    with pytest.raises(E.InvalidOperation):
        store.create("main", dup_sort=True)
    with pytest.raises(E.InvalidOperation):
        store.drop("")
    with store.write_txn() as txn:
        assert txn.put_dup(b"a", b"2", "tags") and not txn.put_dup(b"a", b"1", "tags")
        txn.put(b"b", b"x", "tags")
        assert txn.get_all(b"a", "tags") == [b"1", b"2"]
        assert txn.get(b"a", "tags") == b"1"
        with pytest.raises(E.InvalidOperation):
            txn.put(b"", b"x")
        with pytest.raises(E.BadValueSize):
            txn.put(b"k" * 512, b"x")
        txn.put(b"k" * 511, b"x")
        with pytest.raises(E.InvalidOperation):
            txn.begin_nested()
    rows = {r["name"]: r["entries"] for r in store.databases().collect()}
    assert rows == {"main": 1, "tags": 2, "users": 0}
    with store.write_txn() as txn:
        assert txn.delete_dup(b"a", b"1", "tags") and txn.delete(b"b", "tags")
    assert store.read_txn().get_all(b"a", "tags") == [b"2"]
    store.drop("tags")
    assert [r["name"] for r in store.databases().collect()] == ["main", "users"]


def test_recovery_from_a_broken_manifest(spark, store):
    with store.write_txn() as txn:
        txn.put(b"a", b"1")
    store.files.write_once("manifests/v00000000000000000009.json", '{"sum": "0", "body": "{}"}')
    again = Store(spark, store.root)
    assert again.read_txn().get(b"a") == b"1"
    with again.write_txn() as txn:
        txn.put(b"a", b"2")
    assert again.latest()["version"] == 10 and again.read_txn().get(b"a") == b"2"


def test_copies(spark, store, tmp_path):
    store.create("d", dup_sort=True)
    with store.write_txn() as txn:
        txn.put(b"a", b"1")
        txn.put_dup(b"x", b"y", "d")
    seen = []
    for compact in (False, True):
        copy = store.copy(f"file://{tmp_path}/copy{compact}", compact, lambda *a: seen.append(a))
        assert items(copy.read_txn()) == {b"a": b"1"} and items(copy.read_txn(), "d") == {b"x": b"y"}
    assert seen[:2] == [("d", 1, 2), ("main", 2, 2)]
    info = store.space_info().first()
    assert info["used_pages"] > 0 and info["max_db_size_bytes"] == 1 << 30


def test_quota_and_empty_commit(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s", quota=10)
    before = store.latest()["version"]
    with store.write_txn():
        pass
    assert store.latest()["version"] == before
    with pytest.raises(E.MapFull), store.write_txn() as txn:
        txn.put(b"a", b"1")
    assert store.read_txn().get(b"a") is None


def test_group_commit(store):
    writes = [Write().put(b"k%d" % i, b"v") for i in range(5)] + [Write().put(b"bad", b"1").put(b"", b"2"), Write().delete(b"k0"), Write().put(b"x", b"y", "nowhere")]
    out = commit_group(store, writes, group=3)
    assert [r is None for r in out] == [True] * 5 + [False, True, False]
    assert set(items(store.read_txn())) == {b"k1", b"k2", b"k3", b"k4"}


def test_stream_sink_skips_repeated_batches(spark, store):
    log = "seq long, op string, key binary, value binary"
    apply = sink(store)
    apply(spark.createDataFrame([(0, "put", bytearray(b"a"), bytearray(b"1"))], log), 0)
    apply(spark.createDataFrame([(1, "put", bytearray(b"a"), bytearray(b"2"))], log), 1)
    apply(spark.createDataFrame([(0, "put", bytearray(b"a"), bytearray(b"1"))], log), 0)
    assert store.read_txn().get(b"a") == b"2"


def test_error_codes():
    assert E.from_code(-30799).__class__ is E.KeyNotFound and E.MapFull.code == -30793
    assert E.from_code(12345).__class__ is E.KvError


@pytest.mark.parametrize("logs,share", [(0, 0.0), (100, 1e9), (2, 1e9)])
def test_logs_over_a_base(spark, tmp_path, logs, share):
    """Many small commits give the same state however often a base is written."""
    import random

    rng = random.Random(8)
    store = Store(spark, f"file://{tmp_path}/s", logs=logs, log_share=share)
    store.create("d", dup_sort=True)
    state, pairs, kept = {}, set(), []
    for step in range(7):
        with store.write_txn() as txn:
            if step == 4:
                txn.clear()
                state.clear()
            for _ in range(6):
                k, v = b"k%d" % rng.randrange(8), b"v%d" % rng.randrange(100)
                if rng.random() < 0.7:
                    txn.put(k, v)
                    txn.put(k, v, "d")
                    state[k] = v
                    pairs.add((k, v))
                else:
                    assert txn.delete(k) == (k in state)
                    txn.delete(k, "d")
                    state.pop(k, None)
                    pairs = {p for p in pairs if p[0] != k}
        kept.append((store.read_txn(), dict(state)))
    for reader, then in kept:
        assert items(reader) == then
    last = kept[-1][0]
    assert set(last.items("d")) == pairs and last.count() == len(state)
    assert [(bytes(r["key"]), bytes(r["value"])) for r in last.range(b"k2", b"k6").collect()] == sorted(p for p in state.items() if b"k2" <= p[0] < b"k6")
    assert all(last.get(k) == v for k, v in state.items()) and last.get(b"none") is None
    assert len(store.latest()["tables"]["main"]["logs"]) == {0: 0, 100: 6, 2: 0}[logs]
    again = store.copy(f"file://{tmp_path}/copy", compact=True).read_txn()
    assert items(again) == state and not again.state["tables"]["main"]["logs"]


def test_files_lie_in_key_order(spark, store):
    log = spark.range(500).selectExpr("id AS seq", "'put' AS op", "encode(lpad(CAST(id * 7919 % 500 AS STRING), 5, '0'), 'UTF-8') AS key", "encode('v', 'UTF-8') AS value")
    with store.write_txn() as txn:
        txn.apply(log.repartition(4))
    t = store.read_txn().table()
    assert stats.file_ranges(t).agg({"entries": "sum"}).first()[0] == 500
    assert stats.overlapping_files(t).count() == 0 and stats.repeated(t).count() == 0


def test_stream_into_a_store(spark, store, tmp_path):
    """A stream of log files, run twice: each micro-batch is one version, and none is applied again."""
    schema = "seq long, op string, key binary, value binary"
    source = f"{tmp_path}/log"

    def add(rows):
        spark.createDataFrame([(i, op, bytearray(k), bytearray(v) if v else None) for i, op, k, v in rows], schema).coalesce(1).write.mode("append").parquet(source)

    def drain():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        stream.writeStream.foreachBatch(sink(store)).option("checkpointLocation", f"{tmp_path}/marks").trigger(availableNow=True).start().awaitTermination()

    add([(0, "put", b"a", b"1"), (1, "put", b"b", b"2")])
    drain()
    add([(2, "delete", b"a", None), (3, "put", b"c", b"3")])
    drain()
    drain()
    assert items(store.read_txn()) == {b"b": b"2", b"c": b"3"}


def test_cursor_walks_and_changes(store):
    with store.write_txn() as txn:
        for i in (1, 3, 5, 7, 9):
            txn.put(b"key%02d" % i, b"value%02d" % i)
    c = store.read_txn().cursor()
    entry = lambda i: (b"key%02d" % i, b"value%02d" % i)
    assert c.current() is None and c.seek(b"key05") == entry(5) and c.seek(b"key06") == entry(7) and c.seek(b"key00") == entry(1)
    assert c.prev() is None and c.current() == entry(1) and c.next() == entry(3) and c.next() == entry(5) and c.prev() == entry(3)
    assert c.last() == entry(9) and c.next() is None and c.current() == entry(9) and c.prev() == entry(7)
    assert c.seek(b"key99") is None and c.current() is None and c.next() == entry(1)
    with pytest.raises(E.InvalidOperation):
        c.put(b"a", b"b")
    with store.write_txn() as txn:
        c = txn.cursor()
        c.put(b"key04", b"value04")
        assert c.next() == entry(5) and c.prev() == entry(4)
        assert c.seek(b"key03") and c.update(b"updated") and c.current() == (b"key03", b"updated")
        assert c.seek(b"key07") and c.delete() and c.current() is None and not c.delete() and c.next() == entry(9)
        assert not c.put_no_overwrite(b"key09", b"x") and c.value == b"value09" and c.put_no_overwrite(b"key10", b"x")
    assert items(store.read_txn()) == {b"key01": b"value01", b"key03": b"updated", b"key04": b"value04", b"key05": b"value05", b"key09": b"value09", b"key10": b"x"}


def test_cursor_over_sets(store):
    store.create("d", dup_sort=True)
    with store.write_txn() as txn:
        for v in (b"300", b"100", b"200"):
            txn.put(b"n", v, "d")
        txn.put(b"o", b"1", "d")
    c = store.read_txn().cursor("d")
    assert c.first_dup() is None and c.first() == (b"n", b"100") and c.next_dup() == b"200" and c.next_dup() == b"300" and c.next_dup() is None
    assert c.first_dup() == b"100" and c.next() == (b"o", b"1") and c.next() is None and c.prev() == (b"n", b"100")


def test_orders_of_tables(spark, store):
    for name in ("case_insensitive", "numeric", "reverse_lexicographic", "reversed_key"):
        store.create(name, order=name)
    with store.write_txn() as txn:
        for k in (b"b10", b"A9", b"a9", b"C1", b"B10", b"9"):
            for name in ("case_insensitive", "numeric", "reverse_lexicographic", "reversed_key"):
                txn.put(k, b"v-" + k, name)
    with store.write_txn() as txn:  # over a base too
        txn.put(b"c1", b"again", "case_insensitive")
        txn.delete(b"a9", "numeric")
    t = store.read_txn()
    keys = lambda name: [k for k, _ in t.items(name)]
    assert keys("case_insensitive") == [b"9", b"a9", b"B10", b"c1"] and t.get(b"C1", "case_insensitive") == b"again" and t.count("case_insensitive") == 4
    assert keys("numeric") == [b"9", b"A9", b"C1", b"B10", b"b10"]
    assert keys("reverse_lexicographic") == [b"b10", b"a9", b"C1", b"B10", b"A9", b"9"]
    assert keys("reversed_key") == sorted(keys("reversed_key"), key=lambda k: k.hex()[::-1])
    assert [bytes(r["key"]) for r in t.range(b"A", b"B11", "case_insensitive").collect()] == [b"a9", b"B10"]
    assert [bytes(r["key"]) for r in t.range(b"a9", b"A9", "reverse_lexicographic").collect()] == [b"a9", b"C1", b"B10"]
    c = t.cursor("reverse_lexicographic")
    assert c.first()[0] == b"b10" and c.next()[0] == b"a9" and c.seek(b"a")[0] == b"C1" and c.prev()[0] == b"a9" and c.last()[0] == b"9"
    assert [bytes(r["key"]) for r in t.reverse("numeric").collect()] == keys("numeric")[::-1]
    with pytest.raises(E.InvalidOperation):
        store.create("x", order="none")


def test_typed_tables(spark, store):
    store.create("t", codec=("long", "utf8"))
    from kvloom.functions import codec
    from pyspark.sql import functions as F

    log = spark.range(-3, 3).select(F.col("id").alias("seq"), F.lit("put").alias("op"), codec.be_ordered(F.col("id")).alias("key"), F.encode(F.col("id").cast("string"), "UTF-8").alias("value"))
    with store.write_txn() as txn:
        txn.apply(log, "t")
    assert [tuple(r) for r in store.read_txn().typed("t").orderBy("key").collect()] == [(i, str(i)) for i in range(-3, 3)]


def test_two_processes(spark, store, tmp_path):
    """Two stores on one folder: one writer at a time, and a vacuum keeps what the other reads."""
    other = Store(spark, store.root)
    with store.write_txn() as txn:
        txn.put(b"a", b"1")
    txn = store.write_txn()
    with pytest.raises(E.Conflict):
        other.write_txn(wait=0.1)
    txn.put(b"a", b"2")
    reader = other.read_txn()
    txn.commit()
    with other.write_txn(wait=1.0) as more:
        more.put(b"b", b"3")
    assert reader.id not in store.vacuum() and reader.get(b"a") == b"1" and items(store.read_txn()) == {b"a": b"2", b"b": b"3"}
    assert [r["slot"] for r in store.reader_slots()] == [0, 1]
    reader.close()
    assert reader.id in store.vacuum() and store.clear_stale_readers() == []
    store.files.claim("readers/000007")
    store.files.write_once("readers/000007.1.json", '{"version": 1, "pid": 999999999, "host": "elsewhere", "since": 1.0}')
    assert store.clear_stale_readers() == [7]


def test_a_lock_left_behind(spark, store, monkeypatch):
    from kvloom.sources import store as module

    store.files.claim("writer.lock")
    with pytest.raises(E.Conflict):
        store.write_txn(wait=False)
    monkeypatch.setattr(module, "LEASE", -1.0)
    with store.write_txn() as txn:
        txn.put(b"a", b"1")
    assert store.read_txn().get(b"a") == b"1" and not store.files.exists("writer.lock")


def test_a_bulk_log_is_run_once_and_checked(spark, store):
    from pyspark.sql import functions as F

    runs = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            runs.add(b.num_rows)
            yield b

    log = spark.range(100).selectExpr("id AS seq", "'put' AS op", "encode(lpad(CAST(id AS STRING), 5, '0'), 'UTF-8') AS key", "encode('v', 'UTF-8') AS value")
    log = log.mapInArrow(seen, log.schema)
    with store.write_txn() as txn:
        txn.put(b"00003", b"before")
        txn.apply(log)
        txn.put(b"00004", b"after")
    assert runs.value == 100 and store.read_txn().count() == 100
    assert store.read_txn().get(b"00003") == b"v" and store.read_txn().get(b"00004") == b"after"
    for bad, error in ((log.withColumn("key", F.lit(b"")), E.InvalidOperation), (log.withColumn("key", F.lit(b"k" * 512)), E.BadValueSize)):
        with pytest.raises(error), store.write_txn() as txn:
            txn.apply(bad)
    assert store.read_txn().count() == 100 and not [n for n in store.files.names("tables/main") if "v00000000000000000003" in n]


def test_conditional_operations_without_a_look(store):
    with store.write_txn() as txn:
        txn.put(b"a", b"1")
    with store.write_txn() as txn:
        assert txn.put_no_overwrite(b"a", b"x", tell=False) is None and txn.put_no_overwrite(b"b", b"2", tell=False) is None
        assert txn.update(b"b", b"3", tell=False) is None and txn.update(b"c", b"4", tell=False) is None and txn.delete(b"none", tell=False) is None
    assert items(store.read_txn()) == {b"a": b"1", b"b": b"3"}


def test_growth_durability_and_sync(spark, tmp_path):
    from kvloom.functions.capacity import Growth

    store = Store(spark, f"file://{tmp_path}/s", quota=1000, growth=Growth(2.0, 4096, 1 << 20, 90.0, 1 << 16), durability="no_sync")
    for i in range(4):
        with store.write_txn() as txn:
            txn.put(b"k%d" % i, b"v" * 100)
    assert store.latest()["quota"] > 1000
    store.sync()
    assert Store(spark, store.root).read_txn().count() == 4


def test_validation(spark, store):
    with store.write_txn() as txn:
        txn.put(b"a", b"1")
    assert store.validate().where("problems > 0").count() == 0
    store.require_sound()
    path = store.latest()["tables"]["main"]["path"]
    spark.createDataFrame([(bytearray(b"a"), bytearray(b"1"))], "key binary, value binary").write.mode("append").parquet(f"{store.root}/{path}")
    assert {r["check"] for r in store.validate().where("problems > 0").collect()} >= {"repeated keys", "missing rows"}
    with pytest.raises(E.Corruption):
        store.require_sound()


def test_large_values_as_streams(store):
    from kvloom.sources import large

    data = bytes(range(256)) * 60
    with store.write_txn() as txn:
        assert large.write_stream(txn, b"big", (data[i : i + 1000] for i in range(0, len(data), 1000)), size=4000) == len(data)
        assert large.write_stream(txn, b"none", []) == 0
    reader = store.read_txn()
    assert large.Reader(reader, b"big").readall() == data and large.Reader(reader, b"none").read() == b"" and large.Reader(reader, b"absent").read() == b""
    assert {bytes(r["key"]): (bytes(r["value"]), r["chunks"]) for r in large.whole(reader.table()).collect()} == {b"big": (data, 4), b"none": (b"", 1)}


def test_batcher(store):
    from kvloom.streaming.group_commit import Batcher

    before = store.latest()["version"]
    with Batcher(store, window=0.5) as batcher:
        good, bad, gone = batcher.put(b"a", b"1"), batcher.put(b"", b"2"), batcher.delete(b"a")
        assert good.result() is None and isinstance(bad.result(), E.InvalidOperation) and gone.result() is None
    assert items(store.read_txn()) == {} and store.latest()["version"] == before + 1


def test_appends_go_behind(spark, store):
    rows = lambda *keys: spark.createDataFrame([(bytearray(k), bytearray(b"v")) for k in keys], "key binary, value binary")
    with store.write_txn() as txn:
        txn.append(rows(b"b", b"a"))
    with store.write_txn() as txn:
        txn.append(rows(b"c"))
        with pytest.raises(E.InvalidOperation):
            txn.append(rows(b"c", b"d"))
    assert [k for k, _ in store.read_txn().items()] == [b"a", b"b", b"c"]
