"""Queries that go through a store: each makes one in the session's shared folder, of customers, orders or events at the tables' own size."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvloom.functions import codec
from kvloom.functions.errors import KvError
from kvloom.operators import read, stats
from kvloom.plans.queries import FOLD_SQL, LOG_SQL, PAIRS_SQL, event_log, query, table
from kvloom.sources import large
from kvloom.sources.store import Store
from kvloom.streaming.group_commit import Batcher, Write, commit_batches


def scratch(spark: SparkSession) -> str:
    """The shared folder that the session names; on one machine without one, a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all nodes share")
        import tempfile

        root = tempfile.gettempdir()
    return f"{root.rstrip('/')}/kv-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def puts(t: DataFrame, key: str, value: str) -> DataFrame:
    """A log of puts: numbers as ordered keys, text as values."""
    return t.select(F.col(key).cast("long").alias("seq"), F.lit("put").alias("op"), codec.be_ordered(F.col(key)).alias("key"), codec.utf8_encode(F.col(value)).alias("value"))


def customers(spark: SparkSession, d: str, **options) -> tuple[Store, DataFrame]:
    """A store whose main table is all customers, and the log that made it."""
    store = Store(spark, scratch(spark), **options)
    log = puts(table(spark, d, "customer"), "c_custkey", "c_name")
    with store.write_txn() as txn:
        txn.apply(log)
    return store, log


def shown(t: DataFrame) -> DataFrame:
    return t.select(codec.from_be_ordered(F.col("key")).alias("key"), codec.utf8_decode(F.col("value")).alias("value"))


def key_of(n: int) -> bytes:
    return (n + (1 << 63)).to_bytes(8, "big")


def number_of(key: bytes | None) -> int | None:
    return None if key is None else int.from_bytes(key, "big") - (1 << 63)


ALL_SQL = "SELECT c_custkey AS key, c_name AS value FROM customer"
CHANGED_SQL = "SELECT c_custkey AS key, CASE WHEN c_custkey % 3 = 0 THEN concat('changed-', c_name) ELSE c_name END AS value FROM customer WHERE c_custkey % 5 <> 1"


def change(log: DataFrame) -> DataFrame:
    """Every third customer gets a new value, every fifth but one goes."""
    number = codec.from_be_ordered(F.col("key"))
    new = log.where(number % 3 == 0).withColumn("value", codec.utf8_encode(F.concat(F.lit("changed-"), codec.utf8_decode(F.col("value")))))
    gone = log.where(number % 5 == 1).select((F.col("seq") + (1 << 32)).alias("seq"), F.lit("delete").alias("op"), "key", F.lit(None).cast("binary").alias("value"))
    return new.unionByName(gone)


# versions


@query(ALL_SQL)
def txn_snapshot_old(spark, d):
    store, log = customers(spark, d)
    reader = store.read_txn()
    with store.write_txn() as txn:
        txn.apply(change(log))
    return shown(reader.table())


@query(CHANGED_SQL)
def txn_snapshot_new(spark, d):
    store, log = customers(spark, d)
    with store.write_txn() as txn:
        txn.apply(change(log))
    return shown(store.read_txn().table())


@query(ALL_SQL)
def txn_abort(spark, d):
    store, log = customers(spark, d)
    txn = store.write_txn()
    txn.apply(change(log))
    txn.abort()
    return shown(store.read_txn().table())


@query(CHANGED_SQL)
def txn_upgrade(spark, d):
    """A reader becomes the writer."""
    store, log = customers(spark, d)
    with store.read_txn().upgrade() as txn:
        txn.apply(change(log))
    return shown(store.read_txn().table())


@query(ALL_SQL)
def txn_downgrade(spark, d):
    """A writer drops its changes and reads on."""
    store, log = customers(spark, d)
    txn = store.write_txn()
    txn.apply(change(log))
    return shown(txn.downgrade().table())


@query(FOLD_SQL.format(log=LOG_SQL))
def kv_read_your_writes(spark, d):
    """All events staged over the customers, read before the commit."""
    store, _ = customers(spark, d)
    txn = store.write_txn()
    txn.apply(event_log(spark, d).select("seq", "op", codec.be_ordered(F.col("key")).alias("key"), codec.utf8_encode(F.col("value")).alias("value")))
    return shown(txn.table())


@query(CHANGED_SQL)
def txn_recover(spark, d):
    """A store opened again behind a torn manifest: the newest whole one is the state."""
    store, log = customers(spark, d)
    with store.write_txn() as txn:
        txn.apply(change(log))
    store.files.write_once(store._manifest(store.latest()["version"] + 1), '{"sum": "torn"')
    return shown(Store(spark, store.root).read_txn().table())


@query("SELECT mode, n AS entries FROM (SELECT unnest(['no_sync', 'async_flush', 'sync_data', 'full_sync']) AS mode), (SELECT count(*) AS n FROM customer)")
def txn_durability(spark, d):
    out = None
    for mode in ("no_sync", "async_flush", "sync_data", "full_sync"):
        store, _ = customers(spark, d, durability=mode)
        store.sync()
        one = store.read_txn().table().agg(F.count("*").alias("entries")).select(F.lit(mode).alias("mode"), "entries")
        out = one if out is None else out.unionByName(one)
    return out


@query("""SELECT name, code FROM (VALUES ('nested', -30784), ('empty key', -30784), ('long key', -30781), ('long value', -30781), ('closed', -30782), ('no table', -30794), ('unnamed drop', -30784), ('many tables', -30792),
('many readers', -30791), ('two writers', -1), ('full map', -30793), ('append behind', -30784), ('update of sets', -30784), ('read only', -30784)) t(name, code)""")
def txn_refusals(spark, d):
    """What a store refuses, and the code of each error."""
    store, log = customers(spark, d, max_readers=1, max_databases=1, quota=1 << 40)
    store.create("sets", dup_sort=True)
    found = []

    def case(name, run):
        try:
            run()
        except KvError as error:
            found.append((name, error.code))

    def long_value(txn):
        store.max_value = 10
        txn.put(b"k", b"v" * 11)

    def full():
        with Store(spark, scratch(spark), quota=1).write_txn() as small:
            small.apply(log)

    txn = store.write_txn()
    case("nested", txn.begin_nested)
    case("empty key", lambda: txn.put(b"", b"x"))
    case("long key", lambda: txn.put(b"k" * 512, b"x"))
    case("long value", lambda: long_value(txn))
    case("no table", lambda: txn.put(b"k", b"v", "nowhere"))
    case("unnamed drop", lambda: txn.drop(""))
    case("many tables", lambda: txn.create("more"))
    case("append behind", lambda: txn.append(log.limit(5).select("key", "value")))
    case("update of sets", lambda: txn.update(b"k", b"v", "sets", tell=False))
    case("two writers", lambda: Store(spark, store.root).write_txn(wait=False))
    txn.abort()
    case("closed", lambda: txn.put(b"k", b"v"))
    with store.read_txn() as reader:
        case("many readers", store.read_txn)
        case("read only", lambda: reader.cursor().put(b"k", b"v"))
    case("full map", full)
    return spark.createDataFrame(found, "name string, code int")


@query("SELECT 4 AS versions, 2 AS gone, 1 AS gone_later, n AS entries FROM (SELECT count(*) AS n FROM customer WHERE c_custkey % 5 <> 1)")
def store_vacuum(spark, d):
    """Versions that a reader holds stay until it ends."""
    store, log = customers(spark, d)
    reader = store.read_txn()
    for part in (change(log), change(log).where("op = 'delete'")):
        with store.write_txn() as txn:
            txn.apply(part)
    versions = len(store.versions())
    gone = len(store.vacuum())
    reader.close()
    later = len(store.vacuum())
    return store.read_txn().table().agg(F.count("*").alias("entries")).select(F.lit(versions).alias("versions"), F.lit(gone).alias("gone"), F.lit(later).alias("gone_later"), "entries")


@query("SELECT 3 AS readers, 1 AS oldest_txn, 2 AS newest_txn")
def reader_table(spark, d):
    """Open readers of a store, through two handles of it."""
    store, log = customers(spark, d)
    store.read_txn()
    with store.write_txn() as txn:
        txn.apply(change(log))
    store.read_txn()
    Store(spark, store.root).read_txn()
    store.read_txn().close()
    return store.reader_table().agg(F.count("*").alias("readers"), F.min("txn_id").alias("oldest_txn"), F.max("txn_id").alias("newest_txn"))


# catalog


@query("SELECT 'customers' AS name, false AS dup, count(*) AS entries FROM customer UNION ALL SELECT 'main', false, 0 UNION ALL SELECT 'kinds', true, count(DISTINCT user_id) FROM events UNION ALL SELECT 'regions', false, count(*) FROM region")
def cat_list(spark, d):
    store = Store(spark, scratch(spark))
    with store.write_txn() as txn:
        txn.create("customers")
        txn.create("regions")
        txn.create("kinds", dup_sort=True)
        txn.apply(puts(table(spark, d, "customer"), "c_custkey", "c_name"), "customers")
        txn.apply(puts(table(spark, d, "region"), "r_regionkey", "r_name"), "regions")
        txn.apply(kinds(spark, d), "kinds")
    return store.databases()


def kinds(spark, d):
    e = table(spark, d, "events")
    return e.select(F.col("event_id").alias("seq"), F.lit("put_dup").alias("op"), codec.be_ordered(F.col("user_id")).alias("key"), codec.utf8_encode(F.col("event_type")).alias("value"))


@query("SELECT c_custkey AS key, c_name AS value FROM customer WHERE c_custkey % 2 = 0")
def cat_drop_and_create(spark, d):
    """A table dropped and made again holds what is put then; the others stay."""
    store, log = customers(spark, d)
    for part in (log, log.where(codec.from_be_ordered(F.col("key")) % 2 == 0)):
        with store.write_txn() as txn:
            if "half" in txn.state["tables"]:
                txn.drop("half")
            txn.create("half", codec=("long", "utf8"))
            txn.apply(part, "half")
    assert store.open("half")["codec"] == ["long", "utf8"]
    return store.read_txn().typed("half")


@query("SELECT DISTINCT lower(p_type) AS key, 'second' AS value FROM part")
def store_order_case_insensitive(spark, d):
    """Types put as they are and then in capitals are one key each."""
    store = Store(spark, scratch(spark))
    store.create("types", order="case_insensitive", codec=("utf8", "utf8"))
    p = table(spark, d, "part")
    for value, key in (("first", F.col("p_type")), ("second", F.upper("p_type"))):
        with store.write_txn() as txn:
            txn.apply(p.select(F.col("p_partkey").alias("seq"), F.lit("put").alias("op"), codec.utf8_encode(key).alias("key"), codec.utf8_encode(F.lit(value)).alias("value")), "types")
    return store.read_txn().typed("types").select(F.lower("key").alias("key"), "value")


@query("SELECT key, row_number() OVER (ORDER BY strlen(key), key) AS rn FROM (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS key FROM orders)")
def store_order_numeric(spark, d):
    """Decimal text as keys, in number order."""
    store = Store(spark, scratch(spark))
    store.create("numbers", order="numeric")
    with store.write_txn() as txn:
        o = table(spark, d, "orders")
        txn.apply(o.select(F.col("o_orderkey").alias("seq"), F.lit("put").alias("op"), codec.utf8_encode(F.col("o_custkey").cast("string")).alias("key"), codec.utf8_encode(F.lit("x")).alias("value")), "numbers")
    reader = store.read_txn()
    return read.positions(reader.table("numbers"), reader.order("numbers")).select(codec.utf8_decode(F.col("key")).alias("key"), "rn")


# cursors

WALK_SQL = "SELECT CAST(step AS INTEGER) AS step, key, value FROM (VALUES {rows}) w(step, spot) LEFT JOIN (SELECT c_custkey AS key, c_name AS value, row_number() OVER (ORDER BY c_custkey) AS rn, count(*) OVER () AS n FROM customer) ON rn = CASE WHEN spot < 0 THEN n + 1 + spot ELSE spot END"


@query(WALK_SQL.format(rows="(0, NULL), (1, 1), (2, 2), (3, 3), (4, 2), (5, 2), (6, 101), (7, 102), (8, -1), (9, NULL), (10, -2), (11, 1), (12, NULL), (13, NULL)"))
def store_cursor_walk(spark, d):
    store, _ = customers(spark, d)
    c = store.read_txn().cursor()
    moves = [c.current, c.first, c.next, c.next, c.prev, c.current, lambda: c.seek(key_of(100)), c.next, c.last, c.next, c.prev, lambda: c.seek(key_of(-9)), c.prev, lambda: c.seek(key_of(1 << 40))]
    rows = []
    for step, move in enumerate(moves):
        entry = move()
        rows.append((step, number_of(entry[0]) if entry else None, entry[1].decode() if entry else None))
    return spark.createDataFrame(rows, "step int, key long, value string")


@query("""SELECT c_custkey AS key, CASE c_custkey WHEN 7 THEN 'updated' ELSE c_name END AS value FROM customer WHERE c_custkey <> 11 UNION ALL SELECT -4, 'put'""")
def store_cursor_changes(spark, d):
    store, _ = customers(spark, d)
    with store.write_txn() as txn:
        c = txn.cursor()
        c.put(key_of(-4), b"put")
        c.seek(key_of(7))
        c.update(b"updated")
        c.seek(key_of(11))
        c.delete()
        c.put_no_overwrite(key_of(12), b"not this")
    return shown(store.read_txn().table())


@query(f"SELECT row_number() OVER (ORDER BY value) AS place, value FROM {PAIRS_SQL} WHERE key = (SELECT min(user_id) FROM events)")
def store_cursor_sets(spark, d):
    """The values of the first key, one by one."""
    store = Store(spark, scratch(spark))
    store.create("kinds", dup_sort=True)
    with store.write_txn() as txn:
        txn.apply(kinds(spark, d), "kinds")
    c = store.read_txn().cursor("kinds")
    c.first()
    rows, value = [], c.first_dup()
    while value is not None:
        rows.append((len(rows) + 1, value.decode()))
        value = c.next_dup()
    return spark.createDataFrame(rows, "place long, value string")


@query(f"SELECT key, value FROM {PAIRS_SQL} WHERE value <> 'click'")
def store_sets(spark, d):
    """Sets of values put and deleted in bulk."""
    store = Store(spark, scratch(spark))
    store.create("kinds", dup_sort=True)
    log = kinds(spark, d)
    with store.write_txn() as txn:
        txn.apply(log, "kinds")
    with store.write_txn() as txn:
        txn.apply(log.where(codec.utf8_decode(F.col("value")) == "click").withColumn("op", F.lit("delete_dup")), "kinds")
    return shown(store.read_txn().table("kinds"))


# scans, files, copies


@query("SELECT c_custkey AS key, c_name AS value, row_number() OVER (ORDER BY c_custkey DESC) AS rn FROM customer")
def store_reverse_scan(spark, d):
    store, _ = customers(spark, d)
    return shown_places(read.positions(store.read_txn().table(), read.LEXICOGRAPHIC.reversed()))


def shown_places(t: DataFrame) -> DataFrame:
    return t.select(codec.from_be_ordered(F.col("key")).alias("key"), codec.utf8_decode(F.col("value")).alias("value"), "rn")


@query("SELECT c_custkey AS key, c_name AS value FROM customer WHERE c_custkey >= 50 AND c_custkey < 400")
def store_range(spark, d):
    store, _ = customers(spark, d)
    return shown(store.read_txn().range(key_of(50), key_of(400)))


@query("SELECT count(*) AS entries, min(c_custkey) AS low, max(c_custkey) AS high, 0 AS overlapping FROM customer")
def store_files(spark, d):
    """The files of a base: what they hold together, and how many key ranges overlap."""
    store, _ = customers(spark, d)
    t = store.read_txn().table()
    over = stats.overlapping_files(t).count()
    number = codec.from_be_ordered
    return stats.file_ranges(t).agg(F.sum("entries").alias("entries"), F.min("low").alias("l"), F.max("high").alias("h")).select("entries", number(F.col("l")).alias("low"), number(F.col("h")).alias("high"), F.lit(over).alias("overlapping"))


@query("SELECT lpad(hex(CAST(9223372036854775808 + CAST(c_custkey AS HUGEINT) AS UHUGEINT)), 16, '0') AS key, hex(encode(c_name)) AS value FROM customer")
def store_leaf_dump(spark, d):
    """Raw bytes as the files hold them."""
    store, _ = customers(spark, d)
    return stats.leaf_entries(store.read_txn().table()).drop("file")


@query(ALL_SQL)
def store_copy(spark, d):
    store, _ = customers(spark, d)
    return shown(store.copy(scratch(spark)).read_txn().table())


@query(CHANGED_SQL)
def store_compact_copy(spark, d):
    store, log = customers(spark, d, logs=100, log_share=1e9)
    with store.write_txn() as txn:
        txn.apply(change(log))
    return shown(store.copy(scratch(spark), compact=True).read_txn().table())


@query("SELECT name, CAST(done AS INTEGER) AS done, 3 AS total FROM (VALUES ('a', 1), ('b', 2), ('main', 3)) t(name, done)")
def store_copy_progress(spark, d):
    store, log = customers(spark, d)
    seen = []
    for name in ("a", "b"):
        store.create(name)
    store.copy(scratch(spark), callback=lambda *step: seen.append(step))
    return spark.createDataFrame(seen, "name string, done int, total int")


@query("SELECT name, check_, 0 AS problems FROM (SELECT 'main' AS name), (SELECT unnest(['missing folders', 'bad sizes', 'repeated keys', 'overlapping files', 'missing rows']) AS check_)")
def store_validate(spark, d):
    store, log = customers(spark, d)
    with store.write_txn() as txn:
        txn.apply(change(log))
    return store.validate().withColumnRenamed("check", "check_")


@query("SELECT c_custkey AS key, c_name AS value FROM customer UNION ALL SELECT c_custkey + 10000000 AS key, c_name AS value FROM customer")
def store_append(spark, d):
    store, log = customers(spark, d)
    with store.write_txn() as txn:
        txn.append(log.select(codec.be_ordered(codec.from_be_ordered(F.col("key")) + 10_000_000).alias("key"), "value"))
    return shown(store.read_txn().table())


# group commit and large values


@query(FOLD_SQL.format(log=LOG_SQL))
def batch_group_commit(spark, d):
    """All events committed over the customers in four batches, one version each, and read from the last."""
    store, _ = customers(spark, d)
    log = event_log(spark, d).select("seq", "op", codec.be_ordered(F.col("key")).alias("key"), codec.utf8_encode(F.col("value")).alias("value"))
    made = commit_batches(store, log, 4)
    assert store.latest()["version"] == made[-1]
    return shown(store.read_txn().table())


@query("SELECT CAST(n_nationkey AS BIGINT) AS write, n_nationkey % 7 <> 3 AS done, n_nationkey % 7 <> 3 AS there FROM nation")
def batch_results(spark, d):
    """Writes of several threads' making, each with its own result: an empty key refuses its whole write."""
    store = Store(spark, scratch(spark))
    names = table(spark, d, "nation").select("n_nationkey", "n_name").collect()  # 25 rows at every size
    with Batcher(store, window=0.2) as batcher:
        waiting = {}
        for r in names:
            write = Write().put(key_of(r["n_nationkey"]), r["n_name"].encode())
            waiting[r["n_nationkey"]] = batcher.submit(write.put(b"", b"x") if r["n_nationkey"] % 7 == 3 else write)
    there = {number_of(k) for k, _ in store.read_txn().items()}
    return spark.createDataFrame([(n, w.result() is None, n in there) for n, w in waiting.items()], "write long, done boolean, there boolean")


@query("SELECT doc_id AS id, CAST(greatest((strlen(coalesce(text, '')) + 4055) // 4056, 1) AS BIGINT) AS chunks, md5(text) AS md5 FROM documents WHERE text IS NOT NULL")
def store_large_values(spark, d):
    """Whole texts in a table of chunks, put together again."""
    store = Store(spark, scratch(spark))
    docs = table(spark, d, "documents").select(codec.be_ordered(F.col("doc_id")).alias("key"), codec.utf8_encode(F.col("text")).alias("value"))
    with store.write_txn() as txn:
        txn.apply(large.chunked(docs).select(F.monotonically_increasing_id().alias("seq"), F.lit("put").alias("op"), "key", "value"))
    whole = large.whole(store.read_txn().table())
    return whole.select(codec.from_be_ordered(F.col("key")).alias("id"), "chunks", F.md5("value").alias("md5"))
