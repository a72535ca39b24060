"""A store of named, versioned key-value tables.

A store is a folder. A table is an immutable folder of Parquet files in key order, its base, and the
logs of the commits since, each a folder of its own; reading folds the logs over the base. A version
of the whole store is one small manifest that names the tables and their folders. A commit writes its
operations as one more log, or, when the logs have become many or large against the base, a new base
(see ``LOGS`` and ``LOG_SHARE``); so a small commit costs its own size, not the table's. Then it
writes one new manifest; readers keep the manifest that they
began with, so they see one state whatever is committed meanwhile. The newest manifest that is
whole is the state after a crash. Old versions go when no reader holds them (``vacuum``).

Processes that share a store find each other through files in it: the writer holds ``writer.lock``, each
reader a numbered slot with its version, so there is one writer at a time, ``max_readers`` holds over
all of them, and a vacuum keeps what any of them reads.

A bulk log is run once: it is written to its folder in the store as it is staged, checked by what was
observed on the way, and the commit only names the folder.

Rules: empty keys are refused everywhere; keys and values have size limits; the unnamed table is
called ``main`` and has unique keys; a table's order says which keys are one key and how it is
scanned, and is fixed when it is made; version numbers are never used twice.
"""

from __future__ import annotations

import hashlib
import json
import os
import socket
import threading
import time
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from kvloom.functions import capacity
from kvloom.functions.codec import CODECS
from kvloom.functions.errors import BadTransaction, BadValueSize, Conflict, Corruption, DatabasesFull, InvalidDatabase, InvalidOperation, KvError, MapFull, ReadersFull
from kvloom.functions.order import TABLE_ORDERS, Order
from kvloom.operators import dup, stats, write
from kvloom.sources.files import Files

MAIN = "main"
SCHEMA = "key binary, value binary"
LOG_SCHEMA = "seq long, op string, key binary, value binary"
#: How far a manifest's bytes go before a commit returns. Data files are closed before that in any case.
DURABILITY = {"no_sync": "none", "async_flush": "hflush", "sync_data": "hsync", "full_sync": "hsync"}
# Defaults and limits.
MAP_SIZE, MAX_READERS, MAX_DATABASES = 1 << 30, 126, 128
MAX_KEY, MAX_VALUE = 511, 1 << 30
#: A new base is written when a table has more logs than this, or logs of more than this share of its base's bytes.
LOGS, LOG_SHARE = 8, 1.0
#: Seconds after which a writer's lock counts as left behind, seconds between two tries to get it, and seconds after which a reader is stale.
LEASE, RETRY, STALE = 3600.0, 0.02, 300.0


class Store:
    """An open store.

    ``quota`` in bytes is checked on commit if given, and grows by ``growth`` where that is given and its
    threshold is reached; the size that a commit leaves is kept in the manifest.
    """

    def __init__(self, spark: SparkSession, root: str, map_size: int = MAP_SIZE, max_readers: int = MAX_READERS, max_databases: int = MAX_DATABASES, durability: str = "async_flush", quota: int | None = None, growth: capacity.Growth | None = None, max_key: int = MAX_KEY, max_value: int = MAX_VALUE, bloom: bool = False, logs: int = LOGS, log_share: float = LOG_SHARE):
        if durability not in DURABILITY:
            raise InvalidOperation(f"unknown durability {durability}")
        self.spark, self.files = spark, Files(spark, root)
        self.root = self.files.root
        self.map_size, self.max_readers, self.max_databases = map_size, max_readers, min(max_databases, MAX_DATABASES)
        self.durability, self.quota, self.growth, self.max_key, self.max_value = durability, quota, growth, max_key, max_value
        self.logs, self.log_share = logs, log_share
        self.bloom = bloom  # Parquet Bloom filters on keys, for gets of keys that are not there
        self.guard = threading.Lock()
        self.files.make("manifests")
        self.files.make("readers")
        if not self.versions():
            self.files.write_once(self._manifest(0), self._text({"version": 0, "tables": {MAIN: new_table()}}), DURABILITY[durability])

    # manifests

    @staticmethod
    def _manifest(version: int) -> str:
        return f"manifests/v{version:020d}.json"

    @staticmethod
    def _text(state: dict) -> str:
        body = json.dumps(state, sort_keys=True)
        return json.dumps({"sum": hashlib.sha256(body.encode()).hexdigest(), "body": body})

    def versions(self) -> list[int]:
        return [int(n[1:-5]) for n in self.files.names("manifests") if n.startswith("v") and n.endswith(".json")]

    def state(self, version: int) -> dict | None:
        """Manifest of a version, or None if it is not whole."""
        try:
            outer = json.loads(self.files.read(self._manifest(version)))
            body = outer["body"]
            return json.loads(body) if hashlib.sha256(body.encode()).hexdigest() == outer["sum"] else None
        except (ValueError, KeyError):
            return None

    def latest(self) -> dict:
        for version in sorted(self.versions(), reverse=True):
            if (state := self.state(version)) is not None:
                return state
        raise InvalidDatabase("no whole manifest")

    # transactions

    def read_txn(self) -> ReadTxn:
        """A snapshot of the newest state, in a reader's slot of its own."""
        for slot in range(self.max_readers):
            if self.files.claim(f"readers/{slot:06d}"):
                break
        else:
            raise ReadersFull(f"{self.max_readers} readers")
        # a slot without a version holds every version, so none goes before this one is known
        state = self.latest()
        about = {"version": state["version"], "pid": os.getpid(), "host": socket.gethostname(), "since": time.time()}
        self.files.write_once(f"readers/{slot:06d}.{state['version']}.json", json.dumps(about), "none")
        return ReadTxn(self, state, slot)

    def reader_slots(self) -> list[dict]:
        """What open readers of all processes say of themselves; the version is None while one begins."""
        names = self.files.names("readers")
        found = {int(n): {"slot": int(n), "version": None, "pid": None, "host": None, "since": None} for n in names if n.isdigit()}
        for n in names:
            if n.endswith(".json") and int(n.split(".")[0]) in found:
                try:
                    found[int(n.split(".")[0])] |= json.loads(self.files.read(f"readers/{n}"))
                except Exception:  # closed meanwhile
                    if self.files.exists(f"readers/{n}"):
                        raise
        return [found[k] for k in sorted(found)]

    def free_slot(self, slot: int) -> None:
        for n in self.files.names("readers"):
            if n.startswith(f"{slot:06d}.") and not n.endswith(".part"):
                self.files.delete(f"readers/{n}")
        self.files.delete(f"readers/{slot:06d}")

    def clear_stale_readers(self, older: float = STALE) -> list[int]:
        """Free the slots of processes of this machine that have ended, and of others' readers that are too old; their numbers."""
        gone = []
        for r in self.reader_slots():
            age = time.time() - r["since"] if r["since"] else self.files.age(f"readers/{r['slot']:06d}")
            if r["host"] == socket.gethostname():
                dead = not _alive(r["pid"])
            else:
                dead = age > older
            if dead:
                self.free_slot(r["slot"])
                gone.append(r["slot"])
        return gone

    def write_txn(self, wait: bool | float = True) -> WriteTxn:
        """The one write transaction of all processes. Others wait, for so many seconds if a number is given, or fail with ``wait=False``."""
        owner, until = uuid.uuid4().hex, time.time() + (float("inf") if wait is True else float(wait))
        while not self.files.claim("writer.lock"):
            if self.files.age("writer.lock") > LEASE:  # left behind by a process that has ended
                self.files.delete("writer.lock")
            elif time.time() >= until:
                raise Conflict("another write transaction is open")
            else:
                time.sleep(RETRY)
        try:
            return WriteTxn(self, self.latest(), owner)
        except BaseException:
            self.files.delete("writer.lock")
            raise

    def create(self, name: str, dup_sort: bool = False, codec: tuple[str, str] = ("bytes", "bytes"), order: str = "lexicographic") -> None:
        """A new table; one that is there keeps its flags, codec and order."""
        with self.write_txn() as txn:
            txn.create(name, dup_sort, codec, order)

    def open(self, name: str) -> dict:
        """What the catalog says of a table."""
        tables = self.latest()["tables"]
        if name not in tables:
            raise InvalidDatabase(name)
        return tables[name]

    def drop(self, name: str) -> None:
        with self.write_txn() as txn:
            txn.drop(name)

    def databases(self) -> DataFrame:
        """(name, dup, entries) of every table; entries are keys, counted when the result is read."""
        txn = Txn(self, self.latest())
        out = None
        for n, t in sorted(txn.state["tables"].items()):
            keys = txn.table(n).select("key")
            one = (keys.distinct() if t["dup"] else keys).agg(F.count("*").alias("entries")).select(F.lit(n).alias("name"), F.lit(t["dup"]).alias("dup"), "entries")
            out = one if out is None else out.unionByName(one)
        return out

    def rewrites(self, t: dict) -> bool:
        """Whether a table is to get a new base."""
        size = sum(self.files.bytes(p) for p, *_ in t["logs"])
        return not t["path"] or len(t["logs"]) > self.logs or size > self.log_share * self.files.bytes(t["path"])

    def write_options(self) -> dict[str, str]:
        return {"parquet.bloom.filter.enabled#key": "true"} if self.bloom else {}

    # reports

    def reader_table(self) -> DataFrame:
        """(slot, txn_id, pid, since) of open readers of all processes."""
        rows = [(r["slot"], r["version"], r["pid"], r["since"]) for r in self.reader_slots()]
        return self.spark.createDataFrame(rows, "slot int, txn_id long, pid long, since double")

    def used_bytes(self, state: dict | None = None) -> int:
        return sum(self.files.bytes(p) for t in (state or self.latest())["tables"].values() for p in folders(t))

    def validate(self) -> DataFrame:
        """(name, check, problems) of the current state: what the data files say against what the manifest and the model say."""
        out = None
        reader = Txn(self, self.latest())
        for name, t in sorted(reader.state["tables"].items()):
            lost = sum(not self.files.exists(p) for p in folders(t))
            checks = {"missing folders": self.spark.range(lost)}
            if not lost:
                rows, k = reader.table(name), F.col("key")
                bad = k.isNull() | (F.octet_length(k) == 0) | (F.octet_length(k) > self.max_key) | F.col("value").isNull() | (F.octet_length("value") > self.max_value)
                checks |= {"bad sizes": rows.where(bad), "repeated keys": rows.groupBy(*(["key", "value"] if t["dup"] else [reader.order(name).same(k)])).count().where("count > 1")}
                if t["path"]:
                    base = self.spark.read.schema(SCHEMA).parquet(f"{self.root}/{t['path']}")
                    checks["overlapping files"] = stats.overlapping_files(base) if reader.order(name).name == "lexicographic" and not t["dup"] else self.spark.range(0)
                    checks["missing rows"] = self.spark.range(1).join(base.agg(F.count("*").alias("n"))).where(F.col("n") != t["rows"])
            for check, wrong in checks.items():
                one = wrong.agg(F.count("*").alias("problems")).select(F.lit(name).alias("name"), F.lit(check).alias("check"), "problems")
                out = one if out is None else out.unionByName(one)
        return out

    def require_sound(self) -> None:
        """Raise ``Corruption`` if ``validate`` finds anything."""
        found = self.validate().where("problems > 0").collect()
        if found:
            raise Corruption("; ".join(f"{r['name']}: {r['problems']} {r['check']}" for r in found))

    def space_info(self) -> DataFrame:
        """One row from the real sizes of the current version's files and of older ones."""
        now = self.used_bytes()
        all_ = self.files.bytes("tables")
        used, total = -(-now // capacity.PAGE), -(-all_ // capacity.PAGE)
        row = self.spark.createDataFrame([(total, used, max(total - used, 0), self.map_size)], "t long, u long, f long, m long")
        return row.select(*capacity.space_info(F.col("t"), F.col("u"), F.col("f"), F.col("m")))

    def sync(self) -> None:
        """Bring the current state to the disk, whatever the durability of the commits before: one more manifest of it."""
        if DURABILITY[self.durability] != "hsync":
            with self.write_txn() as txn:
                txn.changed, txn.flush = True, "hsync"

    # upkeep

    def vacuum(self) -> list[int]:
        """Delete versions older than the newest that no reader of any process holds; their numbers. Nothing goes while a reader begins."""
        slots = self.reader_slots()
        if any(r["version"] is None for r in slots):
            return []
        newest = self.latest()["version"]
        held = {r["version"] for r in slots} | {newest}
        gone = [v for v in self.versions() if v < newest and v not in held]
        kept = {p for v in held if (s := self.state(v)) for t in s["tables"].values() for p in folders(t)}
        dropped = {p for v in gone if (s := self.state(v)) for t in s["tables"].values() for p in folders(t)}
        for v in gone:
            self.files.delete(self._manifest(v))
        for path in dropped - kept:
            self.files.delete(path)
        return gone

    def copy(self, to: str, compact: bool = False, callback: Callable[[str, int, int], None] | None = None) -> Store:
        """A store of its own with this one's current state. ``compact`` rewrites tables in key order into few files; otherwise rows are copied as they lie. ``callback`` gets (table, done, all)."""
        txn = self.read_txn()
        try:
            target = Store(self.spark, to, self.map_size, self.max_readers, self.max_databases, self.durability)
            if len(target.versions()) > 1:
                raise InvalidOperation(f"{to} holds a store already")
            tables = txn.state["tables"]
            made = {}
            for done, (name, t) in enumerate(tables.items(), 1):
                made[name] = dict(t) | {"logs": []}
                if folders(t):
                    made[name]["path"] = f"tables/{name}/v{1:020d}"
                    rows = txn.table(name)
                    rows = in_key_order(rows, t["dup"], txn.order(name)) if compact else rows
                    made[name]["rows"] = written(rows, f"{target.root}/{made[name]['path']}")
                if callback:
                    callback(name, done, len(tables))
            target.files.write_once(self._manifest(1), self._text({"version": 1, "tables": made}))
            return target
        finally:
            txn.close()


def _alive(pid: int) -> bool:
    try:
        os.kill(pid, 0)
    except ProcessLookupError:
        return False
    except PermissionError:  # another user's
        return True
    return True


def new_table(dup_sort: bool = False, codec: tuple[str, str] = ("bytes", "bytes"), order: str = "lexicographic") -> dict:
    return {"dup": dup_sort, "path": None, "rows": 0, "logs": [], "codec": list(codec), "order": order}


def in_key_order(rows: DataFrame, dup_sort: bool, order: Order | None = None) -> DataFrame:
    """Rows dealt and sorted by key, so that files and row groups have narrow key ranges."""
    by = ["key", "value"] if dup_sort else order.by(F.col("key")) if order else ["key"]
    return rows.repartitionByRange(*by).sortWithinPartitions(*by)


def written(rows: DataFrame, path: str, options: dict[str, str] | None = None) -> int:
    """Write rows to a folder; how many there were."""
    seen = Observation()
    rows.observe(seen, F.count("*").alias("n")).write.options(**(options or {})).parquet(path)
    return seen.get["n"]


def folders(t: dict) -> list[str]:
    """All folders of a table."""
    return [p for p in (t["path"], *(p for p, *_ in t["logs"])) if p]


class Txn:
    """What reads share. ``table(name)`` is the rows of a table as this transaction sees them."""

    def __init__(self, store: Store, state: dict):
        self.store, self.state, self.open = store, state, True

    @property
    def id(self) -> int:
        return self.state["version"]

    def check(self, name: str) -> dict:
        if not self.open:
            raise BadTransaction("the transaction is closed")
        if name not in self.state["tables"]:
            raise InvalidDatabase(name)
        return self.state["tables"][name]

    def order(self, name: str = MAIN) -> Order:
        return TABLE_ORDERS[self.check(name)["order"]]

    def table(self, name: str = MAIN, where: Column | None = None) -> DataFrame:
        """Rows of a table; a predicate on ``key`` goes to the scans of base and logs."""
        t = self.check(name)
        spark, root = self.store.spark, self.store.root
        base = spark.read.schema(SCHEMA).parquet(f"{root}/{t['path']}") if t["path"] else spark.createDataFrame([], SCHEMA)
        logs, at, kinds = [], 0, [0, 0]
        for path, low, high, *counts in self.log_parts(name):
            kinds = [a + b for a, b in zip(kinds, counts, strict=True)]
            # numbers of a log follow those of the logs before it
            part = spark.read.schema(LOG_SCHEMA).parquet(f"{root}/{path}") if isinstance(path, str) else path
            logs.append(part.withColumn("seq", F.col("seq") + (at - low)))
            at += high - low + 1
        base = base if where is None else base.where(where)
        if not logs:
            return base
        log = logs[0]
        for more in logs[1:]:
            log = log.unionByName(more)
        if where is not None:
            log = log.where(where | F.col("key").isNull())
        return dup.fold(base, log) if t["dup"] else write.fold(base, log, self.order(name), kinds[0] > 0, kinds[1] > 0)

    def log_parts(self, name: str) -> list:
        """(path or rows, least number, greatest number, conditional operations, clears) of the table's logs, in order."""
        return self.check(name)["logs"]

    def typed(self, name: str = MAIN) -> DataFrame:
        """Rows of a table, decoded as its codec says."""
        key, value = (CODECS[c] for c in self.check(name)["codec"])
        return self.table(name).select(key.decode(F.col("key")).alias("key"), value.decode(F.col("value")).alias("value"))

    def is_key(self, key: bytes, name: str) -> Column:
        """Whether a row's key is this key, by the table's order."""
        same = self.order(name).same
        return F.col("key") == F.lit(key) if self.order(name).by_key else same(F.col("key")) == same(F.lit(key))

    def scan(self, name: str = MAIN) -> DataFrame:
        """All rows in the table's order."""
        by = self.order(name).by(F.col("key"))
        return self.table(name).orderBy(*by, "value")

    def reverse(self, name: str = MAIN) -> DataFrame:
        """All rows from the last to the first."""
        by = self.order(name).reversed().by(F.col("key"))
        return self.table(name).orderBy(*by, F.desc("value"))

    def get(self, key: bytes, name: str = MAIN) -> bytes | None:
        """Value of a key; the smallest one in a table of sets."""
        rows = self.table(name, self.is_key(key, name)).orderBy("value").limit(1).collect()
        return bytes(rows[0]["value"]) if rows else None

    def get_all(self, key: bytes, name: str = MAIN) -> list[bytes]:
        return [bytes(r["value"]) for r in self.table(name, self.is_key(key, name)).orderBy("value").collect()]

    def range(self, start: bytes | None, end: bytes | None, name: str = MAIN) -> DataFrame:
        """Rows from ``start`` up to but not with ``end``, in the table's order."""
        order, k, where = self.order(name), F.col("key"), None
        plain = len(order.sort(k)) == 1  # a plain comparison, which scans can use
        rank = (lambda c: order.sort(c)[0]) if plain else order.rank
        lo, hi = (k_ if k_ is None else rank(F.lit(k_)) for k_ in (start, end))
        for side in ([rank(k) <= lo if order.descending else rank(k) >= lo] if start is not None else []) + ([rank(k) > hi if order.descending else rank(k) < hi] if end is not None else []):
            where = side if where is None else where & side
        return self.table(name, where).orderBy(*order.by(k), "value")

    def items(self, name: str = MAIN):
        """Rows in order, one at a time on the driver."""
        return ((bytes(r["key"]), bytes(r["value"])) for r in self.scan(name).toLocalIterator())

    def cursor(self, name: str = MAIN):
        """A position in a table of this transaction."""
        from kvloom.sources.cursor import Cursor

        return Cursor(self, name)

    def count(self, name: str = MAIN) -> int:
        """Entries: keys, also in a table of sets."""
        t = self.table(name)
        return t.select("key").distinct().count() if self.check(name)["dup"] else t.count()

    def __enter__(self):
        return self


class ReadTxn(Txn):
    """A snapshot; holds a reader slot until closed."""

    def __init__(self, store: Store, state: dict, slot: int):
        super().__init__(store, state)
        self.slot = slot

    def close(self) -> None:
        if self.open:
            self.open = False
            self.store.free_slot(self.slot)

    def upgrade(self) -> WriteTxn:
        """A write transaction on the newest state; fails if one is open."""
        if not self.open:
            raise BadTransaction("the transaction is closed")
        txn = self.store.write_txn(wait=False)
        self.close()
        return txn

    def __exit__(self, *_):
        self.close()


class WriteTxn(Txn):
    """Staged changes; ``commit`` publishes all of them, leaving the block with an error or ``abort`` none."""

    def __init__(self, store: Store, state: dict, owner: str):
        super().__init__(store, json.loads(json.dumps(state)))
        # numbers of broken or aborted versions are not used again
        self.number = max([*store.versions(), state["version"]]) + 1
        self.owner = owner
        #: Logs written for each table, and operations after them that are not written yet.
        self.parts: dict[str, list[list]] = {}
        self.rows: dict[str, list[tuple]] = {}
        self.changed, self.flush = False, DURABILITY[store.durability]

    # staging

    def _add(self, name: str, op: str, key: bytes | None, value: bytes | None) -> None:
        t = self.check(name)
        if key is not None:
            self._fits(key, value)
        if t["dup"] and op == "put":
            op = "put_dup"
        rows = self.rows.setdefault(name, [])
        rows.append((len(rows), op, None if key is None else bytearray(key), None if value is None else bytearray(value)))

    def _fits(self, key: bytes, value: bytes | None) -> None:
        if not key:
            raise InvalidOperation("empty key")
        if len(key) > self.store.max_key:
            raise BadValueSize("Key size exceeds maximum allowed size")
        if value is not None and len(value) > self.store.max_value:
            raise BadValueSize("Value size exceeds maximum allowed size")

    def _conditional(self, op: str, key: bytes, value: bytes | None, name: str, tell: bool, wanted: bool) -> bool | None:
        """Stage an operation that depends on whether its key is there; with ``tell``, look whether it does."""
        there = self.get(key, name) is not None if tell else None
        if self.check(name)["dup"] and op in ("put_no_overwrite", "update"):
            raise InvalidOperation(f"{name} holds sets of values")
        if there is None or there == wanted:
            self._add(name, op, key, value)
        return there

    def put(self, key: bytes, value: bytes, name: str = MAIN) -> None:
        self._add(name, "put", key, value)

    def put_no_overwrite(self, key: bytes, value: bytes, name: str = MAIN, tell: bool = True) -> bool | None:
        """Whether the key was not there. Without ``tell`` nothing is read: the fold decides."""
        there = self._conditional("put_no_overwrite", key, value, name, tell, False)
        return None if there is None else not there

    def update(self, key: bytes, value: bytes, name: str = MAIN, tell: bool = True) -> bool | None:
        """Whether the key was there."""
        return self._conditional("update", key, value, name, tell, True)

    def delete(self, key: bytes, name: str = MAIN, tell: bool = True) -> bool | None:
        """Whether the key was there."""
        return self._conditional("delete", key, None, name, tell, True)

    def put_dup(self, key: bytes, value: bytes, name: str, tell: bool = True) -> bool | None:
        """Whether the key is new."""
        if not self.check(name)["dup"]:
            raise InvalidOperation(f"{name} holds one value a key")
        new = self.get(key, name) is None if tell else None
        self._add(name, "put_dup", key, value)
        return new

    def delete_dup(self, key: bytes, value: bytes, name: str, tell: bool = True) -> bool | None:
        """Whether the pair was there."""
        sets = self.check(name)["dup"]
        there = value in self.get_all(key, name) if tell or not sets else None
        if there is None or there:
            self._add(name, "delete_dup" if sets else "delete", key, value if sets else None)
        return there

    def clear(self, name: str = MAIN) -> None:
        self._add(name, "clear", None, None)

    def apply(self, log: DataFrame, name: str = MAIN) -> None:
        """Stage a log (seq, op, key, value) in bulk, after what is staged already. It is run once, into its folder."""
        t = self.check(name)
        op = F.when(F.col("op") == "put", "put_dup").otherwise(F.col("op")) if t["dup"] else F.col("op")
        self._write_rows(name)
        self._write(name, log.select(F.col("seq").cast("long").alias("seq"), op.alias("op"), F.col("key").cast("binary").alias("key"), F.col("value").cast("binary").alias("value")))

    def append(self, rows: DataFrame, name: str = MAIN) -> None:
        """Stage rows (key, value) that must all lie behind the last key, in the table's order."""
        order, k = self.order(name), F.col("key")
        pick, there = (F.min, F.max) if not order.descending else (F.max, F.min)
        high, low = (d.agg(f(order.rank(k)).alias("r")).first()["r"] for d, f in ((self.table(name), there), (rows, pick)))
        if high is not None and low is not None and (low >= high if order.descending else low <= high):
            raise InvalidOperation("keys to append do not lie behind the last one")
        self.apply(rows.select(F.monotonically_increasing_id().alias("seq"), F.lit("put").alias("op"), "key", "value"), name)

    def _write(self, name: str, log: DataFrame) -> None:
        parts = self.parts.setdefault(name, [])
        path = f"tables/{name}/v{self.number:020d}-{self.owner[:8]}-log{len(parts)}"
        seen = Observation()
        k = F.col("key")
        empty = F.sum(F.when((F.octet_length(k) == 0) | ((F.col("op") != "clear") & k.isNull()), 1).otherwise(0))
        checked = log.observe(seen, F.count("*").alias("n"), F.min("seq").alias("low"), F.max("seq").alias("high"), empty.alias("empty"), F.max(F.octet_length(k)).alias("k"), F.max(F.octet_length("value")).alias("v"), F.count_if(F.col("op").isin(*write.CONDITIONAL)).alias("conditional"), F.count_if(F.col("op") == "clear").alias("clears"))
        # sorted as far as rows lie together: row groups have narrower key ranges, and nothing is shuffled
        checked.sortWithinPartitions("key", "seq").write.options(**self.store.write_options()).parquet(f"{self.store.root}/{path}")
        found = seen.get
        wrong = None
        if found["n"] and found["empty"]:
            wrong = InvalidOperation("empty key")
        elif found["n"] and ((found["k"] or 0) > self.store.max_key or (found["v"] or 0) > self.store.max_value):
            wrong = BadValueSize("Key or value size exceeds maximum allowed size")
        if wrong or not found["n"]:
            self.store.files.delete(path)
        if wrong:
            raise wrong
        if found["n"]:
            parts.append([path, found["low"], found["high"], found["conditional"], found["clears"]])

    def _write_rows(self, name: str) -> None:
        if rows := self.rows.pop(name, None):
            self._write(name, self.store.spark.createDataFrame(rows, LOG_SCHEMA).coalesce(1))

    # catalog

    def create(self, name: str, dup_sort: bool = False, codec: tuple[str, str] = ("bytes", "bytes"), order: str = "lexicographic") -> None:
        if not name or name == MAIN and dup_sort:
            raise InvalidOperation("a name is needed, and main holds one value a key")
        if order not in TABLE_ORDERS or (dup_sort and not TABLE_ORDERS[order].by_key) or not set(codec) <= CODECS.keys():
            raise InvalidOperation(f"{order} and {codec} do not fit")
        tables = self.state["tables"]
        if name not in tables:
            if len(tables) - 1 >= self.store.max_databases:
                raise DatabasesFull(f"{self.store.max_databases} databases")
            tables[name] = new_table(dup_sort, codec, order)
            self.changed = True

    def drop(self, name: str) -> None:
        if not name or name == MAIN:
            raise InvalidOperation("the main database stays")
        self.check(name)
        del self.state["tables"][name]
        self.rows.pop(name, None)
        for path, *_ in self.parts.pop(name, []):
            self.store.files.delete(path)
        self.changed = True

    # reading and ending

    def log_parts(self, name: str) -> list:
        parts = [*super().log_parts(name), *self.parts.get(name, [])]
        if rows := self.rows.get(name):
            parts.append((self.store.spark.createDataFrame(rows, LOG_SCHEMA), 0, len(rows) - 1, sum(r[1] in write.CONDITIONAL for r in rows), sum(r[1] == "clear" for r in rows)))
        return parts

    def commit(self) -> int:
        """Number of the version that holds the changes; the one before if there are none."""
        if not self.open:
            raise BadTransaction("the transaction is closed")
        made: list[str] = []
        published = False
        try:
            for name in list(self.rows):
                self._write_rows(name)
            touched = [n for n in self.state["tables"] if self.parts.get(n)]
            if not touched and not self.changed:
                return self.id
            for name in touched:
                t, files = self.state["tables"][name], self.store.files
                new = self.parts.pop(name)
                made += [p for p, *_ in new]
                t["logs"] = [*t["logs"], *new]
                if self.store.rewrites(t):
                    path = f"tables/{name}/v{self.number:020d}-{self.owner[:8]}"
                    made.append(path)
                    t["rows"] = written(in_key_order(self.table(name), t["dup"], self.order(name)), f"{self.store.root}/{path}", self.store.write_options())
                    t["path"], t["logs"] = path, []
                    for p, *_ in new:  # no version names these
                        files.delete(p)
            self._within_quota()
            self.state["version"] = self.number
            if not self._owns() or not self.store.files.write_once(self.store._manifest(self.number), self.store._text(self.state), self.flush):
                raise Conflict(f"version {self.number} belongs to another writer")
            published = True
        finally:
            for path in made if not published else []:
                self.store.files.delete(path)
            self._end()
        return self.number

    def _owns(self) -> bool:
        """Whether the lock is still there; a lease that ran out may have given it to another process, whose manifest then decides."""
        return self.store.files.exists("writer.lock")

    def _within_quota(self) -> None:
        store = self.store
        quota = self.state.get("quota", store.quota)
        if quota is None:
            return
        used = store.used_bytes(self.state)
        while store.growth and (grown := store.growth.after(used, quota)):
            quota = grown
        if used > quota:
            raise MapFull(f"{used} bytes")
        if quota != store.quota:
            self.state["quota"] = quota

    def abort(self) -> None:
        """Drop all changes."""
        if self.open:
            self._end()

    def downgrade(self) -> ReadTxn:
        """Drop all changes and read on."""
        self.abort()
        return self.store.read_txn()

    def begin_nested(self) -> None:
        raise InvalidOperation("nested transactions are not supported")

    def _end(self) -> None:
        """Close, give the lock back and drop what was staged and not committed."""
        self.open = False
        for parts in self.parts.values():
            for path, *_ in parts:
                self.store.files.delete(path)
        self.parts.clear()
        self.store.files.delete("writer.lock")

    def __exit__(self, kind, *_):
        if self.open:
            self.abort() if kind else self.commit()


def put_all(txn: WriteTxn, items: Iterable[tuple[bytes, bytes]], name: str = MAIN) -> None:
    for key, value in items:
        txn.put(key, value, name)


__all__ = ["KvError", "ReadTxn", "Store", "WriteTxn", "in_key_order", "put_all"]
