"""A position in a table, moved by lookups of the neighbouring key in the table's order.

A cursor keeps the key it stands at. Each move is one pushed-down query, so it costs a lookup, not a
scan; bulk reads are ranges and scans. In a write transaction the cursor sees staged changes and can
make them at its position.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kvloom.functions.errors import InvalidOperation
from kvloom.sources.store import MAIN, Txn, WriteTxn

Entry = tuple[bytes, bytes]


class Cursor:
    """Moves return the entry (key, value) arrived at, or None where there is none; a step past an end stays where it was. In a table of sets, moves by key stand at a key's smallest value."""

    def __init__(self, txn: Txn, name: str = MAIN):
        txn.check(name)
        self.txn, self.name, self.order = txn, name, txn.order(name)
        self.key: bytes | None = None
        self.value: bytes | None = None

    def _take(self, where: Column | None, back: bool = False, step: bool = False) -> Entry | None:
        order = self.order.reversed() if back else self.order
        rows = self.txn.table(self.name, where).orderBy(*order.by(F.col("key")), "value").limit(1).collect()
        if rows or not step:
            self.key, self.value = (bytes(rows[0]["key"]), bytes(rows[0]["value"])) if rows else (None, None)
        return (self.key, self.value) if rows else None

    def _side(self, key: bytes, after: bool, equal: bool) -> Column:
        """Rows after (or before) a key, with it or not."""
        k, at = F.col("key"), F.lit(key)
        plain = len(self.order.sort(k)) == 1
        a, b = (self.order.sort(k)[0], self.order.sort(at)[0]) if plain else (self.order.rank(k), self.order.rank(at))
        up = after != self.order.descending
        if equal:
            return a >= b if up else a <= b
        return a > b if up else a < b

    def first(self) -> Entry | None:
        return self._take(None)

    def last(self) -> Entry | None:
        return self._take(None, back=True)

    def seek(self, key: bytes) -> Entry | None:
        """The first entry at or after a key."""
        return self._take(self._side(key, True, True))

    def next(self) -> Entry | None:
        """The entry after the position; the first one if there is no position."""
        return self.first() if self.key is None else self._take(self._side(self.key, True, False), step=True)

    def prev(self) -> Entry | None:
        """The entry before the position; the last one if there is no position."""
        return self.last() if self.key is None else self._take(self._side(self.key, False, False), back=True, step=True)

    def current(self) -> Entry | None:
        """The entry at the position, read again: None if it is gone or there is no position."""
        if self.key is None:
            return None
        rows = self.txn.table(self.name, self.txn.is_key(self.key, self.name)).orderBy("value").limit(1).collect()
        return (bytes(rows[0]["key"]), bytes(rows[0]["value"])) if rows else None

    # sets of values

    def first_dup(self) -> bytes | None:
        """The smallest value of the key at the position."""
        return self._dup(None)

    def next_dup(self) -> bytes | None:
        """The value after the one last shown, of the same key."""
        return None if self.value is None else self._dup(F.col("value") > F.lit(self.value))

    def _dup(self, more: Column | None) -> bytes | None:
        if self.key is None:
            return None
        rows = self.txn.table(self.name, self.txn.is_key(self.key, self.name))
        found = (rows if more is None else rows.where(more)).orderBy("value").limit(1).collect()
        self.value = bytes(found[0]["value"]) if found else None
        return self.value

    # changes at the position

    def _writer(self) -> WriteTxn:
        if not isinstance(self.txn, WriteTxn):
            raise InvalidOperation("a read transaction changes nothing")
        return self.txn

    def put(self, key: bytes, value: bytes) -> None:
        """Upsert, and stand at the key."""
        self._writer().put(key, value, self.name)
        self.key, self.value = key, value

    def put_no_overwrite(self, key: bytes, value: bytes) -> bool:
        """Whether the key was not there; the cursor stands at it in either case."""
        done = self._writer().put_no_overwrite(key, value, self.name)
        self.key, self.value = key, value if done else self.txn.get(key, self.name)
        return done

    def update(self, value: bytes) -> bool:
        """Whether there was an entry at the position to get the value."""
        writer = self._writer()
        if self.key is None or not writer.update(self.key, value, self.name):
            return False
        self.value = value
        return True

    def delete(self) -> bool:
        """Whether there was an entry at the position to go; the next move goes on from where it was."""
        writer = self._writer()
        if self.key is None or not writer.delete(self.key, self.name):
            return False
        self.value = None
        return True
