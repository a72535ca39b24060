"""Orders: what keys are sorted by, and which keys are the same key."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Order:
    """``sort`` gives sort expressions, the most significant first; ``same`` gives the value that equal keys share."""

    name: str
    sort: Callable[[Column], list[Column]]
    same: Callable[[Column], Column]
    descending: bool = False
    by_key: bool = True  # whether ``same`` is the key itself

    def by(self, key: Column) -> list[Column]:
        """Sort columns, in this order's direction."""
        return [c.desc() if self.descending else c.asc() for c in self.sort(key)]

    def reversed(self) -> Order:
        return Order(f"reverse_{self.name}", self.sort, self.same, not self.descending, self.by_key)

    def rank(self, key: Column) -> Column:
        """One comparable value that sorts as this order does, ascending."""
        return F.struct(*[c.alias(f"o{i}") for i, c in enumerate(self.sort(key))])


#: Unsigned bytes, shorter prefix first; for text, the order of its UTF-8 bytes.
LEXICOGRAPHIC = Order("lexicographic", lambda k: [k], lambda k: k)
#: Small letters; keys that differ in case alone are one key.
CASE_INSENSITIVE = Order("case_insensitive", lambda k: [F.lower(k)], lambda k: F.lower(k), by_key=False)
#: Length first, then bytes: decimal digit strings without leading zeros in number order.
NUMERIC = Order("numeric", lambda k: [F.octet_length(k), k], lambda k: k)
REVERSE = LEXICOGRAPHIC.reversed()
#: Keys of one fixed length; other lengths fall back to bytes, so the order is lexicographic.
FIXED = Order("fixed", lambda k: [k], lambda k: k)
#: Bytes compared from the last to the first.
REVERSED_KEY = Order("reversed_key", lambda k: [F.reverse(F.hex(k))], lambda k: k)

#: ``CASE_INSENSITIVE`` for keys held as bytes; bytes that are no UTF-8 stay as they are.
CASE_INSENSITIVE_BYTES = Order("case_insensitive", lambda k: [_lower_bytes(k)], lambda k: _lower_bytes(k), by_key=False)


def _lower_bytes(k: Column) -> Column:
    return F.coalesce(F.encode(F.lower(F.try_validate_utf8(k.cast("string"))), "UTF-8"), k)


ORDERS = {o.name: o for o in (LEXICOGRAPHIC, CASE_INSENSITIVE, NUMERIC, REVERSE, FIXED)}
#: Orders that a store's table may have, by name; its keys are bytes.
TABLE_ORDERS = {o.name: o for o in (LEXICOGRAPHIC, CASE_INSENSITIVE_BYTES, NUMERIC, REVERSE, FIXED, REVERSED_KEY)}
