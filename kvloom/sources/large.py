"""Large values in a table of chunks, so that no row holds a whole one.

A value's chunk has the value's key, then its number in eight big-endian bytes, as its key: chunks of a
value lie together and in order. ``chunked`` and ``whole`` go over many values inside Spark; ``Reader``
and ``write_stream`` go over one on the driver, a chunk at a time.
"""

from __future__ import annotations

import io
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kvloom.functions.capacity import PAGE_DATA
from kvloom.sources.store import MAIN, Txn, WriteTxn

NUMBER = 8


def place(number: Column) -> Column:
    return F.unhex(F.lpad(F.hex(number.cast("long")), 2 * NUMBER, "0"))


def chunked(values: DataFrame, size: int = PAGE_DATA) -> DataFrame:
    """(key, value) rows of chunks of rows (key, value); an empty value has one empty chunk."""
    n = F.greatest(F.ceil(F.octet_length("value") / F.lit(float(size))), F.lit(1)).cast("long")
    each = values.where("value IS NOT NULL").select("key", "value", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("i"))
    return each.select(F.concat("key", place(F.col("i"))).alias("key"), F.substring("value", (F.col("i") * size + 1).cast("int"), F.lit(size)).alias("value"))


def whole(chunks: DataFrame) -> DataFrame:
    """(key, value, chunks) of the values put together again."""
    k = F.col("key")
    n = F.octet_length(k) - NUMBER
    parts = chunks.select(F.substring(k, F.lit(1), n).alias("key"), F.struct(F.substring(k, n + 1, F.lit(NUMBER)).alias("at"), "value").alias("part"))
    together = parts.groupBy("key").agg(F.sort_array(F.collect_list("part")).alias("parts"))
    return together.select("key", F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["value"])).alias("value"), F.size("parts").cast("long").alias("chunks"))


def write_stream(txn: WriteTxn, key: bytes, parts: Iterable[bytes], name: str = MAIN, size: int = PAGE_DATA) -> int:
    """Stage one value given in parts of any length; its number of bytes."""
    held, number, total = b"", 0, 0
    for part in parts:
        held += part
        total += len(part)
        while len(held) >= size:
            txn.put(key + number.to_bytes(NUMBER, "big"), held[:size], name)
            held, number = held[size:], number + 1
    if held or not number:
        txn.put(key + number.to_bytes(NUMBER, "big"), held, name)
    return total


class Reader(io.RawIOBase):
    """One value as a file; a chunk is looked up when its bytes are asked for."""

    def __init__(self, txn: Txn, key: bytes, name: str = MAIN):
        self.txn, self.key, self.name, self.number, self.held = txn, key, name, 0, b""

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        while not self.held:
            chunk = self.txn.get(self.key + self.number.to_bytes(NUMBER, "big"), self.name)
            if not chunk:
                return 0
            self.held, self.number = chunk, self.number + 1
        n = min(len(buffer), len(self.held))
        buffer[:n], self.held = self.held[:n], self.held[n:]
        return n
