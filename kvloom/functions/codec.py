"""Key and value codecs as Column functions: values of a type to bytes and back.

``be_raw`` is plain two's complement, whose byte order puts negative numbers last; ``be_ordered``
flips the sign bit, so that byte order is number order. Bytes of the wrong length decode to null
with ``strict=False`` and raise otherwise.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

BITS = {"byte": 8, "short": 16, "int": 32, "long": 64}


def utf8_encode(c: Column) -> Column:
    return F.encode(c, "UTF-8")


def utf8_decode(c: Column, strict: bool = True) -> Column:
    """Text of UTF-8 bytes; other bytes raise, or give null if not strict."""
    text = c.cast("string")
    return F.validate_utf8(text) if strict else F.try_validate_utf8(text)


def be_raw(c: Column, kind: str = "long") -> Column:
    """Big-endian bytes of an integer column."""
    digits = BITS[kind] // 4
    return F.unhex(F.lpad(F.right(F.hex(c.cast("long")), F.lit(digits)), digits, "0"))


def _sign(kind: str) -> Column:
    return F.lit(str(-(1 << (BITS[kind] - 1)))).cast("long")


def be_ordered(c: Column, kind: str = "long") -> Column:
    """Big-endian bytes whose byte order is the order of the numbers."""
    return be_raw(c.cast("long").bitwiseXOR(_sign(kind)), kind)


def from_be_raw(c: Column, kind: str = "long", strict: bool = True) -> Column:
    bits = BITS[kind]
    unsigned = F.conv(F.hex(c), 16, 10).cast("decimal(20,0)")
    number = lambda n: F.lit(str(n)).cast("decimal(20,0)")
    signed = F.when(unsigned >= number(1 << (bits - 1)), unsigned - number(1 << bits)).otherwise(unsigned)
    right = F.octet_length(c) == bits // 8
    wrong = F.raise_error(F.concat(F.lit("expected bytes: "), F.lit(str(bits // 8)))).cast(kind) if strict else F.lit(None).cast(kind)
    return F.when(c.isNull(), F.lit(None)).when(right, signed.cast(kind)).otherwise(wrong)


def from_be_ordered(c: Column, kind: str = "long", strict: bool = True) -> Column:
    return from_be_raw(c, kind, strict).cast("long").bitwiseXOR(_sign(kind)).cast(kind)


def unsigned_be(c: Column) -> Column:
    """Eight big-endian bytes of an unsigned 64-bit number held as decimal(20,0)."""
    return F.unhex(F.lpad(F.conv(c.cast("string"), 10, 16), 16, "0"))


def from_unsigned_be(c: Column) -> Column:
    return F.when(F.octet_length(c) == 8, F.conv(F.hex(c), 16, 10).cast("decimal(20,0)"))


def compare_bytes(a: Column, b: Column) -> Column:
    """-1, 0 or 1 by unsigned bytes, a prefix before what it begins."""
    return F.when(a < b, -1).when(a > b, 1).when(a == b, 0)


@dataclass(frozen=True)
class Codec:
    """A named pair of Column functions; names are kept in the catalog."""

    name: str
    encode: object
    decode: object


CODECS = {
    "bytes": Codec("bytes", lambda c: c, lambda c: c),
    "utf8": Codec("utf8", utf8_encode, utf8_decode),
    "long": Codec("long", be_ordered, from_be_ordered),
    "long_raw": Codec("long_raw", be_raw, from_be_raw),
    "int": Codec("int", lambda c: be_ordered(c, "int"), lambda c: from_be_ordered(c, "int")),
}
