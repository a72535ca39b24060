"""Exceptions and their numeric codes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


class KvError(Exception):
    """Any error of a store; ``code`` is its number in the store file format's convention."""

    code = -1


class KeyNotFound(KvError):
    code = -30799


class PageNotFound(KvError):
    code = -30798


class Corruption(KvError):
    code = -30797


class VersionMismatch(KvError):
    code = -30795


class InvalidDatabase(KvError):
    code = -30794


class MapFull(KvError):
    code = -30793


class DatabasesFull(MapFull):
    code = -30792


class ReadersFull(KvError):
    code = -30791


class TxnFull(KvError):
    code = -30788


class BadTransaction(KvError):
    code = -30782


class BadValueSize(KvError):
    code = -30781


class Conflict(KvError):
    pass


class InvalidOperation(KvError):
    code = -30784


# Codes and the errors they stand for.
CODES = {
    2: "NotFound", 5: "Io", 12: "Io", 13: "Io", 16: "Io", 22: "InvalidParameter", 28: "MapFull",
    -30799: "KeyNotFound", -30798: "PageNotFound", -30797: "Corruption", -30796: "Custom", -30795: "VersionMismatch", -30794: "InvalidDatabase",
    -30793: "MapFull", -30792: "MapFull", -30791: "ReadersFull", -30788: "TxnFull", -30787: "Custom", -30786: "Custom", -30785: "MapFull",
    -30784: "InvalidOperation", -30783: "BadTransaction", -30782: "BadTransaction", -30781: "InvalidParameter", -30780: "InvalidDatabase",
}


def code_table(spark: SparkSession) -> DataFrame:
    """(code, error) of every known code."""
    return spark.createDataFrame(sorted(CODES.items()), "code int, error string")


def from_code(code: int) -> KvError:
    """The exception of a code."""
    known = {c.code: c for c in KvError.__subclasses__() + [DatabasesFull]}
    return known.get(code, KvError)(CODES.get(code, f"unknown error code: {code}"))
