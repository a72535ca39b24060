"""Comparison of results whatever their order."""

import math


def plain(v):
    if isinstance(v, float):
        return "~" if math.isnan(v) else repr(v + 0.0)
    if v is None:
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, int):
        return repr(float(v))
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    if hasattr(v, "tolist"):
        return plain(v.tolist())
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return str(v)


def of_spark(df):
    names = sorted(df.columns)
    return names, sorted(tuple(plain(r[n]) for n in names) for r in df.collect())


def of_duck(relation):
    names = sorted(relation.columns)
    at = [relation.columns.index(n) for n in names]
    return names, sorted(tuple(plain(r[i]) for i in at) for r in relation.fetchall())
