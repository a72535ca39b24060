"""URL filters: path rules, then exact host lists through a Bloom filter cascade.

The cascade's key universe is every host of the corpus and every parent domain of one, so a listed
key covers its subdomains. Level 0 holds the listed keys, level 1 the unlisted keys that level 0
takes for listed, level 2 the listed keys that level 1 takes for unlisted, and so on until a level
makes no mistake; walking the levels then answers exactly for every key of the universe, and pages
are judged without a join.

Level 0 is as exact as the share of listed keys asks for, so a cascade's size follows the listed
keys (some twenty bits each) and hardly the universe. Levels are built by the executors (bits are
or-ed before and after the shuffle). Keys are dealt by hash to as many cascades as it takes for none
to be over ``MOST_BYTES``; each is broadcast by itself, and a task holds one at a time.

Defined results: a null url or one without ``://`` has an empty host and path, fits no rule and is
allowed; repeated rows are judged alike; an empty list allows every page that no rule blocks.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from kvloom.llm.common import append, cut, drop_path

#: Share of wrong answers aimed at by each level (level 0 may aim at less), and most hashes of a key.
WRONG, HASHES = 0.3, 24
#: Bytes of a cascade at most, by the estimate of ``cascades``.
MOST_BYTES = 64 << 20
#: Answers kept by a task.
HOSTS_KEPT = 200_000
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def with_parts(pages: DataFrame, url: str = "url") -> DataFrame:
    """``pages`` with the host and path of each url."""
    at = F.instr(F.col(url), "://")
    rest = F.when(at > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    raw = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return pages.withColumns({"host": F.translate(raw, CAPITALS, SMALL), "path": path})


def rule_of(rules: list[Rule]) -> tuple[Column, Column]:
    """(text, verdict) of the longest rule that fits columns host and path; nulls if none does."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.text)):
        fits = ((F.col("host") == r.host) | F.endswith(F.col("host"), F.lit("." + r.host))) & F.startswith(F.col("path"), F.lit(r.path))
        text, verdict = F.when(fits, r.text).otherwise(text), F.when(fits, r.verdict).otherwise(verdict)
    return text, verdict


def suffixes(host: str) -> list[str]:
    """A host and its parent domains."""
    parts = host.split(".")
    return [".".join(parts[i:]) for i in range(len(parts))] if host else []


def keys_of(host: Column) -> Column:
    """``suffixes`` as a column of arrays."""
    parts = F.split(host, "\\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts) - i + 1), "."))


class Level:
    """One Bloom filter; its number salts the hashes, so levels fail independently."""

    def __init__(self, number: int, keys: int, wrong: float = WRONG):
        self.number = number
        self.size = max(64, math.ceil(keys * -math.log(wrong) / math.log(2) ** 2 / 64) * 64)
        self.hashes = min(HASHES, max(1, round(self.size / max(keys, 1) * math.log(2))))
        self.bits: np.ndarray | None = None

    def places(self, keys: list[str]) -> np.ndarray:
        """Bit positions, a row a key."""
        import xxhash

        raw = [k.encode() for k in keys]
        a = np.array([xxhash.xxh64_intdigest(k, 2 * self.number) for k in raw], np.uint64)
        b = np.array([xxhash.xxh64_intdigest(k, 2 * self.number + 1) | 1 for k in raw], np.uint64)
        with np.errstate(over="ignore"):
            return ((a[:, None] + np.arange(self.hashes, dtype=np.uint64) * b[:, None]) % np.uint64(self.size)).astype(np.int64)

    def has(self, keys: list[str]) -> np.ndarray:
        at = self.places(keys)
        return ((self.bits[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).astype(bool).all(1)

    def fill(self, keys: DataFrame) -> None:
        """Set the bits of a column of keys."""
        places = self.places

        def words(batches):
            for batch in batches:
                at = places(batch.column(0).to_pylist())
                values, inverse = np.unique(at >> 6, return_inverse=True)
                word = np.zeros(len(values), np.uint64)
                np.bitwise_or.at(word, inverse.ravel(), np.uint64(1) << (at & 63).ravel().astype(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(word.view(np.int64))], names=["word", "bits"])

        schema = StructType([StructField("word", LongType()), StructField("bits", LongType())])
        rows = keys.mapInArrow(words, schema).groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
        self.bits = np.zeros(self.size // 64, np.uint64)
        self.bits[rows["word"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)


class Cascade:
    """Exact membership over a key universe."""

    def __init__(self, levels: list[Level]):
        self.levels = levels

    @property
    def bytes(self) -> int:
        return sum(level.size // 8 for level in self.levels)

    def listed(self, keys: list[str]) -> np.ndarray:
        """Whether each key, of the universe, is listed."""
        out, open_ = np.zeros(len(keys), bool), np.arange(len(keys))
        for i, level in enumerate(self.levels):
            if not len(open_):
                break
            has = level.has([keys[k] for k in open_])
            out[open_[~has]] = i % 2 == 1
            open_ = open_[has]
        out[open_] = len(self.levels) % 2 == 1
        return out


def marked_keys(hosts: DataFrame, listed: DataFrame) -> DataFrame:
    """(key, listed) of the universe: every host of column ``host`` and its parents."""
    seen = hosts.where(F.col("host") != "").groupBy("host").agg(F.lit(1).alias("one"))
    universe = seen.select(F.explode(keys_of(F.col("host"))).alias("key"), F.lit(True).alias("seen"), F.lit(False).alias("listed"))
    wanted = listed.where(F.col("key").isNotNull()).select(F.translate("key", CAPITALS, SMALL).alias("key"), F.lit(False).alias("seen"), F.lit(True).alias("listed"))
    both = universe.unionByName(wanted).groupBy("key").agg(F.max("seen").alias("seen"), F.max("listed").alias("listed"))
    return both.where("seen").select("key", "listed")


def first_wrong(listed: int, universe: int) -> float:
    """Share of wrong answers for level 0: as many unlisted keys pass as there are listed ones, about."""
    return min(WRONG, max(0.7 * listed / max(universe, 1), 2.0**-HASHES))


def build(keys: DataFrame, listed: int, universe: int) -> Cascade:
    """Cascade over marked keys, of which ``listed`` are listed."""
    levels: list[Level] = []
    pools = {True: keys.where("listed").select("key"), False: keys.where(~F.col("listed")).select("key")}
    inside, size = True, listed
    own: list[DataFrame] = []
    while size:
        level = Level(len(levels), size, WRONG if levels else first_wrong(listed, universe))
        level.fill(pools[inside])
        levels.append(level)
        has = level.has

        def taken(batches, has=has):
            for batch in batches:
                yield batch.filter(pa.array(has(batch.column(0).to_pylist())))

        pools[not inside] = cut(pools[not inside].mapInArrow(taken, pools[not inside].schema), "cascade")
        own.append(pools[not inside])
        inside = not inside
        size = pools[inside].count()
    for pool in own:
        drop_path(keys.sparkSession, pool)
    return Cascade(levels)


def part_of(key: str, parts: int) -> int:
    """The cascade of a key: the remainder of Spark's hash of it."""
    import xxhash

    h = xxhash.xxh64_intdigest(key.encode(), 42)
    return (h - (1 << 64) if h >> 63 else h) % parts


def cascades(keys: DataFrame) -> list[Cascade]:
    """As many cascades over marked keys as hold them in ``MOST_BYTES`` each, made one after the other."""
    counted = keys.agg(F.count("*").alias("n"), F.count_if("listed").alias("listed")).first()
    bits = counted["listed"] * (1.44 * -math.log2(first_wrong(counted["listed"], counted["n"])) + 6)
    parts = max(1, math.ceil(bits / 8 / MOST_BYTES))
    out = []
    for part in range(parts):
        own = keys if parts == 1 else keys.where(F.pmod(F.xxhash64("key"), F.lit(parts)) == part)
        n = counted if parts == 1 else own.agg(F.count("*").alias("n"), F.count_if("listed").alias("listed")).first()
        out.append(build(own, n["listed"], n["n"]))
    return out


def filter_urls(pages: DataFrame, rules: list[Rule], listed: DataFrame, url: str = "url") -> DataFrame:
    """``pages`` with host, path, rule and verdict; ``listed`` has a column ``key`` of blocked hosts."""
    made = {"host", "path", "rule", "verdict"}
    d = with_parts(pages.drop(*[c for c in pages.columns if c.lower() in made and c != url]), url)
    text, verdict = rule_of(rules)
    keys = cut(marked_keys(d.select("host"), listed), "url-keys")
    shared = [pages.sparkSession.sparkContext.broadcast(c) for c in cascades(keys)]
    drop_path(pages.sparkSession, keys)
    d = d.withColumns({"rule": text, "_verdict": verdict})

    def make():
        known: dict[str, bool] = {}

        def step(batch: pa.RecordBatch) -> dict[str, pa.Array]:
            hosts = batch.column("host").to_pylist()
            if len(known) > HOSTS_KEPT:
                known.clear()
            new = sorted({h for h in hosts if h not in known})
            known.update(dict.fromkeys(new, False))
            asked: dict[int, list[tuple[str, str]]] = {}
            for h in new:
                for k in suffixes(h):
                    asked.setdefault(part_of(k, len(shared)), []).append((k, h))
            for part, pairs in sorted(asked.items()):
                answers = shared[part].value.listed([k for k, _ in pairs])
                if len(shared) > 1:
                    shared[part].__dict__.pop("_value", None)  # one cascade at a time
                known.update((h, True) for (_, h), yes in zip(pairs, answers.tolist(), strict=True) if yes)
            return {"_listed": pa.array([known[h] for h in hosts], pa.bool_())}

        return step

    d = append(d, [StructField("_listed", BooleanType())], make)
    return d.withColumn("verdict", F.coalesce("_verdict", F.when(F.col("_listed"), "block").otherwise("allow"))).drop("_verdict", "_listed")


# The query's rules, and what its list is made of.
RULES = [Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"), Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/")]
SYLLABLES = "th ha on er he an re in nd ed or wh ing tion ble sh".split()
LISTED_DOMAINS = ("example.com", "example.net", "example.org")
#: Of the names of two syllables, each so manieth is listed.
LISTED_STEP = 5


def listed_keys() -> list[str]:
    """The query's list: every ``LISTED_STEP``-th name of two syllables, below every domain."""
    n = len(SYLLABLES)
    names = [a + b for i, a in enumerate(SYLLABLES) for j, b in enumerate(SYLLABLES) if (i * n + j) % LISTED_STEP == 0]
    return [f"{name}.{d}" for name in names for d in LISTED_DOMAINS]


def digest(pages: DataFrame) -> DataFrame:
    """One row a page: host, path, rule and verdict."""
    listed = pages.sparkSession.createDataFrame(pd.DataFrame({"key": listed_keys()}))
    return filter_urls(pages.select("page_id", "url"), RULES, listed).select("page_id", "host", "path", "rule", "verdict")


def oracle() -> str:
    """The same rows by SQL."""
    fits = lambda r: f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')"
    by_length = sorted(RULES, key=lambda r: -len(r.text))
    rule = " ".join(f"WHEN {fits(r)} THEN '{r.text}'" for r in by_length)
    verdict = " ".join(f"WHEN {fits(r)} THEN '{r.verdict}'" for r in by_length)
    n, quoted = len(SYLLABLES), lambda x: ", ".join(f"'{v}'" for v in x)
    return f"""
WITH cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{CAPITALS}', '{SMALL}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
syllables AS (SELECT unnest([{quoted(SYLLABLES)}]) AS s, unnest(range({n})) AS i),
listed AS (SELECT a.s || b.s || '.' || d.name AS key FROM syllables a, syllables b, (SELECT unnest([{quoted(LISTED_DOMAINS)}]) AS name) d WHERE (a.i * {n} + b.i) % {LISTED_STEP} = 0),
blocked AS (SELECT DISTINCT host FROM (SELECT DISTINCT host FROM parts) h, listed WHERE host = key OR ends_with(host, '.' || key))
SELECT page_id, host, path, CASE {rule} ELSE NULL END AS rule, CASE {verdict} ELSE CASE WHEN host IN (SELECT host FROM blocked) THEN 'block' ELSE 'allow' END END AS verdict FROM parts"""
