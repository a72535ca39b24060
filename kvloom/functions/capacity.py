"""Capacity arithmetic as Column functions. Truncations happen after each step, as the formulas say."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Sizes in bytes.
PAGE, PAGE_DATA, HALF_PAGE, NODE_EXTRA = 4096, 4056, 2048, 32
GIB = 1 << 30
MAX_VALUE = 0xFFFFFFFF * PAGE_DATA
# Page sizes by average value size, and by access pattern.
PAGE_SIZES = {"small": 4096, "medium": 16384, "large": 65536, "huge": 262144}
VALUE_LIMITS = ((128, "small"), (1024, "medium"), (8192, "large"))
PATTERN_SIZES = {"random": "small", "mixed": "medium", "sequential": "large", "bulk": "huge"}
# Fullest a page may get by its number of keys, and when it splits.
ROOM = ((5, 0.98), (15, 0.96), (30, 0.94))
ROOM_REST, SPLIT_AT = 0.92, 0.85
# How full inserts make a page, and bytes that they keep free.
FILL, LEAST_FREE = 0.9, 64
# Bytes of a page header, a branch header and a key's pointer; bytes a second from which pages may be large.
HEADER, BRANCH_HEADER, POINTER, THROUGHPUT = 40, 8, 2, 10_000_000


def whole(c: Column) -> Column:
    """A non-negative number without its fraction, as a long."""
    return F.floor(c).cast("long")


def div_up(a: Column, b: int) -> Column:
    """Smallest whole number of parts of size b that hold a."""
    return F.ceil(a.cast("long") / F.lit(float(b))).cast("long")


def needs_overflow(key_size: Column, value_size: Column) -> Column:
    return key_size + value_size + NODE_EXTRA > HALF_PAGE


def overflow_pages(size: Column) -> Column:
    return div_up(size, PAGE_DATA)


def plain_pages(size: Column) -> Column:
    return div_up(size, PAGE)


def space_info(total: Column, used: Column, free: Column, map_size: Column) -> list[Column]:
    """Columns of a space report."""
    most = F.floor(map_size / F.lit(float(PAGE))).cast("long")
    share = lambda part, all_: F.when(all_ > 0, part.cast("double") / all_.cast("double") * 100.0).otherwise(0.0)
    return [
        total.cast("long").alias("total_pages"), used.cast("long").alias("used_pages"), free.cast("long").alias("free_pages"),
        (total.cast("long") * PAGE).alias("db_size_bytes"), map_size.cast("long").alias("max_db_size_bytes"),
        share(used, total).alias("percent_used"), share(used, most).alias("percent_of_map_used"),
    ]


def pages_remaining(used: Column, map_size: Column) -> Column:
    return F.greatest(F.floor(map_size / F.lit(float(PAGE))).cast("long") - used, F.lit(0).cast("long"))


def entries_remaining(used: Column, map_size: Column, entry_size: Column) -> Column:
    return F.floor(pages_remaining(used, map_size) / div_up(entry_size, PAGE)).cast("long")


def near_capacity(used: Column, map_size: Column, percent: float) -> Column:
    most = F.floor(map_size / F.lit(float(PAGE)))
    return F.when(most > 0, used.cast("double") / most * 100.0).otherwise(0.0) >= percent


def map_size(entries: Column, key_size: Column, value_size: Column, overhead: float = 1.5, metadata: int = 1000, margin: float = 1.2) -> Column:
    """Recommended map size in bytes, whole GiB."""
    entry = (key_size + value_size).cast("double")
    each = F.when(entry <= HALF_PAGE, F.lit(1.0) / (F.lit(float(HALF_PAGE)) / entry)).otherwise(F.ceil(entry / F.lit(float(PAGE))).cast("double"))
    pages = whole(entries.cast("double") * each)
    pages = whole(pages.cast("double") * overhead) + metadata
    pages = whole(pages.cast("double") * margin)
    return div_up(pages * PAGE, GIB) * GIB


def bulk_insert_pages(entries: Column, key_size: Column, value_size: Column) -> Column:
    entry = key_size + value_size
    each = F.when(entry <= HALF_PAGE, F.lit(0.5)).otherwise(div_up(entry, PAGE).cast("double"))
    return whole(whole(entries.cast("double") * each * 1.3).cast("double") * 1.2)


def large_value_pages(value_size: Column) -> Column:
    return div_up(value_size, PAGE) + 10


def transaction_pages(inserts: Column, updates: Column, entry_size: Column) -> Column:
    inserted = inserts.cast("long") * F.greatest(div_up(entry_size, PAGE), F.lit(1).cast("long"))
    pages = inserted + whole(updates.cast("double") * 0.5)
    pages = pages + whole(pages.cast("double") * 0.3)
    return whole(pages.cast("double") * 1.2)


def preflight(required: Column, available: Column, warn_percent: int | None) -> list[Column]:
    """available_pages, estimated_pages, can_proceed and status (ok, warning or insufficient)."""
    enough = required <= available
    status = F.when(~enough, "insufficient")
    if warn_percent is not None:
        status = status.when(required > F.floor(available * warn_percent / F.lit(100.0)), "warning")
    return [available.alias("available_pages"), required.alias("estimated_pages"), enough.alias("can_proceed"), status.otherwise("ok").alias("status")]


@dataclass(frozen=True)
class Growth:
    """When and by how much a map grows; without a limit (None) it grows on."""

    factor: float
    least: int
    most: int
    threshold: float
    limit: int | None
    enabled: bool = True

    def needed(self, used: Column, total: Column) -> Column:
        return F.lit(self.enabled) & (used.cast("double") / total.cast("double") * 100.0 >= self.threshold)

    def next_size(self, size: Column) -> Column:
        """Next map size in bytes; null where the limit is reached already."""
        more = F.least(F.greatest(whole(size.cast("double") * self.factor - size.cast("double")), F.lit(self.least)), F.lit(self.most))
        grown = size.cast("long") + more
        if self.limit is None:
            return div_up(grown, PAGE) * PAGE
        return F.when((grown > self.limit) & (size >= self.limit), F.lit(None)).when(grown > self.limit, F.lit(self.limit)).otherwise(div_up(grown, PAGE) * PAGE)

    def after(self, used: int, size: int) -> int | None:
        """The size that a full map grows to, once; None where it need not or cannot grow."""
        if not self.enabled or size <= 0 or used / size * 100.0 < self.threshold or self.limit is not None and size >= self.limit:
            return None
        grown = size + min(max(int(size * self.factor - size), self.least), self.most)
        return self.limit if self.limit is not None and grown > self.limit else -(-grown // PAGE) * PAGE


MIB = 1 << 20
# Growth presets.
GROWTH = {
    "default": Growth(1.5, 100 * MIB, 10 * GIB, 90.0, 1024 * GIB, enabled=False),
    "conservative": Growth(1.2, 50 * MIB, GIB, 95.0, 100 * GIB),
    "moderate": Growth(1.5, 100 * MIB, 5 * GIB, 90.0, 500 * GIB),
    "aggressive": Growth(2.0, 500 * MIB, 20 * GIB, 80.0, 1024 * GIB),
}


def page_size_of_values(mean: Column) -> Column:
    """Name of the page size for an average value size."""
    out = F.lit("huge")
    for limit, name in reversed(VALUE_LIMITS):
        out = F.when(mean <= limit, name).otherwise(out)
    return out


def page_size_of_pattern(pattern: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, size in PATTERN_SIZES.items():
        out = F.when(pattern == name, size).otherwise(out)
    return out


def migrated(page: Column, old: str, new: str) -> tuple[Column, Column]:
    """(new page, place in it) of an old page when page sizes change."""
    n = PAGE_SIZES[new] // PAGE_SIZES[old]
    return F.floor(page / F.lit(float(n))).cast("long"), F.pmod(page, F.lit(n)).cast("long")


def fixed_capacity(key_size: Column, value_size: Column) -> Column:
    """Entries of fixed sizes that a page's data area holds."""
    return F.floor(PAGE_DATA / (key_size + value_size).cast("double")).cast("long")


def utilization(used: Column) -> Column:
    return used / F.lit(float(PAGE_DATA))


def room_for(used: Column, keys: Column, needed: Column) -> Column:
    """Whether a page with that many keys and used bytes takes ``needed`` more."""
    fullest = F.lit(ROOM_REST)
    for most, share in reversed(ROOM):
        fullest = F.when(keys <= most, share).otherwise(fullest)
    return (used + needed <= PAGE_DATA) & (utilization(used + needed) < fullest)


def should_split(used: Column) -> Column:
    return utilization(used) >= SPLIT_AT


def has_space(used: Column, entry: Column, fill: float = FILL, least_free: int = LEAST_FREE) -> Column:
    """Whether a page under a fill factor, with so many bytes kept free, takes an entry."""
    free = F.lit(PAGE_DATA) - used
    usable = F.lit(int(PAGE_DATA * fill))
    return (used + entry <= usable) & (free >= entry + least_free) & (free >= entry + POINTER)


def overflow_ref(page: Column, count: Column) -> Column:
    """Twelve little-endian bytes: first page, number of pages."""
    turned = lambda c, n: F.reverse(F.regexp_extract_all(F.lpad(F.hex(c.cast("long")), 2 * n, "0"), F.lit("(..)")))
    return F.unhex(F.array_join(F.concat(turned(page, 8), turned(count, 4)), ""))


def from_overflow_ref(ref: Column) -> tuple[Column, Column]:
    """(first page, number of pages) of a reference; null for fewer than twelve bytes."""
    pairs = F.regexp_extract_all(F.hex(ref), F.lit("(..)"))
    number = lambda a, n: F.conv(F.array_join(F.reverse(F.slice(pairs, a, n)), ""), 16, 10).cast("long")
    return tuple(F.when(F.octet_length(ref) >= 12, number(a, n)) for a, n in ((1, 8), (9, 4)))


def check_header(kind: Column, lower: Column, upper: Column, keys: Column, overflow: Column) -> Column:
    """What is wrong with a page header first, or null. ``kind`` is the page's type, or null for none or several."""
    room = F.greatest(lower - HEADER, F.lit(0))
    needed = F.when(kind == "branch", keys * POINTER + BRANCH_HEADER).otherwise(keys * POINTER)
    return (
        F.when(kind.isNull(), "page type").when(lower < HEADER, "lower below header").when(upper > PAGE, "upper beyond page").when(lower > upper, "lower beyond upper")
        .when(kind.isin("branch", "leaf") & (needed > room), "too many keys").when((kind == "overflow") & (overflow == 0), "no overflow pages")
    )


def adapted(pattern: Column, mean: Column, throughput: Column) -> Column:
    """Name of the page size for a workload: small below ``THROUGHPUT`` bytes a second; else by values, and by pattern too where access is in order."""
    by_value, by_pattern = page_size_of_values(mean), page_size_of_pattern(pattern)
    size = lambda name: F.coalesce(*[F.when(name == n, F.lit(b)) for n, b in PAGE_SIZES.items()])
    larger = F.when(size(by_pattern) > size(by_value), by_pattern).otherwise(by_value)
    return F.when(throughput < THROUGHPUT, "small").when(pattern.isin("sequential", "bulk"), larger).otherwise(by_value)


def split_point(entries: Column, append: bool, adaptive: bool, fill: float) -> Column:
    """Entries that stay on the left page."""
    if append and adaptive:
        return F.floor(entries * 3 / F.lit(4.0)).cast("long")
    if not adaptive:
        return F.floor(entries / F.lit(2.0)).cast("long")
    return whole(entries * (0.5 + (1.0 - fill) * 0.5))
