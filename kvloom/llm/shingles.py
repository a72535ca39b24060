"""N-gram Jaccard join by prefix trees.

Documents are sets of distinct five-word shingles (64-bit hashes; a shorter text is one shingle); two
link when their Jaccard similarity reaches ``PERCENT`` percent. What comes back is each document's
component.

1. Shingles are counted over all documents. Each task cuts its documents into batches, sorts a
   batch's shingles and sends them, packed, to the shingles' hash ranges; a range sends each batch the
   shingles that some other document holds too. A shingle that many documents of a batch hold goes
   as one counted entry, and its documents stay with the batch, so no shingle's documents meet.
2. Shingles that one document alone holds can be in no overlap. A document whose shared shingles
   are fewer than the overlap that any link of its size needs links with nothing and leaves; that is
   exact, and most documents leave.
3. Equal sets become one. Shared shingles are counted again among what is left, and documents leave
   again. The remaining sets are put in one global order, rare shingles first.
4. Linked sets share a shingle in their prefixes (size - least overlap + 1 shingles). Sets are put
   into families by common prefix shingles: stars around the least document of each shingle, and
   their connected components.
5. Families are joined by tries (see ``trie``), small ones many to a task. A large family is cut into
   blocks by size and hash: first each block alone; then every block against some sets of the
   largest group so far; then every block against the sets outside that group, as far as sizes
   allow. Sets inside one group need no comparing, so a large group of copies costs no more than
   its size. Tasks hold at most two blocks.

Hash ranges follow a count of the input, so what a range or a task holds does not grow with it.
Tables between steps lie in the shared folder and go once they are read. Only groups (document,
component) are kept, never pairs.

Defined results: null and empty texts have no shingles and link with nothing; equal texts link; rows
that repeat a doc_id give a row each, all with the component of the id, which the links of any of its
texts make; columns but the key and the text are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from kvloom.llm.common import bounded, cut, drop_path, tidy, words
from kvloom.llm.graph import Sets, components
from kvloom.llm.trie import similar

WORDS, PERCENT = 5, 75
#: Shingles and documents of a batch at most (a longer text is a batch of its own); with many ranges, shingles of a batch to a range.
BATCH_SHINGLES, BATCH_DOCS, BATCH_MOST, TO_RANGE = 1 << 19, 60_000, 1 << 21, 16
#: Shingles of a hash range aimed at, and the bytes of text that a shingle takes at least on the mean.
RANGE_SHINGLES, TEXT_BYTES = 1 << 22, 5
#: Documents of a batch with one shingle from which the shingle goes as a counted entry.
HOT = 64
#: Sets of a block of a large family, sets that stand for its largest group, and sets of small families to a task.
BLOCK, PIVOTS, TASK_SETS = 250, 60, 2000
#: Word hashes kept by a task, and rows turned to Python objects at once.
KEPT_WORDS, ROWS = 200_000, 500
#: Document number of a counted entry.
COUNTED = 0xFFFF


class Shingler:
    """Distinct shingles of texts as sorted 64-bit hashes; keeps the hashes of words seen."""

    def __init__(self, n: int = WORDS):
        import xxhash

        self.hash, self.many = xxhash.xxh3_64_intdigest, n
        self.known: dict[bytes, int] = {}
        rng = np.random.RandomState(5)
        self.factors = rng.randint(1, 1 << 62, n).astype(np.uint64) * np.uint64(2) + np.uint64(1)

    def of(self, text: str | None) -> np.ndarray:
        found = words(text)
        if not found:
            return np.zeros(0, np.uint64)
        if len(self.known) > KEPT_WORDS:
            self.known.clear()
        known, hash_ = self.known, self.hash
        h = np.array([known[w] if w in known else known.setdefault(w, hash_(w)) for w in found], np.uint64)
        n = min(self.many, len(h))
        with np.errstate(over="ignore"):
            out = np.full(len(h) - n + 1, n, np.uint64)
            for k in range(n):
                part = h[k : len(h) - n + 1 + k] * self.factors[k]
                out = (out ^ part ^ (part >> np.uint64(32))) * np.uint64(0x9FB21C651E98DF25)
                out ^= out >> np.uint64(35)
        return np.unique(out)


SETS = StructType([StructField("doc_id", LongType()), StructField("n", LongType()), StructField("digest", BinaryType()), StructField("tokens", BinaryType())])


def batch_of(rows: pa.RecordBatch):
    for r in rows.to_pylist():
        yield r["doc_id"], r["n"], r["digest"], np.frombuffer(r["tokens"], "<u8")


def spread(sets_of, ranges: int):
    """Rows (range, batch, kind, data): kind 0 a batch's documents, 1 its shingles of a range, 2 documents of counted shingles."""
    import pickle

    import xxhash

    step = (1 << 48) // ranges + 1
    most = min(BATCH_MOST, max(BATCH_SHINGLES, TO_RANGE * ranges)) if BATCH_SHINGLES < BATCH_MOST else BATCH_SHINGLES

    def run(batches):
        number = TaskContext.get().partitionId() << 32
        docs: list[tuple] = []
        held: list[np.ndarray] = []
        size = 0

        def emit():
            nonlocal number, size
            home = xxhash.xxh3_64_intdigest(number.to_bytes(8, "little")) % ranges
            rows = [(home, number, 0, pickle.dumps(docs))]
            h = np.concatenate(held) >> np.uint64(16)
            o = np.repeat(np.arange(len(held), dtype=np.uint16), [len(x) for x in held])
            order = np.argsort(h, kind="stable")
            h, o = h[order], o[order]
            first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, int)
            count = np.diff(np.append(first, len(h)))
            hot = count >= HOT
            if hot.any():
                lists = [(int(h[a]), o[a : a + c]) for a, c in zip(first[hot].tolist(), count[hot].tolist(), strict=True)]
                rows.append((home, number, 2, pickle.dumps(lists)))
                keep = np.repeat(~hot, count)
                single = np.repeat(hot, count) & np.isin(np.arange(len(h)), first)
                o = np.where(single, np.uint16(COUNTED), o)
                keep |= single
                h, o = h[keep], o[keep]
            if len(h):
                part = (h // np.uint64(step)).astype(np.int64)
                starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
                for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(h)], strict=True):
                    rows.append((int(part[a]), number, 1, pack(h[a:b], o[a:b])))
            number += 1
            docs.clear()
            held.clear()
            size = 0
            c = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c[0], pa.int32()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.int32()), pa.array(c[3], pa.binary())], names=["range", "batch", "kind", "data"])

        for doc, n, digest, tokens in sets_of(batches):
            if docs and (size + len(tokens) > most or len(docs) >= BATCH_DOCS):
                yield emit()
            docs.append((doc, n, digest))
            held.append(tokens)
            size += len(tokens)
        if docs:
            yield emit()
        tidy()

    return run


def pack(h: np.ndarray, o: np.ndarray, *more: np.ndarray) -> bytes:
    """Rising hashes of 48 bits as steps, document numbers of 16 bits, and more numbers of 32 bits, each kind together: the steps' high bytes are zeros that compress away."""
    step = np.diff(h, prepend=np.uint64(0))
    parts = [(step & np.uint64(0xFFFFFFFF)).astype("<u4"), (step >> np.uint64(32)).astype("<u2"), o.astype("<u2"), *[m.astype("<u4") for m in more]]
    return b"".join(p.tobytes() for p in parts)


def unpack(data: bytes, width: int = 8) -> tuple[np.ndarray, ...]:
    """What ``pack`` packed; ``width`` is its bytes an entry."""
    k = len(data) // width
    low, high, o = np.frombuffer(data, "<u4", k), np.frombuffer(data, "<u2", k, 4 * k), np.frombuffer(data, "<u2", k, 6 * k)
    h = np.cumsum(low.astype(np.uint64) + (high.astype(np.uint64) << np.uint64(32)), dtype=np.uint64)
    return (h, o, *[np.frombuffer(data, "<u4", k, at * k) for at in range(8, width, 4)])


def answer(key: tuple, group: pa.Table) -> pa.Table:
    """A range's answers to its batches: the entries whose shingle some other document holds too, then how often it is held."""
    kind = group["kind"].to_numpy()
    passed = group.filter(pa.array(kind != 1)).select(["batch", "kind", "data"])
    asked = group.filter(pa.array(kind == 1))
    if not asked.num_rows:
        return passed
    data = [unpack(d) for d in asked["data"].to_pylist()]
    h, o = (np.concatenate([d[k] for d in data]) for k in (0, 1))
    _, inverse = np.unique(h, return_inverse=True)
    # a counted entry stands for HOT documents or more
    count = np.bincount(inverse, np.where(o == COUNTED, HOT, 1))[inverse].astype("<u4")
    shared, out, at = count > 1, [], 0
    for h, o in data:
        keep, f = shared[at : at + len(h)], count[at : at + len(h)]
        at += len(h)
        out.append(pack(h[keep], o[keep], f[keep]) if keep.any() else b"")
    keep = [i for i, x in enumerate(out) if x]
    made = pa.table({"batch": asked["batch"].combine_chunks().take(pa.array(keep, pa.int64())), "kind": pa.array([1] * len(keep), pa.int32()), "data": pa.array([out[i] for i in keep], pa.binary())})
    return pa.concat_tables([passed.combine_chunks(), made.select(["batch", "kind", "data"])])


def gather(percent: int):
    """A batch's documents with their shared shingles, rare ones first, or null for those that can link with nothing."""
    import pickle

    def run(key: tuple, group: pa.Table) -> pa.Table:
        docs: list[tuple] = []
        lists: dict[int, np.ndarray] = {}
        entries = []
        for kind, data in zip(group["kind"].to_pylist(), group["data"].to_pylist(), strict=True):
            if kind == 0:
                docs = pickle.loads(data)
            elif kind == 2:
                lists |= dict(pickle.loads(data))
            else:
                entries.append(unpack(data, 12))
        none = (np.zeros(0, np.uint64), np.zeros(0, "<u2"), np.zeros(0, "<u4"))
        h, o, f = (np.concatenate([e[k] for e in [none, *entries]]) for k in range(3))
        o = o.astype(np.int64)
        counted = o == COUNTED
        more = [(x, k, lists[x]) for x, k in zip(h[counted].tolist(), f[counted].tolist(), strict=True)]
        h = np.concatenate([h[~counted], *[np.full(len(d), x, np.uint64) for x, _, d in more]])
        f = np.concatenate([f[~counted], *[np.full(len(d), k, "<u4") for _, k, d in more]])
        o = np.concatenate([o[~counted], *[d.astype(np.int64) for *_, d in more]])
        h = h[np.lexsort((h, f, o))] << np.uint64(16)
        size = np.bincount(o, minlength=len(docs))
        tokens, at = [], 0
        for (_, n, _), k in zip(docs, size.tolist(), strict=True):
            tokens.append(h[at : at + k].astype("<u8").tobytes() if n and 100 * k >= percent * n else None)
            at += k
        return pa.table({
            "doc_id": pa.array([d[0] for d in docs], pa.int64()), "n": pa.array([d[1] for d in docs], pa.int64()),
            "digest": pa.array([d[2] for d in docs], pa.binary()), "tokens": pa.array(tokens, pa.binary()),
        })

    return run


def ranges_for(df: DataFrame, shingles) -> int:
    """Hash ranges: some for each shuffle partition, and as many as hold the shingles, of which column ``shingles`` is each row's number or a bound."""
    total = df.agg(F.coalesce(F.sum(shingles), F.lit(0)).cast("long").alias("n")).first()["n"]
    return max(4 * max(16, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), -(-total // RANGE_SHINGLES))


def shared_tokens(df: DataFrame, sets_of, percent: int, name: str, ranges: int) -> DataFrame:
    """``SETS`` rows of all documents; tokens are the shared ones, null where no link is possible."""
    bounded(df.sparkSession)
    asked = df.mapInArrow(spread(sets_of, ranges), StructType([StructField("range", IntegerType()), StructField("batch", LongType()), StructField("kind", IntegerType()), StructField("data", BinaryType())]))
    answered = asked.groupBy("range").applyInArrow(answer, StructType([StructField("batch", LongType()), StructField("kind", IntegerType()), StructField("data", BinaryType())]))
    return cut(answered.groupBy("batch").applyInArrow(gather(percent), SETS), name)


def text_sets(n_words: int):
    def sets_of(batches):
        import xxhash

        shingler = Shingler(n_words)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    s = shingler.of(text)
                    yield doc, len(s), xxhash.xxh3_128_digest(s.tobytes()), s

    return sets_of


def kept_sets(batches):
    for batch in batches:
        yield from batch_of(batch)


FAMILY = StructType([StructField("doc_id", LongType()), StructField("root", LongType())])


def joiner(percent: int):
    """Groups of the sets of one task, tries sharing the frequent shingles: rows carry part (sets of different parts are not compared), label and probe."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        rows = sorted(zip(group["part"].to_pylist(), group["doc_id"].to_pylist(), group["n"].to_pylist(), group["tokens"].to_pylist(), group["label"].to_pylist(), group["probe"].to_pylist(), strict=True), key=lambda r: r[:2])
        docs, roots = [], []
        at = 0
        while at < len(rows):
            end = at
            while end < len(rows) and rows[end][0] == rows[at][0]:
                end += 1
            part = rows[at:end]
            at = end
            sets = Sets(len(part))
            lead: dict[int, int] = {}
            for i, r in enumerate(part):
                if r[4] is not None:
                    sets.union(lead.setdefault(r[4], i), i)
            similar([np.frombuffer(r[3], "<u8")[::-1].tolist() for r in part], [r[2] for r in part], [i for i, r in enumerate(part) if r[5]], percent, sets)
            # groups that are new here, or labels that met
            for i, r in enumerate(part):
                j = sets.find(i)
                if j != i and not (r[4] is not None and r[4] == part[j][4]):
                    docs.append(r[1])
                    roots.append(part[j][1])
        return pa.table({"doc_id": pa.array(docs, pa.int64()), "root": pa.array(roots, pa.int64())})

    return run


def prefixes(percent: int):
    """(token, doc_id) of the shared shingles in the prefix of each set."""

    def run(batches):
        for batch in batches:
            tokens, docs = [], []
            for doc, n, _, t in batch_of(batch):
                part = t[: len(t) - -(-percent * n // 100) + 1]
                tokens.append(part.view(np.int64))
                docs.append(np.full(len(part), doc, np.int64))
            if tokens:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens)), pa.array(np.concatenate(docs))], names=["token", "doc_id"])

    return run


def families(sets: DataFrame, percent: int) -> DataFrame:
    """(node, component): sets that share prefix shingles, directly or through others."""
    held = cut(sets.mapInArrow(prefixes(percent), StructType([StructField("token", LongType()), StructField("doc_id", LongType())])), "prefixes")
    least = cut(held.groupBy("token").agg(F.min("doc_id").alias("first"), F.count("*").alias("k")).where("k > 1").select("token", "first"), "prefix-stars")
    stars = held.join(least, "token").where("doc_id != first").select(F.col("doc_id").alias("a"), F.col("first").alias("b"))
    found = components(stars)
    for used in (held, least):
        drop_path(sets.sparkSession, used)
    return found


JOINED = ("t1", "t2", "t3", "t4")


def joined(rows: DataFrame, percent: int, name: str) -> DataFrame:
    """New groups found by the tasks that columns ``JOINED`` name."""
    found = rows.select(*JOINED, "part", "doc_id", "n", "tokens", "label", "probe").groupBy(*JOINED).applyInArrow(joiner(percent), FAMILY)
    return cut(found.distinct(), name)


def task(t1, t2, t3, t4) -> list:
    return [F.lit(c).alias(n) if isinstance(c, int) else c.cast("long").alias(n) for c, n in zip((t1, t2, t3, t4), JOINED, strict=True)]


def in_families(sets: DataFrame, percent: int) -> DataFrame:
    """(a, b) links that join all similar sets of each family; ``sets`` has family, doc_id, n and tokens."""
    step = math.log(100 / percent)
    sets = sets.withColumn("band", F.floor(F.log("n") / step + 1e-9))
    sizes = sets.groupBy("family", "band").agg(F.count("*").alias("k"))
    totals = sizes.groupBy("family").agg(F.sum("k").alias("total"))
    about = cut(sizes.join(totals, "family").select("family", "band", "total", F.ceil(F.col("k") / BLOCK).alias("blocks")), "family-blocks")
    sets = cut(sets.join(about, ["family", "band"]).withColumn("block", F.pmod(F.xxhash64("doc_id"), "blocks")), "family-sets")
    count = sets.where(F.col("total") <= BLOCK).count()
    # small families many to a task, but to as many tasks as there are shuffle partitions
    tasks = max(int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-count // TASK_SETS))
    small = sets.where(F.col("total") <= BLOCK).select(*task(0, 0, F.pmod(F.xxhash64("family"), F.lit(tasks)), 0), F.col("family").alias("part"), "doc_id", "n", "tokens", F.lit(None).cast("long").alias("label"), F.lit(True).alias("probe"))
    large = sets.where(F.col("total") > BLOCK)
    alone = large.select(*task(1, F.col("family"), F.col("band"), F.col("block")), F.col("family").alias("part"), "doc_id", "n", "tokens", F.lit(None).cast("long").alias("label"), F.lit(True).alias("probe"))
    links = joined(small.unionByName(alone), percent, "links").select(F.col("doc_id").alias("a"), F.col("root").alias("b"))
    made = [about, sets]
    if not large.isEmpty():
        links = across_blocks(large, about, links, percent, made)
    for used in made:
        drop_path(sets.sparkSession, used)
    return links


def across_blocks(large: DataFrame, about: DataFrame, links: DataFrame, percent: int, made: list[DataFrame]) -> DataFrame:
    """``links`` with those between blocks of the large families; tables that nothing needs afterwards are put into ``made``."""
    blocks = about.where(F.col("total") > BLOCK).select("family", F.col("band").alias("to_band"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("to_block"))

    def labelled() -> tuple[DataFrame, DataFrame]:
        """Large families' sets with their group so far, whether it is the family's largest, and counts."""
        groups = components(links)
        marked = large.join(groups, large["doc_id"] == groups["node"], "left").drop("node").withColumn("label", F.coalesce("component", "doc_id")).drop("component")
        marked = cut(marked, "labelled")
        counts = marked.groupBy("family", "label").agg(F.count("*").alias("k"))
        main = counts.groupBy("family").agg(F.max(F.struct("k", F.negative("label").alias("l"))).alias("m"), F.sum("k").alias("all"))
        main = cut(main.select("family", F.negative("m.l").alias("main"), F.col("m.k").alias("main_k"), (F.col("all") - F.col("m.k")).alias("minor_k")), "main-groups")
        made.extend((marked, main))
        return marked.join(main, "family"), main

    near = F.abs(F.col("to_band") - F.col("band")) <= 1
    # every block's other sets against some of the largest group: most groups that belong to it join it here
    marked, _ = labelled()
    pivots = marked.where((F.col("label") == F.col("main")) & (F.pmod(F.xxhash64("doc_id", F.lit(1)), F.col("main_k")) < PIVOTS)).join(blocks, "family").where(near)
    columns = [F.col("family").alias("part"), "doc_id", "n", "tokens", "label"]
    rows = pivots.select(*task(2, F.col("family"), F.col("to_band"), F.col("to_block")), *columns, F.lit(False).alias("probe"))
    rows = rows.unionByName(marked.where("label != main").select(*task(2, F.col("family"), F.col("band"), F.col("block")), *columns, F.lit(True).alias("probe")))
    links = links.unionByName(joined(rows, percent, "links").select(F.col("doc_id").alias("a"), F.col("root").alias("b")))
    # sets outside the largest group against every block that their sizes allow
    marked, main = labelled()
    if main.where("minor_k > 0").isEmpty():
        return links
    chunks = F.ceil(F.col("minor_k") / BLOCK)
    minor = marked.where("label != main").withColumn("chunk", F.pmod(F.xxhash64("doc_id", F.lit(2)), chunks)).join(blocks, "family").where(near)
    bases = marked.where("minor_k > 0").withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), chunks - 1)))
    place = lambda band, block: [F.lit(3).alias("t1"), F.xxhash64("family", band).alias("t2"), F.col(block).cast("long").alias("t3"), F.col("chunk").cast("long").alias("t4")]
    rows = bases.select(*place("band", "block"), *columns, F.lit(False).alias("probe")).unionByName(minor.select(*place("to_band", "to_block"), *columns, F.lit(True).alias("probe")))
    return links.unionByName(joined(rows, percent, "links").select(F.col("doc_id").alias("a"), F.col("root").alias("b")))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", n_words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document."""
    spark = docs.sparkSession
    texts = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    every = shared_tokens(texts, text_sets(n_words), percent, "shingles", ranges_for(texts, F.octet_length("text") / TEXT_BYTES))
    live = every.where("tokens IS NOT NULL AND doc_id IS NOT NULL")
    single = live.groupBy("digest").agg(F.min(F.struct("doc_id", "n", "tokens")).alias("r")).select("r.doc_id", "r.n", "digest", "r.tokens")
    single = cut(single, "single")
    shared = shared_tokens(single, kept_sets, percent, "shared", ranges_for(single, F.octet_length("tokens") / 8))
    sets = shared.where("tokens IS NOT NULL")
    family = families(sets, percent)
    grouped = sets.join(family, sets["doc_id"] == family["node"]).select("doc_id", "n", "tokens", F.col("component").alias("family"))
    links = in_families(grouped, percent)
    # an id that several rows carry is one document: it joins the classes of its texts
    repeated = cut(every.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("k")).where("k > 1").select("doc_id"), "repeated-ids")
    carried = every.where("tokens IS NOT NULL").select("doc_id", "digest").join(repeated, "doc_id").join(single.select("digest", F.col("doc_id").alias("first")), "digest")
    groups = components(links.unionByName(carried.select(F.col("doc_id").alias("a"), F.col("first").alias("b"))))
    about = single.select("digest", "doc_id").join(groups, F.col("doc_id") == F.col("node"), "left").select("digest", F.coalesce("component", "doc_id").alias("component"))
    about = cut(about, "classes")
    # texts of a repeated id that link with nothing have the component of the id all the same
    by_id = cut(repeated.join(groups, F.col("doc_id") == F.col("node")).select("doc_id", F.col("component").alias("of_id")), "repeated-classes")
    for used in (single, shared, family, repeated, groups):
        drop_path(spark, used)
    out = every.select("doc_id", "n", F.when(F.col("tokens").isNotNull(), F.col("digest")).alias("digest")).join(about, "digest", "left").join(by_id, "doc_id", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "of_id", "doc_id").alias("component_id"))
