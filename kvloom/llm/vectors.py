"""Embedding near-dedup by a subspace pigeonhole join.

Unit vectors with a cosine of t or more lie within a squared distance of 2 - 2t. Vectors are rotated
(random signs and a Walsh-Hadamard transform, in arithmetic that gives the same bits everywhere)
and split into ``BLOCKS`` low-dimensional blocks; each block gets the share of the squared distance
that is proportional to its dimensions, and a linked pair must keep to the share in one block at
least. Each block is range-joined:

1. The block's space is cut into cells of about equal counts, one coordinate after the other, each cut
   at the median of a bounded sample. Rows that tie with a cut are dealt to its sides by a hash, so a
   coordinate with few values cuts as well as any. A vector has one home cell, and reaches the cells
   whose distance from it, over all coordinates cut, is within the share.
2. Only the block's part of a vector travels (half precision, with slack for what that loses), packed
   by tile: a pair of cells, one home and the other reached. Inside a tile both sides are cut on by
   a tree over the remaining coordinates, which carries the share that is left. What comes back is the
   vectors that have any candidate in the tile.
3. Whole vectors of those go to the tile once more, where block distances and cosines in double
   precision decide. A linked pair is counted in the first block whose share it keeps to, so the union
   of the blocks' candidates counts each link once.

A tile has two cells at most, and cells have about ``CELL`` components whatever the data: a group of
near copies is cut like the rest. Exact copies are one vector with a weight. Links are counted and
spanning links made inside tiles; pairs never leave them. Vectors of each length are joined among
themselves.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components link with
nothing; vectors of different lengths have no cosine and do not link; repeated rows link with each
other; without rows the result is empty; extra columns are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, FloatType, IntegerType, LongType, StructField, StructType

from kvloom.llm.common import bounded, cut, drop_path, tidy
from kvloom.llm.graph import components

COSINE = 0.95
BLOCKS = 4
#: Components of a cell's vectors (rows times length).
CELL = 1 << 20
#: Most bytes (and rows, and rows a cell) of the sample that cells are cut by, and fewest of its rows at a cut.
SAMPLE_BYTES, SAMPLE_ROWS, SAMPLE_CELL, SAMPLE_LEAST = 32 << 20, 1 << 17, 256, 16
#: Vectors of a leaf of the tree inside a tile, and vectors compared with it at once.
LEAF, VISITORS = 128, 4096
#: Vectors that a task packs at once.
PACKED = 4096
#: What half precision may add to the distance of two parts, whose lengths are 1 at most.
HALF = 0.0012
SIGN_SEED = 20


def rotate(x: np.ndarray) -> np.ndarray:
    """Rows of x scaled to length one, signed, padded to a power of two and transformed."""
    length = np.zeros(len(x))
    for c in x.T:
        length = length + c * c
    unit = x / np.sqrt(length)[:, None]
    width = 1 << max(0, (x.shape[1] - 1).bit_length())
    signs = np.where(np.random.RandomState(SIGN_SEED).randint(0, 2, x.shape[1]) > 0, 1.0, -1.0)
    t = np.zeros((len(x), width))
    t[:, : x.shape[1]] = unit * signs
    step = 1
    while step < width:
        v = t.reshape(len(x), width // (2 * step), 2, step)
        t = np.stack([v[:, :, 0] + v[:, :, 1], v[:, :, 0] - v[:, :, 1]], 2).reshape(len(x), width)
        step *= 2
    return t / np.sqrt(width)


def blocks_of(width: int) -> list[tuple[int, int]]:
    """Column ranges of the blocks."""
    n = min(BLOCKS, width)
    return [(width * i // n, width * (i + 1) // n) for i in range(n)]


def shares(width: int, cosine: float) -> list[float]:
    """Each block's share of the squared distance, a hair more than in proportion."""
    return [(2 - 2 * cosine) * (b - a) / width * (1 + 1e-9) + 1e-12 for a, b in blocks_of(width)]


def block_distance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of row pairs, added up in the order of the columns."""
    out = np.zeros(len(x))
    for p, q in zip(x.T, y.T, strict=True):
        out = out + (p - q) * (p - q)
    return out


def uniform(ids: np.ndarray, level: int) -> np.ndarray:
    """Numbers from 0 up to 1 by id and level."""
    with np.errstate(over="ignore"):
        h = (ids.astype(np.uint64) + np.uint64(level + 1) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(31)
    return (h >> np.uint64(11)).astype(float) / (1 << 53)


class Cells:
    """A cut of a space into 2**depth cells.

    Cuts are kept as far as the sample tells medians; below, cells are cut by a hash of the id, and
    whoever reaches one half reaches the other.
    """

    def __init__(self, sample: np.ndarray, depth: int):
        deep = max(0, (len(sample) // SAMPLE_LEAST).bit_length() - 1)
        self.depth, self.levels = depth, min(depth, deep)
        inner = (1 << self.levels) - 1
        # a cut: coordinate (-1: by the hash alone), place, share of the rows tying with it that go left
        self.axis, self.at, self.left = np.full(inner, -1), np.zeros(inner), np.full(inner, 0.5)
        rows = {0: sample}
        for node in range(inner):
            own = rows.pop(node)
            spread = own.std(0) if len(own) else np.zeros(1)
            if spread.max() > 0:
                c = int(spread.argmax())
                v = np.sort(own[:, c])
                m = v[len(v) // 2]
                ties = int((v == m).sum())
                self.axis[node], self.at[node], self.left[node] = c, m, (len(v) / 2 - (v < m).sum()) / ties
                goes = (own[:, c] < m) | ((own[:, c] == m) & (uniform(np.arange(len(own)), node) < self.left[node]))
            else:
                goes = np.arange(len(own)) % 2 == 0
            rows[2 * node + 1], rows[2 * node + 2] = own[goes], own[~goes]

    def hashed(self, cell: np.ndarray, ids: np.ndarray) -> np.ndarray:
        more = self.depth - self.levels
        return (cell << more) + (uniform(ids, 1000) * (1 << more)).astype(np.int64)

    def home(self, x: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """The cell of each row."""
        node, every = np.zeros(len(x), np.int64), np.arange(len(x))
        for level in range(self.levels):
            axis = self.axis[node]
            v, u = x[every, axis], uniform(ids, level)
            goes = np.where(axis < 0, u < 0.5, (v < self.at[node]) | ((v == self.at[node]) & (u < self.left[node])))
            node = 2 * node + 2 - goes
        return self.hashed(node - (1 << self.levels) + 1, ids)

    def reached(self, x: np.ndarray, budget: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) of the cells within a squared distance of ``budget``."""
        row, node, used = np.arange(len(x)), np.zeros(len(x), np.int64), np.zeros(len(x))
        gaps = np.zeros(x.shape, np.float64)  # distance so far by coordinate
        for _ in range(self.levels):
            axis = self.axis[node]
            past = np.where(axis < 0, 0.0, x[row, axis] - self.at[node])
            old = gaps[np.arange(len(row)), axis]
            parts = []
            for side, gap in ((1, np.maximum(past, 0)), (2, np.maximum(-past, 0))):
                gap = np.where(axis < 0, old, np.maximum(gap, old))
                total = used + gap * gap - old * old
                keep = np.flatnonzero(total <= budget)
                g = gaps[keep]
                g[np.arange(len(keep)), axis[keep]] = gap[keep]
                parts.append((row[keep], 2 * node[keep] + side, total[keep], g))
            row, node, used, gaps = (np.concatenate([p[k] for p in parts]) for k in range(4))
        more = 1 << (self.depth - self.levels)
        cell = (node - (1 << self.levels) + 1) * more
        return np.repeat(row, more), (cell[:, None] + np.arange(more)).ravel()


def meetings(x: np.ndarray, y: np.ndarray | None, budget: float):
    """Places where pairs may keep to a squared distance: (rows of x, rows of y, matrix of pairs that do, all but for rounding).

    Without y, pairs are those of x, each once. Both sides are cut by a tree over x, one coordinate
    after the other, which carries the budget that is left.
    """
    same = y is None
    y = x if same else y

    def widened(t: np.ndarray, first: bool) -> np.ndarray:
        t = t.astype(np.float32)
        half = np.einsum("ij,ij->i", t, t)[:, None] / 2
        one = np.ones((len(t), 1), np.float32)
        return np.hstack([t, -half, -one] if first else [t, one, half])

    # one product gives minus half the squared distance
    wx, wy = widened(x, True), widened(y, False)
    least = np.float32(-budget / 2 - 1e-5)
    place = np.full(len(y), -1)
    todo = [(np.arange(len(x)), np.arange(len(y)), np.zeros(len(y)), ())]
    while todo:
        homes, visitors, used, cuts = todo.pop()
        if not len(homes) or not len(visitors):
            continue
        spread = np.zeros(1)
        if len(homes) > LEAF and len(cuts) < x.shape[1]:
            spread = x[homes].std(0)
            spread[list(cuts)] = -1
        if spread.max() <= 0:
            for at in range(0, len(homes), LEAF):
                h = homes[at : at + LEAF]
                if same:
                    place[homes] = np.arange(len(homes))
                for to in range(0, len(visitors), VISITORS):
                    v = visitors[to : to + VISITORS]
                    near = wx[h] @ wy[v].T >= least
                    if same:  # pairs inside the leaf once
                        near &= (place[v] < 0) | (place[v] > np.arange(at, at + len(h))[:, None])
                    i, k = np.flatnonzero(near.any(1)), np.flatnonzero(near.any(0))
                    if len(i):
                        yield h[i], v[k], near[np.ix_(i, k)]
                if same:
                    place[homes] = -1
            continue
        c = int(spread.argmax())
        homes = homes[np.argsort(x[homes, c], kind="stable")]
        low, high = np.split(homes, [len(homes) // 2])
        v = y[visitors, c]
        for part, gap in ((low, v - x[low[-1], c]), (high, x[high[0], c] - v)):
            total = used + np.maximum(gap, 0) ** 2
            keep = total <= budget
            if same and part is high:  # what is between the halves is found from the lower one
                place[low] = 0
                keep &= place[visitors] < 0
                place[low] = -1
            todo.append((part, visitors[keep], total[keep], (*cuts, c)))


def tile(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray] | None, block: int, cosine: float):
    """Links inside one tile: (links of left, links of right, labels), weights counted.

    ``left`` and ``right`` are (vectors, weights); without ``right`` the tile is a cell with itself.
    Labels number the tile's vectors, left ones first, by the least one they are linked with.
    """
    x, wx = left
    y, wy = right or left
    n = len(x)
    tx = rotate(x)
    ty = rotate(y) if right else tx
    ranges, share = blocks_of(tx.shape[1]), shares(tx.shape[1], cosine)
    lx, ly = np.sqrt(np.einsum("ij,ij->i", x, x)), np.sqrt(np.einsum("ij,ij->i", y, y))
    ux, uy = x / lx[:, None], y / ly[:, None]
    a, b = ranges[block]
    out_x, out_y = np.zeros(n, np.int64), np.zeros(len(y), np.int64)
    label = np.arange(n + (len(y) if right else 0))
    shift = n if right else 0

    def within(i: np.ndarray, k: np.ndarray, j: int) -> np.ndarray:
        """Whether each pair keeps to the share of block j."""
        c, d = ranges[j]
        p, q = tx[i, c:d], ty[k, c:d]
        square = np.einsum("ij,ij->i", p, p)[:, None] + np.einsum("ij,ij->i", q, q) - 2 * (p @ q.T)
        out = square <= share[j]
        r, s = np.nonzero(np.abs(square - share[j]) < 1e-11)  # too near for a product: added up in order
        out[r, s] = block_distance(p[r], q[s]) <= share[j]
        return out

    for i, k, near in meetings(tx[:, a:b], ty[:, a:b] if right else None, share[block]):
        cos = ux[i] @ uy[k].T
        link = near & within(i, k, block) & (cos >= cosine)
        r, s = np.nonzero(near & (np.abs(cos - cosine) < 1e-11))
        if len(r):
            exact = np.einsum("ij,ij->i", x[i[r]], y[k[s]]) / (lx[i[r]] * ly[k[s]]) >= cosine
            link[r, s] = exact & (block_distance(tx[i[r], a:b], ty[k[s], a:b]) <= share[block])
        if not link.any():
            continue
        r, s = np.nonzero(link)
        p, q = i[r], k[s] + shift
        while True:  # labels of linked vectors sink to the least
            differ = label[p] != label[q]
            if not differ.any():
                break
            p, q = p[differ], q[differ]
            low = np.minimum(label[p], label[q])
            np.minimum.at(label, label[p], low)
            np.minimum.at(label, label[q], low)
            label = label[label]
        own = link
        for earlier in range(block):
            own = own & ~within(i, k, earlier)
        out_x[i] += own @ wy[k]
        out_y[k] += wx[i] @ own
    while (label != label[label]).any():
        label = label[label]
    return out_x, out_y, label


def unpack(raw: pa.Array, kind: str) -> np.ndarray:
    rows = raw.to_pylist()
    return np.frombuffer(b"".join(rows), kind).reshape(len(rows), -1).astype(float) if rows else np.zeros((0, 1))


TILE = ("width", "block", "a", "b")


def near_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row."""
    spark = vectors.sparkSession
    kind = "<f4" if isinstance(vectors.schema[vector].dataType, ArrayType) and isinstance(vectors.schema[vector].dataType.elementType, FloatType) else "<f8"
    size = int(kind[2])
    bounded(spark)
    v = F.col(vector)
    finite = F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) < float("inf")))
    usable = F.coalesce(v.isNotNull() & F.col(key).isNotNull() & finite & F.exists(v, lambda e: e != 0), F.lit(False))
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.when(usable, v).alias("v"))

    def packed(batches):
        for batch in batches:
            values = batch.column("v")
            raw = [None if e is None else np.array(e, kind).tobytes() for e in values.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(raw, pa.binary())], names=["vec_id", "raw"])

    schema = StructType([StructField("vec_id", LongType()), StructField("raw", BinaryType())])
    rows = rows.mapInArrow(packed, schema).withColumn("same", F.unhex(F.md5("raw")))
    # one vector for all exact copies, with their number as its weight
    single = rows.where("raw IS NOT NULL").groupBy("same").agg(F.min("vec_id").alias("vid"), F.count("*").alias("weight"), F.first("raw").alias("raw"))
    single = cut(single, "vectors")
    width_of = (F.octet_length("raw") / size).cast("int")
    # lengths with more than a cell of vectors: as many as there are cells at most
    many = {r["w"]: r["n"] for r in single.groupBy(width_of.alias("w")).agg(F.count("*").alias("n")).where(F.col("w") * F.col("n") > CELL).collect()}
    cells: dict[int, list[Cells]] = {}
    for width, n in sorted(many.items()):
        depth = (-(-n * width // CELL) - 1).bit_length()
        most = max(2 * SAMPLE_LEAST, min(SAMPLE_ROWS // len(many), SAMPLE_BYTES // (size * width) // len(many), SAMPLE_CELL << min(depth, 20)))
        # a sample by id; twice as many rows as meant are the most that are taken
        taken = single.where((width_of == width) & (F.pmod(F.xxhash64("vid"), F.lit(-(-n // most))) == 0)).select("vid", "raw").limit(2 * most).toArrow()
        t = rotate(unpack(taken["raw"].combine_chunks(), kind)) if taken.num_rows else np.zeros((0, 1 << max(0, (width - 1).bit_length())))
        cells[width] = [Cells(t[:, c:d], depth) for c, d in blocks_of(t.shape[1])]

    def dealt(batches):
        """Packed parts of vectors by tile."""
        held: dict[tuple, list[tuple[bytes, bytes]]] = {}
        count = 0

        def emit():
            nonlocal count
            out = [(*k, len(v), b"".join(i for i, _ in v), b"".join(p for _, p in v)) for k, v in held.items()]
            held.clear()
            count = 0
            columns = list(zip(*out, strict=True))
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[*TILE, "right", "n", "ids", "parts"])

        for batch in batches:
            ids, raw = batch.column("vid").to_numpy(), batch.column("raw")
            widths = np.array([len(r) // size for r in raw.to_pylist()])
            for width in np.unique(widths).tolist():
                own = np.flatnonzero(widths == width)
                for at in range(0, len(own), 512):
                    rows = own[at : at + 512]
                    t, vid = rotate(unpack(raw.take(pa.array(rows)), kind)), ids[rows]
                    trees, limit = cells.get(width), shares(t.shape[1], cosine)
                    for j, (c, d) in enumerate(blocks_of(t.shape[1])):
                        x = t[:, c:d]
                        if trees:
                            home = trees[j].home(x, vid)
                            row, cell = trees[j].reached(x, limit[j] * (1 + 1e-9))
                        else:
                            home, row, cell = np.zeros(len(x), np.int64), np.arange(len(x)), np.zeros(len(x), np.int64)
                        low, high, right = np.minimum(cell, home[row]), np.maximum(cell, home[row]), home[row] > cell
                        order = np.lexsort((right, high, low))
                        low, high, right, row = low[order], high[order], right[order], row[order]
                        starts = np.flatnonzero(np.concatenate([[True], (low[1:] != low[:-1]) | (high[1:] != high[:-1]) | (right[1:] != right[:-1])])) if len(low) else []
                        part = x.astype("<f2")
                        for s, e in zip(starts, [*starts[1:], len(low)], strict=False):
                            held.setdefault((width, j, int(low[s]), int(high[s]), bool(right[s])), []).append((vid[row[s:e]].astype("<i8").tobytes(), part[row[s:e]].tobytes()))
                    count += len(rows)
                    if count >= PACKED:
                        yield emit()
        if held:
            yield emit()
        tidy()

    fields = [StructField("width", IntegerType()), StructField("block", IntegerType()), StructField("a", LongType()), StructField("b", LongType()), StructField("right", BooleanType())]
    tiles = single.select("vid", "raw").mapInArrow(dealt, StructType([*fields, StructField("n", LongType()), StructField("ids", BinaryType()), StructField("parts", BinaryType())]))

    def candidates(key_row: tuple, group: pa.Table) -> pa.Table:
        """Vectors of a tile with any candidate."""
        width, block, a, b = (k.as_py() for k in key_row)
        span = 1 << max(0, (width - 1).bit_length())
        c, d = blocks_of(span)[block]
        limit = (np.sqrt(shares(span, cosine)[block]) + HALF) ** 2
        right = group["right"].to_numpy(zero_copy_only=False)
        ids = [np.frombuffer(x, "<i8") for x in group["ids"].to_pylist()]
        parts = [np.frombuffer(x, "<f2").reshape(-1, d - c).astype(np.float32) for x in group["parts"].to_pylist()]
        sides = [(np.concatenate([np.zeros(0, "<i8"), *[x for x, r in zip(ids, right, strict=True) if r == s]]), np.concatenate([np.zeros((0, d - c), np.float32), *[x for x, r in zip(parts, right, strict=True) if r == s]])) for s in (False, True)]
        hit = [np.zeros(len(i), bool) for i, _ in sides]
        for i, k, near in meetings(sides[0][1], None if a == b else sides[1][1], limit):
            hit[0][i[near.any(1)]] = True
            hit[a != b][k[near.any(0)]] = True
        found = [i[h] for (i, _), h in zip(sides, hit, strict=True)]
        n = sum(map(len, found))
        const = lambda x, t: pa.array(np.full(n, x), t)
        return pa.table({"width": const(width, pa.int32()), "block": const(block, pa.int32()), "a": const(a, pa.int64()), "b": const(b, pa.int64()), "right": pa.array(np.repeat([False, True], [len(x) for x in found])), "vid": pa.array(np.concatenate(found))})

    active = cut(tiles.groupBy(*TILE).applyInArrow(candidates, StructType([*fields, StructField("vid", LongType())])), "vector-candidates")

    def linked(key_row: tuple, group: pa.Table) -> pa.Table:
        width, block, a, b = (k.as_py() for k in key_row)
        order = np.argsort(group["vid"].to_numpy(), kind="stable")
        group = group.take(pa.array(order))
        ids, weight, on_right = group["vid"].to_numpy(), group["weight"].to_numpy(), group["right"].to_numpy(zero_copy_only=False)
        x = unpack(group["raw"].combine_chunks(), kind)
        if a == b:
            nx, ny, label = tile((x, weight), None, block, cosine)
            n, vid = nx + ny, ids
        else:
            l, r = ~on_right, on_right
            if not l.any() or not r.any():
                return pa.table({"vid": pa.array([], pa.int64()), "links": pa.array([], pa.int64()), "root": pa.array([], pa.int64())})
            nx, ny, label = tile((x[l], weight[l]), (x[r], weight[r]), block, cosine)
            n, vid = np.concatenate([nx, ny]), np.concatenate([ids[l], ids[r]])
        moved = (n > 0) | (label != np.arange(len(label)))
        return pa.table({"vid": vid[moved], "links": n[moved], "root": vid[label[moved]]})

    whole = active.join(single.select("vid", "weight", "raw"), "vid")
    found = whole.groupBy(*TILE).applyInArrow(linked, StructType([StructField(c, LongType()) for c in ("vid", "links", "root")]))
    found = cut(found.groupBy("vid", "root").agg(F.sum("links").alias("links")), "vector-links")
    drop_path(spark, active)
    links = found.groupBy("vid").agg(F.sum("links").alias("links"))
    groups = components(found.select(F.col("vid").alias("a"), F.col("root").alias("b")))
    about = single.select("same", "vid", "weight").join(links, "vid", "left").join(groups.withColumnRenamed("node", "vid"), "vid", "left")
    about = about.select("same", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "vid").alias("component_id"))
    about = cut(about.where("n_links > 0"), "vector-classes")
    for used in (single, found):
        drop_path(spark, used)
    done = rows.select("vec_id", "same").join(about, "same", "left")
    return done.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        F.col("vec_id").eqNullSafe(F.coalesce("component_id", "vec_id")).alias("kept"),
    )
