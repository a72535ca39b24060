"""Packing documents into token windows by Karmarkar-Karp multiway differencing.

A document's ids are cut at every full window and, in what is left, at every ``piece`` ids.
Full windows are sequences of their own. The other pieces of one task are dealt, batch by
batch, into k windows by largest differencing: every piece starts as a partial partition with
one filled part, and the two partial partitions of the largest spread are merged with opposing
imbalances until one is left. k starts at the least number that can hold the batch and rises
whenever a part is over the window.

Nothing is shuffled: each task packs what it reads, so a hot source or a huge document stays
spread as it was read, and a lost task gives the same sequences again (ids of sequences hold
the partition and a counter).

Defined results: a null text counts as empty; an empty document is the end id alone; repeated
rows are packed each; a document with 2048 ids or more fills windows of its own first.
"""

from __future__ import annotations

import heapq
import json
import re
import sys

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from kvloom.llm.common import ROWS_OUT, bounded, tidy

WINDOW, PIECE, END_ID = 2048, 512, 1
#: Pieces dealt at once; bounds the memory and the time of one differencing.
BATCH = 4096
#: Ids held back for dealing at most (4 bytes each).
BATCH_IDS = 1 << 20

#: Characters whose classes differ between releases of the regular expression engines, or that are
#: white space in some only: texts with them go to the tokenizers library whole.
ODD = re.compile("[\\x00-\\x08\\x0b-\\x0c\\x0e-\\x1f\\x7f-\\xa0\\u1680\\u180e\\u2000-\\u200f\\u2028-\\u202f\\u205f-\\u206f\\u3000\\ufeff\\ufff0-\\uffff\\U00010000-\\U0010ffff]")
#: tiktoken's pattern looks back over every character of a white space run (it fails near a million).
LONG_SPACE = re.compile(r"\s{10000}")


class ByteBpe:
    """Ids of a byte-level BPE file, as the tokenizers library gives them without special tokens added.

    The same vocabulary and pattern run in tiktoken, which is some four times faster; texts that hold a
    special token's string, characters of disputed class or white space so long that tiktoken's
    pattern would run out of stack go through the tokenizers library.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(path)
        self.exact.no_truncation()
        self.exact.no_padding()
        with open(path, encoding="utf-8") as file:
            parsed = json.load(file)
        model, pre = parsed["model"], parsed["pre_tokenizer"]
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(plain)))}
        self.special = [t["content"] for t in parsed["added_tokens"]]
        ranks = {bytes(byte_of[c] for c in token): i for token, i in model["vocab"].items() if token not in self.special}
        known = pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and parsed["normalizer"] is None
        # The ids of merged tokens must rise in the order of the merges: then ranks and ids agree.
        merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        order = [model["vocab"][m] for m in merged]
        self.fast = None
        if known and order == sorted(order) and len(ranks) == 256 + len(merged):
            pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
            self.fast = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if self.fast is None or ODD.search(text) or any(s in text for s in self.special) or (len(text) >= 10_000 and LONG_SPACE.search(text)):
            return np.array(self.exact.encode(text, add_special_tokens=False).ids, "<u4")
        return np.array(self.fast.encode_ordinary(text), "<u4")


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """``sizes`` dealt into at most k parts of near-equal sums by largest differencing; indexes."""
    # A partial partition: (-spread, tie, parts with members as (sum, members), largest first). Parts
    # not listed are empty. Members are nested pairs, unfolded at the end.
    heap = [(-x, i, [(x, i)]) for i, x in enumerate(sizes)]
    heapq.heapify(heap)
    tie = len(sizes)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        # Slot j of the one meets slot k-1-j of the other; only the last slots of a long list meet any.
        over = len(a) + len(b) - k
        if over <= 0:
            parts = a + b
        else:
            met = [(x[0] + y[0], (x[1], y[1])) for x, y in zip(a[len(a) - over :], reversed(b[len(b) - over :]), strict=True)]
            parts = a[: len(a) - over] + b[: len(b) - over] + met
        parts.sort(key=lambda p: -p[0])
        heapq.heappush(heap, (-(parts[0][0] - (parts[-1][0] if len(parts) == k else 0)), tie, parts))
        tie += 1
    out = []
    for _, members in heap[0][2] if heap else []:
        stack, flat = [members], []
        while stack:
            x = stack.pop()
            if isinstance(x, tuple):
                stack += x
            else:
                flat.append(x)
        out.append(sorted(flat))
    return out


def windows(sizes: list[int], window: int = WINDOW) -> list[list[int]]:
    """Parts of at most ``window``: the number of parts rises until differencing keeps to it."""
    total = sum(sizes)
    if not total:
        return []
    k = -(-total // window)
    while True:
        parts = differencing(sizes, k)
        if max(sum(sizes[i] for i in p) for p in parts) <= window:
            return parts
        k += max(1, k // 500)


FIELDS = StructType([StructField(n, LongType()) for n in ("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset")] + [StructField("ids", BinaryType())])
NAMES = [f.name for f in FIELDS]


def pack(docs: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text", window: int = WINDOW, piece: int = PIECE, end_id: int = END_ID) -> DataFrame:
    """One row a piece: where it starts in its document, its sequence and offset there, its ids (4 bytes each, little-endian)."""

    def run(batches):
        sys.setrecursionlimit(10_000)
        bpe = ByteBpe(tokenizer_path)
        number = TaskContext.get().partitionId() << 36
        rows: list[tuple] = []
        held: list[tuple] = []  # doc_id, start, ids, doc_tokens
        size = 0

        def emit():
            columns = zip(*rows, strict=True)
            out = pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if n == "ids" else pa.int64()) for n, c in zip(NAMES, columns, strict=True)], names=NAMES)
            rows.clear()
            return out

        def deal():
            nonlocal number, size
            for part in windows([len(h[2]) for h in held], window):
                at = 0
                for i in part:
                    doc, start, ids, total = held[i]
                    rows.append((doc, start, len(ids), total, number, at, ids.tobytes()))
                    at += len(ids)
                number += 1
            held.clear()
            size = 0

        for batch in batches:
            for doc, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.append(bpe.ids(t or ""), np.uint32(end_id)).astype("<u4")
                full = len(ids) // window * window
                for a in range(0, full, window):
                    rows.append((doc, a, window, len(ids), number, 0, ids[a : a + window].tobytes()))
                    number += 1
                    if len(rows) >= 4 * ROWS_OUT:
                        yield emit()
                for a in range(full, len(ids), piece):
                    held.append((doc, a, ids[a : a + piece], len(ids)))
                size += len(ids) - full
                if len(held) >= BATCH or size >= BATCH_IDS:
                    deal()
                if len(rows) >= 4 * ROWS_OUT:
                    yield emit()
        if held:
            deal()
        if rows:
            yield emit()
        del bpe
        tidy()

    bounded(docs.sparkSession)
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, FIELDS)


def digest(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """One row a piece with the CRC-32 of its ids."""
    return pack(docs, tokenizer_path).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
