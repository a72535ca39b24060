"""Quality classifier: logistic regression over hashed word n-grams, learned by follow-the-regularised-leader.

Features are hashed unigrams and bigrams of lower-cased words and unigrams to trigrams of word
shapes (a run of capitals, small letters, digits or one sign each gives one symbol), with a mark
of its own for a word that repeats the one before. Counts of a document are divided by its
number of words. The weights come from FTRL-proximal updates over a bounded sample of labelled
rows (``train_rows``); a score is the logistic function of a sparse dot product.

Defined results: null and empty texts score the intercept alone; repeated rows score alike; a
very long text is one sparse vector; without any labelled row every score is 0.5.
"""

from __future__ import annotations

import re
import tempfile
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, IntegerType, LongType, StringType, StructField

from kvloom.llm import labelled
from kvloom.llm.common import append, tidy

# The split that is kept back, and the threshold.
MODULUS, KEPT_BACK, THRESHOLD = 3, 1, 0.5
#: Most labelled rows that the weights are fitted on.
TRAIN_ROWS = 6000
BITS = 18
EPOCHS = 4
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.5
#: What a document's word and shape features weigh in all.
SCALE = 6.0
WORDS_KEPT = 150_000
#: Bytes of packed features that the learning task keeps in memory; more go to a file.
SPOOL_BYTES = 32 << 20

RUN = re.compile(r"(.)\1+")
SIGNS = ".,;:!?*#$%&|"
SEEDS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def shape(word: str) -> str:
    """Word with capitals as A, small letters as a, digits as 9 and runs as one."""
    bare = word.rstrip(SIGNS)
    if bare.isalpha():  # most words: small letters but for the first, with signs after them
        if bare.islower():
            return "a" + RUN.sub(r"\1", word[len(bare) :])
        if bare[0].isupper() and bare[1:].islower():
            return "Aa" + RUN.sub(r"\1", word[len(bare) :])
    return RUN.sub(r"\1", "".join("A" if c.isupper() else "a" if c.isalpha() else "9" if c.isdigit() else c for c in word))


class Features:
    """Hashed features of texts; keeps the hashes of words seen."""

    def __init__(self):
        import xxhash

        self.hash = xxhash.xxh64_intdigest
        self.known: dict[str, tuple[int, int]] = {}

    def word(self, w: str) -> tuple[int, int]:
        made = (self.hash(w.lower().strip(SIGNS)), self.hash(shape(w), 1))
        if len(self.known) >= WORDS_KEPT:
            self.known.clear()
        self.known[w] = made
        return made

    def of(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Indexes (the intercept is 0) and values."""
        found = text.split() if text else []
        if not found:
            return np.zeros(1, np.uint32), np.ones(1)
        known, word = self.known, self.word
        pairs = np.array([known.get(w) or word(w) for w in found], np.uint64)
        w, s = pairs[:, 0], pairs[:, 1]
        with np.errstate(over="ignore"):
            two = np.where(w[1:] == w[:-1], np.uint64(1), w[1:] * SEEDS[0] + (w[:-1] ^ SEEDS[1]))
            shapes2 = s[1:] * SEEDS[2] + (s[:-1] ^ SEEDS[3])
            shapes3 = shapes2[1:] * SEEDS[1] + (s[:-2] ^ SEEDS[0])
            every = np.concatenate([w, two, s, shapes2, shapes3])
            every ^= every >> np.uint64(29)
            every *= SEEDS[3]
            index = (every >> np.uint64(64 - BITS)).astype(np.uint32)
        index, count = np.unique(index, return_counts=True)
        return np.concatenate([np.zeros(1, np.uint32), index + np.uint32(1)]), np.concatenate([np.ones(1), count * (SCALE / len(found))])


def ftrl(rows: Iterable[tuple[int, np.ndarray, np.ndarray]], epochs: int = EPOCHS) -> np.ndarray:
    """Weights after FTRL-proximal updates over (label, indexes, values) rows in order, gone through once an epoch."""
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zi) <= L1, 0.0, (np.sign(zi) * L1 - zi) / ((BETA + np.sqrt(ni)) / ALPHA + L2))

    for _ in range(epochs):
        for label, i, x in rows:
            zi, ni = z[i], n[i]
            w = weights(zi, ni)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - label) * x
            more = ni + g * g
            z[i] = zi + g - (np.sqrt(more) - np.sqrt(ni)) / ALPHA * w
            n[i] = more
    return weights(z, n)


class Spool:
    """Rows of one task in a file of its own (a small one stays in memory), read in order of (turn, doc_id) as often as asked."""

    def __init__(self):
        self.file = tempfile.SpooledTemporaryFile(max_size=SPOOL_BYTES)  # noqa: SIM115
        self.places: list[tuple] = []

    def add(self, turn: int, doc_id, label: int, n_words: int, data: bytes) -> None:
        self.places.append((turn, doc_id, label, n_words, self.file.tell(), len(data)))
        self.file.write(data)

    def __iter__(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for _, _, label, n_words, at, size in sorted(self.places, key=lambda p: p[:2]):
            self.file.seek(at)
            yield label, *unpacked(self.file.read(size), n_words)


def packed(index: np.ndarray, value: np.ndarray, n_words: int) -> bytes:
    """Rising indexes as steps, and values as the counts that they were made of, compressed: about 2 bytes a feature."""
    counts = np.rint(value[1:] * (n_words / SCALE)).astype("<u4")
    return zlib.compress(np.diff(index[1:], prepend=np.uint32(0)).astype("<u4").tobytes() + counts.tobytes(), 1)


def unpacked(data: bytes, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """What ``packed`` packed; values are rounded to 32 bits."""
    step, count = np.frombuffer(zlib.decompress(data), "<u4").reshape(2, -1)
    index = np.concatenate([np.zeros(1, np.uint32), np.cumsum(step, dtype=np.uint32)])
    value = np.concatenate([np.ones(1), count * (SCALE / n_words)] if len(count) else [np.ones(1)])
    return index, value.astype("<f4").astype(float)


def learned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row: the weights learned from all rows of a task."""
    spool = Spool()
    for batch in batches:
        for r in batch.to_pylist():
            spool.add(r["turn"], r["doc_id"], r["label"], r["n_words"], r["data"])
    weights = ftrl(spool)
    spool.file.close()
    yield pa.RecordBatch.from_arrays([pa.array([weights.astype("<f8").tobytes()], pa.binary())], names=["weights"])
    tidy()


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> np.ndarray:
    """Weights learned from a bounded sample of the labelled rows that are not held out.

    Rows are bounded in number, not in length, so the driver never sees them: one task keeps their
    features in a file and goes through it once an epoch. Only the weights come back.
    """

    def make():
        features = Features()

        def step(batch: pa.RecordBatch) -> dict[str, pa.Array]:
            texts = batch.column("text").to_pylist()
            n_words = [len((t or "").split()) for t in texts]
            data = [packed(*features.of(t), n) for t, n in zip(texts, n_words, strict=True)]
            turn = [hash((d, 7)) for d in batch.column("doc_id").to_pylist()]
            # the text goes no further
            return {"text": pa.nulls(len(texts), pa.string()), "turn": pa.array(turn, pa.int64()), "n_words": pa.array(n_words, pa.int64()), "data": pa.array(data, pa.binary())}

        return step

    chosen = labelled.sample(docs, labels, "quality", MODULUS, KEPT_BACK, train_rows)
    fields = [StructField("text", StringType()), StructField("turn", LongType()), StructField("n_words", LongType()), StructField("data", BinaryType())]
    made = append(chosen, fields, make).select("turn", "doc_id", "label", "n_words", "data")
    got = made.repartition(1).mapInArrow(learned, "weights binary").collect()
    return np.frombuffer(got[0]["weights"], "<f8") if got else ftrl([])


def score(docs: DataFrame, weights: np.ndarray, text: str = "text", name: str = "quality_score") -> DataFrame:
    """``docs`` with the score of each text. The weights are 2**BITS numbers, whatever the input."""
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))

    def make():
        features, w = Features(), shared.value

        def step(batch: pa.RecordBatch) -> dict[str, pa.Array]:
            out = np.empty(batch.num_rows)
            for k, t in enumerate(batch.column(text).to_pylist()):
                i, x = features.of(t)
                out[k] = w[i] @ x
            return {name: pa.array(1 / (1 + np.exp(-np.clip(out, -35, 35))))}

        return step

    return append(docs, [StructField(name, DoubleType())], make)


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row a document: held_out, score and predicted."""
    scored = score(docs.select("doc_id", "text"), fit(docs, labels), name="score")
    return scored.select("doc_id", labelled.held_out(F.col("doc_id"), MODULUS, KEPT_BACK).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast(IntegerType()).alias("predicted"))
