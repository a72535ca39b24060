"""Toxicity: gradient-boosted trees over dense features, calibrated by isotonic regression.

Features of a text are densities of two lexicons (a fixed one, and words and stems that the labelled
rows single out, weighted by the evidence for them), how near second-person words stand to lexicon words, and rates of
capitals, punctuation, repeated signs and obfuscation (digits or signs inside words, stretched
letters, words that meet the lexicon only once such disguise is undone).

Lexicon, trees and calibration are fitted on a bounded sample (``train_rows``) of labelled rows
that are not held out. The calibration sees margins of rows that neither the trees nor the lexicon
behind them were learned from: both are learned once more without each fold. Scores and features
cover whole texts.

Defined results: null and empty texts have zero features and get that leaf's score; repeated rows
score alike; without labelled rows of both classes every score is the mean label (0 without any).
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, IntegerType, StringType, StructField

from kvloom.llm import labelled
from kvloom.llm.common import append, cut, drop_path

# The split that is kept back, and the threshold.
MODULUS, KEPT_BACK, THRESHOLD = 4, 2, 0.3
#: Most labelled rows that lexicon, trees and calibration are fitted on.
TRAIN_ROWS = 12_000
#: Most entries of the learned lexicon, and the least rows and evidence (signed root of the likelihood ratio) of its words and stems.
LEXICON_SIZE, LEXICON_ROWS, LEXICON_Z, STEM_Z = 500, 4, 4.0, 4.5
#: Lengths of the word beginnings that may be learned as stems; a stem is written with a star.
STEMS = range(4, 9)
#: A stem also counts as found twice or three times, in so many different words of a text.
TIMES = (1, 2, 3)
TREES, DEPTH, RATE, BINS, LEAF_ROWS, RIDGE, FOLDS = 60, 3, 0.15, 32, 5, 1.0, 5
WORDS_KEPT = 200_000
#: Words between a second-person word and a lexicon word that count as near.
NEAR = 6

# Insults and second-person words of the four languages of the corpus.
INSULTS = frozenset(
    "idiot idiots moron morons stupid dumb loser losers trash scum clown clowns worthless pathetic disgusting garbage vermin filth "
    "imbecile cretin freak bastard jerk dummkopf trottel vollidiot abschaum dreck widerlich wertlos erbärmlich dumm versager "
    "crétin imbécile abruti ordure déchet nul minable pathétique dégoûtant stupide raclure "
    "idiota imbécil estúpido basura escoria payaso inútil patético asqueroso perdedor".split()
)
SECOND = frozenset("you your yours yourself u ur du dich dir dein deine deiner euch euer ihr tu te toi ton ta tes vous votre vos tú ti tuyo usted ustedes vosotros vuestro".split())
LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "+": "t"})
EDGE = ".,;:!?\"'()[]{}*#%&|<>-_~`/\\"
STRETCH = re.compile(r"(.)\1{2,}")

WORD_FEATURES = ("fixed", "learned", "undone", "stem", "second", "capital", "punctuation", "inside_digit", "inside_sign", "stretched", "shouted")
FEATURES = (*WORD_FEATURES, "near", "fixed_count", "learned_count", "undone_count", "stem_count", "log_words")


def plain(word: str) -> str:
    """Word in small letters without signs at its ends."""
    return word.lower().strip(EDGE)


def undo(word: str) -> str:
    """Small letters that a disguised word stands for."""
    bare = STRETCH.sub(r"\1", word.lower().translate(LEET))
    return "".join(c for c in bare if c.isalpha())


def entries(text: str | None) -> list[str]:
    """What a text offers to the lexicon: its words in plain form and the stems of longer words."""
    found = {plain(w) for w in (text or "").split()} - {""}
    stems = Counter(w[:n] for w in found for n in STEMS if n < len(w))
    return sorted(found | {f"{stem}*{k}" for stem, many in stems.items() for k in TIMES if k <= many})


class Dense:
    """Dense features of texts; keeps those of words seen."""

    def __init__(self, learned: dict[str, float]):
        self.learned = learned
        # learned stems by their beginning, so that most words need one look-up
        self.stems: dict[str, list[tuple[str, float]]] = {}
        for entry, weight in learned.items():
            if entry.endswith("*"):
                self.stems.setdefault(entry[: STEMS.start], []).append((entry[:-1], weight))
        self.index: dict[str, int] = {}
        self.rows = np.zeros((1024, len(WORD_FEATURES)), np.float32)

    def stem(self, p: str) -> float:
        near = self.stems.get(p[: STEMS.start])
        return max((x for s, x in near if len(s) < len(p) and p.startswith(s)), default=0.0) / 10 if near else 0.0

    def word(self, w: str) -> int:
        at = len(self.index)
        if at == len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        bare = w.strip(EDGE)
        if bare.isalpha() and (bare.islower() or (bare[0].isupper() and bare[1:].islower())) and (p := bare.lower()).isalpha() and not STRETCH.search(p):
            # most words: letters, small but for the first, with signs before and after them
            row = self.rows[at]
            row[:] = 0
            if p in INSULTS:
                row[0] = 1
            if p in self.learned:
                row[1] = self.learned[p] / 10
            if p[: STEMS.start] in self.stems:
                row[3] = self.stem(p)
            if p in SECOND:
                row[4] = 1
            if not bare.islower():
                row[5] = 1 / len(w)
            if len(bare) < len(w):
                row[6] = (len(w) - len(bare)) / len(w)
            self.index[w] = at
            return at
        p = plain(w)
        letters = sum(c.isalpha() for c in w)
        fixed, learned = p in INSULTS, self.learned.get(p, 0.0) / 10
        stem = self.stem(p)
        disguised = False
        if not (fixed or learned) and letters >= 2 and not p.isalpha() or STRETCH.search(p):
            bare = undo(p)
            disguised = not (fixed or learned) and (bare in INSULTS or bare in self.learned)
        self.rows[at] = (
            fixed, learned, disguised, stem, p in SECOND, sum(c.isupper() for c in w) / len(w), sum(not c.isalnum() for c in w) / len(w),
            letters > 0 and any(c.isdigit() for c in p), letters > 1 and any(not c.isalnum() for c in p), bool(STRETCH.search(p)), letters > 1 and w.isupper(),
        )
        self.index[w] = at
        return at

    def of(self, text: str | None) -> np.ndarray:
        found = text.split() if text else []
        out = np.zeros(len(FEATURES), np.float32)
        if not found:
            return out
        index, word = self.index, self.word
        if len(index) >= WORDS_KEPT:
            index.clear()
        at = [index[w] if w in index else word(w) for w in found]
        rows = self.rows[at]
        n, k = len(found), len(WORD_FEATURES)
        out[:k] = rows.sum(0) / n
        hits = np.flatnonzero(rows[:, 0] + rows[:, 1] + rows[:, 2] + rows[:, 3])
        second = np.flatnonzero(rows[:, 4])
        if len(hits) and len(second):
            at = np.searchsorted(second, hits)
            gap = np.minimum(np.abs(hits - second[np.maximum(at - 1, 0)]), np.abs(second[np.minimum(at, len(second) - 1)] - hits))
            out[k] = (gap <= NEAR).sum() / n
        out[k + 1 : k + 5] = rows[:, :4].sum(0)
        out[k + 5] = np.log1p(n)
        return out


class Trees:
    """Boosted regression trees of fixed depth on quantile bins, for logistic loss."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        # most features are zero almost everywhere: a cut just above zero is always there
        self.cuts = [np.unique(np.concatenate([[0.0], c, np.quantile(d[d > 0], [0.25, 0.5, 0.75]) if (d > 0).any() else []])) for c, d in zip(self.cuts, x.T, strict=True)]
        b = self.bins(x)
        mean = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.start = float(np.log(mean / (1 - mean)))
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        f = np.full(len(y), self.start)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-f))
            tree = self.grow(b, y - p, p * (1 - p))
            self.trees.append(tree)
            f += RATE * self.leaf(tree, b)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, v, side="left") for c, v in zip(self.cuts, x.T, strict=True)], 1)

    @staticmethod
    def grow(b: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        inner = (1 << DEPTH) - 1
        feature, cut, node = np.zeros(inner, int), np.full(inner, 1 << 30), np.zeros(len(g), int)
        for at in range(inner):
            rows = np.flatnonzero(node == at)
            best = (1e-6, 0, 1 << 30)
            if len(rows) >= 2 * LEAF_ROWS:
                gs, hs = g[rows].sum(), h[rows].sum()
                for j in range(b.shape[1]):
                    v = b[rows, j]
                    size = int(v.max()) + 1
                    gl, hl, nl = (np.cumsum(np.bincount(v, w, size))[:-1] for w in (g[rows], h[rows], np.ones(len(rows))))
                    gain = gl**2 / (hl + RIDGE) + (gs - gl) ** 2 / (hs - hl + RIDGE) - gs**2 / (hs + RIDGE)
                    gain[(nl < LEAF_ROWS) | (len(rows) - nl < LEAF_ROWS)] = 0
                    if len(gain) and gain.max() > best[0]:
                        best = (float(gain.max()), j, int(gain.argmax()))
            feature[at], cut[at] = best[1], best[2]
            node[rows] = 2 * at + 1 + (b[rows, best[1]] > best[2])
        leaf = node - inner
        sums = [np.bincount(leaf, w, inner + 1) for w in (g, h)]
        return feature, cut, sums[0] / (sums[1] + RIDGE)

    @staticmethod
    def leaf(tree: tuple[np.ndarray, np.ndarray, np.ndarray], b: np.ndarray) -> np.ndarray:
        feature, cut, value = tree
        node, rows = np.zeros(len(b), int), np.arange(len(b))
        for _ in range(DEPTH):
            node = 2 * node + 1 + (b[rows, feature[node]] > cut[node])
        return value[node - len(feature)]

    def margin(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        return self.start + RATE * sum((self.leaf(t, b) for t in self.trees), np.zeros(len(x)))


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators fit: block centres and their rising means."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []  # sum of y, sum of x, rows
    for a, c in zip(x[order], y[order], strict=True):
        blocks.append([float(c), float(a), 1.0])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][2] >= blocks[-1][0] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last, strict=True)]
    return np.array([b[1] / b[2] for b in blocks]), np.array([b[0] / b[2] for b in blocks])


class Model:
    """Learned lexicon, trees and calibration.

    ``views`` are the rows' features: first those by the whole lexicon, then those by the lexicon
    learned without each fold.
    """

    def __init__(self, learned: dict[str, float], views: list[np.ndarray], y: np.ndarray, fold: np.ndarray):
        self.learned, self.trees = learned, None
        self.mean = float(y.mean()) if len(y) else 0.0
        if len(y) < 4 * LEAF_ROWS or not 0 < self.mean < 1:
            return
        margins = np.empty(len(y))
        for k in range(FOLDS):
            out, x = fold == k, views[k + 1]
            if out.any():
                margins[out] = Trees(x[~out], y[~out]).margin(x[out])
        self.centres, self.means = isotonic(margins, y)
        self.trees = Trees(views[0], y)

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None or not len(x):
            return np.full(len(x), self.mean)
        m = self.trees.margin(x)
        # a thousandth of the margin keeps the order inside the calibration's flat steps
        return np.clip(0.999 * np.interp(m, self.centres, self.means) + 0.001 / (1 + np.exp(-np.clip(m, -35, 35))), 0, 1)


def lexicons(rows: DataFrame) -> list[dict[str, float]]:
    """Evidence for the words and stems of the lexicon: of all rows (text, label, fold), then without each fold."""

    def words_of():
        def step(batch: pa.RecordBatch) -> dict[str, pa.Array]:
            return {"words": pa.array([entries(t) for t in batch.column("text").to_pylist()], pa.list_(pa.string()))}

        return step

    sets = append(rows, [StructField("words", ArrayType(StringType()))], words_of)
    label, fold = F.col("label"), F.col("fold")
    seen = range(FOLDS)
    totals = {r["fold"]: (int(r["n1"]), int(r["n"])) for r in rows.groupBy("fold").agg(F.sum("label").alias("n1"), F.count("*").alias("n")).collect()}
    counts = sets.select(F.explode("words").alias("word"), "label", "fold").groupBy("word").agg(
        F.sum("label").alias("a"), F.sum(1 - label).alias("c"), *[F.sum(F.when(fold == k, label).otherwise(0)).alias(f"a{k}") for k in seen], *[F.sum(F.when(fold == k, 1 - label).otherwise(0)).alias(f"c{k}") for k in seen]
    )
    counts = cut(counts.where(F.col("a") >= LEXICON_ROWS), "lexicon")
    stem = F.contains("word", F.lit("*"))
    out = []
    for left_out in (None, *seen):
        kept = [v for k, v in totals.items() if k != left_out]
        n1 = sum(x for x, _ in kept)
        n0 = sum(n for _, n in kept) - n1
        a, c = F.col("a"), F.col("c")
        if left_out is not None:
            a, c = a - F.col(f"a{left_out}"), c - F.col(f"c{left_out}")
        share = max(n1, 1) / max(n1 + n0, 1)
        part = lambda x, p, a=a, c=c: F.when(x > 0, x * F.log(x / ((a + c) * p))).otherwise(0.0)
        z = F.sqrt(2 * F.greatest(part(a, share) + part(c, max(1 - share, 1e-9)), F.lit(0.0)))
        found = counts.where((a >= LEXICON_ROWS) & (a > (a + c) * share)).select("word", z.alias("z"))
        top = found.where(F.col("z") >= F.when(stem, STEM_Z).otherwise(LEXICON_Z)).orderBy(F.desc("z"), "word").limit(LEXICON_SIZE)
        learned: dict[str, float] = {}
        for r in top.collect():
            word = r["word"][:-1] if "*" in r["word"] else r["word"]
            learned[word] = max(learned.get(word, 0.0), r["z"])
        out.append(learned)
    drop_path(rows.sparkSession, counts)
    return out


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    """A model learned from a bounded sample of the labelled rows that are not held out."""
    fold = F.pmod(F.xxhash64("doc_id", F.lit(FOLDS)), F.lit(FOLDS)).cast("int").alias("fold")
    rows = cut(labelled.sample(docs, labels, "toxic", MODULUS, KEPT_BACK, train_rows).select("doc_id", "text", "label", fold), "toxicity-rows")
    learned = lexicons(rows)
    names = [f"f{k}" for k in range(len(learned))]

    def make():
        dense = [Dense(x) for x in learned]

        def step(batch: pa.RecordBatch) -> dict[str, pa.Array]:
            texts = batch.column("text").to_pylist()
            return {n: pa.array([d.of(t).astype("<f4").tobytes() for t in texts], pa.binary()) for n, d in zip(names, dense, strict=True)}

        return step

    got = append(rows, [StructField(n, BinaryType()) for n in names], make).select("doc_id", "label", "fold", *names).toArrow().to_pylist()
    drop_path(docs.sparkSession, rows)
    got.sort(key=lambda r: r["doc_id"])
    views = [np.array([np.frombuffer(r[n], "<f4") for r in got]).reshape(len(got), len(FEATURES)) for n in names]
    return Model(learned[0], views, np.array([r["label"] for r in got], float), np.array([r["fold"] for r in got], int))


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "toxicity") -> DataFrame:
    """``docs`` with the calibrated score of each text."""

    def make():
        dense = Dense(model.learned)

        def step(batch: pa.RecordBatch) -> dict[str, pa.Array]:
            x = np.array([dense.of(t) for t in batch.column(text).to_pylist()], np.float32).reshape(batch.num_rows, len(FEATURES))
            return {name: pa.array(model.score(x).astype(float))}

        return step

    return append(docs, [StructField(name, DoubleType())], make)


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row a document: held_out, score and predicted."""
    scored = score(docs.select("doc_id", "text"), fit(docs, labels), name="score")
    return scored.select("doc_id", labelled.held_out(F.col("doc_id"), MODULUS, KEPT_BACK).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast(IntegerType()).alias("predicted"))
