"""Learned scores against plain versions of every step: features, lexicon, trees, calibration, updates."""

import math
import random

import numpy as np
import xxhash

from kvloom.llm import labelled, quality, toxicity
from tests.llm.fixtures import LONG
from tests.llm.test_scores import corpus, frames

TEXTS = [None, "", "one", "One two, TWO two!! three.", "a a a a", "x1y2 don't ### $$$a ÉCOLE é日本 İstanbul", LONG[:3000], "Du bist ein IDIOT, you m0r0n!!! sooooo dumm", "you " * 9 + "scum"]
TEXTS += [" ".join(random.Random(i).choice(["you", "Idiot,", "1d1ot", "trash", "good", "Day.", "dummm", "w-w", "(ok)", "ÄRGER", "dein", "a1"]) for _ in range(25)) for i in range(40)]
WHOLE = (1 << 64) - 1


# quality


def plain_shape(word):
    out = ""
    for c in word:
        c = "A" if c.isupper() else "a" if c.isalpha() else "9" if c.isdigit() else c
        if not out.endswith(c):
            out += c
    return out


def plain_sparse(text):
    """Index to value, one n-gram at a time in whole numbers."""
    a, b, c, d = (int(x) for x in quality.SEEDS)
    words = (text or "").split()
    out = {0: 1.0}
    if not words:
        return out
    w = [xxhash.xxh64_intdigest(x.lower().strip(".,;:!?*#$%&|")) for x in words]
    s = [xxhash.xxh64_intdigest(plain_shape(x), 1) for x in words]
    grams = [*w, *s]
    for i in range(1, len(w)):
        grams.append(1 if w[i] == w[i - 1] else (w[i] * a + (w[i - 1] ^ b)) & WHOLE)
    two = [(s[i] * c + (s[i - 1] ^ d)) & WHOLE for i in range(1, len(s))]
    grams += two + [(two[i] * b + (s[i - 1] ^ a)) & WHOLE for i in range(1, len(two))]
    for g in grams:
        g = ((g ^ (g >> 29)) * d) & WHOLE
        at = (g >> (64 - quality.BITS)) + 1
        out[at] = out.get(at, 0.0) + quality.SCALE / len(words)
    return out


def test_quality_features_equal_plain_ones():
    features = quality.Features()
    for text in TEXTS:
        index, value = features.of(text)
        assert len(set(index.tolist())) == len(index)
        want = plain_sparse(text)
        got = dict(zip(index.tolist(), value.tolist(), strict=True))
        assert got.keys() == want.keys() and all(math.isclose(got[k], want[k]) for k in want), text


def plain_ftrl(rows):
    """Follow the regularised leader, one coordinate at a time."""
    z, n = {}, {}

    def weight(i):
        if abs(z.get(i, 0.0)) <= quality.L1:
            return 0.0
        return -(z[i] - math.copysign(quality.L1, z[i])) / ((quality.BETA + math.sqrt(n[i])) / quality.ALPHA + quality.L2)

    for _ in range(quality.EPOCHS):
        for label, x in rows:
            w = {i: weight(i) for i in x}
            p = 1 / (1 + math.exp(-sum(w[i] * x[i] for i in x)))
            for i in x:
                g = (p - label) * x[i]
                sigma = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / quality.ALPHA
                z[i] = z.get(i, 0.0) + g - sigma * w[i]
                n[i] = n.get(i, 0.0) + g * g
    return {i: weight(i) for i in z}


def test_quality_scores_equal_plain_updates(spark):
    d, l = frames(spark, 90)
    rows, marks = corpus(90)
    text = dict(rows)
    learned = [(i, q) for i, q, _ in marks if not held(i, 3, 1)]
    learned.sort(key=lambda r: (hash((r[0], 7)), r[0]))
    # values travel in single precision
    weights = plain_ftrl([(q, {k: float(np.float32(v)) for k, v in plain_sparse(text[i]).items()}) for i, q in learned])
    for r in quality.digest(d, l).collect():
        want = 1 / (1 + math.exp(-sum(weights.get(k, 0.0) * v for k, v in plain_sparse(text[r["doc_id"]]).items())))
        assert math.isclose(r["score"], want, abs_tol=1e-4) and r["held_out"] == held(r["doc_id"], 3, 1)


def test_quality_rows_come_back_from_the_spool(monkeypatch):
    """In order of turn, whole and as often as asked, whether they lie in memory or in a file."""
    features = quality.Features()
    rows = [(hash((i, 7)), i, i % 2, len((t or "").split()), *features.of(t)) for i, t in enumerate(TEXTS)]
    for most in (1, 1 << 20):
        monkeypatch.setattr(quality, "SPOOL_BYTES", most)
        spool = quality.Spool()
        for turn, i, label, n, index, value in rows:
            spool.add(turn, i, label, n, quality.packed(index, value, n))
        for _ in range(2):
            for (*_, label, _, index, value), got in zip(sorted(rows, key=lambda r: r[:2]), spool, strict=True):
                assert got[0] == label and got[1].tolist() == index.tolist() and got[2].tolist() == value.astype("<f4").tolist()


def held(i, modulus, kept_back):
    import zlib

    return zlib.crc32(str(i).encode()) % modulus == kept_back


# toxicity


def plain_dense(text, learned):
    """The features of a text, one word at a time."""
    edge = ".,;:!?\"'()[]{}*#%&|<>-_~`/\\"
    words = (text or "").split()
    out = dict.fromkeys(toxicity.FEATURES, 0.0)
    if not words:
        return list(out.values())
    hits, second = [], []
    for at, w in enumerate(words):
        p = w.lower().strip(edge)
        stretched = any(p[i] == p[i + 1] == p[i + 2] for i in range(len(p) - 2))
        letters = sum(c.isalpha() for c in w)
        fixed, weight = float(p in toxicity.INSULTS), learned.get(p, 0.0) / 10
        stem = max([learned.get(p[:n] + "*", 0.0) for n in range(4, 9) if n < len(p)] + [0.0]) / 10
        undone = 0.0
        if not (fixed or weight) and ((letters >= 2 and not p.isalpha()) or stretched):
            bare = toxicity.undo(p)
            undone = float(bare in toxicity.INSULTS or bare in learned)
        row = {
            "fixed": fixed, "learned": weight, "undone": undone, "stem": stem, "second": float(p in toxicity.SECOND), "capital": sum(c.isupper() for c in w) / len(w), "punctuation": sum(not c.isalnum() for c in w) / len(w),
            "inside_digit": float(letters > 0 and any(c.isdigit() for c in p)), "inside_sign": float(letters > 1 and any(not c.isalnum() for c in p)), "stretched": float(stretched), "shouted": float(letters > 1 and w.isupper()),
        }
        for k, v in row.items():
            out[k] += v / len(words)
        for k in ("fixed", "learned", "undone", "stem"):
            out[f"{k}_count"] += row[k]
        if fixed or weight or undone or stem:
            hits.append(at)
        if row["second"]:
            second.append(at)
    out["near"] = sum(any(abs(h - s) <= toxicity.NEAR for s in second) for h in hits) / len(words)
    out["log_words"] = math.log1p(len(words))
    return list(out.values())


def test_toxicity_features_equal_plain_ones():
    learned = {"good": 5.0, "dumm*": 4.6, "trash": 7.0, "dumme*": 5.0, "mor*": 9.0}
    dense = toxicity.Dense(learned)
    for text in TEXTS:
        assert np.allclose(dense.of(text), plain_dense(text, learned), atol=1e-5), text


def plain_lexicon(rows):
    """Evidence by the likelihood ratio of one two-by-two table a word."""
    n1, n = sum(y for _, y in rows), len(rows)
    a, c = {}, {}
    for text, y in rows:
        for e in toxicity.entries(text):
            (a if y else c)[e] = (a if y else c).get(e, 0) + 1
    share, found = max(n1, 1) / max(n, 1), []
    for e, k in a.items():
        m = k + c.get(e, 0)
        if k < toxicity.LEXICON_ROWS or k <= m * share:
            continue
        z = math.sqrt(2 * max(0.0, sum(x * math.log(x / (m * p)) for x, p in ((k, share), (m - k, max(1 - share, 1e-9))) if x)))
        if z >= (toxicity.STEM_Z if "*" in e else toxicity.LEXICON_Z):
            found.append((-z, e))
    out = {}
    for z, e in sorted(found)[: toxicity.LEXICON_SIZE]:
        e = e[:-1] if "*" in e else e
        out[e] = max(out.get(e, 0.0), -z)
    return out


def test_toxicity_scores_equal_plain_steps(spark):
    """Lexica without each fold, then features, trees and calibration put together by hand."""
    from pyspark.sql import functions as F

    d, l = frames(spark, 240)
    rows, marks = corpus(240)
    text, toxic = dict(rows), {i: t for i, _, t in marks}
    ids = [i for i in sorted(text) if not held(i, 4, 2)]
    fold = {r["doc_id"]: r["k"] for r in d.select("doc_id", F.pmod(F.xxhash64("doc_id", F.lit(toxicity.FOLDS)), F.lit(toxicity.FOLDS)).alias("k")).collect()}
    lexica = [plain_lexicon([(text[i], toxic[i]) for i in ids if fold[i] != k]) for k in (None, *range(toxicity.FOLDS))]
    sample = labelled.sample(d, l, "toxic", 4, 2, 1000).select("doc_id", "text", "label", F.pmod(F.xxhash64("doc_id", F.lit(toxicity.FOLDS)), F.lit(toxicity.FOLDS)).alias("fold"))
    for got, want in zip(toxicity.lexicons(sample), lexica, strict=True):
        assert got.keys() == want.keys() and all(math.isclose(got[e], want[e]) for e in want)
    assert lexica[0] and any(x != lexica[0] for x in lexica[1:])
    x = [np.array([plain_dense(text[i], lexicon) for i in ids], np.float32) for lexicon in lexica]
    y, f = np.array([toxic[i] for i in ids], float), np.array([fold[i] for i in ids])
    margin = np.zeros(len(ids))
    for k in range(toxicity.FOLDS):
        margin[f == k] = toxicity.Trees(x[k + 1][f != k], y[f != k]).margin(x[k + 1][f == k])
    level = dict(zip(margin.tolist(), plain_isotonic(margin, y), strict=True))
    trees = toxicity.Trees(x[0], y)
    scores = {r["doc_id"]: r["score"] for r in toxicity.digest(d, l).collect()}
    at = sorted(level)
    for i, s in scores.items():
        m = float(trees.margin(np.array([plain_dense(text[i], lexica[0])], np.float32))[0])
        low = max((level[v] for v in at if v <= m), default=level[at[0]])
        high = min((level[v] for v in at if v >= m), default=level[at[-1]])
        # between the steps the score is interpolated
        assert 0.999 * low - 1e-6 <= s <= 0.999 * high + 0.001 + 1e-6


def plain_isotonic(x, y):
    """Rising means by the max-min formula; rows of equal x are one."""
    at = sorted(set(x.tolist()))
    sums = [(sum(y[x == v]), int((x == v).sum())) for v in at]
    mean = lambda a, b: sum(s for s, _ in sums[a : b + 1]) / sum(n for _, n in sums[a : b + 1])
    level = {v: max(min(mean(a, b) for b in range(k, len(at))) for a in range(k + 1)) for k, v in enumerate(at)}
    return [level[v] for v in x.tolist()]


def test_isotonic_equals_the_max_min_formula():
    rng = np.random.RandomState(3)
    for n in (1, 2, 7, 40):
        x = rng.normal(size=n)
        y = (rng.rand(n) < 1 / (1 + np.exp(-2 * x))).astype(float)
        centres, means = toxicity.isotonic(x, y)
        want = plain_isotonic(x, y)
        assert sorted(set(np.round(want, 12))) == sorted(set(np.round(means, 12)))
        for v, m in zip(x, want, strict=True):
            assert means[np.abs(means - m).argmin()] == np.float64(m) or abs(means - m).min() < 1e-12


def plain_tree(rows, g, h, cuts, depth):
    """The best cut of all, tried one by one."""
    if depth == 0:
        return sum(g[i] for i in rows) / (sum(h[i] for i in rows) + toxicity.RIDGE)
    best = (1e-6, None, None)
    score = lambda part: sum(g[i] for i in part) ** 2 / (sum(h[i] for i in part) + toxicity.RIDGE)
    for j, values in enumerate(cuts):
        for cut in values:
            low = [i for i in rows if X[i][j] <= cut]
            if len(rows) >= 2 * toxicity.LEAF_ROWS and toxicity.LEAF_ROWS <= len(low) <= len(rows) - toxicity.LEAF_ROWS:
                high = [i for i in rows if X[i][j] > cut]
                gain = score(low) + score(high) - score(rows)
                if gain > best[0]:
                    best = (gain, j, cut)
    _, j, cut = best
    if j is None:
        return plain_tree(rows, g, h, cuts, 0)
    return (j, cut, plain_tree([i for i in rows if X[i][j] <= cut], g, h, cuts, depth - 1), plain_tree([i for i in rows if X[i][j] > cut], g, h, cuts, depth - 1))


X = np.random.RandomState(9).normal(size=(60, 3))


def test_boosting_equals_plain_trees(monkeypatch):
    monkeypatch.setattr(toxicity, "TREES", 6)
    y = ((X[:, 0] + 0.5 * X[:, 1] ** 2 + 0.3 * np.random.RandomState(10).normal(size=60)) > 0.4).astype(float)
    trees = toxicity.Trees(X, y)
    f = [math.log(y.mean() / (1 - y.mean()))] * 60
    for _ in range(6):
        p = [1 / (1 + math.exp(-v)) for v in f]
        tree = plain_tree(list(range(60)), [a - b for a, b in zip(y, p, strict=True)], [a * (1 - a) for a in p], [c.tolist() for c in trees.cuts], toxicity.DEPTH)
        for i in range(60):
            at = tree
            while isinstance(at, tuple):
                at = at[2] if X[i][at[0]] <= at[1] else at[3]
            f[i] += toxicity.RATE * at
    assert np.allclose(trees.margin(X), f)
