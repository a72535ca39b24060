"""Quality rules: hashed n-gram log-likelihood ratio of a trusted target against the raw corpus.

Two multinomials over the same hashed unigrams and bigrams are counted: one over all trusted
documents, one over all documents. A document's score is the mean, over its n-grams,
of the log ratio of their smoothed probabilities; the verdict compares it with a fixed threshold,
so each document is judged alone and the same way every time. Base rules on length and repetition
come first.

Only DataFrame functions are used. The number of buckets grows with the square root of the corpus, as
its vocabulary does, so n-grams to a bucket stay about as many (``buckets_for``). Counting explodes
bucket numbers and adds them up before the shuffle, so it moves at most one row a bucket and task; the
log ratios go into the scoring plan as one literal, 8 bytes a bucket.

Defined results: null and empty texts have no words and fail the base rule; a document without
n-grams has score 0; repeated rows are judged alike; long texts are counted whole; without trusted
rows every ratio is 0 and the base rule alone decides.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hash buckets of the multinomials, at least, and how many to the square root of the corpus' n-grams.
BUCKETS, TO_ROOT = 8192, 2
#: Bytes of text to an n-gram (two a word).
NGRAM_BYTES = 3
#: Most trusted ids that are broadcast (8 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Pseudo-count of every bucket, in both multinomials.
SMOOTH = 1.0
#: A document is kept if the mean log ratio of its n-grams reaches this.
THRESHOLD = -0.25
#: Base rules: fewest words, and most words in repeated windows in percent.
LEAST_WORDS, MOST_REPEATED = 10, 20
WINDOW = 5

# What separates words, and the signs counted as symbols.
SPACES = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "#*$%&|<>"


def words_of(text: Column) -> Column:
    """Words of a text as an array; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def buckets_for(docs: DataFrame, text: str = "text") -> int:
    """Buckets for a corpus: a power of two."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).cast("long").alias("n")).first()["n"]
    return max(BUCKETS, 1 << (math.ceil(TO_ROOT * math.sqrt(size / NGRAM_BYTES)) - 1).bit_length() if size else 0)


def with_buckets(df: DataFrame, text: str, name: str, buckets: int = BUCKETS) -> DataFrame:
    """``df`` with the hashed unigrams and bigrams of each text: an array of bucket numbers.

    Tokens are words, with runs of two signs and more apart from the letters before them. Tokens,
    unigrams and bigrams are columns of their own, so that each is worked out once a row.
    """
    apart = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "([\\p{L}\\p{N}])([^\\p{L}\\p{N}\\s]{2,})", "$1 $2")
    d = df.withColumn("_tokens", F.array_remove(F.split(apart, SPACES), ""))
    d = d.withColumn("_one", F.transform("_tokens", lambda w: F.pmod(F.xxhash64(w), F.lit(buckets)).cast("int"))).drop("_tokens")
    # hashes of neighbours are combined from the unigram hashes
    n = F.size("_one")
    two = F.zip_with(F.slice("_one", 1, n - 1), F.slice("_one", 2, n - 1), lambda a, b: F.pmod(F.xxhash64(a, b), F.lit(buckets)).cast("int"))
    return d.withColumn(name, F.when(n > 1, F.concat("_one", two)).otherwise(F.col("_one"))).drop("_one")


def base(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text.

    Windows are told apart by 64-bit hashes. The steps are columns of their own, so that none is
    worked out twice.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.btrim(x, F.lit(" \t\n\x0b\x0c\r"))) > 0)
    d = docs.withColumns({"_words": words_of(F.col(text)), "_lines": lines})
    w = F.col("_words")
    d = d.withColumns({
        "n_words": F.size(w).cast("long"),
        "word_chars": F.length(F.array_join(w, "")).cast("long"),
        "n_symbols": (F.length(t) - F.length(F.regexp_replace(t, f"[{SYMBOLS}]", ""))).cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "_hashes": F.transform(w, lambda x: F.xxhash64(x)),
    })
    h = F.col("_hashes")
    none = F.array().cast("array<bigint>")
    spread = F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)]))
    d = d.withColumn("_windows", F.when(F.size(h) > WINDOW, spread).otherwise(none))
    twice = F.size(F.array_distinct("_windows")) < F.size("_windows")
    # positions by hash, only where some window is found twice
    paired = F.sort_array(F.transform(F.col("_windows"), lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    d = d.withColumn("_paired", F.when(twice, paired))
    p = F.col("_paired")
    same = lambda j, k: F.coalesce(F.get(p, j)["h"] == F.get(p, k)["h"], F.lit(False))
    found = F.filter(F.sequence(F.lit(0), F.size(p) - 1), lambda j: same(j, j - 1) | same(j, j + 1))
    places = F.transform(found, lambda j: F.get(p, j)["i"])
    d = d.withColumn("_places", F.when(p.isNotNull(), F.sort_array(places)).otherwise(F.array().cast("array<int>")))
    q = F.col("_places")
    # each window adds the words that the one before does not reach
    gained = F.transform(F.sequence(F.lit(1), F.size(q) - 1), lambda j: F.least(F.get(q, j) - F.get(q, j - 1), F.lit(WINDOW)))
    total = F.when(F.size(q) == 0, 0).when(F.size(q) == 1, WINDOW).otherwise(WINDOW + F.aggregate(gained, F.lit(0), lambda a, x: a + x))
    d = d.withColumn("n_repeat_words", total.cast("long"))
    return d.drop("_words", "_lines", "_hashes", "_windows", "_paired", "_places")


def log_ratios(docs: DataFrame, trusted: DataFrame, text: str = "text", key: str = "doc_id") -> list[float]:
    """Log ratio of target to raw probability for every bucket.

    ``trusted`` holds the ids of the target's documents, each once.
    Counts are added up before and after the shuffle; at most one row a bucket comes back.
    """
    buckets = buckets_for(docs, text)
    ids = trusted.select(F.col(key).alias("_key"), F.lit(1).alias("_target"))
    few = ids.count() <= BROADCAST_IDS
    marked = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).join(F.broadcast(ids) if few else ids, "_key", "left")
    # the outer form keeps the optimizer from adding a filter that works the buckets out once more
    each = with_buckets(marked, "_text", "_buckets", buckets).select(F.explode_outer("_buckets").alias("bucket"), F.coalesce("_target", F.lit(0)).alias("target"))
    counts = each.groupBy("bucket").agg(F.sum("target").alias("target"), F.count("*").alias("raw"))
    rows = counts.where("bucket IS NOT NULL").collect()
    n_target, n_raw = sum(r["target"] for r in rows), sum(r["raw"] for r in rows)
    out = [0.0] * buckets
    if n_target:
        shift = math.log(n_raw + SMOOTH * buckets) - math.log(n_target + SMOOTH * buckets)
        out = [shift] * buckets
        for r in rows:
            out[r["bucket"]] = math.log(r["target"] + SMOOTH) - math.log(r["raw"] + SMOOTH) + shift
    return out


def trusted_ids(labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """Ids of the documents labelled good, each once."""
    return labels.where((F.col("quality") == 1) & F.col(key).isNotNull()).select(key).distinct()


def judge(docs: DataFrame, ratios: list[float], text: str = "text") -> DataFrame:
    """``docs`` with the base figures, base_failed, llr (the score) and kept; same-named columns are replaced."""
    made = {"n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "llr", "kept"}
    d = base(docs.drop(*[c for c in docs.columns if c.lower() in made and c != text]), text)
    weights = F.from_json(F.lit(json.dumps(ratios)), "array<double>")
    d = with_buckets(d, text, "_buckets", len(ratios))
    b = F.col("_buckets")
    total = F.aggregate(b, F.lit(0.0), lambda a, x: a + F.get(weights, x))
    d = d.withColumn("llr", F.when(F.size(b) > 0, total / F.size(b)).otherwise(0.0)).drop("_buckets")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return d.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= THRESHOLD))


def keep(docs: DataFrame, ratios: list[float], text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept, with their own columns.

    The filter also reads a row number, which is not deterministic: else the optimizer would move it
    below the columns that it is made of and write each of their expressions out wherever it is used.
    """
    judged = judge(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(text).alias("_text")), ratios, "_text")
    return judged.withColumn("_number", F.monotonically_increasing_id()).where(F.col("kept") & (F.col("_number") >= 0)).select("_row.*")


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row a document: base figures and verdict."""
    d = docs.select("doc_id", "text")
    judged = judge(d, log_ratios(d, trusted_ids(labels)))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr")
