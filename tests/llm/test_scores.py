"""Quality rules, quality classifier and toxicity."""

import random
import re
import zlib

import numpy as np
import pytest

from kvloom.llm import labelled, quality, quality_rules, toxicity
from tests.llm.fixtures import ROWS, docs, empty, labels

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base_model(text):
    w = WORD.findall(text or "")
    windows = {}
    for i in range(len(w) - 4):
        windows.setdefault(tuple(w[i : i + 5]), []).append(i)
    covered = {k for at in windows.values() if len(at) > 1 for i in at for k in range(i, i + 5)}
    seen, repeated = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            repeated += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), repeated, len(covered)


def test_base_figures_equal_brute_force(spark):
    rng = random.Random(11)
    bits = ["a", "b", "é", "##", "x|y", "<p>", "\x1c", " ", "日本"]
    gaps = [" ", "  ", "\n", "\t", "\r\n", "\x0b", "\n\n", " "]
    texts = ["".join(rng.choice(bits[: rng.choice([2, 3, 9])]) + rng.choice(gaps) for _ in range(rng.choice([0, 1, 4, 5, 6, 12, 60]))) for _ in range(400)]
    texts += [None, "", "\n", "a a a a a", "a a a a a a", "one\none\n one\none"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in quality_rules.digest(df, labels(spark)).collect():
        want = base_model(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want, texts[r["doc_id"]]
        assert r["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r["base_failed"] and r["kept"])


def corpus(n=300):
    """Good prose and three kinds of junk, with labels."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 7))) for _ in range(400)]
    rows, marks = [], []
    for i in range(n):
        w = [rng.choice(words) for _ in range(rng.randrange(30, 90))]
        kind = i % 6
        if kind == 0:
            text = " ".join(x + rng.choice(["***", "$$$", "%%%"]) for x in w)
        elif kind == 1:
            text = " ".join(x.upper() + "!!" for x in w)
        else:
            text = " ".join(w).capitalize() + "."
        toxic = kind in (2, 3) and i % 4 == 0
        if toxic:
            text = text.replace(" ", " you idiot scum ", 2).replace(" ", " moron ", 1)
        rows.append((i, text))
        marks.append((i, int(kind > 1), int(toxic)))
    return rows, marks


def frames(spark, n=300):
    rows, marks = corpus(n)
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")


def test_ratio_equals_brute_force(spark):
    d, l = frames(spark, 60)
    ratios = quality_rules.log_ratios(d, quality_rules.trusted_ids(l))
    rows = quality_rules.with_buckets(d, "text", "b").collect()
    good = {r["doc_id"] for r in l.where("quality = 1").collect()}
    target, raw = np.ones(quality_rules.BUCKETS), np.ones(quality_rules.BUCKETS)
    for r in rows:
        np.add.at(raw, r["b"], 1)
        if r["doc_id"] in good:
            np.add.at(target, r["b"], 1)
    want = np.log(target / target.sum()) - np.log(raw / raw.sum())
    assert np.allclose(ratios, want)
    judged = {r["doc_id"]: r for r in quality_rules.judge(d, ratios).collect()}
    for r in rows:
        assert np.isclose(judged[r["doc_id"]]["llr"], want[r["b"]].mean())
        n = len(WORD.findall(re.sub(r"([^\W_])([^\w\s]{2,})", r"\1 \2", r["text"])))
        assert len(r["b"]) == 2 * n - 1


def test_every_trusted_document_counts(spark, monkeypatch):
    many = labels(spark, 40_000)
    assert quality_rules.trusted_ids(many).count() == many.where("quality = 1").count() > 20_000
    d = spark.range(40_000).selectExpr("id AS doc_id", "concat('word', id % 50, ' and more') AS text")
    ratios = quality_rules.log_ratios(d, quality_rules.trusted_ids(many))
    rows = quality_rules.with_buckets(d, "text", "b").collect()
    target, raw = np.ones(quality_rules.BUCKETS), np.ones(quality_rules.BUCKETS)
    np.add.at(raw, np.concatenate([r["b"] for r in rows]), 1)
    np.add.at(target, np.concatenate([r["b"] for r in rows if r["doc_id"] % 3]), 1)
    assert np.allclose(ratios, np.log(target / target.sum()) - np.log(raw / raw.sum()))
    monkeypatch.setattr(quality_rules, "BROADCAST_IDS", 0)
    assert quality_rules.log_ratios(d, quality_rules.trusted_ids(many)) == ratios


def test_buckets_grow_with_the_corpus(spark, monkeypatch):
    d, l = frames(spark, 60)
    monkeypatch.setattr(quality_rules, "BUCKETS", 64)
    few = quality_rules.log_ratios(d.where("doc_id < 6"), quality_rules.trusted_ids(l))
    many = quality_rules.log_ratios(d, quality_rules.trusted_ids(l))
    assert 64 <= len(few) < len(many) and quality_rules.buckets_for(d.limit(0)) == 64
    rows = quality_rules.with_buckets(d, "text", "b", len(many)).collect()
    judged = {r["doc_id"]: r["llr"] for r in quality_rules.judge(d, many).collect()}
    assert all(np.isclose(judged[r["doc_id"]], np.array(many)[r["b"]].mean()) for r in rows)


def test_rules_filter_above_what_they_work_out(spark):
    """The optimizer neither moves the filter below the columns it is made of nor writes them out again."""
    kept = quality_rules.keep(docs(spark), [0.0] * 4)
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") <= 2 and plan.index("Filter") < plan.index("monotonically_increasing_id")


def test_rules_keep_good_and_drop_junk(spark):
    d, l = frames(spark)
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.digest(d, l).collect()}
    good = {i for i, q, _ in corpus()[1] if q}
    assert sum(kept[i] for i in good) >= 0.97 * len(good)
    assert sum(kept[i] for i in kept if i not in good) <= 0.05 * len(kept)


def test_rules_are_native(spark):
    d, l = frames(spark, 30)
    plan = quality_rules.digest(d, l)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_rules_edge_cases(spark):
    out = quality_rules.digest(docs(spark), labels(spark)).collect()
    assert len(out) == len(ROWS)
    by = {r["doc_id"]: r for r in out}
    assert all(by[i]["base_failed"] and not by[i]["kept"] for i in (1, 2, 3, 4)) and by[1]["llr"] == 0
    assert quality_rules.digest(empty(spark), labels(spark)).count() == 0
    none = quality_rules.digest(docs(spark), labels(spark).limit(0)).collect()
    assert all(r["llr"] == 0 and r["kept"] != r["base_failed"] for r in none)
    kept = quality_rules.keep(docs(spark), [0.0] * quality_rules.BUCKETS)
    assert kept.columns == docs(spark).columns and kept.where("doc_id < 5").count() == 0


def test_held_out_marks(spark):
    from pyspark.sql import functions as F

    rows = spark.range(200).select("id", labelled.held_out(F.col("id"), 3, 1).alias("q"), labelled.held_out(F.col("id"), 4, 2).alias("t")).collect()
    assert all(r["q"] == (zlib.crc32(str(r["id"]).encode()) % 3 == 1) and r["t"] == (zlib.crc32(str(r["id"]).encode()) % 4 == 2) for r in rows)
    assert not spark.sql("SELECT CAST(NULL AS BIGINT) AS id").select(labelled.held_out(F.col("id"), 3, 1)).first()[0]


@pytest.mark.parametrize("module,column", [(quality, "quality"), (toxicity, "toxic")])
def test_held_out_accuracy(spark, module, column):
    d, l = frames(spark, 600)
    mark = {i: (q if column == "quality" else t) for i, q, t in corpus(600)[1]}
    out = module.digest(d, l).collect()
    held = [r for r in out if r["held_out"]]
    assert len(out) == 600 and 100 < len(held) < 260
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= module.THRESHOLD) for r in out)
    assert sum(r["predicted"] == mark[r["doc_id"]] for r in held) >= 0.95 * len(held)


@pytest.mark.parametrize("module", [quality, toxicity])
def test_held_out_labels_are_never_learned(spark, module):
    d, l = frames(spark)
    from pyspark.sql import functions as F

    back = labelled.held_out(F.col("doc_id"), module.MODULUS, module.KEPT_BACK)
    turned = l.withColumns({c: F.when(back, 1 - F.col(c)).otherwise(F.col(c)) for c in ("quality", "toxic")})
    score = lambda x: {r["doc_id"]: r["score"] for r in module.digest(d, x).collect()}
    assert score(l) == score(turned)


@pytest.mark.parametrize("module", [quality, toxicity])
def test_score_edge_cases(spark, module):
    _, l = frames(spark)
    out = module.digest(docs(spark), labels(spark)).collect()
    assert len(out) == len(ROWS) and all(r["score"] is not None and r["predicted"] in (0, 1) for r in out)
    by = {}
    for r in out:
        by.setdefault(r["doc_id"], set()).add(r["score"])
    assert len(by[7]) == 1 and by[1] == by[2] == by[3]
    assert module.digest(empty(spark), l).count() == 0
    assert module.digest(docs(spark), l.limit(0)).count() == len(ROWS)


def test_training_sample_is_bounded_and_fixed(spark):
    d, l = frames(spark)
    ids = lambda parts: sorted(r["doc_id"] for r in labelled.sample(d.repartition(parts), l.repartition(parts), "quality", 3, 1, 40).collect())
    assert ids(1) == ids(5) and len(ids(1)) == 40


def test_repeated_ids_do_not_multiply_the_sample(spark):
    d, l = frames(spark, 60)
    many = d.unionByName(d).unionByName(d.selectExpr("doc_id", "concat(text, ' more') AS text"))
    rows = labelled.sample(many, l, "quality", 3, 1, 20).collect()
    assert len({r["doc_id"] for r in rows}) == len(rows) == 20
    text = dict(corpus(60)[0])
    assert all(r["text"] == min(text[r["doc_id"]], text[r["doc_id"]] + " more") for r in rows)


def test_isotonic_and_trees():
    rng = np.random.RandomState(1)
    x = rng.normal(size=(400, 3)).astype(np.float32)
    y = ((x[:, 0] > 0.3) | (x[:, 1] < -1)).astype(float)
    t = toxicity.Trees(x, y)
    assert ((t.margin(x) > 0) == (y > 0)).mean() > 0.97
    centres, means = toxicity.isotonic(t.margin(x), y)
    assert (np.diff(means) > 0).all() and (np.diff(centres) > 0).all()
    s = toxicity.Model({}, [np.pad(x, ((0, 0), (0, len(toxicity.FEATURES) - 3)))] * (toxicity.FOLDS + 1), y, np.arange(400) % toxicity.FOLDS)
    assert ((s.score(np.pad(x, ((0, 0), (0, len(toxicity.FEATURES) - 3)))) > 0.5) == (y > 0)).mean() > 0.97


def test_disguised_words():
    assert toxicity.undo("1d1ot!") in ("idioti", "idiot") and toxicity.undo("m0r0n") == "moron"
    dense = toxicity.Dense({})
    names = dict(zip(toxicity.FEATURES, dense.of("you are a m0r0n and an idiot"), strict=True))
    assert names["fixed_count"] == 1 and names["undone_count"] == 1 and names["near"] > 0
    assert dense.of("a clean line of words").tolist() == pytest.approx(dense.of("a clean line of words").tolist())
