"""The pipeline against a plain version of each stage."""

import math
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from kvloom.llm import labelled, packing, quality, quality_rules, secrets
from kvloom.llm.common import table
from tests.conftest import SF
from tests.llm.fixtures import docs, empty
from tests.llm.test_pairs import brute_force


def test_stages_one_by_one(spark):
    pytest.importorskip("public_tokenizers")
    from kvloom.llm.queries import tokenizer

    start = table(spark, SF, "documents")
    labels = table(spark, SF, "labels")
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "quality classifier", "n-gram Jaccard join", "secret scans", "packing"]
    ids = lambda d: sorted(r["doc_id"] for r in d.select("doc_id").collect())

    one = stages["quality rules"](spark, start, SF).cache()
    judged = quality_rules.digest(start, labels).collect()
    assert ids(one) == sorted(r["doc_id"] for r in judged if r["kept"]) and one.columns == start.columns
    good = {r["doc_id"] for r in labels.where("quality = 1").collect()}
    failed = {r["doc_id"] for r in judged if r["base_failed"]}
    assert len(good - failed - set(ids(one))) <= 0.02 * len(good)

    two = stages["quality classifier"](spark, one, SF).cache()
    scored = quality.score(one, quality.fit(one, labels)).collect()
    assert ids(two) == sorted(r["doc_id"] for r in scored if r["quality_score"] >= 0.5) and two.columns == start.columns

    three = stages["n-gram Jaccard join"](spark, two, SF).cache()
    groups = brute_force([(r["doc_id"], r["text"]) for r in two.collect()])
    assert ids(three) == sorted({g for g in groups.values()}) and three.columns == start.columns

    four = stages["secret scans"](spark, three, SF).cache()
    before = {r["doc_id"]: r for r in three.collect()}
    for r in four.collect():
        text = before[r["doc_id"]]["text"]
        assert r["text"] == secrets.redact(text, secrets.spans(text), "[SECRET]") and r["n_chars"] == len(r["text"])
    assert four.columns == start.columns and four.schema["n_chars"].dataType == start.schema["n_chars"].dataType

    five = stages["packing"](spark, four, SF)
    bpe = packing.ByteBpe(tokenizer("byte_bpe_50k.json"))
    want = sum(len(bpe.ids(r["text"])) + 1 for r in four.collect())
    rows = five.collect()
    assert sum(r["length"] for r in rows) == want
    run = corpus_pipeline.run(spark, SF).collect()
    key = lambda rows: sorted((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in rows)
    assert key(run) == key(rows)


def test_stages_on_awkward_rows(spark):
    pytest.importorskip("public_tokenizers")
    for rows in (docs(spark), empty(spark)):
        d = rows
        for _, stage in corpus_pipeline.STAGES[:-1]:
            d = stage(spark, d, SF)
            assert d.columns == rows.columns
        last = corpus_pipeline.STAGES[-1][1](spark, d, SF)
        assert last.count() >= d.count()


def test_repeated_ids_count_once(spark):
    d = docs(spark).where("doc_id IN (6, 7, 9)")
    out = corpus_pipeline.one_of_each(spark, d, SF)
    assert sorted(r["doc_id"] for r in out.collect()) == [6, 9]
    assert corpus_pipeline.one_of_each(spark, docs(spark).where("doc_id = 7"), SF).count() == 1


def test_rows_with_repeated_or_no_ids_go_only_as_near_copies(spark):
    a, b, c = ("one two three four five six seven eight nine ten eleven " + x for x in ("alpha", "beta gamma delta epsilon zeta eta", "some other words that follow here"))
    rows = [(5, a), (5, b), (3, a), (None, c), (None, c), (8, c), (None, "alone"), (None, "alone too"), (4, None), (4, "")]
    out = corpus_pipeline.one_of_each(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in out), key=str) == sorted([(5, b), (3, a), (8, c), (None, "alone"), (None, "alone too"), (4, None), (4, "")], key=str)


def test_classifier_learns_from_documents_that_the_rules_dropped(spark):
    start, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    good, bad = (labels.where(f"quality = {q}").select("doc_id") for q in (1, 0))
    unseen = bad.where(labelled.held_out(F.col("doc_id"), quality.MODULUS, quality.KEPT_BACK))
    # none of the bad documents that come to this stage may be learned from
    came = start.join(good.unionByName(unseen), "doc_id", "left_semi").select(*start.columns).cache()
    kept = corpus_pipeline.by_classifier(spark, came, SF).cache()
    assert unseen.count() > 0 and kept.join(bad, "doc_id", "left_semi").count() == 0 and kept.count() == good.count()


def test_classifier_learns_from_long_documents_within_the_drivers_limit(spark, tmp_path):
    rng = random.Random(3)
    words = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "ne", "ru") for b in ("ba", "de", "fi", "go") for c in range(300)]
    rows = [(i, " ".join(rng.choices(words, k=20_000)), i % 2) for i in range(60)]
    texts = [(i, ("Good. " if q else "### $$ ") * 3000 + t) for i, t, q in rows]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    conf, key = spark.sparkContext._jsc.sc().conf(), "spark.driver.maxResultSize"
    before = conf.get(key, "1g")
    # the features of the rows learned from take more, the weights 2 MB
    conf.set(key, "4m")
    try:
        kept = corpus_pipeline.by_classifier(spark, table(spark, str(tmp_path), "documents"), str(tmp_path)).select("doc_id").collect()
    finally:
        conf.set(key, before)
    assert sorted(r["doc_id"] for r in kept) == [i for i, _, q in rows if q]


def test_long_documents_of_one_row_group_are_read_few_at_a_time(spark, tmp_path):
    pa, pq = pytest.importorskip("pyarrow"), pytest.importorskip("pyarrow.parquet")
    # 2.2 GB of text: more than the reader can hold of one batch
    ten = pa.array(["word " * 200_000] * 10)
    text = pa.chunked_array([ten] * 220)
    pq.write_table(pa.table({"text": text}), f"{tmp_path}/documents.parquet", row_group_size=len(text), use_dictionary=False, write_statistics=False, write_batch_size=10, compression="zstd")
    assert pq.ParquetFile(f"{tmp_path}/documents.parquet").num_row_groups == 1
    size = 2200 * 1_000_000
    assert quality_rules.buckets_for(table(spark, str(tmp_path), "documents")) == 1 << math.ceil(math.log2(2 * math.sqrt(size / 3)))
