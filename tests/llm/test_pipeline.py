"""The pipeline over the small tables, each stage against a plain account of what it should do."""

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cellweave.llm import pii, quality, sentencepiece_scan
from tests.llm.test_decontaminate import brute
from tests.llm.test_simhash import groups, words_of

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    steps = dict(corpus_pipeline.STAGES)
    before = {r["doc_id"]: r["text"] for r in docs.collect()}

    good = steps[names[0]](spark, docs, DATA).cache()
    assert good.columns == columns
    feats = quality.features(docs)
    said = quality.scored(feats, quality.fitted(feats, spark.read.parquet(f"{DATA}/labels.parquet"))).where("predicted = 1")
    assert {r["doc_id"] for r in good.collect()} == {r["doc_id"] for r in said.collect()}

    single = steps[names[1]](spark, good, DATA).cache()
    assert single.columns == columns
    rows = sorted((r["doc_id"], r["text"]) for r in good.collect())
    sets = [set(" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if (w := words_of(t)) else set() for _, t in rows]
    label = groups(len(rows), lambda i, j: len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]))
    stay = {rows[i][0] for i in range(len(rows)) if label[i] == i}
    kept = {r["doc_id"] for r in single.collect()}
    assert stay <= kept and len(kept - stay) <= 0.05 * max(1, len(rows) - len(stay)) + 1

    clean = steps[names[2]](spark, single, DATA).cache()
    items = [r["text"] for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    left = {i for i, n in brute([(r["doc_id"], r["text"]) for r in single.collect()], items) if n == 0}
    assert clean.columns == columns and {r["doc_id"] for r in clean.collect()} == left

    private = steps[names[3]](spark, clean, DATA).cache()
    assert private.columns == columns and private.count() == clean.count()
    real = {e for t in before.values() for _, _, _, e in pii.found(t)}
    for r in private.collect():
        assert not real & {e for _, _, _, e in pii.found(r["text"])} and r["n_chars"] == len(r["text"])
        assert pii.found(before[r["doc_id"]]) or r["text"] == before[r["doc_id"]]

    ids = steps[names[4]](spark, private, DATA)
    assert ids.where("not exact").count() == 0
    back = sentencepiece_scan.decoded(ids).join(private.select("doc_id", F.col("text").alias("was")), "doc_id")
    assert back.count() == private.count() == back.where("text = was").count()
