"""The pipeline's stages over odd rows: nulls, repeated rows, columns with clashing names, and an empty table."""

import os

import pytest

import corpus_pipeline

DATA = "/root/testdata/sf0.001"
NAMES = ["ids", "n", "h", "key", "label", "id", "score", "predicted", "item", "entity"]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
@pytest.mark.parametrize("full", [True, False])
def test_stages_over_odd_rows(spark, full):
    """Each stage returns all columns of its input and, of an empty table, no rows; the last one a row for each document."""
    good = spark.read.parquet(f"{DATA}/documents.parquet").where("n_chars > 2000").limit(3).collect()
    rows = [(None, None, None, None, None), (9_000_001, "", "en", "s", 0), (9_000_002, None, "en", None, None), (None, good[1]["text"], "en", "s", 5)]
    rows += [tuple(r) for r in (*good, good[0])]
    rows = [(*r, *(f"{c}-{i}" for c in NAMES)) for i, r in enumerate(rows)] if full else []
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in NAMES))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, DATA)
        assert got.columns == docs.columns, name
        kept = {r["id"]: r for r in docs.collect()}
        left = got.collect()
        assert len(left) <= len(kept) and all(tuple(r)[5:] == tuple(kept[r["id"]])[5:] for r in left), name
        docs = spark.createDataFrame(left, docs.schema)
    ids = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert ids.count() == docs.count() and ids.where("not exact").count() == 0
    assert (docs.count() > 0) == full
