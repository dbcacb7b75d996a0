"""A corpus pipeline: quality filter, near-duplicate removal, benchmark decontamination, surrogates, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.llm import common, decontaminate, near_copies, pii, quality, sentencepiece_scan

#: The stages together are checked against operator tests and a brute-force run; SQL has no way to say them.
ORACLE_SQL = None


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on labelled ones that are not held out, predicts to be good."""
    model = quality.fitted(quality.features(docs), common.table(spark, sf_dir, "labels"))
    return quality.accepted(docs, model)


def near_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return near_copies.representatives(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages."""
    return decontaminate.clean_documents(docs, common.table(spark, sf_dir, "benchmark"))


def surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced, in place."""
    new = pii.pseudonymised(docs, key=pii.key_of(spark))
    return new.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else new


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces, ids, and whether decoding gives back the text."""
    return sentencepiece_scan.encoded(docs)


STAGES = [
    ("quality classifier", quality_filter),
    ("simhash near-dedup", near_deduplication),
    ("benchmark decontamination", decontamination),
    ("pii surrogates", surrogates),
    ("sentencepiece encoding", encoding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = common.materialised(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
