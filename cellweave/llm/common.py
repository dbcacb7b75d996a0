"""Helpers that the corpus operators share: the shared folder, cut lineage, plain byte streams, arrow batches."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; where it is unset (tests), an own one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return (base or spark.sparkContext.getCheckpointDir()).rstrip("/")


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared folder, as a URI."""
    base = shared_folder(spark)
    return f"{base if ':' in base else 'file://' + base}/{name}-{uuid.uuid4().hex}"


#: Rows of an arrow batch in queries that write a table: texts are long rows.
BATCH = 1000


@contextlib.contextmanager
def frugal(spark: SparkSession):
    """Within it, the shuffle files of a query go when the query ends, and not when the driver happens to collect garbage;
    and arrow batches are small."""
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    new = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", rows: str(min(BATCH, int(spark.conf.get(rows)) or BATCH))}
    before = {name: spark.conf.get(name) for name in new}
    for name, value in new.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def materialised(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read again: its lineage is cut, any executor can read it, and
    the shuffles that made it are given up."""
    out = fresh_folder(df.sparkSession, name)
    with frugal(df.sparkSession):
        df.write.parquet(out)
    return df.sparkSession.read.schema(df.schema).parquet(out)


def unused(name: str, *tables: DataFrame) -> str:
    """``name``, with more underscores until no table has a column called so (whatever its case)."""
    taken = {c.lower() for t in tables for c in t.columns}
    while name.lower() in taken:
        name += "_"
    return name


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI, and the path in it; tasks use it for files that are not tables."""
    system, path = fs.FileSystem.from_uri(uri)
    return system, path


def is_local(system: fs.FileSystem) -> bool:
    return isinstance(system, fs.LocalFileSystem) or "Local" in type(getattr(system, "base_fs", system)).__name__


def text_batches(batches, *columns):
    """Of each arrow batch: the columns as Python lists."""
    for batch in batches:
        yield tuple(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in columns)


def out_batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, schema, strict=True)], schema=schema)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


def even_partitions(df: DataFrame) -> int:
    """As many partitions as a shuffle makes by setting; AQE may join small ones afterwards."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def vocabulary_path(name: str) -> str:
    """Where a public tokenizer's file lies: the installed package, or a folder named by the environment."""
    folder = os.environ.get("TOKENIZER_DIR")
    if folder:
        return f"{folder}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)
