"""What operators need of a session."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; an own one only where it is unset."""
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(base or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return (base or context.getCheckpointDir()).rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut, in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


#: Types that a stored table cannot have.
NOT_STORED = re.compile(r"\b(void|interval)\b")


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder, read again: its lineage is cut as by ``checkpointed``, but the rows lie there in
    compressed columns, and the shuffles that made them go when they are written, not when the driver collects garbage.
    Columns that a table cannot have are checkpointed."""
    if any(NOT_STORED.search(t) for _, t in df.dtypes) or len({c.lower() for c in df.columns}) < len(df.columns):
        return checkpointed(df)
    spark, name = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    out, before = f"{shared_folder(spark)}/cells-{uuid.uuid4().hex}", spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        df.write.parquet(out)
    finally:
        spark.conf.set(name, before)
    return spark.read.schema(df.schema).parquet(out)


def unused(name: str, *tables: DataFrame) -> str:
    """``name``, with more underscores until no table has a column called so (whatever its case)."""
    taken = {c.lower() for t in tables for c in t.columns}
    while name.lower() in taken:
        name += "_"
    return name
