"""Cell tables stored in curve order: files hold ranges of keys, and a list of their bounds says which ones a range needs.

Writing deals the rows by key range and sorts them; the bounds of each file come from what was written. Reading a key range,
or a box of cells, opens the files whose bounds meet it and no others, and the filter on keys goes down to row groups.

Defined cases: null keys cannot be (coordinates are not null); an empty table has no files, and every range of it is empty; a
table that has a column of the key's name already is an error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.functions import curves

KEY = "curve_key"
BITS = 21


def anchor_key():
    return curves.morton(*[curves.anchor(c) for c in "xyz"], bits=BITS)


def write_clustered(cells: DataFrame, path: str, files: int | None = None) -> None:
    """cells with the Z-order keys of their anchors as ``curve_key`` below ``path``, in ``files`` files or as many as a shuffle has
    partitions; and the bounds of the files."""
    if KEY in cells.columns:
        raise ValueError(f"there is a column named {KEY}")
    n = files or int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = cells.withColumn(KEY, anchor_key())
    keyed.repartitionByRange(n, KEY).sortWithinPartitions(KEY, "level").write.parquet(f"{path}/cells")
    written = cells.sparkSession.read.schema(keyed.schema).parquet(f"{path}/cells")
    bounds = written.groupBy(F.col("_metadata.file_name").alias("file")).agg(F.min(KEY).alias("first_key"), F.max(KEY).alias("last_key"), F.count("*").alias("n"))
    bounds.coalesce(1).write.parquet(f"{path}/bounds")  # a row a file


def read_clustered(spark: SparkSession, path: str, first: int | None = None, end: int | None = None) -> DataFrame:
    """The cells whose keys are in a half-open range, or all."""
    table = spark.read.parquet(f"{path}/cells")
    if first is None and end is None:
        return table
    meets, inside = F.lit(True), F.lit(True)
    if first is not None:
        meets, inside = meets & (F.col("last_key") >= first), inside & (F.col(KEY) >= first)
    if end is not None:
        meets, inside = meets & (F.col("first_key") < end), inside & (F.col(KEY) < end)
    names = [r["file"] for r in spark.read.parquet(f"{path}/bounds").where(meets).select("file").collect()]
    if not names:
        return table.limit(0)
    return spark.read.schema(table.schema).parquet(*[f"{path}/cells/{n}" for n in sorted(names)]).where(inside)


def read_cell(spark: SparkSession, path: str, x: int, y: int, z: int, level: int) -> DataFrame:
    """The stored cells that lie within a cell: its keys are one range."""
    size = curves.FINEST - level
    first = 0
    for k, c in enumerate((x, y, z)):
        first |= sum(((c << size) >> b & 1) << (3 * b + k) for b in range(BITS))
    return read_clustered(spark, path, first, first + 8**size)
