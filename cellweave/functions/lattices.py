"""Lattices as tables: (name, i, cx, cy, cz, w), a row a direction; readers, checks and opposite directions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.functions.curves import col

AXES = ["cx", "cy", "cz"]
TOLERANCE = 1e-6


def number(text: Column | str) -> Column:
    """A number or a fraction ("1/3") as a double; null for anything else."""
    parts = F.split(F.trim(col(text)), r"\s*/\s*")
    one = lambda k: F.get(parts, F.lit(k)).try_cast("double")
    return F.when(F.size(parts) == 1, one(0)).when((F.size(parts) == 2) & (one(1) != 0), one(0) / one(1))


def read_lattices(spark: SparkSession, path: str) -> DataFrame:
    """Lattices from JSON lines: {"name", "stencil": [[0, 0, 0], ...], "weights": ["1/3", 0.1, ...]}. Vectors and weights that do
    not pair up have nulls."""
    raw = spark.read.schema("name string, stencil array<array<int>>, weights array<string>").json(path)
    each = raw.select("name", F.posexplode(F.arrays_zip("stencil", "weights")).alias("i", "v"))
    return each.select("name", "i", *[F.get("v.stencil", F.lit(k)).alias(c) for k, c in enumerate(AXES)], number("v.weights").alias("w"))


def opposites(lattice: DataFrame) -> DataFrame:
    """Directions with ``opposite``: the least number of the direction the other way; null where there is none."""
    other = lattice.groupBy("name", *[(-F.col(c)).alias(c) for c in AXES]).agg(F.min("i").alias("opposite"))
    return lattice.join(other, ["name", *AXES], "left")


def checked(lattice: DataFrame) -> DataFrame:
    """Of each lattice: its directions, the sum of its weights, and whether it is valid (no gaps, and a sum of one)."""
    whole = F.every(F.col("w").isNotNull() & F.col("cx").isNotNull() & F.col("cy").isNotNull() & F.col("cz").isNotNull())
    got = lattice.groupBy("name").agg(F.count("*").alias("n"), F.sum("w").alias("total"), whole.alias("whole"))
    return got.select("name", "n", "total", F.coalesce(F.col("whole") & (F.abs(F.col("total") - 1) <= TOLERANCE), F.lit(False)).alias("valid"))


def constants(rows: DataFrame) -> DataFrame:
    """(name, value as text) as (name, value); a name that comes twice is an error."""
    twice = [r["name"] for r in rows.groupBy("name").count().where("count > 1").limit(5).collect()]
    if twice:
        raise ValueError(f"declared twice: {', '.join(sorted(twice))}")
    return rows.select("name", number("value").alias("value"))
