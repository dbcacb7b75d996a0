"""Readers: triangle meshes (STL), benchmark JSON, two-column profiles, generated grids and keys, reference tables."""

from __future__ import annotations

import json
import struct

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellweave.sources import mesh_files

CORNERS = mesh_files.CORNERS
TRIANGLE = T.StructType([T.StructField("file", T.StringType()), T.StructField("number", T.LongType()), *[T.StructField(n, T.DoubleType()) for n in ("nx", "ny", "nz", *CORNERS)]])
RECORD = mesh_files.RECORD


def is_binary(body: bytes) -> bool:
    """A file is binary when its size is what its count says; text files also may have 84 bytes or more."""
    return len(body) >= 84 and len(body) == 84 + 50 * struct.unpack_from("<I", body, 80)[0]


def triangles_of(body: bytes) -> np.ndarray:
    """Normal and corners of each triangle, twelve numbers a row."""
    if is_binary(body):
        return np.frombuffer(body, RECORD, offset=84)["v"].astype(float)
    words = body.decode("ascii", "replace").split()
    if not words or words[0].lower() != "solid":
        raise ValueError("neither a binary nor a text STL file")
    rows, now = [], []
    for at, word in enumerate(words):
        if word == "normal" or word == "vertex":
            now += map(float, words[at + 1 : at + 4])
        elif word == "endfacet":
            if len(now) != 12:
                raise ValueError("a facet without a normal and three corners")
            rows.append(now)
            now = []
    return np.array(rows, float).reshape(-1, 12)


def read_stl(spark: SparkSession, path: str | list[str], **options) -> DataFrame:
    """Every triangle of the STL files at a path, text or binary: file, number, normal and corners. Large files are dealt to many
    tasks (options ``records`` and ``bytes``). Facets of a text file are numbered by the counts of its parts before, one row a
    part."""
    spark.dataSource.register(mesh_files.StlSource)
    source = spark.read.format(mesh_files.StlSource.name()).options(**options)
    paths = [path] if isinstance(path, str) else list(path)
    rows = source.option("paths", json.dumps(paths)).load()
    pieces = mesh_files.StlReader({"paths": json.dumps(paths), **{k: str(v) for k, v in options.items()}}).partitions()
    if not any(not p.binary and p.part for p in pieces):
        return rows.select(TRIANGLE.names)
    texts = {p.file for p in pieces if not p.binary and p.part}
    split = F.col("file").isin(sorted(texts)) if len(texts) <= 1000 else F.lit(True)
    before = Window.partitionBy("file").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    last = rows.where(split).groupBy("file", "part").agg(F.max("number").alias("last"), F.count("*").alias("n"))
    base = last.where("last < n").withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).select("file", "part", "base")
    return rows.join(base, ["file", "part"], "left").withColumn("number", F.col("number") + F.coalesce("base", F.lit(0))).select(TRIANGLE.names)


def read_benchmarks(spark: SparkSession, path: str) -> DataFrame:
    """(test, metric, value) from benchmark reports: {"benchmarks": [{"name", numbers...}]} or {"tests": {name: {numbers}}}."""
    numbers = T.MapType(T.StringType(), T.StringType())
    shape = T.StructType([T.StructField("benchmarks", T.ArrayType(numbers)), T.StructField("tests", T.MapType(T.StringType(), numbers))])
    raw = spark.read.schema(shape).json(path, multiLine=True)
    listed = raw.select(F.explode("benchmarks").alias("b")).select(F.col("b")["name"].alias("test"), F.explode("b").alias("metric", "value"))
    named = raw.select(F.explode("tests").alias("test", "b")).select("test", F.explode("b").alias("metric", "value"))
    return listed.unionByName(named).withColumn("value", F.expr("try_cast(value as double)")).where("value is not null")


def read_profile(spark: SparkSession, path: str) -> DataFrame:
    """(coord, value) of a two-column file with # comments."""
    text = spark.read.text(path).where(~F.trim("value").startswith("#") & (F.trim("value") != ""))
    parts = F.split(F.trim("value"), r"[\s,;]+")
    return text.select(F.get(parts, F.lit(0)).cast("double").alias("coord"), F.get(parts, F.lit(1)).cast("double").alias("value"))


def base_grid(spark: SparkSession, n: int = 8, level: int = 0) -> DataFrame:
    """n cells a side, x fastest; the cells in the middle are flagged."""
    at = spark.range(n**3).select((F.col("id") % n).cast("int").alias("x"), (F.floor(F.col("id") / n) % n).cast("int").alias("y"), F.floor(F.col("id") / (n * n)).cast("int").alias("z"))
    middle = F.lit(True)
    for c in "xyz":
        middle &= F.col(c).between((n - 1) // 2, n // 2)
    return at.select("x", "y", "z", F.lit(level).alias("level"), F.lit(0).alias("state"), middle.cast("int").alias("flag"), F.lit(0).alias("material_id"))


def analytical_grid(spark: SparkSession, shape: tuple[int, int, int], value) -> DataFrame:
    """value(x, y, z), a function of Columns in [0, 1), on a grid with x fastest."""
    nx, ny, nz = shape
    at = spark.range(nx * ny * nz).select("id", (F.col("id") % nx / nx).alias("x"), (F.floor(F.col("id") / nx) % ny / ny).alias("y"), (F.floor(F.col("id") / (nx * ny)) / nz).alias("z"))
    return at.select("id", "x", "y", "z", value(F.col("x"), F.col("y"), F.col("z")).cast("float").alias("value"))


def hashed_keys(spark: SparkSession, n: int, bits: int = 24, seed: int = 42) -> DataFrame:
    """Keys that look random and are the same on every run."""
    return spark.range(n).select(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << bits)).alias("key"))


def read_reference(spark: SparkSession, path: str) -> DataFrame:
    """A reference table that ``sinks.write_reference`` wrote; its count and checksum must hold."""
    table, want = spark.read.parquet(f"{path}/table"), spark.read.json(f"{path}/check").first()
    got = checksum(table).first()
    if (got["n"], got["sum"]) != (want["n"], want["sum"]):
        raise ValueError(f"{path}: {got['n']} rows with sum {got['sum']}, not {want['n']} with {want['sum']}")
    return table


def checksum(table: DataFrame) -> DataFrame:
    each: Column = F.xxhash64(*sorted(table.columns)).cast("decimal(38,0)")
    return table.agg(F.count("*").alias("n"), F.coalesce(F.sum(each), F.lit(0)).cast("string").alias("sum"))
