"""The given tables as cell tables, shapes and series, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GRID, LEVEL = 32, 5

CELLS = f"""cells as (
  select x, y, z, {LEVEL} as level, case when ml = 7 then 1 else 0 end as state,
    case when (x // 2 + y // 2 + z // 2) % 3 = 0 then -1 when (x // 2 + y // 2 + z // 2) % 3 = 1 and n >= 3 then 1 else 0 end as flag, mass, n
  from (select cast(l_partkey % {GRID} as integer) as x, cast(l_suppkey % {GRID} as integer) as y, cast(l_orderkey % {GRID} as integer) as z,
          min(l_linenumber) as ml, cast(sum(l_quantity) as bigint) as mass, count(*) as n from lineitem group by 1, 2, 3))"""
#: Parts as primitives placed by their keys; sizes follow p_size.
SHAPES = """shapes as (
  select p_partkey as id, 'p' || p_partkey as name, case p_size % 3 when 0 then 'sphere' when 1 then 'box' else 'cylinder' end as kind,
    1 + cast(p_partkey % 7 as integer) as material_id, (1 + p_size % 4) * 0.75 as radius, 1.0 + p_size % 5 as height, 1.0 + p_size % 3 as width, 2.0 + p_size % 4 as length,
    1.0 as scale, p_partkey % 97 + 0.25 as tx, p_partkey % 89 - 0.5 as ty, p_partkey % 83 + 0.0 as tz from part)"""


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as cells of a 32-grid at level 5; counts and sums combine before the shuffle."""
    axis = lambda key: (F.col(key) % GRID).cast("int")
    grouped = read(spark, sf_dir, "lineitem").groupBy(axis("l_partkey").alias("x"), axis("l_suppkey").alias("y"), axis("l_orderkey").alias("z"))
    got = grouped.agg(F.min("l_linenumber").alias("ml"), F.sum("l_quantity").cast("long").alias("mass"), F.count("*").alias("n"))
    turn = (F.shiftright("x", 1) + F.shiftright("y", 1) + F.shiftright("z", 1)) % 3
    return got.select(
        "x", "y", "z", F.lit(LEVEL).alias("level"), F.when(F.col("ml") == 7, 1).otherwise(0).alias("state"),
        F.when(turn == 0, -1).when((turn == 1) & (F.col("n") >= 3), 1).otherwise(0).alias("flag"), "mass", "n",
    )


#: A grid that follows the data: the least power of two, from 32 on, whose cube is four times the number of line items.
SIDES = [32 << k for k in range(12)]
WIDE = f"""side as (select coalesce(min(s), {SIDES[-1]}) as s from (values {", ".join(f"({s}::bigint)" for s in SIDES)}) v(s) where s * s * s >= 4 * (select count(*) from lineitem)),
  cells as materialized (
  select x, y, z, {LEVEL} as level, case when ml = 7 then 1 else 0 end as state,
    case when (x // 2 + y // 2 + z // 2) % 3 = 0 then -1 when (x // 2 + y // 2 + z // 2) % 3 = 1 and n >= 2 then 1 else 0 end as flag, mass, n
  from (select cast(l_partkey * 7919 % s as integer) as x, cast((l_suppkey * 104729 + l_linenumber) % s as integer) as y, cast(l_orderkey * 31 % s as integer) as z,
          min(l_linenumber) as ml, cast(sum(l_quantity) as bigint) as mass, count(*) as n from lineitem, side group by 1, 2, 3))"""


def wide_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as cells of a grid whose side grows with their number: the count of cells follows the table."""
    lines = read(spark, sf_dir, "lineitem")
    least = 4 * lines.count()
    side = next((s for s in SIDES if s**3 >= least), SIDES[-1])
    x, y, z = F.col("l_partkey") * 7919 % side, (F.col("l_suppkey") * 104729 + F.col("l_linenumber")) % side, F.col("l_orderkey") * 31 % side
    grouped = lines.groupBy(x.cast("int").alias("x"), y.cast("int").alias("y"), z.cast("int").alias("z"))
    got = grouped.agg(F.min("l_linenumber").alias("ml"), F.sum("l_quantity").cast("long").alias("mass"), F.count("*").alias("n"))
    turn = (F.shiftright("x", 1) + F.shiftright("y", 1) + F.shiftright("z", 1)) % 3
    return got.select(
        "x", "y", "z", F.lit(LEVEL).alias("level"), F.when(F.col("ml") == 7, 1).otherwise(0).alias("state"),
        F.when(turn == 0, -1).when((turn == 1) & (F.col("n") >= 2), 1).otherwise(0).alias("flag"), "mass", "n",
    )


def shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, size = F.col("p_partkey"), F.col("p_size")
    kind = F.when(size % 3 == 0, "sphere").when(size % 3 == 1, "box").otherwise("cylinder")
    return read(spark, sf_dir, "part").select(
        key.alias("id"), F.concat(F.lit("p"), key.cast("string")).alias("name"), kind.alias("kind"), (1 + (key % 7).cast("int")).alias("material_id"),
        ((1 + size % 4) * 0.75).alias("radius"), (1.0 + size % 5).alias("height"), (1.0 + size % 3).alias("width"), (2.0 + size % 4).alias("length"),
        F.lit(1.0).alias("scale"), (key % 97 + 0.25).alias("tx"), (key % 89 - 0.5).alias("ty"), (key % 83 + 0.0).alias("tz"),
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events")
