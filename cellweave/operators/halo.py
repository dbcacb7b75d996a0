"""Halo exchange on adapted meshes: the values that a rank needs from others, between levels, and their join back.

A cell's ghost is the place of its own size beyond a face. It is another rank's cell (copied), lies in a coarser cell
(interpolated from the eight corners of that cell's block, an eighth each), or is filled by eight finer ones (averaged).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.functions import curves
from cellweave.functions.schema import Fields
from cellweave.operators import mesh

GHOST = ["gx", "gy", "gz", "level"]
#: What each of the eight corners counts.
WEIGHT = 0.125


def ghosts(cells: DataFrame, rank: str, depth: int = 1) -> DataFrame:
    """(to_rank, gx, gy, gz, level): the distinct places beyond the faces of each rank's cells, up to ``depth`` cells of their own
    size away."""
    steps = [F.struct(*[F.lit(side * k if a == axis else 0).alias(f"d{c}") for a, c in enumerate("xyz")]) for k in range(1, depth + 1) for axis, side in mesh.FACES]
    each = cells.select(F.col(rank).alias("to_rank"), *mesh.CELL, F.explode(F.array(*steps)).alias("f"))
    return each.select("to_rank", *[(F.col(c) + F.col(f"f.d{c}")).alias(f"g{c}") for c in "xyz"], "level").distinct()


def blocks(cells: DataFrame, field: str) -> DataFrame:
    """Of each cell: an eighth of the sum over the block of two cells a side that begins with it; missing ones count nothing."""
    corner = F.explode(F.sequence(F.lit(0), F.lit(7)))
    dealt = cells.select(*mesh.CELL, F.col(field).alias("v"), corner.alias("o"))
    sums = dealt.select(*[(F.col(c) - curves.bit("o", k)).cast("int").alias(c) for k, c in enumerate("xyz")], "level", "v").groupBy(*mesh.CELL)
    return sums.agg((F.sum("v") * WEIGHT).alias("value"))


def exchanged(cells: DataFrame, rank: str, field: str, depth: int = 1) -> DataFrame:
    """(to_rank, gx, gy, gz, level, kind, from_rank, value) of every ghost that another rank's cells fill. Three equi-joins, on
    the place itself, its parent's place, and as its children's parent. ``cells`` is read several times: give a stored table."""
    wanted = ghosts(cells, rank, depth)
    at = [F.col(c).alias(f"g{c}") for c in "xyz"]
    same = cells.select(*at, "level", F.col(rank).alias("from_rank"), F.col(field).cast("double").alias("value"))
    copied = wanted.join(same, GHOST).withColumn("kind", F.lit("copy"))

    owner = cells.select(*mesh.CELL, F.col(rank).alias("from_rank"))
    coarse = owner.join(blocks(cells, field), mesh.CELL).select(*[F.col(c).alias(f"p{c}") for c in "xyz"], (F.col("level") + 1).alias("level"), "from_rank", F.col("value").cast("double").alias("value"))
    up = wanted.withColumns({f"p{c}": curves.parent(f"g{c}") for c in "xyz"})
    interpolated = up.join(coarse, ["px", "py", "pz", "level"]).withColumn("kind", F.lit("interpolate"))

    fine = cells.groupBy(*[curves.parent(c).alias(f"g{c}") for c in "xyz"], (F.col("level") - 1).alias("level"))
    fine = fine.agg(F.count("*").alias("n"), F.min_by(rank, curves.child_number()).alias("from_rank"), F.avg(field).alias("value")).where("n = 8")
    averaged = wanted.join(fine, GHOST).withColumn("kind", F.lit("average"))

    columns = ["to_rank", *GHOST, "kind", "from_rank", "value"]
    return copied.select(columns).unionByName(interpolated.select(columns)).unionByName(averaged.select(columns)).where("to_rank <> from_rank")


def exchanged_fields(cells: DataFrame, rank: str, fields: Fields) -> DataFrame:
    """The same for all declared fields of one component, each to the depth that its declaration asks for (none: not at all), with
    the field's name in front."""
    asked = [f for f in fields.own.values() if f.halo and f.components == 1]
    parts = [exchanged(cells, rank, f.name, f.halo).select(F.lit(f.name).alias("field"), "*") for f in asked]
    if not parts:
        raise ValueError("no declared field of one component has a halo")
    return reduce(DataFrame.unionByName, parts)


def joined_back(cells: DataFrame, rows: DataFrame, rank: str) -> DataFrame:
    """Cells with ``halo``: the values that arrived for each of their faces, as a map from the face's number."""
    face = F.explode(F.array(*[F.struct(F.lit(i).alias("face"), *[F.lit(side if a == axis else 0).alias(f"d{c}") for a, c in enumerate("xyz")]) for i, (axis, side) in enumerate(mesh.FACES)]))
    each = cells.select(*mesh.CELL, F.col(rank).alias("to_rank"), face.alias("f")).select(*mesh.CELL, "to_rank", "f.face", *[(F.col(c) + F.col(f"f.d{c}")).alias(f"g{c}") for c in "xyz"])
    met = each.join(rows.select("to_rank", *GHOST, "value"), ["to_rank", *GHOST])
    got = met.groupBy(*mesh.CELL).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("face", "value")))).alias("halo"))  # six at most
    return cells.join(got, mesh.CELL, "left")


def ranges(rows: DataFrame) -> DataFrame:
    """Ghost ranges: of each pair of ranks, level and kind the half-open range of keys that holds its ghosts, with their number;
    ranges of the same keys and target are one."""
    key = curves.morton(*[curves.anchor(f"g{c}") for c in "xyz"])
    by = ["to_rank", "from_rank", "level", "kind"]
    found = rows.withColumn("key", key).groupBy(*by).agg(F.min("key").alias("start_key"), (F.max("key") + 1).alias("end_key"), F.count("*").alias("n"))
    return found.groupBy("start_key", "end_key", "to_rank").agg(F.min(F.struct("from_rank", "level", "kind", "n")).alias("x")).select("to_rank", "x.*", "start_key", "end_key")
