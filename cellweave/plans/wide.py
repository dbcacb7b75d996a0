"""Registered queries over a grid that grows with the data, and over ranges of its keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellweave.functions import curves, schema
from cellweave.operators import geometry, halo, mesh, partition
from cellweave.operators.partition_bounds import weight_splits
from cellweave.operators.session import checkpointed
from cellweave.plans import catalog, exchange, tables
from cellweave.plans.catalog import ADAPTED, CELLS, FACE_SQL, FIELDS, cycle_sql, morton_sql, query
from cellweave.plans.tables import WIDE
from cellweave.sources import clustered

BITS = 17
KEY = morton_sql(bits=BITS)
ANCHOR = morton_sql("(x << (8 - level))", "(y << (8 - level))", "(z << (8 - level))", bits=20)
RANKS = 16


def anchor_key():
    return curves.morton(*[curves.anchor(c) for c in "xyz"], bits=20)


@query(f"with {WIDE}, {ADAPTED} select * from adapted")
def wide_adapt(spark, d):
    return mesh.adapt(tables.wide_cells(spark, d), FIELDS)


@query(f"with {WIDE}, {ADAPTED} select x, y, z, level, row_number() over (order by {ANCHOR}, level) - 1 as number from adapted")
def wide_rank(spark, d):
    """The place of every cell along the curve."""
    ordered = mesh.adapt(tables.wide_cells(spark, d), FIELDS).withColumn("key", anchor_key())
    return mesh.numbered(ordered, ["key", "level"]).select("x", "y", "z", "level", "number")


@query(f"""with {WIDE}, {ADAPTED}, m as materialized (select * from adapted),
  p as (select x, y, z, level, case when dx = -1 then 0 when dx = 1 then 1 when dy = -1 then 2 when dy = 1 then 3 when dz = -1 then 4 else 5 end as face,
    case dx when -1 then (x << (8 - level)) - 1 when 1 then (x + 1) << (8 - level) else x << (8 - level) end as px, case dy when -1 then (y << (8 - level)) - 1 when 1 then (y + 1) << (8 - level) else y << (8 - level) end as py,
    case dz when -1 then (z << (8 - level)) - 1 when 1 then (z + 1) << (8 - level) else z << (8 - level) end as pz from m, {FACE_SQL}),
  q as materialized (select p.x, p.y, p.z, p.level, face, l.level as n_level, px >> (8 - l.level) as nx, py >> (8 - l.level) as ny, pz >> (8 - l.level) as nz from p, (values (4), (5), (6)) l(level))
  select q.x, q.y, q.z, q.level, face, n_level from q join m on m.level = n_level and m.x = nx and m.y = ny and m.z = nz""")
def wide_neighbors(spark, d):
    return mesh.mixed_neighbours(mesh.adapt(tables.wide_cells(spark, d), FIELDS))


@query(f"""with {WIDE}, {cycle_sql("cells", "once", 3)} select * from once""")
def wide_balanced(spark, d):
    """A balanced cycle."""
    return mesh.adapt(tables.wide_cells(spark, d), FIELDS, balanced=True)


WEIGHED = f"""k as (select {KEY} as key, mass from cells), c as (select key, mass, coalesce(sum(mass) over (order by key rows between unbounded preceding and 1 preceding), 0) as before, sum(mass) over () as total from k),
  r as (select cast(before * {RANKS} // total as integer) as rank, key, mass from c)"""


@query(f"with {WIDE}, {WEIGHED} select rank, min(key) as first_key, max(key) as last_key, count(*) as n, cast(sum(mass) as bigint) as mass from r group by rank")
def wide_splits(spark, d):
    """Ranks of equal mass: splits from the table's own keys, owners looked up."""
    keyed = checkpointed(tables.wide_cells(spark, d).select(curves.morton(bits=BITS).alias("key"), "mass"))
    owned = keyed.withColumn("rank", partition.owner_of_splits("key", weight_splits(keyed, "key", "mass", RANKS)))
    return owned.groupBy("rank").agg(F.min("key").alias("first_key"), F.max("key").alias("last_key"), F.count("*").alias("n"), F.sum("mass").alias("mass"))


@query(catalog.SQL["shape_voxels"])
def shape_cells(spark, d):
    """Shapes placed by descent from coarse cells, and the grid cells that these hold."""
    return geometry.finest(geometry.placed(tables.shapes(spark, d), domain=(-10.0, 90.0)))


VOXELS = catalog.SQL["shape_voxels"]


@query(VOXELS[: VOXELS.rindex("select i as x")] + "select id, count(*) as voxels from l " + VOXELS[VOXELS.rindex("where case kind") :].replace("group by 1, 2, 3", "group by id"))
def shape_volumes(spark, d):
    """The voxels of each shape, added up over its cells of all levels."""
    cells = geometry.descended(tables.shapes(spark, d), domain=(-10.0, 90.0), keep=["id"])
    return cells.groupBy("id").agg(F.sum(F.call_function("shiftleft", F.lit(1).cast("long"), 3 * F.col("up"))).alias("voxels"))


DEEP = f"""{exchange.OWNED}, {exchange.GHOSTS.replace("x + dx as gx, y + dy as gy, z + dz as gz", "x + k * dx as gx, y + k * dy as gy, z + k * dz as gz").replace(FACE_SQL, FACE_SQL + ", (values (1), (2)) depth(k)")}"""


@query(f"with {CELLS}, {ADAPTED}, {exchange.HALO.replace(f'{exchange.OWNED}, {exchange.GHOSTS}', DEEP)} select to_rank, gx, gy, gz, level, kind, from_rank, round(value, 6) as value from halo")
def halo_deep(spark, d):
    """The halo of a field that is declared two cells deep."""
    fields = schema.Fields()
    fields.add(schema.Field("mass", "long", halo=2, rule="volume_weighted"))
    fields.add(schema.Field("n", "long", rule="volume_weighted"))
    cells = checkpointed(exchange.owned(spark, d))
    return halo.exchanged_fields(cells, "rank", fields).drop("field").withColumn("value", F.round("value", 6))


@query(f"with {WIDE}, k as (select *, {morton_sql('(x << 3)', '(y << 3)', '(z << 3)', bits=20)} as curve_key from cells) select * from k where curve_key >= {8**6} and curve_key < {8**7}")
def clustered_range(spark, d):
    """A range of keys of a mesh that is stored in curve order: only the files that hold it are read."""
    folder = exchange.fresh(spark, "clustered")
    clustered.write_clustered(tables.wide_cells(spark, d), folder, 32)
    return clustered.read_clustered(spark, folder, 8**6, 8**7)
