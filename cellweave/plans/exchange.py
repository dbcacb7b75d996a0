"""Further registered queries: halo exchange between levels, moving rows, lattices, profiles, tables that are written and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from cellweave.functions import curves, lattices, profiles, schema
from cellweave.operators import geometry, halo, mesh, partition, series
from cellweave.operators.session import shared_folder
from cellweave.plans import tables
from cellweave.plans.catalog import ADAPTED, CELLS, FACE_SQL, FIELDS, KEY, MOVED, RANKS, morton_sql, query, reranked, vorticity, with_cells
from cellweave.plans.tables import SHAPES
from cellweave.sources import meshes, sinks
from cellweave.streaming import journal, steps

SHARE = 8**curves.FINEST // RANKS
ANCHOR = morton_sql("(x << (8 - level))", "(y << (8 - level))", "(z << (8 - level))")
OWNED = f"owned as (select *, cast({ANCHOR} // {SHARE} as integer) as rank from adapted)"
GHOSTS = f"g as (select distinct rank as to_rank, x + dx as gx, y + dy as gy, z + dz as gz, level from owned, {FACE_SQL})"
HALO = f"""{OWNED}, {GHOSTS}, halo as (
  select g.*, 'copy' as kind, o.rank as from_rank, cast(o.mass as double) as value from g join owned o on o.level = g.level and o.x = gx and o.y = gy and o.z = gz where o.rank <> to_rank
  union all select g.*, 'interpolate', o.rank, (select sum(b.mass) / 8.0 from owned b where b.level = o.level and b.x - o.x in (0, 1) and b.y - o.y in (0, 1) and b.z - o.z in (0, 1))
    from g join owned o on o.level = g.level - 1 and o.x = gx >> 1 and o.y = gy >> 1 and o.z = gz >> 1 where o.rank <> to_rank
  union all select g.*, 'average', f.rank, f.value from g join (select x >> 1 as px, y >> 1 as py, z >> 1 as pz, level - 1 as level, arg_min(rank, (x & 1) + 2 * (y & 1) + 4 * (z & 1)) as rank, avg(mass) as value
    from owned group by 1, 2, 3, 4 having count(*) = 8) f on f.level = g.level and px = gx and py = gy and pz = gz where f.rank <> to_rank)"""


def owned(spark, d):
    """The adapted mesh; ranks own equal shares of the key range of anchors."""
    cells = mesh.adapt(tables.cells(spark, d), FIELDS)
    return cells.withColumn("rank", F.floor(curves.morton(*[curves.anchor(c) for c in "xyz"]) / SHARE).cast("int"))


@query(f"with {CELLS}, {ADAPTED}, {HALO} select to_rank, gx, gy, gz, level, kind, from_rank, round(value, 6) as value from halo")
def halo_mixed(spark, d):
    return halo.exchanged(owned(spark, d), "rank", "mass").withColumn("value", F.round("value", 6))


@query(f"""with {CELLS}, {ADAPTED}, {HALO} select o.x, o.y, o.z, o.level, count(h.value) as n, round(coalesce(sum(h.value), 0), 6) as total from (select * from owned, {FACE_SQL}) o
  left join halo h on h.to_rank = o.rank and h.level = o.level and gx = o.x + dx and gy = o.y + dy and gz = o.z + dz group by 1, 2, 3, 4""")
def halo_joined(spark, d):
    cells = owned(spark, d)
    got = halo.joined_back(cells, halo.exchanged(cells, "rank", "mass"), "rank")
    values = F.coalesce(F.map_values("halo"), F.array().cast("array<double>"))
    return got.select("x", "y", "z", "level", F.size(values).cast("long").alias("n"), F.round(F.aggregate(values, F.lit(0.0), lambda a, v: a + v), 6).alias("total"))


@query(f"""with {CELLS}, {ADAPTED}, {HALO}, k as (select *, {morton_sql("(gx << (8 - level))", "(gy << (8 - level))", "(gz << (8 - level))")} as key from halo),
  r as (select to_rank, from_rank, level, kind, min(key) as start_key, max(key) + 1 as end_key, count(*) as n from k group by 1, 2, 3, 4)
  select to_rank, from_rank, level, kind, n, start_key, end_key from r qualify row_number() over (partition by start_key, end_key, to_rank order by from_rank, level, kind, n) = 1""")
def ghost_ranges(spark, d):
    return halo.ranges(halo.exchanged(owned(spark, d), "rank", "mass"))


@query(f"with {CELLS}, m as (select x, y, z, mass, {KEY} as key, cast({KEY} // {8**tables.LEVEL // RANKS} as integer) as old, cast(ntile({RANKS}) over (order by {KEY}) - 1 as integer) as rank from cells) select *, old <> rank as moved from m")
def migrate_rows(spark, d):
    """The cells, dealt to their new ranks."""
    rows = partition.moved_to(reranked(spark, d), "rank", RANKS)
    return rows.select("x", "y", "z", "mass", "key", "old", "rank", (F.col("old") != F.col("rank")).alias("moved"))


@query(f"""with {CELLS}, {MOVED}, t as (select source, destination, min(key) as first_key, max(key) + 1 as end_key, count(*) as n from moved where source <> destination group by 1, 2)
  select cast(coalesce(sum(n), 0) as bigint) as n, count(*) as transfers, round(coalesce(sum(n), 0) * 0.001::double, 6) as milliseconds, true as valid from t""")
def plan_totals(spark, d):
    rows = reranked(spark, d)
    total = rows.where("old <> rank").count()
    return partition.plan_totals(partition.migration(rows, "old", "rank"), total).withColumn("milliseconds", F.round("milliseconds", 6))


@query("""with recursive h as (select event_id % 200 as step, user_id % 4 as rank, count(*) as n from events group by 1, 2),
  e as (select step, (max(n) - min(n)) / avg(n) as imbalance, row_number() over (order by step) as i from h group by step),
  r as (select i, step, imbalance, 1 as since, false as due from e where i = 1
    union all select e.i, e.step, e.imbalance, case when r.due then 1 else r.since + 1 end, case when r.due then 1 else r.since + 1 end >= 3 and e.imbalance > 0.25 from r join e on e.i = r.i + 1)
  select step, round(imbalance, 6) as imbalance, since, due from r""")
def rebalance_steps(spark, d):
    """Which steps of a history call for a rebalance, at least three apart."""
    history = tables.events(spark, d).groupBy((F.col("event_id") % 200).alias("step"), (F.col("user_id") % 4).alias("rank")).agg(F.count("*").alias("n"))
    return partition.rebalances(history, tolerance=0.25, interval=3).withColumn("imbalance", F.round("imbalance", 6))


@query(f"""with {CELLS}, m as (select x // 2 as x, y // 2 as y, z // 2 as z, avg(mass) as q from cells where flag = -1 and state = 0 group by 1, 2, 3 having count(*) = 8),
  a as (select 512 * mass as q from cells c where not (flag = -1 and state = 0 and exists (select 1 from m where m.x = c.x // 2 and m.y = c.y // 2 and m.z = c.z // 2)) union all select 4096 * q from m)
  select round((select sum(512 * mass) from cells), 3) as before, round((select sum(q) from a), 3) as after, true as holds""")
def conservation(spark, d):
    """A field's integral over an adaptation; averages keep it."""
    cells = tables.cells(spark, d).withColumn("q", F.col("mass").cast("double"))
    got = mesh.conserved(cells, mesh.adapt(cells, FIELDS | {"q": "arithmetic"}), "q")
    return got.select(F.col("before").cast("long").alias("before"), F.round("after", 3).alias("after"), "holds")


@query(with_cells(f"""select round(sum(curl * curl), 3) as enstrophy, count(*) as n from (select round(sum((dx - dy) * b.mass) / 2.0, 6) as curl from cells a, {FACE_SQL}
  join cells b on b.x = a.x + dx and b.y = a.y + dy and b.z = a.z + dz where dz = 0 group by a.x, a.y, a.z having count(*) = 4)"""))
def enstrophy(spark, d):
    """The integral of the squared curl."""
    return vorticity(spark, d).agg(F.round(F.sum(F.col("curl") * F.col("curl")), 3).alias("enstrophy"), F.count("*").alias("n"))


@query(with_cells(f"""select x, y, z, x >> level as rx, ({KEY} >= 100 and {KEY} < 20000) as inside, (x >> 1 = (x + 1) >> 1) as with_next, (mass & ~12) | ((n << 2) & 12) as inserted, (((x & 7) << 1) | ((x & 7) >> 2)) & 7 as turned from cells"""))
def curve_ranges(spark, d):
    """Root cells, half-open key ranges, siblings, and bits put in and turned."""
    own, after = {c: F.col(c) for c in ("x", "y", "z", "level")}, {"x": F.col("x") + 1, "y": F.col("y"), "z": F.col("z"), "level": F.col("level")}
    return tables.cells(spark, d).select(
        "x", "y", "z", curves.root("x").alias("rx"), curves.in_range(curves.morton(), F.lit(100), F.lit(20000)).alias("inside"), curves.siblings(own, after).alias("with_next"),
        curves.inserted("mass", "n", 2, 2).alias("inserted"), curves.rotated3(F.col("x").bitwiseAND(F.lit(7)), 1).alias("turned"),
    )


LATTICES = """v as (select l_returnflag as name, cast(l_quantity as integer) % 3 - 1 as cx, l_linenumber % 3 - 1 as cy, cast(l_suppkey % 2 as integer) as cz, count(*) as n from lineitem group by all),
  t as (select *, sum(n) over (partition by name) as total, row_number() over (partition by name order by cx, cy, cz) - 1 as i from v)"""


def directions(spark, d):
    """A lattice for each return flag; weights are fractions as text."""
    got = tables.read(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("name"), (F.col("l_quantity").cast("int") % 3 - 1).alias("cx"), (F.col("l_linenumber") % 3 - 1).alias("cy"), (F.col("l_suppkey") % 2).cast("int").alias("cz")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("name")  # 18 directions at most
    text = F.concat_ws("/", F.col("n").cast("string"), F.sum("n").over(w).cast("string"))
    return got.select("name", (F.row_number().over(w.orderBy("cx", "cy", "cz")) - 1).alias("i"), "cx", "cy", "cz", lattices.number(text).alias("w"))


@query(f"""with {LATTICES} select a.name, a.i, a.cx, a.cy, a.cz, round(a.n / a.total, 9) as w, b.i as opposite from t a left join t b on a.name = b.name and b.cx = -a.cx and b.cy = -a.cy and b.cz = -a.cz""")
def lattice_opposites(spark, d):
    return lattices.opposites(directions(spark, d)).select("name", "i", "cx", "cy", "cz", F.round("w", 9).alias("w"), "opposite")


@query(f"with {LATTICES} select name, count(*) as n, round(sum(n / total), 6) as total, abs(sum(n / total) - 1) <= 1e-6 as valid from t group by name")
def lattice_checks(spark, d):
    return lattices.checked(directions(spark, d)).withColumn("total", F.round("total", 6))


CAVITY = ", ".join(f"({c}::double, {v}::double)" for c, v in profiles.CAVITY["u"])


@query(f"""with k(t, v) as (values {CAVITY}), p as (select event_id, value, least(greatest(value / 100, 0), 1) as t from events), iv as (select t as lo, lead(t) over (order by t) as hi, v as v0, lead(v) over (order by t) as v1 from k)
  select event_id, round(case when p.t >= 1 then 1.0 else v0 + (p.t - lo) / (hi - lo) * (v1 - v0) end, 6) as u from p left join iv on p.t >= lo and p.t < hi""")
def cavity_profile(spark, d):
    """The published profile of the cavity flow at each event's place."""
    points = tables.events(spark, d).select("event_id", F.lit("u").alias("component"), F.least(F.greatest(F.col("value") / 100, F.lit(0.0)), F.lit(1.0)).alias("coord"))
    return series.bracketed(points, profiles.cavity(spark), ["component"], "coord", "value").select("event_id", F.round("value", 6).alias("u"))


@query("select event_id, round(exp(-4 * (2.0 * (row_number() over (order by event_id) - 1) / greatest((select count(*) from events) - 1, 1)) / 50), 9) as energy from events")
def energy_decay(spark, d):
    """The decaying vortex's energy at as many times as there are events."""
    own = mesh.numbered(tables.events(spark, d).select("event_id"), ["event_id"], "i")
    return own.join(profiles.energy_series(spark, 50.0, 2.0, own.count()), "i").select("event_id", F.round("energy", 9).alias("energy"))


@query(f"""with {SHAPES}, s as (select id, case when id % 11 = 0 then '' else name end as name, case when id % 17 = 0 then 0 else material_id end as material_id, scale, kind, case when id % 5 = 0 then 0 else radius end as radius from shapes)
  select id, case when name = '' then 'no name' when material_id <= 0 then 'no material' else 'no radius' end as reason from s where name = '' or material_id <= 0 or (kind = 'sphere' and radius <= 0)""")
def shape_rejects(spark, d):
    """Shapes that are not valid, with the reason."""
    key = F.col("id")
    odd = tables.shapes(spark, d).withColumns({"name": F.when(key % 11 == 0, "").otherwise(F.col("name")), "material_id": F.when(key % 17 == 0, 0).otherwise(F.col("material_id")), "radius": F.when(key % 5 == 0, 0.0).otherwise(F.col("radius"))})
    return geometry.rejected(odd).select("id", "reason")


# --- written and read back ---


def fresh(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query(with_cells("select * from cells"))
def reference_table(spark, d):
    """A table written with its count and checksum, and read with both tested."""
    folder = fresh(spark, "reference")
    sinks.write_reference(tables.cells(spark, d), folder)
    return meshes.read_reference(spark, folder)


@query(with_cells("select count(*) as n, cast(sum(mass) as bigint) as mass from cells"))
def vtp_points(spark, d):
    """Points and a field's sum, from the piece files of a written mesh."""
    folder = fresh(spark, "vtp")
    sinks.write_vtp(tables.cells(spark, d), folder, 1, ["mass"])
    named = spark.read.text(folder, wholetext=True, pathGlobFilter="*.pvtp").select(F.explode(F.regexp_extract_all("value", F.lit('Source="([^"]*)"'))).alias("file"))
    text = spark.read.text(folder, lineSep="</Piece>", pathGlobFilter="*.vtp").withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1))
    piece = text.join(named, "file").where(F.col("value").contains("<Piece"))
    field = F.split(F.trim(F.regexp_extract("value", r'Name="mass"[^>]*>([^<]*)<', 1)), r"\s+")
    mass = F.aggregate(field, F.lit(0.0), lambda a, v: a + v.cast("double"))
    return piece.agg(F.sum(F.regexp_extract("value", r'NumberOfPoints="(\d+)"', 1).cast("long")).alias("n"), F.sum(mass).cast("long").alias("mass"))


@query(with_cells("select x, y, z, level, state, flag, mass + 6 as mass, n from cells"))
def time_loop(spark, d):
    """Three steps of a kernel that adds the step's number."""
    kernel = lambda cells, t: schema.kernel(cells, {"mass": F.col("mass") + t})
    return steps.time_loop(tables.cells(spark, d), 3, [kernel], checkpoint_every=2)


@query(f"""with {CELLS.replace("cells as", "raw as")}, cells as (select * replace (mass + 1 as mass) from raw), {ADAPTED} select x, y, z, level, state, flag, mass + 2 as mass, n from adapted""")
def resumed_steps(spark, d):
    """Two steps of a loop with a journal, in two runs: the second one goes on after the first one's step."""
    kernel = lambda cells, t: schema.kernel(cells, {"mass": F.col("mass") + t})
    record = journal.Journal(spark, fresh(spark, "journal"))
    once = lambda cells, t: mesh.adapt(kernel(cells, t), FIELDS) if t == 1 else kernel(cells, t)
    steps.resumed_loop(record, tables.cells(spark, d), 1, [once])
    return steps.resumed_loop(record, tables.cells(spark, d), 2, [once])


@query(f"""with {CELLS.replace("cells as", "raw as")}, cells as (select * replace (case when mass >= 60 then 1 else flag end as flag) from raw), {ADAPTED} select * from adapted""")
def stream_adapt(spark, d):
    """A mesh that follows a stream of flags: one micro-batch, written as a table and read back."""
    cells, folder = tables.cells(spark, d), fresh(spark, "stream")
    flags = cells.where("mass >= 60").select(*mesh.CELL, F.lit(1).alias("flag"), F.lit(0).cast("timestamp").alias("ts"))
    flags.write.parquet(f"{folder}/flags")
    source = spark.readStream.schema(flags.schema).parquet(f"{folder}/flags")
    steps.adapt_by_stream(source, cells, f"{folder}/mesh", FIELDS).awaitTermination()
    return spark.read.parquet(f"{folder}/mesh/mesh-0")
