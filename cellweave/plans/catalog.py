"""Every registered query on cell tables and series, with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from cellweave.functions import curves, schema
from cellweave.operators import exact, geometry, locate, mesh, partition, series
from cellweave.operators.session import checkpointed
from cellweave.plans import tables
from cellweave.plans.tables import CELLS, GRID, LEVEL, SHAPES
from cellweave.sources import sinks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: How fields merge in the registered adaptation queries: sums stay whole numbers.
FIELDS = {"mass": "volume_weighted", "n": "volume_weighted"}
RANKS = 4


def query(sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def morton_sql(x="x", y="y", z="z", bits=curves.FINEST) -> str:
    return "(" + " + ".join(f"((cast({c} as bigint) >> {b}) & 1) * {1 << (3 * b + k)}" for b in range(bits) for k, c in enumerate((x, y, z))) + ")"


def with_cells(sql: str) -> str:
    return f"with {CELLS} {sql}"


KEY = morton_sql()
RANK = f"cast({KEY} // {8**LEVEL // RANKS} as integer)"


def ranked(cells: DataFrame) -> DataFrame:
    """Cells with their Z-order key and the rank that owns an equal share of the key range."""
    return cells.withColumn("key", curves.morton()).withColumn("rank", F.floor(F.col("key") / (8**LEVEL // RANKS)).cast("int"))


RANKED = f"ranked as (select *, {KEY} as key, {RANK} as rank from cells)"

# --- keys and coordinates ---


@query(with_cells("select * from cells"))
def base_cells(spark, d):
    return tables.cells(spark, d)


@query(with_cells(f"select x, y, z, {KEY} as key from cells"))
def morton_key(spark, d):
    return tables.cells(spark, d).select("x", "y", "z", curves.morton().alias("key"))


@query(with_cells(f"select {KEY} as key, x, y, z from cells"))
def morton_decode(spark, d):
    keyed = tables.cells(spark, d).select(curves.morton().alias("key"))
    return keyed.select("key", *[curves.morton_axis("key", k).alias(c) for k, c in enumerate("xyz")])


def hilbert_sql(bits: int = curves.FINEST) -> str:
    digit, after = curves.hilbert_table()
    o = "((x >> b) & 1) + 2 * ((y >> b) & 1) + 4 * ((z >> b) & 1)"
    at = f"cast((a % 32) * 8 + {o} + 1 as integer)"
    levels = ", ".join(f"{b}::bigint" for b in reversed(range(bits)))
    return f"list_reduce([0::bigint, {levels}], lambda a, b: ((a // 32) * 8 + {digit}[{at}]) * 32 + {after}[{at}]) // 32"


@query(with_cells(f"select x, y, z, {hilbert_sql()} as key from (select cast(x as bigint) as x, cast(y as bigint) as y, cast(z as bigint) as z from cells)"))
def curve_key(spark, d):
    return tables.cells(spark, d).select("x", "y", "z", curves.hilbert().alias("key"))


@query(with_cells("select x, y, z, x as x2, y as y2, z as z2 from cells"))
def curve_decode(spark, d):
    at = tables.cells(spark, d).select("x", "y", "z", curves.hilbert_cell(curves.hilbert()).alias("c"))
    return at.select("x", "y", "z", *[F.col(f"c.{c}").alias(f"{c}2") for c in "xyz"])


@query(with_cells(f"""select x, y, z, x - 40 >> 1 as px, 2 * (x - 40) + 1 as cx, (x & 1) + 2 * (y & 1) + 4 * (z & 1) as child, (x & 1) + (y & 1) + (z & 1) = 0 as is_first,
  {KEY} >> 3 as parent_key, ({KEY} << 3) + 5 as child_key from cells"""))
def parents_and_children(spark, d):
    key, low = curves.morton(), F.col("x") - 40
    return tables.cells(spark, d).select(
        "x", "y", "z", curves.parent(low).alias("px"), curves.child(low, F.lit(1), 0).alias("cx"), curves.child_number().alias("child"), curves.first_sibling().alias("is_first"),
        curves.parent_key(key).alias("parent_key"), curves.child_key(key, F.lit(5)).alias("child_key"),
    )


@query(with_cells(f"""select x, y, z, {KEY} >> 15 = 0 as at_five, {KEY} >> 12 = 0 as at_four, mass between 0 and 8 as mass_as_level, abs(n * 1000000) < 2097152 as inside from cells"""))
def valid_cells(spark, d):
    key = curves.morton()
    return tables.cells(spark, d).select(
        "x", "y", "z", curves.valid_key(key, F.lit(5)).alias("at_five"), curves.valid_key(key, F.lit(4)).alias("at_four"),
        curves.valid_cell(level="mass").alias("mass_as_level"), curves.valid_cell(x=F.col("n") * 1000000).alias("inside"),
    )


@query(with_cells("select x, y, z, abs(x - 16) + abs(y - 16) + abs(z - 16) as distance, x * 8 as ax, y * 8 as ay, z * 8 as az from cells"))
def distances_and_anchors(spark, d):
    centre = [F.lit(16)] * 3
    return tables.cells(spark, d).select("x", "y", "z", curves.manhattan(["x", "y", "z"], centre).alias("distance"), *[curves.anchor(c).alias(f"a{c}") for c in "xyz"])


@query(with_cells(f"select x, y, z, (({KEY} & 1048575) * {0x9E3779B97F4A7C15 & 1048575}) & 1048575 as slot from cells"))
def slot_hash(spark, d):
    return tables.cells(spark, d).select("x", "y", "z", curves.slot(curves.morton(), curves.capacity(1)).alias("slot"))


# --- adaptation ---


@query(with_cells(f"""select 2 * x + (c & 1) as x, 2 * y + ((c >> 1) & 1) as y, 2 * z + ((c >> 2) & 1) as z, level + 1 as level, state, 0 as flag, mass, n
  from cells, range(8) r(c) where flag > 0 and state = 0 and level < 8"""))
def split_children(spark, d):
    return mesh.split(tables.cells(spark, d))


MERGED = """merged as (select x // 2 as x, y // 2 as y, z // 2 as z, level - 1 as level, 0 as state, 0 as flag, cast(sum(mass) as bigint) as mass, cast(sum(n) as bigint) as n
  from cells where flag = -1 and state = 0 group by x // 2, y // 2, z // 2, level having count(*) = 8)"""


@query(f"with {CELLS}, {MERGED} select * from merged")
def merge_parents(spark, d):
    return mesh.merge(tables.cells(spark, d), FIELDS)


@query(with_cells("""select x // 2 as x, y // 2 as y, z // 2 as z, round(avg(mass), 6) as mean, min(mass) as least, max(mass) as most,
  arg_min(mass, (x & 1) + 2 * (y & 1) + 4 * (z & 1)) as first from cells where flag = -1 and state = 0 group by 1, 2, 3 having count(*) = 8"""))
def merge_rules(spark, d):
    cells = tables.cells(spark, d).withColumns({"mean": F.col("mass").cast("double"), "least": F.col("mass"), "most": F.col("mass"), "first": F.col("mass")})
    got = mesh.merge(cells, {"mean": "arithmetic", "least": "min", "most": "max", "first": "skip"})
    return got.select("x", "y", "z", F.round("mean", 6).alias("mean"), "least", "most", "first")


mesh.define_rule("second_largest", lambda values: F.get(F.sort_array(values, asc=False), F.lit(1)))


@query(with_cells("""select x // 2 as x, y // 2 as y, z // 2 as z, level - 1 as level, cast(list_sort(list(mass), 'DESC')[2] as bigint) as mass from cells where flag = -1 and state = 0 group by x // 2, y // 2, z // 2, level having count(*) = 8"""))
def merge_own_rule(spark, d):
    """A rule that this module defines: a function of the eight children's values."""
    return mesh.merge(tables.cells(spark, d), {"mass": "second_largest", "n": "volume_weighted"}).select("x", "y", "z", "level", "mass")


ADAPTED = f"""{MERGED}, adapted as (
  select x, y, z, level, state, 0 as flag, mass, n from cells c where not (flag > 0 and state = 0 and level < 8)
    and not (flag = -1 and state = 0 and exists (select 1 from merged m where m.x = c.x // 2 and m.y = c.y // 2 and m.z = c.z // 2))
  union all select 2 * x + (c & 1), 2 * y + ((c >> 1) & 1), 2 * z + ((c >> 2) & 1), level + 1, state, 0, mass, n from cells, range(8) r(c) where flag > 0 and state = 0 and level < 8
  union all select * from merged)"""


@query(f"with {CELLS}, {ADAPTED} select * from adapted")
def adapt_full(spark, d):
    return mesh.adapt(tables.cells(spark, d), FIELDS)


@query(f"with {CELLS}, {ADAPTED} select level, count(*) as n, cast(sum(mass) as bigint) as mass from adapted group by level")
def adapt_levels(spark, d):
    return mesh.adapt(tables.cells(spark, d), FIELDS).groupBy("level").agg(F.count("*").alias("n"), F.sum("mass").alias("mass"))


@query(f"""with {CELLS}, {ADAPTED} select count(*) as cells, (select count(*) from cells where flag > 0 and state = 0 and level < 8) as split, (select count(*) from merged) as merged,
  0::bigint as raised, 0::bigint as vetoed, cast(sum(mass) as bigint) as sum_mass, cast(sum(n) as bigint) as sum_n from adapted""")
def adapt_counts(spark, d):
    """What a cycle did, counted by the job that writes the mesh."""
    counts = Observation()
    mesh.adapt(tables.cells(spark, d), FIELDS, counts=counts).write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([counts.get], "cells long, split long, merged long, raised long, vetoed long, sum_mass long, sum_n long")


@query("""select l_returnflag as flag, l_linenumber as line, round(fsum(l_extendedprice * (1 - l_discount)), 2) as price, round(fsum(l_quantity / 3.0), 4) as third from lineitem group by 1, 2""")
def exact_totals(spark, d):
    """Sums of floating-point numbers that no partitioning changes."""
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    rows = tables.read(spark, d, "lineitem").withColumnsRenamed({"l_returnflag": "flag", "l_linenumber": "line"})
    got = exact.exact_sums(rows, ["flag", "line"], {"price": price, "third": F.col("l_quantity") / 3})
    return got.select("flag", "line", F.round("price", 2).alias("price"), F.round("third", 4).alias("third"))


@query(f"with {CELLS}, {ADAPTED} select (select cast(sum(1 << (3 * (8 - level))) as bigint) from cells) as before, (select cast(sum(1 << (3 * (8 - level))) as bigint) from adapted) as after")
def adapt_volume(spark, d):
    cells = tables.cells(spark, d)
    volume = lambda df, name: df.agg(F.sum(F.call_function("shiftleft", F.lit(1).cast("long"), 3 * (8 - F.col("level")))).alias(name))
    return volume(cells, "before").crossJoin(F.broadcast(volume(mesh.adapt(cells, FIELDS), "after")))  # one row each


@query(f"with {CELLS}, {ADAPTED} select x, y, z, level, row_number() over (order by {morton_sql('(x << (8 - level))', '(y << (8 - level))', '(z << (8 - level))')}, level) - 1 as number from adapted")
def curve_rank(spark, d):
    ordered = mesh.curve_order(mesh.adapt(tables.cells(spark, d), FIELDS))
    return mesh.numbered(ordered, ["key", "level"]).select("x", "y", "z", "level", "number")


@query(with_cells("select x, y, z, flag from cells"))
def balance_round_uniform(spark, d):
    """On a mesh of one level no flag is raised: a neighbour gets finer by one level at most."""
    return mesh.balance_round(checkpointed(tables.cells(spark, d))).select("x", "y", "z", "flag")


#: The adapted mesh, its level-6 cells flagged again where their mass is large.
FLAGGED = f"{ADAPTED}, flagged as (select x, y, z, level, state, case when level = 6 and mass >= 90 then 1 else 0 end as flag from adapted)"
FACE_SQL = "(values (-1, 0, 0), (1, 0, 0), (0, -1, 0), (0, 1, 0), (0, 0, -1), (0, 0, 1)) f(dx, dy, dz)"
PROBES = f"""probes as (select level, level + cast(flag > 0 as integer) as will,
    case dx when -1 then (x << (8 - level)) - 1 when 1 then (x + 1) << (8 - level) else x << (8 - level) end as px,
    case dy when -1 then (y << (8 - level)) - 1 when 1 then (y + 1) << (8 - level) else y << (8 - level) end as py,
    case dz when -1 then (z << (8 - level)) - 1 when 1 then (z + 1) << (8 - level) else z << (8 - level) end as pz, x, y, z, dx, dy, dz from flagged, {FACE_SQL})"""


def flagged(spark, d):
    cells = mesh.adapt(tables.cells(spark, d), FIELDS)
    return cells.withColumn("flag", F.when((F.col("level") == 6) & (F.col("mass") >= 90), 1).otherwise(0))


@query(f"""with {CELLS}, {FLAGGED}, {PROBES},
  seen as (select will, l.level, px >> (8 - l.level) as x, py >> (8 - l.level) as y, pz >> (8 - l.level) as z from probes p, (values (4), (5), (6)) l(level) where l.level <= p.level),
  bad as (select distinct c.x, c.y, c.z, c.level from seen p join flagged c using (level, x, y, z) where p.will >= c.level + cast(c.flag > 0 as integer) + 2)
  select f.x, f.y, f.z, f.level, case when b.x is not null and state = 0 and flag <= 0 and f.level < 8 then 1 else flag end as flag from flagged f left join bad b using (x, y, z, level)""")
def balance_flags(spark, d):
    return mesh.balance_round(checkpointed(flagged(spark, d))).select("x", "y", "z", "level", "flag")


def round_sql(src: str, dst: str) -> str:
    """One round of the 2:1 rule: every finer cell's faces, and the cells beyond them."""
    beyond = ", ".join(f"case d{c} when -1 then ({c} << (8 - level)) - 1 when 1 then ({c} + 1) << (8 - level) else {c} << (8 - level) end as p{c}" for c in "xyz")
    return f"""{dst}_p as materialized (select level, level + cast(flag > 0 as integer) as will, {beyond} from {src}, {FACE_SQL}),
  {dst}_s as materialized (select distinct will, l.level, px >> (8 - l.level) as x, py >> (8 - l.level) as y, pz >> (8 - l.level) as z from {dst}_p p, (values (4), (5), (6)) l(level) where l.level <= p.level),
  {dst}_b as materialized (select distinct c.x, c.y, c.z, c.level from {dst}_s p join {src} c using (level, x, y, z) where p.will >= c.level + cast(c.flag > 0 as integer) + 2),
  {dst} as materialized (select f.* replace (case when b.x is not null and f.state = 0 and f.flag <= 0 and f.level < 8 then 1 else f.flag end as flag) from {src} f left join {dst}_b b using (x, y, z, level))"""


#: Flags spread to coarser levels only; the mesh has three.
BALANCED = f"""flagged0 as materialized (select x, y, z, level, state, case when level = 6 and mass >= 90 then 1 else 0 end as flag, mass, n from adapted),
  {round_sql("flagged0", "r1")}, {round_sql("r1", "r2")}, {round_sql("r2", "balanced")}"""


@query(f"with {CELLS}, {ADAPTED}, {BALANCED} select x, y, z, level, flag from balanced")
def balance_fixpoint(spark, d):
    """Rounds of the 2:1 rule to their end."""
    cells, settled = mesh.balance(flagged(spark, d))
    if not settled:
        raise RuntimeError("the mesh did not come into balance")
    return cells.select("x", "y", "z", "level", "flag")


@query(f"""with {CELLS}, {ADAPTED}, {BALANCED} select x, y, z, level, state, 0 as flag, mass, n from balanced where not (flag > 0 and state = 0 and level < 8)
  union all select 2 * x + (c & 1), 2 * y + ((c >> 1) & 1), 2 * z + ((c >> 2) & 1), level + 1, state, 0, mass, n from balanced, range(8) r(c) where flag > 0 and state = 0 and level < 8""")
def adapt_balanced(spark, d):
    """A cycle after flags were raised to the end of the 2:1 rule; the mesh has no merge flags."""
    return mesh.adapt(mesh.balance(flagged(spark, d))[0], FIELDS)


def cycle_sql(src: str, dst: str, rounds: int = 8) -> str:
    """A cycle that ends in balance: pairs of neighbours, cells that must not split, and rounds of raised cells and vetoed groups."""
    beyond = ", ".join(f"case d{c} when -1 then ({c} << (8 - level)) - 1 when 1 then ({c} + 1) << (8 - level) else {c} << (8 - level) end as p{c}" for c in "xyz")
    held = ", ".join(f"{dst}_h{k} as materialized (select id from {dst}_h{k - 1} union select a from {dst}_q join {dst}_h{k - 1} on b = id where la > lb)" for k in range(1, 5))
    step = lambda k: f"""{dst}_l{k} as materialized (select distinct case when v.will > u.will then a else b end as id from {dst}_q join {dst}_s{k} u on a = u.id join {dst}_s{k} v on b = v.id where abs(u.will - v.will) >= 2),
  {dst}_v{k} as materialized (select distinct grp from {dst}_l{k} join {dst}_s{k} using (id) where merging),
  {dst}_s{k + 1} as materialized (select s.id, s.level, s.grp, can, merging and v.grp is null as merging,
    case when merging and v.grp is not null then s.level when not merging and l.id is not null and can and will = s.level then s.level + 1 else will end as will
    from {dst}_s{k} s left join {dst}_v{k} v on s.grp = v.grp left join {dst}_l{k} l on s.id = l.id)"""  # noqa: E731
    return f"""{dst}_i as materialized (select row_number() over (order by level, x, y, z) as id, * from {src}),
  {dst}_g as materialized (select level, x >> 1 as gx, y >> 1 as gy, z >> 1 as gz, min(id) as grp from {dst}_i where flag = -1 and state = 0 and level >= 1 group by 1, 2, 3, 4 having count(*) = 8),
  {dst}_p as materialized (select id, level, {beyond} from {dst}_i, {FACE_SQL}),
  {dst}_q as materialized (select distinct p.id as a, c.id as b, p.level as la, c.level as lb from (select id, level, m, px >> (8 - m) as qx, py >> (8 - m) as qy, pz >> (8 - m) as qz from {dst}_p, (values (3), (4), (5), (6), (7), (8)) l(m) where m <= level) p
    join {dst}_i c on c.level = m and c.x = qx and c.y = qy and c.z = qz),
  {dst}_h0 as materialized (select id from {dst}_i where state <> 0 or level >= 8 union select a from {dst}_q where la > lb + 1), {held},
  {dst}_s0 as materialized (select i.id, i.level, grp, state = 0 and i.level < 8 and h.id is null as can, grp is not null as merging,
    case when flag > 0 and state = 0 and i.level < 8 and h.id is null then i.level + 1 when grp is not null then i.level - 1 else i.level end as will
    from {dst}_i i left join {dst}_g g on g.level = i.level and gx = x >> 1 and gy = y >> 1 and gz = z >> 1 left join {dst}_h4 h on h.id = i.id),
  {", ".join(step(k) for k in range(rounds))},
  {dst}_d as materialized (select i.*, will, merging from {dst}_i i join {dst}_s{rounds} s on i.id = s.id),
  {dst} as materialized (select x, y, z, level, state, 0 as flag, mass, n from {dst}_d where will = level
    union all select 2 * x + (c & 1), 2 * y + ((c >> 1) & 1), 2 * z + ((c >> 2) & 1), level + 1, state, 0, mass, n from {dst}_d, range(8) r(c) where will > level
    union all select x >> 1, y >> 1, z >> 1, level - 1, 0, 0, cast(sum(mass) as bigint), cast(sum(n) as bigint) from {dst}_d where merging group by x >> 1, y >> 1, z >> 1, level)"""


@query(f"""with {CELLS.replace("cells as", "cells as materialized")}, {cycle_sql("cells", "once", 3)},
  again as materialized (select x, y, z, level, state, case when level = 6 and mass >= 90 then 1 when ((x >> 1) + (y >> 1) + (z >> 1)) % 2 = 0 then -1 else 0 end as flag, mass, n from once),
  {cycle_sql("again", "twice")} select * from twice""")
def adapt_balanced_merges(spark, d):
    """Two balanced cycles; in the second one cells split and groups merge on a mesh of three levels."""
    once = mesh.adapt(tables.cells(spark, d), FIELDS, balanced=True)
    turn = (F.shiftright("x", 1) + F.shiftright("y", 1) + F.shiftright("z", 1)) % 2
    again = once.withColumn("flag", F.when((F.col("level") == 6) & (F.col("mass") >= 90), 1).when(turn == 0, -1).otherwise(0))
    return mesh.adapt(again, FIELDS, balanced=True)


@query(f"""with {CELLS}, {ADAPTED}, p as (select event_id, cast(user_id % 256 as integer) as px, cast(event_id % 251 as integer) as py, cast(floor(value) as integer) % 256 as pz from events)
  select p.*, c.x as nx, c.y as ny, c.z as nz, c.level as n_level from p left join
    (select p.event_id, a.x, a.y, a.z, a.level from p, (values (4), (5), (6)) l(m) join adapted a on a.level = m and a.x = px >> (8 - m) and a.y = py >> (8 - m) and a.z = pz >> (8 - m)) c using (event_id)""")
def cells_of_points(spark, d):
    """The cell of the adapted mesh that holds each event's place."""
    at = tables.events(spark, d).select("event_id", (F.col("user_id") % 256).cast("int").alias("px"), (F.col("event_id") % 251).cast("int").alias("py"), (F.floor("value").cast("int") % 256).alias("pz"))
    return locate.cells_of(checkpointed(mesh.adapt(tables.cells(spark, d), FIELDS).select(*mesh.CELL)), at)


@query(f"""with {CELLS}, {FLAGGED}, {PROBES},
  seen as (select p.x as ox, p.y as oy, p.z as oz, p.level as olevel, will, l.level, px >> (8 - l.level) as x, py >> (8 - l.level) as y, pz >> (8 - l.level) as z from probes p, (values (4), (5), (6)) l(level)),
  bad as (select distinct ox as x, oy as y, oz as z, olevel as level from seen p join flagged c using (level, x, y, z) where c.level + cast(c.flag > 0 as integer) >= p.will + 2)
  select f.x, f.y, f.z, f.level, case when b.x is not null and state = 0 and flag <= 0 and f.level < 8 then 1 else flag end as flag from flagged f left join bad b using (x, y, z, level)""")
def balance_probe(spark, d):
    """A round of the 2:1 rule by one probe a face."""
    return mesh.balance_round(checkpointed(flagged(spark, d)), mode="probe").select("x", "y", "z", "level", "flag")


@query(with_cells(f"""select a.x, a.y, a.z, a.level, case when dx = -1 then 0 when dx = 1 then 1 when dy = -1 then 2 when dy = 1 then 3 when dz = -1 then 4 else 5 end as face, b.x as nx, b.y as ny, b.z as nz
  from cells a, {FACE_SQL} join cells b on b.x = a.x + dx and b.y = a.y + dy and b.z = a.z + dz"""))
def stencil_neighbors(spark, d):
    return mesh.face_neighbours(tables.cells(spark, d)).select("x", "y", "z", "level", "face", "nx", "ny", "nz")


@query(f"""with {CELLS}, {FLAGGED}, {PROBES},
  seen as (select p.x, p.y, p.z, p.level, case when dx = -1 then 0 when dx = 1 then 1 when dy = -1 then 2 when dy = 1 then 3 when dz = -1 then 4 else 5 end as face,
    l.level as n_level, px >> (8 - l.level) as nx, py >> (8 - l.level) as ny, pz >> (8 - l.level) as nz from probes p, (values (4), (5), (6)) l(level))
  select s.x, s.y, s.z, s.level, face, min(n_level) as n_level from seen s join flagged c on c.level = n_level and c.x = nx and c.y = ny and c.z = nz group by all""")
def mixed_neighbors(spark, d):
    return mesh.mixed_neighbours(flagged(spark, d))


@query(with_cells("""select f.level, px, py, pz, round(sum(coalesce(c.mass, 0)) / 8, 6) as value
  from (select distinct level, x // 2 as px, y // 2 as py, z // 2 as pz from cells) f, range(8) r(o)
  left join cells c on c.x = px + (o & 1) and c.y = py + ((o >> 1) & 1) and c.z = pz + ((o >> 2) & 1) group by 1, 2, 3, 4"""))
def trilinear_gather(spark, d):
    return mesh.trilinear(tables.cells(spark, d), "mass").withColumn("value", F.round("value", 6))


# --- numbering, scans, compaction ---


@query(with_cells(f"""select k.key, p.place from (select {KEY} as key, state from cells) k left join
  (select key, row_number() over (order by key) - 1 as place from (select {KEY} as key from cells where state = 0)) p using (key)"""))
def compact_permutation(spark, d):
    keyed = tables.cells(spark, d).select(curves.morton().alias("key"), "state")
    return mesh.permutation(keyed, "key", F.col("state") == 0).select("key", "place")


@query(with_cells(f"select {KEY} as key, mass, cast(coalesce(sum(mass) over (order by {KEY} rows between unbounded preceding and 1 preceding), 0) as bigint) as before from cells"))
def block_offsets(spark, d):
    return mesh.running_total(tables.cells(spark, d).select(curves.morton().alias("key"), "mass"), ["key"], "mass")


@query(with_cells(f"select key, (row_number() over (order by key) - 1) * 8 as first_child from (select {KEY} as key from cells where flag > 0 and state = 0)"))
def child_blocks(spark, d):
    asked = tables.cells(spark, d).where(mesh.splits()).select(curves.morton().alias("key"))
    return mesh.numbered(asked, ["key"]).select("key", (F.col("number") * 8).alias("first_child"))


@query(with_cells(f"select cast(({KEY} >> 8) & 255 as integer) as byte, count(*) as n from cells group by 1"))
def histogram_byte(spark, d):
    return tables.cells(spark, d).groupBy(F.shiftright(curves.morton(), 8).bitwiseAND(F.lit(255).cast("long")).cast("int").alias("byte")).agg(F.count("*").alias("n"))


@query(with_cells(f"""select bin, part, n, cast(coalesce(sum(n) over (partition by bin order by part rows between unbounded preceding and 1 preceding), 0) as bigint) as before
  from (select cast({KEY} & 255 as integer) as bin, state as part, count(*) as n from cells group by 1, 2)"""))
def bin_offsets(spark, d):
    counted = tables.cells(spark, d).groupBy(curves.morton().bitwiseAND(F.lit(255).cast("long")).cast("int").alias("bin"), F.col("state").alias("part")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("bin").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return counted.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0)))


@query(with_cells(f"""select count(*) as n, count(*) filter (where key <= last) as falls from (select key, lag(key) over (partition by z order by key) as last from (select {KEY} as key, z from cells))"""))
def sorted_keys(spark, d):
    w = Window.partitionBy("z").orderBy("key")
    seen = tables.cells(spark, d).select(curves.morton().alias("key"), "z").withColumn("last", F.lag("key").over(w))
    return seen.agg(F.count("*").alias("n"), F.count_if(F.col("key") <= F.col("last")).alias("falls"))


@query(f"with {CELLS}, {MERGED} select x, y, z, level, row_number() over (order by {KEY}) - 1 as number from merged")
def group_numbers(spark, d):
    merged = mesh.merge(tables.cells(spark, d), FIELDS).withColumn("key", curves.morton())
    return mesh.numbered(merged, ["key"]).select("x", "y", "z", "level", "number")


# --- reductions, masks ---


@query(with_cells("select cast(sum(mass) as bigint) as total, min(mass) as least, max(mass) as most, count(*) filter (where flag > 0) as split, count(*) filter (where flag < 0) as merge from cells"))
def reduce_mass(spark, d):
    return tables.cells(spark, d).agg(F.sum("mass").alias("total"), F.min("mass").alias("least"), F.max("mass").alias("most"), F.count_if(F.col("flag") > 0).alias("split"), F.count_if(F.col("flag") < 0).alias("merge"))


@query(with_cells("select x, y, z, case when state = 0 and mass > 50 then mass * 2 + x else mass end as mass from cells"))
def kernel_mask(spark, d):
    """A masked kernel leaves other rows as they are."""
    mask = (F.col("state") == 0) & (F.col("mass") > 50)
    return schema.kernel(tables.cells(spark, d), {"mass": F.col("mass") * 2 + F.col("x")}, mask).select("x", "y", "z", "mass")


@query(with_cells("select x, y, z, case when abs(mass - 50) > 30 then 1 when abs(mass - 50) < 5 then -1 else 0 end as flag, case when (x - 16) ** 2 + (y - 16) ** 2 + (z - 16) ** 2 < 144 then 2 else 0 end as near from cells"))
def threshold_flag(spark, d):
    off = F.abs(F.col("mass") - 50)
    apart = F.sqrt(sum((F.col(c) - 16) ** 2 for c in "xyz"))
    return tables.cells(spark, d).select("x", "y", "z", F.when(off > 30, 1).when(off < 5, -1).otherwise(0).alias("flag"), F.when(apart < 12, 2).otherwise(0).alias("near"))


@query(with_cells("select x, y, z, 1.0::double as ones, mass as copied, 0.0::double as zeros, case when x < 8 then x * x else case when x < 16 then x + y else 0 end end as branch, x * 4 + 6 as counted from cells"))
def kernel_templates(spark, d):
    """Fills, copies, nested branches, and a counted loop that folds (x + i) over i in 0..4."""
    loop = F.aggregate(F.sequence(F.lit(0), F.lit(3)), F.lit(0), lambda acc, i: acc + F.col("x") + i)
    return tables.cells(spark, d).select(
        "x", "y", "z", F.lit(1.0).alias("ones"), F.col("mass").alias("copied"), F.lit(0.0).alias("zeros"),
        F.when(F.col("x") < 8, F.col("x") * F.col("x")).otherwise(F.when(F.col("x") < 16, F.col("x") + F.col("y")).otherwise(0)).alias("branch"), loop.alias("counted"),
    )


@query(with_cells("""select x, y, z, round(sin(x / 5.0) + cos(y / 5.0) + tan(z / 40.0), 9) as waves, round(asin(x / 32.0) + acos(y / 32.0) + atan(z) + atan2(x, y + 1), 9) as arcs,
  round(sqrt(mass) + abs(x - 16) + power(n, 1.5) + ln(mass + 1) + log10(mass + 1) + exp(-n), 9) as powers, cast(floor(mass / 7.0) as integer) as low, cast(ceil(mass / 7.0) as integer) as high, least(x, y) as least, greatest(y, z) as most from cells"""))
def math_functions(spark, d):
    x, y, z, mass, n = (F.col(c) for c in ("x", "y", "z", "mass", "n"))
    return tables.cells(spark, d).select(
        "x", "y", "z", F.round(F.sin(x / 5) + F.cos(y / 5) + F.tan(z / 40), 9).alias("waves"), F.round(F.asin(x / 32) + F.acos(y / 32) + F.atan(z) + F.atan2(x, y + 1), 9).alias("arcs"),
        F.round(F.sqrt(mass) + F.abs(x - 16) + F.pow(n, F.lit(1.5)) + F.log(mass + 1) + F.log10(mass + 1) + F.exp(-n), 9).alias("powers"),
        F.floor(mass / 7).cast("int").alias("low"), F.ceil(mass / 7).cast("int").alias("high"), F.least(x, y).alias("least"), F.greatest(y, z).alias("most"),
    )


@query(with_cells("""select x, y, z, round(sin(x * 0.2) * cos(y * 0.2) * cos(z * 0.2) * exp(-0.04 * n), 9) + 0::double as u, round(-cos(x * 0.2) * sin(y * 0.2) * cos(z * 0.2) * exp(-0.04 * n), 9) + 0::double as v,
  round(exp(-0.08 * n), 9) as energy, round(3 * exp(-0.08 * n), 9) as enstrophy from cells"""))
def taylor_green(spark, d):
    """The decaying vortex at Reynolds number 50, time n, space step 0.2."""
    x, y, z = (F.col(c) * 0.2 for c in "xyz")
    decay, energy = F.exp(-0.04 * F.col("n")), F.exp(-0.08 * F.col("n"))
    return tables.cells(spark, d).select(
        "x", "y", "z", (F.round(F.sin(x) * F.cos(y) * F.cos(z) * decay, 9) + 0.0).alias("u"), (F.round(-F.cos(x) * F.sin(y) * F.cos(z) * decay, 9) + 0.0).alias("v"),
        F.round(energy, 9).alias("energy"), F.round(3 * energy, 9).alias("enstrophy"),
    )


@query(with_cells(f"""select a.x, a.y, a.z, round(sum((dx - dy) * b.mass) / 2.0, 6) as curl from cells a, {FACE_SQL} join cells b on b.x = a.x + dx and b.y = a.y + dy and b.z = a.z + dz
  where dz = 0 group by 1, 2, 3 having count(*) = 4"""))
def vorticity(spark, d):
    """Central differences of a field over face neighbours, from one neighbour join and a conditional sum."""
    cells = tables.cells(spark, d)
    near = mesh.face_neighbours(cells).join(cells.select(*[F.col(c).alias(f"n{c}") for c in "xyz"], "mass"), ["nx", "ny", "nz"])
    sign = F.when(F.col("face") == 1, 1).when(F.col("face") == 0, -1).when(F.col("face") == 3, -1).otherwise(1)
    four = near.where("face < 4").groupBy("x", "y", "z").agg(F.count("*").alias("k"), F.sum(sign * F.col("mass") / 2).alias("curl")).where("k = 4")
    return four.select("x", "y", "z", F.round("curl", 6).alias("curl"))


# --- partitions ---


@query(f"with {CELLS}, {RANKED} select rank, min(key) as first_key, max(key) as last_key, count(*) as n, lag(rank) over (order by rank) as previous, lead(rank) over (order by rank) as next from ranked group by rank")
def topology(spark, d):
    return partition.owner_ranges(ranked(tables.cells(spark, d)))


@query(f"with {CELLS}, {RANKED}, c as (select rank, count(*) as n from ranked group by rank) select min(n) as smallest, max(n) as largest, avg(n) as mean, count(*) as ranks, (max(n) - min(n)) / avg(n) as imbalance, (max(n) - min(n)) / avg(n) > 0.1 as due from c")
def rank_imbalance(spark, d):
    counts = ranked(tables.cells(spark, d)).groupBy("rank").agg(F.count("*").alias("n"))
    return partition.rebalance_due(partition.imbalance(counts))


@query(f"""with {CELLS}, {RANKED}, r as (select rank, min(key) as a, max(key) as b from ranked group by rank), k as (select l_orderkey * 7 % 40000 as key from lineitem)
  select k.key, count(*) as n, coalesce((select min(rank) from r where k.key between a and b), -1) as owner from k group by k.key""")
def range_owner(spark, d):
    ranges = partition.owner_ranges(ranked(tables.cells(spark, d)))
    keys = tables.read(spark, d, "lineitem").groupBy((F.col("l_orderkey") * 7 % 40000).alias("key")).agg(F.count("*").alias("n"))
    return partition.range_owner(keys, ranges)


@query(f"with {CELLS} select key, case when key < 8191 then 0 when key < 16383 then 1 when key < 24574 then 2 else 3 end as owner from (select {KEY} as key from cells)")
def split_owner(spark, d):
    return tables.cells(spark, d).select(curves.morton().alias("key")).withColumn("owner", partition.owner_of_splits("key", partition.linear_splits(0, 32766, 4, 4)))


@query(f"with {CELLS} select key, cast(ntile({RANKS}) over (order by key) - 1 as integer) as rank from (select {KEY} as key from cells)")
def partition_ntile(spark, d):
    """Equal counts by key order."""
    return partition.equal_ranks(tables.cells(spark, d).select(curves.morton().alias("key")), ["key"], RANKS)


def reranked(spark, d):
    """Cells with their old rank, by key range, and the rank of equal counts."""
    cells = ranked(tables.cells(spark, d)).select("key", F.col("rank").alias("old"), "x", "y", "z", "mass")
    return partition.equal_ranks(cells, ["key"], RANKS)


MOVED = f"moved as (select {RANK} as source, cast(ntile({RANKS}) over (order by {KEY}) - 1 as integer) as destination, {KEY} as key from cells)"


@query(f"with {CELLS}, {MOVED} select source, destination, min(key) as first_key, max(key) + 1 as end_key, count(*) as n, count(*) > 0 as valid from moved where source <> destination group by 1, 2")
def migration_plan(spark, d):
    return partition.migration(reranked(spark, d), "old", "rank").withColumn("valid", partition.valid_transfer())


@query("""with t as (select o_custkey % 20 as source, o_custkey % 20 + 1 as destination, o_orderkey as first_key, o_orderkey + 1 + o_custkey % 40 as end_key, cast(1 as bigint) as n from orders),
  m as (select *, case when lag(end_key) over w = first_key then 0 else 1 end as gap from t window w as (partition by source, destination order by first_key)),
  i as (select *, sum(gap) over (partition by source, destination order by first_key) as island from m)
  select source, destination, min(first_key) as first_key, max(end_key) as end_key, cast(sum(n) as bigint) as n from i group by source, destination, island""")
def transfer_coalesce(spark, d):
    key, to = F.col("o_orderkey"), F.col("o_custkey") % 20
    rows = tables.read(spark, d, "orders").select(to.alias("source"), (to + 1).alias("destination"), key.alias("first_key"), (key + 1 + F.col("o_custkey") % 40).alias("end_key"), F.lit(1).cast("long").alias("n"))
    return partition.coalesced(rows)


@query(f"""with {CELLS}, {RANKED} select distinct a.rank as to_rank, b.x, b.y, b.z, b.level, b.rank as from_rank, b.mass from ranked a, {FACE_SQL}
  join ranked b on b.x = a.x + dx and b.y = a.y + dy and b.z = a.z + dz where a.rank <> b.rank""")
def halo_rows(spark, d):
    return partition.halo_rows(ranked(tables.cells(spark, d)), "rank", ["mass"]).select("to_rank", "x", "y", "z", "level", "from_rank", "mass")


@query(with_cells(f"select key, 4 * 32768 + 1 * 4 * 32768 + key * 4 as at, key * 4 % 64 = 0 and key > 0 as ghost from (select {KEY} as key from cells)"))
def pack_offsets(spark, d):
    keyed = tables.cells(spark, d).select(curves.morton().alias("key"))
    return keyed.select("key", partition.pack_offset("key", F.lit(1), F.lit(4), 32768).alias("at"), partition.ghost_valid(F.lit(0), "key", F.lit(0), F.col("key") * 4).alias("ghost"))


# --- geometry ---


@query(f"""with {SHAPES} select id, kind = 'sphere' as ball, round(tx - ex, 6) as low_x, round(tx + ex, 6) as high_x, round(ty - ey, 6) as low_y, round(tz + ez, 6) as high_z,
    tx between tx - ex and tx + ex and 50.5 between ty - ey and ty + ey as holds, name <> '' and material_id > 0 and radius > 0 as valid
  from (select *, case kind when 'box' then width / 2 else radius end as ex, case kind when 'sphere' then radius else height / 2 end as ey, case kind when 'box' then length / 2 else radius end as ez from shapes)""")
def shape_boxes(spark, d):
    half = geometry.extent()
    low, high = ({c: F.col(f"t{c}") + sign * half[c] for c in "xyz"} for sign in (-1, 1))
    point = {"x": F.col("tx"), "y": F.lit(50.5), "z": F.col("tz")}
    return tables.shapes(spark, d).select(
        "id", (F.col("kind") == "sphere").alias("ball"), F.round(low["x"], 6).alias("low_x"), F.round(high["x"], 6).alias("high_x"), F.round(low["y"], 6).alias("low_y"), F.round(high["z"], 6).alias("high_z"),
        geometry.contains(point, low, high).alias("holds"), geometry.valid().alias("valid"),
    )


@query(f"""with {SHAPES}, b as (select *, case kind when 'box' then width / 2 else radius end as ex, case kind when 'sphere' then radius else height / 2 end as ey, case kind when 'box' then length / 2 else radius end as ez from shapes),
  c as (select *, unnest(range(cast(floor(greatest(tx - ex, -10)) as bigint), cast(ceil(least(tx + ex, 90)) as bigint))) as i from b),
  c2 as (select *, unnest(range(cast(floor(greatest(ty - ey, -10)) as bigint), cast(ceil(least(ty + ey, 90)) as bigint))) as j from c),
  c3 as (select *, unnest(range(cast(floor(greatest(tz - ez, -10)) as bigint), cast(ceil(least(tz + ez, 90)) as bigint))) as k from c2),
  l as (select *, i + 0.5 - tx as lx, j + 0.5 - ty as ly, k + 0.5 - tz as lz from c3)
  select i as x, j as y, k as z, max(material_id) as material_id from l
  where case kind when 'sphere' then lx * lx + ly * ly + lz * lz <= radius * radius when 'box' then abs(lx) <= width / 2 and abs(ly) <= height / 2 and abs(lz) <= length / 2 else lx * lx + lz * lz <= radius * radius and abs(ly) <= height / 2 end group by 1, 2, 3""")
def shape_voxels(spark, d):
    return geometry.voxels(tables.shapes(spark, d), domain=(-10.0, 90.0))


def corners(spark, d):
    """Each part as a tetrahedron: four triangles."""
    key = F.col("p_partkey")
    at = [key % 50 + 0.3137, key % 41 + 0.2291, key % 37 + 0.1773]
    size = [2.0 + F.col("p_size") % 4, 2.5 + F.col("p_size") % 3, 3.0 + F.col("p_size") % 5]
    point = [[at[a] + (size[a] if a == n else 0) for a in range(3)] for n in (-1, 0, 1, 2)]
    faces = [(0, 1, 2), (0, 1, 3), (0, 2, 3), (1, 2, 3)]
    rows = F.array(*[F.struct(*[point[p][a].alias(f"{v}{c}") for v, p in zip("abc", f, strict=True) for a, c in enumerate("xyz")]) for f in faces])
    parts = tables.read(spark, d, "part").select("p_partkey", "p_size").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "p_partkey")
    return parts.select(key.alias("id"), F.explode(rows).alias("t")).select("id", "t.*")


TETRA = """t as (select p_partkey as id, p_partkey % 50 + 0.3137::double as x0, p_partkey % 41 + 0.2291::double as y0, p_partkey % 37 + 0.1773::double as z0, 2.0::double + p_size % 4 as sx, 2.5::double + p_size % 3 as sy, 3.0::double + p_size % 5 as sz from part)"""


@query(f"""with {TETRA}, a as (select *, unnest(range(cast(floor(x0) as bigint), cast(ceil(x0 + sx) as bigint) + 1)) as x from t), b as (select *, unnest(range(cast(floor(y0) as bigint), cast(ceil(y0 + sy) as bigint) + 1)) as y from a),
  c as (select *, unnest(range(cast(floor(z0) as bigint), cast(ceil(z0 + sz) as bigint) + 1)) as z from b)
  select id, x, y, z from c where x + 0.5 > x0 and y + 0.5 > y0 and z + 0.5 > z0 and (x + 0.5 - x0) / sx + (y + 0.5 - y0) / sy + (z + 0.5 - z0) / sz < 1""")
def mesh_voxels(spark, d):
    return geometry.mesh_voxels(corners(spark, d), ["id"])


@query(f"with {TETRA} select id, round(x0, 6) as min_x, round(y0, 6) as min_y, round(z0, 6) as min_z, round(x0 + sx, 6) as max_x, round(y0 + sy, 6) as max_y, round(z0 + sz, 6) as max_z from t")
def mesh_bounds(spark, d):
    got = geometry.bounds(corners(spark, d), ["id"])
    return got.select("id", *[F.round(c, 6).alias(c) for c in got.columns[1:]])


# --- series ---


@query("""with s as (select event_type, epoch_us(ts) as t, value, event_id from events where event_id % 10 = 0), k as (select event_type, t, max(value) as value from s group by 1, 2),
  iv as (select event_type, t as lo, lead(t) over (partition by event_type order by t) as hi, value as v0, lead(value) over (partition by event_type order by t) as v1 from k),
  ends as (select event_type, min(t) as a, max(t) as b, arg_min(value, t) as va, arg_max(value, t) as vb from k group by 1), p as (select event_id, event_type, epoch_us(ts) as t from events)
  select event_id, round(coalesce(iv.v0 + cast(p.t - iv.lo as double) / (iv.hi - iv.lo) * (iv.v1 - iv.v0), case when p.t <= a then va else vb end), 6) as value
  from p join ends using (event_type) left join iv on iv.event_type = p.event_type and p.t >= iv.lo and p.t < iv.hi""")
def profile_interp(spark, d):
    """Every event's value by interpolation in the profile that every tenth event of its type makes."""
    all_ = tables.events(spark, d).select("event_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), "value")
    profile = all_.where("event_id % 10 = 0").groupBy("event_type", "t").agg(F.max("value").alias("value"))
    got = series.bracketed(all_.select("event_id", "event_type", "t"), profile, ["event_type"], "t", "value")
    return got.select("event_id", F.round("value", 6).alias("value"))


@query("select event_type, round(avg(value), 6) as mean, round(stddev_pop(value), 6) as deviation, min(value) as least, max(value) as most, round(stddev_pop(value) / avg(value), 6) as variation from events group by event_type")
def series_spread(spark, d):
    got = tables.events(spark, d).groupBy("event_type").agg(*series.spread("value"), series.variation("value").alias("variation"))
    return got.select("event_type", *[F.round(c, 6).alias(c) if c in ("mean", "deviation", "variation") else F.col(c) for c in got.columns[1:]])


@query("select user_id, median(value) as baseline, count(*) as n from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as r from events) where r <= 5 group by user_id")
def median_last5(spark, d):
    newest = [F.desc("ts"), F.desc("event_id")]
    return series.last_of(tables.events(spark, d), ["user_id"], newest).groupBy("user_id").agg(F.median("value").alias("baseline"), F.count("*").alias("n"))


@query("""with r as (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as r from events), b as (select user_id, median(value) as baseline from r where r between 2 and 6 group by user_id)
  select user_id, event_id, round(value, 6) as value, round(baseline, 6) as baseline, round((value / baseline - 1) * 100, 6) as percent from r join b using (user_id) where r = 1 and value > baseline * 1.05""")
def regression_check(spark, d):
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    placed = tables.events(spark, d).withColumn("r", F.row_number().over(w)).where("r <= 6")
    base = placed.where("r > 1").groupBy("user_id").agg(F.median("value").alias("baseline"))
    got = series.regressions(placed.where("r = 1"), base, ["user_id"], "value")
    return got.select("user_id", "event_id", *[F.round(c, 6).alias(c) for c in ("value", "baseline", "percent")])


@query("""select event_type, round(case when sum(r * r) < 1e-10 then 0 else sqrt(sum((v - r) * (v - r)) / sum(r * r)) end, 6) as l2, round(max(abs(v - r)), 6) as linf
  from (select event_type, value as v, avg(value) over (partition by event_type, user_id) as r from events) group by event_type""")
def profile_error(spark, d):
    w = Window.partitionBy("event_type", "user_id")
    got = tables.events(spark, d).select("event_type", F.col("value").alias("v"), F.avg("value").over(w).alias("r"))
    return got.groupBy("event_type").agg(F.round(series.l2_error(F.col("v"), F.col("r")), 6).alias("l2"), F.round(series.linf_error(F.col("v"), F.col("r")), 6).alias("linf"))


@query("""with o as (select row_number() over (order by o_orderdate, o_orderkey) - 1 as number, o_totalprice as a from orders), e as (select row_number() over (order by ts, event_id) - 1 as number, value as b from events)
  select number, a, b from o join e using (number)""")
def positional_pairs(spark, d):
    orders = tables.read(spark, d, "orders").select(F.col("o_orderdate").alias("at"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("value"))
    events = tables.events(spark, d).select(F.col("ts").alias("at"), F.col("event_id").alias("id"), "value")
    return series.positional(orders, events, ["at", "id"], "value")


@query("""with p as (select event_id, event_type, epoch_us(ts) as t from events), k as (select distinct event_type, t from p where event_id % 10 = 0)
  select event_id, case when a.t is null then b.t when b.t is null or p.t - a.t <= b.t - p.t then a.t else b.t end as nearest
  from p asof left join k a on p.event_type = a.event_type and p.t >= a.t asof left join k b on p.event_type = b.event_type and p.t <= b.t""")
def nearest_match(spark, d):
    """The time of the profile point nearest to each event; the earlier one of two."""
    all_ = tables.events(spark, d).select("event_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    profile = all_.where("event_id % 10 = 0").select("event_type", "t").distinct()
    return series.nearest(all_, profile, ["event_type"], "t").select("event_id", "nearest")


@query("""with m as (select user_id % 50 as test, event_type as metric, event_id % 7 as commit_, value, event_id, event_id % 2 as new from events),
  one as (select *, row_number() over (partition by test, metric, commit_, new order by event_id desc) as r from m),
  n as (select test, metric, commit_, value from one where r = 1 and new = 1), o as (select test, metric, commit_, value from one where r = 1 and new = 0)
  select * from n union all select * from o where not exists (select 1 from n where n.test = o.test and n.metric = o.metric and n.commit_ = o.commit_)""")
def metric_upsert(spark, d):
    """A metric history, with the rows of new measurements where both have a key."""
    w = Window.partitionBy("test", "metric", "commit_", "new").orderBy(F.desc("event_id"))
    rows = tables.events(spark, d).select((F.col("user_id") % 50).alias("test"), F.col("event_type").alias("metric"), (F.col("event_id") % 7).alias("commit_"), "value", "event_id", (F.col("event_id") % 2).alias("new"))
    one = rows.withColumn("r", F.row_number().over(w)).where("r = 1")
    old, new = (one.where(F.col("new") == k).select("test", "metric", "commit_", "value") for k in (0, 1))
    return series.upserted(old, new, ["test", "metric", "commit_"])


@query("""select user_id, cast(sum(strlen(props)) as bigint) as bytes, count(*) as messages, cast(sum(event_id % 1000) as bigint) as micros,
  '{"bytes":' || cast(sum(strlen(props)) as bigint) || ',"messages":' || count(*) || ',"micros":' || cast(sum(event_id % 1000) as bigint) || '}' as json from events group by user_id""")
def transport_stats(spark, d):
    rows = tables.events(spark, d).select("user_id", F.octet_length("props").alias("bytes"), (F.col("event_id") % 1000).alias("micros"))
    return sinks.transport_stats(rows, ["user_id"])


@query("""select p_partkey, upper(p_type) as macro, trim(p_brand, '"') as bare, 'id_' || lpad(lower(hex(p_partkey)), 16, '0') as hex_name, 'snapshot_' || lpad(cast(p_partkey as varchar), 6, '0') || '.vtp' as file,
  regexp_extract(p_name, '[A-Za-z_][A-Za-z_0-9]*') as identifier from part""")
def string_names(spark, d):
    """Names as the mesh files use them: upper case, without quotes, padded numbers and hex, the first identifier."""
    key = F.col("p_partkey")
    return tables.read(spark, d, "part").select(
        "p_partkey", F.upper("p_type").alias("macro"), F.regexp_replace("p_brand", '^"+|"+$', "").alias("bare"),
        F.concat(F.lit("id_"), F.lpad(F.lower(F.hex(key)), 16, "0")).alias("hex_name"), F.concat(F.lit("snapshot_"), F.lpad(key.cast("string"), 6, "0"), F.lit(".vtp")).alias("file"),
        F.regexp_extract("p_name", "[A-Za-z_][A-Za-z_0-9]*", 0).alias("identifier"),
    )


@query("""with t as (select event_type, event_id % 4 + 1 as ranks, avg(value) as seconds from events group by 1, 2)
  select a.event_type, a.ranks, round(b.seconds / a.ranks / a.seconds, 6) as efficiency from t a join t b on a.event_type = b.event_type and b.ranks = 1""")
def scaling_efficiency(spark, d):
    timed = tables.events(spark, d).groupBy("event_type", (F.col("event_id") % 4 + 1).alias("ranks")).agg(F.avg("value").alias("seconds"))
    one = timed.where("ranks = 1").select("event_type", F.col("seconds").alias("alone"))
    return timed.join(one, "event_type").select("event_type", "ranks", F.round(F.col("alone") / F.col("ranks") / F.col("seconds"), 6).alias("efficiency"))


NODES = """n as (select user_id, event_id as idx, event_type as field, cast(substr(event_type, 1, 1) < 'p' as boolean) or value > 50 as writes, value < 60 as reads from events)"""


@query(f"""with {NODES}, s as (select *, max(case when writes then idx end) over (partition by user_id, field order by idx rows between unbounded preceding and 1 preceding) as before,
    min(case when writes then idx end) over (partition by user_id, field order by idx rows between 1 following and unbounded following) as after from n)
  select distinct user_id, 'RAW' as kind, before as earlier, idx as later from s where reads and before is not null
  union select distinct user_id, 'WAW', before, idx from s where writes and before is not null union select distinct user_id, 'WAR', idx, after from s where reads and after is not null""")
def hazards(spark, d):
    value = F.col("value")
    nodes = tables.events(spark, d).select("user_id", F.col("event_id").alias("idx"), F.col("event_type").alias("field"), ((F.substring("event_type", 1, 1) < "p") | (value > 50)).alias("writes"), (value < 60).alias("reads"))
    return series.hazards(nodes, ["user_id"])


@query("""select user_id, earlier, later from (select user_id, idx as later, level, lag(idx) over w as earlier, lag(level) over w as was from (select user_id, event_id as idx, event_id % 3 as level from events) window w as (partition by user_id order by idx))
  where was is not null and was <> level""")
def level_barriers(spark, d):
    nodes = tables.events(spark, d).select("user_id", F.col("event_id").alias("idx"), (F.col("event_id") % 3).alias("level"))
    return series.barriers(nodes, ["user_id"])


LATTICE = """v as (select cast(l_quantity as integer) % 3 - 1 as cx, l_linenumber % 3 - 1 as cy, cast(l_suppkey % 3 as integer) - 1 as cz, count(*) as n from lineitem group by 1, 2, 3)"""


@query(f"""with {LATTICE} select a.cx, a.cy, a.cz, round(a.n / (select sum(n) from v), 9) as weight, b.cx is not null as has_opposite, (select abs(sum(n) / (select sum(n) from v) - 1) <= 1e-6 from v) as valid
  from v a left join v b on b.cx = -a.cx and b.cy = -a.cy and b.cz = -a.cz""")
def opposites(spark, d):
    """Directions that line items make, their weights, and whether the opposite direction is there too."""
    got = tables.read(spark, d, "lineitem").groupBy((F.col("l_quantity").cast("int") % 3 - 1).alias("cx"), (F.col("l_linenumber") % 3 - 1).alias("cy"), ((F.col("l_suppkey") % 3).cast("int") - 1).alias("cz")).agg(F.count("*").alias("n"))
    total = got.agg(F.sum("n").alias("total"))
    there = got.select(*[(-F.col(c)).alias(c) for c in ("cx", "cy", "cz")], F.lit(True).alias("there"))
    joined = got.join(there, ["cx", "cy", "cz"], "left").crossJoin(F.broadcast(total))  # one row
    all_ = F.sum(F.col("n") / F.col("total")).over(Window.partitionBy())  # 27 rows at most
    return joined.select("cx", "cy", "cz", F.round(F.col("n") / F.col("total"), 9).alias("weight"), F.coalesce("there", F.lit(False)).alias("has_opposite"), (F.abs(all_ - 1) <= 1e-6).alias("valid"))


@query("""select vec_id, round(sqrt(list_sum(list_transform(embedding, lambda v: cast(v as double) * v))), 5) as length, round(cast(embedding[1] as double), 6) as first, len(embedding) as size, round(list_max(embedding), 6) as most from embeddings""")
def vector_fields(spark, d):
    """Vector fields as arrays: components, lengths, and element access."""
    e = F.col("embedding")
    length = F.sqrt(F.aggregate(e, F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double")))
    return tables.read(spark, d, "embeddings").select("vec_id", F.round(length, 5).alias("length"), F.round(F.get(e, F.lit(0)).cast("double"), 6).alias("first"), F.size(e).alias("size"), F.round(F.array_max(e), 6).alias("most"))


@query("""select o_custkey, count(*) filter (where o_orderstatus = 'F') as done, count(*) as n, cast(sum(cast(round(o_totalprice * 100) as bigint)) // greatest(count(*), 1) as bigint) as mean from orders group by o_custkey""")
def counters(spark, d):
    """Counters and whole means of groups."""
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    mean = F.floor(F.sum(cents) / F.greatest(F.count("*"), F.lit(1)))
    return tables.read(spark, d, "orders").groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "F").alias("done"), F.count("*").alias("n"), mean.alias("mean"))


@query(f"with {CELLS}, {ADAPTED} select (select cast(sum(mass) as bigint) from cells) as before, cast(sum(case when level = 6 then mass else 8 * mass end) as bigint) as weighted, (select cast(sum(8 * mass) as bigint) from cells) as total from adapted")
def mass_conservation(spark, d):
    cells = tables.cells(spark, d)
    before = cells.agg(F.sum("mass").alias("before"), F.sum(8 * F.col("mass")).alias("total"))
    after = mesh.adapt(cells, FIELDS).agg(F.sum(F.when(F.col("level") == 6, F.col("mass")).otherwise(8 * F.col("mass"))).alias("weighted"))
    return before.crossJoin(F.broadcast(after)).select("before", "weighted", "total")  # one row each


assert GRID == 2**LEVEL
