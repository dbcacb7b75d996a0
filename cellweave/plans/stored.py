"""Further registered queries: meshes, reports, profiles and traces that are written and read back, declared fields, loops."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from cellweave.functions import schema
from cellweave.operators.session import shared_folder
from cellweave.plans import tables
from cellweave.plans.catalog import ADAPTED, CELLS, FIELDS, query, with_cells
from cellweave.sources import meshes, sinks
from cellweave.streaming import steps

#: A triangle for each part, placed by its key; all numbers are exact in single precision.
FACETS = """facets as (select p_partkey as id, 0.0::double as nx, 0.0::double as ny, 1.0::double as nz, p_partkey % 97 + 0.25::double as ax, p_partkey % 89 - 0.5::double as ay, p_size + 0.0::double as az,
  p_partkey % 97 + 1.25::double as bx, p_partkey % 89 - 0.5::double as by, p_size + 0.0::double as bz, p_partkey % 97 + 0.25::double as cx, p_partkey % 89 + 0.5::double as cy, p_size + 0.0::double as cz from part)"""
#: Facets in one text file, reports in one JSON file.
PIECE = 1000


def facets(spark, d):
    x, y, z = F.col("p_partkey") % 97 + 0.25, F.col("p_partkey") % 89 - 0.5, F.col("p_size").cast("double")
    normal = [F.lit(v).alias(c) for c, v in zip(("nx", "ny", "nz"), (0.0, 0.0, 1.0), strict=True)]
    corners = [c.alias(n) for n, c in zip(meshes.CORNERS, (x, y, z, x + 1, y, z, x, y + 1, z), strict=True)]
    return tables.read(spark, d, "part").select(F.col("p_partkey").alias("id"), *normal, *corners)


def fresh(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def one_row_files(rows, path: str) -> None:
    """rows (piece, value): each in a file of its own."""
    rows.write.partitionBy("piece").text(path)


@query(f"with {FACETS} select * exclude (id) from facets")
def stl_binary(spark, d):
    """Triangles from binary STL files."""
    files = sinks.write_stl(facets(spark, d), fresh(spark, "stl"))
    return meshes.read_stl(spark, files).select("nx", "ny", "nz", *meshes.CORNERS)


@query(f"with {FACETS} select row_number() over (partition by id // {PIECE} order by id) - 1 as number, * exclude (id) from facets")
def stl_text(spark, d):
    """Triangles from text STL files, with their number in the file."""
    folder, own = fresh(spark, "stl"), facets(spark, d)
    corner = lambda v: F.concat_ws(" ", F.lit("vertex"), *[F.col(f"{v}{c}") for c in "xyz"])
    text = F.concat_ws(" ", F.lit("facet normal"), "nx", "ny", "nz", F.lit("outer loop"), *[corner(v) for v in "abc"], F.lit("endloop endfacet"))
    listed = F.transform(F.sort_array(F.collect_list(F.struct("id", text.alias("text")))), lambda r: r["text"])
    grouped = own.groupBy(F.floor(F.col("id") / PIECE).alias("piece")).agg(F.concat_ws(" ", F.lit("solid parts"), F.concat_ws(" ", listed), F.lit("endsolid parts")).alias("value"))
    one_row_files(grouped, folder)
    return meshes.read_stl(spark, folder).select("number", "nx", "ny", "nz", *meshes.CORNERS)


@query("""select p_name || p_partkey as test, 'real_time' as metric, p_retailprice as value from part union all select p_name || p_partkey, 'iterations', p_size::double from part""")
def benchmark_reports(spark, d):
    """Metrics from benchmark reports, half of them of either shape."""
    folder, part = fresh(spark, "reports"), tables.read(spark, d, "part")
    name, piece = F.concat("p_name", "p_partkey"), F.floor(F.col("p_partkey") / PIECE).alias("piece")
    one = F.struct(name.alias("name"), F.col("p_retailprice").alias("real_time"), F.col("p_size").alias("iterations"))
    listed = part.where("p_partkey % 2 = 0").groupBy(piece).agg(F.to_json(F.struct(F.collect_list(one).alias("benchmarks"))).alias("value"))
    two = F.struct(name, F.struct(F.col("p_retailprice").alias("real_time"), F.col("p_size").alias("iterations")))
    named = part.where("p_partkey % 2 = 1").groupBy(piece).agg(F.to_json(F.struct(F.map_from_entries(F.collect_list(two)).alias("tests"))).alias("value"))
    one_row_files(listed.withColumn("piece", F.concat(F.lit("a"), "piece")).unionByName(named.withColumn("piece", F.concat(F.lit("b"), "piece"))), folder)
    return meshes.read_benchmarks(spark, folder).select("test", "metric", "value")


@query("select event_id::double as coord, value from events where event_id % 10 <> 3")
def profile_file(spark, d):
    """A profile of two columns from text; lines of every tenth event are comments."""
    folder = fresh(spark, "profile")
    line = F.concat_ws("  ", F.when(F.col("event_id") % 10 == 3, "#"), "event_id", "value")
    tables.events(spark, d).select(line).write.text(folder)
    return meshes.read_profile(spark, folder)


TRACE = """select event_type as name, 'user' || user_id % 7 as cat, case when event_id % 3 = 0 then 'X' else 'B' end as ph, event_id * 10 as ts, case when event_id % 3 = 0 then event_id % 1000 end as dur, user_id % 4 as pid, user_id as tid from events"""


@query(TRACE)
def trace_arrays(spark, d):
    """Trace events from files of JSON arrays; only complete ones have a duration."""
    folder, key, user = fresh(spark, "trace"), F.col("event_id"), F.col("user_id")
    own = tables.events(spark, d).select(
        F.col("event_type").alias("name"), F.concat(F.lit("user"), user % 7).alias("cat"), F.when(key % 3 == 0, "X").otherwise("B").alias("ph"), (key * 10).alias("ts"),
        (key % 1000).alias("dur"), (user % 4).alias("pid"), user.alias("tid"),
    )
    sinks.write_trace_arrays(own, folder, 5000)
    shape = "name string, cat string, ph string, ts long, dur long, pid long, tid long"
    return spark.read.schema(shape).option("recursiveFileLookup", "true").json(folder, multiLine=True)


@query("""with n as (select cast(ceil(sqrt(count(*))) as bigint) as n from supplier), g as (select i, i % n as x, (i // n) % n as y, i // (n * n) as z, n from n, range(n * n * n) r(i))
  select x::integer as x, y::integer as y, z::integer as z, 0 as level, 0 as state, (x between (n - 1) // 2 and n // 2 and y between (n - 1) // 2 and n // 2 and z between (n - 1) // 2 and n // 2)::integer as flag, 0 as material_id from g""")
def base_mesh(spark, d):
    """A base mesh as wide as the root of the count of suppliers; cells in the middle are flagged."""
    n = tables.read(spark, d, "supplier").select(F.ceil(F.sqrt(F.count("*"))).alias("n")).first()["n"]
    return meshes.base_grid(spark, int(n))


@query("""with n as (select count(*) as nz from supplier) select i as id, i % 5 / 5 as x, i // 5 % 25 / 25 as y, (i // 125) / nz as z, (i % 5 / 5 + i // 5 % 25 / 25 * ((i // 125) / nz))::float as value from n, range(125 * nz) r(i)""")
def analytic_grid(spark, d):
    """A formula on a grid of regions, nations and suppliers."""
    shape = tuple(tables.read(spark, d, t).count() for t in ("region", "nation", "supplier"))
    return meshes.analytical_grid(spark, shape, lambda x, y, z: x + y * z)


# --- declared fields and loops ---


def declared() -> schema.Fields:
    fields = schema.Fields()
    for f in (schema.Field("rho", "double", default=(1.5,)), schema.Field("u", "float", 3), schema.Field("mass", "long", rule="volume_weighted"), schema.Field("kind", "uint8", default=(7,))):
        fields.add(f)
    return fields


@query(with_cells("select x, y, z, mass, 1.5::double as rho, 0.0::float as u2, 3::bigint as components, 7 as kind from cells"))
def fields_filled(spark, d):
    """Declared fields that the cells lack, filled by their defaults or zero; fields are bound by name."""
    fields = declared()
    cells = fields.filled(tables.cells(spark, d))
    mass, rho = fields.bound(cells, ["mass", "rho"])
    return cells.select("x", "y", "z", mass, rho, F.get("u", F.lit(2)).alias("u2"), F.size("u").cast("long").alias("components"), F.col("kind").cast("int").alias("kind"))


@query(with_cells("select cast(sum(ceil(b * n / 64.0) * 64) as bigint) as bytes, any_value(n) as n from (select count(*) as n from cells), (values (8), (12), (8), (1)) v(b)"))
def field_memory(spark, d):
    """What declared fields of all cells take, padded."""
    n = tables.cells(spark, d).count()
    return spark.range(1).select(F.lit(declared().memory(n)).cast("long").alias("bytes"), F.lit(n).cast("long").alias("n"))


@query("""select p_partkey as id, lpad(lower(hex(list_reduce(list_prepend(14695981039346656037::hugeint, list_transform(string_split(p_name, ''), lambda c: ascii(c)::hugeint)), lambda h, b: (xor(h, b) * 1099511628211) % 18446744073709551616)::ubigint)), 16, '0') as hash from part""")
def name_hashes(spark, d):
    """Names' 64-bit hashes; the given names are ASCII."""

    @F.arrow_udf("long")
    def hashed(names: pa.Array) -> pa.Array:
        return pa.array(schema.fnv1a_all(names).view(np.int64), mask=names.is_null().to_numpy(zero_copy_only=False))

    return tables.read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.lower(F.lpad(F.hex(hashed("p_name")), 16, "0")).alias("hash"))


@query(with_cells("""select x, y, z, mass * (1 << t) as mass, t from cells, (select cast(greatest(0, ceil(log2(1000.0 / min(mass)))) as integer) as t from cells)"""))
def while_loop(spark, d):
    """A kernel that doubles a field, as long as any cell is below a bound."""
    double = lambda cells, t: schema.kernel(cells, {"mass": F.col("mass") * 2})
    cells, t = steps.repeated_while(tables.cells(spark, d), [double], F.min("mass") < 1000, 20)
    return cells.select("x", "y", "z", "mass", F.lit(t).alias("t"))


@query(f"""with {CELLS.replace("cells as", "raw as")}, cells as (select * replace (mass + 3 as mass) from raw), {ADAPTED} select * from adapted""")
def loop_adapts(spark, d):
    """Two steps of a kernel that adds the step's number, and an adaptation after every second step."""
    kernel = lambda cells, t: schema.kernel(cells, {"mass": F.col("mass") + t})
    return steps.time_loop(tables.cells(spark, d), 2, [kernel], adapt_every=2, fields=FIELDS)
