"""Geometry on cell tables: boxes, primitives, placement of voxels, and inside tests against triangle meshes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from cellweave.functions.curves import FINEST, col


def contains(point: dict[str, Column], low: dict[str, Column], high: dict[str, Column], pad: float = 0.0) -> Column:
    """Whether a closed box, grown by ``pad``, holds a point."""
    inside = F.lit(True)
    for c in "xyz":
        inside &= col(point[c]).between(col(low[c]) - pad, col(high[c]) + pad)
    return inside


def extent(kind="kind", radius="radius", height="height", width="width", length="length", scale="scale") -> dict[str, Column]:
    """Half sizes of a primitive's box along x, y, z; meshes and expressions have unit boxes. Rotation is not applied."""
    kind, s = col(kind), col(scale)
    r, h, w, ln = (col(c) for c in (radius, height, width, length))
    half = lambda sphere, box, cylinder: F.when(kind == "sphere", sphere).when(kind == "box", box).when(kind == "cylinder", cylinder).otherwise(F.lit(0.5)) * s
    return {"x": half(r, w / 2, r), "y": half(r, h / 2, h / 2), "z": half(r, ln / 2, r)}


def inside(local: dict[str, Column], kind="kind", radius="radius", height="height", width="width", length="length") -> Column:
    """Whether a point in local coordinates is in a primitive; surfaces count."""
    x, y, z = (col(local[c]) for c in "xyz")
    r, h, w, ln = (col(c) for c in (radius, height, width, length))
    sphere = x * x + y * y + z * z <= r * r
    box = (F.abs(x) <= w / 2) & (F.abs(y) <= h / 2) & (F.abs(z) <= ln / 2)
    cylinder = (x * x + z * z <= r * r) & (F.abs(y) <= h / 2)
    return F.when(col(kind) == "sphere", sphere).when(col(kind) == "box", box).when(col(kind) == "cylinder", cylinder).otherwise(F.lit(False))


def to_local(point: dict[str, Column], shift: dict[str, Column], scale="scale") -> dict[str, Column]:
    return {c: (col(point[c]) - col(shift[c])) / col(scale) for c in "xyz"}


def valid(kind="kind", name="name", material="material_id", scale="scale", radius="radius") -> Column:
    good = (F.length(col(name)) > 0) & (col(material) > 0) & (col(scale) > 0)
    return F.coalesce(good & ((col(kind) != "sphere") | (col(radius) > 0)), F.lit(False))


def rejected(shapes: DataFrame) -> DataFrame:
    """The shapes that are not valid, with the reason; ``valid`` takes the others."""
    reason = (
        F.when(F.coalesce(F.length("name"), F.lit(0)) == 0, "no name")
        .when(~F.coalesce(F.col("material_id") > 0, F.lit(False)), "no material")
        .when(~F.coalesce(F.col("scale") > 0, F.lit(False)), "no scale")
        .when(~F.coalesce(valid(), F.lit(False)), "no radius")
    )
    return shapes.withColumn("reason", reason).where("reason is not null")


def in_order(voxels_: DataFrame) -> DataFrame:
    """Cells in output order: z, then y, then x."""
    return voxels_.orderBy("z", "y", "x")


def candidates(shapes: DataFrame, size: float = 1.0, domain: tuple[float, float] | None = None, inclusive: bool = False) -> DataFrame:
    """Each shape with every grid cell (i, j, k) that its box, clipped to the domain, touches. Cells are made along one axis
    after the other, so the rows in between stay few."""
    half = extent()
    out = shapes
    for c, name in zip("xyz", "ijk", strict=True):
        low, high = F.col(f"t{c}") - half[c], F.col(f"t{c}") + half[c]
        if domain:
            low, high = F.greatest(low, F.lit(domain[0])), F.least(high, F.lit(domain[1]))
        first, last = F.floor(low / size), F.ceil(high / size) - (0 if inclusive else 1)
        steps = F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))
        out = out.withColumn(name, F.explode(steps))
    return out


def voxels(shapes: DataFrame, size: float = 1.0, domain: tuple[float, float] | None = None) -> DataFrame:
    """Cells whose centre is in some valid shape: distinct (x, y, z) with the largest material number."""
    centre = {c: (F.col(n) + 0.5) * size for c, n in zip("xyz", "ijk", strict=True)}
    local = to_local(centre, {c: F.col(f"t{c}") for c in "xyz"})
    hit = candidates(shapes.where(valid()), size, domain).where(inside(local))
    return hit.groupBy(*[F.col(n).cast("int").alias(c) for c, n in zip("xyz", "ijk", strict=True)]).agg(F.max("material_id").alias("material_id"))


#: Cells of a shape that a task looks at together.
CELLS = 1 << 17
AXES = dict(zip("xyz", "ijk", strict=True))


def covered(shape: dict[str, np.ndarray], ends: tuple[np.ndarray, np.ndarray], size: float) -> tuple[np.ndarray, np.ndarray]:
    """Whether shapes hold the centres of all grid cells from one to another along each axis, and whether they hold none. The tests
    are those of ``inside`` at the farthest and the nearest of these places along each axis; as they only grow, no rounding differs."""
    low, high = (((e + 0.5) * size - shape["t"]) / shape["scale"] for e in ends)
    below, above = np.abs(low), np.abs(high)
    far, near = np.maximum(below, above), np.where((low <= 0) & (high >= 0), 0.0, np.minimum(below, above))

    def held(at: np.ndarray) -> np.ndarray:
        x, y, z = at
        r, h, w, ln = (shape[c] for c in ("radius", "height", "width", "length"))
        sphere, upright = x * x + y * y + z * z <= r * r, y <= h / 2
        box, cylinder = (x <= w / 2) & upright & (z <= ln / 2), (x * x + z * z <= r * r) & upright
        return np.select([shape["kind"] == "sphere", shape["kind"] == "box", shape["kind"] == "cylinder"], [sphere, box, cylinder], False)

    return held(far), ~held(near)


def descent(shape: dict[str, np.ndarray], size: float, coarsest: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Cells whose centres shapes hold, in as few cells as there are: (number of the shape, i, j and k, levels above the grid's). No
    cell with a side over the least of a shape's box lies in it, so cells that large are not looked at."""
    first, last = shape["first"], shape["last"]
    least = (last - first + 1).min(axis=0)
    top = np.minimum(np.frexp(least.astype(float))[1] - 1, coarsest)
    for up in range(coarsest, -1, -1):
        some = np.flatnonzero(top == up)
        low = first[:, some] >> up
        sides = (last[:, some] >> up) - low + 1
        until = np.cumsum(sides.prod(axis=0))
        for start in range(0, int(until[-1]) if len(some) else 0, CELLS):
            at = np.arange(start, min(start + CELLS, until[-1]))
            of = np.searchsorted(until, at, "right")
            at -= until[of] - sides[:, of].prod(axis=0)
            i, rest = at % sides[0, of], at // sides[0, of]
            cells = np.stack([i, rest % sides[1, of], rest // sides[1, of]]) + low[:, of]
            waiting = [(some[of], cells, up)]
            while waiting:
                of, cells, level = waiting.pop()
                if len(of) > CELLS:
                    waiting += [(of[n : n + CELLS], cells[:, n : n + CELLS], level) for n in range(0, len(of), CELLS)]
                    continue
                own = {c: v[..., of] for c, v in shape.items()}
                begin, end = cells << level, ((cells + 1) << level) - 1
                every, none = covered(own, (begin, end), size)
                every &= ((begin >= own["first"]) & (end <= own["last"])).all(axis=0)
                none |= ((end < own["first"]) | (begin > own["last"])).any(axis=0)
                if every.any():
                    yield of[every], cells[:, every], level
                cut = ~every & ~none
                if level and cut.any():
                    eight = np.stack([(np.arange(8) >> k) & 1 for k in range(3)])
                    children = (cells[:, cut] << 1)[:, :, None] + eight[:, None, :]
                    waiting.append((np.repeat(of[cut], 8), children.reshape(3, -1), level - 1))


def descended(shapes: DataFrame, size: float = 1.0, domain: tuple[float, float] | None = None, coarsest: int = 4, keep: list[str] | None = None) -> DataFrame:
    """Valid shapes (or those of their columns that are to be kept) with the cells whose centres they hold, in as few cells as there
    are: i, j, k and ``up``, the levels above the grid's own. Coarse cells are taken whole, left out, or cut into eight, down to the
    grid; so a shape of any size makes rows by its surface and not by its volume. No row is compared with another; shapes are
    dealt by their places and sizes, as a file of them may be one task's."""
    half, kept = extent(), [c for c in keep or shapes.columns if c not in (*AXES.values(), "up")]
    bounds = {}
    for c, n in AXES.items():
        low, high = F.col(f"t{c}") - half[c], F.col(f"t{c}") + half[c]
        if domain:
            low, high = F.greatest(low, F.lit(domain[0])), F.least(high, F.lit(domain[1]))
        bounds |= {f"__{n}_first": F.floor(low / size), f"__{n}_last": F.ceil(high / size) - 1}
    measures = {"__kind": F.col("kind")} | {f"__{c}": F.col(c).cast("double") for c in ("tx", "ty", "tz", "scale", "radius", "height", "width", "length")}
    known = F.lit(True)
    for c in "xyz":
        known &= F.col(f"t{c}").isNotNull()
    own = shapes.where(valid() & known).select(*kept, *[v.alias(c) for c, v in (measures | bounds).items()])
    for n in AXES.values():
        own = own.where(F.col(f"__{n}_last") >= F.col(f"__{n}_first"))
    parts = int(shapes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = own.repartition(parts, *[F.col(c) for c in measures], *[F.col(c) for c in kept])

    def run(batches):
        for batch in batches:
            number = lambda c: batch.column(c).to_numpy(zero_copy_only=False)  # noqa: B023, E731
            shape = {c: number(f"__{c}") for c in ("scale", "radius", "height", "width", "length")} | {"kind": np.asarray(batch.column("__kind").to_pylist(), dtype=object)}
            shape["t"] = np.stack([number(f"__t{c}") for c in AXES])
            shape |= {e: np.stack([number(f"__{n}_{e}") for n in AXES.values()]) for e in ("first", "last")}
            rest = batch.select(kept)
            for of, cells, up in descent(shape, size, coarsest):
                whole = rest.take(pa.array(of))
                yield pa.RecordBatch.from_arrays([*whole.columns, *map(pa.array, cells), pa.array(np.full(len(of), up, np.int32))], names=[*kept, *AXES.values(), "up"])

    fields = [own.schema[c] for c in kept] + [StructField(n, LongType()) for n in AXES.values()] + [StructField("up", IntegerType())]
    return own.mapInArrow(run, StructType(fields))


def placed(shapes: DataFrame, size: float = 1.0, domain: tuple[float, float] | None = None, level: int = FINEST, coarsest: int = 4) -> DataFrame:
    """Shapes as cells of mixed levels: distinct (x, y, z, level) with the largest material number; the grid is of ``level``. Cells of
    shapes that overlap may lie within each other: the material of a place is the largest of the cells that hold it."""
    got = descended(shapes, size, domain, min(coarsest, level), ["material_id"])
    cell = [F.col(n).cast("int").alias(c) for c, n in zip("xyz", "ijk", strict=True)]
    return got.groupBy(*cell, (F.lit(level) - F.col("up")).alias("level")).agg(F.max("material_id").alias("material_id"))


def finest(cells: DataFrame, level: int = FINEST) -> DataFrame:
    """The grid cells of ``placed`` cells, with the largest material number."""
    out = cells.withColumn("up", level - F.col("level"))
    for c in "xyz":
        first = F.call_function("shiftleft", F.col(c), F.col("up"))
        out = out.withColumn(c, F.explode(F.sequence(first, first + F.call_function("shiftleft", F.lit(1), F.col("up")) - 1)))
    return out.groupBy("x", "y", "z").agg(F.max("material_id").alias("material_id"))


# --- triangle meshes ---


def bounds(triangles: DataFrame, by: list[str]) -> DataFrame:
    """The box of each mesh. Triangles have ax, ay, az, bx... cz."""
    return triangles.groupBy(*by).agg(
        *[F.min(F.least(*[f"{v}{c}" for v in "abc"])).alias(f"min_{c}") for c in "xyz"],
        *[F.max(F.greatest(*[f"{v}{c}" for v in "abc"])).alias(f"max_{c}") for c in "xyz"],
    )


def crossing(y: Column, z: Column, eps: float = 1e-6) -> Column:
    """The x at which a line along x through (y, z) meets a triangle (a, b, c corners as columns); else null."""
    e1 = {c: F.col(f"b{c}") - F.col(f"a{c}") for c in "xyz"}
    e2 = {c: F.col(f"c{c}") - F.col(f"a{c}") for c in "xyz"}
    sy, sz = y - F.col("ay"), z - F.col("az")
    det = e1["z"] * e2["y"] - e1["y"] * e2["z"]
    u = (sz * e2["y"] - sy * e2["z"]) / det
    v = (sy * e1["z"] - sz * e1["y"]) / det
    return F.when(F.abs(det) > eps, F.when((u >= 0) & (v >= 0) & (u + v <= 1), F.col("ax") + u * e1["x"] + v * e2["x"]))


#: Triangles of a task, in the mean.
TRIANGLES = 100_000


def mesh_voxels(triangles: DataFrame, by: list[str], size: float = 1.0) -> DataFrame:
    """(by, x, y, z) of cells whose centre is inside its closed mesh: rays along +x that leave it an odd number of times.

    A triangle is joined with the (y, z) columns of cells it can meet, not with all cells: each triangle explodes to the
    columns of its own bounds, its crossings follow from its own plane, and only they are grouped by column of cells. Hits on
    edges that triangles share are one hit (equal places, rounded). The tasks follow the number of triangles, so that what a
    task holds does not grow with it.
    """
    parts = int(triangles.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(parts, -(-triangles.count() // TRIANGLES))
    columns = triangles.repartition(parts, *by, *[f"{v}{c}" for v in "abc" for c in "xyz"])
    for c, name in (("y", "j"), ("z", "k")):
        low, high = F.least(*[f"{v}{c}" for v in "abc"]), F.greatest(*[f"{v}{c}" for v in "abc"])
        columns = columns.withColumn(name, F.explode(F.sequence(F.floor(low / size), F.floor(high / size))))
    met = columns.select(*by, "j", "k", F.round(crossing((F.col("j") + 0.5) * size, (F.col("k") + 0.5) * size), 6).alias("at"))
    # dealt before they are grouped: no task groups the hits of one file, and negative zero is zero
    met = met.where("at is not null").withColumn("at", F.col("at") + 0.0).repartition(parts, *by, "j", "k")
    runs = met.groupBy(*by, "j", "k").agg(F.sort_array(F.collect_set("at")).alias("at"))
    first, last = F.floor(F.col("at")[0] / size), F.ceil(F.element_at("at", -1) / size)
    cells = runs.withColumn("i", F.explode(F.sequence(first, last)))
    right = F.size(F.filter("at", lambda t: t > (F.col("i") + 0.5) * size))
    return cells.where(right % 2 == 1).select(*by, F.col("i").cast("int").alias("x"), F.col("j").cast("int").alias("y"), F.col("k").cast("int").alias("z"))
