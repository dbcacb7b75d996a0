"""Point location in meshes of mixed levels: the cell that holds a point is the last one whose anchor's key is not beyond it.

Z-order keys of anchors sort a mesh without overlaps so that every cell's keys are one run. A point's cell is therefore its
predecessor among the anchors, whatever the number of levels: one row a point, and no probe for each level. Cells and points
are dealt to the same key ranges; each range begins with an anchor, so that no point's predecessor lies in another range.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StructField, StructType

from cellweave.functions import curves
from cellweave.operators.partition_bounds import key_bounds, place_in
from cellweave.operators.session import unused

CELL = ["x", "y", "z", "level"]
#: Keys take all bits of a coordinate, its sign too.
BITS = 21
POINT = ["px", "py", "pz"]
FOUND = ["nx", "ny", "nz", "n_level"]


def anchor_key() -> Column:
    return curves.morton(*[curves.anchor(c) for c in "xyz"], bits=BITS)


def holds(cell: Column, point: dict[str, Column]) -> Column:
    """Whether a cell (a struct of x, y, z, level) holds a point in units of the finest level."""
    inside = cell.isNotNull()
    for c in "xyz":
        inside &= F.call_function("shiftright", point[c], F.lit(curves.FINEST) - cell["level"]) == cell[c]
    return inside


def located(cells: DataFrame, points: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """Points (px, py, pz in units of the finest level, as integers) with nx, ny, nz and n_level of the cell that holds each, and
    ``n_`` and its name for each further column of cells that is asked for; null where no cell holds the point. Cells must not
    overlap, and are read twice: give a stored table.

    Every point is a row that moves; where many may share a place, ``cells_of`` asks once for each.
    """
    names = {n: unused(n, points) for n in ("range", "key", "cell", "last")}
    part, key, cell, last = names.values()
    here = cells.select(*CELL, *also, anchor_key().alias(key))
    bounds = key_bounds(here, key)
    empty = [F.lit(None).cast(t).alias(c) for c, t in points.dtypes]
    own = here.select(*empty, F.col(key), F.struct(*CELL, *also).alias(cell))
    asked = points.select(*points.columns, curves.morton(*POINT, bits=BITS).alias(key), F.lit(None).cast(own.schema[cell].dataType).alias(cell))
    spread = F.when(F.col(key).isNull(), -1 - F.spark_partition_id()).otherwise(place_in(F.col(key), bounds))  # no place: no cell
    # of equal keys the cell comes first
    before = Window.partitionBy(part).orderBy(F.col(key), F.col(cell).isNull()).rowsBetween(Window.unboundedPreceding, 0)
    seen = own.unionByName(asked).withColumn(part, spread).withColumn(last, F.last(cell, ignorenulls=True).over(before))
    found = F.when(holds(F.col(last), {c: F.col(f"p{c}") for c in "xyz"}), F.col(last))
    got = seen.where(F.col(cell).isNull()).withColumn(last, found)
    return got.select(*points.columns, *[F.col(last)[c].alias(n) for c, n in zip(CELL, FOUND, strict=True)], *[F.col(last)[c].alias(f"n_{c}") for c in also])


def cells_of(cells: DataFrame, points: DataFrame) -> DataFrame:
    """The same, asked once for each place: copies of a place are one row before anything is compared."""
    found = located(cells, points.select(*POINT).distinct())
    found = found.toDF(*[unused(f"of_{c}", points) for c in POINT], *FOUND)
    on = [F.col(p).eqNullSafe(F.col(q)) for p, q in zip(POINT, found.columns, strict=False)]
    return points.join(found, on, "left").select(*points.columns, *FOUND)


# --- neighbours beyond faces ---

#: Cells of a range.
CELLS = 500_000
#: Of each face: its axis, and whether it is the upper one.
FACES = [(axis, side) for axis in range(3) for side in (False, True)]
#: Shifts and masks that move the bits of a coordinate two places apart.
APART = [(32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249)]


def keys_of(points: np.ndarray) -> np.ndarray:
    """Z-order keys of points (one column each): those of ``curves.morton`` with 21 bits."""
    out = np.zeros(points.shape[1], np.int64)
    for k, c in enumerate(points):
        c = c & ((1 << BITS) - 1)
        for by, mask in APART:
            c = (c | (c << by)) & mask
        out |= c << k
    return out


def corners_of(batch: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Of cells: x, y, z and level, and the anchors."""
    cell = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in CELL])
    return cell, cell[:3] << (curves.FINEST - cell[3])


def beyond(cell: np.ndarray, anchor: np.ndarray, face: int) -> np.ndarray:
    """A point beyond a face of each cell: the anchor, moved by one finest unit below or by the cell's size above."""
    axis, above = FACES[face]
    point = anchor.copy()
    point[axis] += (np.int64(1) << (curves.FINEST - cell[3])) if above else -1
    return point


def neighbours(cells: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """x, y, z, level, the further columns of cells that are asked for, face, and what ``located`` finds for the point beyond that face;
    no row where no cell holds it. Cells must not overlap, and are read three times: give a stored table.

    A cell moves once, to its range of keys, where those of its points are looked up that lie in it; only points of other
    ranges are rows. Ranges follow the number of cells, so that what a task holds does not grow with it.
    """
    own = cells.select(*CELL, *also).na.drop(subset=CELL)
    parts = max(int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-own.count() // CELLS))

    def keyed(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(keys_of(corners_of(batch)[1]))], names=["key"])

    bounds = np.array(key_bounds(own.select(*CELL).mapInArrow(keyed, "key long"), "key", parts), np.int64)
    part, face = unused("range", own), unused("face", own)

    def asked(batches):
        for batch in batches:
            cell, anchor = corners_of(batch)
            home = np.searchsorted(bounds, keys_of(anchor), "right")
            rows, to, of = [np.arange(len(home))], [home], [np.full(len(home), -1)]
            for f in range(6):
                there = np.searchsorted(bounds, keys_of(beyond(cell, anchor, f)), "right")
                away = np.flatnonzero(there != home)
                rows, to, of = [*rows, away], [*to, there[away]], [*of, np.full(len(away), f)]
            at = np.concatenate(rows)
            by = np.argsort(at, kind="stable")
            ends = np.append(0, np.cumsum(np.bincount(at, minlength=len(home)))).astype(np.int32)
            each = pa.StructArray.from_arrays([pa.array(np.concatenate(x)[by].astype(np.int32)) for x in (to, of)], names=["to", "of"])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(ends), each)], names=[*batch.schema.names, part])

    def looked_up(batches):
        held = list(batches)
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        cell, anchor = corners_of(table)
        of, home = table.column(face).to_numpy(), table.column(part).to_numpy()
        here = np.flatnonzero(of < 0)
        keys = keys_of(anchor[:, here])
        by = np.argsort(keys, kind="stable")
        here, keys = here[by], keys[by]
        for f in range(6):
            rows = np.concatenate([here, np.flatnonzero(of == f)])
            point = beyond(cell[:, rows], anchor[:, rows], f)
            key = keys_of(point)
            mine = np.searchsorted(bounds, key, "right") == home[rows]
            rows, point, key = rows[mine], point[:, mine], key[mine]
            at = np.searchsorted(keys, key, "right") - 1
            last = here[np.maximum(at, 0)] if len(here) else np.zeros(0, np.int64)
            if not len(last):
                continue
            holds_ = (at >= 0) & ((point >> (curves.FINEST - cell[3, last])) == cell[:3, last]).all(axis=0)
            rows, last = rows[holds_], last[holds_]
            for n in range(0, len(rows), 100_000):
                left, right = (table.select([*CELL, *also]).take(pa.array(x[n : n + 100_000])).combine_chunks() for x in (rows, last))
                columns = [c.combine_chunks() for c in left.columns] + [pa.array(np.full(left.num_rows, f, np.int32))] + [c.combine_chunks() for c in right.columns]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    fields = {f.name: f.dataType for f in own.schema}
    names = [*CELL, *also, "face", *FOUND, *[f"n_{c}" for c in also]]
    types = [*[fields[c] for c in (*CELL, *also)], IntegerType(), *[fields[c] for c in (*CELL, *also)]]
    sent = ArrayType(StructType([StructField("to", IntegerType()), StructField("of", IntegerType())]))
    each = own.mapInArrow(asked, StructType([*own.schema.fields, StructField(part, sent)])).withColumn(part, F.explode(part))
    dealt = each.select(*CELL, *also, F.col(part)["to"].alias(part), F.col(part)["of"].alias(face))
    return dealt.repartitionById(parts, F.col(part)).mapInArrow(looked_up, StructType([StructField(n, t) for n, t in zip(names, types, strict=True)]))


# --- neighbours that decisions may set two levels apart ---

#: The way back.
TOGETHER = [(by, mask) for (by, _), mask in zip(reversed(APART), [m for _, m in reversed(APART[:-1])] + [(1 << BITS) - 1], strict=True)]
#: Bits of a cell that travel with it: whether it asks to merge, splits, and can split.
ASKS, SPLITS, CAN = 1, 2, 4
#: Of a cell's code: the places of its level's, those bits', the face's and the coordinates' further bits.
AT_BITS, AT_FACE, AT_HIGH = 8, 11, 14
HIGH = 16
#: Columns of ``steps``.
MAY = ["can", "splits", "merging"]


def packed(cell: np.ndarray, anchor: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """All of a cell that its key does not tell, in one number; bits of coordinates beyond the key's too."""
    code = cell[3] | (bits << AT_BITS)
    for k, c in enumerate(anchor):
        code |= ((c >> BITS) & ((1 << HIGH) - 1)) << (AT_HIGH + HIGH * k)
    return code


def unpacked(keys: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """x, y, z and level, and anchors, of keys and codes."""
    anchor = np.empty((3, len(keys)), np.int64)
    for k in range(3):
        c = (keys >> k) & APART[-1][1]
        for by, mask in TOGETHER:
            c = (c | (c >> by)) & mask
        high = codes << (64 - AT_HIGH - HIGH * (k + 1)) >> (64 - HIGH)  # with its sign
        anchor[k] = c | (high << BITS)
    level = codes & 255
    return np.concatenate([anchor >> (curves.FINEST - level), level[None]]), anchor


def whole_groups(keys: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Which cells, in order of their keys, are of eight siblings that all ask to merge: these follow each other."""
    merging, n = np.zeros(len(keys), bool), len(keys) - 7
    if n <= 0:
        return merging
    level = codes & 255
    size = 3 * (curves.FINEST - level)
    child, parent = (keys >> size) & 7, keys >> (size + 3)
    asks, high = (codes >> AT_BITS) & ASKS != 0, codes >> AT_HIGH
    first = asks[:n] & (child[:n] == 0)
    for k in range(1, 8):
        first &= asks[k : n + k] & (child[k : n + k] == k)
        for same in (level, parent, high):
            first &= same[k : n + k] == same[:n]
    for k in range(8):
        merging[k : n + k] |= first
    return merging


def steps(cells: DataFrame, bits: Column) -> DataFrame:
    """Of all face neighbours, the pairs that splits and merges can set two levels apart: a cell and a coarser one, or two of one level
    of which one is to merge with its siblings. x, y, z, level, can, splits, merging, and the same of the neighbour beside it,
    which is not finer (nx, ny, nz, n_level, n_can, n_splits, n_merging). Two cells of one level that do not merge cannot come two
    levels apart, so that nothing is lost, and what is written follows the steps of the mesh, not its cells.

    ``bits`` tells of each cell whether it asks to merge, splits and can split. ``merging`` is null where the task did not see
    a cell's siblings; every merging cell is seen with them at least once. Cells must not overlap, and are read three
    times: give a stored table.

    A cell moves once, as two numbers, to its range of keys. Ranges begin where the parent of a cell does: none parts eight
    siblings, and none parts a cell from a point in it, as a cell that reached over the bound would hold that parent.
    """
    own = cells.select(*CELL, bits.cast("int").alias("bits")).na.drop(subset=CELL)
    n = max(int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-own.count() // CELLS))

    def of_parents(batches):
        for batch in batches:
            cell, anchor = corners_of(batch)
            up = 3 * (curves.FINEST - cell[3] + 1)
            yield pa.RecordBatch.from_arrays([pa.array(keys_of(anchor) >> up << up)], names=["key"])

    bounds = np.array(key_bounds(own.select(*CELL).mapInArrow(of_parents, "key long"), "key", n), np.int64)

    def asked(batches):
        for batch in batches:
            cell, anchor = corners_of(batch)
            keys = keys_of(anchor)
            codes = packed(cell, anchor, batch.column("bits").to_numpy().astype(np.int64))
            home = np.searchsorted(bounds, keys, "right")
            rows, to, faces = [np.arange(len(home))], [home], [np.zeros(len(home), np.int64)]
            for f in range(6):
                there = np.searchsorted(bounds, keys_of(beyond(cell, anchor, f)), "right")
                away = np.flatnonzero(there != home)
                rows, to, faces = [*rows, away], [*to, there[away]], [*faces, np.full(len(away), f + 1)]
            at = np.concatenate(rows)
            columns = [np.concatenate(to).astype(np.int32), keys[at], codes[at] | (np.concatenate(faces) << AT_FACE)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["range", "key", "code"])

    def looked_up(batches):
        held = list(batches)
        if not held:
            return
        home, key, code = (np.concatenate([b.column(c).to_numpy() for b in held]) for c in ("range", "key", "code"))
        held.clear()
        by = np.argsort(key, kind="stable")
        home, key, code = home[by], key[by], code[by]
        face = (code >> AT_FACE) & 7
        code ^= face << AT_FACE
        here = np.flatnonzero(face == 0)
        if not len(here):
            return
        cell, anchor = unpacked(key, code)
        keys, bits = key[here], code >> AT_BITS & 7
        merging = np.zeros(len(key), bool)
        merging[here] = whole_groups(keys, code[here])
        may = np.where(face == 0, merging, bits & ASKS != 0)
        for f in range(6):
            rows = np.flatnonzero((face == 0) | (face == f + 1))
            point = beyond(cell[:, rows], anchor[:, rows], f)
            there = keys_of(point)
            mine = np.searchsorted(bounds, there, "right") == home[rows]
            rows, point, there = rows[mine], point[:, mine], there[mine]
            at = np.searchsorted(keys, there, "right") - 1
            last = here[np.maximum(at, 0)]
            level, n_level = cell[3, rows], cell[3, last]
            step = (at >= 0) & ((level > n_level) | ((level == n_level) & (may[rows] | merging[last])))
            step &= ((point >> (curves.FINEST - n_level)) == cell[:3, last]).all(axis=0)
            rows, last = rows[step], last[step]
            for k in range(0, len(rows), 100_000):
                columns = []
                for x in (rows[k : k + 100_000], last[k : k + 100_000]):
                    columns += [pa.array(c.astype(np.int32)) for c in cell[:, x]]
                    columns += [pa.array(bits[x] & CAN != 0), pa.array(bits[x] & SPLITS != 0), pa.array(merging[x], mask=face[x] != 0)]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    names = [*CELL, *MAY, *FOUND, *[f"n_{c}" for c in MAY]]
    types = [BooleanType() if c.removeprefix("n_") in MAY else IntegerType() for c in names]
    dealt = own.mapInArrow(asked, "range int, key long, code long").repartitionById(n, F.col("range"))
    return dealt.mapInArrow(looked_up, StructType([StructField(c, t) for c, t in zip(names, types, strict=True)]))
