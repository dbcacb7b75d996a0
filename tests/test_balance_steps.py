"""A balanced cycle writes what can come two levels apart, not all cells and all their neighbours."""

import itertools
import os
import random

from pyspark.sql import functions as F

from cellweave.operators import locate, mesh
from tests.test_mesh import SCHEMA, random_mesh


def bytes_below(folder):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(folder) for f in names)


def test_a_cycle_without_merges_writes_few_bytes_a_cell(spark):
    """Cells of one level that merge nowhere: the cells twice in columns, and no neighbours."""
    n, side = 64_000, 40
    at = [(F.col("id") / side**k).cast("int") % side for k in range(3)]
    cells = spark.range(n).select(*[c.alias(x) for c, x in zip(at, "xyz", strict=True)], F.lit(5).alias("level"), F.lit(0).alias("state"), (F.hash("id") % 3 == 0).cast("int").alias("flag"), (F.hash("id") % 40).cast("long").alias("mass"))
    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before = bytes_below(folder)
    got = mesh.adapt(cells, {"mass": "volume_weighted"}, balanced=True)
    assert bytes_below(folder) - before < 40 * n  # before, states and neighbours of all cells lay there: 170 bytes a cell
    split = cells.where("flag > 0").count()
    assert {r.level: r["count"] for r in got.groupBy("level").count().collect()} == {5: n - split, 6: 8 * split}


def test_steps_are_all_neighbours_that_can_come_apart(spark, monkeypatch):
    """Against a plain search, with ranges of a few cells: no group of siblings is parted, and cells below zero are found."""
    monkeypatch.setattr(locate, "CELLS", 9)
    for seed in (2, 3):
        rng, ask = random.Random(seed), {}
        cells = []
        for x, y, z, n, *_ in random_mesh(seed):
            to = ask.setdefault((x >> 1, y >> 1, z >> 1, n), rng.choice((-1, -1, 0)))
            cells.append((x - (1 << n - 1), y, z, n, int(rng.random() < 0.02), to or int(rng.random() < 0.2), 1))
        boxes = {c[:4]: c for c in cells}
        groups = {}
        for x, y, z, n, state, flag, _ in cells:
            if flag == -1 and state == 0:
                groups.setdefault((x >> 1, y >> 1, z >> 1, n), []).append((x, y, z, n))
        merging = {c for g in groups.values() if len(g) == 8 for c in g}
        every = set()
        for x, y, z, n in boxes:
            for axis, side in itertools.product(range(3), (-1, 1)):
                p = [x, y, z]
                p[axis] += side
                every |= {((x, y, z, n), b) for m in range(n + 1) if (b := (*(c >> (n - m) for c in p), m)) in boxes}
        needed = {(a, b) for a, b in every if a[3] > b[3] or a in merging or b in merging}
        asks = F.when((F.col("flag") == -1) & (F.col("state") == 0), locate.ASKS).otherwise(0)
        rows = locate.steps(spark.createDataFrame(cells, SCHEMA), asks + F.when((F.col("state") == 0) & (F.col("level") < 8), locate.CAN).otherwise(0)).collect()
        got = {(tuple(r[:4]), tuple(r[7:11])): r for r in rows}
        assert len(got) == len(rows) and merging and len(cells) > 9 * 20
        assert needed <= set(got) <= every and len(needed) < len(every)
        assert {c for (a, b), r in got.items() for c, m in ((a, r.merging), (b, r.n_merging)) if m} == merging
        assert all(r.can == (boxes[a][4] == 0 and a[3] < 8) and r.n_can == (boxes[b][4] == 0 and b[3] < 8) and r.n_merging == (b in merging) for (a, b), r in got.items())


def test_codes_tell_cells_beyond_the_bits_of_keys():
    rng = random.Random(1)
    cells = [(*[rng.randrange(-(2**20), 2**20) for _ in range(3)], n) for n in range(9) for _ in range(20)]
    cell = locate.np.array(cells, locate.np.int64).T
    anchor = cell[:3] << (8 - cell[3])
    codes = locate.packed(cell, anchor, cell[3] % 8)
    back, corners = locate.unpacked(locate.keys_of(anchor), codes)
    assert (back == cell).all() and (corners == anchor).all() and ((codes >> locate.AT_BITS) % 8 == cell[3] % 8).all()


def test_columns_that_no_table_has_are_kept(spark):
    cells = spark.createDataFrame([(x, y, z, 1, 0, -1, 1) for x in range(2) for y in range(2) for z in range(2)], SCHEMA)
    got = mesh.adapt(cells.withColumn("nothing", F.lit(None)), {"mass": "volume_weighted"}, balanced=True).collect()
    assert [(*r[:4], r.mass, r.nothing) for r in got] == [(0, 0, 0, 0, 8, None)]
