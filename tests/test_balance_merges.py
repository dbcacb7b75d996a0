"""Balanced cycles with splits, merges and solid cells on random meshes; point location against a plain search."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from cellweave.operators import locate, mesh
from tests.test_mesh import SCHEMA, random_mesh, table


def apart(cells):
    """Face neighbours that are two levels apart or more."""
    boxes, bad = {tuple(c[:4]) for c in cells}, 0
    for x, y, z, n in boxes:
        for axis, side in itertools.product(range(3), (-1, 1)):
            p = [x, y, z]
            p[axis] += side
            bad += any((*(c >> (n - m) for c in p), m) in boxes for m in range(n - 1))
    return bad


def volume(cells):
    return sum(8 ** (8 - c[3]) for c in cells)


def test_a_merge_beside_a_split_is_vetoed(spark):
    octet = lambda x0, flag: [(x0 + (i & 1), i >> 1 & 1, i >> 2 & 1, 5, 0, flag, 1) for i in range(8)]
    got = [tuple(r) for r in mesh.adapt(table(spark, octet(0, -1) + octet(2, 1)), {"mass": "volume_weighted"}, balanced=True).collect()]
    assert apart(got) == 0 and sorted({r[3] for r in got}) == [5, 6] and len(got) == 8 + 64
    got = mesh.adapt(table(spark, octet(0, -1) + octet(4, 1)), {"mass": "volume_weighted"}, balanced=True).collect()
    assert sorted({r.level for r in got}) == [4, 6] and len(got) == 1 + 64  # they do not touch


def test_a_veto_goes_on_to_the_next_group(spark):
    """Level 6 splits beside level 5, which is raised; the level-5 group beside that was to merge."""
    fine = [(i & 1, i >> 1 & 1, i >> 2 & 1, 6, 0, 1, 1) for i in range(8)]
    beside = [(1 + (i & 1), i >> 1 & 1, i >> 2 & 1, 5, 0, -1 if i else 0, 1) for i in range(8)]  # no whole group: x is 1 and 2
    group = [(2 + (i & 1), i >> 1 & 1, i >> 2 & 1, 5, 0, -1, 1) for i in range(8)]
    rows = {tuple(r[:4]): r for r in fine + [b for b in beside if b[0] == 1] + group}
    got = [tuple(r) for r in mesh.adapt(table(spark, list(rows.values())), {"mass": "volume_weighted"}, balanced=True).collect()]
    assert apart(got) == 0 and (1, 0, 0, 4) not in {r[:4] for r in got}


def test_splits_beside_solid_cells_are_given_up(spark):
    rows = [(0, 0, 0, 1, 1, 0, 1)] + [(2 + (i & 1), i >> 1 & 1, i >> 2 & 1, 2, 0, 1, 1) for i in range(8)]
    got = [tuple(r) for r in mesh.adapt(table(spark, rows), {"mass": "volume_weighted"}, balanced=True).collect()]
    assert apart(got) == 0 and {r[3] for r in got if r[0] == 2 and r[3] == 2} == {2} and any(r[3] == 3 for r in got)


@pytest.mark.parametrize("seed", [1])
def test_random_meshes_stay_balanced(spark, seed):
    rng, rows = random.Random(seed), [(*c[:4], 0, 0, 1) for c in random_mesh(seed, 4)]
    assert apart(rows)
    rows = [tuple(r) for r in mesh.adapt(table(spark, rows), {"mass": "volume_weighted"}, balanced=True).collect()]
    assert apart(rows) == 0 and volume(rows) == 8**8
    for _ in range(2):
        ask = {}
        marked = []
        for x, y, z, n, *_ in rows:
            to = ask.setdefault((x >> 1, y >> 1, z >> 1, n), rng.choice((-1, -1, 0, 2)))
            marked.append((x, y, z, n, int(rng.random() < 0.03), -1 if to == -1 else int(rng.random() < 0.2), 1))
        merged = {r for r in mesh.merge(table(spark, marked), {"mass": "volume_weighted"}).select("x", "y", "z", "level").collect()}
        rows = [tuple(r) for r in mesh.adapt(spark.createDataFrame(marked, SCHEMA), {"mass": "volume_weighted"}, balanced=True).collect()]
        assert apart(rows) == 0 and volume(rows) == 8**8 and len({r[:4] for r in rows}) == len(rows)
        assert merged and {tuple(m) for m in merged} & {r[:4] for r in rows}  # some groups merge


def test_points_find_their_cells(spark):
    rng, cells = random.Random(5), [(x - (1 << n - 1), y, z, n, *r) for x, y, z, n, *r in random_mesh(4)]  # half the coordinates are negative
    boxes = {tuple(c[:4]) for c in cells}
    points = [(i, rng.randrange(-200, 300), rng.randrange(-9, 265), rng.randrange(256)) for i in range(500)] + [(900 + i, -100, 3, 3) for i in range(50)] + [(990, None, 1, 1), (991, 1, 1, None)]

    def plain(p):
        if None in p[1:]:
            return (None,) * 4
        return next(((*(c >> (8 - n) for c in p[1:]), n) for n in range(9) if (*(c >> (8 - n) for c in p[1:]), n) in boxes), (None,) * 4)

    df = spark.createDataFrame(points, "key long, px int, py int, pz int").withColumn("cell", F.lit("clash"))
    got = locate.cells_of(spark.createDataFrame(cells, SCHEMA), df)
    assert got.columns == ["key", "px", "py", "pz", "cell", *locate.FOUND]
    assert sorted((r[0], *r[5:]) for r in got.collect()) == sorted((p[0], *plain(p)) for p in points)
    assert locate.cells_of(spark.createDataFrame([], SCHEMA), df).where("n_level is not null").count() == 0


def test_six_rows_a_cell_move_whatever_the_levels(spark):
    cells = table(spark, random_mesh(6))
    plan = mesh.probed(cells, "state")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") == 1 and "Join" not in plan


def test_a_mesh_in_balance_takes_no_round(spark, monkeypatch):
    """Where no cell gives way, the state is not written anew, and neighbours are not counted once more."""
    from cellweave.operators import mesh

    written, checkpointed = [], mesh.checkpointed
    monkeypatch.setattr(mesh, "checkpointed", lambda df: written.append(df.columns) or checkpointed(df))
    rows = [(x, y, z, 5, 0, int(x == 0), 1) for x in range(2) for y in range(2) for z in range(2)]
    cells, left = mesh.decided(spark.createDataFrame(rows, "x int, y int, z int, level int, state int, flag int, mass long"), 8, 1)
    assert left == 0 and sorted(map(tuple, cells.collect())) == sorted(rows)
    assert sum("changed" in c and "will" in c for c in written) == 2  # the state once, and those that give way: none
