import itertools
import random

import pytest
from pyspark.sql import functions as F

from cellweave.functions import curves
from cellweave.operators import locate, mesh

SCHEMA = "x int, y int, z int, level int, state int, flag int, mass long"


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_one_flagged_cell_has_eight_children(spark):
    got = mesh.split(table(spark, [(0, 0, 0, 0, 0, 1, 5), (1, 0, 0, 0, 1, 1, 5), (2, 0, 0, 8, 0, 1, 5)])).collect()
    assert sorted((r.x, r.y, r.z) for r in got) == sorted(itertools.product((0, 1), repeat=3))
    assert {(r.level, r.flag, r.mass) for r in got} == {(1, 0, 5)}


OCTET = [(i & 1, i >> 1 & 1, i >> 2 & 1, 1, 0, -1, i) for i in range(8)]


def test_eight_siblings_have_one_parent(spark):
    got = mesh.merge(table(spark, OCTET), {"mass": "volume_weighted"}).collect()
    assert [(r.x, r.y, r.z, r.level, r.mass) for r in got] == [(0, 0, 0, 0, 28)]
    assert mesh.merge(table(spark, OCTET[:7]), {}).count() == 0
    assert mesh.merge(table(spark, [(*r[:3], 0, *r[4:]) for r in OCTET]), {}).count() == 0  # level 0 has no parents


def test_split_and_merge_is_a_cycle(spark):
    once = mesh.adapt(table(spark, [(0, 0, 0, 0, 0, 1, 8)]), {"mass": "arithmetic"})
    assert once.count() == 8
    back = mesh.adapt(once.withColumn("flag", F.lit(-1)), {"mass": "arithmetic"}).collect()
    assert [(r.x, r.y, r.z, r.level, r.flag, r.mass) for r in back] == [(0, 0, 0, 0, 0, 8.0)]


def test_cells_that_cannot_split_or_merge_stay(spark):
    rows = [(0, 0, 0, 1, 1, 1, 1), (3, 3, 3, 8, 0, 1, 2), (4, 4, 4, 2, 0, -1, 3)]
    got = mesh.adapt(table(spark, rows), {}).collect()
    assert sorted((r.x, r.level, r.flag) for r in got) == [(0, 1, 0), (3, 8, 0), (4, 2, 0)]


def test_unknown_rule():
    with pytest.raises(ValueError):
        mesh.rule("harmonic")


def random_mesh(seed, deepest=5):
    """A mesh without gaps or overlaps: cells split at random from one root octet, level 1 to 5 or ``deepest``."""
    rng = random.Random(seed)
    cells, todo = [], [(x, y, z, 1) for x, y, z in itertools.product((0, 1), repeat=3)]
    while todo:
        x, y, z, level = todo.pop()
        if level < deepest and rng.random() < (0.75 if level < 3 else 0.3):
            todo += [(2 * x + i, 2 * y + j, 2 * z + k, level + 1) for i, j, k in itertools.product((0, 1), repeat=3)]
        else:
            cells.append((x, y, z, level, int(rng.random() < 0.1), int(rng.random() < 0.1), 1))
    return cells


def plain_round(cells):
    """The 2:1 rule over face neighbours, cell by cell."""
    boxes = {(x, y, z, n): (state, flag) for x, y, z, n, state, flag, _ in cells}
    out = dict(boxes)
    for (x, y, z, n), (_, flag) in boxes.items():
        will = n + (flag > 0)
        for axis, side in itertools.product(range(3), (-1, 1)):
            p = [x, y, z]
            p[axis] += side
            for m in range(n, -1, -1):
                near = (*(c >> (n - m) for c in p), m)
                if near in boxes:
                    s, f = boxes[near]
                    if will >= m + (f > 0) + 2 and s == 0 and m < 8 and f <= 0:
                        out[near] = (s, 1)
    return sorted((*k, *v) for k, v in out.items())


@pytest.mark.parametrize("seed", [1, 2])
def test_balance_equals_a_plain_model(spark, seed):
    cells = random_mesh(seed)
    expected, now = None, cells
    while expected is None or [r for r in expected] != [(*r[:4], *r[4:6]) for r in sorted(now)]:
        if expected is not None:
            now = [(*r, 1) for r in expected]
        expected = plain_round(now)
    got, settled = mesh.balance(table(spark, cells))
    assert settled and sorted((r.x, r.y, r.z, r.level, r.state, r.flag) for r in got.collect()) == expected
    again, _ = mesh.balance(got)
    assert again.where("flag > 0").count() == got.where("flag > 0").count()


def test_balance_pair(spark):
    # a level-1 cell beside a level-3 one: anchors (0, 0, 0) and (128, 0, 0)
    got, settled = mesh.balance(table(spark, [(0, 0, 0, 1, 0, 0, 1), (4, 0, 0, 3, 0, 0, 1)]))
    assert settled and sorted((r.level, r.flag) for r in got.collect()) == [(1, 1), (3, 0)]


def test_adaptation_keeps_volume_and_never_overlaps(spark):
    cells = table(spark, [(*r[:5], 1 if r[5] else -1, 1) for r in random_mesh(3)])
    got = mesh.adapt(cells, {}).collect()
    volume = lambda rows: sum(8 ** (8 - r.level) for r in rows)
    assert volume(got) == volume(cells.collect()) == 8**8
    assert len({(r.x, r.y, r.z, r.level) for r in got}) == len(got)


@pytest.mark.parametrize("bits", [1, 2, 3])
def test_hilbert_curve_is_one_walk_by_faces(spark, bits):
    n = 1 << bits
    at = spark.range(n**3).select((F.col("id") % n).cast("int").alias("x"), (F.floor(F.col("id") / n) % n).cast("int").alias("y"), F.floor(F.col("id") / n**2).cast("int").alias("z"))
    rows = sorted(at.select(curves.hilbert(bits=bits).alias("key"), "x", "y", "z", curves.hilbert_cell(curves.hilbert(bits=bits), bits).alias("back")).collect())
    assert [r.key for r in rows] == list(range(n**3)) and (rows[0].x, rows[0].y, rows[0].z) == (0, 0, 0)
    assert all(abs(a.x - b.x) + abs(a.y - b.y) + abs(a.z - b.z) == 1 for a, b in zip(rows, rows[1:]))
    assert all(tuple(r.back) == (r.x, r.y, r.z) for r in rows)


def test_parent_keys_are_prefixes(spark):
    at = spark.createDataFrame([(random.Random(i).randrange(256), i * 7 % 256, i * 31 % 256) for i in range(200)], "x int, y int, z int")
    up = [curves.parent(c) for c in "xyz"]
    for code in (curves.hilbert, curves.morton):
        assert at.where(code(*up, bits=7) != curves.parent_key(code(bits=8))).count() == 0


def test_valid_cells_and_keys(spark):
    rows = spark.createDataFrame([(10, 20, 30, 5), (0, 0, 0, 9), (2**22, 0, 0, 5)], "x int, y int, z int, level int")
    assert [r[0] for r in rows.select(curves.valid_cell()).collect()] == [True, False, False]
    keys = spark.createDataFrame([(7, 1), (8, 1), (-1, 1), (None, 1), (123, 5)], "key long, level int")
    assert [r[0] for r in keys.select(curves.valid_key("key", "level")).collect()] == [True, False, False, False, True]


def test_capacities():
    for n in (10, 100, 1000, 10_000, 10**7):
        c = curves.capacity(n)
        assert c & (c - 1) == 0 and c >= n / 0.6


def test_compaction(spark):
    rows = [(i * 100, i % 2) for i in range(10)]
    got = {r.key: r.place for r in mesh.permutation(spark.createDataFrame(rows, "key long, state int"), "key", F.col("state") == 1).collect()}
    assert [got[100], got[300], got[500]] == [0, 1, 2] and got[0] is got[200] is None
    got = mesh.permutation(spark.createDataFrame([(k, 1) for k in (100, 50, 200, 25)], "key long, state int"), "key", F.col("state") == 1)
    assert {r.key: r.place for r in got.collect()} == {100: 2, 50: 1, 200: 3, 25: 0}
    got = mesh.permutation(spark.createDataFrame([(k, 0) for k in (100, 200)], "key long, state int"), "key", F.col("state") == 1)
    assert {r.place for r in got.collect()} == {None}


def test_neighbours_on_ranges_of_any_size(spark, monkeypatch):
    """Cells move once, to ranges that follow their number; what lies beyond a face is what point location finds there."""
    rng = random.Random(4)
    rows, waiting = [], [(x - 1, y, z, 5) for x in range(3) for y in range(3) for z in range(3) if rng.random() < 0.9]
    while waiting:
        x, y, z, level = waiting.pop()
        if level < 8 and rng.random() < 0.3:
            waiting += [(2 * x + a, 2 * y + b, 2 * z + c, level + 1) for a in (0, 1) for b in (0, 1) for c in (0, 1)]
        else:
            rows.append((x, y, z, level, rng.randrange(9), None if rng.random() < 0.2 else "s"))
    cells = spark.createDataFrame(rows, "x int, y int, z int, level int, will int, name string")
    at = {(x, y, z, level): (will, name) for x, y, z, level, will, name in rows}
    expected = []
    for x, y, z, level, will, name in rows:
        unit = 1 << (8 - level)
        for face in range(6):
            p = [x * unit, y * unit, z * unit]
            p[face // 2] += unit if face % 2 else -1
            for n in range(5, 9):
                there = (*[v >> (8 - n) for v in p], n)
                if there in at:
                    expected.append((x, y, z, level, will, name, face, *there, *at[there]))
    for most in (7, 500_000):
        monkeypatch.setattr(locate, "CELLS", most)
        got = mesh.probed(cells, "will", "name")
        assert got.columns == ["x", "y", "z", "level", "will", "name", "face", "nx", "ny", "nz", "n_level", "n_will", "n_name"]
        assert got.rdd.getNumPartitions() == max(4, -(-len(rows) // most))
        assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, expected))
    assert mesh.probed(cells.limit(0)).count() == 0
