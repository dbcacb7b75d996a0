"""Splits by weight against a sort, placement by descent against every voxel, lookups over many bounds."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave.operators import geometry, partition
from cellweave.operators.partition_bounds import key_bounds, weight_splits


def plain(rows, ranks):
    """First keys before which k shares have passed."""
    by = {}
    for k, w in rows:
        if k is not None and w is not None:
            by[k] = by.get(k, 0) + w
    total, before, out = sum(by.values()), 0, []
    for k in sorted(by):
        while len(out) < ranks - 1 and before * ranks >= (len(out) + 1) * total:
            out.append(k)
        before += by[k]
    return out + [None] * (ranks - 1 - len(out))


@pytest.mark.parametrize("span,heavy", [(50, False), (10**6, False), (2**62, False), (10**6, True)])
def test_splits_equal_a_sort(spark, span, heavy):
    rng = random.Random(span)
    rows = [(rng.randrange(-span, span), rng.randrange(1, 9)) for _ in range(2000)] + [(None, 5), (3, None)]
    rows += [(7, 6000)] if heavy else []
    df = spark.createDataFrame(rows, "key long, cost long")
    got, want = weight_splits(df, "key", "cost", 7), plain(rows, 7)
    known = sorted({k for k, w in rows if k is not None and w is not None})
    after = lambda s: next((k for k in known if k >= s), None)
    assert [after(s) for s in got] == want  # the same rows on each side
    total = sum(w for k, w in rows if k is not None and w is not None)
    for tolerance in (0.05, 0.5):
        loads = [0] * 7
        splits = weight_splits(df, "key", "cost", 7, tolerance)
        for k, w in rows:
            if k is not None and w is not None:
                loads[sum(s <= k for s in splits)] += w
        most = max(sum(w for k, w in rows if k == key and w) for key in {7, *known[:200]})
        assert max(loads) <= total / 7 * (1 + tolerance) + most


def test_splits_of_no_rows(spark):
    empty = spark.createDataFrame([], "key long, cost long")
    assert weight_splits(empty, "key", "cost", 4) == [] and key_bounds(empty, "key") == []
    one = spark.createDataFrame([(5, 3)], "key long, cost long")
    owned = one.withColumn("rank", partition.owner_of_splits("key", weight_splits(one, "key", "cost", 4)))
    assert owned.first()["rank"] == 0


SHAPE = "id long, name string, kind string, material_id int, radius double, height double, width double, length double, scale double, tx double, ty double, tz double"


def shapes(seed, n=30):
    rng = random.Random(seed)
    at = lambda: rng.uniform(-20, 20)
    return [(i, f"s{i}", rng.choice(["sphere", "box", "cylinder", "mesh"]), rng.randrange(1, 9), rng.uniform(0.2, 9), rng.uniform(0.2, 15), rng.uniform(0.2, 15), rng.uniform(0.2, 15), rng.choice([1.0, 0.5]), at(), at(), at()) for i in range(n)]


@pytest.mark.parametrize("size,domain,coarsest", [(1.0, None, 4), (0.5, (-10.0, 12.25), 3), (1.0, (-7.3, 7.0), 0)])
def test_descent_holds_the_same_voxels(spark, size, domain, coarsest):
    df = spark.createDataFrame(shapes(1), SHAPE)
    rows = lambda d: sorted(tuple(r) for r in d.collect())
    assert rows(geometry.finest(geometry.placed(df, size, domain, coarsest=coarsest))) == rows(geometry.voxels(df, size, domain))


def test_rows_by_surface(spark):
    """Twice the radius: eight times the voxels, about four times the rows."""
    ball = lambda r: spark.createDataFrame([(1, "b", "sphere", 1, r, 0.0, 0.0, 0.0, 1.0, 0.1, 0.2, 0.3)], SHAPE)
    small, large = (geometry.placed(ball(r)) for r in (12.0, 24.0))
    a, b = small.count(), large.count()
    assert geometry.finest(large).count() > 57_000 and b < 4.6 * a and b < 12_000
    assert {r["level"] for r in large.select("level").distinct().collect()} == {8, 7, 6, 5}
    assert geometry.placed(spark.createDataFrame([], SHAPE)).count() == 0


@pytest.mark.parametrize("most", [50, 1 << 17])
def test_descent_of_a_file_with_one_task(spark, monkeypatch, most):
    """Shapes of one partition are dealt to all tasks; cells that no shape's box can hold are not looked at; blocks of any size."""
    seen, covered = [], geometry.covered
    monkeypatch.setattr(geometry, "CELLS", most)
    df = spark.createDataFrame(shapes(3, 60), SHAPE).coalesce(1)
    got = geometry.descended(df, keep=["id"])
    assert got.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    cells = geometry.descended(df).groupBy("id").agg(F.sum(F.expr("shiftleft(1L, 3 * up)")).alias("n"))
    plain = geometry.candidates(df.where(geometry.valid())).where(geometry.inside(geometry.to_local({c: F.col(n) + 0.5 for c, n in zip("xyz", "ijk")}, {c: F.col(f"t{c}") for c in "xyz"})))
    assert sorted(map(tuple, cells.collect())) == sorted(map(tuple, plain.groupBy("id").count().collect()))

    def counted(shape, ends, size):
        seen.append(len(shape["scale"]))
        return covered(shape, ends, size)

    monkeypatch.setattr(geometry, "covered", counted)
    box = {"t": np.full((3, 1), 0.1), "kind": np.array(["box"], dtype=object), "first": np.full((3, 1), -1), "last": np.full((3, 1), 0)}
    box |= {c: np.array([v]) for c, v in (("scale", 1.0), ("radius", 0.0), ("height", 2.0), ("width", 2.0), ("length", 2.0))}
    assert sum(len(of) << 3 * up for of, _, up in geometry.descent(box, 1.0, 4)) == 8 and sum(seen) == 8 + 64
