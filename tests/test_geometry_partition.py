import pytest
from pyspark.sql import functions as F

from cellweave.operators import geometry, mesh, partition, series

SHAPE = "name string, kind string, material_id int, radius double, height double, width double, length double, scale double, tx double, ty double, tz double"


def test_sphere_and_box_voxels(spark):
    ball = spark.createDataFrame([("s", "sphere", 1, 2.5, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0)], SHAPE)
    got = {(r.x, r.y, r.z) for r in geometry.voxels(ball, domain=(-10, 10)).collect()}
    assert len(got) == 56 and (0, 0, 0) in got and (3, 0, 0) not in got
    box = spark.createDataFrame([("b", "box", 2, 0.0, 2.0, 2.0, 2.0, 1.0, 0.0, 0.0, 0.0), ("", "box", 9, 0.0, 9.0, 9.0, 9.0, 1.0, 0.0, 0.0, 0.0)], SHAPE)
    rows = geometry.voxels(box, domain=(-10, 10)).collect()
    assert len(rows) == 8 and {r.material_id for r in rows} == {2}


def test_cube_mesh(spark):
    p = [(x, y, z) for x in (0.2, 3.2) for y in (0.2, 3.2) for z in (0.2, 3.2)]
    quads = [(0, 1, 3, 2), (4, 5, 7, 6), (0, 1, 5, 4), (2, 3, 7, 6), (0, 2, 6, 4), (1, 3, 7, 5)]
    rows = [("m", *p[a], *p[b], *p[c]) for q in quads for a, b, c in ((q[0], q[1], q[2]), (q[0], q[2], q[3]))]
    columns = ", ".join(f"{v}{c} double" for v in "abc" for c in "xyz")
    got = geometry.mesh_voxels(spark.createDataFrame(rows, f"id string, {columns}"), ["id"])
    assert {(r.x, r.y, r.z) for r in got.collect()} == {(x, y, z) for x in range(3) for y in range(3) for z in range(3)}


def test_transfers_that_touch_become_one(spark):
    rows = [(0, 1, 0, 10, 5), (0, 1, 10, 20, 5), (0, 1, 30, 40, 1), (1, 0, 20, 25, 2)]
    got = partition.coalesced(spark.createDataFrame(rows, "source int, destination int, first_key long, end_key long, n long"))
    assert sorted(map(tuple, got.collect())) == [(0, 1, 0, 20, 10), (0, 1, 30, 40, 1), (1, 0, 20, 25, 2)]


def test_imbalance(spark):
    counts = spark.createDataFrame([(0, 100), (1, 140)], "rank int, n long")
    got = partition.rebalance_due(partition.imbalance(counts)).first()
    assert got.imbalance == pytest.approx(40 / 120) and got.due
    assert partition.imbalance(counts.limit(0)).first().imbalance == 0
    assert partition.linear_splits(0, 100, 0, 4) == []


def test_packing(spark):
    at = spark.createDataFrame([(0, 0), (1, 0), (1, 1), (1, 2)], "c int, k int")
    density = at.where("k = 0").select(partition.pack_offset("c", F.lit(0), F.lit(0), 1024)).collect()
    velocity = at.where("c = 1").select(partition.pack_offset(F.lit(1), "k", F.lit(4), 1024)).collect()
    assert [r[0] for r in density] == [0, 4] and [r[0] for r in velocity] == [4100, 8196, 12292]


def test_halo_rows_come_from_other_ranks(spark):
    rows = [(x, 0, 0, 2, x // 2, float(x)) for x in range(4)]
    cells = spark.createDataFrame(rows, "x int, y int, z int, level int, rank int, rho double")
    got = partition.halo_rows(cells, "rank", ["rho"]).collect()
    assert sorted((r.to_rank, r.x, r.from_rank, r.rho) for r in got) == [(0, 2, 1, 2.0), (1, 1, 0, 1.0)]


def test_interpolation_clamps_and_brackets(spark):
    points = spark.createDataFrame([("a", t) for t in (-1.0, 0.0, 0.5, 1.0, 1.75, 2.0, 9.0)] + [("b", 1.0)], "k string, t double")
    line = spark.createDataFrame([("a", 0.0, 0.0), ("a", 1.0, 10.0), ("a", 2.0, 30.0)], "k string, t double, v double")
    got = series.bracketed(points, line, ["k"], "t", "v").orderBy("k", "t").collect()
    assert [r.value for r in got] == [0.0, 0.0, 5.0, 10.0, 25.0, 30.0, 30.0, None]


def test_hazards_of_small_graphs(spark):
    def kinds(*rows):
        table = spark.createDataFrame([(0, *r) for r in rows], "g int, field string, idx int, reads boolean, writes boolean")
        return sorted((r.kind, r.earlier, r.later) for r in series.hazards(table, ["g"]).collect())

    assert kinds(("d", 0, False, True), ("d", 1, True, False)) == [("RAW", 0, 1)]
    assert kinds(("d", 0, False, True), ("d", 1, False, True)) == [("WAW", 0, 1)]
    assert kinds(("d", 0, True, False), ("d", 1, False, True)) == [("WAR", 0, 1)]
    assert kinds(("d", 0, True, False), ("v", 0, False, True), ("p", 1, True, False), ("d", 1, False, True)) == [("WAR", 0, 1)]


def test_numbers_and_totals_do_not_depend_on_partitions(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"), (F.col("id") % 3).alias("v"))
    assert [r.number for r in mesh.numbered(rows, ["k"]).orderBy("k").collect()] == list(range(1000))
    total = 0
    for r in mesh.running_total(rows, ["k"], "v").orderBy("k").collect():
        assert r.before == total
        total += r.v


def test_tasks_follow_the_triangles(spark, monkeypatch):
    """What a task groups does not grow with the table: there are more tasks. Hits at zero of either sign are one."""
    corners = [(0.0, 0.0, 0.0), (4.0, 0.0, 0.0), (0.0, 4.0, 0.0), (0.0, 0.0, 4.0)]
    rows = [(i, *corners[a], *corners[b], *corners[c]) for i in range(40) for a, b, c in ((0, 1, 2), (0, 1, 3), (0, 2, 3), (1, 2, 3))]
    df = spark.createDataFrame(rows, "id int, " + ", ".join(f"{v}{c} double" for v in "abc" for c in "xyz")).coalesce(1)
    few = geometry.mesh_voxels(df, ["id"])
    monkeypatch.setattr(geometry, "TRIANGLES", 16)
    many = geometry.mesh_voxels(df, ["id"])
    assert few.rdd.getNumPartitions() == 4 and many.rdd.getNumPartitions() == 10
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect()))
    assert {(r.x, r.y, r.z) for r in many.collect()} == {(x, y, z) for x in range(4) for y in range(4) for z in range(4) if x + y + z + 1.5 < 4}
