"""Halo exchange, moved rows, carried values, lattices and profiles against plain models."""

import json
import random

import pytest
from pyspark.sql import functions as F

from cellweave.functions import lattices, profiles
from cellweave.operators import geometry, halo, mesh, partition, series
from cellweave.sources import sinks

SHAPE = "x int, y int, z int, level int, state int, flag int, v double, rank int"


def test_halo_copies_interpolates_and_averages(spark):
    coarse = [(x, y, z, 1, 0, 0, float(1 + x + 2 * y + 4 * z), 0) for x in (0,) for y in (0, 1) for z in (0, 1)]
    fine = [(2 + i % 2, i // 2 % 2 + 2 * (o % 2), i // 4 % 2 + 2 * (o // 2), 2, 0, 0, 10.0 * i, 1) for i in range(8) for o in range(4)]
    cells = spark.createDataFrame(coarse + fine, SHAPE)
    got = {(r["to_rank"], r["gx"], r["gy"], r["gz"], r["level"]): r for r in halo.exchanged(cells, "rank", "v").collect()}
    assert {k[0] for k in got} == {0, 1}
    assert all(r["kind"] == ("average" if k[0] == 0 else "interpolate") and r["from_rank"] == 1 - k[0] for k, r in got.items())
    assert got[0, 1, 0, 0, 1]["value"] == 35.0
    assert got[1, 1, 0, 0, 2]["value"] == (1 + 3 + 5 + 7) / 8 and got[1, 1, 3, 3, 2]["value"] == 7 / 8
    assert len(got) == 4 + 16
    joined = halo.joined_back(cells, halo.exchanged(cells, "rank", "v"), "rank").where("halo is not null")
    assert joined.count() == 4 + 16 and joined.where(F.size("halo") == 1).count() == 20
    ranges = halo.ranges(halo.exchanged(cells, "rank", "v")).collect()
    assert sum(r["n"] for r in ranges) == 20 and all(r["start_key"] < r["end_key"] for r in ranges)
    assert halo.exchanged(cells.limit(0), "rank", "v").count() == 0


def test_adapt_with_fields_named_like_parents(spark):
    rows = [(i & 1, i >> 1 & 1, i >> 2 & 1, 1, 0, -1, float(i), float(i), i) for i in range(8)] + [(4, 4, 4, 1, 0, 1, 5.0, 6.0, 7)]
    cells = spark.createDataFrame(rows, "x int, y int, z int, level int, state int, flag int, px double, PY double, n_siblings int")
    got = mesh.adapt(cells, {"px": "arithmetic", "PY": "max", "n_siblings": "min"}).collect()
    assert len(got) == 1 + 8
    parent = next(r for r in got if r["level"] == 0)
    assert (parent["px"], parent["PY"], parent["n_siblings"]) == (3.5, 7.0, 0)
    assert all((r["px"], r["PY"], r["n_siblings"]) == (5.0, 6.0, 7) for r in got if r["level"] == 2)


def test_balanced_adapt_keeps_two_to_one(spark):
    rows = [(x, y, z, 1, 0, 0) for x in range(2) for y in range(2) for z in range(2) if (x, y, z) != (1, 0, 0)]
    rows += [(4 + (i & 1), i >> 1 & 1, i >> 2 & 1, 3, 0, 1) for i in range(8)] + [(2 + (i & 1), i >> 1 & 1, i >> 2 & 1, 2, 0, 0) for i in range(1, 8)]
    cells = spark.createDataFrame(rows, "x int, y int, z int, level int, state int, flag int")
    flags = {(r["x"], r["y"], r["z"], r["level"]): r["flag"] for r in mesh.balance(cells)[0].collect()}
    assert flags[0, 0, 0, 1] == 1 and flags[0, 1, 1, 1] == 0
    assert mesh.adapt(cells, {}, balanced=True).where("level = 2 and x < 2 and y < 2 and z < 2").count() == 8
    probe = {(r["x"], r["y"], r["z"], r["level"]): r["flag"] for r in mesh.balance_round(cells, [1, 2, 3], mode="probe").collect()}
    assert probe[0, 0, 0, 1] == 1 and probe[1, 1, 1, 1] == 0


@pytest.mark.parametrize("ahead", [False, True])
def test_carried_values_equal_a_scan(spark, ahead):
    rng = random.Random(7)
    rows = [(rng.choice("aab"), i, rng.choice([None, None, i * 10])) for i in rng.sample(range(1000), 400)]
    df = spark.createDataFrame(rows, "k string, t int, v int")
    got = {(r["k"], r["t"]): r["last"] for r in series.carried(series.dealt(df, ["k"], ["t"]), ["k"], ["t"], F.col("v"), "last", ahead=ahead).collect()}
    for key in "ab":
        last = None
        for _, t, v in sorted((r for r in rows if r[0] == key), key=lambda r: r[1], reverse=ahead):
            last = v if v is not None else last
            assert got[key, t] == last


def test_range_owner_equals_a_search(spark, monkeypatch):
    rng = random.Random(8)
    ranges = [(k, a, a + rng.randrange(30)) for k, a in ((k, rng.randrange(200)) for k in range(12))]
    keys = spark.createDataFrame([(i,) for i in range(-5, 260)] + [(None,)], "key long")
    table = spark.createDataFrame(ranges, "rank int, first_key long, last_key long")
    want = {i: min((k for k, a, b in ranges if a <= i <= b), default=-1) for i in range(-5, 260)} | {None: -1}
    for few in (10_000, 3):
        monkeypatch.setattr(partition, "FEW", few)
        assert {r["key"]: r["owner"] for r in partition.range_owner(keys, table).collect()} == want
    assert {r["owner"] for r in partition.range_owner(keys, table.limit(0)).collect()} == {-1}


def test_plans_and_rebalances(spark):
    plan = spark.createDataFrame([(0, 1, 5, 9, 4), (0, 1, 9, 12, 3), (1, 0, 1, 2, 1), (0, 1, 20, 22, 2)], "source int, destination int, first_key long, end_key long, n long")
    assert sorted(map(tuple, partition.coalesced(plan).collect())) == [(0, 1, 5, 12, 7), (0, 1, 20, 22, 2), (1, 0, 1, 2, 1)]
    one = partition.plan_totals(plan, 10).first()
    assert (one["n"], one["transfers"], one["valid"]) == (10, 4, True) and abs(one["milliseconds"] - 0.01) < 1e-12
    assert not partition.plan_totals(plan, 11).first()["valid"] and partition.plan_totals(plan.limit(0), 3).first()["valid"]
    history = spark.createDataFrame([(s, r, 10 + (5 * r if s != 4 else 0)) for s in range(1, 9) for r in range(2)], "step int, rank int, n int")
    got = sorted(map(tuple, partition.rebalances(history, 0.1, 3).select("step", "since", "due").collect()))
    assert got == [(1, 1, False), (2, 2, False), (3, 3, True), (4, 1, False), (5, 2, False), (6, 3, True), (7, 1, False), (8, 2, False)]
    ranked = partition.equal_ranks(spark.range(10).select((F.col("id") * 3).alias("key")), ["key"], 4)
    assert [r["count"] for r in ranked.groupBy("rank").count().orderBy("rank").collect()] == [3, 3, 2, 2]
    assert partition.moved_to(ranked, "rank", 4).count() == 10


def test_lattices_from_files(spark, tmp_path):
    (tmp_path / "l.json").write_text("\n".join(map(json.dumps, [{"name": "good", "stencil": [[0, 0, 0], [1, 0, 0], [-1, 0, 0]], "weights": ["2/3", "1/6", 0.16666666666666666]}, {"name": "odd", "stencil": [[0, 0, 0], [0, 1, 0]], "weights": ["1/2"]}])))
    got = lattices.read_lattices(spark, str(tmp_path))
    checks = {r["name"]: r["valid"] for r in lattices.checked(got).collect()}
    assert checks == {"good": True, "odd": False}
    assert {(r["name"], r["i"]): r["opposite"] for r in lattices.opposites(got).collect()} == {("good", 0): 0, ("good", 1): 2, ("good", 2): 1, ("odd", 0): 0, ("odd", 1): None}
    named = spark.createDataFrame([("omega", "1.7"), ("tau", "3/5"), ("odd", "x")], "name string, value string")
    assert {r["name"]: r["value"] for r in lattices.constants(named).collect()} == {"omega": 1.7, "tau": 0.6, "odd": None}
    with pytest.raises(ValueError):
        lattices.constants(named.unionByName(named))


def test_series_reports_and_rejects(spark):
    energy = profiles.energy_series(spark, 50.0, 2.0, 5).orderBy("i").collect()
    assert [r["t"] for r in energy] == [0.0, 0.5, 1.0, 1.5, 2.0] and energy[0]["energy"] == 1.0
    assert profiles.cavity(spark).count() == 34
    found = spark.createDataFrame([("t", f"m{i}", 1.0, 2.0, float(i)) for i in range(5)], "test string, metric string, baseline double, value double, percent double")
    assert "3 more are not listed" in sinks.report(found, 2) and "not listed" not in sinks.report(found)
    shapes = spark.createDataFrame([(1, "", 1, 1.0, "box", 1.0), (2, "a", 0, 1.0, "box", 1.0), (3, "b", 1, 0.0, "box", 1.0), (4, "c", 1, 1.0, "sphere", 0.0), (5, "d", 1, 1.0, "sphere", 2.0)], "id int, name string, material_id int, scale double, kind string, radius double")
    assert [r["reason"] for r in geometry.rejected(shapes).orderBy("id").collect()] == ["no name", "no material", "no scale", "no radius"]
    voxels = spark.createDataFrame([(2, 0, 0), (1, 1, 0), (0, 0, 1)], "x int, y int, z int")
    assert [tuple(r) for r in geometry.in_order(voxels).collect()] == [(2, 0, 0), (1, 1, 0), (0, 0, 1)]
    cells = spark.createDataFrame([(0, 0, 0, 0, 2.0)], "x int, y int, z int, level int, v double")
    assert mesh.conserved(cells, cells, "v").first()["holds"] and not mesh.conserved(cells, cells.withColumn("v", F.col("v") * 2), "v").first()["holds"]
