import json
import struct
import tempfile
import xml.etree.ElementTree as ET
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from cellweave.functions import schema
from cellweave.operators import mesh
from cellweave.sources import meshes, sinks
from cellweave.streaming import steps


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


TRIANGLES = [[0, 0, 1, 0, 0, 0, 1, 0, 0, 0, 1, 0], [0, 0, -1, 0, 0, 5, 2, 0, 5, 0, 2, 5]]


def test_stl_of_both_kinds(spark, folder):
    Path(folder, "a.stl").write_bytes(b"solid but binary".ljust(80) + struct.pack("<I", 2) + b"".join(struct.pack("<12fH", *t, 0) for t in TRIANGLES))
    facets = "".join(f"facet normal {' '.join(map(str, t[:3]))}\nouter loop\n" + "".join(f"vertex {' '.join(map(str, t[i : i + 3]))}\n" for i in (3, 6, 9)) + "endloop\nendfacet\n" for t in TRIANGLES)
    Path(folder, "b.stl").write_text(f"solid name\n{facets}endsolid name\n")
    got = meshes.read_stl(spark, f"file://{folder}/*.stl").orderBy("file", "number").collect()
    assert [list(r)[2:] for r in got] == [list(map(float, t)) for t in TRIANGLES] * 2
    with pytest.raises(ValueError):
        meshes.triangles_of(b"no mesh")


def test_vtp_pieces_and_index(spark, folder):
    cells = spark.createDataFrame([(0, 0, 0, 1, 0.5), (1, 0, 0, 1, 1.5), (0, 1, 0, 2, 2.5), (0, 0, 1, 2, 3.5)], "x int, y int, z int, level int, rho double").repartition(2)
    index = ET.parse(sinks.write_vtp(cells, f"file://{folder}/vtk", 7, ["rho"])).getroot()
    pieces = [p.get("Source") for p in index.iter("Piece")]
    counts = [int(ET.parse(f"{folder}/vtk/{p}").getroot().find(".//Piece").get("NumberOfPoints")) for p in pieces]
    assert sum(counts) == 4 and len(pieces) == 2


def test_reference_tables_are_checked(spark, folder):
    sinks.write_reference(spark.range(10).withColumn("v", F.col("id") * 1.5), f"{folder}/gold")
    assert meshes.read_reference(spark, f"{folder}/gold").count() == 10
    spark.range(1).withColumn("v", F.lit(0.0)).write.mode("append").parquet(f"{folder}/gold/table")
    with pytest.raises(ValueError):
        meshes.read_reference(spark, f"{folder}/gold")


def test_traces_metrics_and_reports(spark, folder):
    events = spark.createDataFrame([("k", "c", "X", 1, 5, 0, 0), ("b", "c", "B", 2, 9, 0, 0)], "name string, cat string, ph string, ts long, dur long, pid long, tid long")
    sinks.write_trace(events.coalesce(1), f"{folder}/trace")
    lines = [json.loads(x) for p in Path(folder, "trace").glob("part-*") for x in p.read_text().splitlines()]
    assert [x.get("dur") for x in lines] == [5, None]
    old = spark.createDataFrame([("t", "c1", "m", 1.0), ("t", "c2", "m", 2.0)], "test string, commit string, metric string, value double")
    new = spark.createDataFrame([("t", "c2", "m", 3.0)], old.schema)
    assert sorted(r.value for r in sinks.append_metrics(old, new).collect()) == [1.0, 3.0]
    found = spark.createDataFrame([("t", "m", 1.0, 1.2, 20.0)], "test string, metric string, baseline double, value double, percent double")
    assert "| t | m | 1 | 1.2 | +20.0 % |" in sinks.report(found) and sinks.report(found.limit(0)) == "No regression.\n"
    stats = sinks.transport_stats(spark.createDataFrame([(0, 10, 3), (0, 5, 4)], "rank int, bytes long, micros long"), ["rank"]).first()
    assert json.loads(stats.json) == {"bytes": 15, "messages": 2, "micros": 7}


def test_benchmarks_and_profiles(spark, folder):
    Path(folder, "a.json").write_text(json.dumps({"benchmarks": [{"name": "p", "real_time": 3.5, "unit": "ms"}]}))
    Path(folder, "b.json").write_text(json.dumps({"tests": {"q": {"time": 2}}}))
    assert sorted(map(tuple, meshes.read_benchmarks(spark, f"{folder}/*.json").collect())) == [("p", "real_time", 3.5), ("q", "time", 2.0)]
    Path(folder, "p.txt").write_text("# head\n0.0 1.0\n0.5, 2.0\n\n1.0\t3.0\n")
    assert sorted(map(tuple, meshes.read_profile(spark, f"{folder}/p.txt").collect())) == [(0.0, 1.0), (0.5, 2.0), (1.0, 3.0)]


def test_grids(spark):
    grid = meshes.base_grid(spark)
    assert grid.count() == 512 and grid.where("flag = 1").count() == 8
    assert mesh.adapt(grid, {}).count() == 568
    assert meshes.analytical_grid(spark, (4, 3, 2), lambda x, y, z: x + y + z).agg(F.max("value")).first()[0] == pytest.approx(0.75 + 2 / 3 + 0.5)
    assert meshes.hashed_keys(spark, 1000).distinct().count() > 990


def test_fields():
    f = schema.Fields()
    assert f.add(schema.Field("rho", default=(1.0,))) and f.add(schema.Field("u", "double", 3, rule="skip")) and not f.add(schema.Field("rho"))
    assert f.memory(10) == 64 + 256 and f.rules() == {"rho": "arithmetic", "u": "skip"}
    for bad in ({"name": ""}, {"name": "a", "components": 33}, {"name": "a", "halo": 3}, {"name": "a", "type": "text"}, {"name": "a", "rule": "x"}, {"name": "a", "default": (1, 2)}):
        with pytest.raises(ValueError):
            schema.Field(**bad)
    assert schema.fnv1a("") == 0xCBF29CE484222325 and schema.fnv1a("a") == 0xAF63DC4C8601EC8C


def test_kernels_and_binding(spark):
    f = schema.Fields()
    f.add(schema.Field("rho", default=(2.0,)))
    cells = f.filled(meshes.base_grid(spark, 2))
    got = schema.kernel(cells, {"rho": F.col("rho") * 3}, F.col("x") == 0)
    assert {(r.x, r.rho) for r in got.collect()} == {(0, 6.0), (1, 2.0)}
    with pytest.raises(ValueError):
        f.bound(cells, ["rho", "nothing"])


def test_time_loop(spark):
    out = steps.time_loop(meshes.base_grid(spark, 2).withColumn("t", F.lit(0)), 4, [lambda c, t: c.withColumn("t", F.lit(t))], adapt_every=2, checkpoint_every=3)
    assert out.count() == 64 and out.agg(F.min("t")).first()[0] == 4


def test_stream_of_flags(spark, folder):
    first = meshes.base_grid(spark, 2).withColumn("flag", F.lit(0))
    for n, rows in enumerate([[(0, 0, 0, 0, 1, 1)], [(0, 0, 0, 1, 1, 2), (1, 1, 1, 0, 1, 2)]]):
        spark.createDataFrame(rows, "x int, y int, z int, level int, flag int, ts long").coalesce(1).write.mode("append").parquet(f"{folder}/flags")
        stream = spark.readStream.schema("x int, y int, z int, level int, flag int, ts long").parquet(f"{folder}/flags")
        steps.adapt_by_stream(stream, first, f"{folder}/mesh", {}).awaitTermination(120)
        assert spark.read.parquet(f"{folder}/mesh/mesh-{n}").count() == [15, 29][n]
