"""Mesh files as data sources: large files in many tasks, boundaries of text, commits and aborts."""

import json
import random
import struct
import tempfile
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from cellweave.sources import mesh_files as M
from cellweave.sources import meshes, sinks


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def text_file(rows, rng):
    gap = lambda: rng.choice([" ", "\n", "\t ", "\r\n", "   "])
    out = ["solid some part\n"]
    for r in rows:
        n = [f"{v:g}" for v in r]
        words = ["facet", "normal", *n[:3], "outer", "loop", *[w for v in range(3) for w in ("vertex", *n[3 + 3 * v : 6 + 3 * v])], "endloop", "endfacet"]
        out += [w + gap() for w in words]
    return "".join([*out, "endsolid some part\n"])


def test_every_range_of_a_text_file_gives_its_own_facets(monkeypatch, folder):
    rng = random.Random(3)
    rows = [[rng.randrange(-99, 99) / 4 for _ in range(12)] for _ in range(40)]
    path = Path(folder, "t.stl")
    path.write_text(text_file(rows, rng))
    size = path.stat().st_size
    for step in (1, 7, 50, 300, 4096, size, 10 * size):
        for chunk in (5, 64, 1 << 20):
            if size // step > 500 and chunk == 5:
                continue
            monkeypatch.setattr(M, "STEP", chunk)
            got = [list(r.values())[3:] for k, a in enumerate(range(0, size, step)) for b in M.facets(M.Piece(str(path), False, k, a, min(a + step, size))) for r in b.to_pylist()]
            assert got == rows, (step, chunk)


def test_one_file_is_read_by_many_tasks(spark, folder):
    rng = np.random.default_rng(1)
    rows = np.zeros(10_000, M.RECORD)
    rows["v"] = rng.integers(-50, 50, (10_000, 12))
    Path(folder, "b.stl").write_bytes(b"solid".ljust(80) + struct.pack("<I", len(rows)) + rows.tobytes())
    df = meshes.read_stl(spark, f"file://{folder}/b.stl", records=999)
    assert df.rdd.getNumPartitions() == 11
    got = df.orderBy("number").collect()
    assert [r["number"] for r in got] == list(range(10_000)) and np.array_equal(np.array([r[2:] for r in got]), rows["v"])
    text = Path(folder, "t.stl")
    text.write_text(text_file(rows["v"][:500].tolist(), random.Random(1)))
    got = meshes.read_stl(spark, str(text), bytes=3000).orderBy("number").collect()
    assert [r["number"] for r in got] == list(range(500)) and np.array_equal(np.array([r[2:] for r in got]), rows["v"][:500])


def test_a_file_of_more_than_two_gigabytes(folder):
    """Sparse on disk: ranges at its end are read without the rest."""
    n = 50_000_000
    path = Path(folder, "large.stl")
    with path.open("wb") as f:
        f.write(b"large".ljust(80) + struct.pack("<I", n))
        f.truncate(84 + 50 * n)
        f.seek(84 + 50 * (n - 1))
        f.write(struct.pack("<12fH", *range(12), 0))
    pieces = M.StlReader({"path": str(path)}).partitions()
    assert path.stat().st_size > 2**31 and len(pieces) == 50 and pieces[-1].end == n
    last = list(M.records(M.Piece(str(path), True, 0, n - 3, n)))[0].to_pylist()
    assert [r["number"] for r in last] == [n - 3, n - 2, n - 1] and [last[-1][c] for c in M.NUMBERS] == list(range(12))


def test_odd_files(spark, folder):
    Path(folder, "empty.stl").write_bytes(b"x" * 80 + struct.pack("<I", 0))
    Path(folder, "none.stl").write_text("solid nothing\nendsolid nothing\n")
    Path(folder, "upper.stl").write_text("SOLID S\nFACET NORMAL 0 0 1\nOUTER LOOP\nVERTEX 0 0 0\nVERTEX 1 0 0\nVERTEX 0 1 0\nENDLOOP\nENDFACET\nENDSOLID S\n")
    assert meshes.read_stl(spark, f"file://{folder}").count() == 1
    for name, body in (("no.txt", "not a mesh"), ("cut.txt", "solid s\nfacet normal 0 0 1\nouter loop\nvertex 0 0 0"), ("bad.txt", "solid s\nfacet normal 0 0 1 outer loop vertex 1 2 endloop endfacet\n")):
        Path(folder, name).write_text(body)
        with pytest.raises(PySparkException, match=name):
            meshes.read_stl(spark, f"file://{folder}/{name}").collect()
    with pytest.raises(FileNotFoundError):
        M.StlReader({"path": f"{folder}/nothing.stl"}).partitions()


def triangles(spark, n):
    return spark.range(n).select(*[(F.col("id") + i).cast("double").alias(c) for i, c in enumerate(M.NUMBERS)])


def test_written_and_read_back(spark, folder):
    out = sinks.write_stl(triangles(spark, 1000).repartition(3), f"file://{folder}/mesh")
    index = json.loads(Path(folder, "mesh", M.INDEX).read_text())
    assert index["triangles"] == 1000 and len(index["files"]) >= 3
    Path(folder, "mesh", "stray.stl").write_bytes(Path(folder, "mesh", index["files"][0]).read_bytes())  # of an attempt that was lost
    got = meshes.read_stl(spark, out)
    assert got.count() == 1000 and got.agg(F.sum("nx")).first()[0] == sum(range(1000))


def test_a_failed_task_is_in_no_index(spark, folder):
    def fails(batches):
        for b in batches:
            yield b
            if b.column(0)[0].as_py() == 0.0:
                raise RuntimeError("lost")

    rows = triangles(spark, 1000).repartitionByRange(3, "nx").sortWithinPartitions("nx")
    with pytest.raises(PySparkException):
        sinks.write_stl(rows.mapInArrow(fails, rows.schema), f"file://{folder}/mesh")
    assert not Path(folder, "mesh", M.INDEX).exists()
    cells = spark.createDataFrame([(i, 0, 0, 1, i / 2) for i in range(100)], "x int, y int, z int, level int, rho double").repartitionByRange(3, "x")
    with pytest.raises(PySparkException):
        sinks.write_vtp(cells.withColumn("rho", F.when(F.col("x") == 50, F.raise_error("lost").cast("double")).otherwise(F.col("rho"))), f"file://{folder}/vtp", 1, ["rho"])
    assert not list(Path(folder, "vtp").glob("*.pvtp"))  # tasks that were stopped after their write may leave files that no index names


def test_writers_without_rows_and_aborts(folder):
    w = M.StlWriter({"path": folder})
    batch = pa.RecordBatch.from_arrays([pa.array([float(i)]) for i in range(12)], names=M.NUMBERS)
    done = w.write(iter([batch, batch.slice(0, 0), batch]))
    assert done.rows == 2 and len(done.files) == 2
    w.abort([done, None])
    assert not list(Path(folder).glob("*.stl"))
    w.commit([w.write(iter([])), None])
    assert json.loads(Path(folder, M.INDEX).read_text()) == {"files": [], "triangles": 0}
