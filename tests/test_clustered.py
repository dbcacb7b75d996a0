"""Tables in curve order open only the files that a range needs; halos of declared depth."""

import itertools
import tempfile

import pytest
from pyspark.sql import functions as F

from cellweave.functions import schema
from cellweave.operators import halo
from cellweave.sources import clustered
from tests.test_mesh import SCHEMA, random_mesh, table


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def test_a_range_opens_its_own_files(spark, folder):
    cells = random_mesh(3)
    clustered.write_clustered(table(spark, cells), f"{folder}/mesh", 16)
    whole = clustered.read_clustered(spark, f"{folder}/mesh")
    assert sorted(tuple(r)[:7] for r in whole.collect()) == sorted(cells) and len(whole.inputFiles()) == 16
    part = clustered.read_cell(spark, f"{folder}/mesh", 1, 0, 1, 1)
    want = sorted(c for c in cells if tuple(v >> c[3] - 1 for v in c[:3]) == (1, 0, 1))
    assert sorted(tuple(r)[:7] for r in part.collect()) == want and 0 < len(part.inputFiles()) <= 4
    assert "PushedFilters: [IsNotNull(curve_key), GreaterThanOrEqual(curve_key" in part._jdf.queryExecution().executedPlan().toString()
    assert clustered.read_clustered(spark, f"{folder}/mesh", 2**60).count() == 0
    with pytest.raises(ValueError):
        clustered.write_clustered(whole, f"{folder}/again")


def test_an_empty_mesh(spark, folder):
    clustered.write_clustered(spark.createDataFrame([], SCHEMA), f"{folder}/none", 4)
    assert clustered.read_cell(spark, f"{folder}/none", 0, 0, 0, 0).count() == 0


def test_halos_of_declared_depth(spark):
    cells = table(spark, [(x, y, z, 3, 0, 0, x + 10 * y + 100 * z) for x, y, z in itertools.product(range(8), repeat=3)]).withColumn("rank", F.floor(F.col("x") / 4).cast("int"))
    fields = schema.Fields()
    for f in (schema.Field("mass", "long", halo=2), schema.Field("state", "int", halo=1), schema.Field("flag", "int")):
        fields.add(f)
    got = halo.exchanged_fields(cells, "rank", fields).collect()
    assert {(r.gx, r.gy, r.gz) for r in got if r.field == "mass" and r.to_rank == 0} == {(x, y, z) for x in (4, 5) for y in range(8) for z in range(8)}
    assert {r.gx for r in got if r.field == "state" and r.to_rank == 1} == {3} and not [r for r in got if r.field == "flag"]
    assert all(r.value == r.gx + 10 * r.gy + 100 * r.gz for r in got if r.field == "mass")
    with pytest.raises(ValueError):
        halo.exchanged_fields(cells, "rank", schema.Fields())
