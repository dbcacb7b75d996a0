"""Rules of one's own, sums that no partitioning changes, and counts that come with the job."""

import math
import random
import struct

import pyarrow as pa
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from cellweave.functions import schema
from cellweave.operators import mesh
from cellweave.operators.exact import exact_sums
from tests.test_mesh import OCTET, SCHEMA, random_mesh, table

bits = lambda v: None if v is None else struct.pack("<d", v)


def test_a_rule_of_ones_own(spark):
    mesh.define_rule("spread", lambda v: F.array_max(v) - F.array_min(v))

    @F.arrow_udf("double")
    def harmonic(values: pa.Array) -> pa.Array:
        return pa.array([8 / sum(1 / (1 + x) for x in v) for v in values.to_pylist()])

    mesh.define_rule("harmonic", harmonic, double=True)
    mesh.define_rule("third_child", lambda v: F.get(v, F.lit(2)))
    try:
        cells = table(spark, OCTET).repartition(5).withColumns({"h": F.col("mass"), "third": F.col("mass")})
        got = mesh.adapt(cells, {"mass": "spread", "h": "harmonic", "third": "third_child"})
        assert [tuple(r) for r in got.select("mass", "h", "third").collect()] == [(7, pytest.approx(8 / sum(1 / (1 + i) for i in range(8))), 2)]
        assert dict(got.dtypes)["mass"] == "bigint" and dict(got.dtypes)["h"] == "double"
        assert schema.Field("rho", rule="harmonic").rule == "harmonic"
        with pytest.raises(ValueError):
            mesh.define_rule("min", lambda v: v)
    finally:
        for name in ("spread", "harmonic", "third_child"):
            mesh.drop_rule(name)
    with pytest.raises(ValueError, match="harmonic"):
        mesh.adapt(table(spark, OCTET), {"mass": "harmonic"})
    with pytest.raises(ValueError):
        mesh.drop_rule("min")


def test_merged_fields_are_equal_to_the_last_bit(spark):
    rng = random.Random(1)
    cells = [(*r[:4], 0, -1, rng.uniform(-1, 1) * 10 ** rng.randrange(-9, 9), None if rng.random() < 0.1 else rng.random()) for r in random_mesh(2)]
    shape = SCHEMA.replace("mass long", "mass double, rho double")
    found = []
    for n in (1, 7, 200):
        got = mesh.merge(spark.createDataFrame(cells, shape).repartition(n, F.rand(n)), {"mass": "volume_weighted", "rho": "arithmetic"}).collect()
        found.append(sorted((*r[:4], bits(r.mass), bits(r.rho)) for r in got))
    assert found[0] and found[0] == found[1] == found[2]


def test_sums_are_equal_to_the_last_bit(spark):
    rng = random.Random(2)
    rows = [(rng.choice("ab"), rng.choice([-1, 1]) * rng.random() * 10 ** rng.randrange(-12, 12)) for _ in range(3000)]
    rows += [("a", None), ("c", None), ("z", 0.0), ("z", -0.0), ("t", 5e-324), ("t", 1e-310), ("h", 1.7e308), ("h", -1.6e308), ("n", float("nan")), ("n", 1.0), ("i", float("inf")), ("i", 2.0), ("j", float("inf")), ("j", float("-inf"))]
    rows += [("w", 1e16), ("w", 1.0), ("w", -1e16)] + [("e", 0.1)] * 10
    found = []
    for n in (1, 7, 200):
        df = spark.createDataFrame(rows, "k string, v double").repartition(n, F.rand(n)).withColumn("bin", F.lit("clash"))
        found.append({r["k"]: r["total"] for r in exact_sums(df, ["k"], {"total": "v"}).collect()})
        whole = exact_sums(df.where("k in ('a', 'b', 'e')"), [], {"total": "v", "twice": F.col("v") * 2}).first()
        assert bits(whole["twice"]) == bits(2 * whole["total"])
    assert all({k: bits(v) for k, v in f.items()} == {k: bits(v) for k, v in found[0].items()} for f in found)
    got = found[0]
    for k in "abehtzw":
        want = math.fsum(v for q, v in rows if q == k and v is not None)
        assert got[k] == pytest.approx(want, rel=1e-15, abs=0), k
    assert got["c"] is None and math.isnan(got["n"]) and got["i"] == math.inf and math.isnan(got["j"]) and got["w"] == 1.0
    assert exact_sums(spark.createDataFrame([], "k string, v double"), ["k"], {"total": "v"}).count() == 0


def test_counts_come_with_the_job(spark):
    cells = table(spark, random_mesh(3)).withColumn("flag", F.when(F.col("flag") > 0, 1).otherwise(-1)).cache()
    counts = Observation()
    got = mesh.adapt(cells, {"mass": "volume_weighted"}, counts=counts).collect()
    want = {"cells": len(got), "split": cells.where(mesh.splits()).count(), "merged": mesh.merge(cells, {"mass": "volume_weighted"}).count(), "raised": 0, "vetoed": 0, "sum_mass": sum(r.mass for r in got)}
    assert counts.get == want and got[0].asDict().keys() == set(cells.columns)


def test_raised_and_vetoed_cells_are_counted(spark):
    octet = lambda x0, n, flag: [(x0 + (i & 1), i >> 1 & 1, i >> 2 & 1, n, 0, flag, 1) for i in range(8)]
    counts = Observation()
    cells = table(spark, octet(0, 5, -1) + octet(2, 5, 1))
    mesh.adapt(cells, {"mass": "volume_weighted"}, balanced=True, counts=counts).collect()
    assert counts.get == {"cells": 72, "split": 8, "merged": 0, "raised": 0, "vetoed": 8, "sum_mass": 72}
    counts = Observation()
    cells = table(spark, [(0, 0, 0, 4, 0, 0, 1), *octet(2, 5, 1)])
    mesh.adapt(cells, {"mass": "volume_weighted"}, balanced=True, counts=counts).collect()
    assert (counts.get["split"], counts.get["raised"], counts.get["vetoed"]) == (9, 1, 0)
