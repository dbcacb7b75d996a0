"""Values carried over ranges with null keys, rebalances by composed maps, hashes of batches, orders."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cellweave.functions import schema
from cellweave.operators import partition, series


@pytest.mark.parametrize("other", ["range_part", "range_part__", "Range_Part_"])
def test_null_is_a_key_like_any_other(spark, other):
    points = [(k, float(t), i) for i, (k, t) in enumerate([(k, t) for k in ("a", None) for t in range(0, 300, 3)])]
    known = [(k, float(t), t * 2.0) for k in ("a", None) for t in range(0, 300, 30)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for n in ("1", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        try:
            a = spark.createDataFrame(points, f"key string, t double, {other} long")
            b = spark.createDataFrame(known, "key string, t double, v double")
            got = series.bracketed(a, b, ["key"], "t", "v").collect()
            assert len(got) == 200 and all(r["value"] == pytest.approx(min(r["t"], 270) * 2) for r in got)
            near = series.nearest(a, b, ["key"], "t").collect()
            assert all(abs(r["nearest"] - r["t"]) <= 15 or r["t"] > 270 for r in near)
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)


def test_transfers_of_a_null_rank_coalesce(spark):
    rows = [(s, 1, k, k + 1, 1) for s in (0, None) for k in range(100) if k != 50]
    got = partition.coalesced(spark.createDataFrame(rows, "source int, destination int, first_key long, end_key long, n long"))
    assert [tuple(r) for r in partition.ordered(got).collect()] == [(None, 1, 0, 50, 50), (None, 1, 51, 100, 49), (0, 1, 0, 50, 50), (0, 1, 51, 100, 49)]


def plain(steps, tolerance, interval):
    since, out = 0, []
    for step, imbalance in steps:
        since += 1
        due = imbalance > tolerance and since >= interval
        out.append((step, since, due))
        since = 0 if due else since
    return out


@pytest.mark.parametrize("interval,tolerance", [(1, 0.5), (3, 0.5), (7, 0.1), (50, 1.2), (1000, 0.0), (0, 0.7)])
def test_rebalances_equal_a_fold(spark, interval, tolerance):
    rng = random.Random(interval)
    history = [(step, rank, rng.randrange(1, 50)) for step in range(0, 900, 3) for rank in range(3)]
    by = {}
    for step, _, n in history:
        by.setdefault(step, []).append(n)
    steps = [(s, (max(v) - min(v)) / (sum(v) / 3)) for s, v in sorted(by.items())]
    got = partition.rebalances(spark.createDataFrame(history, "step int, rank int, n long"), tolerance, interval).orderBy("step").collect()
    assert [(r["step"], r["since"], r["due"]) for r in got] == plain(steps, tolerance, interval)


def test_rebalances_of_no_steps(spark):
    assert partition.rebalances(spark.createDataFrame([], "step int, rank int, n long")).count() == 0


def test_no_row_grows_with_the_steps(spark):
    """A hundred thousand steps; the widest row that moves has the states of an interval."""
    history = spark.range(200_000).select(F.floor(F.col("id") / 2).alias("step"), (F.col("id") % 2).alias("rank"), F.pmod(F.xxhash64("id"), F.lit(9)).alias("n"))
    got = partition.rebalances(history, 0.5, 10)
    assert "collect_list" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert got.agg(F.count("*"), F.min("since"), F.sum(F.col("due").cast("int"))).first()[0] == 100_000
    after = got.where("due").select((F.col("step") + 1).alias("step")).join(got, "step")
    assert after.where("since <> 1").count() == 0


def test_hashes_of_a_batch():
    names = ["", "a", "density", "é", None, "velocity" * 20, "a"]
    for some in (pa.array(names, pa.string()), pa.array(["x", *names], pa.string()).slice(1), pa.array([], pa.string())):
        got = schema.fnv1a_all(some)
        assert [int(h) for h, n in zip(got, some.to_pylist(), strict=True) if n is not None] == [schema.fnv1a(n) for n in some.to_pylist() if n is not None]
