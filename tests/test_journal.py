"""Loops and streams that are stopped between a step's table and its record end as if they had not been."""

import tempfile

import pytest
from pyspark.sql import functions as F

from cellweave.sources import meshes
from cellweave.streaming import steps
from cellweave.streaming.journal import Journal


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


class Stopped(Exception):
    pass


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def first(spark):
    return meshes.base_grid(spark, 2).withColumn("t", F.lit(0))


@pytest.mark.parametrize("at", [0, 1, 3])
def test_a_loop_goes_on_after_its_last_whole_step(spark, folder, monkeypatch, at):
    calls = []

    def kernel(cells, t):
        calls.append(t)
        return cells.withColumn("t", F.col("t") * 3 + t)

    want = rows(steps.time_loop(first(spark), 4, [kernel], adapt_every=2))
    publish, calls[:] = Journal.publish, []
    monkeypatch.setattr(Journal, "publish", lambda self, step, record: (_ for _ in ()).throw(Stopped()) if step == at else publish(self, step, record))
    with pytest.raises(Stopped):
        steps.resumed_loop(Journal(spark, folder), first(spark), 4, [kernel], adapt_every=2)
    monkeypatch.setattr(Journal, "publish", publish)
    journal = Journal(spark, folder)
    assert journal.last() == (at - 1 if at else None)
    assert rows(steps.resumed_loop(journal, first(spark), 4, [kernel], adapt_every=2)) == want
    assert calls == [*range(1, at + 1), *range(max(at, 1), 5)]  # the step that was stopped is made twice, no other
    assert journal.steps() == [3, 4] and rows(steps.resumed_loop(journal, first(spark), 4, [kernel])) == want


def test_a_batch_that_is_stopped_before_its_record_runs_again(spark, folder, monkeypatch):
    shape = "x int, y int, z int, level int, flag int, ts long"
    for n, r in enumerate([(0, 0, 0, 0, 1, 1), (1, 1, 1, 0, 1, 2)]):
        spark.createDataFrame([r], shape).coalesce(1).write.mode("append").parquet(f"{folder}/flags")
    stream = spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).parquet(f"{folder}/flags")
    grid = meshes.base_grid(spark, 2).withColumn("flag", F.lit(0))
    steps.adapt_by_stream(stream, grid, f"{folder}/whole", {}).awaitTermination(120)
    publish, failed = Journal.publish, []

    def fails(self, step, record):
        if step == 1 and not failed:
            failed.append(step)
            raise Stopped()
        publish(self, step, record)

    monkeypatch.setattr(Journal, "publish", fails)
    with pytest.raises(Exception, match="Stopped"):
        steps.adapt_by_stream(stream, grid, f"{folder}/mesh", {}).awaitTermination(120)
    journal = Journal(spark, f"{folder}/mesh")
    assert failed and journal.last() == 0
    steps.adapt_by_stream(stream, grid, f"{folder}/mesh", {}).awaitTermination(120)
    assert journal.steps() == [-1, 0, 1]
    assert rows(journal.read(1)) == rows(Journal(spark, f"{folder}/whole").read(1)) and journal.read(1).count() == 22


def test_a_batch_that_was_whole_is_not_made_again(spark, folder):
    journal = Journal(spark, folder)
    journal.kept(0, lambda: spark.range(3))
    assert journal.kept(0, lambda: (_ for _ in ()).throw(Stopped())).count() == 3
    with pytest.raises(ValueError):
        journal.read(7)
    assert Journal(spark, f"{folder}/new").steps() == []
