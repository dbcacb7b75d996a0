"""Time loops: a mesh that changes in steps, and one that follows a stream of flags."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cellweave.operators import mesh
from cellweave.operators.session import checkpointed
from cellweave.streaming.journal import Journal

Step = Callable[[DataFrame, int], DataFrame]


def time_loop(cells: DataFrame, steps: int, kernels: list[Step], adapt_every: int = 0, fields: dict[str, str] | None = None, checkpoint_every: int = 5) -> DataFrame:
    """Apply the kernels in each step, adapt after every n-th; lineage is cut by a checkpoint every few steps."""
    for t in range(1, steps + 1):
        for kernel in kernels:
            cells = kernel(cells, t)
        if adapt_every and t % adapt_every == 0:
            cells = mesh.adapt(cells, fields or {})
        if t % checkpoint_every == 0:
            cells = checkpointed(cells)
    return cells


def resumed_loop(journal: Journal, first: DataFrame, steps: int, kernels: list[Step], adapt_every: int = 0, fields: dict[str, str] | None = None, keep: int = 2, **adapting) -> DataFrame:
    """The same loop with a table a step in a journal: a run that was stopped goes on after the last whole step. The last ``keep``
    tables stay. Further arguments go to ``mesh.adapt``."""
    start = journal.last()
    if start is None:
        journal.kept(0, lambda: first)
        start = 0
    for t in range(start + 1, steps + 1):

        def made(t=t) -> DataFrame:
            cells = journal.read(t - 1)
            for kernel in kernels:
                cells = kernel(cells, t)
            return mesh.adapt(cells, fields or {}, **adapting) if adapt_every and t % adapt_every == 0 else cells

        journal.kept(t, made)
        journal.forget(t + 1 - keep)
    return journal.read(max(start, steps))


def repeated_while(cells: DataFrame, kernels: list[Step], condition: Column, most: int) -> tuple[DataFrame, int]:
    """Apply the kernels as long as the condition, an aggregate of all cells, holds; the cells, and how many steps it took. It is
    an error if it still holds after ``most`` steps. What is tested is a checkpoint: no step is computed twice."""
    cells = checkpointed(cells)
    for t in range(most + 1):
        if not cells.agg(condition.alias("holds")).first()["holds"]:
            return cells, t
        for kernel in kernels:
            cells = kernel(cells, t + 1)
        cells = checkpointed(cells)
    raise RuntimeError(f"the condition still holds after {most} steps")


def flagged_by(cells: DataFrame, flags: DataFrame) -> DataFrame:
    """Cells with the last flag that each got; flags: x, y, z, level, flag, ts."""
    w = Window.partitionBy(*mesh.CELL).orderBy(F.desc("ts"), F.desc("flag"))
    last = flags.withColumn("__n", F.row_number().over(w)).where("__n = 1").select(*mesh.CELL, F.col("flag").alias("__flag"))
    return cells.join(last, mesh.CELL, "left").withColumn("flag", F.coalesce("__flag", "flag")).select(*cells.columns)


def adapt_by_stream(flags: DataFrame, first: DataFrame, folder: str, fields: dict[str, str], **trigger) -> StreamingQuery:
    """Follow a stream of flags: each micro-batch adapts the mesh of the batch before, kept as a table a batch in ``folder``.

    Batches are steps of a journal: one that runs again after a failure reads the same mesh, and if its own was whole already
    it is not made again.
    """
    journal = Journal(first.sparkSession, folder)
    journal.kept(-1, lambda: first)

    def adapted(batch: DataFrame, number: int) -> None:
        journal.kept(number, lambda: mesh.adapt(flagged_by(journal.read(number - 1), batch), fields))

    return flags.writeStream.foreachBatch(adapted).option("checkpointLocation", f"{folder}/progress").trigger(**(trigger or {"availableNow": True})).start()
