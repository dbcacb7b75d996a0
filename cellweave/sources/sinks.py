"""Writers: visualisation points, reference tables, traces, metric histories and reports."""

from __future__ import annotations

import json

from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.operators import series
from cellweave.sources import mesh_files


def write_vtp(cells: DataFrame, folder: str, step: int, fields: list[str] = ()) -> str:
    """Cells as VTK PolyData: a file a task, and one index that names the files of tasks that ended, written when all have. folder:
    a URI. Returns the index."""
    cells.sparkSession.dataSource.register(mesh_files.VtpSource)
    rows = cells.select("x", "y", "z", "level", *fields)
    rows.write.format(mesh_files.VtpSource.name()).mode("append").option("step", step).option("fields", json.dumps([*fields])).save(folder)
    return f"{fs.FileSystem.from_uri(folder)[1]}/{mesh_files.index_name(step)}"


def write_stl(triangles: DataFrame, folder: str) -> str:
    """Triangles (normal nx, ny, nz and corners ax to cz) as binary STL files below ``folder`` (a URI), which an index names.
    Returns the folder."""
    triangles.sparkSession.dataSource.register(mesh_files.StlSource)
    rows = triangles.select(*[F.col(c).cast("double").alias(c) for c in mesh_files.NUMBERS])
    rows.write.format(mesh_files.StlSource.name()).mode("append").save(folder)
    return folder


def write_reference(table: DataFrame, path: str) -> None:
    """A table beside its count and checksum."""
    from cellweave.sources.meshes import checksum

    table.write.parquet(f"{path}/table")
    checksum(table.sparkSession.read.parquet(f"{path}/table")).coalesce(1).write.json(f"{path}/check")


def write_trace(events: DataFrame, path: str) -> None:
    """Trace events (name, cat, ph, ts, dur, pid, tid) as one JSON object a line; ``dur`` only for complete events."""
    row = F.struct("name", "cat", "ph", "ts", F.when(F.col("ph") == "X", F.col("dur")).alias("dur"), "pid", "tid")
    events.select(F.to_json(row).alias("value")).write.text(path)


def write_trace_arrays(events: DataFrame, path: str, most: int = 100_000) -> None:
    """Trace events as files that are each one JSON array of at most ``most`` events, as trace viewers read them."""
    place = F.monotonically_increasing_id()  # the partition's number, and a row's number in it in the low 33 bits
    piece = F.concat_ws("-", F.shiftright("place", 33), F.floor(F.col("place").bitwiseAND(F.lit((1 << 33) - 1)) / most))
    row = F.struct("name", "cat", "ph", "ts", F.when(F.col("ph") == "X", F.col("dur")).alias("dur"), "pid", "tid")
    pieces = events.withColumn("place", place).groupBy(piece.alias("piece")).agg(F.to_json(F.collect_list(row)).alias("value"))
    pieces.write.partitionBy("piece").text(path)


def append_metrics(history: DataFrame, new: DataFrame) -> DataFrame:
    """A metric history with new measurements; a (test, commit, metric) that is there already is replaced."""
    return series.upserted(history, new, ["test", "commit", "metric"])


def report(found: DataFrame, most: int = 200) -> str:
    """Regressions (test, metric, baseline, value, percent) as a Markdown table, the largest first; how many more there are is
    said below it."""
    rows, n = found.orderBy(F.desc("percent")).limit(most).collect(), found.count()
    head = "| test | metric | baseline | now | change |\n|---|---|---|---|---|\n"
    more = f"\n{n - most} more are not listed.\n" if n > most else ""
    return head + "".join(f"| {r['test']} | {r['metric']} | {r['baseline']:.6g} | {r['value']:.6g} | +{r['percent']:.1f} % |\n" for r in rows) + more if rows else "No regression.\n"


def transport_stats(messages: DataFrame, by: list[str]) -> DataFrame:
    """Bytes, messages and microseconds of groups, and the same as JSON."""
    got = messages.groupBy(*by).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("messages"), F.sum("micros").alias("micros"))
    return got.withColumn("json", F.to_json(F.struct("bytes", "messages", "micros")))
