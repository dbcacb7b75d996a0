"""A journal of tables: what each step made, and which steps are whole.

A step's table is written first and its record after it, as one small file that is moved into place. A step without a record
did not happen: after a failure its table is written again, whatever is left of it. A step with a record is read and not
made again, so that a loop, or a stream whose batch runs twice, ends with the tables of a run without a failure.

Defined cases: a folder without records has no steps; a record whose table is gone is an error when it is read; two runs on
one folder at a time are not supported.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession


class Journal:
    """Tables ``<folder>/<name>-<step>`` and their records below ``<folder>/<name>-log``. folder: a path or URI."""

    def __init__(self, spark: SparkSession, folder: str, name: str = "mesh"):
        self.spark, self.folder, self.name = spark, folder.rstrip("/"), name
        self.system, self.path = fs.FileSystem.from_uri(self.folder)
        self.log = f"{self.path}/{name}-log"

    def table_of(self, step: int) -> str:
        return f"{self.folder}/{self.name}-{step}"

    def record_of(self, step: int) -> str:
        return f"{self.log}/{step + 1:012d}.json"

    def has(self, step: int) -> bool:
        return self.system.get_file_info(self.record_of(step)).type == fs.FileType.File

    def steps(self) -> list[int]:
        """The steps that are whole, in order."""
        if self.system.get_file_info(self.log).type != fs.FileType.Directory:
            return []
        names = [f.base_name for f in self.system.get_file_info(fs.FileSelector(self.log))]
        return sorted(int(n.removesuffix(".json")) - 1 for n in names if n.endswith(".json"))

    def last(self) -> int | None:
        return max(self.steps(), default=None)

    def read(self, step: int) -> DataFrame:
        if not self.has(step):
            raise ValueError(f"step {step} of {self.folder} is not whole")
        return self.spark.read.parquet(self.table_of(step))

    def publish(self, step: int, record: dict) -> None:
        self.system.create_dir(self.log, recursive=True)
        new = f"{self.log}/.{uuid.uuid4().hex}"
        with self.system.open_output_stream(new) as out:
            out.write(json.dumps({"step": step, **record}).encode())
        self.system.move(new, self.record_of(step))

    def kept(self, step: int, made: Callable[[], DataFrame]) -> DataFrame:
        """The table of a step: made and written if there is no record of it, and read."""
        if not self.has(step):
            df = made()
            df.write.mode("overwrite").parquet(self.table_of(step))
            self.publish(step, {"columns": df.columns})
        return self.read(step)

    def forget(self, before: int) -> None:
        """Give up records and tables of steps before this one, records first."""
        for step in [s for s in self.steps() if s < before]:
            self.system.delete_file(self.record_of(step))
            self.system.delete_dir(f"{self.path}/{self.name}-{step}")
