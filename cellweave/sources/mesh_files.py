"""Mesh files as Spark data sources: triangles from and to STL files, cells to VTK point pieces.

Reading deals a file of any size to many tasks: a binary file by ranges of its records, a text file by ranges of bytes, of
which each task reads the facets that begin in its range. Writing commits: a task writes files of names that no other
attempt has, and only the files of tasks that Spark accepts are named in the index, which is written last, in one piece.
If the job fails, the files that are known are deleted; others are in no index, and a folder with an index is read by it.

Paths are those that ``pyarrow.fs`` knows: local and shared folders, HDFS and object stores.

Defined cases: an empty binary file, or a text file without facets, has no rows; a folder without files is an error; a facet
without a normal and three corners is an error that names the file; columns are taken by name, others are not written.
"""

from __future__ import annotations

import fnmatch
import json
import posixpath
import re
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from xml.sax.saxutils import escape, quoteattr

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

NORMAL = ["nx", "ny", "nz"]
CORNERS = [f"{v}{c}" for v in "abc" for c in "xyz"]
NUMBERS = [*NORMAL, *CORNERS]
#: Binary STL: 80 bytes, a 32-bit count, and 50 bytes a triangle.
HEAD, RECORD = 84, np.dtype([("v", "<f4", 12), ("spare", "<u2")])
#: Triangles and bytes of a task; triangles of a batch.
RECORDS, BYTES, BATCH = 1_000_000, 32 << 20, 50_000
INDEX = "index.json"
#: Bytes of text that are read at once; bytes within which a word that began before a range's end is whole.
STEP, WORD = 1 << 20, 16


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def listed(uri: str) -> list[tuple[str, int]]:
    """(file, bytes) of a file, of a folder (by its index, if it has one), or of the files that a pattern's last part matches."""
    system, path = opened(uri.replace("*", "%2A") if "://" in uri else uri)
    path = path.replace("%2A", "*")
    scheme = uri[: uri.index("://") + 3] if "://" in uri else ""
    folder, _, last = path.rpartition("/")
    pattern = last if "*" in last else None
    found = system.get_file_info(fs.FileSelector(folder)) if pattern else [system.get_file_info(path)]
    if pattern:
        found = [f for f in found if fnmatch.fnmatch(f.base_name, pattern)]
    elif found[0].type == fs.FileType.Directory:
        inside = {posixpath.relpath(f.path, path): f for f in system.get_file_info(fs.FileSelector(path, recursive=True))}
        if INDEX in inside:
            with system.open_input_stream(inside[INDEX].path) as f:
                inside = {n: inside[n] for n in json.loads(f.read())["files"]}
        found = [f for n, f in inside.items() if not any(x[0] in "._" for x in n.split("/"))]
    found = [f for f in found if f.type == fs.FileType.File]
    if not found and not pattern and not system.get_file_info(path).type == fs.FileType.Directory:
        raise FileNotFoundError(uri)
    return sorted((scheme + f.path, f.size) for f in found)


def count_of(uri: str, size: int) -> int | None:
    """The triangles of a binary file; None of a text file. A file is binary when its size is what its count says."""
    if size < HEAD:
        return None
    system, path = opened(uri)
    with system.open_input_file(path) as f:
        n = struct.unpack_from("<I", f.read_at(4, 80))[0]
    return n if size == HEAD + 50 * n else None


@dataclass
class Piece(InputPartition):
    """Records ``first`` to ``end`` of a binary file, or the facets of a text file that begin in these bytes."""

    file: str
    binary: bool
    part: int
    first: int
    end: int

    def __post_init__(self):
        super().__init__(self)


def batch_of(file: str, part: int, numbers: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
    n = len(rows)
    columns = [pa.array([file] * n, pa.string()), pa.array(np.full(n, part), pa.int32()), pa.array(numbers, pa.int64()), *(pa.array(rows[:, i].astype(float)) for i in range(12))]
    return pa.RecordBatch.from_arrays(columns, names=["file", "part", "number", *NUMBERS])


def records(piece: Piece) -> Iterator[pa.RecordBatch]:
    system, path = opened(piece.file)
    with system.open_input_file(path) as f:
        for a in range(piece.first, piece.end, BATCH):
            b = min(a + BATCH, piece.end)
            rows = np.frombuffer(f.read_at(50 * (b - a), HEAD + 50 * a), RECORD)["v"]
            yield batch_of(piece.file, piece.part, np.arange(a, b), rows)


def facet_numbers(facet: bytes, file: str) -> list[float]:
    found = re.fullmatch(rb"facet\s+normal((?:\s+\S+){3})\s+outer\s+loop((?:\s+vertex(?:\s+\S+){3}){3})\s+endloop\s+", facet, re.IGNORECASE)
    if not found:
        raise ValueError(f"{file}: a facet without a normal and three corners")
    return [float(x) for x in re.sub(rb"(?i)vertex", b"", found[1] + found[2]).split()]


def facets(piece: Piece) -> Iterator[pa.RecordBatch]:
    """Text is read on beyond the range's end until its last facet is whole; "facet" within "endfacet" begins none."""
    system, path = opened(piece.file)
    begins = re.compile(rb"(?<![A-Za-z])facet(?=\s)", re.IGNORECASE)
    ends = re.compile(rb"(?<![A-Za-z])endfacet(?![A-Za-z])", re.IGNORECASE)
    rows, number = [], 0
    with system.open_input_file(path) as f:
        size = f.size()
        if piece.first == 0 and not f.read_at(min(size, 4096), 0).lstrip().lower().startswith(b"solid"):
            raise ValueError(f"{piece.file}: neither a binary nor a text STL file")
        base = at = max(0, piece.first - 1)  # one byte before: whether a word begins at the range's begin
        held, pos = b"", min(base, 1)  # what stands first is only looked back at
        while True:
            m = begins.search(held, pos)
            if m and base + m.start() >= piece.end:
                break
            e = ends.search(held, m.start()) if m else None
            if e and (e.end() < len(held) or at >= size):
                if base + m.start() >= piece.first:
                    rows.append(facet_numbers(held[m.start() : e.start()], piece.file))
                pos = e.end()
                if len(rows) == BATCH:
                    yield batch_of(piece.file, piece.part, np.arange(number, number + len(rows)), np.array(rows))
                    number, rows = number + len(rows), []
                continue
            if at >= size:
                if m and base + m.start() >= piece.first:
                    raise ValueError(f"{piece.file}: a facet without an end")
                break
            if not m and at >= piece.end + WORD:  # nothing more begins in the range
                break
            keep = max(0, m.start() - 1) if m else max(pos - 1, len(held) - WORD, 0)
            got = f.read_at(min(STEP, size - at), at)
            base, held, at = base + keep, held[keep:] + got, at + len(got)
            pos = max(pos - keep, min(base, 1))
    if rows:
        yield batch_of(piece.file, piece.part, np.arange(number, number + len(rows)), np.array(rows))


class StlReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.paths = json.loads(options["paths"]) if "paths" in options else [options["path"]]
        self.records, self.bytes = int(options.get("records", RECORDS)), int(options.get("bytes", BYTES))

    def partitions(self) -> list[Piece]:
        out = []
        for path in self.paths:
            for file, size in listed(path):
                n = count_of(file, size)
                total, step = (size, self.bytes) if n is None else (n, self.records)
                out += [Piece(file, n is not None, k, a, min(a + step, total)) for k, a in enumerate(range(0, total, step))]
        return out or [Piece("", True, 0, 0, 0)]

    def read(self, piece: Piece) -> Iterator[pa.RecordBatch]:
        if piece.end > piece.first:
            yield from records(piece) if piece.binary else facets(piece)


@dataclass
class Written(WriterCommitMessage):
    files: list[str]
    rows: int


class FileWriter(DataSourceArrowWriter):
    """Files of a task below a folder, and what names them when all tasks have ended."""

    def __init__(self, options: dict[str, str]):
        self.folder = options["path"]

    def target(self) -> tuple[fs.FileSystem, str]:
        system, path = opened(self.folder)
        system.create_dir(path, recursive=True)
        return system, path

    def pieces(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int]]:
        raise NotImplementedError

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, rows = [], 0
        try:
            for name, n in self.pieces(b for b in iterator if b.num_rows):
                files.append(name)
                rows += n
        except BaseException:
            self.remove(files)
            raise
        return Written(files, rows)

    def remove(self, files: list[str]) -> None:
        system, path = opened(self.folder)
        for name in files:
            if system.get_file_info(f"{path}/{name}").type == fs.FileType.File:
                system.delete_file(f"{path}/{name}")

    def abort(self, messages: list[Written | None]) -> None:
        self.remove([name for m in messages if m for name in m.files])

    def publish(self, name: str, body: bytes) -> None:
        """Written beside its place and moved there: a reader finds all of it or nothing."""
        system, path = self.target()
        new = f"{path}/.{uuid.uuid4().hex}"
        with system.open_output_stream(new) as out:
            out.write(body)
        system.move(new, f"{path}/{name}")


class StlWriter(FileWriter):
    def pieces(self, batches):
        system, path = self.target()
        for batch in batches:  # a file a batch: its count stands at its head
            rows = np.zeros(batch.num_rows, RECORD)
            rows["v"] = np.stack([batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in NUMBERS], axis=1)
            name = f"{uuid.uuid4().hex}.stl"
            with system.open_output_stream(f"{path}/{name}") as out:
                out.write(b"\0" * 80 + struct.pack("<I", len(rows)) + rows.tobytes())
            yield name, len(rows)

    def commit(self, messages: list[Written]) -> None:
        files = sorted(name for m in messages if m for name in m.files)
        self.publish(INDEX, json.dumps({"files": files, "triangles": sum(m.rows for m in messages if m)}).encode())


class VtpWriter(FileWriter):
    """A file a task, with a piece for each batch of rows; the index names the files as pieces of one data set."""

    def __init__(self, options: dict[str, str]):
        super().__init__(options)
        self.step, self.fields = int(options.get("step", 0)), json.loads(options.get("fields", "[]"))

    def piece(self, batch: pa.RecordBatch) -> str:
        n = batch.num_rows
        column = lambda c: batch.column(batch.schema.get_field_index(c)).to_pylist()
        points = " ".join(f"{a} {b} {c}" for a, b, c in zip(column("x"), column("y"), column("z"), strict=True))
        data = "".join(f"<DataArray type=\"Float64\" Name={quoteattr(f)} format=\"ascii\">{' '.join(str(float(v)) for v in column(f))}</DataArray>" for f in self.fields)
        return (
            f'<Piece NumberOfPoints="{n}" NumberOfVerts="{n}" NumberOfLines="0" NumberOfStrips="0" NumberOfPolys="0">'
            f'<Points><DataArray type="Float32" NumberOfComponents="3" format="ascii">{points}</DataArray></Points>'
            f'<Verts><DataArray type="Int32" Name="connectivity" format="ascii">{" ".join(map(str, range(n)))}</DataArray><DataArray type="Int32" Name="offsets" format="ascii">{" ".join(str(i + 1) for i in range(n))}</DataArray></Verts>'
            f'<PointData><DataArray type="Int32" Name="Level" format="ascii">{" ".join(map(str, column("level")))}</DataArray>{data}</PointData></Piece>'
        )

    def pieces(self, batches):
        first = next(batches, None)
        if first is None:
            return
        system, path = self.target()
        name, n = f"snapshot_{self.step:06d}_{uuid.uuid4().hex}.vtp", 0
        try:
            with system.open_output_stream(f"{path}/{name}") as out:
                out.write(b'<?xml version="1.0"?><VTKFile type="PolyData" version="1.0" byte_order="LittleEndian"><PolyData>')
                while first is not None:
                    out.write(self.piece(first).encode())
                    n += first.num_rows
                    first = next(batches, None)
                out.write(b"</PolyData></VTKFile>\n")
        except BaseException:
            self.remove([name])
            raise
        yield name, n

    def commit(self, messages: list[Written]) -> None:
        arrays = '<PDataArray type="Int32" Name="Level"/>' + "".join(f'<PDataArray type="Float64" Name={quoteattr(f)}/>' for f in self.fields)
        pieces = "".join(f'<Piece Source="{escape(f)}"/>' for f in sorted(name for m in messages if m for name in m.files))
        body = f'<?xml version="1.0"?><VTKFile type="PPolyData" version="1.0"><PPolyData GhostLevel="0"><PPoints><PDataArray type="Float32" NumberOfComponents="3"/></PPoints><PPointData>{arrays}</PPointData>{pieces}</PPolyData></VTKFile>\n'
        self.publish(index_name(self.step), body.encode())


def index_name(step: int) -> str:
    return f"snapshot_{step:06d}.pvtp"


class StlSource(DataSource):
    """``spark.read.format("stl_triangles").load(path)``: file, part (of the file), number (of a triangle in its file, or of text in
    its part), normal and corners. Options: ``records`` and ``bytes`` of a task, ``paths`` (a JSON list)."""

    @classmethod
    def name(cls) -> str:
        return "stl_triangles"

    def schema(self) -> str:
        return "file string, part int, number long, " + ", ".join(f"{c} double" for c in NUMBERS)

    def reader(self, schema) -> StlReader:
        return StlReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> StlWriter:
        return StlWriter(dict(self.options))


class VtpSource(DataSource):
    """``df.write.format("vtp_points").mode("append").option("step", n).option("fields", json).save(folder)``."""

    @classmethod
    def name(cls) -> str:
        return "vtp_points"

    def writer(self, schema, overwrite: bool) -> VtpWriter:
        return VtpWriter(dict(self.options))
