"""WARC archives, index first: one row per record says where it lies; selected records are read by coalesced ranges.

Writing: each task writes one archive, a gzip member per record, and returns the index: file, offset, length, URL, digest.
The index is a table in the shared folder; only rows of attempts that succeeded are in it. Reading: the selected index
rows are dealt out by file, sorted by offset, and neighbours with small gaps become one byte-range read.

Records with equal payloads of at least ``min_bytes`` bytes: that with the largest ``page_id`` is the response, the others
revisit it. Smaller payloads are always responses.

Defined cases: a null html is the empty payload; a null url is written as an empty one and read back as null; rows
equal in ``page_id``, url and payload count as one record seen twice: both are responses or both revisits; a null ``page_id`` never is the response
when a row with an id has the same payload; an empty table gives no archives and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.llm import common

INDEX = "page_id long, url string, file string, offset long, length long, payload_bytes long, payload_digest string, record_type string, refers_to long"
#: Ranges of one file with at most so many bytes between them are read at once, up to so many bytes.
GAP, MOST = 64 << 10, 8 << 20


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id, url, payload: bytes, digest: str, refers_to, revisit: bool) -> bytes:
    """A response record, or a revisit record that has no payload but its digest and length."""
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {'' if url is None else url.replace(chr(13), '%0D').replace(chr(10), '%0A')}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if revisit:
        head += [f"WARC-Refers-To: <urn:page:{'' if refers_to is None else refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block += b"" if revisit else payload
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """The headers of a record, and the payload in it."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")[1:]
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
    block = rest[: int(fields["Content-Length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


def deduplicated(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Pages with ``refers_to`` and ``revisit``. Only digests that occur again are joined; each is one row."""
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", common.text_or_empty("html").alias("html"))
    own = own.withColumn("sha", F.sha1(F.encode("html", "utf-8"))).withColumn("size", F.octet_length("html"))
    again = (
        own.where(F.col("size") >= min_bytes)
        .groupBy("sha")
        .agg(F.max(F.struct("page_id", F.coalesce("url", F.lit("")).alias("u"))).alias("top"), F.count("*").alias("n"))
        .where("n > 1")
        .select("sha", F.col("top.page_id").alias("refers_to"), F.col("top.u").alias("top_url"))
    )
    joined = own.join(again, "sha", "left")
    other = ~(F.col("page_id").eqNullSafe(F.col("refers_to")) & (F.coalesce("url", F.lit("")) == F.col("top_url")))
    return joined.select("page_id", "url", "html", "refers_to", F.coalesce((F.col("size") >= min_bytes) & F.col("top_url").isNotNull() & other, F.lit(False)).alias("revisit"))


def write_archives(pages: DataFrame, out: str, min_bytes: int = 0, level: int = 1) -> DataFrame:
    """Write the archives below ``out`` (a URI); returns the index."""
    schema = pa.schema(
        [("page_id", pa.int64()), ("url", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
    )

    def write(batches):
        system, folder = common.filesystem(out)
        system.create_dir(folder, recursive=True)
        name = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
        stream, at = None, 0
        try:
            for rows in common.text_batches(batches, "page_id", "url", "html", "refers_to", "revisit"):
                index = []
                for page_id, url, html, refers_to, revisit in zip(*rows, strict=True):
                    stream = stream or system.open_output_stream(f"{folder}/{name}", compression=None)
                    payload = html.encode()
                    digest = base32_sha1(payload)
                    packer = zlib.compressobj(level, wbits=31)
                    raw = packer.compress(record(page_id, url, payload, digest, refers_to, revisit)) + packer.flush()
                    stream.write(raw)
                    index.append((page_id, url, name, at, len(raw), len(payload), digest, "revisit" if revisit else "response", refers_to if revisit else None))
                    at += len(raw)
                if index:
                    yield common.out_batch(schema, list(zip(*index, strict=True)))
        finally:
            if stream:
                stream.close()

    return common.materialised(deduplicated(pages, min_bytes).mapInArrow(write, INDEX), "warc-index")


def ranges(spans: list[tuple[int, int]], gap: int = GAP, most: int = MOST):
    """Sorted (offset, length) pairs as runs of neighbours: (first, last + 1, start byte, end byte)."""
    first = 0
    for i in range(1, len(spans) + 1):
        end = spans[i - 1][0] + spans[i - 1][1]
        if i == len(spans) or spans[i][0] - end > gap or spans[i][0] + spans[i][1] - spans[first][0] > most:
            yield first, i, spans[first][0], end
            first = i


def read_records(selected: DataFrame, out: str, payloads: bool = True) -> DataFrame:
    """The records of the selected index rows, read from the archives and checked against their digests; without ``payloads``
    the html is checked, but not returned."""
    columns = [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
    schema = pa.schema([*columns, ("html", pa.string())] if payloads else columns)

    def page_of(field: str | None):
        number = (field or "").removeprefix("<urn:page:").removesuffix(">")
        return int(number) if number else None

    def read(batches):
        system, folder = common.filesystem(out)
        name, source = None, None
        for files, offsets, lengths in common.text_batches(batches, "file", "offset", "length"):
            at = 0
            while at < len(files):
                upto = at
                while upto < len(files) and files[upto] == files[at]:
                    upto += 1
                if files[at] != name:
                    if source:
                        source.close()
                    name = files[at]
                    source = system.open_input_file(f"{folder}/{name}")
                spans = list(zip(offsets[at:upto], lengths[at:upto], strict=True))
                for a, b, start, end in ranges(spans):
                    raw, rows = source.read_at(end - start, start), []
                    for offset, length in spans[a:b]:
                        fields, payload = parse(zlib.decompress(raw[offset - start : offset - start + length], wbits=31))
                        revisit = fields["WARC-Type"] == "revisit"
                        digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                        if not revisit and base32_sha1(payload) != digest:
                            raise ValueError(f"{name} at {offset}: the payload does not have its digest")
                        size = int(fields["X-Payload-Length"]) if revisit else len(payload)
                        rows.append((page_of(fields["WARC-Record-ID"]), fields["WARC-Target-URI"] or None, size, digest, fields["WARC-Type"], page_of(fields.get("WARC-Refers-To")), *([None if revisit else payload.decode()] if payloads else [])))
                    yield common.out_batch(schema, list(zip(*rows, strict=True)))
                at = upto
        if source:
            source.close()

    dealt = selected.select("file", "offset", "length").repartition(common.even_partitions(selected), "file").sortWithinPartitions("file", "offset")
    shape = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return dealt.mapInArrow(read, f"{shape}, html string" if payloads else shape)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = common.fresh_folder(spark, "warc")
    index = write_archives(common.table(spark, sf_dir, "pages"), out)
    return read_records(index, out, payloads=False).drop("url")
