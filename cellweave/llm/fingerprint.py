"""Document fingerprints: invertible Bloom lookup sketches of a text's paragraphs.

A text is cut into paragraph pieces: at line ends and after sentence ends, and where a piece has reached ``PIECE``
characters. A piece's digest is its 64-bit hash mixed with how often it has come before, so that a repeated paragraph
counts as often as it occurs. A sketch is a table of cells (count, xor of digests, xor of checks); each digest goes into
one cell of each third of the table. The difference of two sketches has only the digests of one side; peeling cells of
count one recovers them. Where peeling gets stuck, both sketches are built again with twice the cells.

Likeness is the number of digests in both texts over the number in either, from the recovered differences. The fingerprint
that is returned is the least table that can be peeled alone, so that a reader finds the same likeness from fingerprints.

Defined cases: a null text is the empty text, which has no digests; two empty texts have likeness 1; the last document's
next one is the first, and a single document's next one is itself; a null ``doc_id`` comes first; equal ``doc_id`` values
are taken in order of their texts; an empty table gives no rows; columns other than the two named are not read.
"""

from __future__ import annotations

import binascii
import hashlib
import json
import math
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.llm import common

PIECE = 120
PIECES = re.compile(rf"[^\n.!?]{{1,{PIECE}}}[.!?]*|[.!?]+")
#: Cells of the smallest sketch; a multiple of three.
CELLS = 24
NULL_ID = -(2**63)
CHECK = 0x5BD1E995
U64 = np.uint64


def mixed(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit mixer of integers; wraps around by design."""
    x = x + U64((seed * 0x9E3779B97F4A7C15) % 2**64)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def digests(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(document number, digest) of every piece, sorted; a set for each document."""
    each = [PIECES.findall(t) for t in texts]
    doc = np.repeat(np.arange(len(texts)), [len(p) for p in each])
    h = np.fromiter((xxhash.xxh3_64_intdigest(p.strip()) for ps in each for p in ps), U64, len(doc))
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    if len(h):
        new = np.r_[True, (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])]
        begins = np.flatnonzero(new)
        before = np.arange(len(h)) - begins[np.cumsum(new) - 1]
        h = mixed(h + before.astype(U64) * U64(0xD6E8FEB86659FD93), 7)
    return doc, h


class Sketches:
    """A table of ``cells`` for each of ``n`` documents."""

    def __init__(self, n: int, cells: int):
        self.n, self.cells = n, cells
        self.count, self.keys, self.check = np.zeros(n * cells, np.int64), np.zeros(n * cells, U64), np.zeros(n * cells, U64)

    def put(self, doc: np.ndarray, key: np.ndarray, sign) -> None:
        third = self.cells // 3
        check = mixed(key, CHECK)
        for j in range(3):
            at = doc * self.cells + j * third + (mixed(key, j + 1) % U64(third)).astype(np.int64)
            np.add.at(self.count, at, sign)
            np.bitwise_xor.at(self.keys, at, key)
            np.bitwise_xor.at(self.check, at, check)

    def minus(self, other: Sketches) -> Sketches:
        out = Sketches(self.n, self.cells)
        out.count, out.keys, out.check = self.count - other.count, self.keys ^ other.keys, self.check ^ other.check
        return out

    def peeled(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each document: how many digests came out, and whether its table is empty then."""
        found = np.zeros(self.n, np.int64)
        look = np.arange(self.n * self.cells)
        while True:
            look = look[np.abs(self.count[look]) == 1]
            pure = look[self.check[look] == mixed(self.keys[look], CHECK)]
            if not len(pure):
                break
            doc, key, sign = pure // self.cells, self.keys[pure], self.count[pure]
            _, first = np.unique(np.stack([doc.astype(U64), key]), axis=1, return_index=True)
            doc, key, sign = doc[first], key[first], sign[first]
            self.put(doc, key, -sign)
            np.add.at(found, doc, 1)
            third = self.cells // 3
            look = np.unique(np.concatenate([doc * self.cells + j * third + (mixed(key, j + 1) % U64(third)).astype(np.int64) for j in range(3)]))
        left = (self.count != 0) | (self.keys != 0)
        return found, ~left.reshape(self.n, self.cells).any(axis=1)

    def as_text(self, rows: np.ndarray) -> list[str]:
        """The tables of some documents: their number of cells, then counts, digests and checks."""
        shaped = [x.reshape(self.n, self.cells)[rows] for x in (self.count.astype("<i4"), self.keys, self.check)]
        head = np.array([self.cells], "<u4").tobytes()
        return [binascii.b2a_base64(head + b"".join(x[i].tobytes() for x in shaped), newline=False).decode() for i in range(len(shaped[0]))]


def sketched(n: int, doc: np.ndarray, key: np.ndarray, cells: int = CELLS) -> Sketches:
    out = Sketches(n, cells)
    out.put(doc, key, 1)
    return out


def standalone(n: int, doc: np.ndarray, key: np.ndarray) -> list[str]:
    """Fingerprints of n digest sets: tables of the least size, doubled from ``CELLS`` on, that peeling empties alone."""
    out, open_, cells = [""] * n, np.arange(n), CELLS
    while len(open_):
        place = np.full(n, -1)
        place[open_] = np.arange(len(open_))
        mine = place[doc] >= 0
        own = sketched(len(open_), place[doc[mine]], key[mine], cells)
        _, done = own.minus(Sketches(len(open_), cells)).peeled()
        for i, text in zip(open_[done], own.as_text(done), strict=True):
            out[i] = text
        open_, cells = open_[~done], cells * 2
    return out


def recovered(fingerprint: str) -> set[int]:
    """The digests of a fingerprint, by peeling."""
    raw = binascii.a2b_base64(fingerprint)
    cells = int(np.frombuffer(raw, "<u4", 1)[0])
    own = Sketches(1, cells)
    own.count = np.frombuffer(raw, "<i4", cells, 4).astype(np.int64)
    own.keys, own.check = (np.frombuffer(raw, "<u8", cells, 4 + 4 * cells + 8 * cells * k).astype(U64) for k in (0, 1))
    found: set[int] = set()
    while True:
        pure = np.flatnonzero((own.count == 1) & (own.check == mixed(own.keys, CHECK)))
        keys = np.unique(own.keys[pure])
        if not len(keys):
            break
        found.update(keys.tolist())
        own.put(np.zeros(len(keys), np.int64), keys, -1)
    if own.count.any() or own.keys.any():
        raise ValueError("the fingerprint cannot be peeled")
    return found


def likeness_of(a: str, b: str) -> float:
    """The likeness of two fingerprints, from nothing else."""
    x, y = recovered(a), recovered(b)
    return len(x & y) / len(x | y) if x or y else 1.0


def likeness(n: int, a: tuple, b: tuple, cells: int = CELLS) -> np.ndarray:
    """Of n pairs of digest sets, by peeling differences; pairs that get stuck try again with twice the cells."""
    size_a, size_b = (np.bincount(x[0], minlength=n) for x in (a, b))
    differing, open_ = np.zeros(n, np.int64), np.arange(n)
    while len(open_):
        place = np.full(n, -1)
        place[open_] = np.arange(len(open_))
        some = [(place[d[k]], h[k]) for d, h in (a, b) for k in [place[d] >= 0]]
        found, done = sketched(len(open_), *some[0], cells).minus(sketched(len(open_), *some[1], cells)).peeled()
        differing[open_[done]] = found[done]
        open_, cells = open_[~done], cells * 2
    both = (size_a + size_b - differing) / 2
    either = size_a + size_b - both
    return np.where(either > 0, both / np.maximum(either, 1), 1.0)


def edited(text: str, following: str) -> str:
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def constant(values: list, kind: str) -> Column:
    """A list as one constant, however long it is."""
    return F.from_json(F.lit(json.dumps(values)), kind)


def bucket_of(key: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds are at most the key: looked up in groups of bounds, then in one group."""
    if not bounds:
        return F.lit(0)
    size = max(1, math.isqrt(len(bounds)))
    groups = [bounds[i : i + size] for i in range(0, len(bounds), size)]
    upto = F.size(F.filter(constant([g[0] for g in groups], "array<bigint>"), lambda b: b <= key))
    inside = F.size(F.filter(F.get(constant(groups, "array<array<bigint>>"), upto - 1), lambda b: b <= key))
    return F.when(upto == 0, F.lit(0)).otherwise((upto - 1) * size + inside)


def dealt_with_next(docs: DataFrame) -> DataFrame:
    """Documents in ascending order within buckets of the id; after each bucket's rows comes the first of the next bucket,
    as a row that is not ``own``. Only bucket bounds and first ids, one of each a bucket, pass through the driver."""
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_or_empty().alias("text"), key.alias("key"))
    n = 3 * common.even_partitions(docs)
    bounds = sorted({int(b) for b in own.stat.approxQuantile("key", [i / n for i in range(1, n)], 0.2 / n)})
    bucket = bucket_of(F.col("key"), bounds)
    firsts = {r["bucket"]: r["first"] for r in own.groupBy(bucket.alias("bucket")).agg(F.min("key").alias("first")).collect()}
    full = sorted(firsts)
    place = {b: i for i, b in enumerate(full)}
    head = constant([firsts.get(b) for b in range(len(bounds) + 1)], "array<bigint>")
    before = constant([full[place[b] - 1] if b in place else None for b in range(len(bounds) + 1)], "array<int>")
    once = F.struct(F.col("bucket"), F.lit(True).alias("own"))
    again = F.struct(F.get(before, F.col("bucket")).alias("bucket"), F.lit(False).alias("own"))
    is_head = F.col("key") == F.get(head, F.col("bucket"))
    placed = own.withColumn("bucket", bucket).withColumn("at", F.explode(F.when(is_head, F.array(once, again)).otherwise(F.array(once))))
    return (
        placed.select("doc_id", "text", "key", "at.bucket", "at.own")
        .repartition(n // 3, "bucket")
        .sortWithinPartitions("bucket", F.desc("own"), "key", "text")
    )


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprints(docs: DataFrame) -> DataFrame:
    """Per document: its sketch, its edited text's sketch, and the likeness of its own to that and to the next document's."""

    def results(ids: list, texts: list[str]) -> pa.RecordBatch:
        """Of all rows but the last, each with the row after it."""
        n = len(texts) - 1
        plain = digests(texts)
        changed = [edited(a, b) for a, b in zip(texts, texts[1:], strict=False)]
        new = digests(changed)
        own = tuple(x[plain[0] < n] for x in plain)
        following = tuple(x[plain[0] > 0] for x in plain)
        following = (following[0] - 1, following[1])
        return pa.RecordBatch.from_pydict(
            {
                "doc_id": pa.array(ids[:n], pa.int64()),
                "n_chars": pa.array([len(t) for t in texts[:n]], pa.int64()),
                "edited_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in changed],
                "fingerprint": standalone(n, *own),
                "edited_fingerprint": standalone(n, *new),
                "near_edited": likeness(n, own, new),
                "near_next": likeness(n, own, following),
            }
        )

    def run(batches):
        ids, texts, size = [], [], 0
        bucket, ended = None, False
        for rows in common.text_batches(batches, "doc_id", "text", "bucket", "own"):
            for doc_id, text, at, own in zip(*rows, strict=True):
                if at != bucket:
                    ids, texts, size, bucket, ended = [], [], 0, at, False
                if ended:
                    continue
                ids.append(doc_id)
                texts.append(text)
                size += len(text)
                ended = not own
                if (ended or size > 2_000_000 or len(texts) > 1000) and len(texts) > 1:
                    yield results(ids, texts)
                    ids, texts, size = ids[-1:], texts[-1:], len(text)

    return dealt_with_next(docs).mapInArrow(run, SCHEMA)


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(common.documents(spark, sf_dir))
