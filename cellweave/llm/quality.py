"""A quality classifier: regularised quadratic discriminant over transformed statistics of whole texts.

Statistics are counted on the UTF-8 bytes and words of a text, then put through logarithms so that each is near normal
within a class. Each class has its mean and its covariance, shrunk towards the pooled one and towards its diagonal;
Cholesky factors are computed once, on the driver, from sums that Spark gathers (their number depends on the count of
statistics alone). A text's score is the difference of its log densities and log priors, squashed to (0, 1); at 0.5 both
classes are as likely.

Learning takes the labelled rows that are not held out: crc32 of the id as text, modulo 3, is not 1. Labels, lang, source
and doc_id are never part of a score.

Defined cases: a null text is the empty text, which has a score too; labels without an id or a quality are left out;
repeated documents and labels count as often as they occur; without labelled rows of both classes every score is 0.5 (and
predicted 1); an empty table gives no rows; other columns are not read, whatever their names. A text of any length is
counted in blocks, with the hashes of its distinct words beside them.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.llm import common

SPACE, LOWER, UPPER, DIGIT, STOP, BAR, BANG, SYMBOL, HIGH, LINE, CLASSES = range(11)
#: Texts are counted in blocks of so many bytes.
BLOCK = 1 << 18
#: Shares of the pooled covariance, and of its diagonal, in each class's covariance.
TO_POOLED, TO_DIAGONAL = 0.05, 0.05


def byte_classes() -> np.ndarray:
    out = np.full(256, SYMBOL, np.uint8)
    for chars, kind in ((b" \t\r\v\f", SPACE), (b"\n", LINE), (bytes(range(97, 123)), LOWER), (bytes(range(65, 91)), UPPER), (bytes(range(48, 58)), DIGIT), (b".,;:?'\"-()", STOP), (b"|", BAR), (b"!", BANG), (bytes(range(128, 256)), HIGH)):
        out[list(chars)] = kind
    return out


KIND = byte_classes()
#: A fixed odd factor and its inverse modulo 2**64: words are hashed as sums of byte times power.
FACTOR = 0x9E3779B97F4A7C15
INVERSE = pow(FACTOR, -1, 2**64)


@functools.lru_cache(1)
def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """The factor's and its inverse's powers from 1 to ``size``."""
    with np.errstate(over="ignore"):
        return tuple(np.cumprod(np.full(size, f, np.uint64)) for f in (FACTOR, INVERSE))


def words_of(data: np.ndarray, kind: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where words begin, their lengths and hashes; no word crosses one of ``starts``. At most ``BLOCK`` bytes."""
    solid = (kind != SPACE) & (kind != LINE)
    edge = np.zeros(len(data) + 1, bool)
    edge[starts], edge[-1] = True, True
    before, after = np.r_[False, solid[:-1]], np.r_[solid[1:], False]
    begin = np.flatnonzero(solid & (~before | edge[:-1]))
    end = np.flatnonzero(solid & (~after | edge[1:])) + 1
    power, back = powers(BLOCK + 1)
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(977)) * power[: len(data)])])
        return begin, end - begin, (total[end] - total[begin]) * back[begin]


def block_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Of the texts data[offsets[i]:offsets[i + 1]], a block in all: bytes by class, then words, words equal to the one before,
    sums of their lengths and of the squares, and distinct words."""
    n, size = len(offsets) - 1, np.diff(offsets)
    doc = np.repeat(np.arange(n, dtype=np.int32), size)
    kind = KIND[data]
    counts = np.bincount(doc * CLASSES + kind, minlength=n * CLASSES).reshape(n, CLASSES)
    begin, length, word = words_of(data, kind, offsets[:-1][size > 0])
    of = doc[begin]
    with np.errstate(over="ignore"):
        mixed = (word ^ (of.astype(np.uint64) * np.uint64(0xD1342543DE82EF95))) * np.uint64(0xBF58476D1CE4E5B9)
    again = of[1:][(word[1:] == word[:-1]) & (of[1:] == of[:-1])]
    _, where = np.unique(mixed, return_index=True)
    per_doc = [np.bincount(of, minlength=n), np.bincount(again, minlength=n), np.bincount(of, length, n), np.bincount(of, length.astype(float) ** 2, n), np.bincount(of[where], minlength=n)]
    return np.column_stack([counts, *per_doc]).astype(float)


def long_counts(data: np.ndarray) -> np.ndarray:
    """The same of one text of any length, a block at a time; a word that a block's end cuts goes on in the next one. What
    is held is a block, and the hashes of the distinct words."""
    out, seen = np.zeros(CLASSES + 5), np.zeros(0, np.uint64)
    last, carried, carried_length = None, 0, 0
    for a in range(0, len(data), BLOCK):
        piece = data[a : a + BLOCK]
        kind = KIND[piece]
        out[:CLASSES] += np.bincount(kind, minlength=CLASSES)
        begin, length, word = words_of(piece, kind, np.zeros(1, np.int64))
        if carried_length and len(begin) and begin[0] == 0:
            word[0] = np.uint64((carried + int(word[0]) * pow(FACTOR, carried_length, 2**64)) % 2**64)
            length[0] += carried_length
        elif carried_length:
            word, length = np.r_[np.uint64(carried), word], np.r_[carried_length, length]
        carried, carried_length = 0, 0
        if a + BLOCK < len(data) and kind[-1] not in (SPACE, LINE):
            carried, carried_length = int(word[-1]), int(length[-1])
            word, length = word[:-1], length[:-1]
        if len(word):
            out[CLASSES : CLASSES + 4] += len(word), (word[1:] == word[:-1]).sum() + (word[0] == last), length.sum(), (length.astype(float) ** 2).sum()
            last = word[-1]
            seen = np.union1d(seen, word)
    out[-1] = len(seen)
    return out[None]


def transformed(counted: np.ndarray) -> np.ndarray:
    """Counts as statistics that are near normal: a row of 13 for each text."""
    counts, (words, again, total, squares, distinct) = counted[:, :CLASSES], counted[:, CLASSES:].T
    size = counts.sum(axis=1)
    letters = counts[:, LOWER] + counts[:, UPPER] + counts[:, HIGH]
    mean = total / np.maximum(words, 1)
    spread = np.sqrt(np.maximum(squares / np.maximum(words, 1) - mean**2, 0))
    share = lambda part, whole, least=1.0: np.log((part + least) / (whole + 20 * least))
    return np.stack(
        [
            np.log1p(words),
            np.log1p(mean),
            np.log1p(spread),
            share(counts[:, UPPER], letters),
            share(counts[:, DIGIT], size),
            share(counts[:, SYMBOL], size),
            share(counts[:, BAR], words),
            share(counts[:, BANG], words),
            share(counts[:, STOP], words),
            share(counts[:, LINE], words),
            share(again, words),
            np.log1p(distinct) / np.maximum(np.log1p(words), 0.5),
            np.log((counts[:, SYMBOL] + counts[:, BAR] + counts[:, BANG] + again + 1) / (words + 1)),
        ],
        axis=1,
    )


def of_texts(column: pa.Array) -> np.ndarray:
    """The statistics of an arrow column of texts, counted block by block."""
    column = pc.fill_null(column, "").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    buffer = column.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None else np.zeros(0, np.uint8)
    out, at = [np.zeros((0, CLASSES + 5))], 0
    while at < len(column):
        upto = int(np.searchsorted(offsets, offsets[at] + BLOCK, "right")) - 1
        upto = min(upto, len(column))
        if upto > at:
            out.append(block_counts(data[offsets[at] : offsets[upto]], offsets[at : upto + 1] - offsets[at]))
        else:
            upto = at + 1
            out.append(long_counts(data[offsets[at] : offsets[upto]]))
        at = upto
    return transformed(np.concatenate(out))


class Model:
    """Class means, inverse Cholesky factors and log determinants; None where a class has no rows."""

    def __init__(self, sums: dict[int, tuple[float, np.ndarray, np.ndarray]]):
        self.parts = None
        if len(sums) < 2:
            return
        n = {k: s[0] for k, s in sums.items()}
        mean = {k: s[1] / s[0] for k, s in sums.items()}
        own = {k: s[2] / s[0] - np.outer(mean[k], mean[k]) for k, s in sums.items()}
        pooled = sum(n[k] * own[k] for k in own) / sum(n.values())
        self.parts = {}
        for k in sums:
            cov = (1 - TO_POOLED - TO_DIAGONAL) * own[k] + TO_POOLED * pooled + TO_DIAGONAL * np.diag(np.diag(pooled)) + 1e-6 * np.eye(len(pooled))
            factor = np.linalg.cholesky(cov)
            self.parts[k] = (mean[k], np.linalg.inv(factor), np.log(np.diag(factor)).sum() - np.log(n[k] / sum(n.values())))

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.parts is None:
            return np.full(len(x), 0.5)
        density = {k: -0.5 * (((x - mean) @ inverse.T) ** 2).sum(axis=1) - rest for k, (mean, inverse, rest) in self.parts.items()}
        d = density[1] - density[0]
        return 0.5 + 0.5 * d / (1 + np.abs(d))


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.encode(F.col(doc_id).cast("string"), "utf-8")) % 3 == 1, F.lit(False))


def features(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of its text."""

    def run(batches):
        for batch in batches:
            x = of_texts(batch.column(1))
            flat = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), flat], names=["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, x array<double>")


def fitted(feats: DataFrame, labels: DataFrame) -> Model:
    """The model of the labelled rows that are not held out. To the driver come only sums: one for each pair of statistics."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("quality in (0, 1)")
    rows = common.materialised(feats.join(known, "doc_id").where(~held_out()).select("quality", "x"), "labelled")

    def sums(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            if batch.num_rows:
                q = batch.column(0).to_numpy(zero_copy_only=False)
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(q), -1)
                for k in np.unique(q):
                    own = x[q == k]
                    part = np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).ravel()])
                    total[int(k)] = total.get(int(k), 0) + part
        for k, part in total.items():
            yield pa.RecordBatch.from_pydict({"quality": pa.array([k] * len(part), pa.int32()), "place": pa.array(range(len(part)), pa.int32()), "part": part})

    gathered = rows.mapInArrow(sums, "quality int, place int, part double").groupBy("quality", "place").agg(F.sum("part").alias("part")).collect()
    found: dict[int, dict[int, float]] = {}
    for r in gathered:
        found.setdefault(r["quality"], {})[r["place"]] = r["part"]
    out = {}
    for k, parts in found.items():
        flat = np.array([parts[i] for i in range(len(parts))])
        d = int((np.sqrt(4 * len(flat) - 3) - 1) / 2)
        out[k] = (flat[0], flat[1 : d + 1], flat[d + 1 :].reshape(d, d))
    return Model(out)


def scored(feats: DataFrame, model: Model) -> DataFrame:
    def run(batches):
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            s = model.scores(x) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "score": s, "predicted": pa.array((s >= 0.5).astype(np.int32))})

    got = feats.mapInArrow(run, "doc_id long, score double, predicted int")
    return got.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that the model predicts to be good, with all their columns. Only texts go to Python."""

    @F.arrow_udf("boolean")
    def good(text: pa.Array) -> pa.Array:
        return pa.array(model.scores(of_texts(text)) >= 0.5)

    return docs.where(good(F.col("text")))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    feats = common.materialised(features(common.documents(spark, sf_dir)), "statistics")
    return scored(feats, fitted(feats, common.table(spark, sf_dir, "labels")))
