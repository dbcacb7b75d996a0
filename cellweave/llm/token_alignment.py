"""Cross-tokenizer alignment: how the tokens of two tokenizers cover the same bytes, counted over a corpus.

Equal texts are one row first: rows meet by their full text, and each distinct text is encoded by both tokenizers and aligned
once, with the number of documents that hold it. Places where tokens of both end cut a text into groups; within a group
every token of one tokenizer is linked with every token of the other.

Distinct texts are packed into blocks of ``BLOCK`` characters. A block has its distinct id pairs, each with the number of
documents that hold it, and for each text where its pairs stand in that list and how often they occur. So what moves for
the corpus-wide counts is a row for each pair of a block, and not for each pair of a text: counts are summed by pair, each
pair learns its count and whether it is the most frequent of its first id, and goes back to the blocks that asked. A
block's texts are measured from its own list. Measures come to documents by the SHA-256 of their text.

Defined cases: null and empty texts, and texts whose tokens of either tokenizer do not give back a space and the text, have no
tokens, links or groups (zeros, and an empty ``groups_sha256``), and add nothing to any count; equal texts have equal
measures, and count as often as they occur; ties for the highest count are all best; a null ``doc_id`` is kept; an empty
table gives no rows; columns other than doc_id and text are not read. A text of any length is aligned as a whole, and its
links are counted in pieces; a group of very many links is counted by its distinct ids.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.llm import common, token_files

FIRST, SECOND = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Characters of a block's texts; a longer text is a block of its own. Links that are counted at once.
BLOCK, LINKS = 1 << 22, 1 << 20
MEASURES = ["n_a", "n_b", "n_groups", "n_links"]


def flat(tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All tokens' bytes in one array, where each begins in it, and their lengths."""
    size = np.array([len(t) for t in tokens], np.int64)
    return np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(size) - size, size


def decimals(n: int, inside: str, last: str) -> np.ndarray:
    """Each id below ``n`` in decimal digits, followed by ``inside`` (row 0) or ``last`` (row 1), filled up with zero bytes."""
    width = len(str(n)) + 1
    rows = [b"".join(f"{i}{end}".encode().ljust(width, b"\0") for i in range(n)) for end in (inside, last)]
    return np.frombuffer(b"".join(rows), np.uint8).reshape(2, n, width)


class Aligner:
    """Both tokenizers, and the bytes of their tokens."""

    def __init__(self, first: str, second: str):
        import sentencepiece

        self.one = token_files.Encoder(first, "I")
        self.one.tokenizer.encode_special_tokens = True  # their strings in a text are plain text
        self.two = sentencepiece.SentencePieceProcessor(model_file=second)
        byte = {c: b for b, c in token_files.byte_letters().items()}
        names = [self.one.tokenizer.id_to_token(i) or "" for i in range(self.one.tokenizer.get_vocab_size())]
        pieces = [self.two.id_to_piece(i) for i in range(self.two.get_piece_size())]
        self.a = flat([bytes(byte[c] for c in t) if all(c in byte for c in t) else t.encode() for t in names])
        self.b = flat([bytes([int(p[3:5], 16)]) if self.two.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)])
        self.factor = len(pieces)
        self.digits_a, self.digits_b = decimals(len(names), ",", "|"), decimals(len(pieces), ",", ";")

    def ids(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(self.one.encode(" " + text), "<u4").astype(np.int64), np.array(self.two.encode(text), np.int64)


@functools.lru_cache(2)
def aligner(first: str, second: str) -> Aligner:
    """One per Python worker, which Spark keeps for the tasks that follow."""
    return Aligner(first, second)


def covers(ids: np.ndarray, tokens: tuple, want: np.ndarray) -> bool:
    """Whether the tokens' bytes, joined, are these."""
    data, begin, size = tokens
    own = size[ids]
    if own.sum() != len(want):
        return False
    at = np.repeat(begin[ids] - np.cumsum(own) + own, own) + np.arange(len(want))
    return bool((data[at] == want).all())


def pair_counts(a: np.ndarray, b: np.ndarray, m: np.ndarray, k: np.ndarray, factor: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct linked pairs (as first id times ``factor`` plus second id) and how often each occurs. Group g has the next
    m[g] tokens of ``a`` and the next k[g] of ``b``."""
    links = m * k
    first_a, first_b, before = np.cumsum(m) - m, np.cumsum(k) - k, np.cumsum(links)
    keys, times = [], []
    g = 0
    while g < len(m):
        if links[g] > LINKS:  # distinct ids, and the products of their numbers
            ua, ca = np.unique(a[first_a[g] : first_a[g] + m[g]], return_counts=True)
            ub, cb = np.unique(b[first_b[g] : first_b[g] + k[g]], return_counts=True)
            keys.append((ua[:, None] * factor + ub).ravel())
            times.append((ca[:, None] * cb).ravel())
            g += 1
            continue
        end = max(g + 1, int(np.searchsorted(before, before[g] - links[g] + LINKS, "right")))
        own_m = m[g:end]
        token = np.repeat(np.arange(g, end), own_m)  # of each first token: its group
        size = k[token]
        at = np.repeat(first_b[token] - np.cumsum(size) + size, size) + np.arange(size.sum())
        some = a[first_a[g] : first_a[g] + own_m.sum()]
        got = np.unique(np.repeat(some, size) * factor + b[at], return_counts=True)
        keys.append(got[0])
        times.append(got[1])
        g = end
    if len(keys) == 1:
        return keys[0], times[0]
    keys, where = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.zeros(len(keys), np.int64)
    np.add.at(total, where, np.concatenate(times))
    return keys, total


def aligned(text: str, by: Aligner) -> tuple[tuple[int, ...], str, np.ndarray, np.ndarray] | None:
    """n_a, n_b, n_groups and n_links; the groups' digest; distinct pairs and their occurrences. None where there are no
    tokens."""
    want = np.frombuffer((" " + text).encode(), np.uint8)
    a, b = by.ids(text)
    if not len(a) or not len(b) or not covers(a, by.a, want) or not covers(b, by.b, want):
        return None
    end_a, end_b = np.cumsum(by.a[2][a]), np.cumsum(by.b[2][b])
    last = np.zeros(len(want) + 1, np.uint8)
    last[end_a] |= 1
    last[end_b] |= 2
    cut_a, cut_b = (last[end_a] == 3).astype(np.int64), (last[end_b] == 3).astype(np.int64)
    group_a, group_b = np.cumsum(cut_a) - cut_a, np.cumsum(cut_b) - cut_b
    m, k = np.bincount(group_a), np.bincount(group_b)
    keys, times = pair_counts(a, b, m, k, by.factor)
    rows = np.zeros((len(a) + len(b), max(by.digits_a.shape[2], by.digits_b.shape[2])), np.uint8)
    rows[np.arange(len(a)) + (np.cumsum(k) - k)[group_a], : by.digits_a.shape[2]] = by.digits_a[cut_a, a]
    rows[np.arange(len(b)) + np.cumsum(m)[group_b], : by.digits_b.shape[2]] = by.digits_b[cut_b, b]
    line = rows.ravel()
    digest = hashlib.sha256(line[line != 0][:-1].tobytes()).hexdigest()
    return (len(a), len(b), len(m), int((m * k).sum())), digest, keys, times


# --- blocks ---


def packed(x: np.ndarray) -> bytes:
    """Whole numbers below 2**32, their bytes side by side by place, so that a table's compression finds the zeros."""
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def unpacked(x: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


SHAPE = "block long, keys array<long>, documents array<long>, digests array<binary>, groups array<string>, measures array<long>, sizes binary, places binary, times binary"


def as_blocks(texts: DataFrame, first: str = FIRST, second: str = SECOND) -> DataFrame:
    """texts: (text, copies), distinct. Blocks of aligned texts; texts without tokens are left out."""
    paths = common.vocabulary_path(first), common.vocabulary_path(second)

    def block(number: int, digests: list, got: list, copies: list) -> pa.RecordBatch:
        size = np.array([len(x[2]) for x in got])
        keys, where = np.unique(np.concatenate([x[2] for x in got]), return_inverse=True)
        documents = np.zeros(len(keys), np.int64)
        np.add.at(documents, where, np.repeat(np.array(copies, np.int64), size))
        begin = np.cumsum(size) - size
        step = np.diff(where, prepend=0)  # places ascend within a text
        step[begin] = where[begin]
        columns = [[number], [keys], [documents], [digests], [[x[1] for x in got]], [np.array([x[0] for x in got], np.int64).ravel()], [packed(size)], [packed(step)], [packed(np.concatenate([x[3] for x in got]))]]
        types = [pa.int64(), *[pa.list_(pa.int64())] * 2, pa.list_(pa.binary()), pa.list_(pa.string()), pa.list_(pa.int64()), *[pa.binary()] * 3]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[x.split()[0] for x in SHAPE.split(", ")])

    def run(batches):
        by, number, held = aligner(*paths), TaskContext.get().partitionId() << 32, 0
        digests, got, copies = [], [], []
        for some, counts in common.text_batches(batches, "text", "copies"):
            for text, n in zip(some, counts, strict=True):
                found = aligned(text, by)
                if found is None:
                    continue
                if held + len(text) > BLOCK and got:
                    yield block(number, digests, got, copies)
                    digests, got, copies, held, number = [], [], [], 0, number + 1
                digests.append(hashlib.sha256(text.encode()).digest())
                got.append(found)
                copies.append(n)
                held += len(text)
        if got:
            yield block(number, digests, got, copies)

    return texts.select("text", "copies").mapInArrow(run, SHAPE)


def pair_table(blocks: DataFrame, factor: int) -> DataFrame:
    """(key, n, best): in how many documents of the corpus a pair is linked, and whether no pair of its first id is in more."""
    each = blocks.select(F.explode(F.arrays_zip("keys", "documents")).alias("x")).groupBy(F.col("x.keys").alias("key")).agg(F.sum("x.documents").alias("n"))
    counts = common.materialised(each.withColumn("first", F.floor(F.col("key") / factor).cast("int")), "pair-counts")
    most = counts.groupBy("first").agg(F.max("n").alias("most"))
    return counts.join(most, "first").select("key", "n", (F.col("n") == F.col("most")).alias("best"))


def measured(blocks: DataFrame, pairs: DataFrame) -> DataFrame:
    """(digest, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every text."""
    asked = blocks.select("block", F.posexplode("keys").alias("place", "key")).join(pairs, "key")
    told = asked.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("place", "n", "best"))).alias("x"))  # a block's own pairs
    met = blocks.select("block", "digests", "groups", "measures", "sizes", "places", "times").join(told.select("block", F.col("x.n").alias("n"), F.col("x.best").alias("best")), "block")

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(batch.schema.get_field_index(name))[i] for name in ("digests", "groups", "measures", "sizes", "places", "times", "n", "best")}
                size, times = unpacked(row["sizes"].as_py()), unpacked(row["times"].as_py())
                begin = np.cumsum(size) - size
                # steps are differences within a text: undo them over all texts at once
                where = np.cumsum(unpacked(row["places"].as_py()))
                where = where - np.repeat(np.r_[0, where[begin[1:] - 1]], size)
                n, best = row["n"].values.to_numpy(), row["best"].values.to_numpy(zero_copy_only=False)
                sums = np.add.reduceat(n[where] * times, begin)
                n_best = np.add.reduceat(best[where] * times, begin)
                measures = row["measures"].values.to_numpy().reshape(-1, len(MEASURES))
                columns = [row["digests"].values, *(pa.array(measures[:, j]) for j in range(len(MEASURES))), pa.array(n_best), pa.array(sums), row["groups"].values]
                yield pa.RecordBatch.from_arrays(columns, names=["digest", *MEASURES, "n_best", "count_sum", "groups_sha256"])

    numbers = ", ".join(f"{c} long" for c in (*MEASURES, "n_best", "count_sum"))
    return met.mapInArrow(run, f"digest binary, {numbers}, groups_sha256 string")


def alignment(docs: DataFrame, first: str = FIRST, second: str = SECOND) -> DataFrame:
    """doc_id and the measures of its text, for every document."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    full = F.col("text").isNotNull() & (F.col("text") != "")
    distinct = docs.where(full).groupBy("text").agg(F.count("*").alias("copies"))
    blocks = common.materialised(as_blocks(distinct, first, second), "token-blocks")
    factor = aligner(common.vocabulary_path(first), common.vocabulary_path(second)).factor
    found = common.materialised(measured(blocks, pair_table(blocks, factor)), "token-measures")
    numbers = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in (*MEASURES, "n_best", "count_sum")]
    columns = ["doc_id", *numbers, F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256")]
    met = docs.where(full).select("doc_id", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest")).join(found, "digest", "left").select(columns)
    nothing = [F.lit(0).cast("long").alias(c) for c in (*MEASURES, "n_best", "count_sum")]
    return met.unionByName(docs.where(~F.coalesce(full, F.lit(False))).select("doc_id", *nothing, F.lit("").alias("groups_sha256")))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment(common.documents(spark, sf_dir))
