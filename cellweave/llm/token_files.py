"""Token-id files: flat unsigned integers beside 64-bit document offsets, memory-mapped when read.

Layout of one output: for each partition, in ascending ``doc_id`` order over all partitions,

* ``<name>.ids``: the token ids, little-endian unsigned integers of the smallest width that holds the vocabulary;
* ``<name>.off``: ``n_docs + 1`` unsigned 64-bit offsets into that file, in ids;
* ``<name>.doc``: the documents' ids as signed 64-bit integers (a null id is the smallest integer).

The manifest, a table, names the files of the attempts that succeeded and has each partition's base: the prefix sum of
the counts of the partitions before it. ``base + offset`` is a position in the whole corpus.

Defined cases: a null text is the empty text (its only id is the end id); a null ``doc_id`` sorts first; equal
``doc_id`` values are written in order of their texts; an empty table gives an empty manifest and no rows; columns other
than the two named are not read.
"""

from __future__ import annotations

import array
import functools
import json
import re
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellweave.llm import common

#: The parts into which a byte-level tokenizer splits a text before it merges bytes, for Latin letters.
LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ʯ"
SPLIT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[0-9]+| ?[^\\s0-9{LETTERS}]+|\\s+(?!\\S)|\\s+")
#: A character outside these may be a letter, a number or white space that SPLIT does not know.
UNKNOWN = re.compile(f"[^\\x09-\\x0d\\x20-\\x7e{LETTERS}¡-©«¬®-±´¶-¸»¿×÷‐-―‘-‟†-…€]")
NULL_ID = -(2**63)
MANIFEST = "part int, file string, n_docs long, n_tokens long"
#: Words that one Python worker remembers before it starts anew: about 100 MB.
REMEMBERED = 600_000


@functools.cache
def byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


def by_words(file: dict) -> bool:
    """Whether a tokenizer's file has no normaliser, the plain byte-level split, and merges that forget nothing."""
    split, model = file.get("pre_tokenizer") or {}, file["model"]
    plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
    merges = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
    return bool(plain and merges and not file.get("normalizer") and not file.get("truncation") and not file.get("padding"))


class Encoder:
    """Whole texts to id bytes with the tokenizers library. Where the file asks for nothing but the byte-level split and merges,
    each distinct word goes through its merges once; texts of other files, or with characters or special tokens that the
    split does not know, are encoded by the library as a whole."""

    def __init__(self, path: str, width: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.width, self.known = Tokenizer.from_file(path), width, {}
        self.model, self.letters = self.tokenizer.model, byte_letters()
        added = self.tokenizer.get_added_tokens_decoder()
        self.special = [str(t.content) for t in added.values()]
        self.by_words = by_words(json.loads(self.tokenizer.to_str()))

    def word(self, word: str) -> bytes:
        mapped = word.encode().decode("latin-1").translate(self.letters)
        return array.array(self.width, [t.id for t in self.model.tokenize(mapped)]).tobytes()

    def whole(self, text: str) -> bytes:
        return array.array(self.width, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, text: str) -> bytes:
        if not self.by_words or UNKNOWN.search(text) or any(s in text for s in self.special):
            return self.whole(text)
        words = SPLIT.findall(text)
        try:
            return b"".join(map(self.known.__getitem__, words))
        except KeyError:
            if len(self.known) > REMEMBERED:
                self.known.clear()
            known, word = self.known, self.word
            for w in words:
                if w not in known:
                    known[w] = word(w)
            return b"".join(map(known.__getitem__, words))


@functools.cache
def encoder(path: str, width: str) -> Encoder:
    """One per Python worker, which Spark keeps for the tasks that follow."""
    return Encoder(path, width)


def write_token_files(
    docs: DataFrame, out: str, tokenizer: str = "byte_bpe_50k.json", end_id: int = 2, partitions: int | None = None
) -> DataFrame:
    """Encode, append ``end_id``, write the files below ``out`` (a URI); returns the manifest with each partition's base."""
    from tokenizers import Tokenizer

    path = common.vocabulary_path(tokenizer)
    width = "H" if max(Tokenizer.from_file(path).get_vocab_size(), end_id + 1) <= 2**16 else "I"

    def write(batches):
        enc = encoder(path, width)
        system, folder = common.filesystem(out)
        system.create_dir(folder, recursive=True)
        part = TaskContext.get().partitionId()
        name = f"{folder}/{part:06d}-{uuid.uuid4().hex}"
        end, offsets, ids = array.array(width, [end_id]).tobytes(), [0], []
        at = 0
        size = array.array(width).itemsize
        with system.open_output_stream(f"{name}.ids") as stream:
            for doc_ids, texts in common.text_batches(batches, "doc_id", "text"):
                for doc_id, text in zip(doc_ids, texts, strict=True):
                    got = enc.encode(text or "") + end
                    stream.write(got)
                    at += len(got) // size
                    offsets.append(at)
                    ids.append(NULL_ID if doc_id is None else doc_id)
        with system.open_output_stream(f"{name}.off") as stream:
            stream.write(np.array(offsets, "<u8").tobytes())
        with system.open_output_stream(f"{name}.doc") as stream:
            stream.write(np.array(ids, "<i8").tobytes())
        if ids:
            yield pa.RecordBatch.from_pydict(
                {"part": pa.array([part], pa.int32()), "file": [name.removeprefix(folder + "/")], "n_docs": [len(ids)], "n_tokens": [at]}
            )

    dealt = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .repartitionByRange(partitions or common.even_partitions(docs), F.col("doc_id").asc_nulls_first())
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())
    )
    manifest = common.materialised(dealt.mapInArrow(write, MANIFEST), "token-manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    return manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))).withColumn("width", F.lit(width))


def read_token_files(manifest: DataFrame, out: str) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens and the CRC-32 of its ids as 32-bit integers."""

    def read(batches):
        system, folder = common.filesystem(out)

        def array_of(name: str, kind: str):
            if common.is_local(system):
                return np.memmap(f"{folder}/{name}", kind, "r")
            with system.open_input_file(f"{folder}/{name}") as f:
                return np.frombuffer(f.read(), kind)

        for files, bases, widths in common.text_batches(batches, "file", "base", "width"):
            for file, base, width in zip(files, bases, widths, strict=True):
                ids, off = array_of(f"{file}.ids", "<u2" if width == "H" else "<u4"), array_of(f"{file}.off", "<u8").astype("i8")
                doc = np.array(array_of(f"{file}.doc", "<i8"))
                for a in range(0, len(doc), 10_000):
                    b = min(len(doc), a + 10_000)
                    some = np.array(ids[off[a] : off[b]]).astype("<u4")
                    cut = off[a : b + 1] - off[a]
                    crc = [zlib.crc32(some[i:j]) for i, j in zip(cut[:-1], cut[1:], strict=True)]
                    yield pa.RecordBatch.from_pydict(
                        {
                            "doc_id": pa.array(doc[a:b], pa.int64(), mask=doc[a:b] == NULL_ID),
                            "start": pa.array(off[a:b] + base, pa.int64()),
                            "n_tokens": pa.array(np.diff(off[a : b + 1]), pa.int64()),
                            "ids_crc32": pa.array(crc, pa.int64()),
                        }
                    )

    spread = manifest.select("file", "base", "width").repartition(common.even_partitions(manifest))
    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = common.fresh_folder(spark, "token-files")
    return read_token_files(write_token_files(common.documents(spark, sf_dir), out), out)
