"""SentencePiece encoding and decoding: the best segmentation by a max-plus scan over chunks.

A segmentation's score is the sum of its pieces' scores; the best one is a shortest path, so its pieces of a text follow
from (max, +) products. A text longer than ``CHUNK`` characters is split into chunks that any task can take. A chunk's
transfer matrix has, for i characters that a piece from before covers and j characters that its last piece covers
beyond it, the best score between. Products of matrices over blocks of chunks, then over the blocks, give the scores at
each chunk's start; with these each chunk traces back, for every state at its end, to a state at its start. Composing
those maps from the end of the text fixes the states, and each chunk is then segmented on its own. Shorter texts are one
chunk, with one state at either end. Where no piece can cross a place (before a space mark, around characters without a
longer piece), paths meet; the words between such places are solved once and remembered.

Among segmentations of the same score the one with the longest last piece wins, then of those before it, and so on; that
holds over chunk borders too. Characters without a piece become byte pieces.

New words of a batch are searched together, position by position, in arrays.

The given vocabulary was made by byte-pair merges; its scores are merge ranks. Here they are summed, as in the library's
unigram mode: ids follow that mode, not the order of merges. Decoding gives back the text either way.

Defined cases: a null text is the empty text, which has no pieces; equal rows give equal results; an empty table gives no
rows; columns other than the two named are not read. ``exact`` tells whether decoding gives back the text; a text that
holds the space mark itself decodes to spaces there.
"""

from __future__ import annotations

import contextlib
import functools
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.llm import common

MARK = "▁"
CHUNK = 32_768
#: Chunks whose matrices one task multiplies.
BLOCK = 64
#: Bytes of remembered words in a task, about; they go when the task ends.
REMEMBERED = 32_000_000
#: Words up to so many characters are searched in arrays.
WIDE = 40
NONE = -np.inf


class Tree:
    """All pieces as a tree of characters; steps are looked up in a hash table, for many words at once."""

    SIZE = 2**18

    def __init__(self, pieces: dict[str, tuple[float, int]]):
        nodes, steps = {"": 0}, []
        for p in pieces:
            for k in range(1, len(p) + 1):
                if p[:k] not in nodes:
                    nodes[p[:k]] = len(nodes)
                    steps.append((nodes[p[: k - 1]] << 21 | ord(p[k - 1]), nodes[p[:k]]))
        while self.SIZE < 3 * len(steps):
            self.SIZE *= 2
        self.keys, self.to = np.full(self.SIZE, -1, np.int64), np.zeros(self.SIZE, np.int32)
        keys = np.array([k for k, _ in steps], np.int64)
        for key, at, (_, to) in zip(keys.tolist(), self.places(keys).tolist(), steps, strict=True):
            while self.keys[at] >= 0:
                at = (at + 1) % self.SIZE
            self.keys[at], self.to[at] = key, to
        self.score, self.piece = np.full(len(nodes), NONE), np.full(len(nodes), -1, np.int32)
        for p, (score, i) in pieces.items():
            self.score[nodes[p]], self.piece[nodes[p]] = score, i
        self.longest = max(map(len, pieces))

    def places(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % self.SIZE

    def steps(self, nodes: np.ndarray, letters: np.ndarray) -> np.ndarray:
        """The nodes one character on; -1 where there is none."""
        keys = nodes.astype(np.int64) << 21 | letters
        at = self.places(keys)
        got = self.keys[at]
        open_ = np.flatnonzero((got != keys) & (got >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) % self.SIZE
            got[open_] = self.keys[at[open_]]
            open_ = open_[(got[open_] != keys[open_]) & (got[open_] >= 0)]
        return np.where(got == keys, self.to[at], -1)

    def best(self, words: list[str]) -> list[bytes]:
        """Id bytes of words, longest word first; each of their characters is a piece."""
        sizes = np.array([len(w) for w in words])
        wide = int(sizes[0])
        letters = np.zeros((len(words), wide), np.int64)
        letters[np.arange(wide) < sizes[:, None]] = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
        best = np.full((wide + 1, len(words)), NONE)
        best[0] = 0
        begin, last = np.zeros((wide + 1, len(words)), np.int32), np.zeros((wide + 1, len(words)), np.int32)
        for at in range(wide):
            rows = np.arange(np.searchsorted(-sizes, -at, "left"))
            nodes = np.zeros(len(rows), np.int32)
            for to in range(at + 1, min(wide, at + self.longest) + 1):
                fits = sizes[rows] >= to
                rows, nodes = rows[fits], nodes[fits]
                nodes = self.steps(nodes, letters[rows, to - 1])
                alive = nodes >= 0
                rows, nodes = rows[alive], nodes[alive]
                if not len(rows):
                    break
                new = best[at, rows] + self.score[nodes]
                better = new > best[to, rows]
                r = rows[better]
                best[to, r], begin[to, r], last[to, r] = new[better], at, self.piece[nodes[better]]
        out, filled = np.zeros((len(words), wide), "<i4"), np.full(len(words), wide)
        at, rows = sizes.copy(), np.arange(len(words))
        while len(rows):
            filled[rows] -= 1
            out[rows, filled[rows]] = last[at[rows], rows]
            at[rows] = begin[at[rows], rows]
            rows = rows[at[rows] > 0]
        return [row[k:].tobytes() for row, k in zip(out, filled, strict=True)]


class Vocabulary:
    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        self.prefix = model.normalizer_spec.add_dummy_prefix
        self.pieces = {p.piece: (p.score, i) for i, p in enumerate(model.pieces) if p.type in (1, 4)}
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == 6}
        self.longest = max(map(len, self.pieces))
        self.unknown = min(s for s, _ in self.pieces.values()) - 10
        self.raw = [bytes([int(p.piece[3:5], 16)]) if p.type == 6 else b"" if p.type in (2, 3) else p.piece.replace(MARK, " ").encode() for p in model.pieces]
        self.starts = {p[:k] for p in self.pieces for k in range(1, len(p) + 1)}
        inner = any(re.search(f"[^{MARK}]{MARK}|\n", p) and len(p) > 1 for p in self.pieces)
        #: Parts that no piece crosses; without such places a text is one part.
        self.crossed = inner
        self.parts = re.compile("(?s).+" if inner else f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n")
        single = "".join(re.escape(p) for p in self.pieces if len(p) == 1)
        #: Parts whose every character is a piece; they can be searched in arrays.
        self.easy = re.compile(f"[{single}]{{1,{WIDE}}}" if single else "(?!)")
        self.tree = Tree(self.pieces)
        self.values = np.array([p.score for p in model.pieces])
        self.known: dict[str, bytes] = {}
        self.held = 0

    def forget(self) -> None:
        self.known, self.held = {}, 0

    def remember(self, part: str, ids: bytes) -> None:
        self.known[part] = ids
        self.held += 200 + 2 * len(part) + len(ids)

    def marked(self, text: str) -> str:
        """The text as it is segmented."""
        return (MARK if self.prefix and text else "") + text.replace(" ", MARK)

    def steps(self, s: str, at: int):
        """(end, score, piece) of the pieces that start here, short ones first; a lone character always has one."""
        single = False
        for end in range(at + 1, min(len(s), at + self.longest) + 1):
            p = s[at:end]
            if p not in self.starts:
                break
            got = self.pieces.get(p)
            if got:
                single |= end == at + 1
                yield end, got[0], got[1]
        if not single:
            yield at + 1, self.unknown, -1

    def ids(self, s: str, at: int, piece: int) -> list[int]:
        return [piece] if piece >= 0 else [self.bytes[b] for b in s[at].encode()]

    def forward(self, s: str, entry: dict[int, float], end: int) -> tuple[dict[int, float], dict[int, tuple[int, int]]]:
        """Best scores of positions from the entries on, and (start, piece) of the last piece there; pieces start before ``end``."""
        best, last = dict(entry), {}
        for at in range(min(entry, default=0), end):
            base = best.get(at)
            if base is None:
                continue
            for to, score, piece in self.steps(s, at):
                if to not in best or base + score > best[to]:
                    best[to], last[to] = base + score, (at, piece)
        return best, last

    def back(self, s: str, last: dict, at: int) -> tuple[int, list[int]]:
        """The entry that a position's best path comes from, and its ids."""
        out = []
        while at in last:
            at, piece = last[at]
            out.append(self.ids(s, at, piece))
        return at, [i for part in reversed(out) for i in part]

    def learn(self, parts) -> None:
        """Solve parts that no piece crosses, and remember their id bytes."""
        if self.held > REMEMBERED:  # short words come again most often
            kept = {p: ids for p, ids in self.known.items() if len(p) <= 7}
            self.forget()
            if 300 * len(kept) < REMEMBERED // 2:
                for p, ids in kept.items():
                    self.remember(p, ids)
        new = [p for p in parts if p not in self.known]
        easy = sorted((p for p in new if self.easy.fullmatch(p)), key=len, reverse=True)
        for k in range(0, len(easy), 20_000):
            some = easy[k : k + 20_000]
            for p, ids in zip(some, self.tree.best(some), strict=True):
                self.remember(p, ids)
        for p in new:
            if p not in self.known:
                _, last = self.forward(p, {0: 0.0}, len(p))
                self.remember(p, np.array(self.back(p, last, len(p))[1], "<i4").tobytes())

    def score(self, parts: list[str]) -> float:
        """The sum of the best scores of parts."""
        counts = Counter(parts)
        self.learn(counts)
        odd = {p for p in counts if not self.easy.fullmatch(p)}
        ids = b"".join([self.known[p] for p in parts if p not in odd])
        return float(self.values[np.frombuffer(ids, "<i4")].sum()) + sum(counts[p] * self.forward(p, {0: 0.0}, len(p))[0][len(p)] for p in odd)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Whole texts, each as one chunk."""
        each = [self.parts.findall(self.marked(t)) for t in texts]
        self.learn(set().union(*each))
        get = self.known.__getitem__
        return [b"".join(map(get, parts)) for parts in each]

    def decode(self, ids: list[int]) -> str:
        out = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")
        return out[1:] if self.prefix and out[:1] == " " else out

    # --- chunks ---

    def meets(self, s: str, at: int) -> bool:
        """Whether no piece crosses this place: a part of the text begins here."""
        return (s[at] == MARK and s[at - 1] != MARK) or s[at] == "\n" or s[at - 1] == "\n"

    def regions(self, s: str, size: int) -> tuple[int, int]:
        """The first and the last place of a chunk (with what follows it, in s) where paths meet; size + 1 if there is none."""
        places = range(1, min(size, len(s) - 1) + 1)
        first = None if self.crossed else next((i for i in places if self.meets(s, i)), None)
        return (size + 1, size + 1) if first is None else (first, next(i for i in reversed(places) if self.meets(s, i)))

    def matrix(self, s: str, size: int, first: bool) -> np.ndarray:
        """The transfer matrix of the chunk s[:size]."""
        n = self.longest
        a, b = self.regions(s, size)
        out = np.full((n, n), NONE)
        middle, tail = 0.0, {}
        if a <= size:
            middle = self.score(self.parts.findall(s[a:b]))
            tail, _ = self.forward(s, {b: 0.0}, size)
        for i in range(1 if first else min(n, size + 1, a + 1)):
            head, _ = self.forward(s, {i: 0.0}, min(a, size))
            for j in range(n):
                if a > size:
                    out[i, j] = head.get(size + j, NONE) if size + j <= len(s) else NONE
                elif a in head and size + j in tail:
                    out[i, j] = head[a] + middle + tail[size + j]
        return out

    def traced(self, s: str, size: int, alpha: np.ndarray) -> Traced:
        return Traced(self, s, size, alpha)


class Traced:
    """A chunk's best paths from the scores at its start, up to every state at its end. Between the first and the last
    place where paths meet there is one path for all states."""

    def __init__(self, voc: Vocabulary, s: str, size: int, alpha: np.ndarray):
        self.voc, self.s, self.size = voc, s, size
        self.a, self.b = voc.regions(s, size)
        self.meets = self.a <= size
        entry = {i: x for i, x in enumerate(alpha) if x > NONE and i <= len(s)}
        self.head, self.head_last = voc.forward(s, entry, min(self.a, size))
        self.tail, self.tail_last = voc.forward(s, {self.b: 0.0}, size) if self.meets else ({}, {})

    def reached(self, state: int) -> bool:
        at = self.size + state
        return self.a in self.head and at in self.tail if self.meets else at in self.head

    def entry(self, state: int) -> int:
        return self.voc.back(self.s, self.head_last, self.a if self.meets else self.size + state)[0]

    def ids(self, state: int) -> bytes:
        if not self.meets:
            return np.array(self.voc.back(self.s, self.head_last, self.size + state)[1], "<i4").tobytes()
        head = self.voc.back(self.s, self.head_last, self.a)[1]
        tail = self.voc.back(self.s, self.tail_last, self.size + state)[1]
        parts = self.voc.parts.findall(self.s[self.a : self.b])
        self.voc.learn(set(parts))
        return b"".join([np.array(head, "<i4").tobytes(), *(self.voc.known[p] for p in parts), np.array(tail, "<i4").tobytes()])


@functools.cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@contextlib.contextmanager
def borrowed(path: str):
    """The worker's vocabulary for a task; the words that the task has solved go with it."""
    voc = vocabulary(path)
    try:
        yield voc
    finally:
        voc.forget()


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a[..., :, None] + b[None, :, :]).max(axis=-2) if a.ndim == 2 else (a[:, None] + b).max(axis=0)


def rows_of(ids: list[bytes]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(b) // 4 for b in ids])])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(b"".join(ids), "<i4"), pa.int32()))


def encoded_giants(texts: DataFrame, path: str, chunk: int) -> DataFrame:
    """(sha, text) of distinct long texts as (sha, ids, exact)."""
    n = vocabulary(path).longest

    def split(batches):
        with borrowed(path) as voc:
            for shas, bodies in common.text_batches(batches, "sha", "text"):
                for sha, body in zip(shas, bodies, strict=True):
                    s = voc.marked(body)
                    at = range(0, len(s), chunk)
                    for k in range(0, len(at), 64):
                        some = at[k : k + 64]
                        yield pa.RecordBatch.from_pydict(
                            {"sha": [sha] * len(some), "c": pa.array([x // chunk for x in some], pa.int32()), "size": pa.array([min(chunk, len(s) - x) for x in some], pa.int32()), "s": [s[x : x + chunk + n - 1] for x in some]}
                        )

    def measure(batches):
        with borrowed(path) as voc:
            for shas, cs, sizes, ss in common.text_batches(batches, "sha", "c", "size", "s"):
                m = [voc.matrix(s, size, c == 0).tobytes() for s, size, c in zip(ss, sizes, cs, strict=True)]
                yield pa.RecordBatch.from_pydict({"sha": shas, "c": pa.array(cs, pa.int32()), "m": m})

    as_matrix = lambda raw: np.frombuffer(raw, float).reshape(n, n)

    def multiplied(pdf):
        pdf = pdf.sort_values("c")
        total = functools.reduce(product, map(as_matrix, pdf["m"]))
        return pdf.head(1)[["sha", "block"]].assign(m=total.tobytes())

    def starts(pdf, by, out):
        """The scores at the start of each row, in order of ``by``, from those at the first."""
        pdf = pdf.sort_values(by)
        alpha = np.frombuffer(pdf["first"].iloc[0], float) if "first" in pdf else np.where(np.arange(n) == 0, 0.0, NONE)
        found = []
        for m in map(as_matrix, pdf["m"]):
            found.append(alpha.tobytes())
            alpha = product(alpha, m)
        return pdf[["sha", by]].assign(**{out: found})

    def maps(batches):
        with borrowed(path) as voc:
            for shas, cs, sizes, ss, alphas in common.text_batches(batches, "sha", "c", "size", "s", "alpha"):
                to = []
                for s, size, alpha in zip(ss, sizes, alphas, strict=True):
                    paths = voc.traced(s, size, np.frombuffer(alpha, float))
                    to.append(bytes(paths.entry(j) if paths.reached(j) else 255 for j in range(n)))
                yield pa.RecordBatch.from_pydict({"sha": shas, "c": pa.array(cs, pa.int32()), "to": to})

    def states(pdf):
        """From the end of the text back: the state at each chunk's end. A text has at most 2 GB, so few chunks."""
        pdf = pdf.sort_values("c", ascending=False)
        state, found = 0, []
        for to in pdf["to"]:
            found.append(state)
            state = to[state]
        return pdf[["sha", "c"]].assign(state=np.array(found, np.int32))

    def pieces(batches):
        with borrowed(path) as voc:
            for shas, cs, sizes, ss, alphas, ends in common.text_batches(batches, "sha", "c", "size", "s", "alpha", "state"):
                ids = []
                for s, size, alpha, state in zip(ss, sizes, alphas, ends, strict=True):
                    ids.append(voc.traced(s, size, np.frombuffer(alpha, float)).ids(state))
                yield pa.RecordBatch.from_arrays([pa.array(shas, pa.string()), pa.array(cs, pa.int32()), rows_of(ids)], names=["sha", "c", "ids"])

    chunks = common.materialised(texts.mapInArrow(split, "sha string, c int, size int, s string"), "chunks")
    dealt = chunks.repartition(common.even_partitions(chunks))
    measured = common.materialised(dealt.mapInArrow(measure, "sha string, c int, m binary"), "matrices").withColumn("block", F.floor(F.col("c") / BLOCK).cast("int"))
    blocks = measured.groupBy("sha", "block").applyInPandas(multiplied, "sha string, block int, m binary")
    firsts = blocks.groupBy("sha").applyInPandas(lambda pdf: starts(pdf, "block", "first"), "sha string, block int, first binary")
    alphas = measured.join(firsts, ["sha", "block"]).groupBy("sha", "block").applyInPandas(lambda pdf: starts(pdf, "c", "alpha"), "sha string, c int, alpha binary")
    ready = common.materialised(chunks.join(alphas, ["sha", "c"]), "chunk-scores")
    ends = ready.mapInArrow(maps, "sha string, c int, to binary").groupBy("sha").applyInPandas(states, "sha string, c int, state int")
    each = ready.join(ends, ["sha", "c"]).mapInArrow(pieces, "sha string, c int, ids array<int>")
    return each.groupBy("sha").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("c", "ids"))), lambda x: x["ids"])).alias("ids"))


def encoded(docs: DataFrame, model: str = "piece_bpe_32k.model", chunk: int = CHUNK) -> DataFrame:
    """doc_id, ids, n_pieces, and whether decoding them gives back the text."""
    path = common.vocabulary_path(model)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_or_empty().alias("text"))

    def run(batches):
        with borrowed(path) as voc:
            for ids, texts in common.text_batches(batches, "doc_id", "text"):
                for a in range(0, len(ids), 300):
                    some = texts[a : a + 300]
                    got = voc.encode(some)
                    exact = [voc.decode(np.frombuffer(g, "<i4").tolist()) == t for g, t in zip(got, some, strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(ids[a : a + 300], pa.int64()), rows_of(got), pa.array(exact, pa.bool_())], names=["doc_id", "ids", "exact"])

    def checked(batches):
        with borrowed(path) as voc:
            for batch in batches:
                exact = [voc.decode(g) == t for g, t in zip(*(batch.column(i).to_pylist() for i in (1, 2)), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(exact, pa.bool_())], names=["doc_id", "ids", "exact"])

    shape = "doc_id long, ids array<int>, exact boolean"
    short = own.where(F.length("text") <= chunk).mapInArrow(run, shape)
    long_ = own.where(F.length("text") > chunk).withColumn("sha", F.sha2(F.encode("text", "utf-8"), 256))
    found = encoded_giants(long_.select("sha", "text").dropDuplicates(["sha"]), path, chunk)
    giants = long_.join(found, "sha").select("doc_id", "ids", "text").mapInArrow(checked, shape)
    return short.unionByName(giants).select("doc_id", F.size("ids").alias("n_pieces"), "ids", "exact")


def decoded(rows: DataFrame, model: str = "piece_bpe_32k.model") -> DataFrame:
    """doc_id and the text of its ids (a null array is the empty text)."""
    path = common.vocabulary_path(model)

    def run(batches):
        with borrowed(path) as voc:
            for ids, each in common.text_batches(batches, "doc_id", "ids"):
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([voc.decode(x or []) for x in each], pa.string())], names=["doc_id", "text"])

    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(common.documents(spark, sf_dir))
