"""Exact removal of repeated byte strings with a run-length index (a run-compressed Burrows-Wheeler transform).

Every byte that is covered by a string of ``LENGTH`` bytes that also starts earlier (in an earlier document, or earlier in
the same one) is removed; strings are judged on the input, and never cross documents.

One index over a corpus fits no machine, so windows of ``LENGTH`` bytes are first dealt to buckets by content: the least
hash of the ``SEED``-byte strings in a window is its anchor, and equal windows have equal anchors. Neighbouring windows
with the same anchor form a fragment; fragments are what travels.

1. Fragments that equal an earlier one of the same batch of documents, or of the corpus, are repeats as a whole: each
   different fragment goes on once (two 64-bit hashes tell them apart), whatever the count of its copies.
2. Anchors with one fragment are done (unless it holds its anchor again, however short it is). The others' fragments, with their bytes, form texts of bounded size, in order of
   anchor and document. Of each text the index keeps only the runs of its transform: for the first suffix of each run
   where it starts (a sampled run end), its predecessor in suffix order, and how long the two agree. From these samples
   the matching statistics of all positions stream out: a position's longest match with its neighbour in suffix order is
   its run sample's, less the distance from it. Windows whose match is at least ``LENGTH`` long belong together with
   their neighbour's; of windows that belong together all but the earliest are marked.
3. An anchor with more than ``MOST`` fragments (a very common line) is taken apart: its windows get longer anchors, the
   bytes that all windows with the anchor at a like place share, and go through both steps again. Where even those are too
   common, windows are dealt by the hash of their whole content, which needs no text in one place.

Defined cases: a null text is the empty text; documents of fewer than ``LENGTH`` bytes keep all; a null ``doc_id`` comes
before all others; rows of equal ``doc_id`` are ordered by their texts, and rows equal in both are one document (each of
them is returned); an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.llm import common

LENGTH, SEED = 100, 32
#: Bytes of texts that are hashed at once, and of fragments that one index holds (unless one anchor has more).
BLOCK, TEXT = 1 << 20, 1 << 19
#: Fragments of an anchor that go into one index.
MOST = 500
#: Kinds of fragments that a task remembers, of the last blocks and of those that came again: 32 bytes each.
FAMILIAR = 200_000
U64 = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


BYTES = mixed(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
FACTORS = mixed(np.arange(500, 512, dtype=U64) * U64(0xD1342543DE82EF95)) | U64(1)


def hashed(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the strings of SEED and of 64 bytes at every position, by doubling."""
    h, width, seed = BYTES[data], 1, None
    for factor in FACTORS[:6]:
        if width == SEED:
            seed = h
        h = h[:-width] * factor + h[width:]
        h ^= h >> U64(29)
        width *= 2
    return seed, h


def least_over(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours."""
    step, size = x, 1
    while size * 2 <= width:
        step = np.minimum(step[:-size], step[size:])
        size *= 2
    rest = width - size
    return np.minimum(step[: len(step) - rest], step[rest:]) if rest else step


def loops(seed: np.ndarray, anchor: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which fragments, of the windows from begin to end, hold their anchor at two places: those alone can hold a window twice.
    A place is an anchor's if some window over it has no less hash; of a text that repeats itself, such places follow each other."""
    width = LENGTH - SEED + 1
    most = ~least_over(~np.concatenate([np.zeros(width - 1, np.uint64), anchor, np.zeros(width - 1, np.uint64)]), width)
    at = np.flatnonzero(seed == most)
    twice = np.concatenate([[0], np.cumsum(seed[at[1:]] == seed[at[:-1]])])
    first, last = np.searchsorted(at, begin), np.searchsorted(at, end + width - 1) - 1
    return twice[last] > twice[first]


def fragments(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of the texts data[offsets[i]:offsets[i + 1]]: (document, start in it, windows, anchor, content hash, whether the anchor
    comes again in it)."""
    seed, h64 = hashed(data)
    anchor = least_over(seed, LENGTH - SEED + 1)
    n = len(anchor)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:n]
    fits = np.arange(n) + LENGTH <= offsets[doc + 1]
    new = np.ones(n, bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
    begin = np.flatnonzero(new & fits)
    breaks = np.flatnonzero(new)
    end = np.append(breaks[1:], n)[np.searchsorted(breaks, begin)]
    end = np.minimum(end, offsets[doc[begin] + 1] - LENGTH + 1)
    windows = end - begin
    size = windows + LENGTH - 1
    content = mixed(h64[begin] * FACTORS[7] + h64[begin + (size - 64) // 2] * FACTORS[8] + (h64[begin + size - 64] ^ FACTORS[10]) * FACTORS[9] + size.astype(U64))
    for i in np.flatnonzero(size > 192):  # three strings of 64 bytes do not cover these
        content[i] = int.from_bytes(hashlib.blake2b(data[begin[i] : begin[i] + size[i]].tobytes(), digest_size=8).digest(), "big")
    return doc[begin], begin - offsets[doc[begin]], windows, anchor[begin], content, loops(seed, anchor, begin, end)


def blocks(batches, *columns, most: int = BLOCK):
    """Rows of arrow batches in groups of bounded text: lists of the columns, the last one as bytes."""
    rows, size = [], 0
    for values in common.text_batches(batches, *columns):
        for row in zip(*values, strict=True):
            raw = row[-1].encode() if isinstance(row[-1], str) else row[-1]
            rows.append((*row[:-1], raw))
            size += len(raw)
            if size > most or len(rows) >= 10_000:
                yield rows
                rows, size = [], 0
    if rows:
        yield rows


def first_of_kind(anchor, content, order, start) -> np.ndarray:
    """Which fragments are the first of those with equal anchor and content."""
    by = np.lexsort((start, order, content, anchor))
    same = np.zeros(len(by), bool)
    same[1:] = (anchor[by][1:] == anchor[by][:-1]) & (content[by][1:] == content[by][:-1])
    own = np.empty(len(by), bool)
    own[by] = ~same
    return own


class Familiar:
    """Kinds of fragments that a task has met: those of its last blocks, and those that came again in a later block, up to
    ``FAMILIAR`` of each. It only saves rows: a very common line is sent once a task, not once a block."""

    def __init__(self):
        self.recent = self.common = np.zeros((4, 0), np.int64)

    def known(self, anchor: np.ndarray, content: np.ndarray, order: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Which fragments, of different kinds, are equal to an earlier one (by order and start) that was met before."""
        own = np.stack([anchor.view(np.int64), content.view(np.int64), order, start.astype(np.int64)])
        again = np.zeros(len(start), bool)
        met = np.zeros(len(start), bool)
        for kinds in (self.common, self.recent):
            if kinds.shape[1]:
                at = np.minimum(np.searchsorted(kinds[1], own[1]), kinds.shape[1] - 1)
                same = (kinds[1][at] == own[1]) & (kinds[0][at] == own[0])
                met |= same
                again |= same & ((kinds[2][at] < own[2]) | ((kinds[2][at] == own[2]) & (kinds[3][at] < own[3])))
        self.common = self.merged(self.common, own[:, met])
        self.recent = self.merged(self.recent, own[:, ~met])
        return again

    @staticmethod
    def merged(kinds: np.ndarray, new: np.ndarray) -> np.ndarray:
        """Both, the earliest of each content; the new ones alone where they are too many together."""
        both = np.concatenate([kinds, new], axis=1) if kinds.shape[1] + new.shape[1] <= FAMILIAR else new[:, :FAMILIAR]
        both = both[:, np.lexsort((both[3], both[2], both[1]))]
        return both[:, np.append(True, both[1][1:] != both[1][:-1])] if both.shape[1] else both


FRAGMENT = "own boolean, anchor long, content long, ord long, start int, windows int, loops boolean"
FRAGMENT_COLUMNS = ["own", "anchor", "content", "ord", "start", "windows", "loops"]


def fragment_rows(docs: DataFrame) -> DataFrame:
    """docs: (ord, text). Every fragment; ``own`` is false where an earlier one that the same task has met is equal."""

    def run(batches):
        familiar = Familiar()
        for rows in blocks(batches, "ord", "text"):
            order = np.array([r[0] for r in rows], np.int64)
            offsets = np.concatenate([[0], np.cumsum([len(r[1]) for r in rows])])
            data = np.frombuffer(b"".join(r[1] for r in rows), np.uint8)
            if len(data) < LENGTH:
                continue
            doc, start, windows, anchor, content, again = fragments(data, offsets)
            o = order[doc]
            own = first_of_kind(anchor, content, o, start)
            first = np.flatnonzero(own)
            own[first[familiar.known(anchor[first], content[first], o[first], start[first])]] = False
            yield pa.RecordBatch.from_arrays(
                [pa.array(own), pa.array(anchor.view(np.int64)), pa.array(content.view(np.int64)), pa.array(o), pa.array(start.astype(np.int32)), pa.array(windows.astype(np.int32)), pa.array(again)],
                names=FRAGMENT_COLUMNS,
            )

    return docs.select("ord", "text").mapInArrow(run, FRAGMENT)


def sifted(rows: DataFrame) -> DataFrame:
    """Fragments that are repeats as a whole (open is false), and the first of each kind where its anchor has more kinds
    or comes again in it."""
    # copies within a task need no partner any more: they go anywhere, so that a common anchor has few rows of a task
    to = F.when(F.col("own"), F.col("anchor")).otherwise(F.xxhash64("ord", "start"))
    dealt = rows.repartition(common.even_partitions(rows), to).sortWithinPartitions("anchor", "content", "ord", "start")

    def run(batches):
        last = None  # (anchor, content) of the row before, and the first row of its anchor while that has one kind
        waiting = None
        for batch in batches:
            own, anchor, content, order, start, windows, loops_ = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(7))
            marks = [(order[~own], start[~own], windows[~own], anchor[~own], np.zeros((~own).sum(), bool))]
            keep = np.flatnonzero(own)
            if len(keep):
                a, c = anchor[keep], content[keep]
                before_a, before_c = np.roll(a, 1), np.roll(c, 1)
                same_a, same_c = a == before_a, c == before_c
                same_a[0] = last is not None and a[0] == last[0]
                same_c[0] = last is not None and c[0] == last[1]
                again = same_a & same_c  # not the first of its kind
                kind = ~again
                other = kind & same_a  # a further kind of its anchor
                marks.append((order[keep][again], start[keep][again], windows[keep][again], a[again], np.zeros(again.sum(), bool)))
                group = np.cumsum(~same_a)  # 0: goes on from the batch before
                several = np.zeros(group[-1] + 1, bool)
                several[group[other]] = True
                if waiting is not None:
                    if several[0]:
                        marks.append(tuple(np.array([x]) for x in waiting) + (np.array([True]),))
                        waiting = None
                    elif group[-1] > 0:
                        waiting = None
                    first_open = False
                else:
                    first_open = same_a[0]  # the group that goes on has several kinds already, or its first row was passed on
                if first_open:
                    several[0] = True
                long_ = loops_[keep]  # its anchor comes again in it, and so may its windows
                opened = kind & (several[group] | long_)
                marks.append((order[keep][opened], start[keep][opened], windows[keep][opened], a[opened], np.ones(opened.sum(), bool)))
                end = group == group[-1]
                if not several[group[-1]] and (group[-1] > 0 or waiting is None):
                    at = np.flatnonzero(end & kind)
                    if len(at) and not long_[at[0]]:
                        i = keep[at[0]]
                        waiting = (order[i], start[i], windows[i], anchor[i])
                last = (a[-1], c[-1])
            out = [np.concatenate(x) for x in zip(*marks, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(out[4]), pa.array(out[3], pa.int64()), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int32())], names=["open", "anchor", "ord", "start", "windows"])

    return dealt.mapInArrow(run, "open boolean, anchor long, ord long, start int, windows int")


# --- the index ---


class RunLengthIndex:
    """The runs of a text's Burrows-Wheeler transform, with samples at run ends. The text is a list of strings, each with an
    end mark of its own; end marks sort below bytes, in the strings' order."""

    def __init__(self, strings: list[bytes]):
        sizes = np.array([len(s) for s in strings])
        self.text = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8)
        self.end = np.repeat(np.cumsum(sizes + 1) - 1, sizes + 1)
        order, packed = self.sorted_suffixes(len(strings))
        n = len(order)
        begins = np.zeros(n, bool)
        begins[np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])] = True
        letter = self.text[order - 1]
        whole = begins[order] | (order == self.end[order])
        head = np.ones(n, bool)
        head[1:] = (letter[1:] != letter[:-1]) | whole[1:] | whole[:-1]
        at = np.flatnonzero(head)
        self.heads, self.runs = order[at], len(at)
        self.before = np.where(at > 0, order[at - 1], -1)
        self.agree = self.common_prefix(self.heads, self.before, packed)
        by = np.argsort(self.heads)
        self.heads, self.before, self.agree = self.heads[by], self.before[by], self.agree[by]

    def sorted_suffixes(self, strings: int) -> tuple[np.ndarray, np.ndarray]:
        """All suffixes in order, by prefix doubling from seven bytes; and the seven bytes at each position."""
        text, end, n = self.text, self.end, len(self.text)
        place = np.arange(n)
        packed = np.zeros(n, np.int64)
        code = np.append(text.astype(np.int64) + 1, np.zeros(7, np.int64))
        code[np.flatnonzero(end == place)] = 0
        alive = np.ones(n, bool)
        for j in range(7):
            now = code[j : j + n]
            alive &= (place + j < end) | (now == 0)
            packed = (packed << 9) | np.where(alive & (place + j < end), now, 0)
        key = packed.copy()
        marks = np.flatnonzero(end == place)
        key[marks] = np.arange(len(marks)) - strings  # below all others
        order = np.argsort(key, kind="stable")
        rank = np.empty(n, np.int64)
        new = np.ones(n, bool)
        new[1:] = key[order][1:] != key[order][:-1]
        head = np.flatnonzero(new)
        rank[order] = head[np.cumsum(new) - 1]
        size = np.diff(np.append(head, n))
        active = order[np.repeat(size, size) > 1]
        step = 7
        while len(active):
            own, then = rank[active], rank[np.minimum(active + step, end[active])]
            by = np.lexsort((then, own))
            active, own, then = active[by], own[by], then[by]
            group = np.ones(len(active), bool)
            group[1:] = own[1:] != own[:-1]
            new = group.copy()
            new[1:] |= then[1:] != then[:-1]
            first = np.flatnonzero(group)[np.cumsum(group) - 1]
            head = np.flatnonzero(new)
            number = np.cumsum(new) - 1
            rank[active] = own + head[number] - first
            size = np.diff(np.append(head, len(active)))
            active = active[size[number] > 1]
            step *= 2
        order = np.empty(n, np.int64)
        order[rank] = place
        return order, packed

    def common_prefix(self, a: np.ndarray, b: np.ndarray, packed: np.ndarray) -> np.ndarray:
        """How many bytes the suffixes at a and b agree in; seven at a time."""
        room = np.where(b >= 0, np.minimum(self.end[a] - a, self.end[b] - b), 0)
        out, open_ = np.zeros(len(a), np.int64), np.flatnonzero(room > 0)
        while len(open_):
            x = packed[a[open_] + out[open_]] ^ packed[b[open_] + out[open_]]
            same = x == 0
            high = np.frexp(x.astype(float))[1]  # one over the highest differing bit; 63 bits of nine each
            out[open_] += np.where(same, 7, (63 - high) // 9)
            open_ = open_[same & (out[open_] < room[open_])]
        return np.minimum(out, room)

    def matching_statistics(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each text position: its predecessor in suffix order, and how many bytes they agree in. Streamed from the
        samples: both follow from the last sampled position at or before it."""
        place = np.arange(len(self.text))
        gap = np.diff(np.append(self.heads, len(self.text)))
        sample = np.repeat(np.arange(self.runs), gap)
        past = place - self.heads[sample]
        agree = np.maximum(self.agree[sample] - past, 0)
        return np.where(agree > 0, self.before[sample] + past, -1), agree

    def later_windows(self, length: int = LENGTH) -> np.ndarray:
        """Positions of windows of ``length`` bytes that also occur before, in the text's order."""
        before, agree = self.matching_statistics()
        n = len(self.text)
        linked = agree >= length
        root = np.where(linked, before, np.arange(n))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
        first = np.arange(n)
        some = np.flatnonzero(linked)
        np.minimum.at(first, root[some], some)
        return np.flatnonzero((linked | (first < np.arange(n))) & (first[root] < np.arange(n)))


def runs_of(positions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted positions as (first, count) of their runs."""
    if not len(positions):
        return positions, positions
    begin = np.flatnonzero(np.append(True, np.diff(positions) > 1))
    return positions[begin], np.diff(np.append(begin, len(positions)))


MARK = "ord long, start int, windows int"


def marks_of(order, start, windows) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(order, pa.int64()), pa.array(start, pa.int32()), pa.array(windows, pa.int32())], names=["ord", "start", "windows"])


def indexed(pieces: DataFrame) -> DataFrame:
    """pieces: (anchor, ord, start, body), anchors of at most MOST rows. Windows that occur earlier under the same anchor."""

    def marked(rows) -> pa.RecordBatch:
        index = RunLengthIndex([r[3] for r in rows])
        found = index.later_windows()
        begins = np.concatenate([[0], np.cumsum([len(r[3]) + 1 for r in rows])])
        first, count = runs_of(found)
        of = np.searchsorted(begins, first, "right") - 1
        order, start = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
        return marks_of(order[of], start[of] + first - begins[of], count)

    def run(batches):
        rows, size = [], 0
        for values in common.text_batches(batches, "anchor", "ord", "start", "body"):
            for row in zip(*values, strict=True):
                if size > TEXT and row[0] != rows[-1][0]:
                    yield marked(rows)
                    rows, size = [], 0
                rows.append(row)
                size += len(row[3])
        if rows:
            yield marked(rows)

    dealt = pieces.repartition(common.even_partitions(pieces), "anchor").sortWithinPartitions("anchor", "ord", "start")
    return dealt.select("anchor", "ord", "start", "body").mapInArrow(run, MARK)


def longer(pieces: DataFrame) -> DataFrame:
    """Fragments of common anchors with longer ones. A window has its anchor 0 to LENGTH - SEED bytes after its start; those
    with it in the first half of these places share LENGTH - 34 bytes from the anchor on, the others as many bytes or more
    that end with the anchor."""
    half = (LENGTH - SEED + 1) // 2

    def run(batches):
        for rows in blocks(batches, "anchor", "ord", "start", "body"):
            out = []
            for anchor, order, start, body in rows:
                data = np.frombuffer(body, np.uint8)
                seed, h64 = hashed(data)
                n = len(data) - LENGTH + 1
                at = np.flatnonzero(seed.view(np.int64) == anchor)
                place = at[np.searchsorted(at, np.arange(n))]
                late = place - np.arange(n) > half
                new = np.ones(n, bool)
                new[1:] = (place[1:] != place[:-1]) | (late[1:] != late[:-1])
                begin = np.flatnonzero(new)
                count = np.diff(np.append(begin, n))
                size = count + LENGTH - 1
                p = place[begin]
                first = np.where(late[begin], p - half - 1, p)  # shared: 66 bytes from the anchor on, or 67 up to its end
                second = np.where(late[begin], p + SEED - 64, p + LENGTH - half - 64)
                key = mixed(h64[first] * FACTORS[7] + h64[second] * FACTORS[8] + late[begin].astype(U64))
                content = mixed(h64[begin] * FACTORS[7] + h64[begin + (size - 64) // 2] * FACTORS[8] + (h64[begin + size - 64] ^ FACTORS[10]) * FACTORS[9] + size.astype(U64))
                out.append((key.view(np.int64), content.view(np.int64), np.full(len(begin), order), (start + begin).astype(np.int32), count.astype(np.int32)))
            key, content, order, start, count = (np.concatenate(x) for x in zip(*out, strict=True))
            own = first_of_kind(key, content, order, start)
            # repeats that follow each other (periodic text) are one row
            new = np.ones(len(own), bool)
            new[1:] = own[1:] | own[:-1] | (order[1:] != order[:-1]) | (start[:-1] + count[:-1] != start[1:])
            begin = np.flatnonzero(new)
            own, key, content, order, start, count = own[begin], key[begin], content[begin], order[begin], start[begin], np.add.reduceat(count, begin).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(key), pa.array(content), pa.array(order), pa.array(start), pa.array(count), pa.array(np.zeros(len(own), bool))], names=FRAGMENT_COLUMNS)

    return pieces.select("anchor", "ord", "start", "body").mapInArrow(run, FRAGMENT)


def by_window(pieces: DataFrame) -> DataFrame:
    """The same for anchors of any size: windows meet by the hash of their whole content, each distinct one once."""

    def run(batches):
        for rows in blocks(batches, "ord", "start", "body", most=TEXT // 4):
            for order, start, body in rows:
                data = np.frombuffer(body, np.uint8)
                _, h64 = hashed(data)
                n = len(data) - LENGTH + 1
                a, b = h64[:n], h64[LENGTH - 64 : LENGTH - 64 + n]
                one, two = mixed(a * FACTORS[7] + b), mixed(b * FACTORS[8] + (a ^ FACTORS[9]))
                yield pa.RecordBatch.from_arrays([pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array(np.full(n, order), pa.int64()), pa.array((start + np.arange(n)).astype(np.int32))], names=["one", "two", "ord", "start"])

    seen = pieces.select("ord", "start", "body").mapInArrow(run, "one long, two long, ord long, start int")
    first = seen.groupBy("one", "two").agg(F.min(F.struct("ord", "start")).alias("first"), F.count("*").alias("n")).where("n > 1")
    later = seen.join(first.select("one", "two", "first"), ["one", "two"]).where(F.struct("ord", "start") > F.col("first"))
    return later.select("ord", "start", F.lit(1).alias("windows"))


# --- the whole ---


def ordered(docs: DataFrame) -> tuple[DataFrame, bool]:
    """(ord, doc_id, text), one row a document; ord follows the order of doc_id, then of the text. And whether it is doc_id."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_or_empty().alias("text"))
    ids = own.select("doc_id")
    if ids.where("doc_id is null").isEmpty() and ids.groupBy("doc_id").count().where("count > 1").isEmpty():
        return own.withColumn("ord", F.col("doc_id")), True
    one = own.dropDuplicates(["doc_id", "text"])
    by = [F.col("doc_id").asc_nulls_first(), F.col("text")]
    dealt = one.repartitionByRange(common.even_partitions(one), *by).sortWithinPartitions(*by)
    return common.materialised(dealt.withColumn("ord", F.monotonically_increasing_id()), "ordered"), False


def bucketed(docs: DataFrame) -> DataFrame:
    """Documents as a table in the shared folder, bucketed by ord: joins by it move the other side only."""
    name = f"texts_{uuid.uuid4().hex}"
    n = common.even_partitions(docs)
    docs.select("ord", "text").write.bucketBy(n, "ord").option("path", common.fresh_folder(docs.sparkSession, name)).option("compression", "zstd").saveAsTable(name)
    table = docs.sparkSession.table(name)
    docs.sparkSession.sql(f"drop table {name}")  # the name only: the files stay, and the plan has them
    return table


def sliced(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """The bytes of fragments: (anchor, many, ord, start, body)."""
    each = wanted.groupBy("ord").agg(F.collect_list(F.struct("anchor", "many", "start", "windows")).alias("parts"))

    def run(batches):
        for rows in blocks(batches, "ord", "parts", "text"):
            out = [(p["anchor"], p["many"], order, p["start"], raw[p["start"] : p["start"] + p["windows"] + LENGTH - 1]) for order, parts, raw in rows for p in parts]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.bool_(), pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["anchor", "many", "ord", "start", "body"])

    return texts.join(each, "ord").select("ord", "parts", "text").mapInArrow(run, "anchor long, many boolean, ord long, start int, body binary")


def opened(found: DataFrame) -> DataFrame:
    """Open fragments, and whether their anchor has too many of them (many)."""
    rows = found.where("open").drop("open")
    crowded = rows.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > MOST).select("anchor", F.lit(True).alias("many"))
    return rows.join(crowded, "anchor", "left").withColumn("many", F.coalesce("many", F.lit(False)))


def repeats(texts: DataFrame, rows: DataFrame) -> DataFrame:
    """(ord, start, windows): runs of windows that occur earlier."""
    found = common.materialised(sifted(rows), "fragments")
    pieces = common.materialised(sliced(texts, opened(found)), "pieces")
    crowded = pieces.where("many")
    further = common.materialised(sifted(longer(crowded)), "fragments")
    # their bytes lie in the pieces that they are parts of
    part = opened(further).withColumnRenamed("start", "at").withColumnRenamed("anchor", "key").withColumnRenamed("many", "still")
    inside = crowded.join(part, "ord").where((F.col("at") >= F.col("start")) & (F.col("at") + F.col("windows") + LENGTH - 1 <= F.col("start") + F.octet_length("body")))
    cut = F.substring("body", F.col("at") - F.col("start") + 1, F.col("windows") + LENGTH - 1)
    parts = inside.select(F.col("key").alias("anchor"), F.col("still").alias("many"), "ord", F.col("at").alias("start"), cut.alias("body"))
    parts = common.materialised(parts, "pieces")
    whole = found.where("not open").select("ord", "start", "windows").unionByName(further.where("not open").select("ord", "start", "windows"))
    few = indexed(pieces.where("not many")).unionByName(indexed(parts.where("not many")))
    return whole.unionByName(few).unionByName(by_window(parts.where("many")))


RESULT = "ord long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string"


def removed(docs: DataFrame, keep_text: bool = True) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and the remaining bytes as text (``kept``; broken
    characters at the edges of removed runs are replaced)."""
    own, regular = ordered(docs)
    texts = bucketed(own)
    marks = repeats(texts, fragment_rows(own))
    each = marks.groupBy("ord").agg(F.collect_list(F.struct("start", "windows")).alias("marks"))

    def run(batches):
        for rows in blocks(batches, "ord", "marks", "text"):
            out = []
            for order, marked, raw in rows:
                gone = np.zeros(len(raw) + 1, np.int32)
                if marked:
                    start = np.array([m["start"] for m in marked])
                    np.add.at(gone, start, 1)
                    np.add.at(gone, start + np.array([m["windows"] for m in marked]) + LENGTH - 1, -1)
                out_of = np.cumsum(gone[:-1]) > 0
                left = np.frombuffer(raw, np.uint8)[~out_of].tobytes() if marked else raw
                spans = int((out_of[1:] & ~out_of[:-1]).sum() + (out_of[:1].sum()))
                out.append((order, len(raw), int(out_of.sum()), spans, hashlib.sha256(left).hexdigest(), left.decode("utf-8", "replace") if keep_text else None))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(),) * 4 + (pa.string(),) * 2, strict=True)], names=["ord", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    done = texts.join(each, "ord", "left").select("ord", "marks", "text").mapInArrow(run, RESULT)
    if regular:
        return done.withColumnRenamed("ord", "doc_id")
    named = own.join(done, "ord").drop("ord")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_or_empty().alias("text"))
    same = rows["doc_id"].eqNullSafe(named["doc_id"]) & (rows["text"] == named["text"])
    return rows.join(named, same).select(rows["doc_id"], "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")


def op1_run_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed(common.documents(spark, sf_dir), keep_text=False).drop("kept")
