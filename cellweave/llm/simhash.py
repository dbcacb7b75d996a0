"""SimHash near-duplicates: fingerprints of word shingles, linked by a generalised pigeonhole search.

The bits of the distinct fingerprints are dealt into parts: correlated bits (measured on a bounded sample) go into the same
part, so that the parts' values spread. Part i has a threshold t_i; with the sum of (t_i + 1) over all parts equal to
limit + 1, two fingerprints within ``limit`` bits differ in at most t_i bits in some part i. How many parts, and which
thresholds, comes from dynamic programming on candidate counts: the share of the sample's pairs within t bits in a part,
times the pairs there are, plus the cost of the probe rows. Each fingerprint is put in its bucket of every part, and
probes the buckets whose value differs from its own in 1 to t_i bits; candidates are verified on all 64 bits.

Within a bucket a breadth-first search links what is near, so that each bucket gives at most one link a row, not all
pairs; buckets over ``MOST`` rows are split into blocks that meet in pairs, which loses none. Copies share a fingerprint
and are one row of the search. Components come from links between fingerprints: joined within tasks first, then, where many
are left, by rounds of the smaller-neighbour rule.

Defined cases: a null text is the empty text; texts without words have fingerprint zero and are linked like others; a
null ``doc_id`` is kept, with its component's smallest id (null if it has none); repeated rows are kept; an empty table
gives no rows; other columns are not read (``representatives`` keeps them).
"""

from __future__ import annotations

import itertools
import math
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.llm import common

WORDS = re.compile("[^\x20\x09-\x0d]+")
CAPITALS = {c: c + 32 for c in range(65, 91)}
#: Fingerprints of the sample that bit groups and thresholds are chosen by.
SAMPLE = 2000
#: Rows of a bucket that are searched at once; larger buckets are split.
MOST = 20_000
#: Links of a partition of ``components``: that many settle in one task.
LINKS = 50_000
#: The cost of a probe row against that of a candidate.
PROBE_COST = 200.0
U64 = np.uint64


def shingles(text: str, width: int) -> list[bytes]:
    """Word shingles as UTF-8, repeats included; fewer words make one shingle, no words none."""
    words = WORDS.findall(text.translate(CAPITALS))
    if len(words) <= width:
        return [" ".join(words).encode()] if words else []
    return [s.encode() for s in map(" ".join, zip(*(words[i:] for i in range(width)), strict=False))]


def hashes(text: str, width: int) -> np.ndarray:
    each = shingles(text, width)
    return np.fromiter(map(xxhash.xxh64_intdigest, each, itertools.repeat(42)), U64, len(each))


def fingerprint(h: np.ndarray) -> int:
    """A bit is set if over half the hashes have it."""
    if not len(h):
        return 0
    ones = np.zeros(64, np.int64)
    for a in range(0, len(h), 1 << 16):
        some = h[a : a + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(some, axis=1).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


def signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed 64-bit integer."""

    def run(batches):
        for ids, texts in common.text_batches(batches, "doc_id", "text"):
            fp = [signed(fingerprint(hashes(t or "", width))) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(fp, pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


# --- the search plan ---


def bits_of(fps: np.ndarray) -> np.ndarray:
    """Rows of 64 zeros and ones; bit 0 is the lowest."""
    return np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def grouped_bits(bits: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in parts of near equal size, correlated ones together: each part starts with the free bit that has most
    correlation left, and takes its most correlated neighbours."""
    n = bits.shape[1]
    if len(bits) > 1:
        centred = bits - bits.mean(axis=0)
        spread = np.maximum(centred.std(axis=0), 1e-9)
        tied = np.abs((centred / spread).T @ (centred / spread)) / len(bits)
    else:
        tied = np.zeros((n, n))
    np.fill_diagonal(tied, 0)
    free, out = set(range(n)), []
    for k in range(parts):
        size = len(free) // (parts - k)
        seed = max(sorted(free), key=lambda b: tied[b, sorted(free)].sum())
        part = [seed]
        free.remove(seed)
        while len(part) < size:
            best = max(sorted(free), key=lambda b: tied[b, part].sum())
            part.append(best)
            free.remove(best)
        out.append(sorted(part))
    return out


def probes(bits: int, threshold: int) -> int:
    return sum(math.comb(bits, k) for k in range(1, threshold + 1))


def plan(sample: np.ndarray, rows: int, limit: int) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each part. Thresholds of -1 leave a part unused."""
    bits = bits_of(sample) if len(sample) else np.zeros((0, 64), np.uint8)
    best, best_cost = None, math.inf
    for m in range(2, limit + 2):
        groups = grouped_bits(bits, m)
        cost = []
        for g in groups:
            some = bits[:1000, g].astype(np.int32)
            near = some @ (1 - some).T
            near = near + near.T
            pairs = max(1, len(some) * (len(some) - 1))
            line = [0.0]
            for t in range(limit + 1):
                # pairs within t bits: those seen among different texts, at least as many as random bits would give
                share = max(((near <= t).sum() - len(some)) / pairs, sum(math.comb(len(g), k) for k in range(t + 1)) / 2.0 ** len(g))
                n_probes = probes(len(g), t)
                line.append(rows * (1 + n_probes) * PROBE_COST + share * rows * rows / 2 if n_probes < 5000 else math.inf)
            cost.append(line)
        # least cost of the first parts with a given sum of (threshold + 1)
        table = {0: (0.0, ())}
        for line in cost:
            step: dict[int, tuple[float, tuple]] = {}
            for used, (c, ts) in table.items():
                for t in range(-1, limit + 1 - used):
                    new = c + line[t + 1], (*ts, t)
                    if used + t + 1 not in step or new[0] < step[used + t + 1][0]:
                        step[used + t + 1] = new
            table = step
        c, ts = table.get(limit + 1, (math.inf, ()))
        if c < best_cost:
            best, best_cost = [(g, t) for g, t in zip(groups, ts, strict=True) if t >= 0], c
    return best


def masks(bits: list[int], threshold: int) -> list[int]:
    return [signed(sum(1 << b for b in some)) for k in range(1, threshold + 1) for some in itertools.combinations(bits, k)]


# --- links within buckets ---


def distance(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def linked(fp: np.ndarray, ids: np.ndarray, own: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """Links of a bucket that join what is near in it: rows of the bucket (own), and probes, which are near own rows."""
    out, open_ = [], np.arange(len(fp))
    while len(open_):
        front = [open_[0]]
        open_ = open_[1:]
        while front and len(open_):
            at = front.pop()
            near = distance(fp[open_], fp[at]) <= limit
            if not own[at]:
                near &= own[open_]
            if near.any():
                got = open_[near]
                out += [(ids[at], ids[g]) for g in got]
                front += list(got)
                open_ = open_[~near]
    return out


def probe_of(part: int, key: Column):
    return lambda flip: F.struct(F.lit(part).alias("part"), key.bitwiseXOR(flip).alias("key"), F.lit(False).alias("own"))


def probed_by(rows: DataFrame, parts: list[tuple[list[int], int]]) -> DataFrame:
    """rows: distinct (id, fp, ...). Each row in its bucket of every part (own) and in those that it probes: id, fp, part, key,
    own, and the further columns."""
    more = [c for c in rows.columns if c not in ("id", "fp")]
    sent = []
    for k, (bits, threshold) in enumerate(parts):
        mask = signed(sum(1 << b for b in bits))
        key = F.col("fp").bitwiseAND(F.lit(mask))
        own = F.struct(F.lit(k).alias("part"), key.alias("key"), F.lit(True).alias("own"))
        sent.append(F.array(own))
        other = masks(bits, threshold)
        if other:
            flips = F.array(*[F.lit(x).cast("long") for x in other])
            sent.append(F.transform(flips, probe_of(k, key)))
    return rows.select("id", "fp", F.explode(F.concat(*sent)).alias("at"), *more).select("id", "fp", "at.part", "at.key", "at.own", *more)


def in_blocks(seen: DataFrame, more: list[str]) -> DataFrame:
    """Rows with ``blocks``, the number of blocks of their bucket, dealt to every pair of blocks that theirs is in, sorted."""
    mine = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    pair = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.least(x, mine) * F.col("blocks") + F.greatest(x, mine))
    dealt = seen.withColumn("block", F.explode(pair)).select("id", "fp", "own", "part", "key", "block", *more)
    return dealt.repartition(common.even_partitions(seen), "part", "key", "block").sortWithinPartitions("part", "key", "block")


def in_buckets(rows: DataFrame, parts: list[tuple[list[int], int]]) -> DataFrame:
    """All rows in their buckets, dealt and sorted: id, fp, own, part, key, block, and the further columns. Buckets that are too
    large are split: their rows go to every block that pairs their own block with another."""
    more = [c for c in rows.columns if c not in ("id", "fp")]
    probed = probed_by(rows, parts)
    large = probed.groupBy("part", "key").agg(F.count("*").alias("n")).where(F.col("n") > MOST).withColumn("blocks", F.ceil(F.col("n") / (MOST // 2)).cast("int"))
    seen = probed.join(large.select("part", "key", "blocks"), ["part", "key"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    return in_blocks(seen, more)


def whole_buckets(batches):
    """Sorted rows as columns of whole buckets, and where each bucket begins (with the end as the last place)."""
    rest = None
    for batch in itertools.chain(batches, [None]):
        if batch is None:
            now, rest = rest, None
        else:
            now = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns)]
            if rest is not None:
                now = [np.concatenate(x) for x in zip(rest, now, strict=True)]
        if now is None or not len(now[0]):
            continue
        part, key, block = now[3:6]
        new = np.flatnonzero((part[1:] != part[:-1]) | (key[1:] != key[:-1]) | (block[1:] != block[:-1])) + 1
        begins = np.r_[0, new, len(part)]
        if batch is not None:  # the last bucket may go on
            rest = [x[begins[-2] :] for x in now]
            begins = begins[:-1]
        if len(begins) > 1:
            yield [x[: begins[-1]] for x in now], begins


def links(rows: DataFrame, parts: list[tuple[list[int], int]], limit: int) -> DataFrame:
    """rows: distinct (id, fp). Pairs (a, b) of ids whose fingerprints are near; every near pair is connected by them."""

    def run(batches):
        for (ids, fp, own, *_), begins in whole_buckets(batches):
            fp, size = fp.view(U64), np.diff(begins)
            found = []
            small = np.repeat(size <= 64, size)
            bucket = np.repeat(np.arange(len(size)), size)
            index = np.flatnonzero(small)
            for step in range(1, int(size[size <= 64].max(initial=0))):  # row i against row i + step of its bucket
                index = index[index + step < begins[-1]]
                index = index[bucket[index] == bucket[index + step]]
                near = (distance(fp[index], fp[index + step]) <= limit) & (own[index] | own[index + step])
                found.append(np.stack([ids[index[near]], ids[index[near] + step]]))
            for b in np.flatnonzero(size > 64):
                s = slice(begins[b], begins[b + 1])
                got = linked(fp[s], ids[s], own[s], limit)
                if got:
                    found.append(np.array(got, np.int64).T)
            if found:
                a, b = np.concatenate(found, axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    return in_buckets(rows, parts).mapInArrow(run, "a long, b long").where("a <> b").distinct()


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of all that the links (a, b) join: the least id, and each other one."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    up = np.arange(len(ids))
    while True:  # the least label over each link, for its ends and for what they were tied to
        before = up.copy()
        low = np.minimum(before[x], before[y])
        for end in (x, y, before[x], before[y]):
            np.minimum.at(up, end, low)
        up = up[up]
        if (up == before).all():
            break
    rest = np.flatnonzero(up != np.arange(len(ids)))
    return ids[up[rest]], ids[rest]


def contracted(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b), those of each partition as stars: they join the same. A task holds one link for each of its ids."""

    def run(batches):
        held, size, most = [], 0, LINKS
        for batch in batches:
            held.append([batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)])
            size += batch.num_rows
            if size > most:
                held = [stars(*map(np.concatenate, zip(*held, strict=True)))]
                size = len(held[0][0])
                most = max(LINKS, 2 * size)
        if size:
            a, b = stars(*map(np.concatenate, zip(*held, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return edges.select("a", "b").where("a <> b").mapInArrow(run, "a long, b long")


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """(id, component): the smallest id reachable over the links, for every id that has a smaller one. Each task joins what the
    links of its partition join; up to ``LINKS`` of what is left are one partition, and settled. More alternate, until
    nothing changes, between tying each node's larger neighbours and its smaller neighbours to the smallest one it knows."""
    spark = edges.sparkSession
    common.shared_folder(spark)
    with common.frugal(spark):
        now = common.materialised(contracted(edges), "contracted")
        parts = max(1, -(-now.count() // LINKS))
        now = common.materialised(contracted(now.coalesce(parts)), "contracted")
        if parts == 1:
            return now.select(F.col("b").alias("id"), F.col("a").alias("component"))
        mark = None
        for _ in range(most):
            both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
            least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
            large = both.join(least, "u").where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a <> b").distinct()
            down = large.select(F.col("b").alias("u"), F.col("a").alias("v"))
            low = down.groupBy("u").agg(F.min("v").alias("m"))
            small = down.join(low, "u").select(F.col("m").alias("a"), F.explode(F.array("u", "v")).alias("b")).where("a <> b").distinct()
            # few links are held in few files, however many partitions a shuffle has
            now = (small.coalesce(max(1, -(-mark["n"] // LINKS))) if mark else small).checkpoint()
            new = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
            if new == mark:
                return now.select(F.col("b").alias("id"), F.col("a").alias("component")).distinct()
            mark = new
    raise RuntimeError("components did not settle")


def search_plan(rows: DataFrame, limit: int) -> list[tuple[list[int], int]]:
    """The plan for distinct fingerprints, by their count and a bounded sample of them, the same on every run."""
    some = rows.select("fp").orderBy(F.xxhash64("fp")).limit(SAMPLE).collect()
    return plan(np.array([r["fp"] for r in some], np.int64).view(U64), rows.count(), limit)


def classes(fps: DataFrame, limit: int) -> DataFrame:
    """fps: (doc_id, fp). Distinct fingerprints with their component: (fp, component_id)."""
    own = common.materialised(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprints")
    nodes = own.select(F.col("fp").alias("id"), "fp")
    tied = components(links(nodes, search_plan(nodes, limit), limit))
    named = own.join(tied.withColumnRenamed("id", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    return named.join(least, "component").select("fp", "component_id")


def near_duplicates(docs: DataFrame, width: int = 4, limit: int = 4) -> DataFrame:
    """doc_id, fingerprint (hex) and component_id of every document."""
    fps = common.materialised(fingerprints(docs, width), "simhash")
    found = classes(fps, limit)
    return fps.join(found, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.documents(spark, sf_dir))
