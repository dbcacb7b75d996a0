"""One document of each group of near copies: SimHash and prefix candidates, verified by their word shingles.

Texts are compared by their distinct five-word shingles; texts with equal sets are one node. Two nodes are tied if the
sets' similarity (common over all) is ``SIMILARITY`` or more; of each group that ties make the smallest ``doc_id`` stays.

Most ties come cheaply from SimHash: texts whose 64-bit word differs in at most ``LIMIT`` bits meet in its buckets (the
generalised pigeonhole of ``simhash``), and a forest of least distances of each bucket goes on to the exact check. This
pass only saves work. All other pairs come from an exact filter: in one order of all shingles, rarest first, similar sets
share one of their first ``prefix`` shingles, and their sizes, the shingle's places, and counts of their shingles in 256
classes (first their parities, then the counts) bound what they can share. Pairs that a shingle brings together are tested in rounds, by how far apart they are by
size; a pair is left out only if a bound excludes it, or if verified links join the two already. The order comes from a
sample, and is exact whatever it is.

Defined cases: as for ``simhash``; texts without words are copies of each other; a row with a null ``doc_id`` stays only
if no row of its group has an id; of rows equal in ``doc_id`` and group one stays, with the least shingle-set hash; all
columns of the kept rows stay.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.llm import common, simhash

WIDTH, LIMIT, WIDER, SIMILARITY = 5, 4, 40, 0.8
#: Documents, and shingles of them, that the order of shingles is chosen by.
SAMPLE, LISTED = 10_000, 100_000
#: How far apart by size the pairs of each round are, in places of their bucket. Neighbours come first: links among them
#: join most groups, and pairs within a group are not made any more.
ROUNDS = (1, 2, 17, 129, 2049, 1 << 40)
#: Candidate pairs that a task holds before it thins them to a forest.
HELD = 500_000
#: Candidate pairs of a round that are sent to all tasks; more are joined by shuffles. Few are verified without the filter by
#: counts. A task verifies some of the few.
FEW, SOME = 10_000, 500
PARITY = ["p0", "p1", "p2", "p3"]
BEFORE = ["b1", "b2"]
#: A class of a set's shingles that has so many or more.
FULL = 255
U64 = np.uint64
OTHER = (U64(0xA0761D6478BD642F), U64(0xE7037ED1A0B428DB))


def remixed(h: np.ndarray, salt: np.uint64) -> np.ndarray:
    x = h ^ salt
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def distinct_hashes(text: str | None) -> np.ndarray:
    return np.unique(simhash.hashes(text or "", WIDTH))


def node_of(h: np.ndarray) -> int:
    """A text's node: a hash of its shingle set."""
    return simhash.signed(xxhash.xxh3_64_intdigest(h.tobytes(), seed=len(h)))


def parities(h: np.ndarray) -> list[int]:
    """Of 256 classes of shingles, whether an odd number of them is in the set, as bits of four words. Sets differ in at least
    one shingle for each class in which these differ."""
    odd = np.bincount((h >> U64(40) & U64(255)).astype(np.int64), minlength=256) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


def frequent(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that are common in a bounded sample, sorted, and their counts in it."""

    def run(batches):
        for (texts,) in common.text_batches(batches, "text"):
            for a in range(0, len(texts), 200):
                flat = np.concatenate([distinct_hashes(t) for t in texts[a : a + 200]])
                yield pa.RecordBatch.from_arrays([pa.array(flat.view(np.int64))], names=["h"])

    every = max(1, docs.count() // SAMPLE)
    some = docs.select("text").where(F.pmod(F.xxhash64("text"), F.lit(every)) == 0).mapInArrow(run, "h long")
    got = some.groupBy("h").agg(F.count("*").alias("n")).where("n > 2").orderBy(F.desc("n"), "h").limit(LISTED).collect()
    h, n = np.array([r["h"] for r in got], np.int64).view(U64), np.array([r["n"] for r in got], np.int64)
    order = np.argsort(h)
    return h[order], n[order]


def prefix(h: np.ndarray, listed: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first shingles of a set, of which a similar set must share one among its own first."""
    if not len(h):
        return h
    seen = np.zeros(len(h), np.int64)
    if len(listed):
        at = np.minimum(np.searchsorted(listed, h), len(listed) - 1)
        seen = np.where(listed[at] == h, counts[at], 0)
    return h[np.lexsort((h, seen))][: len(h) - int(np.ceil(SIMILARITY * len(h) - 1e-9)) + 1]


def sketched(docs: DataFrame) -> DataFrame:
    listed, seen = frequent(docs)

    def run(batches):
        names = ["doc_id", "id", "fp", "v1", "v2", "size", *PARITY, "prefix", "counts"]
        for ids, texts in common.text_batches(batches, "doc_id", "text"):
            for a in range(0, len(ids), 500):
                out, firsts, counts = [], [], []
                for doc_id, text in zip(ids[a : a + 500], texts[a : a + 500], strict=True):
                    h = distinct_hashes(text)
                    out.append((doc_id, node_of(h), *(simhash.signed(simhash.fingerprint(x)) for x in (h, *(remixed(h, s) for s in OTHER))), len(h), *parities(h)))
                    firsts.append(prefix(h, listed, seen).view(np.int64))
                    counts.append(np.minimum(np.bincount((h >> U64(56)).astype(np.int64), minlength=256), FULL).astype(np.uint8).tobytes())
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in firsts])])
                flat = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(firsts), pa.int64()))
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in zip(*out, strict=True)), flat, pa.array(counts, pa.binary())], names=names)

    shape = "doc_id long, id long, fp long, v1 long, v2 long, size long, p0 long, p1 long, p2 long, p3 long, prefix array<long>, counts binary"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, shape)


def forest(a: np.ndarray, b: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """Which edges are a forest of least weight over n nodes: each round, every tree takes its lightest edge outwards."""
    rank = np.empty(len(a), np.int64)
    rank[np.lexsort((b, a, weight))] = np.arange(len(a))
    tree, taken = np.arange(n), np.zeros(len(a), bool)
    by_rank = np.argsort(rank)
    open_ = np.arange(len(a))
    while len(open_):
        ta, tb = tree[a[open_]], tree[b[open_]]
        cross = ta != tb
        open_, ta, tb = open_[cross], ta[cross], tb[cross]
        if not len(open_):
            break
        best = np.full(n, len(a))
        np.minimum.at(best, ta, rank[open_])
        np.minimum.at(best, tb, rank[open_])
        got = np.unique(by_rank[best[best < len(a)]])
        taken[got] = True
        x, y = tree[a[got]], tree[b[got]]
        up = np.arange(n)
        while True:  # the taken edges join trees: least label over them
            low = np.minimum(up[x], up[y])
            before = up.copy()
            np.minimum.at(up, x, low)
            np.minimum.at(up, y, low)
            up = up[up]
            if (up == before).all():
                break
        tree = up[tree]
    return taken


def candidates(nodes: DataFrame, parts, limit: int, wider: int) -> DataFrame:
    """nodes: distinct (id, fp, v1, v2). A forest of candidate pairs (a, b) of each bucket."""

    def run(batches):
        for (ids, fp, own, _, _, _, v1, v2), begins in simhash.whole_buckets(batches):
            fp, v1, v2 = (x.view(U64) for x in (fp, v1, v2))
            out = []
            for begin, end in zip(begins[:-1], begins[1:], strict=True):
                n = end - begin
                mine = np.flatnonzero(own[begin:end]) + begin
                if n < 2 or not len(mine):
                    continue
                held, size = [], 0
                rows = max(1, 2_000_000 // n)
                for k in range(0, len(mine), rows):
                    some = mine[k : k + rows]
                    x, y = np.nonzero(np.bitwise_count(fp[some, None] ^ fp[None, begin:end]) <= limit)
                    x, y = some[x] - begin, y
                    keep = (ids[x + begin] != ids[y + begin]) & (~own[y + begin] | (x < y))
                    x, y = x[keep], y[keep]
                    w = np.bitwise_count(fp[x + begin] ^ fp[y + begin]).astype(np.int16)
                    w += np.bitwise_count(v1[x + begin] ^ v1[y + begin])
                    w += np.bitwise_count(v2[x + begin] ^ v2[y + begin])
                    near = w <= wider
                    held.append((x[near], y[near], w[near]))
                    size += near.sum()
                    if size > HELD:
                        a, b, c = map(np.concatenate, zip(*held, strict=True))
                        take = forest(a, b, c, n)
                        held, size = [(a[take], b[take], c[take])], int(take.sum())
                if size:
                    a, b, c = map(np.concatenate, zip(*held, strict=True))
                    take = forest(a, b, c, n) if len(a) > 1 else slice(None)
                    out.append((ids[a[take] + begin], ids[b[take] + begin]))
            if out:
                a, b = (np.concatenate(x) for x in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    return simhash.in_buckets(nodes.select("id", "fp", "v1", "v2"), parts).mapInArrow(run, "a long, b long")


def met(nodes: DataFrame) -> DataFrame:
    """nodes: (id, size, prefix). The prefix shingles that several nodes have: id, size, pos, key, the two shingles before it in
    the prefix (its id where there is none), and the count n of nodes. Counts are combined before they move, and the join
    that follows may be split, so that no shingle gathers in one task."""
    each = nodes.select("id", "size", "prefix", F.posexplode("prefix").alias("pos", "key"))
    before = [F.coalesce(F.get("prefix", F.col("pos") - k), F.col("id")).alias(b) for k, b in enumerate(BEFORE, 1)]
    counted = each.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    return each.select("id", "size", "pos", "key", *before).join(counted, "key").select("id", "size", "pos", "key", "n", *BEFORE)


def apart(tokens: DataFrame, nodes: DataFrame, tied: DataFrame, first: int, last: int) -> DataFrame:
    """tokens: as from ``met``. Pairs (a, b), some of them again, that may be similar, are not in one component of ``tied``, and whose places by
    size in a bucket are ``first`` to ``last`` - 1 apart. Sizes, places and parities bound their similarity. A pair that has
    one of the shingles before in common meets in that one's bucket, too, and is left to it: its first common shingle has
    no such one before."""

    def run(batches):
        for (ids, size, _, _, _, _, pos, label, b1, b2, *odd), begins in simhash.whole_buckets(batches):
            lengths = np.diff(begins)
            order = np.lexsort((ids, size, np.repeat(np.arange(len(lengths)), lengths)))
            ids, size, pos, label, b1, b2, *odd = (x[order] for x in (ids, size, pos, label, b1, b2, *odd))
            odd = [p.view(U64) for p in odd]
            end, index, out, held = np.repeat(begins[1:], lengths), np.arange(len(ids)), [], 0
            for step in range(first, min(last, int(lengths.max()))):
                index = index[index + step < end[index]]
                index = index[size[index] >= SIMILARITY * size[index + step] - 1e-9]
                if not len(index):
                    break
                x, y = index, index + step
                most = np.minimum(size[x] - pos[x], size[y] - pos[y])  # what they share from here on, at most
                near = (label[x] != label[y]) & (most >= SIMILARITY * (size[x] + size[y] - most) - 1e-9)
                near &= (b1[x] != b1[y]) & (b1[x] != b2[y]) & (b2[x] != b1[y]) & (b2[x] != b2[y])
                x, y = x[near], y[near]
                differ = sum(np.bitwise_count(p[x] ^ p[y]).astype(np.int64) for p in odd)
                near = differ * (1 + SIMILARITY) <= (1 - SIMILARITY) * (size[x] + size[y]) + 1e-9
                out.append((ids[x[near]], ids[y[near]]))
                held += int(near.sum())
                if held > HELD:
                    yield sent(out)
                    out, held = [], 0
            if held:
                yield sent(out)

    def sent(out):
        a, b = (np.concatenate(x) for x in zip(*out, strict=True))
        a, b = np.unique([np.minimum(a, b), np.maximum(a, b)], axis=1)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    named = tokens.where(F.col("n") > first).join(tied, "id", "left").join(nodes.select("id", *PARITY), "id")
    blocks = F.when(F.col("n") > simhash.MOST, F.ceil(F.col("n") / (simhash.MOST // 2))).otherwise(1).cast("int")
    seen = named.select("id", F.col("size").alias("fp"), F.lit(True).alias("own"), F.lit(0).alias("part"), "key", blocks.alias("blocks"), "pos", F.coalesce("component", "id").alias("label"), *BEFORE, *PARITY)
    return simhash.in_blocks(seen, ["pos", "label", *BEFORE, *PARITY]).mapInArrow(run, "a long, b long").where("a <> b")


def plausible(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs that may be similar by their counts of shingles in 256 classes: what two sets share is at most the sum of the
    lesser counts. Where a class is ``FULL``, nothing is known, and the pair stays."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, 256) for i in (2, 3))
                sizes = batch.column(4).to_numpy(zero_copy_only=False)
                most = np.minimum(x, y).sum(axis=1, dtype=np.int64)
                keep = ((1 + SIMILARITY) * most >= SIMILARITY * sizes - 1e-9) | (x == FULL).any(axis=1) | (y == FULL).any(axis=1)
                yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(keep)) for i in (0, 1)], names=["a", "b"])

    one = nodes.select(F.col("id").alias("a"), F.col("counts").alias("x"), F.col("size").alias("m"))
    two = nodes.select(F.col("id").alias("b"), F.col("counts").alias("y"), F.col("size").alias("n"))
    both = pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y", (F.col("m") + F.col("n")).alias("sizes"))
    return common.materialised(both.mapInArrow(run, "a long, b long"), "plausible")


def shingle_sets(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """(id, hashes) of the documents in rows (doc_id, id)."""

    def run(batches):
        for ids, texts in common.text_batches(batches, "id", "text"):
            for a in range(0, len(ids), 200):
                sets = [distinct_hashes(t).view(np.int64) for t in texts[a : a + 200]]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
                flat = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(sets), pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(ids[a : a + 200], pa.int64()), flat], names=["id", "hashes"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    texts = own.join(rows, own["doc_id"].eqNullSafe(rows["doc_id"])).select("id", "text")
    return texts.mapInArrow(run, "id long, hashes array<long>")


def verified(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, regular: bool) -> DataFrame:
    """The pairs whose shingle sets are similar. nodes: (id, doc_id, ...), a document of each node; pairs: (a, b), of which some
    may come again. Few pairs and their documents' ids go to all tasks, so that neither texts nor nodes are shuffled for them."""
    count = pairs.count()
    if not count:
        return pairs
    few = count <= FEW
    pairs = pairs.coalesce(1).distinct() if few else plausible(pairs.distinct(), nodes)
    sent = F.broadcast if few else lambda df: df
    ends = pairs.select(F.col("a").alias("id"), "a", "b").unionByName(pairs.select(F.col("b").alias("id"), "a", "b"))
    if regular:
        sets = shingle_sets(docs, sent(nodes.join(sent(ends.select("id")), "id", "left_semi").select("doc_id", "id")))
    else:  # an id may have several texts: their own nodes tell which is meant
        needed = ends.select("id").distinct()
        sets = nodes_of(docs.select("text"), "doc_id").join(needed.withColumnRenamed("id", "doc_id"), "doc_id").dropDuplicates(["doc_id"])
        sets = shingle_sets(sets, needed.select(F.col("id").alias("doc_id"), "id"))
    if few:
        one, two = (F.first(F.when(F.col("id") == F.col(c), F.col("hashes")), ignorenulls=True).alias(n) for c, n in (("a", "x"), ("b", "y")))
        joined = sets.join(sent(ends), "id").groupBy("a", "b").agg(one, two).coalesce(-(-count // SOME))
    else:
        sets = common.materialised(sets, "shingle-sets")
        one = sets.select(F.col("id").alias("a"), F.col("hashes").alias("x"))
        two = sets.select(F.col("id").alias("b"), F.col("hashes").alias("y"))
        joined = pairs.join(one, "a").join(two, "b")
    joined = joined.withColumn("n", F.size(F.array_intersect("x", "y")))
    return joined.where(F.col("n") >= SIMILARITY * (F.size("x") + F.size("y") - F.col("n"))).select("a", "b")


def nodes_of(docs: DataFrame, node: str) -> DataFrame:
    """``docs`` and its nodes as the column ``node``."""

    @F.arrow_udf("long")
    def of(text: pa.Array) -> pa.Array:
        return pa.array([node_of(distinct_hashes(t.as_py())) for t in text], pa.int64())

    return docs.withColumn(node, of(F.col("text")))


def representatives(docs: DataFrame, limit: int = LIMIT, wider: int = WIDER) -> DataFrame:
    """The rows of ``docs`` that stay: one of each group of near copies."""
    with common.frugal(docs.sparkSession):  # the questions asked on the way shuffle, too
        return kept_rows(docs, limit, wider)


def kept_rows(docs: DataFrame, limit: int, wider: int) -> DataFrame:
    rows = common.materialised(sketched(docs), "simhash")
    regular = rows.where("doc_id is null").isEmpty() and rows.groupBy("doc_id").count().where("count > 1").isEmpty()
    firsts = [F.first(c).alias(c) for c in ("fp", "v1", "v2", "size", *PARITY, "prefix", "counts")]
    nodes = common.materialised(rows.groupBy("id").agg(F.min("doc_id").alias("doc_id"), *firsts), "nodes")
    plan = simhash.search_plan(nodes.select("fp").distinct(), limit)
    pairs = common.materialised(candidates(nodes, plan, limit, wider), "candidates")
    tied = simhash.components(verified(docs, nodes, pairs, regular))
    tokens = common.materialised(met(nodes), "tokens")
    most = tokens.agg(F.max("n")).first()[0] or 0
    for begin, end in zip(ROUNDS[:-1], ROUNDS[1:], strict=True):
        if begin >= most:
            break
        pairs = common.materialised(apart(tokens, nodes, tied, begin, end), "candidates")
        known = tied.select(F.col("component").alias("a"), F.col("id").alias("b"))
        tied = simhash.components(verified(docs, nodes, pairs, regular).unionByName(known))
    named = nodes.join(tied, "id", "left").withColumn("component", F.coalesce("component", "id"))
    first = named.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "id")).alias("x"))
    stays = first.select(F.col("x.doc_id").alias("doc_id"), F.col("x.id").alias("id"))
    node, own = common.unused("node", docs), common.unused("own_id", docs)
    if regular:
        gone = rows.select("doc_id").join(stays.select("doc_id"), "doc_id", "left_anti")
        return docs.join(gone.select(F.col("doc_id").alias(own)), docs["doc_id"] == F.col(own), "left_anti")
    mine = nodes_of(docs, node)
    stays = stays.select(F.col("doc_id").alias(own), F.col("id").alias("id"))
    left = mine.join(stays, (mine[node] == stays["id"]) & mine["doc_id"].cast("long").eqNullSafe(stays[own]), "left_semi")
    return left.dropDuplicates([node]).select(*docs.columns)
