"""Vector codes: product quantisation by Lloyd's rounds, assigned by two trees, in whole numbers.

A component x becomes floor(1024 * x); vectors are cut into ``PARTS`` equal parts, and each position of a part has a codebook
of up to ``ENTRIES`` entries. A round assigns every part to its nearest entry (ties to the lower index) and moves each
entry to the floored mean of its parts; entries without parts stay.

Vectors are stored once as blocks of rows, each with an order for every part position: that of a tree that halves its rows at
the widest component. In a round each task walks down such a tree and the tree of the entries together. A pair of nodes is
given up when its boxes are farther apart than another pair's can be at most; once entries stand alone, one is given up too
when another is nearer all over the box. A node with one entry left is assigned whole, by its cached count and sums; what
is still uncertain at the leaves is decided by distances, row by row. All bounds are whole numbers, so that nothing is
given up that could win or tie.

A task gives back sums of its rows for each entry; Spark adds them (as decimals, so that no sum overflows), and only sums,
as many as the codebooks have numbers, reach the driver. The codebooks that go to the tasks are of that size as well.

Defined cases: vectors that are null, or hold null, NaN or infinite components, are dropped; the codebooks start from the rows
of smallest ``vec_id``, nulls last, rows of equal ids in order of their vectors; repeated rows count each; with under 256
rows there are fewer entries; vectors shorter than the longest, or of a length that four does not divide, are filled up with
zeros; null labels are one label; an empty table gives no rows; columns other than vec_id, embedding and label are not read.
The sum of squared distances must fit 62 bits, else it is a ``ValueError`` (with 64 components: beyond 500,000).
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.llm import common

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Rows of a block, at most; bytes of its numbers, at most; rows of a leaf, at least.
ROWS, BYTES, LEAF = 4096, 1 << 21, 64


# --- trees ---


def halved(n: int, level: int) -> np.ndarray:
    """Where the nodes of a level begin, and the end: each node's halves are the next level's."""
    return (np.arange(2**level + 1) * n) >> level


def depth_of(n: int, leaf: int) -> int:
    """Levels below the root, with ``leaf`` rows or more in every node."""
    return max(0, (n // leaf).bit_length() - 1)


def tree_order(x: np.ndarray, depth: int) -> np.ndarray:
    """Rows in an order that sorts each node by its widest component before it is halved."""
    order = np.arange(len(x))
    for level in range(depth if x.shape[1] else 0):
        edges = halved(len(x), level)
        now = x[order]
        wide = (np.maximum.reduceat(now, edges[:-1], axis=0) - np.minimum.reduceat(now, edges[:-1], axis=0)).argmax(axis=1)
        node = np.repeat(np.arange(len(wide)), np.diff(edges))
        order = order[np.lexsort((now[np.arange(len(now)), wide[node]], node))]
    return order


class Tree:
    """Boxes of all nodes over rows in tree order; and sums, where they are asked for."""

    def __init__(self, x: np.ndarray, depth: int, sums: bool = False):
        self.x, self.depth = x, depth
        self.edges = [halved(len(x), level) for level in range(depth + 1)]
        each = lambda f: [f.reduceat(x, e[:-1], axis=0) for e in self.edges]
        self.low, self.high, self.sums = each(np.minimum), each(np.maximum), each(np.add) if sums else None


def groups(q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted numbers: where each begins, and which group each place is in."""
    new = np.r_[True, q[1:] != q[:-1]]
    return np.flatnonzero(new), np.cumsum(new) - 1


class Search:
    """The entries of a codebook under a tree, and the walk of a block's tree against it."""

    def __init__(self, entries: np.ndarray):
        depth = depth_of(len(entries), 1)
        self.number = tree_order(entries, depth)
        self.entries, self.tree = entries, Tree(entries[self.number], depth)
        self.squares = (entries**2).sum(axis=1)

    def near_enough(self, low, high, q, e, level) -> np.ndarray:
        """Pairs of nodes whose boxes are no farther apart than the best of the same node can be at most."""
        elow, ehigh = self.tree.low[level][e], self.tree.high[level][e]
        gap = np.maximum(np.maximum(elow - high, low - ehigh), 0)
        most = np.maximum(ehigh - low, high - elow)
        begin, group = groups(q)
        best = np.minimum.reduceat((most**2).sum(axis=1), begin)
        return (gap**2).sum(axis=1) <= best[group]

    def not_ruled_out(self, low, high, q, e) -> np.ndarray:
        """Pairs of a node and an entry, but those where one other entry is nearer at every place of the node's box."""
        begin, group = groups(q)
        off = ((low + high - 2 * self.entries[e]) ** 2).sum(axis=1)
        least = np.minimum.reduceat(off, begin)[group]
        one = np.minimum.reduceat(np.where(off == least, e, len(self.entries)), begin)[group]
        slope = 2 * (self.entries[e] - self.entries[one])
        most = np.maximum(low * slope, high * slope).sum(axis=1) + self.squares[one] - self.squares[e]
        return (most > 0) | ((most == 0) & (one >= e))

    def walk(self, rows: Tree) -> tuple[list, list]:
        """Whole nodes as (level, nodes, entries), and single rows as (places, entries)."""
        whole, single = [], []
        level, down, alone = 0, 0, False
        q, e = np.zeros(1, np.int64), np.zeros(1, np.int64)
        while len(q):
            low, high = rows.low[level][q], rows.high[level][q]
            keep = self.not_ruled_out(low, high, q, e) if alone else self.near_enough(low, high, q, e, down)
            q, e = q[keep], e[keep]
            if not alone and down == self.tree.depth:  # leaves have one or two entries
                edges = self.tree.edges[down]
                size = np.diff(edges)[e]
                place = np.repeat(edges[e] - np.cumsum(size) + size, size) + np.arange(size.sum())
                q, e, alone = np.repeat(q, size), self.number[place], True
                continue
            if alone:
                begin, group = groups(q)
                sure = np.diff(np.r_[begin, len(q)])[group] == 1
                whole.append((level, q[sure], e[sure]))
                q, e = q[~sure], e[~sure]
                if not len(q):
                    break
                if level == rows.depth:
                    single += self.leaves(rows, q, e)
                    break
            else:
                for _ in range(min(2, self.tree.depth - down)):
                    q, e, down = np.repeat(q, 2), np.repeat(2 * e, 2) + np.tile([0, 1], len(e)), down + 1
            if level < rows.depth:
                size = np.diff(np.r_[groups(q)[0], len(q)])
                begin = np.cumsum(size) - size
                # a node's pairs go to both of its halves, one half after the other
                take = np.repeat(begin, 2 * size) + np.arange(2 * len(q)) - np.repeat(2 * begin, 2 * size)
                second = take - np.repeat(begin, 2 * size) >= np.repeat(size, 2 * size)
                take = take - second * np.repeat(size, 2 * size)
                q, e, level = 2 * q[take] + second, e[take], level + 1
        return whole, single

    def leaves(self, rows: Tree, q: np.ndarray, e: np.ndarray) -> list:
        """Each row of a leaf with the nearest of its leaf's entries; of equal ones that of the lowest index. What all distances
        of a row share is left out. Whole numbers below 2**53 are exact as floating-point numbers, too, in any order of
        additions, and are multiplied faster; larger ones stay integers."""
        out, edges = [], rows.edges[rows.depth]
        begin = groups(q)[0]
        reach = max((int(np.abs(y).max()) for y in (self.entries, rows.low[0], rows.high[0]) if y.size), default=0)
        kind = np.float64 if 3 * rows.x.shape[1] * reach**2 < 2**53 else np.int64
        x, entries, squares = rows.x.astype(kind), -2 * self.entries.astype(kind), self.squares.astype(kind)
        for a, b in zip(begin, np.r_[begin[1:], len(q)], strict=True):
            first, last = edges[q[a]], edges[q[a] + 1]
            asked = np.sort(e[a:b])
            distance = squares[asked] + x[first:last] @ entries[asked].T
            out.append((np.arange(first, last), asked[distance.argmin(axis=1)]))
        return out


def totals(search: Search, rows: Tree) -> np.ndarray:
    """Of each entry: its number of rows, and the sums of their components."""
    out = np.zeros((len(search.entries), rows.x.shape[1] + 1), np.int64)
    whole, single = search.walk(rows)
    for level, q, e in whole:
        np.add.at(out[:, 0], e, np.diff(rows.edges[level])[q])
        np.add.at(out[:, 1:], e, rows.sums[level][q])
    for at, e in single:
        np.add.at(out[:, 0], e, 1)
        np.add.at(out[:, 1:], e, rows.x[at])
    return out


def nearest(search: Search, rows: Tree) -> np.ndarray:
    """The entry of each row, in tree order."""
    out = np.zeros(len(rows.x), np.int64)
    whole, single = search.walk(rows)
    for level, q, e in whole:
        edges = rows.edges[level]
        size = np.diff(edges)[q]
        out[np.repeat(edges[q] - np.cumsum(size) + size, size) + np.arange(size.sum())] = np.repeat(e, size)
    for at, e in single:
        out[at] = e
    return out


# --- vectors as blocks ---


def kept(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """(vec_id, x, label) of the vectors whose components are all finite numbers."""
    finite = F.forall(column, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return vectors.where(F.col(column).isNotNull() & finite).select(F.col("vec_id").cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("x"), "label")


def whole_numbers(x: pa.Array, size: int) -> np.ndarray:
    """Rows of ``size`` scaled and floored components, the missing ones zero."""
    x = x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x
    length = x.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(x), size), np.int64)
    out[np.arange(size) < length[:, None]] = np.floor(SCALE * x.flatten().to_numpy(zero_copy_only=False))
    return out


def as_blocks(rows: DataFrame, size: int) -> DataFrame:
    """Rows as blocks: their ids and labels, their numbers part by part in tree order, and each tree's order."""
    most = max(LEAF, min(ROWS, BYTES // (8 * max(1, size))))
    kind = dict(rows.dtypes)["label"]

    def block(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = whole_numbers(batch.column(1), size).reshape(batch.num_rows, PARTS, -1)
        orders = [tree_order(x[:, p], depth_of(len(x), LEAF)) for p in range(PARTS)]
        numbers = np.stack([x[o, p] for p, o in enumerate(orders)]).astype("<i4").tobytes()
        one = pa.array([0, batch.num_rows], pa.int32())
        lists = [pa.ListArray.from_arrays(one, batch.column(i)) for i in (0, 2)]
        return pa.RecordBatch.from_arrays([*lists, pa.array([numbers]), pa.array([np.stack(orders).astype("<i4").tobytes()])], names=["ids", "labels", "numbers", "orders"])

    def run(batches):
        waiting, n = [], 0
        for batch in batches:
            waiting.append(batch)
            n += batch.num_rows
            while n >= most:
                table = pa.Table.from_batches(waiting)
                yield block(table.slice(0, most).combine_chunks().to_batches()[0])
                waiting, n = table.slice(most).to_batches(), n - most
        if n:
            yield block(pa.Table.from_batches(waiting).combine_chunks().to_batches()[0])

    return rows.mapInArrow(run, f"ids array<long>, labels array<{kind}>, numbers binary, orders binary")


def trees_of(numbers: bytes, n: int, sums: bool) -> list[Tree]:
    x = np.frombuffer(numbers, "<i4").astype(np.int64).reshape(PARTS, n, -1)
    return [Tree(x[p], depth_of(n, LEAF), sums) for p in range(PARTS)]


def summed(blocks: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """Of each part and entry, over all rows: their number, and the sums of their components."""
    width = books[0].shape[1]

    def run(batches):
        search = [Search(b) for b in books]
        total = np.zeros((PARTS, len(books[0]), width + 1), np.int64)
        for batch in batches:
            for numbers, n in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                for p, rows in enumerate(trees_of(numbers.as_py(), n, True)):
                    total[p] += totals(search[p], rows)
        part, entry = np.nonzero(total[:, :, 0])
        if len(part):
            places = np.tile(np.arange(width + 1), len(part))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part, width + 1), pa.int32()), pa.array(np.repeat(entry, width + 1), pa.int32()), pa.array(places, pa.int32()), pa.array(total[part, entry].ravel())], names=["part", "entry", "place", "total"])

    each = blocks.select("numbers", F.size("ids").alias("n")).mapInArrow(run, "part int, entry int, place int, total long")
    with common.frugal(blocks.sparkSession):
        added = each.groupBy("part", "entry", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
    out = [np.zeros((len(b), width + 1), object) for b in books]
    for r in added:
        out[r["part"]][r["entry"], r["place"]] = int(r["total"])
    return out


def moved(book: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Each entry at the floored mean of its rows; where it has none it stays."""
    used = total[:, 0] != 0
    new = book.copy()
    new[used] = (total[used, 1:] // total[used, :1]).astype(np.int64)
    return new


def coded(blocks: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """(vec_id, label, code, error) of every row."""
    kind = dict(blocks.dtypes)["labels"][6:-1]

    def run(batches):
        search = [Search(b) for b in books]
        for batch in batches:
            for i in range(batch.num_rows):
                ids, labels = batch.column(0)[i].values, batch.column(1)[i].values
                orders = np.frombuffer(batch.column(3)[i].as_py(), "<i4").reshape(PARTS, -1)
                codes, error = np.zeros((len(ids), PARTS), np.uint8), np.zeros(len(ids), np.int64)
                for p, rows in enumerate(trees_of(batch.column(2)[i].as_py(), len(ids), False)):
                    e = nearest(search[p], rows)
                    codes[orders[p], p] = e
                    error[orders[p]] += ((rows.x - books[p][e]) ** 2).sum(axis=1)
                yield pa.RecordBatch.from_arrays([ids, labels, pa.array([c.tobytes().hex() for c in codes]), pa.array(error)], names=["vec_id", "label", "code", "error"])

    return blocks.mapInArrow(run, f"vec_id long, label {kind}, code string, error long")


def learned(rows: DataFrame, blocks: DataFrame, size: int, rounds: int = ROUNDS) -> list[np.ndarray]:
    """The codebooks after all rounds."""
    first = rows.select("vec_id", "x").orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(ENTRIES).collect()
    start = whole_numbers(pa.array([r["x"] for r in first], pa.list_(pa.float64())), size).reshape(len(first), PARTS, size // PARTS)
    books = [np.ascontiguousarray(start[:, p]) for p in range(PARTS)]
    for _ in range(rounds if first else 0):
        books = [moved(b, t) for b, t in zip(books, summed(blocks, books), strict=True)]
    return books


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(map(str, np.stack(books).ravel().tolist())).encode()).hexdigest()


def compressed(vectors: DataFrame, column: str = "embedding", rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """(vec_id, label, code, error) of every kept vector, as a table, and the codebooks that the codes belong to."""
    rows = kept(vectors, column)
    largest: Column = F.max(F.array_max(F.transform("x", F.abs)))
    found = rows.agg(F.max(F.size("x")).alias("size"), largest.alias("largest")).first()
    size = -(-(found["size"] or 0) // PARTS) * PARTS
    reach = SCALE * (found["largest"] or 0.0) + 1
    if size * (2 * reach) ** 2 >= 2.0**62 or reach >= 2**31 - 1:
        raise ValueError(f"components up to {found['largest']} are too large for distances in whole numbers")
    blocks = common.materialised(as_blocks(rows, size), "vector-blocks")
    books = learned(rows, blocks, size, rounds)
    if not len(books[0]):
        return rows.where(F.lit(False)).select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")), books
    return common.materialised(coded(blocks, books), "vector-codes"), books


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = compressed(common.table(spark, sf_dir, "embeddings"))
    by_label = codes.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    met = codes.join(by_label, F.col("label").eqNullSafe(F.col("of")))
    return met.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def oracle_sql() -> str:
    head = f"""
with rows_ as materialized (select row_number() over (order by vec_id nulls last, embedding) - 1 as r, vec_id, label, embedding from embeddings where embedding is not null),
each as materialized (select r, len(embedding) // {PARTS} as w, unnest(embedding) as v, generate_subscripts(embedding, 1) - 1 as i from rows_),
bad as (select distinct r from each where v is null or not isfinite(v)),
ok as materialized (select row_number() over (order by r) - 1 as k, r, vec_id, label from rows_ where r not in (select r from bad)),
comps as materialized (select k, i // w as part, i % w as pos, cast(floor({SCALE} * cast(v as double)) as bigint) as c from each join ok using (r)),
book0 as materialized (select part, k as entry, pos, c from comps where k < {ENTRIES})"""
    nearest_ = """
best{n} as materialized (
  select k, part, min(d * 256 + entry) as packed from (
    select x.k, x.part, b.entry, cast(sum((x.c - b.c) * (x.c - b.c)) as bigint) as d from comps x join book{n} b on x.part = b.part and x.pos = b.pos group by 1, 2, 3) group by 1, 2)"""
    moved_ = """
sums{n} as materialized (select x.part, t.packed % 256 as entry, x.pos, cast(sum(x.c) as bigint) as s, count(*) as n from comps x join best{n} t on x.k = t.k and x.part = t.part group by 1, 2, 3),
book{m} as materialized (
  select b.part, b.entry, b.pos, coalesce((s - ((s % n) + n) % n) // n, b.c) as c
  from book{n} b left join sums{n} u on b.part = u.part and b.entry = u.entry and b.pos = u.pos)"""
    steps = [step for n in range(ROUNDS) for step in (nearest_.format(n=n), moved_.format(n=n, m=n + 1))]
    tail = f"""
codes as materialized (select k, string_agg(lower(lpad(to_hex(packed % 256), 2, '0')), '' order by part) as code, cast(sum(packed // 256) as bigint) as error from best{ROUNDS} group by k),
named as (select vec_id, label, code, error from codes join ok using (k))
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error,
  (select sha256(string_agg(cast(c as varchar), ',' order by part, entry, pos)) from book{ROUNDS}) as codebooks_sha256 from named"""
    return ",".join([head, *steps, nearest_.format(n=ROUNDS), tail])
