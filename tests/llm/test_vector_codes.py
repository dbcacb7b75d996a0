"""Vector codes against plain Lloyd rounds, and the dual walk against all distances."""

import glob
import hashlib
import math
import os
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave.llm import vector_codes as V

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("n,m,width,most", [(1, 1, 3, 5), (3, 2, 1, 2), (50, 5, 2, 3), (300, 7, 2, 4), (1000, 100, 4, 3), (5, 256, 3, 2), (700, 256, 1, 2), (64, 3, 0, 1), (900, 40, 8, 2**27)])
def test_walk_equals_all_distances(n, m, width, most):
    rng = np.random.default_rng(n + m)
    x, e = rng.integers(-most, most + 1, (n, width)), rng.integers(-most, most + 1, (m, width))
    depth = V.depth_of(n, V.LEAF)
    rows = V.Tree(x[V.tree_order(x, depth)], depth, True)
    distance = ((rows.x[:, None] - e[None]) ** 2).sum(axis=2)
    want = distance.argmin(axis=1)  # the first of equal ones
    assert (V.nearest(V.Search(e), rows) == want).all()
    sums = np.zeros((m, width + 1), np.int64)
    np.add.at(sums[:, 0], want, 1)
    np.add.at(sums[:, 1:], want, rows.x)
    assert (V.totals(V.Search(e), rows) == sums).all()


def test_far_groups_are_assigned_whole():
    rng = np.random.default_rng(2)
    centres = np.array([[0, 0], [10_000, 0], [0, 10_000], [10_000, 10_000]])
    x = np.repeat(centres, 64, axis=0) + rng.integers(-9, 10, (256, 2))
    depth = V.depth_of(256, V.LEAF)
    rows = V.Tree(x[V.tree_order(x, depth)], depth, True)
    whole, single = V.Search(centres).walk(rows)
    assert not single and sum(len(q) for _, q, _ in whole) <= 8 and sorted({int(e) for _, _, es in whole for e in es}) == [0, 1, 2, 3]


def test_equal_entries_go_to_the_lowest():
    x = np.arange(200)[:, None] % 3
    depth = V.depth_of(200, V.LEAF)
    rows = V.Tree(x[V.tree_order(x, depth)], depth, True)
    got = V.nearest(V.Search(np.array([[2], [0], [0], [2], [1]])), rows)
    assert {(int(a), int(b)) for a, b in zip(rows.x[:, 0], got, strict=True)} == {(0, 1), (1, 4), (2, 0)}


def plain(rows):
    """rows: (vec_id, vector, label). Result rows, by Python's own numbers."""
    rows = [r for r in rows if r[1] is not None and all(v is not None and math.isfinite(v) for v in r[1])]
    if not rows:
        return []
    size = -(-max(len(v) for _, v, _ in rows) // 4) * 4
    w = size // 4
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    x = [[math.floor(1024 * v) for v in vec] + [0] * (size - len(vec)) for _, vec, _ in rows]
    parts = [[[r[p * w + i] for i in range(w)] for r in x] for p in range(4)]
    books = [part[:256] for part in parts]
    near = lambda y, book: min((sum((a - b) ** 2 for a, b in zip(y, e, strict=True)), k) for k, e in enumerate(book))
    for _ in range(4):
        for p in range(4):
            own = [[] for _ in books[p]]
            for y in parts[p]:
                own[near(y, books[p])[1]].append(y)
            books[p] = [[sum(c) // len(o) for c in zip(*o, strict=True)] if o else e for o, e in zip(own, books[p], strict=True)]
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    out = []
    for i, (vec_id, _, label) in enumerate(rows):
        got = [near(parts[p][i], books[p]) for p in range(4)]
        out.append((vec_id, "".join(f"{k:02x}" for _, k in got), sum(d for d, _ in got), label))
    by = {}
    for _, _, e, label in out:
        by[label] = by.get(label, 0) + e
    return sorted(((i, c, e, by[label], sha) for i, c, e, label in out), key=repr)


def query(spark, rows, tmp_path):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    df.withColumns({"code": F.lit("clash"), "X": F.lit(1), "error": F.lit(None).cast("int")}).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = V.op11_vector_codes(spark, str(tmp_path))
    return sorted((tuple(r) for r in got.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=repr)


def test_query_equals_plain_rounds(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(V, "ROWS", 100)
    r = random.Random(4)
    rows = [(i if i % 50 else None, [r.gauss(i % 5, 0.3) for _ in range(8)], i % 3 or None) for i in range(340)]
    rows += rows[:20] + [(-1, [0.5] * 8, 1)] * 30 + [(-2, None, 1), (-3, [1.0, None] * 4, 1), (-4, [float("nan")] * 8, 2), (-5, [float("inf")] * 8, 2)]
    assert query(spark, rows, tmp_path) == plain(rows)


def test_few_short_and_uneven_vectors(spark, tmp_path):
    rows = [(3, [1.0, 2.0, -3.5], 1), (1, [], None), (2, [0.25] * 6, None), (2, [0.25] * 6, None)]
    assert query(spark, rows, tmp_path) == plain(rows)


def test_empty_table_and_too_large_numbers(spark, tmp_path):
    assert query(spark, [], tmp_path) == []
    big = spark.createDataFrame([(1, [1e30] * 4, 1)], "vec_id long, embedding array<double>, label int")
    with pytest.raises(ValueError, match="too large"):
        V.compressed(big)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
def test_query_equals_sql(spark):
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    found = c.execute(V.oracle_sql())
    names = [x[0] for x in found.description]
    df = V.op11_vector_codes(spark, DATA)
    assert sorted(names) == sorted(df.columns)
    assert sorted(tuple(r) for r in df.select(*names).collect()) == sorted(found.fetchall())
