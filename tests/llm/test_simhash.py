import itertools
import random
import re

import numpy as np
import pytest
import xxhash

from cellweave.llm import near_copies, simhash


def words_of(text):
    return re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def print_of(text, width=4):
    w = words_of(text)
    each = [" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in each]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def groups(n, linked):
    label = list(range(n))

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, j in itertools.combinations(range(n), 2):
        if linked(i, j):
            a, b = top(i), top(j)
            label[max(a, b)] = min(a, b)
    return [top(i) for i in range(n)]


def texts(seed, n):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    out = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(20, 90))) for _ in range(n // 2)]
    while len(out) < n:
        w = rng.choice(out).split(" ")
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        out.append(" ".join(w))
    return [*out, "", None, "  \n", "One two", "one TWO", "Ünï code Ä b c"]


def test_components_equal_brute_force(spark, monkeypatch):
    rows = list(enumerate(texts(3, 160)))
    fps = [print_of(t) for _, t in rows]
    label = groups(len(rows), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 4)
    expected = [(i, f"{fps[i]:016x}", label[i]) for i, _ in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, simhash.near_duplicates(docs).collect())) == expected
    monkeypatch.setattr(simhash, "MOST", 8)  # large buckets are split into blocks
    assert sorted(map(tuple, simhash.near_duplicates(docs).collect())) == expected


@pytest.mark.parametrize("rows,limit", [(100, 4), (10**6, 4), (10**10, 4), (10**5, 10), (10**7, 7)])
def test_plan_covers_every_near_pair(rows, limit):
    rng = np.random.default_rng(1)
    sample = rng.integers(0, 2**63, 300).astype(np.uint64)
    parts = simhash.plan(sample, rows, limit)
    assert sum(t + 1 for _, t in parts) == limit + 1
    for _ in range(300):
        flipped = set(rng.choice(64, limit, replace=False).tolist())
        assert any(len(flipped & set(bits)) <= t for bits, t in parts)


def test_correlated_bits_share_a_part():
    rng = np.random.default_rng(2)
    bits = rng.integers(0, 2, (500, 64)).astype(np.uint8)
    bits[:, 40] = bits[:, 3]
    part = next(p for p in simhash.grouped_bits(bits, 4) if 3 in p)
    assert 40 in part


def test_null_and_repeated_ids(spark):
    rows = [(None, "a b c d e f g h"), (5, "a b c d e f g h"), (5, "a b c d e f g h"), (5, "other words are here to be seen"), (None, "lonely words without any company at all")]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 5
    assert sorted((r["doc_id"], r["component_id"]) for r in got if r["doc_id"] is not None) == [(5, 5)] * 3
    assert sorted((r["component_id"] for r in got if r["doc_id"] is None), key=str) == [5, None]
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("most", [20_000, 8])  # with 8, large buckets are split into blocks
def test_representatives_equal_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(simhash, "MOST", most)
    rows = [(i, t, "x", i) for i, t in enumerate(texts(7, 140))]
    sets = [set(" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if (w := words_of(t)) else set() for _, t, *_ in rows]

    def similar(i, j):
        return (not sets[i] and not sets[j]) or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])

    label = groups(len(rows), similar)
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string, id long")
    kept = near_copies.representatives(docs).collect()
    assert kept[0].__fields__ == docs.columns
    kept = {r["doc_id"] for r in kept}
    clear = {i for i in range(len(rows)) if label[i] == i}
    assert clear <= kept  # nothing goes that has no similar one before it
    assert len(kept - clear) <= 0.03 * len(rows)  # fingerprints may miss a pair close to the limit


def test_representatives_of_odd_rows(spark):
    text = "one two three four five six seven eight nine ten"
    rows = [(None, text), (3, text), (3, text), (3, "another text that has no copy in the table at all"), (None, None), (4, "")]
    kept = near_copies.representatives(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["text"]) for r in kept) == [(3, "another text that has no copy in the table at all"), (3, text), (4, "")]
    assert near_copies.representatives(spark.createDataFrame([], "doc_id long, text string, lang string")).columns == ["doc_id", "text", "lang"]


def test_forest_keeps_connections():
    rng = np.random.default_rng(4)
    a, b = rng.integers(0, 60, 200), rng.integers(0, 60, 200)
    w = rng.integers(0, 9, 200)
    take = near_copies.forest(a, b, w, 60)
    for limit in range(9):
        every = groups(60, lambda i, j, e={(x, y) for x, y, z in zip(a, b, w) if z <= limit}: (i, j) in e or (j, i) in e)
        some = groups(60, lambda i, j, e={(x, y) for x, y, z, t in zip(a, b, w, take) if z <= limit and t}: (i, j) in e or (j, i) in e)
        assert every == some
