import hashlib
import random
from collections import Counter

import numpy as np

from cellweave.llm import fingerprint


def pieces(text):
    seen, out = Counter(), set()
    for p in fingerprint.PIECES.findall(text):
        p = p.strip()
        seen[p] += 1
        out.add((p, seen[p]))
    return out


def alike(a, b):
    a, b = pieces(a), pieces(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def test_results_equal_brute_force(spark):
    rng = random.Random(1)
    sentence = lambda: " ".join("".join(rng.choice("abcdef") for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(1, 12))) + ". "
    stock = [sentence() for _ in range(60)]
    texts = ["".join(rng.choice(stock) for _ in range(rng.randint(0, 60))) for _ in range(90)] + ["", None, "é" * 999, "x\n" * 500, "no end"]
    rows = [(i * 7 % 1000, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, own int")
    got = {r["doc_id"]: r for r in fingerprint.fingerprints(docs).collect()}
    order = sorted(rows)
    assert len(got) == len(rows)
    prints = {}
    for (doc_id, text), (_, following) in zip(order, order[1:] + order[:1]):
        text, following = text or "", following or ""
        n = len(text) // 4
        new = text[: len(text) - n] + following[:n]
        r = got[doc_id]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(new.encode()).hexdigest())
        assert abs(r["near_edited"] - alike(text, new)) < 1e-9 and abs(r["near_next"] - alike(text, following)) < 1e-9
        assert prints.setdefault(text, r["fingerprint"]) == r["fingerprint"]
        prints[new] = prints.get(new, r["edited_fingerprint"])
        assert prints[new] == r["edited_fingerprint"]


def test_likeness_follows_from_the_fingerprints(spark):
    rng = random.Random(2)
    stock = [f"sentence {i} of many. " for i in range(40)]
    docs = spark.createDataFrame([(i, "".join(rng.choice(stock) for _ in range(rng.randint(0, 120)))) for i in range(40)], "doc_id long, text string")
    rows = fingerprint.fingerprints(docs).orderBy("doc_id").collect()
    for r, following in zip(rows, rows[1:] + rows[:1]):
        assert abs(fingerprint.likeness_of(r["fingerprint"], r["edited_fingerprint"]) - r["near_edited"]) < 1e-9
        assert abs(fingerprint.likeness_of(r["fingerprint"], following["fingerprint"]) - r["near_next"]) < 1e-9


def test_odd_tables(spark):
    assert fingerprint.fingerprints(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    one = fingerprint.fingerprints(spark.createDataFrame([(3, "abcdefgh")], "doc_id long, text string")).collect()
    assert one[0]["edited_sha256"] == hashlib.sha256(b"abcdefab").hexdigest() and one[0]["near_next"] == 1.0
    rows = [(None, "first. "), (2, "b. c."), (2, "b. c."), (2, "a."), (9, None)]
    assert fingerprint.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).count() == 5


def test_peeling_recovers_differences():
    a, b = fingerprint.digests(["one. two. three.", "x"]), fingerprint.digests(["one. two. four. five.", "x"])
    diff = fingerprint.sketched(2, *a).minus(fingerprint.sketched(2, *b))
    found, done = diff.peeled()
    assert done.all() and found.tolist() == [3, 0]


def test_stuck_sketches_grow():
    texts = ["\n".join(f"{s} {i}" for i in range(500)) for s in "ab"]
    a, b = (fingerprint.digests([t]) for t in texts)
    _, done = fingerprint.sketched(1, *a).minus(fingerprint.sketched(1, *b)).peeled()
    assert not done[0]
    assert np.allclose(fingerprint.likeness(1, a, b), 0)
