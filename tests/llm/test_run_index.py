import hashlib
import random

import numpy as np
import pytest

from cellweave.llm import run_index


def brute(rows, length=run_index.LENGTH):
    """rows: (doc_id, text). Per distinct row, in order: n_bytes, n_removed, n_spans, sha256 of what is left."""
    order = sorted(set((d, t or "") for d, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    seen, out = set(), {}
    for doc_id, text in order:
        raw = text.encode()
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - length + 1):
            w = raw[i : i + length]
            if w in seen:
                gone[i : i + length] = True
            seen.add(w)
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        left = bytes(b for b, g in zip(raw, gone) if not g)
        out[doc_id, text] = (len(raw), int(gone.sum()), spans, hashlib.sha256(left).hexdigest())
    return [(d, *out[d, t or ""]) for d, t in rows]


def result(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = run_index.removed(docs, keep_text=False).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    return sorted(map(tuple, got.collect()), key=str)


@pytest.mark.parametrize("seed", range(12))
def test_index_finds_later_windows(seed):
    rng = random.Random(seed)
    length, letters = rng.choice([4, 7, 12]), rng.choice(["ab", "abc", "abcdefgh"])
    strings = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 80))).encode() for _ in range(9)]
    strings += [strings[0] * 3, b"a" * 60, strings[2]]
    seen, expected, at = set(), [], 0
    for s in strings:
        for i in range(len(s) - length + 1):
            if s[i : i + length] in seen:
                expected.append(at + i)
            seen.add(s[i : i + length])
        at += len(s) + 1
    index = run_index.RunLengthIndex(strings)
    assert index.later_windows(length).tolist() == expected
    assert index.runs < len(index.text)


def test_removal_equals_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 9))) for _ in range(300)]
    said = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passages = [said(n) for n in (25, 40, 60, 14)]
    rows = []
    for i in range(120):
        parts = [said(rng.randint(0, 40))] + [p for p in passages if rng.random() < 0.3] + [said(rng.randint(0, 20))]
        rows.append((i * 3, "\n".join(parts)))
    rows += [(1000 + i, rows[i][1]) for i in range(0, 60, 7)]  # copies
    for i in range(20):  # near copies
        text = rows[i][1].split(" ")
        if len(text) > 3:
            text[rng.randrange(len(text))] = "changed"
        rows.append((2000 + i, " ".join(text)))
    rows += [(3000, "xy " * 400), (3001, "xy " * 300), (3002, ""), (3003, None), (3004, "é" * 300), (3005, rows[0][1] * 3)]
    assert result(spark, rows) == sorted(brute(rows), key=str)
    rows += [(4000 + i, said(3) + " ab cd" * (60 + i) + said(2)) for i in range(8)]  # periodic, in many kinds
    assert result(spark, rows) == sorted(brute(rows), key=str)
    monkeypatch.setattr(run_index, "MOST", 2)  # common anchors are dealt by window
    assert result(spark, rows) == sorted(brute(rows), key=str)


def test_null_and_repeated_ids(spark):
    text = "the quick brown fox " * 3 + "jumps over a lazy dog and runs away from all of it, as it always does " * 2
    rows = [(None, text), (7, text), (7, text), (7, text + "!"), (1, "short"), (None, None)]
    assert result(spark, rows) == sorted(brute(rows), key=str)


def test_empty_table_and_extra_columns(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, ord string, marks int, anchor string")
    assert run_index.removed(docs).count() == 0
    docs = spark.createDataFrame([(1, "a" * 250, "x", 1, "y")], "doc_id long, text string, ord string, marks int, anchor string")
    got = run_index.removed(docs).collect()[0]
    assert (got["n_bytes"], got["n_removed"], got["n_spans"], got["kept"]) == (250, 249, 1, "a")


def test_batches_of_any_size(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        rng = random.Random(8)
        base = ["".join(rng.choice("abcdefgh ") for _ in range(400)) for _ in range(4)]
        rows = [(i, base[i % 4][rng.randint(0, 90) :] + rng.choice(base)) for i in range(40)]
        assert result(spark, rows) == sorted(brute(rows), key=str)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("most", [5, 40, 1000])
def test_familiar_kinds_have_an_earlier_row(monkeypatch, most):
    """What a task calls known was met before at a smaller place; a kind in every block is sent once if it is remembered."""
    monkeypatch.setattr(run_index, "FAMILIAR", most)
    rng, familiar, least, sent = np.random.default_rng(most), run_index.Familiar(), {}, 0
    for block in range(30):
        kinds = np.append(rng.choice(500, 20, replace=False), 500)
        order = np.where(kinds == 500, block, rng.integers(0, 100, 21))
        start = rng.integers(0, 50, 21).astype(np.int32)
        again = familiar.known(kinds.astype(np.uint64) // np.uint64(7), kinds.astype(np.uint64) * np.uint64(2**55 + 1), order, start)
        for k, o, s, g in zip(kinds.tolist(), order.tolist(), start.tolist(), again.tolist()):
            assert not g or least[k] < (o, s)
            least[k] = min(least.get(k, (o, s)), (o, s))
        sent += not again[-1]
    assert sent == 1 or most < 20


@pytest.mark.parametrize("period", [1, 7, 30, 60, 68])
def test_windows_that_come_again_in_a_short_fragment(spark, period):
    """A text of its own that repeats itself over fewer windows than an anchor has places."""
    rng = random.Random(period)
    said = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    rows = [(i, said(i % 3 * 60) + (said(period) * 200)[: 101 + period + i] + said(i % 2 * 80)) for i in range(20)]
    assert sum(r[2] > 0 for r in brute(rows)) == 20
    assert result(spark, rows) == sorted(brute(rows), key=str)
