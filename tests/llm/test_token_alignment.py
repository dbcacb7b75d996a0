"""Alignment of two tokenizers against a plain walk over bytes, and corpus-wide counts against plain sets."""

import hashlib
import os
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave.llm import common
from cellweave.llm import token_alignment as T

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tokenizers():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(common.vocabulary_path(T.FIRST))
    a.encode_special_tokens = True
    letters = {}
    spare = 256
    for byte in range(256):
        if 33 <= byte <= 126 or 161 <= byte <= 172 or 174 <= byte:
            letters[chr(byte)] = byte
        else:
            letters[chr(spare)] = byte
            spare += 1
    return a, sentencepiece.SentencePieceProcessor(model_file=common.vocabulary_path(T.SECOND)), letters


def tokens(text, tokenizers):
    """Both tokenizers' (id, bytes), by the libraries alone; empty where they do not give back the text."""
    a, b, letters = tokenizers
    if not text:
        return [], []
    want = (" " + text).encode()
    one = [(i, bytes(letters[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    two = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
    if b"".join(x for _, x in one) != want or b"".join(x for _, x in two) != want:
        return [], []
    return one, two


def groups(one, two):
    out, a, b, at, bt = [], [], [], 0, 0
    one, two = list(one), list(two)
    while one or two:
        if at <= bt:
            i, x = one.pop(0)
            a.append(i)
            at += len(x)
        else:
            i, x = two.pop(0)
            b.append(i)
            bt += len(x)
        if at == bt and a and b:
            out.append((a, b))
            a, b = [], []
    assert not a and not b
    return out


def plain(rows, tokenizers):
    """rows: (doc_id, text). All result rows."""
    cut = {t: groups(*tokens(t, tokenizers)) for t in {t or "" for _, t in rows}}
    held = Counter()
    for _, t in rows:
        held.update({(x, y) for a, b in cut[t or ""] for x in a for y in b})
    most = defaultdict(int)
    for (x, _), n in held.items():
        most[x] = max(most[x], n)
    out = []
    for i, t in rows:
        g = cut[t or ""]
        links = [(x, y) for a, b in g for x in a for y in b]
        line = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        sha = hashlib.sha256(line.encode()).hexdigest() if g else ""
        out.append((i, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), len(links), sum(held[p] == most[p[0]] for p in links), sum(held[p] for p in links), sha))
    return sorted(out, key=repr)


def odd_texts():
    r = random.Random(9)
    out = ["", " ", "  two  spaces\t\n\n x", "a", "\x00\x01", "<|endoftext|> and <s> </s> <unk>", "▁ under", "né à la carte 日本語 🙂🙂🇫🇷", "ﬁ ligature x́", "\r\n", "0x0A <0x0A>", "aaaa" * 300, "日" * 50]
    alphabet = ["the ", "tion", "é", "ß", " ", "\n", "🙂", "1234", "ing", "日本", "!!", "\t", "ξ"]
    return out + ["".join(r.choice(alphabet) for _ in range(r.randrange(60))) for _ in range(60)]


def result(df):
    return sorted((tuple(r) for r in df.select("doc_id", *T.MEASURES, "n_best", "count_sum", "groups_sha256").collect()), key=repr)


def test_alignment_equals_plain_walk(spark, tokenizers, monkeypatch):
    monkeypatch.setattr(T, "BLOCK", 500)
    monkeypatch.setattr(T, "LINKS", 40)
    texts = odd_texts()
    rows = [(i if i % 7 else None, t) for i, t in enumerate(texts)] + [(1000 + i, texts[3 + i % 9]) for i in range(30)] + [(5, None), (5, None), (6, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n": F.lit("clash"), "KEY": F.lit(1), "digest": F.lit(0), "copies": F.lit(-3)})
    assert result(T.alignment(df)) == plain(rows, tokenizers)


def test_empty_table(spark):
    assert T.alignment(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert result(T.alignment(spark.createDataFrame([(1, None), (2, "▁")], "doc_id long, text string"))) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_pairs_of_large_groups_by_distinct_ids(monkeypatch):
    rng = np.random.default_rng(1)
    m, k = rng.integers(1, 6, 50), rng.integers(1, 6, 50)
    m[20], k[20] = 90, 70
    a, b = rng.integers(0, 9, m.sum()), rng.integers(0, 7, k.sum())
    want, i, j = Counter(), 0, 0
    for x, y in zip(m, k, strict=True):
        want.update(int(p * 7 + q) for p in a[i : i + x] for q in b[j : j + y])
        i, j = i + x, j + y
    for links in (1, 10, 100, 1 << 20):
        monkeypatch.setattr(T, "LINKS", links)
        keys, times = T.pair_counts(a, b, m, k, 7)
        assert dict(zip(keys.tolist(), times.tolist(), strict=True)) == want


def test_packed_numbers_come_back():
    x = np.array([0, 1, 255, 256, 70_000, 2**32 - 1])
    assert (T.unpacked(T.packed(x)) == x).all() and len(T.unpacked(T.packed(x[:0]))) == 0


def test_very_long_text(tokenizers):
    text = "the cat sat on été " * 60_000
    got = T.aligned(text, T.aligner(*(common.vocabulary_path(x) for x in (T.FIRST, T.SECOND))))
    one, two = tokens(text[: 19 * 50], tokenizers)
    assert got[0][0] > 1000 * len(one) and got[0][1] > 1000 * len(two) and got[3].sum() == got[0][3]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
def test_query_equals_plain_walk_over_the_table(spark, tokenizers):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    assert result(T.op13_token_alignment(spark, DATA)) == plain(rows, tokenizers)
