"""The stage's result against a brute force over all pairs of shingle sets."""

import random

from cellweave.llm import near_copies
from tests.llm.test_simhash import groups, words_of


def shingle_set(text):
    w = words_of(text)
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def left(texts):
    sets = [shingle_set(t) for t in texts]
    label = groups(len(texts), lambda i, j: len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]))
    return {i for i in range(len(texts)) if label[i] == i}


def kept(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"] for r in near_copies.representatives(docs).collect()}


def said(rng, n):
    return ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n)]


def changed(rng, words, runs):
    """Each changed word, far from others, makes five shingles new."""
    out = list(words)
    for at in rng.sample(range(1, len(words) // 10), runs):
        out[at * 10] = "".join(said(rng, 2))
    return out


def test_repeats_do_not_count(spark):
    rng = random.Random(1)
    texts = []
    for times in range(2, 22):
        line, rest = said(rng, 10), said(rng, 100)
        texts += [" ".join(line + rest), " ".join(line * times + rest)]
    assert kept(spark, texts) == left(texts) == set(range(0, 40, 2))


def test_no_pair_at_the_limit_is_missed(spark):
    rng = random.Random(2)
    texts = []
    for _ in range(150):
        words = said(rng, 229)  # 225 shingles, of which five words change 25: 200 of 250 are common
        texts += [" ".join(words), " ".join(changed(rng, words, 5))]
    assert kept(spark, texts) == left(texts) == set(range(0, 300, 2))


def test_no_true_link_is_thinned_away(spark):
    rng = random.Random(3)
    texts = []
    for _ in range(80):  # b is not similar to a or c, which are similar
        b = said(rng, 229)
        a = changed(rng, b, 3) + said(rng, 16)
        c = changed(rng, a, 4)
        texts += [" ".join(a), " ".join(b), " ".join(c)]
    assert kept(spark, texts) == left(texts)


def test_rounds_test_every_pair_of_a_large_bucket(spark, monkeypatch):
    rng = random.Random(4)
    monkeypatch.setattr(near_copies, "ROUNDS", (1, 2, 5, 11, 1 << 40))
    base = said(rng, 120)
    texts = [" ".join(changed(rng, base, rng.randint(0, 4)) + said(rng, rng.randint(0, 12))) for _ in range(90)]
    assert kept(spark, texts) == left(texts)
