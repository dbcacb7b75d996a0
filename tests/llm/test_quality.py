import random
import zlib

import numpy as np
import pyarrow as pa

from cellweave.llm import quality


def test_statistics_equal_a_plain_count():
    texts = ["", "Hello, world! Hello", "a a a b\nb C|d", "é ñ 123 ###", " x ", "\n", "word"]
    got = quality.of_texts(pa.array(texts))
    for row, text in zip(got, texts, strict=True):
        raw, words = text.encode(), text.split()
        sizes = [len(w.encode()) for w in words]
        assert np.isclose(row[0], np.log1p(len(words)))
        assert np.isclose(row[1], np.log1p(np.mean(sizes) if sizes else 0))
        again = sum(a == b for a, b in zip(words, words[1:]))
        assert np.isclose(row[10], np.log((again + 1) / (len(words) + 20)))
        assert np.isclose(row[11], np.log1p(len(set(words))) / max(np.log1p(len(words)), 0.5))
        upper, letters = sum(65 <= b <= 90 for b in raw), sum(chr(b).isalpha() and b < 128 or b >= 128 for b in raw)
        assert np.isclose(row[3], np.log((upper + 1) / (letters + 20)))


def test_blocks_do_not_matter(monkeypatch):
    texts = pa.array(["some words here"] * 5 + [None, "", "X" * 500] + ["other | text !!"] * 4)
    whole = quality.of_texts(texts)
    monkeypatch.setattr(quality, "BLOCK", 40)
    assert np.allclose(whole, quality.of_texts(texts)) and np.allclose(whole[3:], quality.of_texts(texts[3:]))


def test_long_texts_are_counted_in_pieces(monkeypatch):
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab  \n|!É") for _ in range(rng.randint(30, 400))) for _ in range(60)] + ["w" * 333, "w" * 333 + " " + "w" * 333, " " * 100, "ab " * 90 + "ab"]
    whole = quality.of_texts(pa.array(texts))
    for size in (7, 16, 64):
        monkeypatch.setattr(quality, "BLOCK", size)
        assert np.allclose(whole, quality.of_texts(pa.array(texts)))


def test_scores_equal_a_plain_discriminant(spark):
    docs, labels = tables(spark, 300)
    rows = quality.features(docs).join(labels, "doc_id").toPandas()
    x, y = np.array(rows["x"].tolist()), rows["quality"].to_numpy()
    known = np.array([zlib.crc32(str(i).encode()) % 3 != 1 for i in rows["doc_id"]])
    own = {k: np.cov(x[known & (y == k)].T, bias=True) for k in (0, 1)}
    share = {k: (known & (y == k)).sum() / known.sum() for k in (0, 1)}
    pooled = sum(share[k] * own[k] for k in own)
    logs = {}
    for k in own:
        cov = (1 - quality.TO_POOLED - quality.TO_DIAGONAL) * own[k] + quality.TO_POOLED * pooled + quality.TO_DIAGONAL * np.diag(np.diag(pooled)) + 1e-6 * np.eye(len(pooled))
        d = x - x[known & (y == k)].mean(axis=0)
        logs[k] = np.log(share[k]) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d)
    diff = logs[1] - logs[0]
    feats = quality.features(docs)
    got = quality.scored(feats, quality.fitted(feats, labels)).toPandas().set_index("doc_id")["score"][rows["doc_id"]]
    assert np.allclose(got, 0.5 + 0.5 * diff / (1 + np.abs(diff)), atol=1e-6)


def auc(score, label):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    pos = label == 1
    return (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


def tables(spark, n=600):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(n):
        words = ["".join(rng.choice("abcdefghi") for _ in range(rng.randint(1, 8))) for _ in range(rng.randint(5, 80))]
        bad = i % 5 == 0
        if bad:
            words = rng.choice([[w.upper() + "!!" for w in words], [w + " |" for w in words], [w for w in words for _ in range(6)], [w + "###" for w in words]])
        rows.append((i, " ".join(words), "en", "s"))
        labels.append((i, int(not bad), 0))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark):
    docs, labels = tables(spark)
    feats = quality.features(docs)
    got = quality.scored(feats, quality.fitted(feats, labels)).join(labels, "doc_id").toPandas()
    assert (got["held_out"] == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got["doc_id"]]).all()
    test = got[got["held_out"]]
    assert auc(test["score"].to_numpy(), test["quality"].to_numpy()) > 0.98
    assert (test["predicted"] == test["quality"]).mean() > 0.95
    assert ((got["score"] >= 0.5) == (got["predicted"] == 1)).all() and got["score"].between(0, 1).all()


def test_held_out_labels_do_not_matter(spark):
    docs, labels = tables(spark, 200)
    feats = quality.features(docs)
    turned = labels.withColumn("quality", quality.F.when(quality.held_out(), 1 - quality.F.col("quality")).otherwise(quality.F.col("quality")))
    a, b = (quality.fitted(feats, x) for x in (labels, turned))
    assert all(np.allclose(a.parts[k][0], b.parts[k][0]) for k in (0, 1))


def test_odd_tables(spark):
    docs = spark.createDataFrame([(None, None), (1, ""), (1, "words"), (2, "x" * 100_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 0)], "doc_id long, quality int")
    feats = quality.features(docs)
    got = quality.scored(feats, quality.fitted(feats, labels)).collect()
    assert [r["score"] for r in got] == [0.5] * 4 and [r["predicted"] for r in got] == [1] * 4
    assert not any(r["held_out"] for r in got if r["doc_id"] is None)
    assert quality.scored(quality.features(docs.limit(0)), quality.Model({})).count() == 0


def test_accepted_keeps_columns(spark):
    docs, labels = tables(spark, 300)
    kept = quality.accepted(docs, quality.fitted(quality.features(docs), labels))
    assert kept.schema == docs.schema
    ids = {r["doc_id"] for r in kept.collect()}
    assert sum(i % 5 > 0 for i in ids) > 0.97 * 240 and sum(i % 5 == 0 for i in ids) < 6
