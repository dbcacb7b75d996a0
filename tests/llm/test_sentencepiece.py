import random

import numpy as np
import pytest

from cellweave.llm import common, sentencepiece_scan as sp

PATH = common.vocabulary_path("piece_bpe_32k.model")


def brute(voc, text):
    """One pass over the whole text, no parts, no chunks."""
    s = voc.marked(text)
    best, last = [0.0] + [sp.NONE] * len(s), {}
    for at in range(len(s)):
        for to, score, piece in voc.steps(s, at):
            if best[at] + score > best[to]:
                best[to], last[to] = best[at] + score, (at, piece)
    return voc.back(s, last, len(s))[1]


def texts():
    rng = random.Random(2)
    words = ["the", "thhation", "inger", "éré", "queeaux", "of", "und", "ñandú", "Zukeitpf", "日本", "a\nb", "x  y", "###", "aaaaaaaa"]
    return [" ".join(rng.choice(words) for _ in range(n)) for n in (0, 1, 2, 17, 60, 300)] + ["", " ", "   lead", "tail  ", "\n\n", "▁mark", "a" * 200, "\U0001f600 é", "no" * 90, "日本語" * 40]


def test_whole_texts_equal_brute_force():
    voc = sp.Vocabulary(PATH)
    for text, got in zip(texts(), voc.encode(texts()), strict=True):
        assert np.frombuffer(got, "<i4").tolist() == brute(voc, text)
        assert voc.decode(np.frombuffer(got, "<i4").tolist()) == text.replace("▁", " ") or text.startswith(("▁", " "))


def test_no_segmentation_of_the_librarys_lattice_scores_more():
    from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

    m = sentencepiece_model_pb2.ModelProto()
    m.ParseFromString(open(PATH, "rb").read())
    m.trainer_spec.model_type = 1
    library, voc = SentencePieceProcessor(model_proto=m.SerializeToString()), sp.Vocabulary(PATH)
    for text in ["Hello world of words", "reticulated thhations", "élan vital queeauxment", "a", "the herest hesten"]:
        ids = np.frombuffer(voc.encode([text])[0], "<i4").tolist()
        score = sum(map(library.get_score, ids))
        assert score == max(sum(map(library.get_score, x)) for x in library.nbest_encode_as_ids(text, 50))


@pytest.mark.parametrize("chunk", [17, 40, 97])
def test_chunks_equal_brute_force(spark, chunk):
    voc = sp.Vocabulary(PATH)
    rows = list(enumerate(texts())) + [(50, None), (51, texts()[5]), (None, texts()[4])]
    docs = spark.createDataFrame([(*r, "s", 0) for r in rows], "doc_id long, text string, sha string, c int")
    got = sp.encoded(docs, chunk=chunk).collect()
    assert len(got) == len(rows)
    by_id = {r["doc_id"]: r for r in got}
    for doc_id, text in rows:
        assert by_id[doc_id]["ids"] == brute(voc, text or ""), (chunk, text)
        assert by_id[doc_id]["n_pieces"] == len(by_id[doc_id]["ids"])
        assert by_id[doc_id]["exact"] == ("▁" not in (text or ""))


def test_products_are_associative():
    rng = np.random.default_rng(1)
    a, b, c = (rng.integers(-9, 9, (4, 4)).astype(float) for _ in range(3))
    assert (sp.product(sp.product(a, b), c) == sp.product(a, sp.product(b, c))).all()
    assert (sp.product(sp.product(a[0], b), c) == sp.product(a, sp.product(b, c))[0]).all()


def test_decoding_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a tale of Ünïcode \U0001f600\n"), (2, "")], "doc_id long, text string")
    assert sorted(map(tuple, sp.decoded(sp.encoded(docs)).collect())) == [(1, "a tale of Ünïcode \U0001f600\n"), (2, "")]
    assert sp.encoded(docs.limit(0)).count() == 0
