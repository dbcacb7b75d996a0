import zlib

import numpy as np

from cellweave.llm import common, token_files


def expected(rows, end=2):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(common.vocabulary_path("byte_bpe_50k.json"))
    out, at = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, end]
        out.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_files_hold_the_ids(spark):
    odd = ["", None, "Hello  world's  3½ tests\n\n\tx²", "日本語 text Привет", "<|endoftext|> inside", "a" * 3000, "it's I'll we've", " nbsp  ", "é́ combining", "\U0001f600 smile", "mixed123abc!!!???"]
    rows = [(100 - 3 * i, t) for i, t in enumerate(odd)] + [(None, "no id"), (7, "twice"), (7, "twice"), (7, "again")]
    docs = spark.createDataFrame([(*r, "z", 1) for r in rows], "doc_id long, text string, part string, base int")
    out = common.fresh_folder(spark, "t")
    got = token_files.read_token_files(token_files.write_token_files(docs, out, partitions=3), out)
    assert sorted(map(tuple, got.collect()), key=lambda r: r[1]) == expected(rows)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    out = common.fresh_folder(spark, "t")
    assert token_files.read_token_files(token_files.write_token_files(docs, out), out).count() == 0


def test_files_with_other_settings_are_encoded_by_the_library():
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        enc = token_files.Encoder(common.vocabulary_path(name), "I")
        assert enc.by_words == (name == "byte_bpe_50k.json")
        for text in ("Hello World  again's 12", "", "Ünï\n x"):
            assert np.frombuffer(enc.encode(text), "<u4").tolist() == enc.tokenizer.encode(text, add_special_tokens=False).ids
