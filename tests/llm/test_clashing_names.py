"""Columns of the user with names that operators use inside."""

from cellweave.llm import decontaminate, near_copies, pii, quality

NAMES = ["k1", "k2", "n", "h", "key", "item", "hits", "windows", "near", "places", "node", "own_id", "id", "__gone", "__node", "text_hash", "attempts", "__n", "__key", "n_items", "X", "entity", "kind", "label", "size"]


def table(spark):
    rows = [(1, "one two three four five six seven eight nine ten"), (2, "Mrs Ann Lee met Mr Lee"), (3, None), (None, "other words here"), (4, "one two three four five six seven eight nine ten"), (4, "one two three four five six seven eight nine ten")]
    return spark.createDataFrame([(*r, *(f"{n}-{i}" for n in NAMES)) for i, r in enumerate(rows)], "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in NAMES))


def kept(docs, got):
    assert got.columns == docs.columns
    own = {r[2]: r for r in docs.collect()}
    rows = got.collect()
    assert all(tuple(r)[2:] == tuple(own[r[2]])[2:] for r in rows)
    return rows


def test_other_columns_stay(spark, monkeypatch):
    docs = table(spark)
    tests = spark.createDataFrame([(0, "one two three four five six seven eight nine ten")], "item_id long, text string")
    assert len(kept(docs, decontaminate.clean_documents(docs, tests))) == 3
    assert len(kept(docs, near_copies.representatives(docs))) == 4
    assert len(kept(docs, near_copies.representatives(docs.where("doc_id < 4")))) == 3
    assert len(kept(docs, quality.accepted(docs, quality.Model({})))) == 6
    assert len(kept(docs, pii.pseudonymised(docs, "key"))) == 6
    monkeypatch.setattr(pii, "CLOSURE_ROWS", -1)
    assert len(kept(docs, pii.pseudonymised(docs, "key"))) == 6
    try:
        pii.pseudonymised(docs, "key", count="x")
    except ValueError:
        pass
    else:
        raise AssertionError("a count of a name that is there")
