"""Against a brute force over all alignments, which knows nothing of seeds."""

import itertools
import random

from cellweave.llm import decontaminate as dc


def accepted(h, b):
    need = min(len(b), dc.NEED)
    for g in range(-len(b), len(h) + 1):
        a = [0 <= i + g < len(h) and h[i + g] == b[i] for i in range(len(b))]
        if any(5 * sum(a[s : s + need]) >= 4 * need for s in range(len(b) - need + 1)):
            return True
    return False


def test_every_offset_and_all_substitutions(spark):
    rng = random.Random(5)
    items, docs = [], []
    for n in (9, 10, 11, 12, 13, 15, 18):
        item = [f"i{n}w{k}" for k in range(n)]
        items.append(item)
        gone = [(), *itertools.combinations(range(n), 1), *itertools.combinations(range(n), 2), *(rng.sample(range(n), 3) for _ in range(60))]
        for k, some in enumerate(gone):
            w = [f"x{rng.randrange(50)}" if i in some else x for i, x in enumerate(item)]
            docs.append(["before"] * (9 + k % 4) + w + ["after"] * 9)
    table = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(docs)], "doc_id long, text string")
    tests = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    got = {r["doc_id"] for r in dc.judged(table, tests).where("__n > 0").collect()}
    assert got == {i for i, w in enumerate(docs) if any(accepted(w, b) for b in items)}


def test_masks_leave_nothing_that_is_accepted():
    for n, most in [(dc.SPAN, 1), *((n, 2) for n in range(dc.SPAN + 1, dc.NEED + 1))]:
        for gone in itertools.combinations(range(n), most):
            assert any(not {s + x for x in m} & set(gone) for s in range(n - dc.SPAN + 1) for m in dc.MASKS)


def test_texts_with_many_alignments_and_items(spark, monkeypatch):
    monkeypatch.setattr(dc, "STRETCH", 7)
    monkeypatch.setattr(dc, "GROUPS", 3)
    rng = random.Random(6)
    items = [[f"i{k}w{j % 3}" for j in range(rng.randint(9, 20))] for k in range(30)]  # they repeat themselves
    items += [[f"j{k}w{j}" for j in range(rng.randint(5, 20))] for k in range(30)]
    whole = [w for item in items for w in [*item, "between"]]
    docs = [whole, whole, items[3] * 40, ["x"] * 50, items[40][:4], []]
    table = spark.createDataFrame([(i % 5, " ".join(w)) for i, w in enumerate(docs)], "doc_id long, text string")
    tests = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    got = sorted((r["doc_id"], len(r["text"]), r["__n"]) for r in dc.judged(table, tests).collect())
    assert got == sorted((i % 5, len(" ".join(w)), sum(accepted(w, b) for b in items)) for i, w in enumerate(docs))
