import random
import re

from cellweave.llm import decontaminate as dc


def words_of(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def brute(docs, items):
    """Per document, how many different items have a verified alignment that seeds can meet."""
    tests = {tuple(w) for w in map(words_of, items) if len(w) >= dc.SHORTEST}
    out = []
    for doc_id, text in docs:
        h, n = words_of(text), 0
        for b in tests:
            need = min(len(b), dc.NEED)
            met = set()
            if len(b) >= dc.SPAN:
                for p in range(len(h) - dc.SPAN + 1):
                    for q in range(len(b) - dc.SPAN + 1):
                        if any(all(h[p + x] == b[q + x] for x in m) for m in dc.MASKS):
                            met.add(p - q)
            else:
                met = {p for p in range(len(h) - len(b) + 1) if tuple(h[p : p + len(b)]) == b}
            least = need if len(b) < dc.SPAN else -(-need * 4 // 5)
            good = False
            for g in met:
                a = [0 <= i + g < len(h) and h[i + g] == b[i] for i in range(len(b))]
                good |= any(sum(a[s : s + need]) >= least for s in range(len(b) - need + 1))
            n += good
        out.append((doc_id, n))
    return out


def test_equals_brute_force_and_finds_substitutions(spark):
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 4))) for _ in range(60)]
    said = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [said(n) for n in (4, 5, 7, 9, 16, 20, 30, 16)]
    items[-1] = list(items[4])
    docs = []
    for i in range(120):
        w = said(rng.randint(0, 50))
        if i % 2:
            part = list(rng.choice(items))
            for _ in range(rng.randint(0, 2)):
                part[rng.randrange(len(part))] = "zzz"
            w[len(w) // 2 : len(w) // 2] = part
        docs.append((i, " ".join(w).title() if i % 3 else ", ".join(w)))
    docs += [(900, None), (None, " ".join(items[5])), (900, "")]
    table = spark.createDataFrame([(*d, 1, "k") for d in docs], "doc_id long, text string, hits int, key string")
    tests = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)] + [(99, None), (100, "")], "item_id long, text string")
    got = dc.judged(table.select("doc_id", "text"), tests).select("doc_id", "__n").collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute(docs, [" ".join(w) for w in items]), key=str)
    clean = dc.clean_documents(table, tests)
    assert clean.columns == ["doc_id", "text", "hits", "key"] and clean.count() == sum(n == 0 for _, n in brute(docs, [" ".join(w) for w in items]))


def test_any_single_substitution_is_found(spark):
    item = [f"w{i}" for i in range(16)]
    docs = []
    for at in range(16):
        for shift in range(1):
            w = list(item)
            w[at] = "other"
            docs.append((at * 10 + shift, " ".join([f"x{i}" for i in range(shift)] + w + ["y"] * 5)))
    got = dc.judged(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(0, " ".join(item))], "item_id long, text string"))
    assert got.where("__n = 1").count() == len(docs)


def test_join_without_broadcast_and_empty_tables(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "one two three four five six seven eight nine ten"), (2, "nothing")], "doc_id long, text string")
    tests = spark.createDataFrame([(0, "One two three; four five six seven eight nine, ten!")], "item_id long, text string")
    monkeypatch.setattr(dc, "BROADCAST_KEYS", 0)
    assert sorted((r["doc_id"], r["__n"]) for r in dc.judged(docs, tests).collect()) == [(1, 1), (2, 0)]
    assert dc.judged(docs, tests.limit(0)).where("__n > 0").count() == 0
    assert dc.judged(docs.limit(0), tests).count() == 0
