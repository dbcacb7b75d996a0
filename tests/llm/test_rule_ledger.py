"""The rule ledger against plain counts, its SQL, and the given labels."""

import glob
import os
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave.llm import rule_ledger as R

DATA = "/root/testdata/sf0.001"


def plain(text):
    words = re.findall("[^\x20\x09-\x0d]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    times, inside = Counter(windows), set()
    for i, w in enumerate(windows):
        if times[w] > 1:
            inside |= set(range(i, i + 5))
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside), len(lines), text.count("!"))


def texts():
    r = random.Random(5)
    out = ["", " ", "\n\n", "a", "\x1c x\x85y z \x00", "a b c d e " * 2, "a b c d e f", "x\n x\nx\n\n\nx ", "é　ü|<>!!! #", "a b c d e f a b c d e"]
    return out + ["".join(r.choice(["a", "b", "ab", " ", " ", "\n", "!", "|", "\t"]) for _ in range(r.randrange(300))) for _ in range(200)]


def test_measures_equal_plain_counts():
    for t in texts():
        assert R.measured(t) == plain(t), t


def test_blocks_and_wide_vocabularies(monkeypatch):
    monkeypatch.setattr(R, "BLOCK", 7)
    for t in texts():
        assert R.measured(t) == plain(t)
    ids = np.arange(40_000) % 20_000  # 20,000 ** 5 is beyond 63 bits
    assert R.repeated_words(ids, 20_000) == 40_000
    assert R.repeated_words(np.arange(40_000), 40_000) == 0


def test_very_long_text():
    text = " ".join(f"w{i}" for i in range(400_000)) + " w1 w2 w3 w4 w5"
    got = dict(zip(R.MEASURES, R.measured(text), strict=True))
    assert got["n_words"] == 400_005 and got["n_repeat_words"] == 10


def odd(spark):
    rows = [(1, None, "x"), (None, "a b", "y"), (2, "", "z"), (2, "", "z"), (3, "word " * 30, "w"), (4, " ".join(f"word{i}" for i in range(20)), "w"), (5, " ".join(f"word{i} ||" for i in range(20)), "v")]
    return spark.createDataFrame(rows, "doc_id long, text string, n_words string").withColumn("failed", F.lit("clash"))


def test_ledger_of_odd_rows(spark):
    got = R.verdicts(R.ledger(odd(spark)), R.POLICIES[R.CURRENT]).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == 7 and not by[1]["kept"] and by[1]["failed"] & 1 and by[None]["n_words"] == 2
    assert by[3]["failed"] == R.mask_of("repeated_windows", "short_words") & by[3]["failed"] and by[4]["kept"] and by[4]["failed"] == 0
    assert by[5]["failed"] == R.mask_of("symbols") and not by[5]["kept"]
    assert R.ledger(odd(spark).limit(0)).count() == 0


def test_versions_read_the_same_ledger(spark):
    entries = R.ledger(odd(spark))
    kept = {v: {r["doc_id"] for r in R.verdicts(entries, p).where("kept").collect()} for v, p in R.POLICIES.items()}
    assert kept == {1: {4, 5}, 2: {4}, 3: {4}}


def test_soft_rules_may_fail_once(spark):
    masks = spark.createDataFrame([(0,), (8,), (24,), (4,), (12,)], "failed long")
    assert [r["kept"] for r in R.verdicts(masks, R.POLICIES[3]).collect()] == [True, True, False, False, False]


def test_ablations_equal_row_by_row(spark):
    rng = random.Random(3)
    masks = [rng.randrange(128) if rng.random() < 0.5 else 1 << rng.randrange(7) for _ in range(500)] + [0] * 50
    entries = spark.createDataFrame([(m, i % 9) for i, m in enumerate(masks)], "failed long, n_words long")
    got = {(r["version"], r["rule"]): r for r in R.ablations(entries, list(R.POLICIES.values())).collect()}

    def keeps(p, m):
        return not m & p.never and bin(m & p.sometimes).count("1") <= p.most

    for p in R.POLICIES.values():
        for r in R.RULES:
            if not (p.never | p.sometimes) & r.mask:
                assert (p.version, r.name) not in got
                continue
            only = [i for i, m in enumerate(masks) if not keeps(p, m) and keeps(p, m & ~r.mask)]
            x = got[p.version, r.name]
            want = (550, sum(keeps(p, m) for m in masks), sum(bool(m & r.mask) for m in masks), len(only), sum(i % 9 for i in only))
            assert (x["documents"], x["kept"], x["failing"], x["only_here"], x["words_only_here"]) == want


def test_failing_by_group(spark):
    rows = spark.createDataFrame([("a", 3), ("a", 1), ("b", 0)], "source string, failed long")
    got = {r["source"]: (r["documents"], r["some_fail"], r["all_fail"]) for r in R.failing_by(rows, ["source"]).collect()}
    assert got == {"a": (2, 3, 1), "b": (1, 0, 0)}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
def test_query_equals_sql_and_labels(spark):
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    df = R.op12_rule_ledger(spark, DATA)
    found = c.execute(R.oracle_sql())
    names = [x[0] for x in found.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(tuple(r) for r in df.select(*names).collect()) == sorted(found.fetchall())
    good = spark.read.parquet(f"{DATA}/labels.parquet").where("quality = 1").select("doc_id").distinct()
    own = df.join(good, "doc_id").where("not base_failed")
    assert own.where("kept").count() >= 0.99 * own.count()
    bad = df.join(spark.read.parquet(f"{DATA}/labels.parquet").where("quality = 0").select("doc_id").distinct(), "doc_id")
    assert bad.where("not kept").count() >= 0.9 * bad.count()
