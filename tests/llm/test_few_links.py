"""Few links and few pairs take few jobs, whatever the number of partitions; many take the same result."""

import random
import uuid

import pytest

from cellweave.llm import near_copies, simhash
from tests.llm.test_near_copies import changed, kept, left, said


def jobs_of(spark, run):
    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, group)
    try:
        out = run()
        return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def links_of(spark, edges, parts):
    return spark.createDataFrame(edges, "a long, b long").repartition(parts)


def test_few_links_settle_without_rounds(spark):
    ids = random.Random(1).sample(range(-(10**6), 10**6), 500)
    edges = links_of(spark, list(zip(ids[:-1], ids[1:], strict=True)), 7)
    got, jobs = jobs_of(spark, lambda: simhash.components(edges).collect())
    assert {(r["id"], r["component"]) for r in got} == {(x, min(ids)) for x in ids if x != min(ids)} and len(got) == 499
    assert jobs <= 10


@pytest.mark.parametrize("most", [3, 40, 50_000])
def test_components_of_one_and_of_many_partitions(spark, monkeypatch, most):
    rng = random.Random(most)
    monkeypatch.setattr(simhash, "LINKS", most)
    ids = [rng.randint(-(2**63), 2**63 - 1) for _ in range(200)]
    edges = [(rng.choice(ids), rng.choice(ids)) for _ in range(130)]
    edges += [(b, a) for a, b in edges[:20]] + edges[:20] + [(ids[0], ids[0])]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    got = simhash.components(links_of(spark, edges, 5)).collect()
    assert {(r["id"], r["component"]) for r in got if r["id"] != r["component"]} == {(x, root(x)) for x in list(up) if root(x) != x}
    assert len({r["id"] for r in got}) == len(got)


def test_no_links(spark):
    assert simhash.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("few", [0, 10_000])
def test_few_and_many_pairs_are_verified_alike(spark, monkeypatch, few):
    rng = random.Random(5)
    monkeypatch.setattr(near_copies, "FEW", few)
    monkeypatch.setattr(near_copies, "SOME", 7)
    base, texts = said(rng, 150), ["", "one two"]
    for _ in range(40):
        texts += [" ".join(changed(rng, base, rng.randint(0, 5))), " ".join(said(rng, 60))]
    texts += texts[:9]
    assert kept(spark, texts) == left(texts)
