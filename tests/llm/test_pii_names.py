import re
import time
import timeit

from cellweave.llm import pii

KEY = b"k" * 32


def test_more_surnames_than_the_lists_give_stay_distinct(spark):
    word = lambda i: "".join("abcdefghij"[int(c)] for c in f"{i:05d}")
    rows = [(f"name_s_{script}", f"{first}{word(i)}") for script, first in (("latin", "Q"), ("cyrillic", "Щ")) for i in range(20_000)]
    own = spark.createDataFrame(rows, pii.ENTITY)
    later = {(r["kind"], r["entity"]): r["attempt"] for r in pii.attempts(own, KEY).collect()}
    new = {(k, pii.surrogate(k, e, KEY, later.get((k, e), 0))) for k, e in rows}
    assert len(new) == len(rows)
    assert all(re.fullmatch(pii.NAME, name) for _, name in new)


def given(spark, rows, *more):
    """What each entity gets."""
    own = spark.createDataFrame(rows, pii.ENTITY)
    later = {(r["kind"], r["entity"]): r["other"] if r["other"] is not None else r["attempt"] for r in pii.attempts(own, KEY, *more).collect()}
    return {(k, e): x if isinstance(x := later.get((k, e), 0), str) else pii.surrogate(k, e, KEY, x) for k, e in rows}


def test_entities_of_a_full_format_take_each_others_places(spark):
    rows = [("email", f"{c}@example.com") for c in "abcdefghijklmnopqrstuvwxyz"] + [("email", "ab@example.com"), ("secret", "------"), ("secret", "abc123")]
    new = given(spark, rows)
    assert len(set(new.values())) == len(rows)
    full = {e for k, e in rows if len(e) == len("a@example.com")}
    assert {new["email", e] for e in full} == full and all(new["email", e] != e for e in full)
    assert new["email", "ab@example.com"] not in {e for _, e in rows} and re.fullmatch("[a-z]{3}[0-9]{3}", new["secret", "abc123"])
    assert new["secret", "------"] == "------"


def test_one_that_is_stuck_alone_changes_places_with_another(spark):
    own = spark.createDataFrame([("email", f"{c}@example.com") for c in "ab"], pii.ENTITY)
    got = {r["entity"]: r["other"] for r in pii.in_turn(own, own.where("entity like 'a%'"), KEY).collect()}
    assert got == {"a@example.com": "b@example.com", "b@example.com": "a@example.com"}


def test_all_addresses_of_a_private_range(spark):
    rows = [("ip", f"192.168.{i >> 8}.{i & 255}") for i in range(1 << 16)] + [("ip", f"10.0.0.{i}") for i in range(256)]
    began = time.time()
    new = given(spark, rows)
    assert time.time() - began < 120
    assert len(set(new.values())) == len(rows) and all(a != b for (_, a), b in new.items())
    assert all(pii.ip_range(pii.ip_number(a)) == pii.ip_range(pii.ip_number(b)) for (_, a), b in new.items())


def test_no_kind_is_slow():
    """Every range of addresses, and one of each other kind."""
    some = [("ip", a) for a in ("192.168.1.1", "169.254.1.1", "172.16.4.4", "10.1.2.3", "127.0.0.1", "0.0.0.1", "224.0.0.1", "255.255.255.255", "8.8.8.8")]
    some += [("email", "ann.lee@mail.example.com"), ("phone", "+1 415 555 0132"), ("card", "4111 1111 1111 1111"), ("iban", "DE89 3704 0044 0532 0130 00"), ("ssn", "123-45-6789"), ("ssn", "000-45-6789"), ("mac", "00:1a:2b:3c:4d:5e")]
    for kind, entity in some:
        best = min(timeit.repeat(lambda k=kind, e=entity: pii.surrogate(k, e, KEY), number=20, repeat=5)) / 20
        assert best < 2e-3, (kind, entity, best)


def test_ranges_keep_to_themselves():
    for k, (low, bits) in enumerate(pii.RANGES, 1):
        for n in (low, low + (1 << bits) - 1, low + (1 << bits) // 3):
            address = ".".join(map(str, n.to_bytes(4, "big")))
            assert pii.ip_range(n) == k == pii.ip_range(pii.ip_number(pii.surrogate("ip", address, KEY)))
    assert pii.ip_range(pii.ip_number(pii.surrogate("ip", "8.8.8.8", KEY))) == 0


def test_without_a_key_each_run_draws_its_own(spark):
    assert pii.key_of(spark) != pii.key_of(spark)
    spark.conf.set("spark.cellweave.surrogates.key", "of this test")
    try:
        assert pii.key_of(spark) == "of this test"
    finally:
        spark.conf.unset("spark.cellweave.surrogates.key")


def test_later_mentions_and_one_gender():
    new, n = pii.replaced("Lee side. Mrs Ann Lee came; Dr Ann Lee said no. Ann left, and Lee's dog. Leeward.", KEY, {}, {})
    m = re.fullmatch(r"Lee side\. Mrs (\S+) (\S+) came; Dr (\S+) (\S+) said no\. (\S+) left, and (\S+)'s dog\. Leeward\.", new)
    assert n == 6 and m[1] == m[3] == m[5] != "Ann" and m[2] == m[4] == m[6] != "Lee"
