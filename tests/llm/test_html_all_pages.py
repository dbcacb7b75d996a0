"""Expressions are learned from all pages of a host, whatever their number and partitions."""

import json
import random
import zlib

from pyspark.sql import functions as F

from cellweave.llm import html_wrapper as h

WORDS = "river stone cloud garden winter paper silver mountain letter window morning yellow bridge candle forest".split()


def said(rng, n=30):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(n))


def site(rng, k):
    """A page and its own text. Of 200 pages, 5 say what another template adds, and 6 are not in the usual section."""
    section = f"Section {k % 3}" if k % 37 == 5 else "Section of news"
    added = "<div class='z'>Printed with permission</div>" if k % 41 == 7 else ""
    own = [said(rng) for _ in range(1 + k % 3)]
    body = "".join(f"<p>{p}</p>" for p in own)
    return f"<html><body><article><div class='x'>Follow us everywhere</div><h1>Title {k}</h1><div class='s'>{section}</div>{body}{added}{'<hr>' * (k % 11)}</article></body></html>", [f"Title {k}", section, *own]


def table(spark, rows, parts):
    return spark.createDataFrame([(i, f"http://{host}/{i}", html) for i, (host, html) in enumerate(rows)], "page_id long, url string, html string").repartition(parts, F.hash("page_id"))


def hosts(n=200):
    rng = random.Random(11)
    return [("one.example.com", *site(rng, k)) for k in range(n)]


def test_rare_templates_and_rare_texts_of_a_slot_count(spark):
    rows = hosts()
    got = {r["page_id"]: r["text"] for r in h.extracted(table(spark, [r[:2] for r in rows], 5)).collect()}
    assert got == {i: "\n".join(own) for i, (_, _, own) in enumerate(rows)}


def found(spark, rows, parts):
    return h.wrappers(h.read_pages(table(spark, rows, parts).select("html", h.host_of().alias("host"))))


def learned(spark, rows, parts):
    return {(r["host"], r["part"]): json.loads(zlib.decompress(r["rule"])) for r in found(spark, rows, parts).collect()}


def test_rules_do_not_depend_on_partitions(spark, monkeypatch):
    rng = random.Random(12)
    rows = [r[:2] for r in hosts(60)]
    copy = said(rng, 60)
    for k in range(30):  # chains of near copies
        words = copy.split()
        words[k : k + 2 * k] = said(rng, 2 * k).split()
        rows.append(("copies", f"<article><div class='lead'>Lead</div><p>{' '.join(words)}</p>{'<hr>' * (k % 3)}</article>"))
    plain = {(host, ""): json.loads(json.dumps(h.rules([h.stream(p) for x, p in rows if x == host]))) for host in {x for x, _ in rows}}
    assert learned(spark, rows, 1) == plain
    monkeypatch.setattr(h, "REMEMBERED", 3000)
    assert learned(spark, rows[::-1], 7) == plain


def test_parts_of_a_host_with_many_forms_become_one_expression(spark, monkeypatch):
    rows = [r[:2] for r in hosts()]
    monkeypatch.setattr(h, "NODES", 600)
    first = found(spark, rows, 3)
    assert first.where("part <> ''").count() > 8
    assert [r["part"] for r in h.rejoined(first).collect()] == [""]
    test_rare_templates_and_rare_texts_of_a_slot_count(spark)


def test_hosts_that_fit_no_expression_have_several(spark, monkeypatch):
    rows = hosts()
    monkeypatch.setattr(h, "NODES", 60)
    pages = table(spark, [r[:2] for r in rows] + [("two", "<article><p>alone</p></article>")], 5)
    got = [(r["page_id"], r["text"]) for r in h.extracted(pages).collect()]
    assert len(got) == 201 and dict(got)[200] == "alone"
    for i, text in got:
        assert i == 200 or set(rows[i][2]) - {"Section of news"} <= set(text.split("\n"))


def test_sketches_of_short_pages_and_likeness():
    assert len(h.sketch([])) == h.SKETCH == len(h.sketch([h.Piece("", 0, False, "one two", 0)]))
    assert h.near([1] * h.SKETCH, [1] * 12 + [2] * 12) and not h.near([1] * h.SKETCH, [1] * 11 + [2] * 13)
