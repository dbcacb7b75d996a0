import json

from cellweave.llm import html_wrapper as h


def page(title, paragraphs, extra="", ad="Buy now"):
    body = "".join(f"<p>{p}</p>" for p in paragraphs)
    return f"<!DOCTYPE html><html><head><title>{title}</title><script>if (a<b) '</p>'</script></head><body><nav><ul><li><a href='/x'>Home</a></li><li><a href='/y'>News</a></li></ul></nav><div class='ad'>{ad}</div><article><h1>{title}</h1>{body}{extra}</article><footer>&copy; us</footer></body></html>"


def rules(*pages):
    return h.parsed(json.dumps(h.rules([h.stream(p) for p in pages])))


def test_wrapper_has_repeats_options_and_slots():
    got = h.rules([h.stream(page("A", ["one"])), h.stream(page("B", ["two", "three", "four"])), h.stream(page("C", ["five", "six"], "<ul><li>x</li><li>y</li></ul>"))])
    assert "(<p>#</p>)+" in got["wrapper"] and "<h1>#</h1>" in got["wrapper"]
    assert ")?" in got["wrapper"] and "(<li><a>#</a></li>)+" in got["wrapper"].replace("#=", "#")


def test_main_text_without_the_rest():
    extra = "<section class='comments'><p>First!</p></section><aside>See also</aside><form>Search <input></form>"
    p = page("T &amp; U", ["a  <b>bold</b>\n word", "x&nbsp;y&#233;", ""], extra)
    expected = "T & U\na bold word\nx yé"
    assert h.main_text(p, rules(p, page("V", ["q"]))) == expected
    assert h.main_text(p, h.parsed(h.NO_RULE)) == expected


def test_tag_soup_and_truncated_pages():
    p = "<body><article><h1>T</h1><p><b>one.<br><p>two</p><p>three <a href='a>b'>link</a> more"
    assert h.main_text(p, h.parsed(h.NO_RULE)) == "T\none.\ntwo\nthree link more"
    assert h.main_text("", h.parsed(h.NO_RULE)) == "" and h.main_text("just text", h.parsed(h.NO_RULE)) == "just text"
    assert h.main_text("<p>a<b", h.parsed(h.NO_RULE)) in ("a<b", "a")
    assert h.main_text("<script>never ends", h.parsed(h.NO_RULE)) == ""
    assert h.main_text("<p>x" + "<" * 20_000, h.parsed(h.NO_RULE)).startswith("x")


def test_hosts_without_articles_learn_slots():
    site = lambda text: f"<html><body><div class='top'>The Daily Site</div><div class='content'><p>{text}</p><p>More of {text}</p></div><div class='end'>All rights reserved</div></body></html>"
    rule = rules(site("alpha"), site("beta"), site("gamma"))
    assert h.main_text(site("delta"), rule) == "delta\nMore of delta"


def test_query_over_tables(spark):
    rows = [(i, f"http://{'a' if i % 3 else 'b'}.example.com/{i}", page(f"T{i}", [f"p{i}", "q"] * (i % 4)), "r") for i in range(40)]
    rows += [(100, None, "<article><p>no host</p></article>", "r"), (101, "http://c/", None, "r"), (102, "odd", "", "r"), (1, rows[1][1], rows[1][2], "r")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, rule string")
    got = {}
    for r in h.extracted(pages).collect():
        got.setdefault(r["page_id"], []).append(r)
    assert sum(map(len, got.values())) == len(rows)
    for page_id, url, html, _ in rows:
        r = got[page_id][0]
        assert r["url"] == url and r["n_chars"] == len(r["text"])
        if page_id < 100:
            assert r["text"] == "\n".join([f"T{page_id}"] + [f"p{page_id}", "q"] * (page_id % 4))
    assert [got[i][0]["text"] for i in (100, 101, 102)] == ["no host", "", ""]
    assert h.extracted(pages.limit(0)).count() == 0
