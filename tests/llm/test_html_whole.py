import json

from cellweave.llm import html_wrapper as h


def rules(*pages):
    return h.parsed(json.dumps(h.rules([h.stream(p) for p in pages])))


def test_pages_that_are_copies_keep_their_text():
    p = "<html><body><nav>Home</nav><div class='content'><p>The only paragraph.</p></div></body></html>"
    assert h.main_text(p, rules(p, p, p)) == "The only paragraph."


def test_pages_without_article_on_a_host_that_has_some():
    site = lambda t: f"<html><body><nav>Home</nav><div class='top'>Daily</div><div class='content'><p>{t}</p></div></body></html>"
    article = "<html><body><nav>Home</nav><article><h1>T</h1><p>in it</p></article></body></html>"
    rule = rules(site("one"), site("two"), article)
    assert h.main_text(site("three"), rule) == "three"
    assert h.main_text("<body><div class='other'><p>unknown place</p></div></body>", rule) == "unknown place"
    assert h.main_text(article, rule) == "T\nin it"


def test_class_words_above_an_article_do_not_empty_it():
    for words in ("page no-sidebar", "has-header"):
        p = f"<html><body><div class='{words}'><article><p>kept</p><div class='related'>not</div></article><div class='sidebar'>nor</div></div></body></html>"
        assert h.main_text(p, rules(p)) == "kept" == h.main_text(p, h.parsed(h.NO_RULE))
