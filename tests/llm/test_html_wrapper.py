"""The wrapper decides: pages on which names alone are not enough, and the parts that inference and matching are made of."""

import json
import random

from cellweave.llm import html_wrapper as h

WORDS = "river stone cloud garden winter paper silver mountain letter window morning yellow bridge candle forest".split()


def said(rng, n=30):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(n))


def rules(pages):
    return h.parsed(json.dumps(h.rules([h.stream(p) for p in pages])))


def without(page):
    return h.main_text(page, h.parsed(h.NO_RULE))


def test_template_text_within_articles_goes():
    rng = random.Random(1)

    def page(k):
        own = [said(rng) for _ in range(1 + k % 3)]
        body = "".join(f"<p>{p}</p>" for p in own)
        return f"<html><body><article><div class='x'>Follow us everywhere</div><h1>Title {k}</h1>{body}<div class='y'><p>All rights reserved by us.</p></div></article></body></html>", [f"Title {k}", *own]

    pages = [page(k) for k in range(8)]
    rule = rules([p for p, _ in pages])
    for p, own in [*pages, page(50), page(51)]:
        assert h.main_text(p, rule) == "\n".join(own)
        assert without(p) != "\n".join(own)
    odd = pages[0][0].replace("Follow us everywhere", "A text of its own")
    assert h.main_text(odd, rule).startswith("A text of its own\n")


def test_template_text_on_hosts_without_articles_goes():
    rng = random.Random(2)
    page = lambda own: f"<html><body><div class='top'>The Daily Site</div><div class='content'><p>{own}</p></div><div class='end'>Imprint and more</div></body></html>"
    texts = [said(rng) for _ in range(9)]
    rule = rules([page(t) for t in texts[:8]])
    assert [h.main_text(page(t), rule) for t in texts] == texts
    assert without(page(texts[0])) != texts[0]


def test_shared_paragraphs_and_near_copies_stay():
    rng = random.Random(3)
    shared = said(rng)
    page = lambda ps: "<html><body><article>" + "".join(f"<p>{p}</p>" for p in ps) + "</article></body></html>"
    several = [[said(rng), shared, said(rng)] for _ in range(8)]
    rule = rules([page(p) for p in several])
    assert all(h.main_text(page(p), rule) == "\n".join(p) for p in several)
    head = lambda k, t: f"<html><body><article><h1>{t}</h1><div class='lead'>{shared}</div><p>{several[0][0]} {k}</p></article></body></html>"
    copies = [head(k, "One title") for k in range(8)]
    rule = rules(copies)
    assert all(h.main_text(p, rule) == without(p) for p in copies)


def test_pages_that_depart_from_the_wrapper_keep_their_text():
    rng = random.Random(4)
    page = lambda own, more="": f"<html><body><nav>Menu</nav><article><h1>{own[:9]}</h1><p>{own}</p>{more}</article><footer>End</footer></body></html>"
    rule = rules([page(said(rng)) for _ in range(8)])
    own = said(rng)
    other = "<section><table><tr><td>cell</td></tr></table></section><blockquote>said</blockquote><p>after</p>"
    assert h.main_text(page(own, other), rule) == f"{own[:9]}\n{own}\ncell\nsaid\nafter"
    assert h.main_text("<main><p>only</p></main>", rule) == "only" and h.main_text("", rule) == ""


def test_hidden_elements_go():
    p = "<article><p>a</p><p hidden>b<p>c</p><div style='color:red; display : none'><div>d</div><p>e</p></div><span aria-hidden=true>f</span>g<i class='hidden'>h</i><div hidden>never ends<p>i</p></article>"
    assert without(p) == "a\nc\ngh\nnever ends\ni"
    assert without("<body style='visibility:hidden'><article hidden><p>all</p></article></body>") == "all"


def length(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_alignment_is_a_longest_common_subsequence(monkeypatch):
    rng = random.Random(5)
    for bits in (1 << 26, 20):
        monkeypatch.setattr(h, "TABLE", bits)
        for _ in range(300):
            a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 14))] for _ in range(2))
            got = h.matched(a, b)
            assert len(got) == length(a, b) and all(a[i] == b[j] for i, j in got)
            assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(got, got[1:]))


def test_sampled_pages_match_their_own_expression_and_long_pages_work():
    rng = random.Random(6)

    def some(depth=0):
        kinds = [f"<p>{said(rng, 3)}</p>", f"<li>{said(rng, 2)}</li>", f"<div class='{rng.choice('abc')}'>" + (some(depth + 1) if depth < 3 else "x") + "</div>", f"<h2>{said(rng, 2)}</h2>"]
        return "".join(rng.choice(kinds) for _ in range(rng.randint(1, 6)))

    for _ in range(20):
        pages = [f"<html><body><article>{some()}</article></body></html>" for _ in range(6)]
        rule = rules(pages)
        for p in pages:
            assert -1 not in rule.taken(h.laid_out(p)[0])
            assert h.main_text(p, rule).replace("\n", "") in without(p).replace("\n", "") or h.main_text(p, rule)
    giants = ["<html><body><article>" + "".join(f"<p>{said(rng, 2)}</p>" + "<hr>" * rng.randint(0, 2) for _ in range(3000)) + "</article></body></html>" for _ in range(3)]
    rule = rules(giants)
    assert all(h.main_text(p, rule) == without(p) for p in giants)
