"""Main text of web pages by wrappers: union-free regular expressions inferred from pages of the same host.

A page becomes a stream of tags and texts, in which a run of equal neighbouring groups is one repeated group. Every page of
a host is learned from. Pages whose streams have the same form are merged place by place, before the shuffle and after it:
a slot keeps the texts that all of its pages have there, and whether texts differ. Then the forms of a host are aligned, one
after the other, by a longest common subsequence: equal tags match; texts that differ become text slots; what only one side
has becomes an optional group. Forms of over ``NODES`` tags and texts in all are aligned in parts (by the forms' hashes), and
then those parts with each other, so that a task's memory has a bound; a host of which even the aligned parts have more
keeps several expressions, each learned from all pages of its forms.

Every page is then matched against its host's expression, as a finite automaton: each text falls into a slot. What a slot
says decides: a text that the slot has on all of its pages, if several are different, is template and goes, in articles too; what
varies is the page's own, and so are the texts of repeated groups, as articles may share paragraphs. Pages that are near
copies of each other count as one page there, so that what copies have in common stays. Names of containers are a prior:
they tell the article from menus, adverts and comments, which vary too. Where a page departs from the expression, unknown
tags are passed over, and matching goes on at the next place that has the same containers; a text that has no slot is
judged by the slots of its containers, or else by their names.

On a page with an article or main element, texts within it count, else those outside; of the latter, only slots that vary,
if there are any. A page without html tags is one text. Elements that are hidden (``hidden``, ``aria-hidden``, ``display:
none``, ``visibility: hidden``) count as if they were not there; a whole page or article is never taken for hidden.

Blocks end at block tags and at line breaks; inline tags do not end a block. Character references are decoded, white space
in a block becomes one space, empty blocks go, and blocks are joined by a line feed.

Defined cases: a null html is the empty text; a null or odd url belongs to the host without a name; repeated rows are
kept, and count once in inference; of equally long alignments the one that keeps the first form's order wins, and forms come
by their hashes, so that rules do not depend on partitions; a page of any length is aligned and matched (alignments take
memory in proportion to the two streams); an empty table gives no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

import bisect
import functools
import html as entities
import itertools
import json
import re
import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.llm import common

#: Bytes of pages whose forms a task remembers before it passes them on.
REMEMBERED = 16_000_000
#: Tags and texts that one task aligns into an expression; where there are more, in 16 parts, or 256, and so on.
NODES = 16_384
#: Numbers of a page's sketch.
SKETCH = 24
#: Shares of a form's sketches.
SHARES = 64
#: The most neighbouring elements that make one repeated group.
GROUP = 4
#: Different pages that share a text of an article before it is template; outside of articles two are enough.
SHARED = 3
#: Bits of an alignment's table that are held at once.
TABLE = 1 << 26

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^\"'>]++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([A-Za-z][A-Za-z0-9:-]*)([^>]*)>", re.S)
NAMED = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
ATTRIBUTE = re.compile(r"""([^\s"'=<>/]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
# Element names by their role.
RAW = {"script", "style", "textarea", "title", "noscript", "template", "svg", "iframe", "xmp", "math"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Elements whose end tag may be left out.
OPEN = {"p", "li", "dt", "dd", "tr", "td", "th", "option", "thead", "tbody", "tfoot"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
CONTAINERS = {"html", "head", "body", "div", "section", "article", "main", "nav", "header", "footer", "aside", "form", "ul", "ol", "dl", "table", "figure", "details", "dialog", "menu", "fieldset", "select", "button", "center", "template"}
MAIN = ("article", "main")
BOILER_TAGS = {"head", "nav", "footer", "aside", "form", "dialog", "menu", "select", "button", "fieldset"}
BOILER_WORDS = {"ad", "ads", "advert", "advertisement", "adverts", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies", "disqus", "footer", "header", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "pagination", "popup", "promo", "promoted", "related", "respond", "share", "sharing", "sidebar", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget"}
WORD = re.compile("[a-z]+")


def host_of(url: str = "url") -> Column:
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


# --- pages as tokens ---


def label(name: str, attributes: str) -> str:
    """A container's name with its class, id and role words, sorted; digits do not count."""
    if name not in CONTAINERS or not attributes:
        return name
    words = {w for m in NAMED.finditer(attributes) for w in WORD.findall(m[2].lower())}
    return ".".join([name, *sorted(words)])


def hidden(attributes: str) -> bool:
    low = attributes.lower()
    if "hidden" not in low and "none" not in low:
        return False
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or "").strip("\"'")
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and UNSEEN.search(value)):
            return True
    return False


def all_tokens(page: str):
    """("<", label, hidden), (">", name, False) and ("#", text, False) of a page; comments and raw elements have no tokens."""
    at = 0
    while at < len(page):
        m = TAG.search(page, at)
        if m is None:
            yield "#", page[at:], False
            return
        if m.start() > at:
            yield "#", page[at : m.start()], False
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        name = name.lower()
        attributes = m[3] if m[3] is not None else m[6] or ""
        if m[1] or m[4]:
            yield ">", name, False
        elif name in RAW:
            end = re.compile(rf"</{re.escape(name)}\s*[^>]*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            yield "<", "br" if name in ("textarea", "title", "noscript", "template") else "wbr", False
        else:
            yield "<", label(name, attributes), name not in VOID and name not in ("html", "body", *MAIN) and hidden(attributes)


def end_of(found: list, at: int) -> int:
    """Where the element that begins at a token ends: the place after it; the place itself if it has no end."""
    name, depth = found[at][1].split(".", 1)[0], 0
    for i in range(at, len(found)):
        kind, what, _ = found[i]
        own = kind != "#" and what.split(".", 1)[0] == name
        if own and kind == "<":
            if depth and name in OPEN:
                return i
            depth += 1
        elif own:
            depth -= 1
            if not depth:
                return i + 1
        elif kind == ">" and name in OPEN and what in CONTAINERS:
            return i
    return at


def tokens(page: str) -> list[tuple[str, str]]:
    """The visible tokens of a page."""
    found, out, at = list(all_tokens(page)), [], 0
    while at < len(found):
        kind, what, unseen = found[at]
        end = end_of(found, at) if unseen else at
        if end > at:
            at = end
        else:
            out.append((kind, what))
            at += 1
    return out


class Piece(NamedTuple):
    """A text of a page: the labels of its containers, the number of its block, and its place in the page's stream (-1 for
    white space)."""

    path: str
    block: int
    linked: bool
    text: str
    at: int


def laid_out(page: str) -> tuple[list[str], list[Piece]]:
    """A page's stream (its tags with their containers, and "#" with its containers for a text), and its texts."""
    path: list[str] = []
    here, block, links = "", 0, False
    shapes: list[str] = []
    texts: list[Piece] = []
    for kind, what in tokens(page):
        if kind == "#":
            solid = not what.isspace()
            texts.append(Piece(here, block, links, what, len(shapes) if solid else -1))
            if solid:
                shapes.append(f"#\t{here}")
            continue
        name = what.split(".", 1)[0]
        if name == "a":
            links = kind == "<"
        if name in INLINE:
            if name == "a":
                shapes.append(f"{'<' if kind == '<' else '</'}a\t{here}")
            continue
        block, links = block + 1, False
        if kind == "<":
            shapes.append(f"<{what}\t{here}")
        if name in CONTAINERS:
            if kind == "<":
                path.append(what)
            else:
                for i in range(len(path) - 1, -1, -1):
                    if path[i].split(".", 1)[0] == name:
                        del path[i:]
                        break
            here = "/".join(path)
        if kind == ">":
            shapes.append(f"</{what}\t{here}")
    return shapes, texts


def hash_of(text: str) -> str:
    return xxhash.xxh32_hexdigest(" ".join(text.split()))


def sketch(texts: list[Piece]) -> list[int]:
    """The least hashes of a page's four-word shingles, one by each of ``SKETCH`` mixers: pages that share shingles share these."""
    words = " ".join(t.text for t in texts).split()
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    h = np.concatenate([h, np.zeros(max(0, 4 - len(words)), np.uint64)])
    with np.errstate(over="ignore"):
        for k in (1, 2):  # pairs of words, then pairs of pairs
            h = h[:-k] * np.uint64(0x9E3779B185EBCA87) + h[k:]
            h ^= h >> np.uint64(29)
        return [int((h * np.uint64(2 * k + 0x9E3779B97F4A7C15)).min() >> np.uint64(33)) for k in range(SKETCH)]


def stream(page: str) -> list[str]:
    """A page as strings: its sketch, then its tags, and its texts with their hashes and whether they are links."""
    shapes, texts = laid_out(page)
    out = list(shapes)
    for t in texts:
        if t.at >= 0:
            out[t.at] = f"{shapes[t.at]}\t{hash_of(t.text)}\t{int(t.linked)}"
    return [",".join(map(str, sketch(texts))), *out]


def boiler(path: str) -> bool:
    """Whether a container above is there for something else than main text. Class words above a main element do not count:
    they tell of the page ("no-sidebar")."""
    inside, above = False, in_main(path)
    for step in path.split("/"):
        name, *words = step.split(".")
        inside |= name in MAIN
        above &= not inside
        if name in BOILER_TAGS or (name == "header" and not inside):
            return True
        if name not in ("html", "body", *MAIN) and not above and not BOILER_WORDS.isdisjoint(words):
            return True
    return False


def in_main(path: str) -> bool:
    return any(step.split(".", 1)[0] in MAIN for step in path.split("/"))


# --- inference ---


class Slot(NamedTuple):
    """A text of the wrapper: the hashes that all its pages have there, whether texts differ, and its pages as bits (of their
    sketches)."""

    path: str
    hashes: frozenset[str]
    varies: bool
    linked: bool
    pages: int


class Group(NamedTuple):
    """"?" or "+" over nodes; a node is a tag, a Slot or a Group."""

    kind: str
    inner: list


def shape(node) -> str:
    """What a node must have in common with another to match it."""
    if isinstance(node, str):
        return node
    return f"#\t{node.path}" if isinstance(node, Slot) else f"{node.kind}({' '.join(map(shape, node.inner))})"


def merged(a, b, same_page: bool):
    """Two matching nodes as one. Of one page, a slot has all texts; of several, those that each of them has."""
    if isinstance(a, str):
        return a
    if isinstance(a, Slot):
        hashes = a.hashes | b.hashes if same_page else a.hashes & b.hashes
        return Slot(a.path, hashes, a.varies or b.varies or a.hashes != b.hashes, a.linked and b.linked, a.pages | b.pages)
    return Group(a.kind, [merged(x, y, same_page) for x, y in zip(a.inner, b.inner, strict=True)])


def element_ends(nodes: list) -> list[int]:
    """Of each place: the place after the element that begins there, or 0."""
    ends, open_ = [0] * len(nodes), []
    for i, n in enumerate(nodes):
        if isinstance(n, str) and n.startswith("</"):
            name = n[2:].split("\t")[0]
            for k in range(len(open_) - 1, -1, -1):
                if open_[k][1] == name:
                    ends[open_[k][0]] = i + 1
                    del open_[k:]
                    break
        elif isinstance(n, str):
            open_.append((i, n[1:].split("\t")[0].split(".", 1)[0]))
    return ends


def folded(nodes: list, known: set[str] = frozenset()) -> list:
    """Runs of equal neighbouring groups, of up to ``GROUP`` elements each, as one repeated group; groups that are known to
    repeat also when alone."""
    shapes, ends = [shape(n) for n in nodes], element_ends(nodes)
    out, at = [], 0
    while at < len(nodes):
        end, done = at, False
        for _ in range(GROUP):
            end = ends[end] if end < len(nodes) else 0
            if not end:
                break
            unit = shapes[at:end]
            size, last = end - at, end
            while shapes[last : last + size] == unit:
                last += size
            if last > end or f"+({' '.join(unit)})" in known:
                one = nodes[at:end]
                for k in range(end, last, size):
                    one = [merged(a, b, True) for a, b in zip(one, nodes[k : k + size], strict=True)]
                out.append(Group("+", one))
                at, done = last, True
                break
        if not done:
            out.append(nodes[at])
            at += 1
    return out


def rows_of(a: list[str], b: list[str], keep: bool) -> list[int]:
    """Of the longest common subsequences of a's prefixes with all prefixes of b: bits, zero where one more of b is matched.
    Each row is one sum of integers. All rows, or the last one."""
    places: dict[str, int] = {}
    for j, x in enumerate(b):
        places[x] = places.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    now, rows = full, []
    for x in a:
        up = now & places.get(x, 0)
        now = ((now + up) | (now - up)) & full
        if keep:
            rows.append(now)
    return rows if keep else [now]


def lengths(row: int, n: int) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(row.to_bytes((n + 7) // 8, "little"), np.uint8), bitorder="little")[:n]
    return np.concatenate([[0], np.cumsum(bits == 0)])


def matched(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places of a longest common subsequence. Tables over ``TABLE`` bits are halved, so that memory stays small."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    out = [(i, i) for i in range(head)]
    x, y = a[head : len(a) - tail], b[head : len(b) - tail]
    if len(x) > 1 and len(x) * len(y) > TABLE:
        half = len(x) // 2
        first = lengths(rows_of(x[:half], y, False)[0], len(y))
        second = lengths(rows_of(x[half:][::-1], y[::-1], False)[0], len(y))[::-1]
        cut = int(np.argmax(first + second))
        out += [(i + head, j + head) for i, j in matched(x[:half], y[:cut])]
        out += [(i + head + half, j + head + cut) for i, j in matched(x[half:], y[cut:])]
    elif x and y:
        rows, i, j, found = rows_of(x, y, True), len(x), len(y), []
        while i and j:
            if rows[i - 1] >> (j - 1) & 1:
                j -= 1
                continue
            i -= 1
            if not i or rows[i - 1] >> (j - 1) & 1:
                j -= 1
                found.append((i + head, j + head))
        out += reversed(found)
    return out + [(len(a) - k, len(b) - k) for k in range(tail, 0, -1)]


def aligned(wrapper: list, page: list) -> list:
    """The wrapper that also covers this page, or another wrapper: matches stay, what one side alone has becomes optional."""
    a, b = ([(n, isinstance(w, Group) and w.kind == "?") for w in side for n in (w.inner if isinstance(w, Group) and w.kind == "?" else [w])] for side in (wrapper, page))
    out: list = []

    def optional(nodes: list) -> None:
        if nodes and out and isinstance(out[-1], Group) and out[-1].kind == "?":
            out[-1].inner.extend(nodes)
        elif nodes:
            out.append(Group("?", list(nodes)))

    i = j = 0
    for x, y in [*matched([shape(n) for n, _ in a], [shape(n) for n, _ in b]), (len(a), len(b))]:
        optional([n for n, _ in a[i:x]])
        optional([n for n, _ in b[j:y]])
        if x < len(a):  # matched parts that are optional on either side stay so
            node = merged(a[x][0], b[y][0], False)
            optional([node]) if a[x][1] or b[y][1] else out.append(node)
        i, j = x + 1, y + 1
    return out


def repeated(nodes: list) -> set[str]:
    inner = (n for w in nodes for n in (w.inner if isinstance(w, Group) and w.kind == "?" else [w]))
    return {shape(n) for n in inner if isinstance(n, Group) and n.kind == "+"}


def nodes_of(tokens_: list[str], page: int) -> list:
    out = []
    for t in tokens_:
        kind, path, *rest = t.split("\t")
        out.append(Slot(path, frozenset(rest[:1]), False, rest[1] == "1", 1 << page) if kind == "#" else t)
    return out


def form(nodes: list) -> str:
    """What pages have in common that can be merged place by place, as a hash."""
    return xxhash.xxh3_128_hexdigest("\n".join(map(shape, nodes)))


def both(a: list, b: list) -> list:
    """Two pages, or sets of pages, of the same form."""
    return [merged(x, y, False) for x, y in zip(a, b, strict=True)]


def marked(nodes: list, pages) -> list:
    """Nodes whose slots have other bits for their pages, by a function of those they had."""
    out = []
    for n in nodes:
        if isinstance(n, Group):
            n = Group(n.kind, marked(n.inner, pages))
        out.append(n._replace(pages=pages(n.pages)) if isinstance(n, Slot) else n)
    return out


def refolded(nodes: list, known: set[str]) -> list:
    return folded([Group("?", folded(w.inner, known)) if isinstance(w, Group) and w.kind == "?" else w for w in nodes], known)


def widened(wrapper: list, nodes: list) -> list:
    """The wrapper that also covers pages of this form, or what another wrapper covers."""
    page = refolded(nodes, repeated(wrapper))
    new = repeated(page) - repeated(wrapper)
    return aligned(refolded(wrapper, new) if new else wrapper, page)


def packed(nodes: list, sketches=()) -> bytes:
    """Nodes and the sketches of their pages as packed JSON."""

    def plain(n):
        if isinstance(n, str):
            return n
        return [n.path, sorted(n.hashes), n.varies, n.linked, n.pages] if isinstance(n, Slot) else {n.kind: list(map(plain, n.inner))}

    return zlib.compress(json.dumps([list(map(plain, nodes)), list(sketches)]).encode(), 1)


def unpacked(blob: bytes) -> tuple[list, list]:
    def node(x):
        if isinstance(x, str):
            return x
        if isinstance(x, list):
            return Slot(x[0], frozenset(x[1]), *x[2:])
        ((kind, inner),) = x.items()
        return Group(kind, list(map(node, inner)))

    nodes, sketches = json.loads(zlib.decompress(blob))
    return list(map(node, nodes)), sketches


def written(nodes: list) -> str:
    """The expression as text: (...)+ repeats, (...)? is optional, # is a slot, #= one whose text is always the same."""
    each = []
    for n in nodes:
        if isinstance(n, str):
            each.append(n.split("\t")[0] + ">")
        else:
            each.append(("#" if n.varies else "#=") if isinstance(n, Slot) else f"({written(n.inner)}){n.kind}")
    return "".join(each)


def automaton(nodes: list) -> tuple[list, list[bool], list[int], list[list[int]]]:
    """The expression's tags and slots in order, whether each repeats, those it may begin with, and those that may follow each."""
    leaves: list = []
    repeats: list[bool] = []
    follow: list[list[int]] = []

    def linked(sources: list[int], targets: list[int]) -> None:
        for s in sources:
            follow[s].extend(t for t in targets if t not in follow[s])

    def built(seq: list, inside: bool) -> tuple[list[int], list[int], bool]:
        first, last, empty = [], [], True
        for n in seq:
            if isinstance(n, Group):
                f, l, e = built(n.inner, inside or n.kind == "+")
                if n.kind == "+":
                    linked(l, f)
                e |= n.kind == "?"
            else:
                leaves.append(n)
                repeats.append(inside)
                follow.append([])
                f = l = [len(leaves) - 1]
                e = False
            linked(last, f)
            first = first + f if empty else first
            last = last + l if e else l
            empty &= e
        return first, last, empty

    first, _, _ = built(nodes, False)
    return leaves, repeats, first, follow


def near(a: list[int], b: list[int]) -> bool:
    return 2 * sum(x == y for x, y in zip(a, b, strict=True)) >= SKETCH


def firsts(sketches) -> list[list[int]]:
    """The first sketches, ascending, of pages that are no near copies of those before: ``SHARED`` at most, as no more are asked for."""
    heads: list[list[int]] = []
    for s in sorted(sketches):
        if len(heads) < SHARED and not any(near(s, h) for h in heads):
            heads.append(s)
    return heads


def different(sketches) -> list[list[int]]:
    """``firsts`` of a form's pages, by shares that their sums tell, so that one form's pages can be in many tasks."""
    shares: dict[int, list] = {}
    for s in sketches:
        shares.setdefault(sum(s) % SHARES, []).append(s)
    return firsts(s for share in shares.values() for s in firsts(share))


def at_places(places: int, sketches: list) -> list:
    return [s for i, s in enumerate(sketches) if places >> i & 1]


def joined(parts) -> tuple[list, list]:
    """One wrapper of forms or of wrappers (nodes, and the sketches that their slots' bits tell), and its sketches; of those
    only the first different ones of each slot are kept."""
    wrapper: list | None = None
    sketches: list[list[int]] = []
    for nodes, own in parts:
        nodes = marked(nodes, lambda pages: pages << len(sketches))
        sketches = sketches + own
        wrapper = refolded(nodes, frozenset()) if wrapper is None else widened(wrapper, nodes)
    kept: dict[tuple, int] = {}
    few = functools.cache(lambda pages: sum(1 << kept.setdefault(tuple(s), len(kept)) for s in firsts(at_places(pages, sketches))))
    return marked(wrapper, few), list(map(list, kept))


def rule_of(wrapper: list, sketches: list) -> dict:
    """A wrapper as text and as an automaton, and what each slot says: whether its texts count on pages with a main element
    (1), on others (2), and which texts are template."""
    leaves, repeats, first, follow = automaton(wrapper)
    slots = [n for n in leaves if isinstance(n, Slot)]
    counts_of = functools.cache(lambda pages: len(firsts(at_places(pages, sketches))))
    seen = lambda n: counts_of(n.pages)
    plain = [n for n in slots if not in_main(n.path) and not boiler(n.path)]
    linked: dict[str, list[bool]] = {}
    for n in plain:
        linked.setdefault(n.path, []).append(n.linked)
    links = {p: 2 * sum(x) > len(x) for p, x in linked.items()}
    own = [n for n in plain if (n.varies or seen(n) < 2) and not links[n.path]] or plain
    kept = set(map(id, own))
    said = []
    for n, many in zip(leaves, repeats, strict=True):
        if isinstance(n, Slot):
            main = in_main(n.path)
            counts = not boiler(n.path) and (main or id(n) in kept)
            template = sorted(n.hashes) if n.hashes and counts and not many and seen(n) >= (SHARED if main else 2) and (main or n.varies) else []
            said.append([(1 if main else 2) * counts, template])
        else:
            said.append(None)
    return {"wrapper": written(wrapper), "shapes": [shape(n) for n in leaves], "first": first, "follow": follow, "said": said}


def of_form(nodes: list, sketches: list) -> tuple[list, list]:
    """A form for ``joined``: its slots are on all of its pages."""
    return marked(nodes, lambda _: (1 << len(sketches)) - 1), sketches


def read(tokens_: list[str]) -> tuple[str, list, list[int]]:
    """Of a page's stream: its form, its nodes and its sketch."""
    nodes = folded(nodes_of(tokens_[1:], 0))
    return form(nodes), nodes, list(map(int, tokens_[0].split(",")))


def rules(streams: list[list[str]]) -> dict:
    """A host's rule from the streams of all its pages: what ``wrappers`` does over tasks."""
    found: dict[str, tuple[list, list]] = {}
    for key, nodes, own in map(read, streams):
        before, sketches = found.get(key, (nodes, []))
        found[key] = both(before, nodes), [*sketches, own]
    return rule_of(*joined(of_form(nodes, different(sketches)) for _, (nodes, sketches) in sorted(found.items())))


# --- extraction ---


class Rule:
    """A wrapper that pages are matched against."""

    def __init__(self, got: dict):
        self.shapes, self.said = got["shapes"], [x and (x[0], frozenset(x[1])) for x in got["said"]]
        self.places: dict[str, list[int]] = {}
        for i, s in enumerate(self.shapes):
            self.places.setdefault(s, []).append(i)
        self.follow = [self.by_shape(f) for f in got["follow"]]
        self.first = self.by_shape(got["first"])
        #: What the slots of a container say together, for texts that no slot takes.
        self.paths: dict[str, int] = {}
        for s, x in zip(self.shapes, self.said, strict=True):
            if x:
                self.paths[s[2:]] = self.paths.get(s[2:], 0) | x[0]

    def by_shape(self, targets: list[int]) -> dict[str, list[int]]:
        out: dict[str, list[int]] = {}
        for t in targets:
            out.setdefault(self.shapes[t], []).append(t)
        return out

    def taken(self, shapes: list[str]) -> list[int]:
        """The place of the expression that takes each token; -1 for tokens that none takes."""
        steps: list[dict[int, int] | None] = []
        now: dict[int, int] = {-1: -1}
        for s in shapes:
            new: dict[int, int] = {}
            for at in now:
                for to in (self.follow[at] if at >= 0 else self.first).get(s, ()):
                    new.setdefault(to, at)
            if not new and s in self.places:  # the page departs: go on at the nearest place of this kind, one ahead if there is one
                at = next(iter(now))
                ahead = bisect.bisect_right(self.places[s], at)
                to = self.places[s][min(ahead, len(self.places[s]) - 1)]
                new = {to: at}
            steps.append(new or None)
            now = new or now
        out, at = [-1] * len(shapes), next(iter(now))
        for i in range(len(shapes) - 1, -1, -1):
            if steps[i] is not None:
                out[i], at = at, steps[i][at]
        return out


def main_text(page: str, rule: Rule) -> str:
    shapes, texts = laid_out(page)
    own = 1 if any(t.at >= 0 and in_main(t.path) and not boiler(t.path) for t in texts) else 2
    taken = rule.taken(shapes) if rule.shapes else [-1] * len(shapes)
    parts: dict[int, list[str]] = {}
    verdicts: dict[str, bool] = {}
    for t in texts:
        said = rule.said[taken[t.at]] if t.at >= 0 and taken[t.at] >= 0 else None
        if said:
            verdict = said[0] == own and not (said[1] and hash_of(t.text) in said[1])
        else:
            verdict = verdicts.get(t.path)
            if verdict is None:
                verdict = rule.paths[t.path] == own if t.path in rule.paths else not boiler(t.path) and in_main(t.path) == (own == 1)
                verdicts[t.path] = verdict
        if verdict:
            parts.setdefault(t.block, []).append(entities.unescape(t.text) if "&" in t.text else t.text)
    blocks = (" ".join("".join(p).split()) for p in parts.values())
    return "\n".join(b for b in blocks if b)


NO_RULE = json.dumps({"wrapper": "", "shapes": [], "first": [], "follow": [], "said": []})


@functools.lru_cache(64)
def parsed(rule: str | bytes) -> Rule:
    """A rule from its JSON, packed or not."""
    return Rule(json.loads(zlib.decompress(rule) if isinstance(rule, bytes) else rule))


PAGES = pa.schema([("host", pa.string()), ("page", pa.int64()), ("form", pa.string()), ("sketch", pa.list_(pa.int32())), ("size", pa.int32()), ("nodes", pa.binary())])
FORMS = pa.schema([("host", pa.string()), ("form", pa.string()), ("nodes", pa.binary())])
HEADS = pa.schema([("host", pa.string()), ("form", pa.string()), ("heads", pa.list_(pa.list_(pa.int32())))])
RULES = pa.schema([("host", pa.string()), ("part", pa.string()), ("size", pa.int32()), ("rule", pa.binary()), ("wrapper", pa.binary())])
PAGES_READ = "host string, page long, form string, sketch array<int>, size int, nodes binary"


def size_of(nodes: list) -> int:
    return sum(size_of(n.inner) if isinstance(n, Group) else 1 for n in nodes)


def grouped(batches, keys: int, *columns):
    """Runs of sorted rows that share their first columns."""
    rows = (row for lists in common.text_batches(batches, *columns) for row in zip(*lists, strict=True))
    return itertools.groupby(rows, lambda row: row[:keys])


def sent(schema: pa.Schema, rows):
    for some in itertools.batched(rows, 200):
        yield common.out_batch(schema, list(zip(*some, strict=True)))


def read_pages(pages: DataFrame) -> DataFrame:
    """One row for each page, with its form and sketch; and rows with the merged nodes of a form (``nodes``), from each task."""

    def run(batches):
        known: dict[tuple[str, str], list] = {}
        held = 0

        def passed():
            rows = [(host, None, key, None, size_of(nodes), packed(nodes)) for (host, key), nodes in known.items()]
            known.clear()
            return common.out_batch(PAGES, list(zip(*rows, strict=True)))

        for hosts, marks, bodies in common.text_batches(batches, "host", "page", "html"):
            keys, sketches = [], []
            for host, body in zip(hosts, bodies, strict=True):
                key, nodes, own = read(stream(body))
                keys.append(key)
                sketches.append(own)
                before = known.get((host, key))
                held += 0 if before else len(body)
                known[host, key] = both(before, nodes) if before else nodes
                if held > REMEMBERED:
                    yield passed()
                    held = 0
            none = [None] * len(keys)
            yield common.out_batch(PAGES, [hosts, marks, keys, sketches, none, none])
        if known:
            yield passed()

    return pages.select("host", F.xxhash64("html").alias("page"), "html").mapInArrow(run, PAGES_READ)


def heads_of(found: DataFrame) -> DataFrame:
    """(host, form, heads): ``firsts`` of each share of a form's sketches, equal ones first told once."""

    def heads(group):
        found: list[list[int]] = []
        for *_, own in group:  # ascending
            if len(found) < SHARED:
                found = firsts([*found, own])
        return found

    def run(batches):
        return sent(HEADS, ((*key[:2], heads(group)) for key, group in grouped(batches, 3, "host", "form", "share", "sketch")))

    own = found.where("nodes is null").select("host", "form", "sketch").distinct()
    own = own.withColumn("share", F.expr(f"aggregate(sketch, 0L, (x, y) -> x + y) % {SHARES}"))
    own = own.repartition("host", "form", "share").sortWithinPartitions("host", "form", "share", "sketch")
    few = own.mapInArrow(run, "host string, form string, heads array<array<int>>")
    return few.groupBy("host", "form").agg(F.flatten(F.collect_list("heads")).alias("heads"))


def parts_of(sizes: DataFrame) -> DataFrame:
    """(host, digits): how many hexadecimal digits of a form's hash tell its expression; none for hosts with one expression."""
    return sizes.groupBy("host").agg(F.sum("size").alias("size")).select("host", F.expr(f"cast(greatest(0, ceil(log(16, size / {NODES}))) as int)").alias("digits"))


def first_digits(column: str) -> Column:
    return F.expr(f"substring({column}, 1, digits)")


def rules_of(found: DataFrame, parts) -> DataFrame:
    """RULES of (host, part, key, ...): the rows of a part, in order of their keys, as one wrapper; ``parts`` reads a row."""

    def row(key, group):
        wrapper, sketches = joined(map(parts, group))
        whole = key[1] == ""
        return *key, size_of(wrapper), zlib.compress(json.dumps(rule_of(wrapper, sketches)).encode()), None if whole else packed(wrapper, sketches)

    def run(batches):
        return sent(RULES, (row(*x) for x in grouped(batches, 2, "host", "part", "nodes", "heads")))

    return found.repartition("host", "part").sortWithinPartitions("host", "part", "key").mapInArrow(run, "host string, part string, size int, rule binary, wrapper binary")


def wrappers(found: DataFrame) -> DataFrame:
    """(host, part, size, rule, wrapper) from all pages that ``read_pages`` found: each expression and what its slots say, as
    packed JSON; of hosts with many forms first one for each part of them."""

    def whole(batches):
        return sent(FORMS, ((*key, packed(functools.reduce(both, (unpacked(r[2])[0] for r in group)))) for key, group in grouped(batches, 2, "host", "form", "nodes")))

    some = found.where("nodes is not null").select("host", "form", "size", "nodes")
    forms = some.select("host", "form", "nodes").repartition("host", "form").sortWithinPartitions("host", "form").mapInArrow(whole, "host string, form string, nodes binary")
    forms = forms.join(heads_of(found), ["host", "form"]).join(parts_of(some.select("host", "form", "size").distinct()), "host")
    forms = forms.select("host", first_digits("form").alias("part"), F.col("form").alias("key"), "nodes", "heads")
    return rules_of(forms, lambda r: of_form(unpacked(r[2])[0], firsts(r[3])))


def rejoined(split: DataFrame) -> DataFrame:
    """The wrappers of hosts in parts as one for each host, or as few as ``NODES`` lets."""
    rows = split.join(parts_of(split), "host").select("host", first_digits("part").alias("part"), F.col("part").alias("key"), F.col("wrapper").alias("nodes"), F.lit(None).cast("int").alias("heads"))
    return rules_of(rows, lambda r: unpacked(r[2]))


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, the main text and its length of every page."""
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", common.text_or_empty("html").alias("html"), host_of().alias("host"))
    found = common.materialised(read_pages(own), "pages")
    learned = common.materialised(wrappers(found), "wrappers")
    split = learned.where("part <> ''")
    if split.isEmpty():
        with_rules = own.join(learned.select("host", "rule"), "host", "left")
    else:
        again = common.materialised(rejoined(split), "wrappers").unionByName(learned.where("part = ''")).select("host", "part", "rule")
        digits = parts_of(split).where("digits > 0")
        shares = found.where("nodes is null").join(digits, "host").groupBy("host", "page").agg(F.min(first_digits("form")).alias("part"))
        with_parts = own.withColumn("page", F.xxhash64("html")).join(shares, ["host", "page"], "left").withColumn("part", F.coalesce("part", F.lit("")))
        with_rules = with_parts.join(again, ["host", "part"], "left")

    def run(batches):
        for ids, urls, bodies, rule in common.text_batches(batches, "page_id", "url", "html", "rule"):
            text = [main_text(b, parsed(r or NO_RULE)) for b, r in zip(bodies, rule, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(urls, pa.string()), pa.array(text, pa.string()), pa.array(map(len, text), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return with_rules.select("page_id", "url", "html", "rule").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(common.table(spark, sf_dir, "pages"))
