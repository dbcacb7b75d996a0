"""Surrogates for personal data: detected entities get keyed replacements of their own type and format.

Digits and letters of an entity pass through a keyed permutation of all strings of that format (a Feistel network over
mixed radices), so different entities get different surrogates and equal ones equal surrogates, in every document:

* e-mail addresses keep their shape, top-level domain and reserved example domains;
* phone numbers keep country code, punctuation, a fictional 555 exchange and leading digits' validity;
* IPv4 addresses stay in their range (private, loopback, link-local, multicast or public);
* IPv6 addresses keep their first group, hardware addresses their first byte, and both their notation;
* card numbers keep their issuer's digit and whether their Luhn check holds; IBANs keep country and valid check digits;
* social security numbers keep their format and whether they are valid;
* secrets (access keys, tokens with a known prefix, passwords, private keys in text armour) keep prefix, length and
  character classes;
* persons after a form of address get names of the same gender and script; surnames and given names are replaced one by
  one, so that "Mrs Ann Lee" and "Mrs Lee" stay the same person, and later mentions in the same text without a form of
  address are replaced too. A given name after "Dr" has the gender that another form of address in the text gives it.

Collision checks run over all distinct entities of the corpus: a surrogate that is another entity of the corpus, or that
a second entity has, is drawn again with the next attempt number until there is none; where real entities nearly fill a
format, they take each other's places (``attempts``). Names come from lists first; from
the third attempt on they have a second part, one syllable longer with each attempt, so that no number of names is too many.

Defined cases: a null text stays null and has no entities; an empty table gives no rows; other columns are kept as they
are; equal rows are treated alike. Matches never overlap: the leftmost, then the first kind in ``KINDS``, wins.
"""

from __future__ import annotations

import hashlib
import re
import secrets

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellweave.llm import common

# Forms of address by gender, and names by gender and script.
ADDRESS = {
    "f": ["Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mme", "Señora", "Sra", "Doña", "г-жа", "госпожа"],
    "m": ["Mr", "Sir", "Herr", "Monsieur", "M", "Señor", "Sr", "Don", "г-н", "господин"],
    "u": ["Dr", "Prof", "Professor"],
}
GIVEN = {
    ("f", "latin"): ["Alice", "Beatrice", "Carla", "Diana", "Elena", "Fiona", "Greta", "Hannah", "Irene", "Julia", "Karin", "Laura", "Maria", "Nora", "Olivia", "Paula", "Rosa", "Sophie", "Teresa", "Vera"],
    ("m", "latin"): ["Adrian", "Bruno", "Carl", "David", "Erik", "Felix", "Gregor", "Hugo", "Ivan", "Jonas", "Klaus", "Leon", "Martin", "Nils", "Oscar", "Peter", "Robert", "Simon", "Thomas", "Victor"],
    ("u", "latin"): ["Alex", "Andrea", "Billie", "Casey", "Chris", "Dominique", "Jamie", "Jordan", "Kim", "Morgan", "Pat", "Robin", "Sam", "Sasha", "Taylor"],
    ("f", "cyrillic"): ["Анна", "Вера", "Дарья", "Елена", "Ирина", "Мария", "Нина", "Ольга", "Софья", "Юлия"],
    ("m", "cyrillic"): ["Антон", "Борис", "Виктор", "Денис", "Иван", "Максим", "Олег", "Павел", "Роман", "Юрий"],
    ("u", "cyrillic"): ["Женя", "Саша", "Слава", "Валя"],
}
SURNAMES = {
    "latin": ["Abbott", "Baker", "Carver", "Dalton", "Ellis", "Fischer", "Garner", "Hansen", "Iverson", "Jensen", "Keller", "Lambert", "Moreno", "Novak", "Olsen", "Parker", "Quinn", "Romero", "Schmitt", "Turner", "Ulrich", "Vargas", "Weber", "Young", "Zimmer"],
    "cyrillic": ["Белов", "Волков", "Громов", "Жуков", "Зайцев", "Комаров", "Лебедев", "Морозов", "Орлов", "Соколов"],
}
SYLLABLES = {
    "latin": [c + v for c in "bdfgklmnprstvz" for v in "aeiou"],
    "cyrillic": [c + v for c in "бвгдзклмнпрст" for v in "аеиоу"],
}
#: What tokens of well-known services begin with; the last one begins signed tokens.
PREFIXES = ["ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "glpat-", "xoxa-", "xoxb-", "xoxp-", "xoxr-", "xoxs-", "sk_live_", "sk_test_", "sk-", "AIza", "npm_", "hf_", "eyJ"]
TITLES = {t: g for g, ts in ADDRESS.items() for t in ts}
NAME = r"[A-ZÀ-ÖØ-ÞА-ЯЁ][a-zß-öø-ÿа-яё]+(?:['-][A-ZÀ-ÖØ-ÞА-ЯЁ][a-zß-öø-ÿа-яё]+)?"
#: Kind: (what a text must hold to be searched, pattern; the group "x", if there is one, is what gets replaced).
KINDS: dict[str, tuple[str, str]] = {
    "privatekey": ("PRIVATE KEY", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----(?P<x>[A-Za-z0-9+/=\s]{16,})-----END (?:[A-Z]+ )*PRIVATE KEY-----"),
    "token": ("", rf"(?<![A-Za-z0-9_-])(?:{'|'.join(map(re.escape, PREFIXES))})(?=[A-Za-z_-]*[0-9])[A-Za-z0-9_-]{{16,}}(?:\.[A-Za-z0-9_-]{{8,}}){{0,2}}"),
    "email": ("@", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)*\.[A-Za-z]{2,}"),
    "secret": ("", r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b|\b(?i:password|passwd|pwd|secret|token|api[_-]?key)\b[ \t]*[=:][ \t]*[\"']?(?P<x>[A-Za-z0-9_+/.-]{6,})"),
    "iban": ("", r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b"),
    "ip": (".", r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![0-9]|\.[0-9])"),
    "ipv6": (":", r"(?<![0-9A-Za-z:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?=[0-9A-Fa-f:]*[0-9])(?:[0-9A-Fa-f]{1,4}:){2,6}(?::[0-9A-Fa-f]{1,4}){1,4})(?![0-9A-Za-z:])"),
    "mac": ("", r"(?<![0-9A-Za-z:-])[0-9A-Fa-f]{2}(?P<sep>[:-])(?:[0-9A-Fa-f]{2}(?P=sep)){4}[0-9A-Fa-f]{2}(?![0-9A-Za-z:-])"),
    "ssn": ("-", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    "phone": ("", r"(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3,4}[ .-][0-9]{4}(?![0-9-])|(?<![0-9A-Za-z+])\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9])"),
    "card": ("", r"(?<![0-9A-Za-z])(?:[0-9]{4}[ -]){3}[0-9]{4}(?![0-9])|(?<![0-9A-Za-z])[0-9]{13,19}(?![0-9A-Za-z])"),
}
PATTERNS = {k: (needs, re.compile(p)) for k, (needs, p) in KINDS.items()}
DIGITS = re.compile("[0-9]{2}")
#: Digits that an IPv6 address has after its first group; shorter ones have too few surrogates.
LEAST = 5
#: What hardware and IPv6 addresses have somewhere.
HEX = re.compile("[0-9A-Fa-f][:-][0-9A-Fa-f]{1,4}[:-][0-9A-Fa-f]{0,4}[:-]|[0-9A-Fa-f]{1,4}:[0-9A-Fa-f]{1,4}::")
#: One of these is in every text that has a form of address: those that hold no other one, and "M" with what must follow.
ADDRESSED = [t for t in TITLES if t != "M" and not any(o in t for o in TITLES if o not in ("M", t))] + ["M ", "M. "]
PERSON = re.compile(rf"\b(?P<t>{'|'.join(sorted(map(re.escape, TITLES), key=len, reverse=True))})\b\.?[ ]+(?P<x>{NAME}(?: {NAME}){{0,2}})")
BARE = re.compile(rf"\b{NAME}\b")
#: Exceptions up to this count travel in the tasks' closure; more are joined by document.
CLOSURE_ROWS = 10_000
ENTITY = "kind string, entity string"


def prf(key: bytes, *parts: object) -> int:
    return int.from_bytes(hashlib.blake2b("\x1f".join(map(str, parts)).encode(), key=key, digest_size=16).digest(), "big")


def permuted(symbols: list[int], radices: list[int], key: bytes, tweak: str) -> list[int]:
    """A keyed bijection of the strings over these radices."""
    if len(symbols) < 2:
        return [(s + prf(key, tweak, r)) % r for s, r in zip(symbols, radices, strict=True)]
    half, out = len(symbols) // 2, list(symbols)
    for turn in range(8):
        a, b = (slice(0, half), slice(half, None)) if turn % 2 else (slice(half, None), slice(0, half))
        pad = prf(key, tweak, turn, out[b])
        for i in range(*a.indices(len(out))):
            pad, out[i] = pad // radices[i] if pad >> 64 else prf(key, tweak, turn, i, pad), (out[i] + pad) % radices[i]
    return out


def by_class(text: str, key: bytes, tweak: str, hexadecimal: bool = False, first_digits: bool = False) -> str:
    """Digits to digits, letters to letters of the same case; anything else stays."""
    alphabets = {"0": "0123456789", "a": "abcdef" if hexadecimal else "abcdefghijklmnopqrstuvwxyz", "A": "ABCDEF" if hexadecimal else "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
    places, symbols, radices, bases = [], [], [], []
    for i, ch in enumerate(text):
        kind = "0" if "0" <= ch <= "9" else "a" if "a" <= ch <= "z" else "A" if "A" <= ch <= "Z" else ""
        if kind:
            letters = alphabets[kind]
            if first_digits and kind == "0" and ch in "23456789" and (i == 0 or not text[i - 1].isdigit()):
                letters = "23456789"
            places.append(i)
            bases.append(letters)
            symbols.append(letters.index(ch))
            radices.append(len(letters))
    out = list(text)
    for i, letters, s in zip(places, bases, permuted(symbols, radices, key, f"{tweak}|{radices}"), strict=True):
        out[i] = letters[s]
    return "".join(out)


def luhn(digits: str) -> int:
    """The digit that would complete these."""
    return -sum(d if i % 2 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits)))) % 10


def refilled(shape: str, symbols: str) -> str:
    """``symbols`` put in the places of the letters and digits of ``shape``."""
    each = iter(symbols)
    return "".join(next(each) if c.isalnum() else c for c in shape)


#: Ranges of addresses with a meaning of their own (first address, bits that are free in it).
RANGES = [(10 << 24, 24), (127 << 24, 24), (172 << 24 | 16 << 16, 20), (192 << 24 | 168 << 16, 16), (169 << 24 | 254 << 16, 16), (0, 24), (224 << 24, 29)]


def ip_number(address: str) -> int:
    return int.from_bytes(bytes(map(int, address.split("."))), "big")


def ip_range(n: int) -> int:
    """The number of a range that holds an address, from 1 on; 0 for public addresses."""
    return next((k for k, (low, bits) in enumerate(RANGES, 1) if n >> bits == low >> bits), 0)


def valid_ssn(number: str) -> bool:
    area, group, serial = number.split("-")
    return area not in ("000", "666") and area < "900" and group != "00" and serial != "0000"


def script_of(text: str) -> str:
    return "cyrillic" if any("Ѐ" <= c <= "ӿ" for c in text) else "latin"


def surrogate(kind: str, entity: str, key: bytes, attempt: int = 0) -> str:
    """The replacement of an entity in its normal form; a later attempt gives another one."""
    tweak = f"{kind}|{attempt}"
    if kind == "email":
        local, _, domain = entity.partition("@")
        labels = domain.split(".")
        kept = 2 if len(labels) > 1 and labels[-2] == "example" else 1
        moved = by_class("@".join([local, ".".join(labels[:-kept])]), key, tweak)
        return ".".join([x for x in [moved, *labels[-kept:]] if x]) if moved[-1:] != "@" else moved + ".".join(labels[-kept:])
    if kind == "phone":
        m = re.match(r"\+[0-9]{1,3}(?=[^0-9])|", entity)
        rest = entity[m.end() :]
        fixed = re.search(r"(?<![0-9])555(?![0-9])", rest)
        if fixed:
            moved = by_class(rest[: fixed.start()] + "/" + rest[fixed.end() :], key, tweak, first_digits=False)
            moved = moved.replace("/", "555")
            return m[0] + moved
        return m[0] + by_class(rest, key, tweak, first_digits=True)
    if kind == "ip":
        n = ip_number(entity)
        at = ip_range(n)
        low, bits = RANGES[at - 1] if at else (0, 32)
        while True:  # a range's own bits; public addresses, six sevenths of all, until one comes that is public
            n = low + int("".join(map(str, permuted(list(map(int, f"{n - low:0{bits}b}")), [2] * bits, key, f"{tweak}|{at}"))), 2)
            if ip_range(n) == at:
                return ".".join(map(str, n.to_bytes(4, "big")))
    if kind == "card":
        digits = re.sub("[^0-9]", "", entity)
        off = (int(digits[-1]) - luhn(digits[:-1])) % 10
        body = digits[0] + by_class(digits[1:-1], key, tweak)
        return refilled(entity, body + str((luhn(body) + off) % 10))
    if kind == "iban":
        plain = entity.replace(" ", "")
        body = by_class(plain[4:], key, tweak)
        number = lambda b: int("".join(str(int(c, 36)) for c in b + plain[:2] + "00"))
        off = (int(plain[2:4]) - (98 - number(plain[4:]) % 97)) % 97
        return refilled(entity, f"{plain[:2]}{(98 - number(body) % 97 + off - 2) % 97 + 2:02d}{body}")
    if kind == "secret":
        prefix = entity[:4] if entity[:4] in ("AKIA", "ASIA") else ""
        rest = entity[len(prefix) :]
        return prefix + by_class(rest, key, tweak, hexadecimal=bool(re.fullmatch("[0-9a-f]+|[0-9A-F]+", rest)))
    if kind == "privatekey":
        return by_class(entity, key, tweak)
    if kind == "token":
        prefix = next(p for p in PREFIXES if entity.startswith(p))
        return prefix + by_class(entity[len(prefix) :], key, tweak)
    if kind in ("ipv6", "mac"):
        first = re.split("[:-]", entity)[0]
        return first + by_class(entity[len(first) :], key, tweak, hexadecimal=True)
    if kind == "ssn":
        n = entity
        while True:  # the permutation is applied until it comes back to numbers of the same kind
            n = by_class(n, key, tweak)
            if valid_ssn(n) == valid_ssn(entity):
                return n
    _, gender, script = kind.split("_")  # name_<gender or s>_<script>
    pool = SURNAMES[script] if gender == "s" else GIVEN[gender, script]
    name = pool[prf(key, tweak, entity, 0) % len(pool)]
    if attempt < 3:
        return name
    syllables = SYLLABLES[script]  # lists end; a second part of ever more syllables does not
    part = "".join(syllables[prf(key, tweak, entity, i) % len(syllables)] for i in range(1, attempt))
    return f"{name}-{part.capitalize()}"


def format_of(kind: str, entity: str) -> str:
    """What an entity has in common with all its surrogates: what stays as it is, and the classes of the other characters."""
    digits = re.sub("[^0-9]", "", entity)
    fixed = {
        "ip": lambda: str(ip_range(ip_number(entity))),
        "ssn": lambda: str(valid_ssn(entity)),
        "card": lambda: f"{digits[0]} {int(digits[-1]) == luhn(digits[:-1])}",
        "iban": lambda: entity[:2],
        "token": lambda: next(p for p in PREFIXES if entity.startswith(p)),
        "secret": lambda: entity[:4] if entity[:4] in ("AKIA", "ASIA") else "",
        "ipv6": lambda: re.split("[:-]", entity)[0],
        "mac": lambda: re.split("[:-]", entity)[0],
        "phone": lambda: re.match(r"(?:\+[0-9]{1,3}(?=[^0-9]))?", entity)[0] + str(bool(re.search("(?<![0-9])555(?![0-9])", entity))),
        "email": lambda: entity.rpartition(".")[2],
    }.get(kind, str)()
    classes = "" if kind == "ip" else re.sub("[A-Z]", "A", re.sub("[a-z]", "a", re.sub("[0-9]", "0", entity)))
    return f"{kind} {fixed} {classes}"


def normal(kind: str, entity: str) -> str:
    return entity.lower() if kind == "email" else entity


def found(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, entity) of all entities of a text, in order and without overlaps."""
    spans = []
    digits = DIGITS.search(text) is not None
    for rank, (kind, (needs, pattern)) in enumerate(PATTERNS.items()):
        if needs not in text or (kind in ("iban", "ip", "ssn", "phone", "card") and not digits) or (kind in ("mac", "ipv6") and not HEX.search(text)) or (kind == "token" and not any(map(text.__contains__, PREFIXES))) or (kind == "secret" and not ("=" in text or ":" in text or "AKIA" in text or "ASIA" in text)):
            continue
        for m in pattern.finditer(text):
            if kind == "ipv6" and len(re.sub("^[^:]*|:", "", m[0])) < LEAST:
                continue
            a, b = m.span("x") if "x" in pattern.groupindex and m["x"] is not None else m.span()
            spans.append((a, rank, b, kind, text[a:b]))
    persons = list(PERSON.finditer(text)) if any(map(text.__contains__, ADDRESSED)) else []
    given: dict[str, set[str]] = {}  # the genders that forms of address give a given name in this text
    for m in persons:
        for word in m["x"].split(" ")[:-1]:
            given.setdefault(word, set()).add(TITLES[m["t"]])
    named: dict[str, tuple[int, str]] = {}
    for m in persons:
        at, words = m.start("x"), m["x"].split(" ")
        for i, word in enumerate(words):
            last = i == len(words) - 1
            known = "s" if last else "".join(given[word] - {"u"})
            kind = f"name_{known if len(known) == 1 else TITLES[m['t']]}_{script_of(word)}"
            spans.append((at, len(PATTERNS), at + len(word), kind, word))
            named.setdefault(word, (at, kind))
            at += len(word) + 1
    for m in BARE.finditer(text) if named else ():  # a later mention without a form of address
        if m[0] in named and m.start() > named[m[0]][0]:
            spans.append((m.start(), len(PATTERNS) + 1, m.end(), named[m[0]][1], m[0]))
    out, end = [], 0
    for a, _, b, kind, entity in sorted(spans):
        if a >= end:
            out.append((a, b, kind, entity))
            end = b
    return out


def matched_case(entity: str, other: str, kind: str) -> str:
    return other.upper() if kind == "email" and entity.isupper() else other


def replaced(text: str, key: bytes, later: dict[tuple[str, str], int | str], known: dict) -> tuple[str, int]:
    """The text with surrogates, and how many. later: attempts of entities that collided, or what they get; known: surrogates so
    far."""
    parts, at, spans = [], 0, found(text)
    for a, b, kind, entity in spans:
        own = (kind, normal(kind, entity))
        if own not in known:
            if len(known) > 50_000:
                known.clear()
            given = later.get(own, 0)
            known[own] = given if isinstance(given, str) else surrogate(*own, key, given)
        parts += [text[at:a], matched_case(entity, known[own], kind)]
        at = b
    return "".join([*parts, text[at:]]) if spans else text, len(spans)


def entities(docs: DataFrame) -> DataFrame:
    """The distinct entities of all texts, in normal form."""

    def run(batches):
        for (texts,) in common.text_batches(batches, "text"):
            seen = {(k, normal(k, e)) for t in texts if t for _, _, k, e in found(t)}
            if seen:
                kinds, values = zip(*sorted(seen), strict=True)
                yield pa.RecordBatch.from_pydict({"kind": list(kinds), "entity": list(values)})

    return docs.select("text").mapInArrow(run, ENTITY).distinct()


def attempts(own: DataFrame, key: bytes, rounds: int = 6, most: int = 40) -> DataFrame:
    """Entities whose first surrogate collides: (kind, entity, attempt, other), with the attempt that does not collide.

    A format that real entities nearly fill has no free surrogates. What still collides after ``rounds`` (names excepted, which
    never run out) gets ``other``: the next entity of its format in a keyed order of these, the last one the first. All other
    surrogates are no real entities, so these stay distinct, and none is its own. One that is alone in its format is joined
    by another entity of it; if there is none, it stays (a password of six dashes has no other form).
    """

    def drawn(batches):
        for kinds, values, tries in common.text_batches(batches, "kind", "entity", "attempt"):
            new = [surrogate(k, e, key, a) for k, e, a in zip(kinds, values, tries, strict=True)]
            yield pa.RecordBatch.from_pydict({"kind": kinds, "entity": values, "attempt": pa.array(tries, pa.int32()), "other": new})

    shape = f"{ENTITY}, attempt int, other string"
    now = common.materialised(own.withColumn("attempt", F.lit(0)).mapInArrow(drawn, shape), "surrogates")
    real = now.select("kind", F.col("entity").alias("other"))
    stuck = now.limit(0).select("kind", "entity")
    for turn in range(most):
        shared = now.groupBy("kind", "other").agg(F.min("entity").alias("keeps"), F.count("*").alias("n")).where("n > 1")
        clash = (
            now.join(shared, ["kind", "other"], "left")
            .join(real.withColumn("is_real", F.lit(True)), ["kind", "other"], "left")
            .withColumn("again", F.col("is_real").isNotNull() | (F.col("keeps").isNotNull() & (F.col("keeps") != F.col("entity"))))
        )
        losers = clash.where("again").select("kind", "entity", (F.col("attempt") + 1).cast("int").alias("attempt"))
        if losers.isEmpty():
            break
        if turn == rounds:
            stuck = common.materialised(losers.where(~F.col("kind").startswith("name_")).select("kind", "entity"), "stuck")
            losers = losers.where(F.col("kind").startswith("name_"))
        now = common.materialised(clash.where("not again").select("kind", "entity", "attempt", "other").unionByName(losers.mapInArrow(drawn, shape)), "surrogates")
    else:
        raise RuntimeError(f"names still collide after {most} attempts")
    later = now.where("attempt > 0").select("kind", "entity", "attempt", F.lit(None).cast("string").alias("other"))
    if stuck.isEmpty():
        return later
    turned = common.materialised(in_turn(own, stuck, key), "in-turn")
    return later.join(turned, ["kind", "entity"], "left_anti").unionByName(turned)


def in_turn(own: DataFrame, stuck: DataFrame, key: bytes) -> DataFrame:
    """(kind, entity, attempt, other) of entities that take each other's places within their format. No format has more of them
    than it has strings."""

    def described(batches):
        for kinds, values in common.text_batches(batches, "kind", "entity"):
            places = [f"{prf(key, 'turn', k, e):032x}" for k, e in zip(kinds, values, strict=True)]
            yield pa.RecordBatch.from_pydict({"kind": kinds, "entity": values, "format": [format_of(k, e) for k, e in zip(kinds, values, strict=True)], "place": places})

    shape = f"{ENTITY}, format string, place string"
    rows = common.materialised(stuck.mapInArrow(described, shape), "formats")
    alone = rows.groupBy("kind", "format").agg(F.count("*").alias("n")).where("n = 1").select("kind", "format")
    others = own.join(alone.select("kind").distinct(), "kind", "left_semi").join(rows, ["kind", "entity"], "left_anti").mapInArrow(described, shape)
    partner = others.join(alone, ["kind", "format"]).groupBy("kind", "format").agg(F.min_by("entity", "place").alias("entity"), F.min("place").alias("place"))
    by = Window.partitionBy("kind", "format")
    after = F.coalesce(F.lead("entity").over(by.orderBy("place", "entity")), F.first("entity").over(by.orderBy("place", "entity")))
    return rows.unionByName(partner).select("kind", "entity", F.lit(0).alias("attempt"), after.alias("other"))


def pseudonymised(docs: DataFrame, key: str | bytes, text: str = "text", count: str | None = None) -> DataFrame:
    """``docs`` with surrogates in its text column; with ``count``, one more column has the number of entities; a column that
    is there already is an error."""
    if count and count.lower() in map(str.lower, docs.columns):
        raise ValueError(f"there is a column named {count}")
    key = hashlib.blake2b(key.encode() if isinstance(key, str) else key, digest_size=32).digest()
    own = common.materialised(entities(docs.select(F.col(text).alias("text"))), "entities")
    later = attempts(own, key)
    few = later.limit(CLOSURE_ROWS + 1).collect()
    kept = docs.columns
    if len(few) <= CLOSURE_ROWS:
        table = {(r["kind"], r["entity"]): r["other"] if r["other"] is not None else r["attempt"] for r in few}
        source, per_row = docs, False
    else:  # by the document's hash: each gets the attempts of the entities that it holds
        source, per_row = joined_attempts(docs, text, later), True
        table = {}

    schema_out = T.StructType([*docs.schema.fields, *([T.StructField(count, T.IntegerType())] if count else [])])
    place = kept.index(text)

    def run(batches):
        known: dict = {}
        for batch in batches:
            texts = batch.column(place).to_pylist()
            extra = batch.column(len(kept)).to_pylist() if per_row else [None] * len(texts)
            new = []
            for t, pairs in zip(texts, extra, strict=True):
                if t is None:
                    new.append((None, 0))
                elif pairs:
                    new.append(replaced(t, key, {(p["kind"], p["entity"]): p["other"] if p["other"] is not None else p["attempt"] for p in pairs}, {}))
                else:
                    new.append(replaced(t, key, table, known if not per_row else {}))
            columns = [batch.column(i) for i in range(len(kept))]
            columns[place] = pa.array([t for t, _ in new], batch.schema.field(place).type)
            names = [*kept]
            if count:
                columns.append(pa.array([n for _, n in new], pa.int32()))
                names.append(count)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return source.mapInArrow(run, schema_out)


def joined_attempts(docs: DataFrame, text: str, later: DataFrame) -> DataFrame:
    """``docs`` and one more, last column: the attempts of its entities that collided."""
    mark, pairs = common.unused("text_hash", docs), common.unused("attempts", docs)

    def run(batches):
        for texts, marks in common.text_batches(batches, "text", mark):
            rows = [(m, k, normal(k, e)) for t, m in zip(texts, marks, strict=True) if t for _, _, k, e in found(t)]
            if rows:
                m, k, e = zip(*rows, strict=True)
                yield pa.RecordBatch.from_pydict({mark: pa.array(m, pa.string()), "kind": list(k), "entity": list(e)})

    hashed = docs.withColumn(mark, F.sha1(F.encode(F.coalesce(F.col(text), F.lit("")), "utf-8")))
    own = hashed.select(F.col(text).alias("text"), mark).mapInArrow(run, f"{mark} string, {ENTITY}").distinct()
    each = own.join(later, ["kind", "entity"]).groupBy(mark).agg(F.collect_list(F.struct("kind", "entity", "attempt", "other")).alias(pairs))
    return hashed.join(each, mark, "left").select(*docs.columns, pairs)


def key_of(spark: SparkSession) -> str:
    """The deployment's secret: ``spark.cellweave.surrogates.key``. Where it is unset there is no default that anyone could know:
    the run draws a key of its own, and its surrogates cannot be told apart from chance, nor be linked to another run's."""
    return spark.conf.get("spark.cellweave.surrogates.key", None) or secrets.token_hex(32)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir).select("doc_id", "text")
    return pseudonymised(docs, key=key_of(spark), count="n_entities")


