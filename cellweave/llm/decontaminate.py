"""Benchmark decontamination by spaced seeds, in DataFrame operations alone.

A text becomes its lower-case words of letters and digits. A window of ``SPAN`` words gives one key for each mask: the
hash of the words that the mask keeps. Keys of all windows of the test items are joined with those of all windows of the
documents. The masks are fixed: each position is ignored by one, and any two substitutions in
``SPAN + 1`` words leave a mask whole in one of the two windows there. So whatever the verification accepts meets, if the
document has the words of the windows: an item of ``SPAN`` words with one substitution, a longer one with two. Each hit
fixes an alignment; it is verified when some stretch of ``NEED`` words (the whole item, if shorter) around it agrees in at
least ``SHARE`` of its words.

Items of ``SHORTEST`` to ``SPAN`` - 1 words are looked for as a whole, without substitutions, at every position; shorter
ones are too common to tell, and never count.

Few windows are hashed: every mask keeps neighbours, and a window goes on only if all pairs of neighbours that its mask
keeps are pairs of some item, and few are joined: its key must be one of an item. Both are told by filters of bits
(literals of at most 2 MB each; false hits cost time, and nothing is lost).
The items' keys are broadcast only when there are at most ``BROADCAST_KEYS`` of them, 24 bytes each; beyond it the join
shuffles. The items' words are joined to hits alone. A document's hits are verified in groups of neighbouring alignments
and some of the items, so that a text that repeats itself, or holds many items, is no single large row.

Defined cases: a null text is the empty text, which is clean; a null ``doc_id`` is kept; repeated rows are judged alike;
empty tables give no hits; a text of any length is one row of word hashes; overlaps with several items count once an
item; other columns, whatever their names, are kept by ``clean_documents`` and not read otherwise.
"""

from __future__ import annotations

import functools
import json
import operator
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.llm import common

SPAN, NEED, SHARE, SHORTEST = 9, 13, 0.8, 5
#: Fixed masks: the positions of a window that each keeps.
MASKS = ((4, 5, 6, 7, 8), (1, 2, 6, 7, 8), (0, 1, 3, 4, 8), (0, 2, 3, 5, 6))
BROADCAST_KEYS = 1_000_000
#: The filter's size in bits, as powers of two: the least, and the most.
LEAST_BITS, MOST_BITS = 12, 24
#: Hits are verified in groups: of a document those of so many alignments in a row, with one of so many groups of items.
STRETCH, GROUPS = 1024, 16


def words(text: str = "text") -> Column:
    """Hashes of a text's words, in order."""
    split = F.array_remove(F.split(F.lower(common.text_or_empty(text)), r"[^\p{L}\p{N}]+"), "")
    return F.transform(split, lambda w: F.xxhash64(w))


def all_of(tests: list[Column]) -> Column:
    return functools.reduce(operator.and_, tests)


def neighbours(mask: tuple[int, ...]) -> list[int]:
    """Positions of a mask whose next one it keeps too."""
    return [p for p in mask if p + 1 in mask]


def pair(i: Column, h: str = "h") -> Column:
    return F.xxhash64(F.get(F.col(h), i), F.get(F.col(h), i + 1))


def masked(m: int, at: Column, h: str = "h") -> Column:
    """(at, key) of the window that starts there, by one mask."""
    return F.struct(at.alias("at"), F.xxhash64(F.lit(m), *[F.get(F.col(h), at + p) for p in MASKS[m]]).alias("key"))


def whole(at: Column, size: int | Column, h: str = "h") -> Column:
    """(at, key) of ``size`` words as they are."""
    return F.struct(at.alias("at"), F.xxhash64(F.lit(-1), F.slice(F.col(h), at + 1, size)).alias("key"))


def starts(span: int, h: str = "h") -> Column:
    """Starts of all windows; empty if the text is shorter."""
    return F.when(F.size(h) >= span, F.sequence(F.lit(0), F.size(h) - span)).otherwise(F.array().cast("array<int>"))


def items_of(benchmark: DataFrame) -> DataFrame:
    """(item, h): the items' word hashes. Equal texts are one item."""
    return benchmark.select(words().alias("h")).where(F.size("h") >= SHORTEST).distinct().select(F.xxhash64("h").alias("item"), "h")


def keys_of(items: DataFrame) -> DataFrame:
    """(key, item, q): of each item its keys, and where they start."""
    each = [F.transform(starts(SPAN), functools.partial(lambda m, at: masked(m, at), m)) for m in range(len(MASKS))]
    short = F.when(F.size("h") < SPAN, F.array(whole(F.lit(0), F.size("h")))).otherwise(F.array().cast("array<struct<at:int,key:bigint>>"))
    found = items.select("item", F.explode(F.concat(*each, short)).alias("k"))
    return found.select(F.col("k.key").alias("key"), "item", F.col("k.at").alias("q")).distinct()


def bit_filter(hashes: DataFrame, probes: int) -> Callable[[Column], Column]:
    """hashes: one column. Whether a hash is among them, seldom also true for others: a table of bits, as a literal."""
    own = hashes.toDF("x").distinct()
    bits = min(MOST_BITS, max(LEAST_BITS, (16 * own.count()).bit_length()))
    slots = lambda x: [F.shiftrightunsigned(x, 64 - bits), x.bitwiseAND(F.lit((1 << bits) - 1))][:probes]
    place, bit = lambda x: F.shiftright(x, 6).cast("int"), lambda x: x.bitwiseAND(F.lit(63)).cast("int")
    each = own.select(F.explode(F.array(*slots(F.col("x")))).alias("x"))
    found = each.groupBy(place(F.col("x")).alias("place")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit(F.col("x")))).alias("bits"))
    table = [0] * (1 << bits - 6)
    for r in found.collect():  # one row for 64 bits
        table[r["place"]] = r["bits"]
    literal = F.from_json(F.lit(json.dumps(table)), "array<bigint>")
    return lambda x: all_of([F.bit_get(F.get(literal, place(s)), bit(s)) == 1 for s in slots(x)])


def candidates(docs: DataFrame, items: DataFrame, tests: DataFrame) -> DataFrame:
    """(k1, k2, h, windows) of the documents that have windows with a chance: (at, key) each. k1 and k2 are equal for equal
    id and text."""
    in_pairs = bit_filter(items.select(F.explode(F.transform(starts(2), lambda i: pair(i)))), 1)
    in_keys = bit_filter(tests.select("key"), 2)
    sizes = items.where(F.size("h") < SPAN).agg(F.collect_set(F.size("h")).alias("sizes")).first()["sizes"]
    near = lambda p, offsets: [F.get(F.col("near"), p + o) for o in offsets]
    each = []
    for m, mask in enumerate(MASKS):
        first, *rest = neighbours(mask)
        at = F.transform("places", functools.partial(lambda first, i: i - first, first))
        good = functools.partial(lambda rest, p: all_of([p >= 0, p <= F.size("h") - SPAN, *near(p, rest)]), rest)
        each.append(F.transform(F.filter(at, good), functools.partial(lambda m, p: masked(m, p), m)))
    for size in sorted(sizes):
        good = functools.partial(lambda size, p: all_of([p <= F.size("h") - size, *near(p, range(1, size - 1))]), size)
        each.append(F.transform(F.filter("places", good), functools.partial(lambda size, p: whole(p, size), size)))
    own = docs.select(*identity(), words().alias("h")).withColumn("near", F.transform(starts(2), lambda i: in_pairs(pair(i))))
    places = own.withColumn("places", F.filter(starts(2), lambda i: F.get(F.col("near"), i)))
    found = places.select("k1", "k2", "h", F.filter(F.concat(*each), lambda x: in_keys(x["key"])).alias("windows"))
    some = F.when(F.size("windows") > 0, F.array(F.struct("h", "windows")))
    return found.select("k1", "k2", F.explode(some).alias("x")).select("k1", "k2", "x.h", "x.windows")


def identity() -> list[Column]:
    """Two hashes of a row's id and text."""
    parts = [F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)), F.col("doc_id").isNull(), common.text_or_empty()]
    return [F.xxhash64(*parts).alias("k1"), F.xxhash64(F.lit("other"), *parts).alias("k2")]


def verified(h: str, hit: Column) -> Column:
    """Whether the alignment has a stretch of NEED words (or the whole item) that agrees well enough."""
    b, diagonal = hit["b"], hit["diagonal"]
    need = F.least(F.size(b), F.lit(NEED))
    agrees = F.transform(b, lambda w, i: F.when((i + diagonal >= 0) & (F.get(F.col(h), i + diagonal) == w), 1).otherwise(0))
    least = F.when(F.size(b) < SPAN, need).otherwise(F.ceil(need * F.lit(SHARE)).cast("int"))
    starts = F.sequence(F.lit(0), F.size(b) - need)
    return F.exists(starts, lambda s: F.aggregate(F.slice(agrees, s + 1, need), F.lit(0), lambda x, y: x + y) >= least)


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(k1, k2, n): how many different items each document has a verified overlap with; only documents with some."""
    items = items_of(benchmark)
    tests = common.materialised(keys_of(items), "item-keys")
    held = common.materialised(candidates(docs.select("doc_id", "text"), items, tests), "windows")
    seen = held.select("k1", "k2", F.explode("windows").alias("x")).select("k1", "k2", F.col("x.at").alias("p"), F.col("x.key").alias("key"))
    hits = seen.join(F.broadcast(tests) if tests.count() <= BROADCAST_KEYS else tests, "key")
    hits = hits.select("k1", "k2", "item", (F.col("p") - F.col("q")).alias("diagonal")).distinct()
    dealt = [F.floor(F.col("diagonal") / STRETCH).alias("stretch"), F.pmod("item", F.lit(GROUPS)).alias("g")]
    known = hits.join(items.withColumnRenamed("h", "b"), "item").groupBy("k1", "k2", *dealt).agg(F.collect_list(F.struct("item", "diagonal", "b")).alias("hits"))
    good = F.transform(F.filter("hits", lambda x: verified("h", x)), lambda x: x["item"])
    each = held.select("k1", "k2", "h").join(known, ["k1", "k2"]).select("k1", "k2", F.explode(F.array_distinct(good)).alias("item"))
    return each.distinct().groupBy("k1", "k2").agg(F.count("*").cast("int").alias("n"))


def judged(docs: DataFrame, benchmark: DataFrame, count: str = "__n") -> DataFrame:
    """``docs`` with one more column: how many different items each document has a verified overlap with."""
    k1, k2, n = (common.unused(k, docs) for k in ("k1", "k2", "n"))
    found = overlaps(docs, benchmark).select(F.col("k1").alias(k1), F.col("k2").alias(k2), F.col("n").alias(n))
    own = docs.withColumns(dict(zip((k1, k2), identity(), strict=True)))
    return own.join(found, [k1, k2], "left").select(*docs.columns, F.coalesce(n, F.lit(0)).alias(count))


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a verified overlap, with all their columns."""
    count = common.unused("n_items", docs)
    return judged(docs, benchmark, count).where(F.col(count) == 0).select(*docs.columns)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judged(common.documents(spark, sf_dir), common.table(spark, sf_dir, "benchmark"), "n_items")
    return found.select("doc_id", (F.col("n_items") > 0).alias("contaminated"), F.col("n_items").cast("long").alias("n_items"))


def oracle_sql() -> str:
    """The wanted overlaps in SQL: all alignments of equal words, with no seeds, masks or hashes. An alignment counts if at
    least ``SPAN`` of its words lie in the document (all of them, for shorter items)."""
    return f"""
with d as (select doc_id, row_number() over () as r, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '') as h from documents),
t as (select distinct list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '') as b from benchmark),
items as (select b, len(b) as n, least(len(b), {NEED}) as need, row_number() over () as item from t where len(b) >= {SHORTEST}),
dw as (select r, unnest(range(0, len(h))) as p, unnest(h) as w from d),
tw as (select item, n, need, unnest(range(0, len(b))) as i, unnest(b) as w from items),
aligned as (
  select r, item, n, need, p - i as g, case when n < {SPAN} then n else ceil(need * {SHARE}) end as least_words, list(i) as agrees
  from dw join tw using (w) group by r, item, n, need, g having count(*) >= least_words),
good as (
  select distinct r, item from aligned join d using (r)
  where least(len(h), g + n) - greatest(g, 0) >= least(n, {SPAN})
    and len(list_filter(range(0, n - need + 1), lambda s: len(list_filter(agrees, lambda i: i >= s and i < s + need)) >= least_words)) > 0)
select doc_id, count(item) > 0 as contaminated, count(item) as n_items from d left join good using (r) group by r, doc_id
"""
