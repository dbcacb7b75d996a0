"""Quality rules as a ledger: every rule is evaluated once, its failure is a bit, and policies are masks over the bits.

One pass over the texts counts all measurements; a second projection turns them into ``failed``, a 64-bit mask in which
bit k is set where rule k failed. The ledger (id, measurements, mask) is a table. A policy is a version with a mask of
rules of which none may fail and a mask of rules of which a few may; its verdict is two bitwise operations on a row of the
ledger, so a new version, or a comparison of versions, reads no text. Ablations count rows by mask first (there are at most
as many masks as rules can fail together) and ask each policy about each mask, with and without each rule's bit.

Thresholds are whole numbers on both sides, so that no verdict hangs on rounding.

Defined cases: a null text is the empty text (no words, so it fails ``few_words``); a null ``doc_id`` is kept; repeated rows
are measured each; an empty table gives no rows; equal windows and lines are compared as whole strings, so ties do not
occur; other columns are not read, whatever their names (``verdicts`` keeps those of the ledger). A text of any length is
split in blocks of ``BLOCK`` characters; what is held of it is a number for each word and its distinct words and lines.
"""

from __future__ import annotations

import array
import re
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.llm import common

WORDS = re.compile("[^\x20\x09-\x0d]+")
SPACE = re.compile("[\x20\x09-\x0d]")
#: What the counts look for.
SYMBOLS, BLANKS = "#*$%&|<>", "\x20\x09\x0a\x0b\x0c\x0d"
#: Words of a window; characters that are split at once.
WIDTH, BLOCK = 5, 1 << 20
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_exclamations"]


@dataclass(frozen=True)
class Rule:
    """``fails`` is a condition on measurements; ``bit`` never changes its meaning, in any version."""

    bit: int
    name: str
    fails: Callable[[], Column]

    @property
    def mask(self) -> int:
        return 1 << self.bit


RULES = [
    Rule(0, "few_words", lambda: F.col("n_words") < 10),
    Rule(1, "repeated_windows", lambda: 100 * F.col("n_repeat_words") > 20 * F.col("n_words")),
    Rule(2, "symbols", lambda: 10 * F.col("n_symbols") > F.col("n_words")),
    Rule(3, "duplicate_lines", lambda: 100 * F.col("n_dup_lines") > 40 * F.col("n_lines")),
    Rule(4, "short_words", lambda: 2 * F.col("word_chars") < 5 * F.col("n_words")),
    Rule(5, "long_words", lambda: F.col("word_chars") > 12 * F.col("n_words")),
    Rule(6, "exclamations", lambda: 2 * F.col("n_exclamations") > F.col("n_words")),
]


def mask_of(*names: str) -> int:
    bits = {r.name: r.mask for r in RULES}
    return sum(bits[n] for n in dict.fromkeys(names))


@dataclass(frozen=True)
class Policy:
    """A document is kept if it fails no rule of ``never``, and at most ``most`` of ``sometimes``."""

    version: int
    never: int
    sometimes: int = 0
    most: int = 0

    def keeps(self, failed: Column) -> Column:
        soft = F.bit_count(failed.bitwiseAND(F.lit(self.sometimes))) <= self.most
        return (failed.bitwiseAND(F.lit(self.never)) == 0) & soft


BASE = mask_of("few_words", "repeated_windows")
POLICIES = {
    1: Policy(1, BASE),
    2: Policy(2, BASE | mask_of("symbols", "duplicate_lines", "short_words", "long_words", "exclamations")),
    3: Policy(3, BASE | mask_of("symbols"), mask_of("duplicate_lines", "short_words", "long_words", "exclamations"), 1),
}
CURRENT = 2


# --- measurements ---


def numbers_of(text: str) -> tuple[np.ndarray, int]:
    """Each word of a text as the number of its first occurrence among distinct words, and how many those are."""
    seen: dict[str, int] = {}
    out, at = array.array("q"), 0
    while at < len(text):
        cut = SPACE.search(text, at + BLOCK) if len(text) - at > BLOCK else None
        end = cut.start() if cut else len(text)
        out.extend([seen.setdefault(w, len(seen)) for w in WORDS.findall(text, at, end)])
        at = end
    return np.frombuffer(out, np.int64) if len(out) else np.zeros(0, np.int64), len(seen)


def ranks(x: np.ndarray) -> np.ndarray:
    return np.unique(x, return_inverse=True)[1]


def windows_of(ids: np.ndarray, distinct: int) -> np.ndarray:
    """A number for each window of ``WIDTH`` words; equal ones have equal numbers, and others do not."""
    n = len(ids) - WIDTH + 1
    key, size = ids[:n], distinct
    for k in range(1, WIDTH):
        if size * distinct >= 2**63:
            key = ranks(key)
            size = len(ids)
        key = key * distinct + ids[k : k + n]
        size *= distinct
    return key


def repeated_words(ids: np.ndarray, distinct: int) -> int:
    """Words in windows that are found twice or more."""
    n = len(ids) - WIDTH + 1
    if n < 2:
        return 0
    key = windows_of(ids, distinct)
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    if not same.any():
        return 0
    begins = np.zeros(len(ids) + 1, np.int64)
    for some in (order[1:][same], order[:-1][same]):
        begins[some] = 1
    before = np.r_[0, np.cumsum(begins[: len(ids)])]
    low = np.maximum(np.arange(len(ids)) - WIDTH + 1, 0)
    return int((before[1:] > before[low]).sum())


def measured(text: str) -> tuple[int, ...]:
    """The values of ``MEASURES``."""
    ids, distinct = numbers_of(text)
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    return (
        len(ids),
        len(text) - sum(map(text.count, BLANKS)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(ids, distinct),
        len(lines),
        text.count("!"),
    )


def measurements(docs: DataFrame) -> DataFrame:
    """doc_id and the measurements of every document."""

    def run(batches):
        for ids, texts in common.text_batches(batches, "doc_id", "text"):
            columns = list(zip(*(measured(t or "") for t in texts), strict=True)) or [()] * len(MEASURES)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(c, pa.int64()) for c in columns)], names=["doc_id", *MEASURES])

    shape = ", ".join(f"{c} long" for c in ("doc_id", *MEASURES))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, shape)


# --- the ledger, and what is asked of it ---


def failures(rules: list[Rule] = RULES) -> Column:
    """The bits of the rules that a row of measurements fails."""
    bits = [F.when(r.fails(), F.lit(r.mask)).otherwise(F.lit(0)).cast("long") for r in rules]
    out = bits[0]
    for b in bits[1:]:
        out = out.bitwiseOR(b)
    return out


def ledger(docs: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """doc_id, measurements and ``failed``, as a table in the shared folder."""
    return common.materialised(measurements(docs).withColumn("failed", failures(rules)), "rule-ledger")


def verdicts(entries: DataFrame, policy: Policy) -> DataFrame:
    """The ledger with ``kept`` by a policy."""
    return entries.withColumn("kept", policy.keeps(F.col("failed")))


def ablations(entries: DataFrame, policies: list[Policy], rules: list[Rule] = RULES) -> DataFrame:
    """Of each policy and rule that it asks for: version, rule, documents in all, kept, failing the rule, kept only if the rule
    were left out, and the words of the latter."""
    masks = entries.groupBy("failed").agg(F.count("*").alias("n"), F.sum("n_words").alias("words"))
    asked = []
    for p in policies:
        for r in rules:
            if (p.never | p.sometimes) & r.mask:
                failed = F.col("failed")
                kept, without = p.keeps(failed), p.keeps(failed.bitwiseAND(F.lit(~r.mask)))
                asked.append(F.struct(F.lit(p.version).alias("version"), F.lit(r.name).alias("rule"), kept.alias("kept"), (failed.bitwiseAND(F.lit(r.mask)) != 0).alias("fails"), (without & ~kept).alias("only")))
    each = masks.select("n", "words", F.explode(F.array(*asked)).alias("x")).select("n", "words", "x.*")
    count = lambda where, what="n": F.coalesce(F.sum(F.when(F.col(where), F.col(what))), F.lit(0))
    return each.groupBy("version", "rule").agg(F.sum("n").alias("documents"), count("kept").alias("kept"), count("fails").alias("failing"), count("only").alias("only_here"), count("only", "words").alias("words_only_here"))


def failing_by(entries: DataFrame, by: list[str]) -> DataFrame:
    """Of each group: documents, the rules that some of them fail, and the rules that all of them fail, as masks."""
    return entries.groupBy(*by).agg(F.count("*").alias("documents"), F.bit_or("failed").alias("some_fail"), F.bit_and("failed").alias("all_fail"))


def op12_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = verdicts(ledger(common.documents(spark, sf_dir)), POLICIES[CURRENT])
    base = F.col("failed").bitwiseAND(F.lit(BASE)) != 0
    return entries.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept", "failed")


def oracle_sql() -> str:
    return r"""
with docs as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
split as (select r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as words from docs),
each as (select r, unnest(words) as word, generate_subscripts(words, 1) as i from split),
windows as (
  select r, i, word || ' ' || lead(word, 1) over o || ' ' || lead(word, 2) over o || ' ' || lead(word, 3) over o || ' ' || lead(word, 4) over o as win
  from each window o as (partition by r order by i)),
found as (select r, i, count(*) over (partition by r, win) as times from windows where win is not null),
inside as (select distinct r, i + k as i from found cross join (select unnest([0, 1, 2, 3, 4]) as k) where times > 1),
repeats as (select r, count(*) as n from inside group by r),
lines as (select r, unnest(string_split(text, chr(10))) as line from docs),
solid as (select r, count(*) as n, count(distinct line) as different from lines where regexp_matches(line, '[^\x20\x09-\x0D]') group by r),
counts as (
  select doc_id, len(words) as n_words, len(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) as word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]')) as n_symbols, coalesce(solid.n - solid.different, 0) as n_dup_lines,
    coalesce(repeats.n, 0) as n_repeat_words, coalesce(solid.n, 0) as n_lines, len(regexp_extract_all(text, '!')) as n_exclamations
  from split left join repeats using (r) left join solid using (r)),
bits as (
  select *, case when n_words < 10 then 1 else 0 end + case when 100 * n_repeat_words > 20 * n_words then 2 else 0 end
    + case when 10 * n_symbols > n_words then 4 else 0 end + case when 100 * n_dup_lines > 40 * n_lines then 8 else 0 end
    + case when 2 * word_chars < 5 * n_words then 16 else 0 end + case when word_chars > 12 * n_words then 32 else 0 end
    + case when 2 * n_exclamations > n_words then 64 else 0 end as failed from counts)
select doc_id, cast(n_words as bigint) as n_words, cast(word_chars as bigint) as word_chars, cast(n_symbols as bigint) as n_symbols,
  cast(n_dup_lines as bigint) as n_dup_lines, cast(n_repeat_words as bigint) as n_repeat_words, failed & 3 <> 0 as base_failed, failed = 0 as kept,
  cast(failed as bigint) as failed from bits"""
