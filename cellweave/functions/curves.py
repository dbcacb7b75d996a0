"""Space-filling curve keys and cell coordinates as Column expressions.

Cells have native coordinates (in units of their own level); an anchor is a cell's lowest corner in units of the finest
level. Keys use three bits a level, x lowest.
"""

from __future__ import annotations

from functools import cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

FINEST = 8
#: Coordinates are 21-bit signed.
LIMIT = 2**21


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bit(c: Column | str, at: int) -> Column:
    return F.shiftright(col(c), at).bitwiseAND(F.lit(1))


def morton(x="x", y="y", z="z", bits: int = FINEST) -> Column:
    """Bits of the coordinates side by side, x lowest: the Z-order key."""
    each = [F.shiftleft(bit(c, b).cast("long"), 3 * b + k) for b in range(bits) for k, c in enumerate((x, y, z))]
    return reduce(lambda a, b: a.bitwiseOR(b), each)


def morton_axis(key: Column | str, axis: int, bits: int = FINEST) -> Column:
    each = [F.shiftleft(bit(key, 3 * b + axis), b) for b in range(bits)]
    return reduce(lambda a, b: a.bitwiseOR(b), each).cast("int")


def rotated(x: int, by: int) -> int:
    """Three bits, rotated to the left."""
    by %= 3
    return (x << by | x >> (3 - by)) & 7


@cache
def hilbert_table() -> tuple[list[int], list[int]]:
    """(digit, next state) at 8 * state + octant. A state is an entry corner and a direction, 24 in all; the rule is that of
    compact Hilbert indices: the octant, seen from the entry and turned to the direction, is the digit's Gray code."""
    gray = [i ^ i >> 1 for i in range(8)]
    trailing = [(~i & i + 1).bit_length() - 1 for i in range(8)]  # ones at the low end
    entry = [0] + [gray[2 * ((i - 1) // 2)] for i in range(1, 8)]
    turn = [0] + [trailing[i - 1 if i % 2 == 0 else i] % 3 for i in range(1, 8)]
    digit, after = [], []
    for state in range(24):
        e, d = state // 3, state % 3
        for octant in range(8):
            w = gray.index(rotated(octant ^ e, -(d + 1)))
            digit.append(w)
            after.append((e ^ rotated(entry[w], d + 1)) * 3 + (d + turn[w] + 1) % 3)
    return digit, after


def octant(x, y, z, at: Column) -> Column:
    """The three bits of the coordinates at a bit position that is a Column."""
    one = lambda c: F.shiftright(col(c).cast("int"), at).bitwiseAND(F.lit(1)) if isinstance(at, int) else F.call_function("shiftright", col(c).cast("int"), at).bitwiseAND(F.lit(1))
    return one(x) + 2 * one(y) + 4 * one(z)


def hilbert(x="x", y="y", z="z", bits: int = FINEST) -> Column:
    """The key along a true Hilbert curve (neighbours along it share a face): one table step a level, high bits first."""
    digit, after = (F.array(*map(F.lit, t)) for t in hilbert_table())

    def step(acc: Column, at: Column) -> Column:
        place = acc["state"] * 8 + octant(x, y, z, at)
        return F.struct((acc["key"] * 8 + F.get(digit, place)).alias("key"), F.get(after, place).alias("state"))

    start = F.struct(F.lit(0).cast("long").alias("key"), F.lit(0).alias("state"))
    levels = F.array(*map(F.lit, reversed(range(bits))))
    return F.aggregate(levels, start, step, lambda acc: acc["key"])


@cache
def hilbert_inverse() -> tuple[list[int], list[int]]:
    """(octant, next state) at 8 * state + digit."""
    digit, after = hilbert_table()
    octants, states = [0] * 192, [0] * 192
    for at, (w, s) in enumerate(zip(digit, after, strict=True)):
        octants[at // 8 * 8 + w], states[at // 8 * 8 + w] = at % 8, s
    return octants, states


def hilbert_cell(key: Column | str, bits: int = FINEST) -> Column:
    """The coordinates of a Hilbert key, as a struct of x, y, z."""
    octants, states = (F.array(*map(F.lit, t)) for t in hilbert_inverse())
    key = col(key)

    def step(acc: Column, at: Column) -> Column:
        w = F.call_function("shiftright", key, 3 * at).bitwiseAND(F.lit(7).cast("long")).cast("int")
        place = acc["state"] * 8 + w
        o = F.get(octants, place)
        grown = [(acc[c] * 2 + F.shiftright(o, k).bitwiseAND(F.lit(1))).alias(c) for k, c in enumerate("xyz")]
        return F.struct(*grown, F.get(states, place).alias("state"))

    start = F.struct(*[F.lit(0).alias(c) for c in "xyz"], F.lit(0).alias("state"))
    return F.aggregate(F.array(*map(F.lit, reversed(range(bits)))), start, step, lambda acc: F.struct(*[acc[c].alias(c) for c in "xyz"]))


def anchor(c: Column | str, level: Column | str = "level") -> Column:
    """A native coordinate in units of the finest level."""
    return F.call_function("shiftleft", col(c).cast("int"), F.lit(FINEST) - col(level))


def parent(c: Column | str) -> Column:
    """The parent's coordinate; floors, also below zero."""
    return F.shiftright(col(c), 1)


def child(c: Column | str, number: Column | str, axis: int) -> Column:
    return F.shiftleft(col(c), 1).bitwiseOR(bit(number, axis).cast("int"))


def child_number(x="x", y="y", z="z") -> Column:
    """Which child of its parent a cell is, x lowest."""
    return (bit(x, 0) + 2 * bit(y, 0) + 4 * bit(z, 0)).cast("int")


def first_sibling(x="x", y="y", z="z") -> Column:
    return child_number(x, y, z) == 0


def siblings(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Whether two cells (x, y, z, level) share a parent."""
    same = (col(a["level"]) == col(b["level"])) & (col(a["level"]) > 0)
    for c in "xyz":
        same &= parent(a[c]) == parent(b[c])
    return same


def parent_key(key: Column | str) -> Column:
    return F.shiftright(col(key), 3)


def child_key(key: Column | str, number: Column | str) -> Column:
    """The key of the n-th child along the curve."""
    return F.shiftleft(col(key), 3).bitwiseOR(col(number).cast("long"))


def valid_key(key: Column | str, level: Column | str) -> Column:
    return F.coalesce((col(key) >= 0) & (F.call_function("shiftright", col(key), 3 * col(level)) == 0), F.lit(False))


def valid_cell(x="x", y="y", z="z", level="level") -> Column:
    inside = col(level).between(0, FINEST)
    for c in (x, y, z):
        inside &= F.abs(col(c)) < LIMIT
    return F.coalesce(inside, F.lit(False))


def manhattan(a: list[Column | str], b: list[Column | str]) -> Column:
    return reduce(lambda p, q: p + q, [F.abs(col(p) - col(q)) for p, q in zip(a, b, strict=True)])


def slot(key: Column | str, capacity: int) -> Column:
    """key times the golden-ratio factor, low bits: exact for power-of-two capacities up to 2**30, without overflow."""
    mask = capacity - 1
    return ((col(key).bitwiseAND(F.lit(mask).cast("long"))) * F.lit(0x9E3779B97F4A7C15 & mask).cast("long")).bitwiseAND(F.lit(mask).cast("long"))


def capacity(n: int, load: float = 0.6) -> int:
    """Slots of a hash table: a power of two from 2**20 to 2**30."""
    need = max(1, -(-n * 10 // int(load * 10)))
    return 1 << min(30, max(20, (need - 1).bit_length()))


def root(c: Column | str, level: Column | str = "level") -> Column:
    """The coordinate of the level-0 cell above a cell."""
    return F.call_function("shiftright", col(c).cast("int"), col(level))


def in_range(key: Column | str, start: Column | str, end: Column | str) -> Column:
    """Whether a half-open range holds a key."""
    return (col(key) >= col(start)) & (col(key) < col(end))


def inserted(value: Column | str, bits: Column | str, at: int, width: int) -> Column:
    """``value`` with ``width`` bits from place ``at`` on replaced by those of ``bits``."""
    mask = ((1 << width) - 1) << at
    return col(value).bitwiseAND(F.lit(~mask)).bitwiseOR(F.shiftleft(col(bits), at).bitwiseAND(F.lit(mask)))


def rotated3(bits: Column | str, by: int) -> Column:
    """Three bits, rotated to the left."""
    by %= 3
    return F.shiftleft(col(bits), by).bitwiseOR(F.shiftright(col(bits), 3 - by)).bitwiseAND(F.lit(7))
