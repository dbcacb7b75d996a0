"""Operators on cell tables: split, merge, balance, adapt, neighbours, interpolation, compaction, numbering.

A cell table has x, y, z (native coordinates), level, state (0 fluid, 1 solid), flag (over 0 split, -1 merge) and fields.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from cellweave.functions import curves
from cellweave.operators.exact import exact_sums
from cellweave.operators.locate import ASKS, CAN, CELL, FOUND, MAY, SPLITS, neighbours, steps
from cellweave.operators.session import checkpointed, stored, unused

CHILD = "__child"


def of_eight(c: str) -> Column:
    """Aggregate: the values of siblings as an array, in the order of the children."""
    return F.transform(F.array_sort(F.collect_list(F.struct(CHILD, F.col(c).alias("v")))), lambda s: s["v"])


def added(values: Column) -> Column:
    """The sum of an array, from left to right: the same on any partitioning. Nulls do not count; without values it is null."""
    known = F.filter(values, lambda v: v.isNotNull())
    return F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda a, v: a + v))


def mean_of(values: Column) -> Column:
    return added(values) / F.size(F.filter(values, lambda v: v.isNotNull()))


#: How eight children's field values become their parent's: aggregates over siblings.
RULES: dict[str, Callable[[str], Column]] = {
    "arithmetic": lambda c: F.avg(c),
    "volume_weighted": lambda c: F.sum(c),
    "min": lambda c: F.min(c),
    "max": lambda c: F.max(c),
    "skip": lambda c: F.min_by(c, CHILD),
}
#: The same for fields of floating-point numbers, whose sums depend on their order.
IN_ORDER: dict[str, Callable[[str], Column]] = {"arithmetic": lambda c: mean_of(of_eight(c)), "volume_weighted": lambda c: added(of_eight(c))}
#: Rules whose result is a double, whatever the field's type.
DOUBLE = {"arithmetic"}


def define_rule(name: str, of: Callable[[Column], Column], double: bool = False) -> None:
    """A merge rule of one's own, for this process. ``of`` makes a Column of the parent's value from a Column that is the array of
    the eight children's, in their order (x lowest): by array functions, or by an arrow UDF over that array. The value is
    cast to the field's type; with ``double``, the field is one of doubles after an adaptation."""
    if name in RULES:
        raise ValueError(f"there is an averaging rule named {name!r}")
    RULES[name] = lambda c: of(of_eight(c))
    if double:
        DOUBLE.add(name)


def drop_rule(name: str) -> None:
    """Give up a rule of one's own."""
    if name in ("arithmetic", "volume_weighted", "min", "max", "skip"):
        raise ValueError(f"{name!r} is no rule of one's own")
    RULES.pop(name, None)
    DOUBLE.discard(name)


def rule(name: str, kind: str = "bigint") -> Callable[[str], Column]:
    """The rule's aggregate for a field of a type."""
    if name not in RULES:
        raise ValueError(f"no averaging rule is named {name!r}")
    return IN_ORDER.get(name, RULES[name]) if kind in ("float", "double") else RULES[name]


def splits(most: int = curves.FINEST) -> Column:
    """Whether a cell is to be split: flagged, fluid, and not at the finest level."""
    return (F.col("flag") > 0) & (F.col("state") == 0) & (F.col("level") < most)


def split(cells: DataFrame, most: int = curves.FINEST) -> DataFrame:
    """The eight children of each cell that is to be split; they inherit all other columns, and their flag is 0."""
    eight = F.explode(F.sequence(F.lit(0), F.lit(7)))
    out = cells.where(splits(most)).withColumn(CHILD, eight)
    out = out.withColumns({c: curves.child(c, CHILD, k) for k, c in enumerate("xyz")} | {"level": F.col("level") + 1, "flag": F.lit(0)})
    return out.drop(CHILD)


def asks_to_merge(least: int = 1) -> Column:
    return (F.col("flag") == -1) & (F.col("state") == 0) & (F.col("level") >= least)


def parents_of(cells: DataFrame) -> dict[str, str]:
    """Names for the parents' coordinates that no column of the mesh has."""
    return {c: unused(f"p{c}", cells) for c in "xyz"}


def merge(cells: DataFrame, fields: dict[str, str], least: int = 1) -> DataFrame:
    """The parents of complete groups of eight siblings that all ask for it. fields: column to rule; others: first sibling's."""
    kept = [c for c in cells.columns if c not in (*CELL, "state", "flag", *fields)]
    up, n, types = parents_of(cells), unused("n_siblings", cells), dict(cells.dtypes)
    asked = cells.where(asks_to_merge(least)).withColumns({up[c]: curves.parent(c) for c in "xyz"} | {CHILD: curves.child_number()})
    grouped = asked.groupBy("level", *up.values()).agg(
        F.count("*").alias(n),
        F.min_by("state", CHILD).alias("state"),
        *[rule(r, types[c])(c).alias(c) for c, r in fields.items()],
        *[F.min_by(c, CHILD).alias(c) for c in kept],
    )
    whole = grouped.where(F.col(n) == 8).withColumn("level", F.col("level") - 1).withColumn("flag", F.lit(0))
    return whole.select(*[F.col(up[c]).alias(c) if c in "xyz" else F.col(c) for c in cells.columns])


def adapt(cells: DataFrame, fields: dict[str, str], most: int = curves.FINEST, least: int = 1, balanced: bool = False, counts: Observation | None = None) -> DataFrame:
    """The mesh after one cycle: cells that neither split nor merge, children, and parents; flags are 0. With ``counts``, whatever
    job first computes the mesh counts what became of it on the way: cells, split, merged (groups), raised and vetoed (cells;
    see ``decided``) and, of each field of whole numbers, its sum as ``sum_`` and its name.

    With ``balanced``, flags are first changed until the mesh after the cycle has no face neighbours two levels apart (see
    ``decided``). A mesh that was out of balance before is split further, cycle after cycle, as far as its cells can split.

    Survivors need no anti-join: whether a cell's group is complete is one count over its parent, which merging needs
    anyway; the count is joined back on the parent, so each cell moves once.
    """
    if balanced:
        for _ in range(most + 1):
            cells, left = decided(cells, most, least, marks=counts is not None)
            cells = stored(cells)  # a cycle reads them three times
            out = cycle(cells, fields, most, least, counts, exact=True)
            if not left or not cells.where(splits(most)).limit(1).count():
                return out
            cells, counts = stored(out), Observation() if counts is not None else None  # the first cycle is the one that counts
        return cells
    return cycle(cells, fields, most, least, counts)


#: What ``decided`` tells of a cell: whether it was raised to split, and whether its group was vetoed.
MARKS = ["raised__", "vetoed__"]


def counted(adapted: DataFrame, fields: dict[str, str], counts: Observation) -> DataFrame:
    """The adapted mesh, with ``made__`` and marks, under observation."""
    eighths = lambda where: (F.count_if(where) / 8).cast("long")
    sums = [F.sum(c).alias(f"sum_{c}") for c, t in adapted.dtypes if c in fields and t in ("int", "bigint", "smallint")]
    child, parent = F.col("made__") == 1, F.col("made__") == -1
    seen = [F.count("*").alias("cells"), eighths(child).alias("split"), F.count_if(parent).alias("merged"), eighths(child & F.col(MARKS[0])).alias("raised"), (eighths(child & F.col(MARKS[1])) + F.count_if((F.col("made__") == 0) & F.col(MARKS[1]))).alias("vetoed")]
    return adapted.observe(counts, *seen, *sums)


def cycle(cells: DataFrame, fields: dict[str, str], most: int, least: int, counts: Observation | None = None, exact: bool = False) -> DataFrame:
    if counts is not None:
        marks = {m: F.lit(False) for m in MARKS if m not in cells.columns}
        out = cycled(cells.withColumns(marks | {"made__": F.lit(0)}), fields, most, least, exact)
        return counted(out, fields, counts).drop("made__", *MARKS)
    return cycled(cells, fields, most, least, exact)


def cycled(cells: DataFrame, fields: dict[str, str], most: int, least: int, exact: bool = False) -> DataFrame:
    """With ``exact``, every flag is followed, as ``decided`` leaves them: no group has to be counted for survivors."""
    asks, up, n = asks_to_merge(least), parents_of(cells), unused("n_siblings", cells)
    if exact:
        survivors = cells.where("flag = 0")
    else:
        parents = [curves.parent(c).alias(up[c]) for c in "xyz"]
        whole = cells.where(asks).groupBy("level", *parents).agg(F.count("*").alias(n)).where(F.col(n) == 8)
        tagged = cells.withColumns({up[c]: curves.parent(c) for c in "xyz"})
        left = tagged.where(~splits(most)).join(whole, ["level", *up.values()], "left")
        survivors = left.where(~(asks & F.col(n).isNotNull())).select(*cells.columns).withColumn("flag", F.lit(0))
    children = split(cells, most).select(*cells.columns)
    parents_ = merge(cells, fields, least)
    if "made__" in cells.columns:
        children, parents_ = children.withColumn("made__", F.lit(1)), parents_.withColumn("made__", F.lit(-1))
    types = {c: t for c, t in cells.dtypes}
    same = lambda df: df.select(*[F.col(c).cast("double" if fields.get(c) in DOUBLE else types[c]).alias(c) for c in cells.columns])
    return same(survivors).unionByName(same(children)).unionByName(same(parents_))


def conserved(before: DataFrame, after: DataFrame, field: str, tolerance: float = 1e-6) -> DataFrame:
    """One row: a field's integral (value times volume, in finest cells) before and after, and whether they agree within the
    relative tolerance. Sums of floating-point numbers are the same on any partitioning."""
    volume = F.call_function("shiftleft", F.lit(1).cast("long"), 3 * (F.lit(curves.FINEST) - F.col("level")))

    def total(df: DataFrame, name: str) -> DataFrame:
        if dict(df.dtypes)[field] in ("float", "double"):
            return exact_sums(df, [], {name: F.col(field) * volume}).select(F.coalesce(name, F.lit(0.0)).alias(name))
        return df.agg(F.coalesce(F.sum(F.col(field) * volume), F.lit(0)).cast("double").alias(name))

    both = total(before, "before").crossJoin(F.broadcast(total(after, "after")))  # one row each
    return both.withColumn("holds", F.abs(F.col("after") - F.col("before")) <= tolerance * F.greatest(F.abs("before"), F.lit(1.0)))


def curve_order(cells: DataFrame) -> DataFrame:
    """Cells with ``key``, the anchor's Z-order key: sorting by (key, level) walks a mixed mesh in space."""
    return cells.withColumn("key", curves.morton(*[curves.anchor(c) for c in "xyz"], bits=16))


# --- neighbours ---

FACES = [(axis, side) for axis in range(3) for side in (-1, 1)]


def face_neighbours(cells: DataFrame) -> DataFrame:
    """Same-level cells that share a face, with the face's number: an equi-join on computed coordinates."""
    face = F.explode(F.array(*[F.struct(F.lit(i).alias("face"), *[F.lit(side if a == axis else 0).alias(f"d{c}") for a, c in enumerate("xyz")]) for i, (axis, side) in enumerate(FACES)]))
    probes = cells.select(*CELL, face.alias("f")).select(*CELL, "f.face", *[(F.col(c) + F.col(f"f.d{c}")).alias(f"n{c}") for c in "xyz"])
    there = cells.select(*[F.col(c).alias(f"n{c}") for c in "xyz"], "level")
    return probes.join(there, ["nx", "ny", "nz", "level"])


def probed(cells: DataFrame, *more: str) -> DataFrame:
    """For each cell and face, the cell that holds the point beyond it: x, y, z, level, face, nx, ny, nz, n_level, and each
    further column of both (the neighbour's with ``n_`` before). Few rows a cell move, whatever the number of levels."""
    return neighbours(cells, more)


def mixed_neighbours(cells: DataFrame, levels: list[int] | None = None) -> DataFrame:
    """For each cell and face, the level of the cell that holds the point beyond it. ``levels`` need not be known any more."""
    return probed(checkpointed(cells.select(*CELL))).select(*CELL, "face", "n_level")


def with_will(cells: DataFrame) -> DataFrame:
    """The level that each cell will have when its flag is followed."""
    return cells.select(*CELL, (F.col("level") + (F.col("flag") > 0).cast("int")).alias("will"))


def unbalanced(cells: DataFrame) -> DataFrame:
    """Cells with a face neighbour that is (or will be, by its flag) finer by two levels or more. Seen from the finer cell: the
    cell beyond each of its faces is the one that may have to be split."""
    found = probed(with_will(cells), "will").where("n_level < level and will >= n_will + 2")
    return found.select(*[F.col(n).alias(c) for c, n in zip(CELL, FOUND, strict=True)]).distinct()


def unbalanced_by_probes(cells: DataFrame) -> DataFrame:
    """The same by one probe point a face, seen from the coarser cell: the point beyond its lowest corner. Finer cells that do
    not touch that corner are not seen."""
    return probed(with_will(cells), "will").where("n_will >= will + 2").select(*CELL).distinct()


#: Ways to find cells that break the 2:1 rule: all faces of all finer cells, or one probe a face.
MODES = {"strict": unbalanced, "probe": unbalanced_by_probes}


def balance_round(cells: DataFrame, levels: list[int] | None = None, most: int = curves.FINEST, mode: str = "strict") -> DataFrame:
    """Cells with flags raised to 1 where a neighbour would be finer by two levels: one round of the 2:1 rule. ``cells`` is
    read several times: give a stored table. ``levels`` need not be known any more."""
    mark = unused("unbalanced", cells)
    bad = MODES[mode](cells).withColumn(mark, F.lit(True))
    can = F.coalesce(mark, F.lit(False)) & (F.col("state") == 0) & (F.col("level") < most) & (F.col("flag") <= 0)
    return cells.join(bad, CELL, "left").withColumn("flag", F.when(can, F.lit(1)).otherwise(F.col("flag"))).select(*cells.columns)


def balance(cells: DataFrame, most: int = curves.FINEST, rounds: int = 10, mode: str = "strict") -> tuple[DataFrame, bool]:
    """Rounds until no flag changes; and whether that was reached. Each round's mesh is a checkpoint. Flags spread to coarser
    cells only, so ten rounds are enough for nine levels."""
    now = checkpointed(cells)
    flagged = now.where("flag > 0").count()
    for _ in range(rounds):
        now = checkpointed(balance_round(now, None, most, mode))
        new = now.where("flag > 0").count()
        if new == flagged:
            return now, True
        flagged = new
    return now, False


# --- what a balanced cycle does ---

BESIDE = FOUND
PARENT = ["gx", "gy", "gz"]


def as_own(pairs: DataFrame, *more: str) -> DataFrame:
    """The neighbours of pairs, as cells."""
    return pairs.select(*[F.col(n).alias(c) for c, n in zip(CELL, BESIDE, strict=True)], *more)


def held_back(state: DataFrame, pairs: DataFrame) -> DataFrame:
    """Cells that must not split: those that cannot, and those beside a coarser one that must not, or is coarser by two."""
    held = state.where("not can").select(*CELL)
    steep = pairs.where("level > n_level + 1").select(*CELL)
    new = checkpointed(held.unionByName(steep).distinct())
    every = new
    coarser = pairs.where("level > n_level").select(*CELL, *BESIDE)
    while True:
        beside = coarser.join(new.toDF(*BESIDE), BESIDE).select(*CELL).distinct()
        new = checkpointed(beside.join(every, CELL, "left_anti"))
        if not new.limit(1).count():
            return every
        every = checkpointed(every.unionByName(new))


def decided(cells: DataFrame, most: int = curves.FINEST, least: int = 1, marks: bool = False) -> tuple[DataFrame, int]:
    """Cells with the flags that keep the mesh balanced when they are followed: 1 for every cell that splits, -1 for the eight of
    every group that merges, else 0; and how many neighbours would still be two levels apart (none, if the mesh was balanced
    before).

    Two kinds of decisions are changed, each for good, so that rounds end: a cell is raised to split, and a group of siblings,
    as a unit, gives up merging. The coarser of two neighbours gives way: its group is vetoed if it was to merge, else it is
    split. Beforehand, splits beside cells that can never follow (solid ones) are given up. Each round after the first looks
    at the neighbours of what the round before changed, and at no others.

    Rounds hold only neighbours that can come two levels apart (``steps``) and their cells. All other cells keep what they ask
    for, or 0 where they cannot split or their group is not whole: of the whole mesh, two stored tables are all that is written.
    """
    base = stored(cells)
    can = (F.col("state") == 0) & (F.col("level") < most)
    bit = lambda told, value: F.when(told, value).otherwise(0)
    pairs = stored(steps(base, bit(asks_to_merge(least), ASKS) + bit(splits(most), SPLITS) + bit(can, CAN)))
    group = [curves.parent(c).alias(g) for c, g in zip("xyz", PARENT, strict=True)]
    ends = pairs.select(*CELL, *MAY).unionByName(pairs.select(*[F.col(n).alias(c) for c, n in zip((*CELL, *MAY), (*BESIDE, *[f"n_{c}" for c in MAY]), strict=True)]))
    state = stored(ends.groupBy(*CELL).agg(*[F.coalesce(F.max(c), F.lit(False)).alias(c) for c in MAY]).select(*CELL, *group, *MAY))
    pairs = pairs.select(*CELL, *BESIDE)
    held = held_back(state, pairs).withColumn("held", F.lit(True))
    will = F.when(F.col("splits") & F.col("held").isNull(), F.col("level") + 1).when(F.col("merging"), F.col("level") - 1).otherwise(F.col("level"))
    state = checkpointed(state.join(held, CELL, "left").select(*CELL, *PARENT, (F.col("can") & F.col("held").isNull()).alias("can"), "splits", "merging", F.col("merging").alias("asked"), will.alias("will"), F.lit(True).alias("changed")))

    even = False
    for first in (True, *[False] * (4 * (most + 2))):
        ask = pairs
        if not first:
            moved = state.where("changed").select(*CELL)
            ask = pairs.join(moved, CELL, "left_semi").unionByName(pairs.join(moved.toDF(*BESIDE), BESIDE, "left_semi").select(*CELL, *BESIDE)).distinct()
        levels = state.select(*CELL, "will")
        both = ask.join(levels, CELL).join(levels.toDF(*BESIDE, "n_will"), BESIDE)
        low = both.where("n_will >= will + 2").select(*CELL).unionByName(as_own(both.where("will >= n_will + 2"))).distinct()
        low = checkpointed(low.join(state, CELL))
        if low.isEmpty():  # nothing gives way: the state stays; and as the first round looks at all, no neighbours are two apart
            even = first
            break
        veto = low.where("merging").select("level", *PARENT).distinct().withColumn("veto", F.lit(True))
        raised = low.where("not merging and can and will = level").select(*CELL).withColumn("raised", F.lit(True))
        veto_, raised_ = F.coalesce("veto", F.lit(False)) & F.col("merging"), F.coalesce("raised", F.lit(False))
        now = state.join(raised, CELL, "left").join(veto, ["level", *PARENT], "left")
        now = now.select(*CELL, *PARENT, "can", "splits", (F.col("merging") & ~veto_).alias("merging"), "asked", F.when(veto_, F.col("level")).when(raised_, F.col("level") + 1).otherwise(F.col("will")).alias("will"), (veto_ | raised_).alias("changed"))
        state = checkpointed(now)
        if not state.where("changed").limit(1).count():
            break
    else:
        raise RuntimeError("the mesh did not come into balance")
    levels = state.select(*CELL, "will")
    left = 0 if even else pairs.join(levels, CELL).join(levels.toDF(*BESIDE, "n_will"), BESIDE).where("abs(will - n_will) > 1").count()
    told, asked, was = (unused(c, base) for c in ("told", "asked", "was"))
    flag, follows = F.when(F.col("will") > F.col("level"), 1).when(F.col("merging"), -1).otherwise(0), bit(F.col("splits"), 1)
    others = stored(state.where(F.col("asked") | (flag != follows)).select(*CELL, flag.alias(told), F.col("asked").alias(asked)))
    out = base.withColumn(was, F.col("flag")).join(others, CELL, "left")
    out = out.withColumn("flag", F.coalesce(told, bit(splits(most), 1)).cast(dict(base.dtypes)["flag"]))
    if not marks:
        return out.select(*base.columns), left
    marked = {MARKS[0]: (F.col("flag") > 0) & (F.col(was) <= 0), MARKS[1]: F.coalesce(asked, F.lit(False)) & (F.col("flag") != -1)}
    return out.withColumns(marked).select(*base.columns, *MARKS), left


def trilinear(cells: DataFrame, value: str) -> DataFrame:
    """Of each parent octet that has a cell: the sum of an eighth of each corner's value; missing corners count nothing."""
    fine = cells.select(*[curves.parent(c).alias(f"p{c}") for c in "xyz"], "level").distinct()
    corner = F.explode(F.sequence(F.lit(0), F.lit(7)))
    probes = fine.withColumn("corner", corner).select("level", "px", "py", "pz", *[(F.col(f"p{c}") + curves.bit("corner", k)).cast("int").alias(c) for k, c in enumerate("xyz")])
    joined = probes.join(cells.select(*CELL, value), CELL, "left")
    return joined.groupBy("level", "px", "py", "pz").agg((F.sum(F.coalesce(F.col(value), F.lit(0))) / 8).alias("value"))


# --- numbering ---


def numbered(df: DataFrame, by: list, name: str = "number") -> DataFrame:
    """Rows numbered 0, 1, 2... in order of ``by``, which must tell rows apart. No window over all rows: rows are dealt by
    range, numbered within their partition, and moved by the counts of the partitions before, one row each."""
    session = df.sparkSession
    n = int(session.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(n, *by).sortWithinPartitions(*by).withColumn("__at", F.monotonically_increasing_id())
    dealt = checkpointed(dealt.withColumn("__part", F.shiftright("__at", 33)))
    counts = dealt.groupBy("__part").agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.withColumn("__base", F.coalesce(F.sum("__n").over(before), F.lit(0))).select("__part", "__first", "__base")
    return dealt.join(F.broadcast(base), "__part").withColumn(name, F.col("__at") - F.col("__first") + F.col("__base")).drop("__at", "__part", "__first", "__base")


def running_total(df: DataFrame, by: list, value: str, name: str = "before") -> DataFrame:
    """The sum of ``value`` over all rows before, in order of ``by``: an exclusive scan in two passes."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = checkpointed(df.repartitionByRange(n, *by).withColumn("__part", F.spark_partition_id()))
    own = Window.partitionBy("__part").orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy("__part").agg(F.sum(value).alias("__sum"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.withColumn("__base", F.coalesce(F.sum("__sum").over(before), F.lit(0))).select("__part", "__base")
    out = dealt.withColumn("__own", F.coalesce(F.sum(value).over(own), F.lit(0))).join(F.broadcast(base), "__part")
    return out.withColumn(name, F.col("__own") + F.col("__base")).drop("__part", "__own", "__base")


def permutation(df: DataFrame, key: str, active: Column) -> DataFrame:
    """Each row's place among the active rows in key order; null for the others."""
    placed = numbered(df.where(active & F.col(key).isNotNull()), [key], "place").select(key, "place")
    return df.join(placed, key, "left")
