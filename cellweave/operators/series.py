"""Operators on series and measurements: interpolation, nearest match, error norms, histories, regressions, scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellweave.operators.session import checkpointed, unused


PART = "range_part"


def dealt(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Rows dealt by range of key and order, with the number of their part as a column (``part_of``): a key of any size, null
    too, spreads over many parts."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    taken = [c for c in df.columns if c.rstrip("_").lower() == PART]
    part = max(taken, key=len) + "_" if taken else PART
    return checkpointed(df.repartitionByRange(n, *by, *order).withColumn(part, F.spark_partition_id()))


def part_of(rows: DataFrame) -> str:
    """The column of ``dealt`` that numbers the parts: the one with most underscores, where a table has others of that name."""
    return max((c for c in rows.columns if c.rstrip("_").lower() == PART), key=len)


def carried(rows: DataFrame, by: list[str], order: list[str], value: Column, name: str, ahead: bool = False, own: bool = True) -> DataFrame:
    """rows: from ``dealt``. The last value that is not null of a key's rows before, in ``order`` (own: the row's own too), or
    with ``ahead`` the first one after. Null is a key like any other. No window goes over a whole key: each part has its own,
    and what comes from other parts is one row for each part of a key."""
    direction = F.desc if ahead else F.asc
    part = part_of(rows)
    within = Window.partitionBy(part, *by).orderBy(*map(direction, order)).rowsBetween(Window.unboundedPreceding, 0 if own else -1)
    here = rows.withColumn(name, F.last(value, ignorenulls=True).over(within))
    place = F.when(value.isNotNull(), F.struct(*order))
    edge = rows.groupBy(part, *by).agg((F.min_by if ahead else F.max_by)(value, place).alias("edge"))
    between = Window.partitionBy(*by).orderBy(direction(part)).rowsBetween(Window.unboundedPreceding, -1)
    other = edge.withColumn("other", F.last("edge", ignorenulls=True).over(between)).where("other is not null").select(part, *by, "other")
    there = {c: unused(f"of_{c}", here) for c in (part, *by)}
    found = unused("other", here)
    other = other.select(*[F.col(c).alias(n) for c, n in there.items()], F.col("other").alias(found))
    met = here.join(other, [F.col(c).eqNullSafe(F.col(n)) for c, n in there.items()], "left")
    return met.withColumn(name, F.coalesce(name, found)).select(*here.columns)


def merged(points: DataFrame, series: DataFrame, by: list[str], at: str, value: str | None) -> DataFrame:
    """Points and series in one table, dealt: of series rows ``__v`` is (t, v); points come after equal series rows."""
    empty = {c: F.lit(None).cast(t).alias(c) for c, t in points.dtypes if c not in (*by, at)}
    pair = F.struct(F.col(at).alias("t"), (F.col(value).cast("double") if value else F.lit(None).cast("double")).alias("v"))
    b = series.select(*[F.col(c) if c in (*by, at) else empty[c] for c in points.columns], pair.alias("__v"), F.lit(0).alias("__point"))
    a = points.select(*points.columns, F.lit(None).cast(b.schema["__v"].dataType).alias("__v"), F.lit(1).alias("__point"))
    return dealt(a.unionByName(b), by, [at])


def bracketed(points: DataFrame, series: DataFrame, by: list[str], at: str, value: str) -> DataFrame:
    """As-of interpolation without a range join: points and series are merged in one order; the point before and the point
    after are carried over. Outside the series its first or last value holds."""
    both = merged(points, series, by, at, value)
    got = carried(both, by, [at, "__point"], F.col("__v"), "__lo")
    got = carried(got.withColumn("__turn", -F.col("__point")), by, [at, "__turn"], F.col("__v"), "__hi", ahead=True).where("__point = 1")
    x, lo, hi = F.col(at).cast("double"), F.col("__lo"), F.col("__hi")
    between = lo["v"] + (x - lo["t"]) / (hi["t"] - lo["t"]) * (hi["v"] - lo["v"])
    found = F.when(lo.isNull(), hi["v"]).when(hi.isNull() | (hi["t"] == lo["t"]), lo["v"]).otherwise(between)
    return got.withColumn("value", found).select(*points.columns, "value")


def nearest(points: DataFrame, series: DataFrame, by: list[str], at: str) -> DataFrame:
    """Points with ``nearest``: the place of the series' nearest point, the earlier one of two, from one order of both."""
    both = merged(points, series, by, at, None)
    got = carried(both, by, [at, "__point"], F.col("__v.t"), "__lo")
    got = carried(got.withColumn("__turn", -F.col("__point")), by, [at, "__turn"], F.col("__v.t"), "__hi", ahead=True).where("__point = 1")
    lo, hi, x = F.col("__lo"), F.col("__hi"), F.col(at)
    found = F.when(lo.isNull(), hi).when(hi.isNull() | (x - lo <= hi - x), lo).otherwise(hi)
    return got.withColumn("nearest", found).select(*points.columns, "nearest")


def l2_error(found: Column, real: Column) -> Column:
    """Aggregate: the relative Euclidean error; 0 if there is nothing to relate to."""
    size = F.sum(real * real)
    return F.when(size < 1e-10, F.lit(0.0)).otherwise(F.sqrt(F.sum((found - real) * (found - real)) / size))


def linf_error(found: Column, real: Column) -> Column:
    return F.max(F.abs(found - real))


def spread(value: str) -> list[Column]:
    """Mean, population deviation, least and largest value."""
    return [F.avg(value).alias("mean"), F.stddev_pop(value).alias("deviation"), F.min(value).alias("least"), F.max(value).alias("most")]


def variation(value: str) -> Column:
    return F.stddev_pop(value) / F.avg(value)


def last_of(rows: DataFrame, by: list[str], newest: list, n: int = 5) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*newest)
    return rows.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")


def regressions(new: DataFrame, base: DataFrame, by: list[str], value: str, threshold: float = 0.05) -> DataFrame:
    """New values over their baseline by more than the threshold, with the change in percent."""
    joined = new.join(base, by).where(F.col(value) > F.col("baseline") * (1 + threshold))
    return joined.withColumn("percent", (F.col(value) / F.col("baseline") - 1) * 100)


def upserted(old: DataFrame, new: DataFrame, by: list[str]) -> DataFrame:
    """Both tables, the new row winning where both have a key."""
    return new.unionByName(old.join(new.select(*by).distinct(), by, "left_anti"))


def positional(a: DataFrame, b: DataFrame, by: list, value: str) -> DataFrame:
    """Two series joined by position, up to the shorter one."""
    from cellweave.operators.mesh import numbered

    one = numbered(a, by).select(F.col("number"), F.col(value).alias("a"))
    two = numbered(b, by).select(F.col("number"), F.col(value).alias("b"))
    return one.join(two, "number")


def hazards(accesses: DataFrame, by: list[str]) -> DataFrame:
    """Order dependencies of reads and writes: (by, kind, earlier, later).

    accesses: (by..., field, idx, reads, writes). Only the nearest are given: a read after the last write before it (RAW), a
    write after the last write before it (WAW), and a write after each read since that write (WAR); the others follow from
    them. Windows per field, no self-join of pairs.
    """
    w = Window.partitionBy(*by, "field").orderBy("idx")
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    last_write = F.last(F.when(F.col("writes"), F.col("idx")), ignorenulls=True).over(past)
    ahead = Window.partitionBy(*by, "field").orderBy(F.desc("idx")).rowsBetween(Window.unboundedPreceding, -1)
    next_write = F.last(F.when(F.col("writes"), F.col("idx")), ignorenulls=True).over(ahead)
    seen = accesses.withColumn("before", last_write).withColumn("after", next_write)
    pick = lambda kind, where, a, b: seen.where(where).select(*by, F.lit(kind).alias("kind"), F.col(a).alias("earlier"), F.col(b).alias("later"))
    return (
        pick("RAW", "reads and before is not null", "before", "idx")
        .unionByName(pick("WAW", "writes and before is not null", "before", "idx"))
        .unionByName(pick("WAR", "reads and after is not null", "idx", "after"))
        .distinct()
    )


def barriers(nodes: DataFrame, by: list[str]) -> DataFrame:
    """Neighbouring nodes of different level: where work has to wait for all before it."""
    w = Window.partitionBy(*by).orderBy("idx")
    seen = nodes.where("level >= 0").withColumn("earlier", F.lag("idx").over(w)).withColumn("was", F.lag("level").over(w))
    return seen.where("was is not null and was <> level").select(*by, "earlier", F.col("idx").alias("later"))
