"""Sums of floating-point numbers that are the same to the last bit on any partitioning.

A number is a whole multiple of a power of two. Numbers are dealt into bins by their size, eight binary orders each; within a
bin every number is a whole number of the bin's unit below 2**62, so that sums of a bin are exact (as decimals: up to 2**64
rows). What depends on no order then is added up in one order, from the smallest bin on. Sums combine before they move, and
a group has as many rows as it has bins: one or two, where its numbers are alike.

Defined cases: nulls do not count, and a group of nulls alone has null; NaN, or infinities of both signs, make NaN; zero of
either sign is zero; an empty table has no groups, or, without keys, one null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.operators.session import unused

#: Binary orders of a bin; the bits of a bin's smallest number.
ORDERS, LOW = 8, 54


def scaled(x: Column, by: Column) -> Column:
    """x times two to a power, in two steps, so that neither over- nor underflows before its time."""
    half = F.floor(by / 2)
    return x * F.pow(F.lit(2.0), half) * F.pow(F.lit(2.0), by - half)


def bin_of(x: Column) -> Column:
    """Null for zero and for what is not finite."""
    size = F.abs(x)
    finite = (size > 0) & (size < F.lit(float("inf"))) & ~F.isnan(x)
    return F.when(finite, F.floor(F.log2(size) / ORDERS)).cast("int")


def exact_sums(df: DataFrame, by: list[str], values: dict[str, Column | str]) -> DataFrame:
    """by, and for each name the sum of its values (as doubles) over the group."""
    kind, at, unit, total, odd = (unused(n, df) for n in ("which", "bin", "units", "total", "odd"))
    names = list(values)
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), (F.col(v) if isinstance(v, str) else v).cast("double").alias("v")) for i, v in enumerate(values.values())]))
    rows = df.select(*by, each.alias(kind)).select(*by, F.col(kind)["i"].alias(kind), F.col(kind)["v"].alias(unit)).withColumn(at, bin_of(F.col(unit)))
    x = F.col(unit)
    whole = F.when(F.col(at).isNotNull(), scaled(x, LOW - ORDERS * F.col(at)).cast("long")).when(x == 0, F.lit(0)).cast("decimal(38,0)")
    special = F.when(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), x)
    binned = rows.groupBy(*by, kind, at).agg(F.sum(whole).alias(total), F.sum(special).alias(odd))  # sums of infinities have no order
    part = F.when(F.col(at).isNull(), F.col(total).cast("double")).otherwise(scaled(F.col(total).cast("double"), ORDERS * F.col(at) - LOW))
    entry = F.when(part.isNotNull(), F.struct(F.coalesce(F.col(at), F.lit(-10_000)).alias("at"), part.alias("part")))
    parts = F.array_sort(F.collect_list(entry))  # a few bins
    added = F.when(F.size(parts) > 0, F.aggregate(parts, F.lit(0.0), lambda a, p: a + p["part"]))
    found = binned.groupBy(*by, kind).agg(F.sum(odd).alias(odd), added.alias(total))
    value = F.coalesce(odd, total)
    if not by:
        return found.agg(*[F.max(F.when(F.col(kind) == i, value)).alias(n) for i, n in enumerate(names)])
    return found.groupBy(*by).agg(*[F.max(F.when(F.col(kind) == i, value)).alias(n) for i, n in enumerate(names)])
