"""Bounds of key ranges: from one pass that keeps a mergeable sketch, and looked up as a constant."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.functions.curves import col


def place_in(key: Column | str, bounds: list[int]) -> Column:
    """How many of the sorted bounds are at most the key: looked up in groups of bounds, then in one group."""
    if not bounds:
        return F.lit(0)
    size = max(1, math.isqrt(len(bounds)))
    groups = [bounds[i : i + size] for i in range(0, len(bounds), size)]
    constant = lambda values, kind: F.from_json(F.lit(json.dumps(values)), kind)
    upto = F.size(F.filter(constant([g[0] for g in groups], "array<bigint>"), lambda b: b <= col(key)))
    inside = F.size(F.filter(F.get(constant(groups, "array<array<bigint>>"), upto - 1), lambda b: b <= col(key)))
    return F.when(upto == 0, F.lit(0)).otherwise((upto - 1) * size + inside)


def key_bounds(rows: DataFrame, key: str, parts: int | None = None) -> list[int]:
    """Keys of rows that cut them into near equal ranges, as many as a shuffle has partitions: the quantile sketches of all
    tasks, merged. Only the bounds reach the driver."""
    n = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if n < 2:
        return []
    cuts = [k / n for k in range(1, n)]
    got = rows.agg(F.percentile_approx(key, cuts, max(10_000, 20 * n)).alias("cuts")).first()["cuts"]
    return sorted(set(got or []))


#: Bits that one pass tells apart; bins that travel as constants.
STEP, FEW = 12, 10_000


def weight_splits(rows: DataFrame, key: str, weight: str, ranks: int, tolerance: float = 0.0) -> list[int]:
    """Keys that cut the rows (keys and weights are whole numbers) into ``ranks`` ranges of near equal weight, without a sort.

    Each task keeps the weights of up to 4096 ranges of keys; these sketches add up to one. A range that holds a place where
    the rows have to be cut is told apart further in the next pass, which reads only rows of such ranges, until a range has
    one key, or at most ``tolerance`` of a rank's share. The k-th split is the first key (or range) before which k shares
    have passed: no rank has more than its share, the tolerance, and one key. The driver has ranges and their weights,
    4096 for each split at most. Null keys and weights do not count.
    """
    own = rows.select(F.col(key).cast("long").alias("k"), F.col(weight).cast("long").alias("w")).where("k is not null and w is not null")
    ends = own.agg(F.min("k").alias("low"), F.max("k").alias("high"), F.sum(F.col("w").cast("decimal(38,0)")).alias("total")).first()
    if ends["low"] is None or not ends["total"] or ranks < 2:
        return []
    low, total, width = ends["low"], int(ends["total"]), (ends["high"] - ends["low"]).bit_length()
    share = tolerance * total / ranks
    asked = dict.fromkeys(range(1, ranks), (0, 0))  # of each split: the range it lies in, and the weight before that
    found, shift, was = {}, width, width
    while asked:
        was, shift = shift, max(0, shift - STEP)
        inside = sorted({r for r, _ in asked.values()})
        offset = F.col("k") - F.lit(low)
        held = own if was >= width else among(own, F.shiftright(offset, was), inside)
        binned = held.groupBy(F.shiftright(offset, shift).alias("bin")).agg(F.sum(F.col("w").cast("decimal(38,0)")).alias("w")).collect()
        by: dict[int, list[tuple[int, int]]] = {}
        for r in binned:
            by.setdefault(r["bin"] >> (was - shift), []).append((r["bin"], int(r["w"])))
        for k, (range_, before) in list(asked.items()):
            for b, w in sorted(by[range_]):
                if before * ranks >= k * total:  # k shares have passed
                    found[k] = low + (b << shift)
                    break
                if (before + w) * ranks >= k * total and shift and w > share:
                    asked[k] = (b, before)
                    break
                before += w
            else:
                found[k] = low + ((range_ + 1) << was)
            if k in found:
                del asked[k]
    return [found[k] for k in sorted(found)]


def among(rows: DataFrame, value: Column, some: list[int]) -> DataFrame:
    """Rows whose value is one of some: as a constant, or joined where these are many."""
    if len(some) <= FEW:
        return rows.where(value.isin(some))
    wanted = rows.sparkSession.createDataFrame([(x,) for x in some], "one_of long")
    return rows.join(wanted, value == F.col("one_of"), "left_semi")
