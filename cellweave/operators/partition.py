"""Partitions of a cell table along a curve key: owners, topology, imbalance, split points, transfers, halo rows."""

from __future__ import annotations

import heapq
import json
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellweave.functions.curves import col
from cellweave.operators import mesh, series
from cellweave.operators.partition_bounds import place_in
from cellweave.operators.session import checkpointed, unused


#: Ranges that travel as constants; with more of them the join is Spark's.
FEW = 10_000


def owner_of_splits(key: Column | str, splits: list[int]) -> Column:
    """The first range whose upper split lies above the key; the last one beyond all splits. Splits are few: one a rank."""
    return place_in(key, sorted(splits))


def linear_splits(low: int, high: int, count: int, ranks: int) -> list[int]:
    """Split keys at equal shares of the key range, as if keys were evenly spread."""
    share = count // ranks
    return [int(low + (k * share / count) * (high - low)) for k in range(1, ranks)] if count else []


def owner_ranges(cells: DataFrame, rank: str = "rank", key: str = "key") -> DataFrame:
    """Of each rank: its first and last key, its number of cells, and the ranks before and after (null at the ends)."""
    by = Window.orderBy(rank)  # one row a rank
    out = cells.groupBy(rank).agg(F.min(key).alias("first_key"), F.max(key).alias("last_key"), F.count("*").alias("n"))
    return out.withColumn("previous", F.lag(rank).over(by)).withColumn("next", F.lead(rank).over(by))


def segments(ranges: list[tuple[int, int, int]]) -> tuple[list[int], list[int]]:
    """Closed ranges (first, last, rank) as starts of segments, and each segment's lowest rank, -1 where none is."""
    edges = sorted({e for first, last, _ in ranges for e in (first, last + 1)})
    begins, ends = {}, {}
    for first, last, rank in ranges:
        begins.setdefault(first, []).append(rank)
        ends.setdefault(last + 1, []).append(rank)
    open_: list[int] = []
    gone: Counter = Counter()
    owners = []
    for e in edges:
        gone.update(ends.get(e, ()))
        for rank in begins.get(e, ()):
            heapq.heappush(open_, rank)
        while open_ and gone[open_[0]]:
            gone[heapq.heappop(open_)] -= 1
        owners.append(open_[0] if open_ else -1)
    return edges, owners


def range_owner(keys: DataFrame, ranges: DataFrame, key: str = "key") -> DataFrame:
    """Keys with the lowest rank whose closed range holds them, else -1. Up to ``FEW`` ranges (one a rank) are looked up as a
    constant; more of them are joined."""
    hit = ranges.select(F.col("rank").alias("owner"), "first_key", "last_key")
    few = hit.limit(FEW + 1).collect()
    if len(few) <= FEW:
        edges, owners = segments([(r["first_key"], r["last_key"], r["owner"]) for r in few if r["first_key"] is not None])
        owner = F.get(F.from_json(F.lit(json.dumps([-1, *owners])), "array<int>"), place_in(key, edges))
        return keys.withColumn("owner", F.when(F.col(key).isNull(), F.lit(-1)).otherwise(owner))
    joined = keys.join(hit, F.col(key).between(F.col("first_key"), F.col("last_key")), "left")
    return joined.groupBy(*keys.columns).agg(F.coalesce(F.min("owner"), F.lit(-1)).alias("owner"))


def equal_ranks(cells: DataFrame, by: list[str], ranks: int, name: str = "rank") -> DataFrame:
    """Cells with a rank of near equal count, in order of ``by``: the first n mod ranks ranks have one more."""
    number = unused("number", cells)
    placed = mesh.numbered(cells, by, number)
    n = placed.agg(F.count("*").alias("total"))
    size, more = F.floor(F.col("total") / ranks), F.col("total") % ranks
    edge = more * (size + 1)
    rank = F.when(F.col(number) < edge, F.floor(F.col(number) / (size + 1))).otherwise(more + F.floor((F.col(number) - edge) / size))
    return placed.crossJoin(F.broadcast(n)).withColumn(name, rank.cast("int")).select(*cells.columns, name)  # one row


def moved_to(cells: DataFrame, rank: str, ranks: int, key: str = "key") -> DataFrame:
    """The table dealt to its ranks' parts, each in key order: the rows themselves move."""
    return cells.repartitionByRange(ranks, rank).sortWithinPartitions(rank, key)


def imbalance(counts: DataFrame, n: str = "n") -> DataFrame:
    """(largest - smallest) / mean; 0 without rows."""
    got = counts.agg(F.min(n).alias("smallest"), F.max(n).alias("largest"), F.avg(n).alias("mean"), F.count("*").alias("ranks"))
    return got.withColumn("imbalance", F.when(F.coalesce(F.col("mean"), F.lit(0)) == 0, F.lit(0.0)).otherwise((F.col("largest") - F.col("smallest")) / F.col("mean")))


def rebalance_due(found: DataFrame, tolerance: float = 0.1, enabled: bool = True, since: int | None = None, interval: int = 0) -> DataFrame:
    """since: steps from the last rebalance on; before ``interval`` of them nothing is due."""
    allowed = enabled and (since is None or since >= interval)
    return found.withColumn("due", F.lit(allowed) & (F.col("imbalance") > tolerance))


def rebalances(history: DataFrame, tolerance: float = 0.1, interval: int = 1) -> DataFrame:
    """history: (step, rank, n). Of each step: its imbalance, the steps since the last rebalance, and whether one is due; one
    that is due starts the count again.

    What decides is one of few states: the steps since the last rebalance, up to ``interval``, beyond which they act alike. A
    run of steps is thus a map of the state before it to what is after it, and maps of neighbouring runs compose. Steps are dealt by range; each range's map comes from one pass, the maps (one row a range) are composed in
    order, and a second pass starts each range from its own state. No row grows with the number of steps.
    """
    each = history.groupBy("step").agg(F.min("n").alias("a"), F.max("n").alias("b"), F.avg("n").alias("mean"))
    each = each.select("step", F.when(F.col("mean") == 0, 0.0).otherwise((F.col("b") - F.col("a")) / F.col("mean")).alias("imbalance"))
    kind = dict(each.dtypes)["step"]
    n = int(history.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    over = F.coalesce(F.col("imbalance") > tolerance, F.lit(False))
    dealt = each.withColumn("over", over).repartitionByRange(n, "step").sortWithinPartitions("step").withColumn("part", F.spark_partition_id())
    dealt = checkpointed(dealt)

    def mapped(batches):
        """Of a range, for each state before it: the count after all steps, and whether it began anew within the range."""
        now, anew, part, length = np.arange(max(0, interval) + 1), np.zeros(max(0, interval) + 1, bool), None, 0
        for batch in batches:
            if batch.num_rows:
                part, length = batch.column(0)[0].as_py(), length + batch.num_rows
                for is_over in batch.column(1).to_numpy(zero_copy_only=False):
                    due = is_over & (now + 1 >= interval)
                    now, anew = np.where(due, 0, now + 1), anew | due
        if part is not None:
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "length": pa.array([length], pa.int64()), "counts": [now.tolist()], "anew": [anew.tolist()]})

    maps = {r["part"]: r for r in dealt.select("part", "over").mapInArrow(mapped, "part int, length long, counts array<long>, anew array<boolean>").collect()}  # a row a range
    begins, now = {}, 0
    for part in sorted(maps):
        begins[part], m, state = now, maps[part], min(now, max(0, interval))
        now = m["counts"][state] if m["anew"][state] else now + m["length"]

    def counted(batches):
        now = None
        for batch in batches:
            if batch.num_rows:
                if now is None:
                    now = begins[batch.column(3)[0].as_py()]
                since, due = [], []
                for over in batch.column(2).to_numpy(zero_copy_only=False):
                    since.append(now + 1)
                    due.append(bool(over) and now + 1 >= interval)
                    now = 0 if due[-1] else now + 1
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(since, pa.int32()), pa.array(due)], names=["step", "imbalance", "since", "due"])

    return dealt.select("step", "imbalance", "over", "part").mapInArrow(counted, f"step {kind}, imbalance double, since int, due boolean")


def migration(cells: DataFrame, old: str, new: str, key: str = "key") -> DataFrame:
    """What has to move: per (source, destination) the key range and the number of cells, counted cell by cell."""
    moved = cells.where(F.col(old) != F.col(new))
    return moved.groupBy(F.col(old).alias("source"), F.col(new).alias("destination")).agg(
        F.min(key).alias("first_key"), (F.max(key) + 1).alias("end_key"), F.count("*").alias("n")
    )


def valid_transfer(source="source", destination="destination", first="first_key", end="end_key", n="n") -> Column:
    return (col(source) >= 0) & (col(destination) >= 0) & (col(source) != col(destination)) & (col(end) > col(first)) & (col(n) > 0)


def plan_totals(transfers: DataFrame, total: int | None = None) -> DataFrame:
    """One row: cells to move, transfers, the time they take (0.001 ms a cell), and whether all are valid and add up to
    ``total``, if that is given. A plan without transfers is valid."""
    got = transfers.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("transfers"), F.coalesce(F.every(valid_transfer()), F.lit(True)).alias("all_valid"))
    fits = F.lit(True) if total is None else (F.col("n") == total) | (F.col("transfers") == 0)
    return got.select("n", "transfers", (F.col("n") * 0.001).alias("milliseconds"), (F.col("all_valid") & fits).alias("valid"))


def coalesced(transfers: DataFrame) -> DataFrame:
    """Transfers of the same pair that touch, as one; the rows have no order (``ordered`` gives one). The end of the transfer
    before and the start of an island are carried over ranges of rows, so that a pair of any size spreads."""
    pair, at = ["source", "destination"], ["first_key", "end_key"]
    rows = series.carried(series.dealt(transfers.select(*pair, *at, "n"), pair, at), pair, at, F.col("end_key"), "before", own=False)
    begins = F.when(F.coalesce(F.col("before") != F.col("first_key"), F.lit(True)), F.col("first_key"))
    marked = series.carried(rows.withColumn("begins", begins), pair, at, F.col("begins"), "island")
    return marked.groupBy(*pair, "island").agg(F.min("first_key").alias("first_key"), F.max("end_key").alias("end_key"), F.sum("n").alias("n")).drop("island")


def ordered(transfers: DataFrame) -> DataFrame:
    """Transfers in order of source, destination and key, over all partitions."""
    return transfers.orderBy("source", "destination", "first_key")


def halo_rows(cells: DataFrame, rank: str, fields: list[str]) -> DataFrame:
    """The rows that each rank needs from others: (rank, x, y, z, level, fields) of face neighbours that others own."""
    owned = cells.select(*mesh.CELL, F.col(rank).alias("to_rank"))
    near = mesh.face_neighbours(owned).join(owned, mesh.CELL)
    wanted = near.select("to_rank", *[F.col(f"n{c}").alias(c) for c in "xyz"], "level").distinct()
    there = cells.select(*mesh.CELL, F.col(rank).alias("from_rank"), *fields)
    return wanted.join(there, mesh.CELL).where("to_rank <> from_rank")


def pack_offset(cell: Column | str, component: Column | str, before_bytes: Column | str, capacity: int, width: int = 4) -> Column:
    """The byte of a value in a column-by-column buffer of ``capacity`` cells."""
    return col(before_bytes) * capacity + col(component) * width * capacity + col(cell) * width


def ghost_valid(start="start", end="end", target="target", offset="offset") -> Column:
    return (col(start) < col(end)) & (col(target) >= 0) & (col(offset) % 64 == 0)
