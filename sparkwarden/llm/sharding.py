"""Sharding: cut an ordered row of atomic groups into contiguous shards whose largest is as small as can be.

The smallest feasible capacity is found by binary search; a capacity is feasible
if taking groups greedily needs no more than ``shards`` shards, and the greedy
cuts at the smallest capacity are the result (so the first shards are the fuller
ones, and trailing shards may be unused).

The groups stay in a table, ordered and numbered in blocks of ``block`` groups.
The driver holds one sum per block.  With them alone most capacities are decided:
a capacity is feasible if it is when every shard stops at a block boundary, and
infeasible if it is not even when groups could be cut.  Only for those between
does the check read groups, one block per cut, of which a bounded number is kept.

A group is all rows of one key; its size is the sum of theirs.

Edge cases.  A null key is a group of its own, which comes first; null, empty and
negative sizes count as 0; rows with the same key are never parted; an empty table
gives no rows; fewer groups than shards leave shards unused; fewer than one shard is a ``ValueError``; extra columns are
ignored.
"""

from __future__ import annotations

from collections import OrderedDict

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import stored

BLOCK = 1 << 16


class Groups:
    """Sizes of ordered groups: ``sums`` of all blocks at hand, the groups of a block on demand."""

    def __init__(self, sums: np.ndarray, counts: np.ndarray, fetch, keep: int = 64):
        self.before = np.append(0, np.cumsum(sums))
        self.first = np.append(0, np.cumsum(counts))
        self.fetch, self.keep = fetch, keep
        self.held: OrderedDict[int, np.ndarray] = OrderedDict()

    @property
    def total(self) -> int:
        return int(self.before[-1])

    def inside(self, block: int) -> np.ndarray:
        """Running sums within a block."""
        if block not in self.held:
            if len(self.held) >= self.keep:
                self.held.popitem(last=False)
            self.held[block] = np.cumsum(self.fetch(block))
        self.held.move_to_end(block)
        return self.held[block]

    def cuts(self, capacity: int, most: int) -> list[int] | None:
        """Where shards end under ``capacity``, greedily; None if that takes more than ``most``."""
        out, done, n = [], 0, int(self.first[-1])
        while (out[-1] if out else 0) < n:
            if len(out) == most:
                return None
            block = int(np.searchsorted(self.before, done + capacity, "right")) - 1
            if block >= len(self.before) - 1:
                out.append(n)
                break
            sums = self.inside(block)
            here = int(np.searchsorted(sums, done + capacity - int(self.before[block]), "right"))
            end = int(self.first[block]) + here
            if end <= (out[-1] if out else 0):
                return None  # one group alone is larger
            out.append(end)
            done = int(self.before[block]) + (int(sums[here - 1]) if here else 0)
        return out

    def by_blocks(self, capacity: int, most: int) -> bool:
        """Whether shards that end at block boundaries do; if so, greedy cuts do."""
        done, used = 0, 0
        while done < len(self.before) - 1:
            end = int(np.searchsorted(self.before, self.before[done] + capacity, "right")) - 1
            if end <= done or used == most:
                return False
            done, used = end, used + 1
        return True


def smallest_capacity(groups: Groups, largest: int, shards: int) -> int:
    """The least capacity that ``shards`` shards can hold."""
    lo, hi = max(largest, -(-groups.total // shards)), max(largest, groups.total)
    while lo < hi:
        middle = (lo + hi) // 2
        if groups.by_blocks(middle, shards) or groups.cuts(middle, shards) is not None:
            hi = middle
        else:
            lo = middle + 1
    return lo


def shard(df: DataFrame, key: str = "doc_id", size: Column | None = None, shards: int = 64, block: int = BLOCK) -> DataFrame:
    """``<key>, group_size, shard`` for every group of ``df``, in the order of ``key``.

    ``size``: a row's size, the bytes of its ``text`` by default.  One shuffle, of keys
    and sizes, puts groups in order; texts are never moved."""
    if shards < 1:
        raise ValueError("there must be one shard at least")
    spark = df.sparkSession
    size = F.octet_length(df["text"]) if size is None else size
    rows = df.select(df[key].alias("k"), F.greatest(F.coalesce(size.cast("long"), F.lit(0)), F.lit(0)).alias("n"))
    sums = rows.groupBy("k").agg(F.sum("n").alias("n"))
    ordered = stored(sums.repartitionByRange(F.col("k").asc_nulls_first()).sortWithinPartitions(F.col("k").asc_nulls_first()).select("k", "n", F.spark_partition_id().alias("p"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("i")), "groups")
    block_of = F.struct(F.col("p"), F.floor(F.col("i") / F.lit(block)).cast("long").alias("b"))
    blocks = ordered.groupBy(block_of.alias("x")).agg(F.sum("n").alias("s"), F.count(F.lit(1)).alias("c"), F.max("n").alias("m")).orderBy("x").select("x.p", "x.b", "s", "c", "m").collect()
    if not blocks:
        return ordered.select(F.col("k").alias(key), F.col("n").alias("group_size"), F.lit(0).alias("shard"))

    def fetch(j: int) -> np.ndarray:
        p, b = blocks[j]["p"], blocks[j]["b"]
        part = ordered.where((F.col("p") == p) & (F.col("i") >= b * block) & (F.col("i") < (b + 1) * block))
        return part.select("i", "n").toPandas().sort_values("i")["n"].to_numpy(np.int64)

    groups = Groups(np.array([r["s"] for r in blocks], np.int64), np.array([r["c"] for r in blocks], np.int64), fetch)
    capacity = smallest_capacity(groups, max(r["m"] for r in blocks), shards)
    ends = np.array(groups.cuts(capacity, shards), np.int64)
    # Each cut as (partition, place in it): a short table, at most one row a shard.
    at = np.searchsorted(groups.first, ends, "right") - 1
    bounds = []
    for end, j in zip(ends[:-1].tolist(), at[:-1].tolist(), strict=True):
        row = blocks[j]
        bounds.append((row["p"], row["b"] * block + end - int(groups.first[j])))
    place = F.struct(F.col("p"), F.col("i").alias("i"))
    cut_type = T.ArrayType(T.StructType([T.StructField("p", T.IntegerType()), T.StructField("i", T.LongType())]))
    cuts = spark.createDataFrame([(bounds,)], T.StructType([T.StructField("cuts", cut_type)]))
    return ordered.crossJoin(F.broadcast(cuts)).select(F.col("k").alias(key), F.col("n").alias("group_size"), F.size(F.filter("cuts", lambda c: c <= place)).alias("shard"))
