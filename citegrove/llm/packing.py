"""Filling fixed-capacity containers: harmonic packing by reciprocal-capacity classes, rooms left in bins topped up by best fit."""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citegrove.plans.materialize import ship, spread

#: Pieces of one bin kind that are packed together in one shard, about; shards don't know of each other, and each is one task's.
SHARD_ITEMS = 25_000


def cut_pieces(items: DataFrame, key: str, size: str, capacity: Column) -> DataFrame:
    """items with piece and size: an item within the capacity is piece 0; a longer one is cut into full pieces and the rest.

    Items of null or no size have no piece.
    """
    n = F.ceil(F.col(size) / capacity).cast("int")
    cut = items.filter(F.col(size) > 0).select("*", F.explode(F.sequence(F.lit(0), n - 1)).alias("piece"))
    return cut.withColumn("size", F.least(capacity, F.col(size) - F.col("piece") * capacity))


def fill_bins(sizes: list[int], capacity: int) -> list[int]:
    """The bin of each piece; sizes are in falling order and not above capacity.

    A size in (capacity / (k + 1), capacity / k] is of class k, and k pieces of that class always fit together. Class by class, from
    the widest on, a piece goes where it leaves the least room among the bins of the classes before; those that fit nowhere make bins of
    their class, k to each, so that every such bin but a class's last is filled to k / (k + 1) at least.
    """
    into = [0] * len(sizes)
    rooms: dict[int, list[int]] = {}
    present: list[int] = []  # the rooms that some bin has, rising
    n_bins = 0

    def leave(room: int, at: int) -> None:
        if room > 0:
            if room in rooms:
                rooms[room].append(at)
            else:
                rooms[room] = [at]
                insort(present, room)

    i = 0
    while i < len(sizes):
        k = capacity // sizes[i]
        own = []
        while i < len(sizes) and capacity // sizes[i] == k:
            s = sizes[i]
            j = bisect_left(present, s)
            if j < len(present):
                room = present[j]
                into[i] = rooms[room].pop()
                if not rooms[room]:
                    del rooms[room], present[j]
                leave(room - s, into[i])
            else:
                own.append(i)
            i += 1
        for first in range(0, len(own), k):
            used = 0
            for m in own[first : first + k]:
                into[m] = n_bins
                used += sizes[m]
            leave(capacity - used, n_bins)
            n_bins += 1
    return into


def pack(pieces: DataFrame, bin_kind: str, key: str) -> DataFrame:
    """pieces (bin_kind, key, piece, size, capacity; 0 < size <= capacity) with container, a number within bin_kind.

    Pieces are dealt to shards by their hash, as many as there are SHARD_ITEMS, and each shard is packed by fill_bins. An empty table
    gives no rows; equal pieces and repeated keys are packed one by one. All pieces of a bin kind have one capacity; a kind with
    several is packed as several. Container numbers hold 24 bits of shard, 8 of the capacity's number and 31 of the bin.
    """
    ship(pieces.sparkSession)
    wanted = pieces.columns
    kinds = pieces.groupBy(bin_kind, "capacity").agg(F.count(F.lit(1)).alias("_n"))
    several = F.dense_rank().over(Window.partitionBy(bin_kind).orderBy("capacity")) - 1
    shards = kinds.select(F.col(bin_kind).alias("_kind"), F.col("capacity").alias("_capacity"), F.ceil(F.col("_n") / F.lit(SHARD_ITEMS)).cast("long").alias("_shards"), several.cast("long").alias("_which"))
    # one row a kind: joined by broadcast where the planner sees that they are few
    same = pieces[bin_kind].eqNullSafe(F.col("_kind")) & (F.col("capacity") == F.col("_capacity"))
    dealt = pieces.join(shards, same).withColumn("_shard", F.pmod(F.xxhash64(key, "piece", "size"), F.col("_shards"))).select(*wanted, "_which", "_shard")

    def fill(t: pa.Table) -> pa.Table:
        t = t.sort_by([("size", "descending"), (key, "ascending"), ("piece", "ascending")])
        bins = np.array(fill_bins(t["size"].to_pylist(), t["capacity"][0].as_py()), np.int64)
        shard, which = t["_shard"][0].as_py(), t["_which"][0].as_py()
        if shard >= 1 << 24 or which >= 1 << 8:
            raise ValueError("more shards or capacities of a bin kind than a container's number can hold")
        return t.select(wanted).append_column("container", pa.array(bins + (shard << 39) + (which << 31), pa.int64()))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", container long"
    return spread(dealt, bin_kind, "_which", "_shard").groupBy(bin_kind, "_which", "_shard").applyInArrow(fill, schema)
