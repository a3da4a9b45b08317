"""Joins that no frequent key can clog, and groups of rows that share keys directly or through others."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citegrove.plans.materialize import settle, ship

#: A value in more than one row of so many meets the dictionary by broadcast; there are at most that many such values.
HEAVY_SHARE = 64
#: Values in fewer rows than this are never frequent, however small the table.
HEAVY_FLOOR = 1000
#: Edges of a graph that one task finishes by itself.
ONE_TASK = 100_000


def join_skewed(rows: DataFrame, book: DataFrame, on: list[str], n_rows: int) -> DataFrame:
    """rows joined with book on the columns on; book has one row a value and the value's number of rows as n.

    Values with n above n_rows / HEAVY_SHARE are joined from a broadcast list (at most HEAVY_SHARE values, of whatever table),
    the others by a shuffle join in which no key has more rows than that.
    """
    heavy_from = max(HEAVY_FLOOR, n_rows // HEAVY_SHARE)
    if n_rows < heavy_from:
        return rows.join(book.drop("n"), on)
    more = [c for c in book.columns if c not in (*on, "n")]
    heavy = book.filter(F.col("n") >= heavy_from).select(*on, F.struct(*more).alias("_heavy"))
    met = rows.join(F.broadcast(heavy), on, "left")
    own = rows.columns
    frequent = met.filter("_heavy is not null").select(*own, *(F.col(f"_heavy.{c}").alias(c) for c in more))
    others = met.filter("_heavy is null").select(*own).join(book.filter(F.col("n") < heavy_from).drop("n"), on)
    return frequent.unionByName(others)


def connected(edges: DataFrame) -> DataFrame:
    """(node, first): of each node (a number) that shares a key with another, directly or through others, the smallest node of them all.

    edges: node and key (a string), distinct. Each round gives every node that still shares a key the neighbour of the least random number, or that
    one's own, then makes one node of those with the same. Keys of one node only drop out, so finished groups do too, and what is
    left shrinks by a part of itself each round. As soon as no more than ONE_TASK edges are left, one task finishes them. The rounds' steps are put together
    at the end. Nodes and keys of many edges are joined from short broadcast lists. An empty table gives no rows.
    """
    steps, left, number = [], edges, 0
    while True:
        left = settle(left)
        n_edges = left.count()
        if n_edges <= ONE_TASK:
            if n_edges:
                ship(edges.sparkSession)
                steps.append(settle(left.select(F.col("node").cast("long"), "key").coalesce(1).mapInArrow(_united, "node long, to long")))
            break
        busy = left.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(F.xxhash64("node", F.lit(number)).alias("at"), "node")).alias("low")).filter("n > 1")
        left = settle(join_skewed(left, settle(busy), ["key"], n_edges))
        near = settle(left.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min("low").alias("low")).select("node", "n", F.col("low.node").alias("to")))
        jump = near.groupBy("to").agg(F.count(F.lit(1)).alias("n")).join(near.select(F.col("node").alias("to"), F.col("to").alias("next")), "to")
        near = settle(join_skewed(near.select("node", F.col("n").alias("edges"), "to"), jump, ["to"], n_edges).select("node", F.col("edges").alias("n"), F.col("next").alias("to")))
        steps.append(near.select("node", "to"))
        left = join_skewed(left.select("node", "key"), near, ["node"], n_edges).select(F.col("to").alias("node"), "key").distinct()
        number += 1
    if not steps:
        return edges.filter("false").select("node", F.col("node").alias("first"))
    whole = steps[-1]
    for step in reversed(steps[:-1]):
        last = whole.select(F.col("node").alias("to"), F.col("to").alias("root"))
        many = step.groupBy("to").agg(F.count(F.lit(1)).alias("n"))
        whole = settle(join_skewed(step, last.join(many, "to"), ["to"], step.count()).select("node", F.col("root").alias("to")).unionByName(step.join(last, "to", "left_anti").select("node", "to")))
    if len(steps) == 1 and number == 0:
        return whole.select("node", F.col("to").alias("first"))
    least = settle(whole.groupBy("to").agg(F.least(F.min("node"), F.first("to")).alias("first"), F.count(F.lit(1)).alias("n")))
    return join_skewed(whole, least, ["to"], whole.count()).select("node", "first")


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, to): each node that shares a key with another, and the smallest of its group; the edges all in one task."""
    parent: dict[int, int] = {}
    holder: dict[str, int] = {}

    def find(x: int) -> int:
        root = x
        while parent[root] != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    shared = set()
    for b in batches:
        for node, key in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            parent.setdefault(node, node)
            other = holder.setdefault(key, node)
            if other != node:
                shared.update((node, other))
                x, y = find(node), find(other)
                parent[max(x, y)] = min(x, y)
    nodes = sorted(shared)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], names=["node", "to"])
