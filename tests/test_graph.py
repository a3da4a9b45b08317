import random

import pytest

from citegrove.operators import graph


@pytest.mark.parametrize("one_task", [0, 40, 100_000])
def test_connected(spark, monkeypatch, one_task):
    """Chains, stars and cliques against union-find, with hot keys and nodes by broadcast; an empty table has none."""
    monkeypatch.setattr(graph, "HEAVY_FLOOR", 4)
    monkeypatch.setattr(graph, "ONE_TASK", one_task)
    rng = random.Random(9)
    edges = {(i, f"c{j}") for i in range(100, 140) for j in (i, i + 1)} | {(i, "hub") for i in range(0, 60, 3)} | {(rng.randrange(200, 300), f"k{rng.randrange(90)}") for _ in range(150)} | {(999, "alone")}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for n, k in sorted(edges):
        parent[find(k)] = find(n)
    members = {}
    for n in {n for n, _ in edges}:
        members.setdefault(find(n), set()).add(n)
    want = {n: min(g) for g in members.values() if len(g) > 1 for n in g}
    df = spark.createDataFrame(sorted(edges), "node long, key string")
    assert {r["node"]: r["first"] for r in graph.connected(df).collect()} == want
    assert graph.connected(df.filter("false")).count() == 0


def test_join_skewed(spark, monkeypatch):
    monkeypatch.setattr(graph, "HEAVY_FLOOR", 5)
    rows = [(i, "hot" if i % 2 else f"k{i % 40}") for i in range(200)]
    df = spark.createDataFrame(rows, "i long, k string")
    book = spark.createDataFrame([("hot", 100, 1), ("k2", 5, 2), ("none", 1, 3)], "k string, n long, v long")
    assert sorted(map(tuple, graph.join_skewed(df, book, ["k"], 200).collect())) == sorted((k, i, v) if False else (i, k, v) for i, k in rows for kk, _, v in [("hot", 0, 1), ("k2", 0, 2)] if kk == k)
