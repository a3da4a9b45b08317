"""All similar pairs of set-valued records: T-occurrence merging over partitioned inverted lists."""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections.abc import Iterator
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citegrove.llm.dictionary import encode
from citegrove.plans.materialize import settle, ship, spread

#: An inverted-list partition with more listed records than this is parted by one more token, as long as that copies fewer rows than dealing does.
HOT = 512
#: Probes of one partition that a task takes; partitions with more are dealt to several tasks, each with the lists.
PROBES = 4096
#: Times that parting may copy the rows of a partition which one task could take.
WIDER = 16
#: Weight of a heap step against a binary search when the longest lists are chosen.
MU = 0.02


def _occurs(lists: list[list[int]], low: int, need: int) -> list[int]:
    """The numbers >= low in at least need of the ascending lists.

    The longest lists are set aside and only searched; the others are merged by a heap that jumps over numbers that can't reach need.
    """
    lists = sorted((x for x in lists if x and x[-1] >= low), key=len)
    if len(lists) < need:
        return []
    aside = min(need - 1, int(need / (MU * math.log2(len(lists[-1]) + 1) + 1)))
    short, long, least = (lists[: len(lists) - aside], lists[len(lists) - aside :], need - aside) if aside else (lists, [], need)
    at = [bisect_left(x, low) for x in short]
    heap = [(x[p], k) for k, (x, p) in enumerate(zip(short, at, strict=True)) if p < len(x)]
    heapq.heapify(heap)
    out = []
    while len(heap) >= least:
        top = heap[0][0]
        popped = []
        while heap and heap[0][0] == top:
            popped.append(heapq.heappop(heap)[1])
        if len(popped) >= least:
            n = len(popped)
            for i, x in enumerate(long):
                if n + len(long) - i < need:
                    break
                p = bisect_left(x, top)
                n += p < len(x) and x[p] == top
            if n >= need:
                out.append(top)
            jump = top + 1
        else:
            while heap and len(popped) < least - 1:
                popped.append(heapq.heappop(heap)[1])
            if not heap:
                break
            jump = heap[0][0]
        for k in popped:
            x = short[k]
            p = bisect_left(x, jump, at[k])
            at[k] = p
            if p < len(x):
                heapq.heappush(heap, (x[p], k))
    return out


def _partition_pairs(path: list[int], alone: bool, members: list[tuple], num: int, den: int, cross: bool) -> Iterator[tuple[int, int]]:
    """Pairs within one partition of the inverted lists, each pair only where its first common tokens are the partition's own; if alone, all of them.

    members come by size. Each probes the lists of the listed ones before it, and is then listed itself if its tokens here are within the shorter prefix
    that a partner of its size or more must meet.
    """
    lists: dict[int, list[int]] = {}
    sizes: list[int] = []
    listed: list[tuple] = []
    for member in members:
        n, rep, side, probe, index, tokens = member
        least = -(-num * n // den)
        if probe and listed:
            low = bisect_left(sizes, least)
            if low < len(sizes):
                own = [lists[t] for t in tokens if t in lists]
                for j in _occurs(own, low, least):
                    m, other, other_side, _, _, theirs = listed[j]
                    if cross and side == other_side:
                        continue
                    has = set(theirs)
                    common = [t for t in tokens if t in has]
                    if den * len(common) >= num * (n + m - len(common)) and (common == path if alone else common[: len(path)] == path):
                        yield (rep, other) if rep < other else (other, rep)
        if index:
            for t in tokens:
                lists.setdefault(t, []).append(len(listed))
            sizes.append(n)
            listed.append(member)


def _pairs(num: int, den: int, cross: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, members, out = None, [], []

        def close() -> None:
            if len(members) > 1:
                out.extend(_partition_pairs(now[0], now[1], members, num, den, cross))

        def give() -> pa.RecordBatch:
            b = pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], names=["a", "b"])
            out.clear()
            return b

        for batch in batches:
            cols = [c.to_pylist() for c in batch.columns]
            for path, alone, part, n, rep, side, probe, index, tokens in zip(*cols, strict=True):
                if (path, alone, part) != now:
                    close()
                    now, members = (path, alone, part), []
                    if len(out) > 50_000:
                        yield give()
                members.append((n, rep, side, probe, index, tokens))
        close()
        yield give()

    return run


def _partitions(reps: DataFrame, num: int, den: int) -> DataFrame:
    """The rows of all partitions of the inverted lists: path (the partition's tokens), alone, part, n, rep, side, probe, index, tokens.

    A record stands in the partition of each token of its prefix. Where a partition lists more than HOT records, its rows go on to the
    partitions of that token and one more, and so on; a record that can be a partner by the tokens so far alone also stays in a partition for such
    pairs. Where parting would copy more rows than dealing, as with long records, the probes are dealt to tasks instead.
    """
    need = F.ceil(F.col("n") * num / F.lit(den)).cast("int")
    # a partner of the same size or more must meet a record within the shorter of its two prefixes
    short = F.col("n") - F.ceil(F.col("n") * (2 * num) / F.lit(num + den)).cast("int") + 1
    r = reps.select("rep", "side", "tokens", F.size("tokens").alias("n")).withColumns({"need": need, "prefix": F.col("n") - need + 1, "short": short})
    own = ["rep", "side", "n", "tokens", "need", "prefix", "short", "path", "pos", "index"]
    rows = r.select("*", F.posexplode(F.slice("tokens", 1, F.col("prefix"))).alias("pos", "t")).withColumns({"path": F.array("t"), "index": F.col("pos") < F.col("short")}).select(*own)
    cols, done, level = ["path", "alone", "part", "n", "rep", "side", "probe", "index", "tokens"], None, 1

    def dealt(df: DataFrame, m: Column, alone: bool) -> DataFrame:
        parts = F.ceil(m / F.lit(PROBES)).cast("int")
        d = df.select("*", F.lit(alone).alias("alone"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("part")).withColumn("probe", F.pmod(F.xxhash64("rep"), parts) == F.col("part"))
        return d.filter("probe or index").select(*cols)

    while True:
        rows = settle(rows)
        wider = F.sum(F.col("prefix") + (level - 1) - F.col("pos"))
        sizes = rows.groupBy("path").agg(F.count(F.lit(1)).alias("m"), F.count_if("index").alias("listed"), F.count_if(F.col("need") <= level).alias("m_alone"), wider.alias("wider"))
        by_dealing = F.col("m") * F.greatest(F.ceil(F.col("m") / F.lit(PROBES)), F.lit(WIDER))
        sizes = settle(sizes.filter("m > 1 and listed > 0").withColumns({"hot": (F.col("listed") > HOT) & (F.col("wider") < by_dealing), "n": F.col("m")}))
        total = sizes.groupBy().agg(F.coalesce(F.sum("m"), F.lit(0)).alias("m"), F.count_if("hot").alias("hot")).first()
        counted = encode(rows, sizes, ["path"], total["m"])
        cold = dealt(counted.filter("not hot"), F.col("m"), False)
        done = cold if done is None else done.unionByName(cold)
        if not total["hot"]:
            return done
        hot = counted.filter("hot")
        done = done.unionByName(dealt(hot.filter(F.col("need") <= level), F.col("m_alone"), True))
        # the next common token lies at most one place further back
        on = hot.select("*", F.posexplode(F.slice("tokens", F.col("pos") + 2, F.col("prefix") + (level - 1) - F.col("pos"))).alias("j", "t"))
        on = on.withColumns({"path": F.concat("path", F.array("t")), "pos": F.col("pos") + F.col("j") + 1})
        rows, level = on.withColumn("index", F.col("index") & (F.col("pos") <= F.col("short") + (level - 1))).select(*own), level + 1


def _joined(sets: DataFrame, key: str, values: str, at_least: Fraction, side: str | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pairs of representatives (a, b), all items with their tokens, and the representatives with their number of copies."""
    if at_least <= 0:
        raise ValueError("at_least must be above 0")
    ship(sets.sparkSession)
    num, den = at_least.numerator, at_least.denominator
    clean = F.array_distinct(F.filter(F.col(values), lambda v: v.isNotNull() & (v != "")))
    base = settle(sets.select(F.col(key).alias("item"), (F.col(side) if side else F.lit(False)).alias("side"), clean.alias("vs")).filter(F.size("vs") > 0))
    long = base.select("item", "side", F.explode("vs").alias("value"))
    book = settle(long.groupBy("value").agg(F.count(F.lit(1)).alias("n")).withColumn("tid", F.monotonically_increasing_id()))
    coded = encode(long, book.withColumn("df", F.col("n")), ["value"], base.count())
    tokens = F.transform(F.array_sort(F.collect_list(F.struct("df", "tid"))), lambda x: x["tid"])
    items = settle(coded.groupBy("item", "side").agg(tokens.alias("tokens")))
    reps = settle(items.groupBy("tokens", "side").agg(F.min("item").alias("rep"), F.count(F.lit(1)).alias("copies")))
    # unequal sets with one common token are a pair at thresholds of 1/2 or less only
    lists = _partitions(reps if 2 * num <= den else reps.filter(F.size("tokens") > 1), num, den)
    lists = spread(lists, "path", "alone", "part").sortWithinPartitions("path", "alone", "part", "n", "rep")
    return lists.mapInArrow(_pairs(num, den, side is not None), "a long, b long"), items, reps


def similar_pairs(sets: DataFrame, key: str, values: str, at_least: Fraction, side: str | None = None) -> DataFrame:
    """(item_a, item_b), item_a < item_b: every pair whose arrays of values share at_least of all their distinct values.

    sets: key (unique integer) and values (array of strings; repeats, nulls and '' count for nothing). Rows without a value have
    no partner; an empty table gives no pairs; other columns are ignored. side names a boolean column that parts the rows into
    two tables; only pairs across them are given then.

    Rows of equal sets are joined once, as one representative, and expanded at the end; similar_classes leaves them together. Tokens get integers in
    order of their frequency. The inverted lists are partitioned by the tokens of a record's prefix, hot partitions by one more token as long as
    they are hot, and within one a record probes the lists of its tokens for records that occur in as many as the overlap needs. Only at
    thresholds of 1/2 or less can unequal sets be a pair with one common token: there records of one value take part. A threshold of 0 or less is an error.
    """
    pairs, items, reps = _joined(sets, key, values, at_least, side)
    return _expand(pairs, items, reps, side is not None, 2 * at_least.numerator <= at_least.denominator)


def similar_classes(sets: DataFrame, key: str, values: str, at_least: Fraction) -> tuple[DataFrame, DataFrame]:
    """(pairs, members): the pairs as in similar_pairs, but between the first items of equal sets only, and (item, first_item) of every item with a value.

    For tables with many copies, whose pairs would grow with the square of a set's copies. Two items are a pair if they have one
    first item or if their first items are a pair.
    """
    pairs, items, reps = _joined(sets, key, values, at_least, None)
    book = reps.select("tokens", F.col("rep").alias("first_item"), F.col("copies").alias("n"))
    return pairs.select(F.col("a").alias("item_a"), F.col("b").alias("item_b")), encode(items.select("item", "tokens"), book, ["tokens"], items.count()).select("item", "first_item")


def _expand(pairs: DataFrame, items: DataFrame, reps: DataFrame, cross: bool, single: bool) -> DataFrame:
    """Pairs of representatives and of copies to pairs of items; single tells that equal sets of one value are among the pairs."""
    multiple = reps.filter("copies > 1").select("rep", "tokens", "side")
    copies = settle(items.join(multiple, ["tokens", "side"]).select("rep", "item"))
    member = lambda c, to: F.coalesce(F.col(to), F.col(c))
    across = (
        pairs.join(copies.select(F.col("rep").alias("a"), F.col("item").alias("ia")), "a", "left")
        .join(copies.select(F.col("rep").alias("b"), F.col("item").alias("ib")), "b", "left")
        .select(member("a", "ia").alias("x"), member("b", "ib").alias("y"))
    )
    if cross and single:
        return across.select(F.least("x", "y").alias("item_a"), F.greatest("x", "y").alias("item_b"))
    if cross:
        sides = reps.filter(F.size("tokens") == 1).select(F.col("rep"), "tokens", "side")  # longer equal sets are among the pairs
        left, right = (sides.filter(F.col("side") == s).select("tokens", F.col("rep").alias(c)) for s, c in ((False, "a"), (True, "b")))
        same = left.join(right, "tokens").select("a", "b")
        same = (
            same.join(copies.select(F.col("rep").alias("a"), F.col("item").alias("ia")), "a", "left")
            .join(copies.select(F.col("rep").alias("b"), F.col("item").alias("ib")), "b", "left")
            .select(member("a", "ia").alias("x"), member("b", "ib").alias("y"))
        )
    else:
        same = copies.alias("l").join(copies.alias("r"), (F.col("l.rep") == F.col("r.rep")) & (F.col("l.item") < F.col("r.item")))
        same = same.select(F.col("l.item").alias("x"), F.col("r.item").alias("y"))
    return across.unionAll(same).select(F.least("x", "y").alias("item_a"), F.greatest("x", "y").alias("item_b"))


def words(text: Column) -> Column:
    """Distinct runs of a-z and 0-9 of the lower-cased text."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), 1))
