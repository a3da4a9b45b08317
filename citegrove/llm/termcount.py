"""Frequency of every distinct value: a global integer dictionary, blockwise count arrays, sums by identifier range."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citegrove.plans.materialize import settle, ship

#: Identifiers in one range; an array of counts has so many slots.
RANGE = 4096
#: Blocks of records whose counts are made apart, at least; as many as shuffle partitions if those are more.
BLOCKS = 64
#: Characters that part words: everything that Unicode calls white space.
SPACE = r"[\s\p{Z}\x1c-\x1f\x85]+"


def normal_value(value: Column) -> Column:
    """Trimmed, lower case, runs of white space as one blank; null for null, '' for blank."""
    return F.lower(F.trim(F.regexp_replace(value, SPACE, " ")))


def _count_arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(span, slot, occ, rec) rows, spans in order, to one pair of count arrays a span."""
    now, occ, rec = None, None, None

    def out() -> pa.RecordBatch:
        top = int(np.flatnonzero(occ)[-1]) + 1
        return pa.RecordBatch.from_arrays(
            [pa.array([now], pa.int64()), pa.array([occ[:top]], pa.list_(pa.int64())), pa.array([rec[:top]], pa.list_(pa.int64()))],
            names=["span", "occ", "rec"],
        )

    for b in batches:
        span, slot, o, r = (b.column(i).to_numpy(zero_copy_only=False) for i in range(4))
        for s in np.unique(span):
            if s != now:
                if now is not None:
                    yield out()
                now, occ, rec = int(s), np.zeros(RANGE, np.int64), np.zeros(RANGE, np.int64)
            at = span == s
            np.add.at(occ, slot[at], o[at])
            np.add.at(rec, slot[at], r[at])
    if now is not None:
        yield out()


def value_counts(df: DataFrame, key: str, values: str, normal=normal_value) -> DataFrame:
    """(value, n_occ, n_rec) of every distinct value in the array column values; n_rec counts the rows holding it.

    Values are compared as normal() makes them; null and blank ones, null and empty arrays and rows of a null array count for
    nothing. key names a row; repeated keys are rows of their own. An empty df gives no rows.

    The values of each block of records are counted with partial sums, so a value in a third of all rows arrives at the
    dictionary as one row a block. Each distinct value gets an integer; the blocks' counts become arrays over ranges of
    RANGE integers, and the arrays are added up slot by slot.
    """
    ship(df.sparkSession)
    # a row's own distinct values, with a mark on the first time that a value comes in the row
    arr = F.filter(F.transform(F.col(values), normal), lambda v: v.isNotNull() & (v != ""))
    n_blocks = max(BLOCKS, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # each value is marked before the array is taken apart, so that no value carries its array along
    row = df.select(F.pmod(F.xxhash64(F.col(key)), F.lit(n_blocks)).cast("int").alias("block"), F.array_sort(arr).alias("vs"))
    marked = F.transform("vs", lambda v, i: F.struct(v.alias("value"), ((i == 0) | (F.get("vs", i - 1) != v)).cast("int").alias("first")))
    ex = row.select("block", F.explode(marked).alias("x")).select("block", "x.value", "x.first")
    blocks = settle(ex.groupBy("value", "block").agg(F.count(F.lit(1)).alias("occ"), F.sum("first").alias("rec")))
    book = settle(
        blocks.select("value").distinct().withColumn("id", F.monotonically_increasing_id()).withColumns(
            {"span": F.col("id").bitwiseAND(F.lit(-RANGE)), "slot": F.col("id").bitwiseAND(F.lit(RANGE - 1)).cast("int")}
        )
    )
    coded = blocks.join(book, "value").select("block", "span", "slot", "occ", "rec")
    arrays = (
        coded.repartition("block")
        .sortWithinPartitions("span")
        .select("span", "slot", "occ", "rec")
        .mapInArrow(_count_arrays, "span long, occ array<bigint>, rec array<bigint>")
    )
    slots = arrays.select("span", F.posexplode(F.arrays_zip("occ", "rec")).alias("slot", "x")).filter("x.occ > 0")
    sums = slots.groupBy("span", "slot").agg(F.sum("x.occ").alias("n_occ"), F.sum("x.rec").alias("n_rec"))
    return sums.join(book, ["span", "slot"]).select("value", "n_occ", "n_rec")


def mark_useless(counts: DataFrame, n_records: DataFrame, rare_below: int = 3, common_percent: int = 2) -> DataFrame:
    """The values in fewer than rare_below records ('rare') or in more than common_percent % of them ('common').

    n_records: one row with the number n of records that hold a value at all. A value that is both is rare.
    """
    mark = F.when(F.col("n_rec") < rare_below, "rare").when(F.col("n_rec") * 100 > F.col("n") * common_percent, "common")
    return counts.crossJoin(F.broadcast(n_records)).withColumn("mark", mark).filter("mark is not null").select("value", "n_occ", "n_rec", "mark")


def records_with_values(df: DataFrame, values: str, normal=normal_value) -> DataFrame:
    """One row with the number n of rows that hold a value at all."""
    some = F.exists(F.col(values), lambda v: F.coalesce(normal(v), F.lit("")) != "")
    return df.groupBy().agg(F.coalesce(F.sum(some.cast("int")), F.lit(0)).alias("n"))
