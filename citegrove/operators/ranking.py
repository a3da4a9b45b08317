"""Relevance, composite rank, top-k with a quota for recent records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citegrove.functions.text import authority, paper_type, recency
from citegrove.plans.materialize import settle

#: Weights of relevance, authority, type, recency and topics.
WEIGHTS = (1.0, 0.8, 0.8, 0.15, 0.4)
TYPE_BOOST = {"survey": 0.6, "benchmark": 0.5}
OTHER_BOOST = 0.2


def _n(c: Column) -> Column:
    return F.coalesce(F.size(F.array_distinct(c)), F.lit(0))


def relevance(subfields: Column, keywords: Column) -> Column:
    """How much a record is on topic: buckets, subfield names and keywords in title and abstract, fields of study, and sources.

    subfields and keywords are arrays of lower-case strings; keywords of four letters or fewer don't count, and six at most do.
    """
    text = F.lower(F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("abstract", F.lit(""))))
    in_text = lambda arr, ok: F.size(F.filter(arr, lambda k: ok(k) & text.contains(k)))
    names = in_text(subfields, lambda k: F.lit(True))
    words = F.least(in_text(keywords, lambda k: F.length(k) > 4), F.lit(6))
    fos = F.aggregate(subfields, F.lit(0), lambda s, k: s + F.size(F.filter(F.coalesce("fields_of_study", F.array().cast("array<string>")), lambda f: F.lower(f).contains(k))))
    return 0.4 * _n(F.col("buckets")) + 0.5 * names + 0.3 * words + 0.3 * fos + 0.3 * (_n(F.col("sources")) - 1)


def composite_rank(papers: DataFrame, pool: str, subfields: Column, keywords: Column, topics: Column, now: int = 2026, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """papers with score, paper_type and rank (1 best, by score and seq) within each pool; the authority counts against the pool's largest."""
    rel, cite, kind, rec, topic = weights
    w = Window.partitionBy(pool)
    p = papers.withColumn("paper_type", paper_type(F.col("title"), F.col("abstract"))).withColumn("authority", authority(F.col("citations"), F.col("year"), now))
    top = F.coalesce(F.nullif(F.max("authority").over(w), F.lit(0.0)), F.lit(1.0))
    boost = F.when(F.col("paper_type") == "survey", TYPE_BOOST["survey"]).when(F.col("paper_type") == "benchmark", TYPE_BOOST["benchmark"]).otherwise(OTHER_BOOST)
    shared = F.size(F.array_intersect(F.coalesce("topic_ids", F.array().cast("array<string>")), topics))
    score = rel * relevance(subfields, keywords) + cite * F.col("authority") / top + kind * boost + rec * recency(F.col("year"), now) + topic * shared
    p = p.withColumn("score", F.round(score, 4))
    return p.withColumn("rank", F.row_number().over(w.orderBy(F.desc("score"), "seq")))


def top_k(df: DataFrame, group: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """The first k rows of each group in order, with their rank."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col(name) <= k)


def balanced_top_k(ranked: DataFrame, pool: str, k: int, now: int = 2026, recent_years: int = 4, share: float = 0.34) -> DataFrame:
    """k rows of each pool with a quota of recent ones: the best recent first, the rest by rank; a pool of k or fewer as it is.

    ranked carries rank (1 best) and year. The quota is k * share, rounded half to even, and one at least.
    """
    quota = max(1, round(k * share))
    recent = F.coalesce(F.col("year"), F.lit(0)) >= now - recent_years
    w = Window.partitionBy(pool)
    r = ranked.withColumn("_size", F.count(F.lit(1)).over(w)).withColumn("_recent", F.row_number().over(Window.partitionBy(pool, recent).orderBy("rank")))
    first = recent & (F.col("_recent") <= quota) & (F.col("_size") > k)
    r = r.withColumn("_at", F.row_number().over(w.orderBy(F.when(first, 0).otherwise(1), "rank")))
    return r.filter((F.col("_at") <= k) | (F.col("_size") <= k)).drop("_size", "_recent", "_at")


def cap_per_group(ranked: DataFrame, query: list[str], group: str, cap: int, k: int) -> DataFrame:
    """The first k of each query's ranking with at most cap of one group. The cap only looks at better ranks, so it comes before the limit."""
    by_group = Window.partitionBy(*query, group).orderBy("rank")
    some = ranked.withColumn("_g", F.row_number().over(by_group)).filter(F.col("_g") <= cap).drop("_g")
    return some.withColumn("place", F.row_number().over(Window.partitionBy(*query).orderBy("rank"))).filter(F.col("place") <= k)


def pool_normalize(df: DataFrame, pool: str, value: str) -> Column:
    """value as a share of the pool's largest, which counts as 1 if it is 0."""
    return F.col(value) / F.coalesce(F.nullif(F.max(value).over(Window.partitionBy(pool)), F.lit(0.0)), F.lit(1.0))


def numbered(df: DataFrame, order: list[str], name: str = "number") -> DataFrame:
    """df with the place of each row in order, from 1; rows alike in order stand in any order among themselves.

    Rows are parted by ranges of order, numbered within each part, and moved on by the sizes of the parts before, of which there are
    as many as shuffle partitions.
    """
    parted = settle(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = parted.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    within = parted.withColumn("_i", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    return within.join(F.broadcast(before), "_part").withColumn(name, F.col("_i") + F.col("_before")).drop("_part", "_i", "_before")
