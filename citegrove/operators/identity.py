"""Entity resolution of paper records: keyed merge, second pass by version, representative choice, ordered distinct."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citegrove.functions.text import dedup_key, version_key

SCALARS = ["title", "venue", "url", "pdf_url", "doi", "arxiv_id"]
LISTS = ["fields_of_study", "topic_ids", "sources", "queries", "buckets"]
_EMPTY = "array<string>"


def _some(c: str) -> Column:
    return F.nullif(F.col(c), F.lit(""))


def _first(value: Column, order: str = "seq") -> Column:
    return F.min_by(value, F.when(value.isNotNull(), F.col(order)))


def _united(c: str) -> Column:
    return F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce(F.col(c), F.array().cast(_EMPTY))))))


def merge_records(df: DataFrame, key: str) -> DataFrame:
    """One record a key, field by field: the first non-empty scalar by seq, the longest abstract (the earlier on ties), the largest
    citations and semantic score, the sorted union of each list, and for each tag the first value list.

    seq is the smallest of the group and n its size; rows of a null key are left out. Empty and null fields say nothing. All are partial
    aggregates, so large groups are combined before the shuffle.
    """
    longest = F.max_by("abstract", F.struct(F.length(F.coalesce("abstract", F.lit(""))), -F.col("seq")))
    tags = F.transform(F.map_entries("tags"), lambda e: F.struct(F.col("seq").alias("seq"), e["key"].alias("k"), e["value"].alias("v")))
    all_tags = F.array_sort(F.flatten(F.collect_list(F.coalesce(tags, F.array().cast("array<struct<seq:bigint,k:string,v:array<string>>>")))))
    firsts = F.filter(all_tags, lambda t, i: ~F.exists(F.slice(all_tags, 1, i), lambda u: u["k"] == t["k"]))
    merged = df.filter(F.col(key).isNotNull()).groupBy(key).agg(
        *(_first(_some(c)).alias(c) for c in SCALARS),
        longest.alias("abstract"),
        _first(F.when(F.size("authors") > 0, F.col("authors"))).alias("authors"),
        _first(F.when(F.col("year") != 0, F.col("year"))).alias("year"),
        F.max(F.coalesce("citations", F.lit(0))).alias("citations"),
        F.max("semantic_score").alias("semantic_score"),
        *(_united(c).alias(c) for c in LISTS),
        F.transform(firsts, lambda t: F.struct(t["k"], t["v"])).alias("tags"),
        F.min("seq").alias("seq"),
        F.count(F.lit(1)).alias("n"),
    )
    return merged.withColumn("tags", F.map_from_entries("tags"))


def merge_by_identity(papers: DataFrame) -> DataFrame:
    """First pass: records of one dedup key become one."""
    return merge_records(papers.withColumn("key", dedup_key(F.col("doi"), F.col("arxiv_id"), F.col("title"))), "key")


def merge_by_version(records: DataFrame) -> DataFrame:
    """Second pass: records of one title and first author become one; those without stay, ordered after the others (keyed = false)."""
    keyed = records.drop("key", "n").withColumn("version", F.nullif(version_key(F.col("title"), F.col("authors")), F.lit("")))
    merged = merge_records(keyed, "version").withColumn("keyed", F.lit(True))
    alone = keyed.filter("version is null").withColumn("keyed", F.lit(False)).withColumn("n", F.lit(1).cast("long"))
    return merged.unionByName(alone)


def representatives(papers: DataFrame) -> DataFrame:
    """(seq, kept_seq, n): the record with the longest abstract of each identity, and of these of each version, at the first place.

    Unlike the merge, one whole record stands for the group; ties go to the earlier one.
    """
    size = F.struct(F.length(F.coalesce("abstract", F.lit(""))), -F.col("kept_seq"))
    p = papers.withColumn("key", dedup_key(F.col("doi"), F.col("arxiv_id"), F.col("title"))).withColumn("kept_seq", F.col("seq"))
    cols = ["kept_seq", "title", "authors", "abstract"]
    once = p.groupBy("key").agg(F.min("seq").alias("seq"), F.max_by(F.struct(*cols), size).alias("r"), F.count(F.lit(1)).alias("n")).select("seq", "r.*", "n")
    v = once.withColumn("version", version_key(F.col("title"), F.col("authors")))
    v = v.withColumn("version", F.when(F.col("version") == "", F.concat(F.lit("\x00"), F.col("seq").cast("string"))).otherwise(F.col("version")))
    size2 = F.struct(F.length(F.coalesce("abstract", F.lit(""))), -F.col("seq"))
    return v.groupBy("version").agg(F.min("seq").alias("seq"), F.max_by("kept_seq", size2).alias("kept_seq"), F.sum("n").alias("n")).select("seq", "kept_seq", "n")


def ordered_distinct(df: DataFrame, by: list[Column], order: list[str]) -> DataFrame:
    """The first row of each value of by, in order."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def upsert_latest(old: DataFrame, new: DataFrame, key: str, version: str) -> DataFrame:
    """old and new together, one row a key, the one of the highest version; of one version a row of new."""
    rows = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    cols = [c for c in rows.columns if c not in ("_new", key)]
    return rows.groupBy(key).agg(F.max_by(F.struct(*cols), F.struct(version, "_new")).alias("r")).select(key, "r.*")


def missing_keys(wanted: DataFrame, have: DataFrame, on: list[str]) -> DataFrame:
    """What is wanted and not there yet: the resume pattern."""
    return wanted.join(have.select(*on).distinct(), on, "left_anti")
