"""Queries of the training-data operators over whole tables, each with SQL where SQL can say it."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citegrove.llm import bpe, canonmap, consensus, packing, readability, setjoin, sql, survivor, termcount, twins
from citegrove.plans.registry import Registry
from citegrove.plans.materialize import settle
from citegrove.session import table

REGISTRY = Registry()


@REGISTRY.add("p3_found", sql.P3_FOUND)
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of paper_hit with two copies or more."""
    hits = table(spark, sf_dir, "paper_hit")
    return twins.collapse_copies(hits, "hit_id", twins.paper_hit_record(), "title").filter("n_copies >= 2")


def _evidence(items: DataFrame) -> DataFrame:
    return items.withColumn("vs", F.array_distinct(F.filter(F.transform("evidence", termcount.normal_value), lambda v: v.isNotNull() & (v != ""))))


@REGISTRY.add("p4_found", sql.P4_FOUND)
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of menu items with similar evidence, and of design items with similar words of the name."""
    items = table(spark, sf_dir, "menu_item")
    by_evidence = setjoin.similar_pairs(_evidence(items).filter(F.size("vs") >= 3), "item_id", "vs", Fraction(3, 5))
    design = items.filter(F.col("key").isin("threats", "evidence_standards", "protocols", "validity_checks"))
    by_name = setjoin.similar_pairs(design.withColumn("vs", setjoin.words(F.col("name"))), "item_id", "vs", Fraction(3, 4))
    return by_evidence.select(F.lit("evidence").alias("field"), "item_a", "item_b").unionAll(by_name.select(F.lit("name").alias("field"), "item_a", "item_b"))


@REGISTRY.add("p5_found", sql.P5_FOUND)
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence values too rare or too common to be useful."""
    items = table(spark, sf_dir, "menu_item")
    counts = termcount.value_counts(items, "item_id", "evidence")
    return termcount.mark_useless(counts, termcount.records_with_values(items, "evidence"))


@REGISTRY.add("p6_found")
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entry of canon_entry meant by each typed name of a resource item, 0 for none."""
    typed = canonmap.typed_names(table(spark, sf_dir, "menu_item"))
    return canonmap.map_values(typed, table(spark, sf_dir, "canon_entry")).select("item_id", "pos", "entry_id")


_ITEM = ["problem_id", "model", "condition", "ref_index"]


def _consensus(spark: SparkSession, sf_dir: str) -> consensus.Consensus:
    votes = consensus.evaluation_votes(table(spark, sf_dir, "evaluation"), table(spark, sf_dir, "benchmark_problem"))
    return consensus.consensus(votes, _ITEM, "judge", "status", consensus.STATUSES)


@REGISTRY.add("p1_found")
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The consensus status of every item on which three judges or more gave a usable one."""
    return _consensus(spark, sf_dir).items.filter("n_annotators >= 3").select(*_ITEM, F.col("label").alias("status"))


@REGISTRY.add("p1_agreement")
def p1_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consensus, confidence and pairwise agreement of every item with a usable status."""
    return _consensus(spark, sf_dir).items.withColumnRenamed("label", "status")


@REGISTRY.add("p1_reliability")
def p1_reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The judges' votes and accuracy, by triplets alone and in the end."""
    return _consensus(spark, sf_dir).annotators.withColumnRenamed("annotator", "judge")


@REGISTRY.add("p7_ids")
def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document by byte_bpe_50k."""
    return bpe.encode_texts(table(spark, sf_dir, "documents"), "doc_id", "text")


@REGISTRY.add("p8_containers")
def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which document or piece lies in which container of each context budget."""
    sizes = settle(bpe.count_tokens(table(spark, sf_dir, "documents"), "doc_id", "text"))
    budgets = table(spark, sf_dir, "context_budget").select("budget_id", F.col("capacity_tokens").cast("long").alias("capacity"))
    pieces = packing.cut_pieces(sizes.crossJoin(F.broadcast(budgets)), "doc_id", "n_tokens", F.col("capacity"))
    packed = packing.pack(pieces.select("budget_id", "doc_id", "piece", "size", "capacity"), "budget_id", "doc_id")
    return packed.select("budget_id", "doc_id", "piece", F.col("size").alias("n_tokens"), "container")


@REGISTRY.add("p8_fill")
def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers of each context budget, and the share of their space that is used."""
    budgets = table(spark, sf_dir, "context_budget").select("budget_id", F.col("capacity_tokens").cast("long").alias("capacity"))
    used = p8_containers(spark, sf_dir).groupBy("budget_id", "container").agg(F.sum("n_tokens").alias("used"))
    per = used.groupBy("budget_id").agg(F.count(F.lit(1)).alias("n_containers"), F.sum("used").alias("used"), F.max("used").alias("most"))
    return per.join(F.broadcast(budgets), "budget_id").select("budget_id", "capacity", "n_containers", "most", F.round(F.col("used") / (F.col("capacity") * F.col("n_containers")), 6).alias("fill"))


@REGISTRY.add("p2_found")
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The surviving record of every work with two records or more."""
    return survivor.survivors(table(spark, sf_dir, "paper"))


def _levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readability.reading_levels(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "graded_passage"))


@REGISTRY.add("p9_found")
def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reading level of every document of English prose."""
    return _levels(spark, sf_dir).filter("prose").select("doc_id", "level")


@REGISTRY.add("p9_profile")
def p9_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, words and mean level by prose and level."""
    g = _levels(spark, sf_dir).groupBy("prose", "level")
    return g.agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_words").alias("n_words"), F.round(F.avg("mean_level"), 6).alias("mean_level"))
