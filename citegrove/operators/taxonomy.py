"""Upkeep of the taxonomy: look-ups, additions without near duplicates, edits, keywords of subfields."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citegrove.functions.text import taxonomy_tokens


def _own(c: str):
    return F.coalesce(c, F.array().cast("array<string>"))


def canonical_labels(labels: DataFrame, label: str, taxonomy: DataFrame, order: str, least: float = 0.6) -> DataFrame:
    """labels with task: the task of that name whatever the case, else the nearest task by shared tokens (the first in order on ties), else null.

    taxonomy: task, keywords and order, a dimension of fixed size that travels to the labels.
    """
    x = taxonomy.select("task", F.col(order).alias("_o"), F.array_distinct(F.concat(taxonomy_tokens(F.col("task")), F.flatten(F.transform(_own("keywords"), taxonomy_tokens)))).alias("_x"))
    distinct = labels.select(F.col(label).alias("_l")).filter("_l is not null").distinct().withColumn("_t", taxonomy_tokens(F.col("_l")))
    j = F.when((F.size("_t") > 0) & (F.size("_x") > 0), F.size(F.array_intersect("_t", "_x")) / F.size(F.array_union("_t", "_x"))).otherwise(0.0)
    score = F.when(F.lower("_l") == F.lower("task"), F.lit(2.0)).otherwise(j)
    both = distinct.crossJoin(F.broadcast(x)).withColumn("_j", score).filter(F.col("_j") >= least)
    best = both.groupBy("_l").agg(F.min_by("task", F.struct(-F.col("_j"), "_o")).alias("task"))
    return labels.drop("task").join(best, labels[label] == best["_l"], "left").drop("_l")


def add_labels(taxonomy: DataFrame, labels: DataFrame, label: str, order: str, area: str = "Custom") -> tuple[DataFrame, DataFrame]:
    """(taxonomy with new rows, labels with task): labels without an equal or near task become tasks of their own, with source custom.

    taxonomy: task, area, keywords, datasets, metrics, card_type, source and order (a number). New labels that are near each other, equal tokens
    or case aside, are one, the first by name.
    """
    known = canonical_labels(labels, label, taxonomy, order)
    new = known.filter(F.col("task").isNull() & F.col(label).isNotNull()).select(F.col(label).alias("l")).distinct().withColumn("t", F.array_sort(taxonomy_tokens(F.col("l"))))
    first = new.groupBy("t").agg(F.min("l").alias("new_task"))
    last = taxonomy.groupBy().agg(F.coalesce(F.max(order), F.lit(0)).alias("last"))
    none = F.array().cast("array<string>")
    rows = first.crossJoin(F.broadcast(last)).select(
        F.col("new_task").alias("task"), F.lit(area).alias("area"), F.col("t").alias("keywords"), none.alias("datasets"), none.alias("metrics"), F.lit("empirical").alias("card_type"), F.lit("custom").alias("source"),
        (F.col("last") + F.row_number().over(Window.partitionBy("last").orderBy("new_task"))).alias(order),
    )
    named = new.join(first, "t").select(F.col("l").alias(label), "new_task")
    out = known.join(named, label, "left").withColumn("task", F.coalesce("task", "new_task")).drop("new_task")
    return taxonomy.select(*rows.columns).unionByName(rows), out


def edit(taxonomy: DataFrame, drop: DataFrame | None = None, changes: DataFrame | None = None, new: DataFrame | None = None) -> DataFrame:
    """The taxonomy with tasks dropped, changed and added.

    drop: task. changes: task and any of set_keywords, remove_keywords, add_keywords (arrays) and set_area; keywords are set, then
    taken out, then added once each in order. new: whole rows; a task that is there already is an error when read.
    """
    t = taxonomy
    if drop is not None:
        t = t.join(drop.select("task").distinct(), "task", "left_anti").select(*taxonomy.columns)
    if changes is not None:
        c = changes
        for name, kind in (("set_keywords", "array<string>"), ("remove_keywords", "array<string>"), ("add_keywords", "array<string>"), ("set_area", "string")):
            c = c if name in c.columns else c.withColumn(name, F.lit(None).cast(kind))
        j = t.join(c.select("task", "set_keywords", "remove_keywords", "add_keywords", "set_area"), "task", "left")
        kept = F.filter(F.coalesce("set_keywords", _own("keywords")), lambda k: ~F.array_contains(_own("remove_keywords"), k))
        j = j.withColumns({"keywords": F.array_distinct(F.concat(kept, _own("add_keywords"))), "area": F.coalesce("set_area", "area")})
        t = j.select(*taxonomy.columns)
    if new is not None:
        twice = new.select("task").join(t.select("task"), "task", "left_semi").withColumn("twice", F.lit(True)).distinct()
        checked = new.join(twice, "task", "left").withColumn("task", F.when(F.col("twice").isNull(), F.col("task")).otherwise(F.raise_error(F.concat(F.lit("there is a task "), "task")).cast("string")))
        t = t.unionByName(checked.select(*taxonomy.columns))
    return t


def keywords_of(subfields: DataFrame, by: str, subfield: str, taxonomy: DataFrame) -> DataFrame:
    """(by, keywords): the sorted distinct keywords of each one's subfields; subfields that the taxonomy doesn't know have none."""
    j = subfields.select(by, F.lower(subfield).alias("_s")).join(taxonomy.select(F.lower("task").alias("_s"), "keywords"), "_s", "left")
    words = j.select(by, F.explode_outer("keywords").alias("k")).groupBy(by).agg(F.array_sort(F.collect_set("k")).alias("keywords"))
    return words


def vocabulary(taxonomy: DataFrame) -> DataFrame:
    """(area, line): a line for each area with its tasks in order; tasks without an area are under Other."""
    t = taxonomy.withColumn("area", F.coalesce(F.nullif("area", F.lit("")), F.lit("Other"))).groupBy("area").agg(F.array_sort(F.collect_list("task")).alias("x"))
    return t.select("area", F.concat(F.lit("["), "area", F.lit("] "), F.array_join("x", ", ")).alias("line"))
