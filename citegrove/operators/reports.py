"""Numbers and texts of reports, comparisons of runs, suites of known answers, plans of harvests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citegrove.operators.scoring import ARM


def signed(c: Column, digits: int = 3) -> Column:
    """A number with its sign and digits places, a dash for null."""
    return F.when(c.isNull(), "–").otherwise(F.concat(F.when(c < 0, "−").otherwise("+"), F.format_number(F.abs(c), digits)))


def interval(mean: Column, lo: Column, hi: Column, digits: int = 3) -> Column:
    """mean [lo, hi], in bold where 0 lies outside."""
    text = F.concat(signed(mean, digits), F.lit(" ["), signed(lo, digits), F.lit(", "), signed(hi, digits), F.lit("]"))
    return F.when((lo > 0) | (hi < 0), F.concat(F.lit("**"), text, F.lit("**"))).otherwise(text)


def first_votes(statuses: DataFrame) -> DataFrame:
    """statuses (item, run_statuses) with the status of the first pass, null where there is none."""
    return statuses.withColumn("status", F.get("run_statuses", F.lit(0)))


def strict_share(items: DataFrame) -> DataFrame:
    """(arm, n, strict): the share of an arm's items that are covered; unknown statuses count for nothing."""
    return items.groupBy(*ARM).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("status") == "covered").cast("double")).alias("strict"))


def compare_runs(old: DataFrame, new: DataFrame) -> DataFrame:
    """(arm, old, new, delta) of the arms that both have: strict shares of two runs of the same items."""
    a, b = strict_share(old).select(*ARM, F.col("strict").alias("old")), strict_share(new).select(*ARM, F.col("strict").alias("new"))
    return a.join(b, ARM).withColumn("delta", F.col("new") - F.col("old"))


def stamped_arms(arms: DataFrame, ablated: DataFrame, by: list[str]) -> DataFrame:
    """arms with ablated, whether ablated (by) lists them."""
    mark = ablated.select(*by).distinct().withColumn("ablated", F.lit(True))
    return arms.join(mark, by, "left").withColumn("ablated", F.coalesce("ablated", F.lit(False)))


def cross_kits(cases: DataFrame, kits: DataFrame, rotation: dict[str, str], base: list[str]) -> DataFrame:
    """cases with proposal: the kit's texts of a case's keys, a key without a text standing for itself; a case without keys takes base of the next kit.

    cases: kit, keys (array, null for a cross-claim case); kits: kit, texts (map). rotation names the next kit of each.
    """
    turn = F.create_map(*(F.lit(x) for pair in rotation.items() for x in pair))
    c = cases.withColumn("_kit", F.when(F.col("keys").isNull(), turn[F.col("kit")]).otherwise(F.col("kit"))).withColumn("_keys", F.coalesce("keys", F.array(*map(F.lit, base))))
    j = c.join(kits.select(F.col("kit").alias("_kit"), "texts"), "_kit", "left")
    return j.withColumn("proposal", F.transform("_keys", lambda k: F.coalesce(F.col("texts")[k], k))).drop("_kit", "_keys", "texts")


def harvest_plan(fields: DataFrame, venues: DataFrame, done: DataFrame) -> DataFrame:
    """(field, venue): every field with every venue, both small lists, without the pairs that are done."""
    pairs = fields.select("field").distinct().crossJoin(F.broadcast(venues.select("venue").distinct()))
    return pairs.join(done.select("field", "venue").distinct(), ["field", "venue"], "left_anti")


def resolve_pdfs(papers: DataFrame, candidates: DataFrame, key: str) -> DataFrame:
    """papers with the address and resolver of the first candidate (key, step, resolver, url) that isn't blank, by step; null without one."""
    good = candidates.filter(F.coalesce(F.trim("url"), F.lit("")) != "")
    first = good.groupBy(key).agg(F.min_by(F.struct("resolver", "url"), F.struct("step", "resolver", "url")).alias("r"))
    return papers.join(first.select(key, "r.*"), key, "left")


def provenance(papers: DataFrame, source: str) -> DataFrame:
    """(source, n): how many papers' texts each source gave; null is none."""
    return papers.groupBy(F.coalesce(source, F.lit("none")).alias("source")).agg(F.count(F.lit(1)).alias("n"))


def label_table(labels: DataFrame) -> DataFrame:
    """(label, n, n_papers, fields): claims and papers of each label, and its claims by field, most first. labels: problem_id, paper, field, label."""
    rows = labels.select("problem_id", "paper", F.coalesce("field", F.lit("Other")).alias("field"), "label").filter("label is not null").distinct()
    per = rows.groupBy("label").agg(F.countDistinct("problem_id").alias("n"), F.countDistinct("paper").alias("n_papers"))
    by = rows.groupBy("label", "field").agg(F.countDistinct("problem_id").alias("k"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("k")).alias("o"), "field", "k"))), lambda x: F.concat(x["field"], F.lit(" "), x["k"].cast("string"))), ", ")
    return per.join(by.groupBy("label").agg(text.alias("fields")), "label")


def checked_dataset(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """rows (problem_id, experiments, roles) as they are, read with an error where a problem comes twice, has fewer than two experiments or roles that
    aren't parallel, isn't among wanted, or is missing."""
    n = rows.groupBy("problem_id").agg(F.count(F.lit(1)).alias("_n"))
    j = rows.join(n, "problem_id").join(wanted.select("problem_id").distinct().withColumn("_w", F.lit(True)), "problem_id", "full_outer")
    bad = F.when(F.col("_n").isNull(), "is missing").when(F.col("_w").isNull(), "isn't wanted").when(F.col("_n") > 1, "comes twice").when(F.coalesce(F.size("experiments"), F.lit(0)) < 2, "has fewer than two experiments")
    bad = bad.when(F.size("roles") != F.size("experiments"), "has roles that aren't parallel")
    return j.withColumn("problem_id", F.when(bad.isNull(), F.col("problem_id")).otherwise(F.raise_error(F.concat(F.lit("problem "), "problem_id", F.lit(" "), bad)).cast("string"))).select(*rows.columns)
