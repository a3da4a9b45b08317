"""Validators that list every fault of a row or group, and leakage checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citegrove.functions.text import arxiv_number, squash
from citegrove.operators.scoring import VALUE

ROLES = ["apparatus", "headline", "mechanism", "control", "confound", "external"]
MIN_EXPERIMENT, LONG_EXPERIMENT = 120, 2000
BEARS = ["decides", "supports", "tangential", "irrelevant"]


def faults(*checks: tuple[Column, Column | str]) -> Column:
    """The messages of the checks that are true, joined by '; '; '' if none is. An unknown check is false."""
    return F.concat_ws("; ", *(F.when(F.coalesce(bad, F.lit(False)), m if isinstance(m, Column) else F.lit(m)) for bad, m in checks))


def reference_messages(experiments: Column, roles: Column, claim: Column, draft: Column | None = None) -> Column:
    """The faults of a reference, one message each, with the numbers of the experiments that are at fault; an empty array for none."""
    length = lambda e: F.length(F.trim(F.coalesce(e, F.lit(""))))
    short = F.transform(F.filter(F.transform(experiments, lambda e, i: F.struct(i.alias("i"), length(e).alias("n"))), lambda x: x["n"] < MIN_EXPERIMENT), lambda x: F.format_string("experiments[%d]: %d characters, %d at least", x["i"], x["n"], F.lit(MIN_EXPERIMENT)))
    odd = F.transform(F.filter(F.transform(roles, lambda r, i: F.struct(i.alias("i"), r.alias("r"))), lambda x: ~F.coalesce(x["r"].isin(*ROLES), F.lit(False))), lambda x: F.format_string("roles[%d]: unknown role %s", x["i"], F.coalesce(x["r"], F.lit("null"))))
    n, none = F.coalesce(F.size(experiments), F.lit(0)), F.array().cast("array<string>")
    one = lambda bad, m: F.when(F.coalesce(bad, F.lit(False)), F.array(F.lit(m))).otherwise(none)
    parts = [one(F.lit(False) if draft is None else draft, "still a draft"), one(n < 2, "needs two experiments"), F.coalesce(short, none), one(F.trim(F.coalesce(claim, F.lit(""))) == "", "claim is blank"), one(F.size(roles) != n, "roles are not parallel"), F.coalesce(odd, none)]
    return F.concat(*parts)


def reference_faults(experiments: Column, roles: Column, claim: Column) -> Column:
    """Faults of a reference: fewer than two experiments, short ones, no claim, roles that aren't parallel or aren't known."""
    short = F.size(F.filter(experiments, lambda e: F.length(F.trim(F.coalesce(e, F.lit("")))) < MIN_EXPERIMENT))
    n = F.coalesce(F.size(experiments), F.lit(0))
    return faults(
        (n < 2, "needs two experiments"),
        (short > 0, F.concat(short.cast("string"), F.lit(" short experiments"))),
        (F.trim(F.coalesce(claim, F.lit(""))) == "", "claim is blank"),
        (F.size(roles) != n, "roles are not parallel"),
        (F.exists(roles, lambda r: ~F.coalesce(r.isin(*ROLES), F.lit(False))), "unknown role"),
    )


def long_experiments(experiments: Column) -> Column:
    """Numbers of the experiments longer than the soft limit, from 0."""
    return F.array_compact(F.transform(experiments, lambda e, i: F.when(F.length(e) > LONG_EXPERIMENT, i)))


def judgment_faults(rows: DataFrame, problems: DataFrame, by: list[str], proposed: int, min_chain: int = 2) -> DataFrame:
    """(by, n, missing, repeated, faults): of each judge's pass over an arm, items left out or given twice, and rows at fault.

    rows: ref_index, status, covered_by, reasoning_chain, rationale, adequacy; problems: problem_id and n_reference.
    """
    chain = F.size(F.filter("reasoning_chain", lambda x: F.trim(x) != ""))
    listed = F.coalesce(F.size("covered_by"), F.lit(0))
    row = (
        (~F.coalesce(F.col("status").isin(*VALUE), F.lit(False))).cast("int")
        + (F.coalesce(F.col("status").isin("partial", "missing"), F.lit(False)) & (F.coalesce(chain, F.lit(0)) < min_chain)).cast("int")
        + (F.coalesce(F.col("status") == "covered", F.lit(False)) & (listed == 0)).cast("int")
        + (F.coalesce(F.col("status") == "missing", F.lit(False)) & (listed > 0)).cast("int")
        + F.coalesce(F.exists("covered_by", lambda j: (j < 0) | (j >= proposed)), F.lit(False)).cast("int")
        + (F.length(F.trim(F.coalesce("rationale", F.lit("")))) < 25).cast("int")
        + (F.length(F.trim(F.coalesce("adequacy", F.lit("")))) < 20).cast("int")
    )
    g = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.collect_set("ref_index").alias("seen"), F.sum(row).alias("faults"))
    wanted = F.when(F.col("n_reference") > 0, F.sequence(F.lit(0), F.col("n_reference") - 1)).otherwise(F.array().cast("array<int>"))
    j = g.join(problems, "problem_id")
    return j.select(*by, "n", F.array_sort(F.array_except(wanted, "seen")).alias("missing"), (F.col("n") - F.size("seen")).alias("repeated"), "faults")


def audit_faults(rows: DataFrame, by: list[str], index: str, bears: str, duplicate_of: str, reason: str) -> DataFrame:
    """(by, n, unknown_bears, forward_duplicates, no_reason) of each audit."""
    n = F.count_if
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        n(~F.coalesce(F.col(bears).isin(*BEARS), F.lit(False))).alias("unknown_bears"),
        n(F.col(duplicate_of).isNotNull() & ~F.coalesce(F.col(duplicate_of).between(0, F.col(index) - 1), F.lit(False))).alias("forward_duplicates"),
        n(F.trim(F.coalesce(reason, F.lit(""))) == "").alias("no_reason"),
    )


def leaked(bundle: DataFrame, sources: DataFrame, block: int = 24, prefix: int = 60, least: int = 25) -> DataFrame:
    """(seq, source_seq): papers of a bundle that are a source paper: equal arXiv number, or a squashed title that contains the other's start.

    bundle and sources: seq, title, arxiv_id, pdf_url, url, doi. Titles are compared where the bundle's has more than least letters; a source's may be
    of any length but 0. Containment is found by the first block letters of the start, or all of it where it is shorter, which must stand in the other
    title, instead of by comparing all with all. Null titles and numbers say nothing.
    """
    ids = lambda df: arxiv_number(df["arxiv_id"], df["pdf_url"], df["url"], df["doi"])
    b = bundle.select("seq", ids(bundle).alias("ax"), squash(F.coalesce("title", F.lit(""))).alias("t"))
    s = sources.select(F.col("seq").alias("source_seq"), ids(sources).alias("ax"), squash(F.coalesce("title", F.lit(""))).alias("u"))
    by_id = b.filter("ax <> ''").join(s.filter("ax <> ''"), "ax").select("seq", "source_seq")

    def grams(c: Column, n: int) -> Column:
        at = F.when(F.length(c) >= n, F.sequence(F.lit(1), F.length(c) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.array_distinct(F.transform(at, lambda i: F.substring(c, i, F.lit(n))))

    long_b, some_s = b.filter(F.length("t") > least), s.filter("u <> ''")
    lengths = [r["n"] for r in some_s.select(F.least(F.length("u"), F.lit(block)).alias("n")).distinct().collect()]  # block values at most
    start = lambda c: F.left(c, F.lit(prefix))
    ours_in_theirs = long_b.withColumn("g", F.left("t", F.lit(block))).join(some_s.withColumn("g", F.explode(grams(F.col("u"), block))), "g").filter(F.col("u").contains(start(F.col("t"))))
    all_grams = F.concat(F.array().cast("array<string>"), *(grams(F.col("t"), n) for n in sorted(lengths)))
    theirs_in_ours = some_s.withColumn("g", F.left("u", F.lit(block))).join(long_b.withColumn("g", F.explode(all_grams)), "g").filter(F.col("t").contains(start(F.col("u"))))
    return by_id.unionByName(ours_in_theirs.select("seq", "source_seq")).unionByName(theirs_in_ours.select("seq", "source_seq")).distinct()


def symmetric_difference(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """(on, side): keys that only a or only b has."""
    left, right = (x.select(*on).distinct().withColumn(c, F.lit(True)) for x, c in ((a, "_a"), (b, "_b")))
    j = left.join(right, on, "full_outer").filter(F.col("_a").isNull() | F.col("_b").isNull())
    return j.select(*on, F.when(F.col("_b").isNull(), "left").otherwise("right").alias("side"))
