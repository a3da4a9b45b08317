"""Votes over repeated judgments, recall and precision metrics, paired deltas and bootstrap intervals."""

from __future__ import annotations

import random
from statistics import fmean

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a status is worth.
VALUE = {"covered": 1.0, "partial": 0.5, "missing": 0.0}
OBLIGED, BEYOND, RIGOUR = ["headline", "apparatus", "control", "confound"], ["mechanism", "external"], ["control", "confound"]
ITEM = ["problem_id", "model", "condition", "ref_index"]
ARM = ["problem_id", "model", "condition"]
#: Arms of the report, in order.
ARMS = ["nocard", "rag", "card"]
CONTESTED = "CONTESTED"
#: So many unnamed numbers in a row end an arm's experiments.
GAP = 3


def value_of(status: Column, other: Column | None = None) -> Column:
    """The worth of a status; other (null) for anything else."""
    c = F.when(F.lit(False), F.lit(0.0))
    for s, v in VALUE.items():
        c = c.when(status == s, F.lit(v))
    return c.otherwise(F.lit(None).cast("double") if other is None else other)


def ordered_passes(evaluation: DataFrame, usable: Column) -> DataFrame:
    """Rows of an item numbered as passes in order of time: pass 0 is the first. status becomes the usable status; repeated rows count once."""
    cols = [*ITEM, "judge", "run", "judged_at", usable.alias("status"), F.coalesce("covered_by", F.array().cast("array<int>")).alias("covered_by"), F.coalesce(F.size("reasoning_chain"), F.lit(0)).alias("chain")]
    return evaluation.filter("ref_index is not null").select(*cols).distinct()


def majority_vote(votes: DataFrame, item: list[str], value: str, order: str, tie: str | None = None) -> DataFrame:
    """(item, n, top, winner): the mode of the non-null values, the first seen on ties, and it or tie as the winner.

    The winner needs a strict majority where tie is given; without tie it is the mode. Items with null values only have a null winner.
    """
    per = votes.groupBy(*item, value).agg(F.count(value).alias("n"), F.min(order).alias("first"))
    best = per.groupBy(*item).agg(F.sum("n").alias("n"), F.min_by(F.struct(F.col(value).alias("top"), F.col("n").alias("k")), F.when(F.col(value).isNotNull(), F.struct(-F.col("n"), "first"))).alias("t"))
    strict = F.col("t.k") * 2 > F.col("n")
    won = F.col("t.top") if tie is None else F.when(strict, F.col("t.top")).when(F.col("n") > 0, F.lit(tie))
    return best.select(*item, "n", F.col("t.top").alias("top"), won.alias("winner"))


def aggregate_runs(passes: DataFrame, order: str = "judged_at") -> DataFrame:
    """One row an item over its passes: the majority status or CONTESTED, the mean worth, the experiments that the agreeing passes
    list (all passes if contested), the longest chain among them, and the number of passes.

    passes: item columns, status, covered_by, chain and the order. A pass with a null status votes for nothing and is worth 0 in the mean.
    """
    voted = majority_vote(passes, ITEM, "status", order, tie=CONTESTED)
    j = passes.join(voted.select(*ITEM, "winner"), ITEM)
    agree = (F.col("status") == F.col("winner")) | (F.col("winner") == CONTESTED)
    lists = F.flatten(F.collect_list(F.when(agree, F.col("covered_by"))))
    return j.groupBy(*ITEM, "winner").agg(
        F.array_sort(F.array_distinct(lists)).alias("covered_by"),
        F.avg(value_of(F.col("status"), F.lit(0.0))).alias("mean_value"),
        F.max(F.when(agree, F.col("chain"))).alias("chain"),
        F.count(F.lit(1)).alias("passes"),
    ).withColumnRenamed("winner", "status")


def run_statuses(passes: DataFrame, order: str = "judged_at") -> DataFrame:
    """(item, run_statuses): the statuses of an item's passes in order, null ones kept."""
    each = passes.groupBy(*ITEM).agg(F.array_sort(F.collect_list(F.struct(order, "status"))).alias("x"))
    return each.select(*ITEM, F.transform("x", lambda x: x["status"]).alias("run_statuses"))


def aggregate_sufficiency(runs: DataFrame, by: list[str]) -> DataFrame:
    """(by, n_runs, sufficiency, reasoning, missing, missing_all_runs): what an arm's runs say as a whole.

    runs: by, run, sufficiency, reasoning, missing (array). sufficiency needs a strict majority of the non-null ones, else it is null; reasoning and
    missing are those of the first run of that sufficiency, null counting as one, or of the first run; missing_all_runs is the sorted union.
    """
    x = runs.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("run", "sufficiency", "reasoning", "missing"))).alias("x"))
    said = F.filter(F.transform("x", lambda r: r["sufficiency"]), lambda s: s.isNotNull())
    most = F.get(F.filter(F.array_distinct(said), lambda s: 2 * F.size(F.filter(said, lambda t: t == s)) > F.size(said)), F.lit(0))
    x = x.withColumn("sufficiency", most)
    first = F.coalesce(F.get(F.filter("x", lambda r: r["sufficiency"].eqNullSafe(F.col("sufficiency"))), F.lit(0)), F.get("x", F.lit(0)))
    none = F.array().cast("array<string>")
    union = F.array_sort(F.array_distinct(F.filter(F.flatten(F.transform("x", lambda r: F.coalesce(r["missing"], none))), lambda m: m.isNotNull())))
    return x.withColumn("first", first).select(*by, F.size("x").cast("long").alias("n_runs"), "sufficiency", F.coalesce("first.reasoning", F.lit("")).alias("reasoning"), F.coalesce("first.missing", none).alias("missing"), union.alias("missing_all_runs"))


def run_scores(items: DataFrame, by: list[str]) -> DataFrame:
    """(by, n_contested, judge_runs, run_agreement): items without a majority, the most passes of an item, and the share of items with one."""
    contested = F.col("status") == CONTESTED
    return items.groupBy(*by).agg(F.count_if(contested).alias("n_contested"), F.max("passes").alias("judge_runs"), F.avg((~F.coalesce(contested, F.lit(False))).cast("double")).alias("run_agreement"))


def item_value(contested: str = "mean") -> Column:
    """The worth of an aggregated item; a contested one counts its mean or zero."""
    return F.when(F.col("status") == CONTESTED, F.col("mean_value") if contested == "mean" else F.lit(0.0)).otherwise(value_of(F.col("status")))


def recall(items: DataFrame, by: list[str], contested: str = "mean") -> DataFrame:
    """(by, n, recall, strict): mean worth with halves and without; items of no known worth are skipped in recall."""
    return items.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(item_value(contested)).alias("recall"), F.avg((F.col("status") == "covered").cast("double")).alias("strict"))


def recall_at(items: DataFrame, by: list[str], k: int, contested: str = "zero") -> DataFrame:
    """Worth recovered if only the first k experiments were run: an item counts if one of them is among its experiments."""
    return items.groupBy(*by).agg(recall_within(k, contested).alias("recall_at"))


def recall_within(k: int, contested: str = "zero") -> Column:
    """The aggregate of recall_at, so that several k can share one pass."""
    hit = F.coalesce(F.array_min("covered_by") < k, F.lit(False))
    return F.avg(F.when(hit, F.coalesce(item_value(contested), F.lit(0.0))).otherwise(0.0))


def score_run(items: DataFrame, by: list[str], proposed: int) -> DataFrame:
    """Counts of each status, and the experiments 0..proposed-1 that no item lists."""
    used = F.array_distinct(F.flatten(F.collect_list("covered_by")))
    count = lambda s: F.count_if(F.col("status") == s).alias(f"n_{s.lower()}")
    return items.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_reference"), *(count(s) for s in (*VALUE, CONTESTED)), F.array_sort(F.array_except(F.sequence(F.lit(0), F.lit(proposed - 1)), used)).alias("unused"),
        (F.size(F.array_intersect(used, F.sequence(F.lit(0), F.lit(proposed - 1)))) / proposed).alias("overlap"),
    )


def matching(edges: list[list[int]], k: int) -> int:
    """Size of a largest matching between the first k experiments and items; edges: the experiments of each item."""
    holder: dict[int, int] = {}

    def place(item: int, tried: set[int]) -> bool:
        for e in edges[item]:
            if 0 <= e < k and e not in tried:
                tried.add(e)
                if e not in holder or place(holder[e], tried):
                    holder[e] = item
                    return True
        return False

    return sum(place(i, set()) for i in range(len(edges)))


def n_proposed(passes: DataFrame, by: list[str]) -> DataFrame:
    """(by, n_proposed): one more than the largest experiment that a pass of the arm names, 0 if none is named.

    Numbers below 0, and those that follow GAP or more numbers that no pass names, are out of range. Experiments after the last one
    named leave no trace in the judgments and can't be counted.
    """
    named = F.array_sort(F.array_distinct(F.flatten(F.collect_list("covered_by"))))
    last = F.aggregate(F.filter(named, lambda j: j >= 0), F.lit(0), lambda n, j: F.when(j - n < GAP, j + 1).otherwise(n))
    return passes.groupBy(*by).agg(last.cast("long").alias("n_proposed"))


def matched(items: DataFrame, by: list[str], k: int | None, proposed: int | str) -> DataFrame:
    """(by, n_items, k, matched, precision, f1): strict matching among the first k experiments, of as many as items where k is None.

    proposed: the number of experiments proposed, or the column of items that has it for the arm. An arm's items are its reference
    experiments, a handful, so each group is small.
    """
    own_number = isinstance(proposed, str)

    def solve(f: pd.DataFrame) -> pd.DataFrame:
        own = [[int(e) for e in x] for x, s in zip(f["covered_by"], f["status"], strict=True) if s == "covered"]
        n = len(f)
        at = min(n, int(f[proposed].iloc[0]) if own_number else proposed) if k is None else k
        m = matching(own, at)
        row = {c: f[c].iloc[0] for c in by} | {"n_items": n, "k": at, "matched": m, "precision": m / at if at else 0.0, "f1": 2 * m / (at + n) if at + n else 0.0}
        return pd.DataFrame([row])

    kinds = ", ".join(f"`{c}` {items.schema[c].dataType.simpleString()}" for c in by)
    return items.select(*by, "status", "covered_by", *([proposed] if own_number else [])).groupBy(*by).applyInPandas(solve, f"{kinds}, n_items long, k long, matched long, precision double, f1 double")


def paired(scores: DataFrame, unit: list[str], arm: str, value: str, a: str, b: str) -> DataFrame:
    """(unit, a, b, delta): the value in both arms and b less a, units without one of them left out."""
    wide = scores.filter(F.col(arm).isin(a, b)).groupBy(*unit).pivot(arm, [a, b]).agg(F.avg(value))
    return wide.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*unit, F.col(a).alias("a"), F.col(b).alias("b"), (F.col(b) - F.col(a)).alias("delta"))


def hash_bootstrap(pairs: DataFrame, group: list[str], value: Column, order: str, rounds: int, seed: str, size: Column | None = None) -> DataFrame:
    """(group, n, mean, lo, hi): percentile interval of a mean, or of the ratio sum(value) / sum(size), over hashed resamples.

    Draw i of round b takes the row whose number is the hash of seed, b and i modulo n, so any engine can repeat it. The resample is
    one row a draw; rounds are spread over the cluster. lo and hi are the sorted means at 2.5 and 97.5 % by index.
    """
    from pyspark.sql import Window

    w = Window.partitionBy(*group)
    p = pairs.select(*group, value.alias("v"), (F.lit(1.0) if size is None else size.cast("double")).alias("m"), (F.row_number().over(w.orderBy(order)) - 1).alias("i"))
    n = p.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), (F.sum("v") / F.sum("m")).alias("mean"))
    spark = pairs.sparkSession
    b = spark.range(rounds).select(F.col("id").alias("b"))
    pick = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), "b", "draw")), 1, 8), 16, 10).cast("long")
    draws = n.select(*group, "n").crossJoin(F.broadcast(b)).select(*group, "n", "b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("draw")).withColumn("i", F.pmod(pick, F.col("n")))
    means = draws.join(p.withColumn("i", F.col("i").cast("long")), [*group, "i"]).groupBy(*group, "b").agg((F.sum("v") / F.sum("m")).alias("x"))
    ranked = means.withColumn("at", F.row_number().over(w.orderBy("x")) - 1)
    ends = ranked.groupBy(*group).agg(F.max(F.when(F.col("at") == int(0.025 * rounds), F.col("x"))).alias("lo"), F.max(F.when(F.col("at") == int(0.975 * rounds), F.col("x"))).alias("hi"))
    return n.join(ends, group)


def seeded_bootstrap(pairs: DataFrame, group: list[str], value: str, order: str, rounds: int = 10_000, seed: int = 0) -> DataFrame:
    """(group, n, mean, lo, hi) with Python's generator, so that a seed gives the same interval as a plain loop over the deltas.

    A group's deltas, one a claim and model, are one task's.
    """

    def draw(f: pd.DataFrame) -> pd.DataFrame:
        v = f.sort_values(order)[value].tolist()
        rng = random.Random(seed)
        means = sorted(fmean(rng.choices(v, k=len(v))) for _ in range(rounds))
        row = {c: f[c].iloc[0] for c in group} | {"n": len(v), "mean": fmean(v), "lo": means[int(0.025 * rounds)], "hi": means[int(0.975 * rounds)]}
        return pd.DataFrame([row])

    kinds = ", ".join(f"`{c}` {pairs.schema[c].dataType.simpleString()}" for c in group)
    return pairs.groupBy(*group).applyInPandas(draw, f"{kinds}, n long, mean double, lo double, hi double")


def audit_rates(rows: DataFrame, by: list[str], bears: str, flawed: Column, repeats: Column) -> DataFrame:
    """Shares of an arm's experiments by what they bear on; precision is the share that is useful, sound and no repetition."""
    b = F.col(bears)
    useful = F.coalesce(b.isin("decides", "supports"), F.lit(False))
    share = lambda c: F.round(F.avg(F.coalesce(c, F.lit(False)).cast("double")), 4)
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), share(useful & ~F.coalesce(flawed, F.lit(False)) & ~F.coalesce(repeats, F.lit(False))).alias("precision"), share(useful).alias("bears_on_claim"),
        *(share(b == k).alias(k) for k in ("decides", "supports", "tangential", "irrelevant")), share(flawed).alias("flawed"), share(repeats).alias("duplicate"),
    )
