"""Consensus from several annotators' labels: accuracies by the triplet moment method, votes combined by log-odds weights."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citegrove.llm.dictionary import encode
from citegrove.plans.materialize import settle, ship

#: Items that each pair of a triplet must share at least.
MIN_SHARED = 5
#: Votes of one item that meet as one list; the votes of a larger item are dealt to groups of about so many, and each two groups meet.
CROWD = 64
#: Annotators of a block; the triplets of each three blocks are one task's.
BLOCK = 256
#: Bounds of sensitivities and false-positive rates, so that no weight is infinite.
LEAST, MOST = 0.02, 0.98
#: The difference of the two for annotators while no triplet is measured at all.
USUAL = 0.5


@dataclass(frozen=True)
class Consensus:
    """items: item columns, n_annotators, label, confidence, agreement; annotators: annotator, n_votes, triplet_accuracy, accuracy, sensitivity."""

    items: DataFrame
    annotators: DataFrame


def one_vote_each(rows: DataFrame, item: list[str], annotator: str, label: str, run: str, at: str) -> DataFrame:
    """One label for each item and annotator: of each run the latest row, of the runs the label most given, then the latest.

    Rows with a null label or annotator are left out. A null time is the earliest; of rows of one time the greater label counts.
    """
    r = rows.filter(F.col(label).isNotNull() & F.col(annotator).isNotNull())
    last = r.groupBy(*item, annotator, run).agg(F.max(F.struct(F.coalesce(F.col(at).cast("timestamp"), F.lit("0001-01-01").cast("timestamp")).alias("at"), F.col(label).alias("label"))).alias("x"))
    votes = last.groupBy(*item, annotator, F.col("x.label").alias("label")).agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("x.at", run)).alias("late"))
    return votes.groupBy(*item, annotator).agg(F.max(F.struct("n", "late", "label")).alias("x")).select(*item, annotator, F.col("x.label").alias(label))


def pair_moments(votes: DataFrame, rates: DataFrame, k: int, n_rows: int) -> DataFrame:
    """(i, j, n, c0, c1, ...): of every pair of annotators with MIN_SHARED items in common, in both orders, and for each label the
    share of those items that both give it less the share expected by chance of how often each gives it.

    votes: _item, a, v, n_rows of them; rates: a, m (shares of the labels among the annotator's votes). All votes of an item are paired; those of an
    item with more than CROWD are dealt to groups, and each two groups are one row, so that no task has all pairs of a large item. Pairs are
    counted before they are shuffled.
    """
    groups = F.ceil(F.col("n_item") / F.lit(CROWD)).cast("int")
    sizes = votes.groupBy("_item").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    crowded = settle(sizes.filter(F.col("n") > CROWD).withColumn("n_item", F.col("n")))
    listed = F.array_sort(F.collect_list(F.struct("a", "v")))
    whole = votes.join(crowded.select("_item"), "_item", "left_anti").groupBy("_item").agg(listed.alias("vs")).filter(F.size("vs") > 1)
    first = whole.select("vs", F.posexplode("vs").alias("at", "x"))
    met = first.select("x", F.explode(F.slice("vs", F.col("at") + 2, F.size("vs"))).alias("y"))
    dealt = encode(votes, crowded, ["_item"], n_rows).select("_item", "a", "v", groups.alias("groups"), F.pmod(F.xxhash64("a"), groups).cast("int").alias("part"))
    parts = settle(dealt.groupBy("_item", "part", "groups").agg(listed.alias("vs")))
    lower = parts.select("_item", F.col("part").alias("p"), F.explode(F.sequence("part", F.col("groups") - 1)).alias("q"), F.col("vs").alias("xs"))
    upper = parts.select("_item", F.explode(F.sequence(F.lit(0), F.col("part"))).alias("p"), F.col("part").alias("q"), F.col("vs").alias("ys"))
    two = lower.join(upper, ["_item", "p", "q"]).select("p", "q", "ys", F.explode("xs").alias("x"))
    across = two.select("x", F.explode(F.filter("ys", lambda y: (F.col("p") < F.col("q")) | (F.col("x.a") < y["a"]))).alias("y"))
    pairs = met.unionByName(across).select(F.least("x.a", "y.a").alias("i"), F.greatest("x.a", "y.a").alias("j"), F.col("x.v").alias("vi"), F.col("y.v").alias("vj"))
    both = pairs.groupBy("i", "j").agg(F.count(F.lit(1)).alias("n"), *(F.count_if((F.col("vi") == z) & (F.col("vj") == z)).alias(f"b{z}") for z in range(k)))
    shares = lambda to, name: rates.select(F.col("a").alias(to), F.col("m").alias(name))
    half = both.filter(F.col("n") >= MIN_SHARED).join(shares("i", "mi"), "i").join(shares("j", "mj"), "j")
    half = half.select("i", "j", "n", *((F.col(f"b{z}") / F.col("n") - F.get("mi", F.lit(z)) * F.get("mj", F.lit(z))).alias(f"c{z}") for z in range(k)))
    return half.unionByName(half.select(F.col("j").alias("i"), F.col("i").alias("j"), "n", *(f"c{z}" for z in range(k))))


def triplet_spread(c: DataFrame, k: int) -> DataFrame:
    """(a, s0, s1, ...): for each label z how far annotator a tells it from the others, times the label's standard deviation; null without a triplet.

    c: pair_moments. C_ij C_ik / C_jk is the square of s_i for any j and k. It is averaged over all pairs of annotators who make a triplet with i,
    with weights of the fewest items that two of the three share; the sign is that of the moments with the others. Annotators are dealt to blocks of
    about BLOCK, and the moments of each three blocks are put together in one task.
    """
    c = settle(c)
    ship(c.sparkSession)
    blocks = max(1, -(-c.select("i").distinct().count() // BLOCK))
    number = lambda x: F.pmod(F.xxhash64(x), F.lit(blocks)).cast("int")
    edges = c.select("*", number("i").alias("bi"), number("j").alias("bj"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other"))
    spokes = edges.withColumns({"one": F.col("bi"), "two": F.least("bj", "other"), "three": F.greatest("bj", "other"), "spoke": F.lit(True)})
    rims = edges.filter("bi <= bj").withColumns({"one": F.col("other"), "two": F.col("bi"), "three": F.col("bj"), "spoke": F.lit(False)})
    values = [f"c{z}" for z in range(k)]
    cols = ["one", "two", "three", "spoke", "i", "j", "n", "bj", *values]
    names = ["a", *(f"{x}{z}" for z in range(k) for x in ("num", "den"))]

    def sums(rows: pa.Table) -> pa.Table:
        get = lambda name: rows[name].to_numpy()
        spoke, left, right, n = get("spoke"), get("i"), get("j"), get("n").astype(float)
        ids, at = np.unique(np.concatenate([left, right]), return_inverse=True)
        left, right, block = at[: len(n)], at[len(n) :], np.full(len(ids), -1)
        block[right] = get("bj")
        two, three = rows["two"][0].as_py(), rows["three"][0].as_py()
        rim = np.zeros((len(ids), len(ids)))
        rim[left[~spoke], right[~spoke]] = n[~spoke]
        rim_c = np.zeros((k, len(ids), len(ids)))
        moments = np.array([get(v) for v in values])
        rim_c[:, left[~spoke], right[~spoke]] = moments[:, ~spoke]
        order = np.flatnonzero(spoke)[np.argsort(left[spoke], kind="stable")]
        out = []
        for own in np.split(order, np.flatnonzero(np.diff(left[order])) + 1) if len(order) else []:
            x, y = own[block[right[own]] == two], own[block[right[own]] == three]
            if not len(x) or not len(y):
                continue
            there = np.ix_(right[x], right[y])
            w = np.minimum(np.minimum.outer(n[x], n[y]), rim[there])
            if w.any():  # pairs of one block are met in both orders, those of two blocks in one
                times = 1.0 if two == three else 2.0
                out.append([ids[left[own[0]]], *(times * v for z in range(k) for v in (moments[z, x] @ (w * np.sign(rim_c[z][there])) @ moments[z, y], (w * np.abs(rim_c[z][there])).sum()))])
        cols = list(zip(*out, strict=True)) or [[] for _ in names]
        return pa.table([pa.array(cols[0], pa.int64()), *(pa.array(v, pa.float64()) for v in cols[1:])], names=names)

    parts = spokes.select(*cols).unionByName(rims.select(*cols)).groupBy("one", "two", "three").applyInArrow(sums, ", ".join([f"{names[0]} long", *(f"{x} double" for x in names[1:])]))
    squares = parts.groupBy("a").agg(*(F.sum(x).alias(x) for x in names[1:]))
    size = settle(squares.select("a", *(F.sqrt(F.greatest(F.lit(0.0), F.col(f"num{z}") / F.nullif(f"den{z}", F.lit(0.0)))).alias(f"s{z}") for z in range(k))))
    others = c.join(size.withColumnRenamed("a", "j"), "j").groupBy(F.col("i").alias("a")).agg(*(F.sum(F.col("n") * F.col(f"c{z}") * F.col(f"s{z}")).alias(f"o{z}") for z in range(k)))
    return size.join(others, "a", "left").select("a", *(F.when(F.col(f"o{z}") < 0, -F.col(f"s{z}")).otherwise(F.col(f"s{z}")).alias(f"s{z}") for z in range(k)))


def consensus(votes: DataFrame, item: list[str], annotator: str, label: str, labels: list[str]) -> Consensus:
    """The consensus label of each item, with the annotators' reliability.

    votes: one row for each item and annotator, with a label of labels; other labels and null annotators count for nothing.
    agreement is the share of agreeing pairs among the item's votes (null for one vote). Ties of the weighted votes go to the label named first
    in labels. An empty table gives no items and no annotators.

    Each label is told apart from the others by triplets: from the pairwise agreement on it, corrected for chance, come every annotator's
    sensitivity and false-positive rate for it, so that harsh, lenient and contrary annotators count for what they tell. A vote adds to each label the
    log odds of having been given, and of the other labels not having been given, were that label true. Annotators without a triplet take the
    mean of the others. triplet_accuracy is the share of right votes by these rates, accuracy that of votes equal to the consensus.

    No group is collected but votes of an item up to about CROWD and pairs of annotators of three blocks; everything else is a sum by annotator, by pair of
    annotators or by item.
    """
    spark, k = votes.sparkSession, len(labels)
    v = F.array_position(F.array(*map(F.lit, labels)), F.col(label)).cast("int") - 1
    named = settle(votes.select(F.struct(*item).alias("_item"), F.col(annotator).cast("string").alias("annotator"), v.alias("v")).filter("annotator is not null and v >= 0"))
    counts = named.groupBy("annotator").agg(F.count(F.lit(1)).alias("n"), *(F.count_if(F.col("v") == z).alias(f"n{z}") for z in range(k)))
    rates = settle(counts.withColumns({"a": F.monotonically_increasing_id(), "n_votes": F.col("n"), "m": F.array(*(F.col(f"n{z}") / F.col("n") for z in range(k)))}))
    total = rates.groupBy().agg(*(F.coalesce(F.sum(f"n{z}"), F.lit(0)).alias(f"n{z}") for z in range(k))).first()
    n_rows = sum(total)
    given = [(x + 1) / (n_rows + k) for x in total]  # how often each label is given at all
    known = settle(encode(named, rates.select("annotator", "n", "a"), ["annotator"], n_rows).select("_item", "a", "v"))
    spread = triplet_spread(pair_moments(known, rates, k, n_rows), k)
    usual = spread.groupBy().agg(*(F.avg(f"s{z}").alias(f"u{z}") for z in range(k)))
    quality = rates.join(spread, "a", "left").crossJoin(F.broadcast(usual))
    rate = []
    for z, p in enumerate(given):
        sd = (p * (1 - p)) ** 0.5
        d = F.coalesce(F.col(f"s{z}") / sd, F.col(f"u{z}") / sd, F.lit(USUAL))
        false = F.get("m", F.lit(z)) - p * d
        clip = lambda c: F.least(F.lit(MOST), F.greatest(F.lit(LEAST), c))
        rate.append((clip(false + d).alias(f"sens{z}"), clip(false).alias(f"false{z}")))
    quality = settle(quality.select("a", "annotator", "n", "n_votes", *(c for pair in rate for c in pair)))
    yes = [F.log(F.col(f"sens{z}") / F.col(f"false{z}")) for z in range(k)]
    no = [F.log((1 - F.col(f"sens{z}")) / (1 - F.col(f"false{z}"))) for z in range(k)]
    weights = quality.select("a", "n", *(F.struct(y.alias("yes"), x.alias("no")).alias(f"w{z}") for z, (y, x) in enumerate(zip(yes, no, strict=True))))
    weighed = encode(known, weights, ["a"], n_rows)
    score = lambda z: F.sum(F.when(F.col("v") == z, F.col(f"w{z}.yes")).otherwise(F.col(f"w{z}.no")))
    prior = [F.lit(p / (1 - p)) for p in given]
    sums = weighed.groupBy("_item").agg(F.count(F.lit(1)).alias("n"), F.array(*(F.round(score(z) + F.log(prior[z]), 9) for z in range(k))).alias("s"), *(F.count_if(F.col("v") == z).alias(f"n{z}") for z in range(k)))
    odds = F.transform("s", lambda x: F.exp(x - F.array_max("s")))
    same = sum((F.col(f"n{z}") * (F.col(f"n{z}") - 1) for z in range(k)), F.lit(0))
    best = F.array_position("s", F.array_max("s")).cast("int") - 1
    out = sums.select(
        "_item",
        F.col("n").alias("n_annotators"),
        F.get(F.array(*map(F.lit, labels)), best).alias("label"),
        best.alias("z"),
        (1 / F.aggregate(odds, F.lit(0.0), lambda s, x: s + x)).alias("confidence"),
        F.when(F.col("n") > 1, same / (F.col("n") * (F.col("n") - 1))).alias("agreement"),
    )
    equal = known.join(out.select("_item", "z"), "_item").groupBy("a").agg(F.avg((F.col("v") == F.col("z")).cast("double")).alias("accuracy"))
    right = sum((F.lit(p) * F.col(f"sens{z}") for z, p in enumerate(given)), F.lit(0.0))
    annotators = quality.join(equal, "a").select("annotator", "n_votes", right.alias("triplet_accuracy"), "accuracy", F.array(*(F.col(f"sens{z}") for z in range(k))).alias("sensitivity"))
    return Consensus(out.select("_item.*", "n_annotators", "label", "confidence", "agreement"), annotators)


#: The three statuses of a verdict.
STATUSES = ["covered", "partial", "missing"]


def usable_status(status: Column) -> Column:
    """covered, partial or missing, apart from case, surrounding white space and a final full stop; else null."""
    s = F.regexp_extract(F.lower(status), r"^[\s\p{Z}]*(covered|partial|missing)[\s\p{Z}]*\.?[\s\p{Z}]*$", 1)
    return F.nullif(s, F.lit(""))


def evaluation_votes(evaluation: DataFrame, problems: DataFrame) -> DataFrame:
    """A vote for each item of evaluation whose ref_index names an experiment of its problem, and judge."""
    there = problems.select("problem_id", F.posexplode("experiments").alias("ref_index", "_x")).select("problem_id", "ref_index").distinct()
    rows = evaluation.select("problem_id", "model", "condition", "ref_index", "judge", "run", "judged_at", usable_status(F.col("status")).alias("status"))
    item = ["problem_id", "model", "condition", "ref_index"]
    return one_vote_each(rows.filter("status is not null").join(there, ["problem_id", "ref_index"]), item, "judge", "status", "run", "judged_at")
