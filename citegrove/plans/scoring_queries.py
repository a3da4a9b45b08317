"""Queries of votes, metrics, statistics and reports over repeated judgments."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from citegrove.operators import scoring as s
from citegrove.plans.registry import REGISTRY
from citegrove.session import table

q = REGISTRY.add

_USABLE = r"nullif(regexp_extract(lower(status), '^\s*(covered|partial|missing)\s*\.?\s*$', 1), '')"
_PASSES = rf"""v as (select distinct problem_id, model, condition, ref_index, judge, run, judged_at, {_USABLE} as status, coalesce(covered_by, []) as covered_by, coalesce(len(reasoning_chain), 0) as chain from evaluation where ref_index is not null),
 g as (select problem_id, model, condition, ref_index, status, count(status) as n, min(judged_at) as first from v group by all),
 mv as (select problem_id, model, condition, ref_index, cast(sum(n) as bigint) as n, arg_min(status, (-n, first)) filter (where status is not null) as top, max(n) filter (where status is not null) as k from g group by all),
 m as (select *, case when k * 2 > n then top when n > 0 then 'CONTESTED' end as winner from mv)"""
_ITEMS = _PASSES + """, j as (select v.*, m.winner, v.status = m.winner or m.winner = 'CONTESTED' as agree from v join m using (problem_id, model, condition, ref_index)),
 it as (select problem_id, model, condition, ref_index, winner as status, coalesce(list_sort(list_distinct(flatten(list(covered_by) filter (where agree)))), []) as covered_by,
  avg(case status when 'covered' then 1.0 when 'partial' then 0.5 else 0.0 end) as mean_value, max(chain) filter (where agree) as chain, count(*) as passes from j group by all),
 iv as (select *, case status when 'covered' then 1.0::double when 'partial' then 0.5::double when 'missing' then 0.0::double when 'CONTESTED' then mean_value end as value,
  case status when 'covered' then 1.0::double when 'partial' then 0.5::double when 'missing' then 0.0::double when 'CONTESTED' then 0.0::double end as value0 from it)"""


def _passes(spark, d):
    usable = F.nullif(F.regexp_extract(F.lower("status"), r"^\s*(covered|partial|missing)\s*\.?\s*$", 1), F.lit(""))
    return s.ordered_passes(table(spark, d, "evaluation"), usable)


def _items(spark, d):
    return s.aggregate_runs(_passes(spark, d))


def r6(c, name):
    return F.round(c, 6).alias(name)


@q("majority_vote", f"with {_PASSES} select problem_id, model, condition, ref_index, n, top, winner from m")
def majority_vote(spark, d):
    return s.majority_vote(_passes(spark, d), s.ITEM, "status", "judged_at", tie=s.CONTESTED)


@q("aggregate_runs", f"with {_ITEMS} select problem_id, model, condition, ref_index, status, array_to_string(covered_by, ',') as covered_by, round(mean_value, 6) as mean_value, chain, passes from it")
def aggregate_runs(spark, d):
    i = _items(spark, d)
    return i.select(*s.ITEM, "status", F.array_join(F.col("covered_by").cast("array<string>"), ",").alias("covered_by"), r6("mean_value", "mean_value"), F.col("chain").cast("long").alias("chain"), "passes")


@q("run_statuses", f"with {_PASSES} select problem_id, model, condition, ref_index, string_agg(coalesce(status, '-'), ',' order by judged_at, status nulls first) as run_statuses from v group by all")
def run_statuses(spark, d):
    """The statuses of each item's passes in order of time."""
    r = s.run_statuses(_passes(spark, d))
    return r.select(*s.ITEM, F.array_join("run_statuses", ",", "-").alias("run_statuses"))


@q("run_scores", f"with {_ITEMS} select problem_id, model, condition, count(*) filter (where status = 'CONTESTED') as n_contested, max(passes) as judge_runs, round(avg(case when status = 'CONTESTED' then 0.0 else 1.0 end)::double, 6) as run_agreement from iv group by problem_id, model, condition")
def run_scores(spark, d):
    return s.run_scores(_items(spark, d), s.ARM).select(*s.ARM, "n_contested", "judge_runs", r6("run_agreement", "run_agreement"))


@q("label_vote", f"""with {_PASSES}, t as (select problem_id, ref_index, status, count(distinct judge) as n from v where status is not null group by all)
select problem_id, ref_index, array_to_string(list(status order by status), ',') as kept from t where n >= 2 group by all""")
def label_vote(spark, d):
    """Labels that two judges or more gave to a reference experiment."""
    t = _passes(spark, d).filter("status is not null").groupBy("problem_id", "ref_index", "status").agg(F.countDistinct("judge").alias("n")).filter("n >= 2")
    return t.groupBy("problem_id", "ref_index").agg(F.array_join(F.array_sort(F.collect_list("status")), ",").alias("kept"))


_RECALL = "count(*) as n, round(avg(value), 6) as recall, round(avg(case when status = 'covered' then 1.0::double when status is not null then 0.0::double end), 6) as strict"


@q("recall", f"with {_ITEMS} select problem_id, model, condition, {_RECALL}, round(avg(value0), 6) as recall_zero from iv group by problem_id, model, condition")
def recall(spark, d):
    """Recall of each arm, a contested item at its mean and at zero."""
    i = _items(spark, d)
    return i.groupBy(*s.ARM).agg(F.count(F.lit(1)).alias("n"), r6(F.avg(s.item_value()), "recall"), r6(F.avg((F.col("status") == "covered").cast("double")), "strict"), r6(F.avg(s.item_value("zero")), "recall_zero"))


@q("strict_recall", f"with {_ITEMS}, b as (select distinct problem_id, ref_index, role from (select problem_id, unnest(roles) as role, generate_subscripts(roles, 1) - 1 as ref_index from benchmark_problem)) select model, condition, count(*) as n, round(avg(case when status = 'covered' then 1.0::double when status is not null then 0.0::double end), 6) as strict from iv join b using (problem_id, ref_index) where role in ('control', 'confound') group by model, condition")
def strict_recall(spark, d):
    """Strict recall over the controls and confounds."""
    return _with_roles(spark, d).filter(F.col("role").isin(*s.RIGOUR)).groupBy("model", "condition").agg(F.count(F.lit(1)).alias("n"), r6(F.avg((F.col("status") == "covered").cast("double")), "strict"))


def _roles(spark, d):
    return table(spark, d, "benchmark_problem").select("problem_id", "field", F.posexplode("roles").alias("ref_index", "role")).distinct()


def _with_roles(spark, d):
    return _items(spark, d).join(_roles(spark, d), ["problem_id", "ref_index"])


_ROLED = _ITEMS + """, b as (select distinct problem_id, field, ref_index, role from (select problem_id, field, unnest(roles) as role, generate_subscripts(roles, 1) - 1 as ref_index from benchmark_problem)),
 ro as (select iv.*, b.field, b.role from iv join b using (problem_id, ref_index))"""


@q("role_slice", f"with {_ROLED} select condition, role, {_RECALL} from ro where role is not null group by condition, role")
def role_slice(spark, d):
    i = _with_roles(spark, d).filter("role is not null")
    return s.recall(i, ["condition", "role"]).select("condition", "role", "n", r6("recall", "recall"), r6("strict", "strict"))


@q("overlapping_groups", f"""with {_ROLED}, o as (select unnest(case when role in ('headline', 'apparatus') then ['obliged'] when role in ('control', 'confound') then ['obliged', 'rigour'] when role in ('mechanism', 'external') then ['beyond'] else [] end) as grp, * from ro)
select condition, grp, {_RECALL} from o group by condition, grp""")
def overlapping_groups(spark, d):
    """Groups of roles that overlap: an item counts in each of its groups."""
    groups = F.array_compact(F.array(F.when(F.col("role").isin(*s.OBLIGED), "obliged"), F.when(F.col("role").isin(*s.RIGOUR), "rigour"), F.when(F.col("role").isin(*s.BEYOND), "beyond")))
    i = _with_roles(spark, d).withColumn("grp", F.explode(groups))
    return s.recall(i, ["condition", "grp"]).select("condition", "grp", "n", r6("recall", "recall"), r6("strict", "strict"))


@q("score_run", f"""with {_ITEMS}, u as (select problem_id, model, condition, count(*) as n_reference, count(*) filter (where status = 'covered') as n_covered, count(*) filter (where status = 'partial') as n_partial,
  count(*) filter (where status = 'missing') as n_missing, count(*) filter (where status = 'CONTESTED') as n_contested, list_distinct(flatten(list(covered_by))) as used from iv group by all)
select * exclude (used), array_to_string(list_filter(range(0, 5), lambda x: not list_contains(used, x)), ',') as unused, round(len(list_filter(range(0, 5), lambda x: list_contains(used, x))) / 5::double, 6) as overlap from u""")
def score_run(spark, d):
    r = s.score_run(_items(spark, d), s.ARM, 5)
    return r.withColumn("unused", F.array_join(F.col("unused").cast("array<string>"), ",")).withColumn("overlap", F.round("overlap", 6))


@q("unused_proposed", f"with {_ITEMS}, ar as (select distinct problem_id, model, condition from iv), al as (select *, unnest(range(0, 5)) as proposal from ar), us as (select distinct problem_id, model, condition, unnest(covered_by)::bigint as proposal from iv) select al.* from al anti join us using (problem_id, model, condition, proposal)")
def unused_proposed(spark, d):
    """Experiments of each arm that no item lists."""
    left = s.score_run(_items(spark, d), s.ARM, 5).select(*s.ARM, F.explode("unused").alias("proposal"))
    return left.withColumn("proposal", F.col("proposal").cast("long"))


@q("recall_at_k", f"with {_ITEMS} select problem_id, model, condition, " + ", ".join(f"round(avg(case when list_min(covered_by) < {k} then coalesce(value0, 0) else 0.0 end)::double, 6) as r{k}" for k in (1, 3, 6)) + " from iv group by problem_id, model, condition")
def recall_at_k(spark, d):
    return _items(spark, d).groupBy(*s.ARM).agg(*(r6(s.recall_within(k), f"r{k}") for k in (1, 3, 6)))


_NAMED = ", ".join(f"count(*) filter (where status = 'covered' and ({' or '.join(f'list_contains(covered_by, {e})' for e in es)})) as n{''.join(map(str, es))}" for es in ((0,), (1,), (2,), (0, 1), (0, 2), (1, 2), (0, 1, 2)))


@q("matched_at_k", f"""with {_ITEMS}, h as (select problem_id, model, condition, count(*) as n_items, {_NAMED} from iv group by all),
 ma as (select *, least(3, n0 + 2, n1 + 2, n2 + 2, n01 + 1, n02 + 1, n12 + 1, n012) as matched from h)
select problem_id, model, condition, n_items, 3::bigint as k, matched, matched / 3::double as precision, 2 * matched / (3 + n_items)::double as f1 from ma""")
def matched_at_k(spark, d):
    """Largest strict matching among the first three experiments of each arm."""
    return s.matched(_items(spark, d), s.ARM, 3, 5)


@q("r_precision")
def r_precision(spark, d):
    """Precision among as many experiments as the arm has reference items, or as it proposed if fewer."""
    passes = _passes(spark, d)
    return s.matched(s.aggregate_runs(passes).join(s.n_proposed(passes, s.ARM), s.ARM), s.ARM, None, "n_proposed")


@q("audit_rates", rf"""with a as (select model, condition, case {_USABLE} when 'covered' then 'decides' when 'partial' then 'supports' when 'missing' then 'irrelevant' else 'tangential' end as bears,
  coalesce({_USABLE} = 'missing' and len(covered_by) > 0, false) as flawed, coalesce(run > 0, false) as dup from evaluation)
select model, condition, count(*) as n, round(avg((bears in ('decides', 'supports') and not flawed and not dup)::int), 4) as precision, round(avg((bears in ('decides', 'supports'))::int), 4) as bears_on_claim,
 {', '.join(f"round(avg((bears = '{k}')::int), 4) as {k}" for k in ('decides', 'supports', 'tangential', 'irrelevant'))}, round(avg(flawed::int), 4) as flawed, round(avg(dup::int), 4) as duplicate from a group by model, condition""")
def audit_rates(spark, d):
    e = table(spark, d, "evaluation")
    status = F.nullif(F.regexp_extract(F.lower("status"), r"^\s*(covered|partial|missing)\s*\.?\s*$", 1), F.lit(""))
    bears = F.when(status == "covered", "decides").when(status == "partial", "supports").when(status == "missing", "irrelevant").otherwise("tangential")
    rows = e.withColumn("bears", bears).withColumn("flaw", (status == "missing") & (F.size("covered_by") > 0)).withColumn("dup", F.col("run") > 0)
    return s.audit_rates(rows, ["model", "condition"], "bears", F.col("flaw"), F.col("dup"))


# ---- reports -------------------------------------------------------------

_ARMSQL = _ITEMS + ", ar as (select problem_id, model, condition, avg(value) as recall from iv group by all)"


def _arms(spark, d):
    return s.recall(_items(spark, d), s.ARM)


@q("arm_means_pivot", f"with {_ARMSQL} select model, " + ", ".join(f"round(avg(recall) filter (where condition = '{c}'), 6) as {c}" for c in s.ARMS) + " from ar group by model")
def arm_means_pivot(spark, d):
    return _arms(spark, d).groupBy("model").pivot("condition", s.ARMS).agg(F.round(F.avg("recall"), 6))


@q("pooled_grouping_sets", f"with {_ARMSQL} select case when grouping(model) = 1 then 'pooled' else model end as model, condition, count(*) as n, round(avg(recall), 6) as recall from ar group by grouping sets ((model, condition), (condition))")
def pooled_grouping_sets(spark, d):
    a = _arms(spark, d)
    g = a.groupingSets([[F.col("model"), F.col("condition")], [F.col("condition")]], F.col("model"), F.col("condition"))
    g = g.agg(F.grouping("model").alias("g"), F.count(F.lit(1)).alias("n"), F.round(F.avg("recall"), 6).alias("recall"))
    return g.select(F.when(F.col("g") == 1, F.lit("pooled")).otherwise(F.col("model")).alias("model"), "condition", "n", "recall")


_ONE = _PASSES + ", one as (select problem_id, model, condition, ref_index, judge, arg_max(status, (judged_at, run, status)) as status from v where status is not null and judge is not null group by all)"


def _one(spark, d):
    v = _passes(spark, d).filter("status is not null and judge is not null")
    return v.groupBy(*s.ITEM, "judge").agg(F.max_by("status", F.struct("judged_at", "run", "status")).alias("status"))


# few claims have a model's arms in two conditions here, so the pairs are those of a judge and model over whatever they saw
_PAIRED = _ONE + """, us as (select judge, model, condition, avg(case status when 'covered' then 1.0::double when 'partial' then 0.5::double else 0.0::double end) as recall from one group by all),
 pd as (select judge, model, avg(recall) filter (where condition = 'nocard') as a, avg(recall) filter (where condition = 'card') as b from us group by all),
 pr as (select judge, model, a, b, b - a as delta from pd where a is not null and b is not null)"""


def _paired(spark, d):
    seen = _one(spark, d).groupBy("judge", "model", "condition").agg(F.avg(s.value_of(F.col("status"))).alias("recall"))
    return s.paired(seen, ["judge", "model"], "condition", "recall", "nocard", "card")


@q("paired_delta", f"with {_PAIRED} select judge, model, round(a, 6) as a, round(b, 6) as b, round(delta, 6) as delta from pr")
def paired_delta(spark, d):
    return _paired(spark, d).select("judge", "model", r6("a", "a"), r6("b", "b"), r6("delta", "delta"))


@q("per_claim_delta", f"with {_PAIRED} select judge, count(*) as n, round(avg(a), 6) as a, round(avg(b), 6) as b, round(avg(delta), 6) as delta from pr group by judge")
def per_claim_delta(spark, d):
    return _paired(spark, d).groupBy("judge").agg(F.count(F.lit(1)).alias("n"), *(r6(F.avg(c), c) for c in ("a", "b", "delta")))


@q("up_down_ties", f"with {_PAIRED} select model, count(*) filter (where delta > 0.0005) as up, count(*) filter (where delta < -0.0005) as down, count(*) filter (where abs(delta) <= 0.0005) as ties, arg_max(judge, (round(delta, 9), judge)) as best, arg_min(judge, (round(delta, 9), judge)) as worst from pr group by model")
def up_down_ties(spark, d):
    at = F.struct(F.round("delta", 9), "judge")
    return _paired(spark, d).groupBy("model").agg(
        F.count_if(F.col("delta") > 0.0005).alias("up"), F.count_if(F.col("delta") < -0.0005).alias("down"), F.count_if(F.abs("delta") <= 0.0005).alias("ties"),
        F.max_by("judge", at).alias("best"), F.min_by("judge", at).alias("worst"),
    )


_DRAW = """rb as (select range as b from range({rounds})), nn as (select model, count(*) as n, {mean} as mean from pn group by model),
 dr as (select model, b, cast(('0x' || substr(md5('{seed}:' || b || ':' || d), 1, 8)) as bigint) % n as i from (select model, n, b, unnest(range(0, n)) as d from nn, rb)),
 me as (select dr.model, b, {mean} as x from dr join pn on pn.model = dr.model and pn.i = dr.i group by dr.model, b),
 rk as (select model, x, row_number() over (partition by model order by x) - 1 as at_ from me),
 en as (select model, max(x) filter (where at_ = {lo}) as lo, max(x) filter (where at_ = {hi}) as hi from rk group by model)"""


@q("bootstrap_hash", f"with {_PAIRED}, pn as (select model, delta as v, row_number() over (partition by model order by judge) - 1 as i from pr), " + _DRAW.format(rounds=400, seed="s0", mean="avg(v)", lo=10, hi=390) + " select model, n, round(mean, 6) as mean, round(lo, 6) as lo, round(hi, 6) as hi, lo > 0 or hi < 0 as significant from nn join en using (model)")
def bootstrap_hash(spark, d):
    """Percentile interval of each model's mean delta, by hashed resamples."""
    b = s.hash_bootstrap(_paired(spark, d), ["model"], F.col("delta"), "judge", 400, "s0")
    return b.select("model", "n", r6("mean", "mean"), r6("lo", "lo"), r6("hi", "hi"), ((F.col("lo") > 0) | (F.col("hi") < 0)).alias("significant"))


@q("bootstrap_seeded")
def bootstrap_seeded(spark, d):
    """The same with Python's generator and a seed."""
    return s.seeded_bootstrap(_paired(spark, d), ["model"], "delta", "judge", rounds=1000)


_RATIO = _ONE + """, wo as (select *, case status when 'covered' then 1.0::double when 'partial' then 0.5::double else 0.0::double end as value from one),
 cl as (select judge, model, sum(case when condition = 'card' then value end) - sum(case when condition = 'nocard' then value end) as v, count(*) filter (where condition in ('card', 'nocard')) as m from wo group by all),
 pn as (select model, v, m, row_number() over (partition by model order by judge) - 1 as i from cl where v is not null)"""


@q("bootstrap_ratio", f"with {_RATIO}, " + _DRAW.format(rounds=400, seed="r0", mean="sum(v) / sum(m)", lo=10, hi=390) + " select model, n, round(mean, 6) as mean, round(lo, 6) as lo, round(hi, 6) as hi from nn join en using (model)")
def bootstrap_ratio(spark, d):
    """Interval of a ratio of sums, whole judges resampled."""
    i = _one(spark, d).withColumn("value", s.value_of(F.col("status")))
    part = lambda c: F.sum(F.when(F.col("condition") == c, F.col("value")))
    claims = i.groupBy("judge", "model").agg((part("card") - part("nocard")).alias("v"), F.count_if(F.col("condition").isin("card", "nocard")).alias("m")).filter("v is not null")
    b = s.hash_bootstrap(claims, ["model"], F.col("v"), "judge", 400, "r0", size=F.col("m"))
    return b.select("model", "n", r6("mean", "mean"), r6("lo", "lo"), r6("hi", "hi"))


@q("micro_ratio", f"with {_ITEMS} select model, condition, cast(sum(value) as double) as total, count(value) as n, round(sum(value) / count(value), 6) as ratio from iv group by model, condition having count(value) > 0")
def micro_ratio(spark, d):
    i = _items(spark, d).withColumn("value", s.item_value()).groupBy("model", "condition")
    g = i.agg(F.sum("value").alias("total"), F.count("value").alias("n")).filter("n > 0")
    return g.select("model", "condition", "total", "n", r6(F.col("total") / F.col("n"), "ratio"))


@q("unanimous_share", f"with {_PASSES}, c as (select problem_id, model, condition, ref_index, count(distinct status) as k, count(status) as n from v group by all) select condition, count(*) as n_items, round(avg((k = 1)::int), 6) as unanimous, count(*) filter (where k > 1) as contested from c where n > 1 group by condition")
def unanimous_share(spark, d):
    c = _passes(spark, d).groupBy(*s.ITEM).agg(F.countDistinct("status").alias("k"), F.count("status").alias("n")).filter("n > 1")
    return c.groupBy("condition").agg(F.count(F.lit(1)).alias("n_items"), r6(F.avg((F.col("k") == 1).cast("int")), "unanimous"), F.count_if(F.col("k") > 1).alias("contested"))


@q("confusion_pivot", f"with {_ONE} select a.status as first, count(*) filter (where b.status = 'covered') as covered, count(*) filter (where b.status = 'partial') as partial, count(*) filter (where b.status = 'missing') as missing from one a join one b using (problem_id, model, condition, ref_index) where a.judge < b.judge group by a.status")
def confusion_pivot(spark, d):
    one = _one(spark, d)
    pairs = one.join(one.select(*s.ITEM, F.col("judge").alias("other"), F.col("status").alias("second")), s.ITEM).filter("judge < other")
    return pairs.groupBy(F.col("status").alias("first")).pivot("second", ["covered", "partial", "missing"]).agg(F.count(F.lit(1))).na.fill(0)


@q("rater_agreement", f"with {_ONE} select a.judge as judge_a, b.judge as judge_b, count(*) as n, round(avg((a.status = b.status)::int), 6) as agree from one a join one b using (problem_id, model, condition, ref_index) where a.judge < b.judge group by all")
def rater_agreement(spark, d):
    one = _one(spark, d)
    pairs = one.withColumnRenamed("judge", "judge_a").join(one.select(*s.ITEM, F.col("judge").alias("judge_b"), F.col("status").alias("other")), s.ITEM).filter("judge_a < judge_b")
    return pairs.groupBy("judge_a", "judge_b").agg(F.count(F.lit(1)).alias("n"), r6(F.avg((F.col("status") == F.col("other")).cast("int")), "agree"))


@q("pairwise_agreement", f"with {_PASSES}, l as (select problem_id, model, condition, ref_index, judge, run, arg_max(status, (judged_at, status)) as status from v where status is not null and judge is not null group by all) select a.judge, count(*) as n, round(avg((a.status = b.status)::int), 6) as agree from l a join l b using (problem_id, model, condition, ref_index, judge) where a.run < b.run group by a.judge")
def pairwise_agreement(spark, d):
    """Agreement of a judge's passes with each other."""
    v = _passes(spark, d).filter("status is not null and judge is not null")
    one = v.groupBy(*s.ITEM, "judge", "run").agg(F.max_by("status", F.struct("judged_at", "status")).alias("status"))
    pairs = one.join(one.select(*s.ITEM, "judge", F.col("run").alias("other"), F.col("status").alias("second")), [*s.ITEM, "judge"]).filter("run < other")
    return pairs.groupBy("judge").agg(F.count(F.lit(1)).alias("n"), r6(F.avg((F.col("status") == F.col("second")).cast("int")), "agree"))


@q("label_mix", f"with {_PASSES}, c as (select judge, status, count(*) as n from v where status is not null group by all) select judge, status, n, round(n / sum(n) over (partition by judge), 6) as share from c")
def label_mix(spark, d):
    c = _passes(spark, d).filter("status is not null").groupBy("judge", "status").agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("judge")), 6))


@q("complete_case_intersect", f"with {_ONE} select judge, model, ref_index from (select distinct judge, model, ref_index, condition from one where condition in ('nocard', 'rag', 'card')) group by all having count(*) = 3")
def complete_case_intersect(spark, d):
    """What a judge saw of a model in all three arms."""
    i = _one(spark, d).select("judge", "model", "ref_index", "condition").distinct()
    arms = [i.filter(F.col("condition") == c).drop("condition") for c in s.ARMS]
    return arms[0].intersect(arms[1]).intersect(arms[2])


@q("suite_report", f"""with {_ONE}, x as (select *, status = 'covered' as ok, ref_index = 0 as target from one),
 pa as (select problem_id, model, condition, ref_index, judge, run, arg_max(status, (judged_at, status)) as status from v where status is not null and judge is not null group by all),
 ag as (select judge, count(*) as n_again, count(*) filter (where k = 1) as same from (select judge, count(distinct status) as k, count(*) as n from pa group by problem_id, model, condition, ref_index, judge) where n > 1 group by judge),
 r as (select judge, count(*) filter (where target) as n_target, count(*) filter (where target and ok) as passed, count(*) filter (where not target) as n_other, count(*) filter (where not target and not ok) as collateral from x group by judge)
select r.*, coalesce(n_again, 0) as n_again, round(same / n_again::double, 6) as self_agreement from r left join ag using (judge)""")
def suite_report(spark, d):
    """Passes on the target item, collateral misses on the others, and the share of items on which all passes agree, by judge."""
    x = _one(spark, d).withColumn("ok", F.col("status") == "covered").withColumn("target", F.col("ref_index") == 0)
    t, ok = F.col("target"), F.col("ok")
    r = x.groupBy("judge").agg(F.count_if(t).alias("n_target"), F.count_if(t & ok).alias("passed"), F.count_if(~t).alias("n_other"), F.count_if(~t & ~ok).alias("collateral"))
    v = _passes(spark, d).filter("status is not null and judge is not null")
    runs = v.groupBy(*s.ITEM, "judge", "run").agg(F.max_by("status", F.struct("judged_at", "status")).alias("status"))
    again = runs.groupBy(*s.ITEM, "judge").agg(F.countDistinct("status").alias("k"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    agree = again.groupBy("judge").agg(F.count(F.lit(1)).alias("n_again"), r6(F.avg((F.col("k") == 1).cast("int")), "self_agreement"))
    return r.join(agree, "judge", "left").withColumn("n_again", F.coalesce("n_again", F.lit(0)))


@q("band_check", f"with {_ARMSQL}, bd(condition, low, high) as (values ('nocard', 0.2, 0.5), ('rag', 0.4, 0.6), ('retr', 0.4, 0.6), ('card', 0.5, 0.9)) select condition, n, round(recall, 6) as recall, recall between low::double and high::double as in_band from (select condition, count(*) as n, avg(recall) as recall from ar group by condition) join bd using (condition)")
def band_check(spark, d):
    """Whether each arm's mean lies in the band expected of it."""
    bands = spark.createDataFrame([("nocard", 0.2, 0.5), ("rag", 0.4, 0.6), ("retr", 0.4, 0.6), ("card", 0.5, 0.9)], "condition string, low double, high double")
    m = _arms(spark, d).groupBy("condition").agg(F.count(F.lit(1)).alias("n"), F.avg("recall").alias("recall"))
    return m.join(F.broadcast(bands), "condition").select("condition", "n", r6("recall", "recall"), F.col("recall").between(F.col("low"), F.col("high")).alias("in_band"))


@q("field_recall", f"with {_ROLED} select coalesce(field, 'Other') as field, condition, {_RECALL} from ro group by all")
def field_recall(spark, d):
    i = _with_roles(spark, d).withColumn("field", F.coalesce("field", F.lit("Other")))
    return s.recall(i, ["field", "condition"]).select("field", "condition", "n", r6("recall", "recall"), r6("strict", "strict"))


@q("attribution", f"""with {_ARMSQL}, cd as (select distinct problem_id, role as card from (select problem_id, unnest(roles) as role from benchmark_problem) where role is not null),
 x as (select card, problem_id, avg(recall) as recall from ar join cd using (problem_id) where condition = 'card' group by all)
select card, count(*) as n, round(avg(recall), 6) as mean, round(min(recall), 6) as low, round(max(recall), 6) as high from x group by card""")
def attribution(spark, d):
    """Each claim's recall credited to every role that it uses; the groups overlap."""
    cards = table(spark, d, "benchmark_problem").select("problem_id", F.explode("roles").alias("card")).filter("card is not null").distinct()
    x = _arms(spark, d).filter("condition = 'card'").join(cards, "problem_id").groupBy("card", "problem_id").agg(F.avg("recall").alias("recall"))
    return x.groupBy("card").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("recall"), "mean"), r6(F.min("recall"), "low"), r6(F.max("recall"), "high"))


@q("percentile_index", "select source, n_chars as p90 from (select source, n_chars, row_number() over (partition by source order by n_chars) - 1 as i, count(*) over (partition by source) as n from documents) where i = cast(floor(0.9 * n) as bigint)")
def percentile_index(spark, d):
    """The value at index 0.9 n of the sorted lengths of each source, not interpolated."""
    w = Window.partitionBy("source")
    x = table(spark, d, "documents").select("source", "n_chars", (F.row_number().over(w.orderBy("n_chars")) - 1).alias("i"), F.count(F.lit(1)).over(w).alias("n"))
    return x.filter(F.col("i") == F.floor(F.lit(0.9) * F.col("n"))).select("source", F.col("n_chars").alias("p90"))
