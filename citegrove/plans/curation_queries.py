"""Queries of curation, data quality, leakage and labels."""

from __future__ import annotations


from pyspark.sql import Window
from pyspark.sql import functions as F

from citegrove.functions import text
from citegrove.operators import curation as c
from citegrove.operators import quality
from citegrove.plans.registry import REGISTRY
from citegrove.plans.sqltext import ALIASES, CANON_GENERIC, CANON_MODEL, NORM_TITLE, SQUASH, strip_sql
from citegrove.plans.text_queries import CONTENT
from citegrove.session import table

q = REGISTRY.add

_N = "coalesce(len(list_distinct(list_filter(evidence, lambda e: trim(e) <> ''))), 0)"
_RES = "('datasets', 'models', 'baselines', 'metrics')"
_PRUNED = f"""i as (select *, {_N} as n, key in {_RES} as resource from menu_item), r as (select *, resource and not max(n >= 2) over (partition by subfield, key) as relaxed from i),
 p as (select * from r where not resource or relaxed or n >= 2)"""
_CAP = "case key when 'threats' then 14 when 'validity_checks' then 6 when 'evidence_standards' then 6 when 'protocols' then 8 when 'baselines' then 6 when 'metrics' then 6 when 'datasets' then 4 else 8 end"


def _items(spark, d):
    return table(spark, d, "menu_item")


def _pruned(spark, d):
    return c.prune_relaxed(_items(spark, d), ["subfield", "key"])


@q("prune_relaxed", f"with {_PRUNED} select item_id, subfield, key, n, relaxed from p")
def prune_relaxed(spark, d):
    return _pruned(spark, d).select("item_id", "subfield", "key", F.col("n").cast("long").alias("n"), "relaxed")


@q("round_robin", f"""with {_PRUNED}, t as (select *, row_number() over (partition by key, subfield order by n desc, name, item_id) as turn from p),
 z as (select *, row_number() over (partition by key order by turn, subfield) as place from t) select key, item_id, place from z where place <= {_CAP}""")
def round_robin(spark, d):
    """The slots of each key dealt over the subfields in turn, by evidence within a subfield."""
    r = c.round_robin(_pruned(spark, d), ["key"], "subfield", [F.desc("n"), F.col("name"), F.col("item_id")], c.cap_of(F.col("key"), "0.4"))
    return r.select("key", "item_id", F.col("place").cast("long").alias("place"))


@q("kind_quota", f"""with i as (select *, {_N} as n from menu_item where key = 'threats' and kind in ('control', 'confound')), a as (select *, row_number() over (partition by subfield, kind order by n desc, name, item_id) as spot from i),
 e as (select *, case when spot > 3 then row_number() over (partition by subfield, spot > 3 order by (kind <> 'control')::int, spot) end as extra, sum((spot <= 3)::int) over (partition by subfield) as taken from a)
select subfield, item_id, kind from e where spot <= 3 or extra <= 6 - taken""")
def kind_quota(spark, d):
    """Six threats of each subfield, half controls and half confounds, with the rest of one kind given to the other."""
    i = _items(spark, d).filter("key = 'threats'").withColumn("n", c.n_evidence(F.col("evidence")))
    return c.kind_quota(i, ["subfield"], [F.desc("n"), F.col("name"), F.col("item_id")], 6).select("subfield", "item_id", "kind")


@q("allocate_exact", f"""with recursive i as (select key, lower(name) as low, min(item_id) as item_id, min(name) as name, list_distinct(list(subfield) filter (where subfield <> '')) as tags, max({_N}) as n from menu_item where name is not null group by key, lower(name)),
 o as (select *, row_number() over (partition by key order by n desc, name, item_id) as at_ from i),
 la as (select key, lane, list(item_id order by at_) as own, row_number() over (partition by key order by lane) - 1 as number from (select key, item_id, at_, unnest(tags) as lane from o) group by key, lane),
 lk as (select key, count(*) as lanes from la group by key),
 z as (select key, 0::bigint as step, []::bigint[] as dealt from lk
  union all select z.key, z.step + 1, case when y.pick is null or len(z.dealt) >= 20 then z.dealt else list_append(z.dealt, y.pick) end
   from z join lk using (key) join la on la.key = z.key and la.number = z.step % lk.lanes, lateral (select list_filter(la.own, lambda c: not list_contains(z.dealt, c))[1] as pick) y where z.step < lk.lanes * 20),
 d as (select key, arg_max(dealt, step) as dealt from z group by key),
 r as (select o.key, o.item_id, len(coalesce(d.dealt, [])) + row_number() over (partition by o.key order by o.at_) as place from o left join d using (key) where not list_contains(coalesce(d.dealt, []), o.item_id)),
 u as (select key, unnest(dealt) as item_id, generate_subscripts(dealt, 1) as place from d union all select key, item_id, place from r)
select key, item_id, place from u where place <= 20""")
def allocate_exact(spark, d):
    """The slots of each key for items of several subfields: an item of one name carries all the subfields that list it."""
    i = _items(spark, d).filter("name is not null").groupBy("key", F.lower("name").alias("low")).agg(
        F.min("item_id").alias("item_id"), F.min("name").alias("name"), F.array_sort(F.collect_set("subfield")).alias("subfields"), F.max(c.n_evidence(F.col("evidence"))).alias("n")
    )
    return c.allocate_groups(i.select("key", "item_id", "name", "subfields", "n"), "key", 20)


@q("jaccard_pairs", f"""with w as (select item_id, subfield, key, unnest({CONTENT}) as word, len({CONTENT}) as n from menu_item where key in ('threats', 'evidence_standards', 'protocols', 'validity_checks')),
 p as (select a.item_id as item_a, b.item_id as item_b, a.n as na, b.n as nb, count(*) as k from w a join w b on a.subfield = b.subfield and a.key = b.key and a.word = b.word and a.item_id < b.item_id group by all)
select item_a, item_b, round(k / (na + nb - k)::double, 6) as jaccard from p where k >= 0.6::double * (na + nb - k) or (k = least(na, nb) and k >= 2)""")
def jaccard_pairs(spark, d):
    """Design items of one subfield and key that say the same: shared content words, or one within the other."""
    i = _items(spark, d).filter(F.col("key").isin("threats", "evidence_standards", "protocols", "validity_checks") & F.col("subfield").isNotNull())
    p = c.similar_names(i.select("subfield", "key", F.col("item_id").alias("id"), text.content_words(F.col("name")).alias("words")), ["subfield", "key"])
    return p.select(F.least("a", "b").alias("item_a"), F.greatest("a", "b").alias("item_b"), F.round(F.col("k") / (F.col("na") + F.col("nb") - F.col("k")), 6).alias("jaccard"))


@q("alias_group", f"""with a as (select subfield, key, item_id, unnest({ALIASES('name')}) as alias from menu_item)
select subfield, key, alias, min(item_id) as first_item, count(*) as n from a group by all""")
def alias_group(spark, d):
    """Items of one subfield and key under each of their names."""
    return c.alias_edges(_items(spark, d), ["subfield", "key"])


_CANON = f"case when key in ('models', 'baselines') then {CANON_MODEL('name')} else {CANON_GENERIC('name')} end"
_SLOTS = f"""nn as (select key, coalesce(kind, '') as kind, {strip_sql('name')} as name, {_CANON} as canon, item_id from menu_item where name is not null),
 na as (select key, kind, name, canon, min(item_id) as node, list_distinct(list_concat({ALIASES('name')}, [{SQUASH('canon')}])) as al from nn where canon <> '' group by key, kind, name, canon),
 nr as (select *, row_number() over (partition by key, kind order by node) as i from na),
 z as (select key, kind, 0::bigint as i, []::struct(slot bigint, al varchar[])[] as slots, null::bigint as node, null::bigint as slot from na group by key, kind
  union all select z.key, z.kind, nr.i, case when y.at_ is null then list_append(z.slots, {{'slot': nr.node, 'al': nr.al}}) else list_transform(z.slots, lambda s: case when s.slot = y.at_ then {{'slot': s.slot, 'al': list_distinct(list_concat(s.al, nr.al))}} else s end) end, nr.node, coalesce(y.at_, nr.node)
   from z join nr on nr.key = z.key and nr.kind = z.kind and nr.i = z.i + 1, lateral (select list_filter(z.slots, lambda s: list_has_any(s.al, nr.al))[1].slot as at_) y)"""


@q("alias_merge_exact", f"with recursive {_SLOTS} select z.key, z.kind, nr.name, z.slot from z join nr on nr.key = z.key and nr.kind = z.kind and nr.node = z.node")
def alias_merge_exact(spark, d):
    """The exact greedy merge of all subfields' items by their names, kinds kept apart."""
    return c.alias_slots(_items(spark, d)).select("key", "kind", "name", "slot")


@q("absorb_exact", f"""with recursive r as (select item_id, subfield, key, coalesce(kind, '') as kind, {CONTENT} as words, {_N} as n, name from menu_item where name is not null and key in ('threats', 'evidence_standards', 'protocols', 'validity_checks')),
 o as (select *, row_number() over (partition by subfield, key, kind order by n desc, length(name), item_id) as i from r),
 z as (select subfield, key, kind, 0::bigint as i, []::struct(host bigint, words varchar[])[] as hosts, null::bigint as item_id, null::bigint as host from r group by subfield, key, kind
  union all select z.subfield, z.key, z.kind, o.i, case when y.at_ is null then list_append(z.hosts, {{'host': o.item_id, 'words': o.words}}) else z.hosts end, o.item_id, coalesce(y.at_, o.item_id)
   from z join o on o.subfield is not distinct from z.subfield and o.key = z.key and o.kind = z.kind and o.i = z.i + 1, lateral (select list_filter(z.hosts, lambda s: len(s.words) > 0 and len(o.words) > 0 and
    (len(list_intersect(s.words, o.words)) >= 0.6::double * len(list_distinct(list_concat(s.words, o.words))) or (len(list_intersect(s.words, o.words)) = least(len(s.words), len(o.words)) and len(list_intersect(s.words, o.words)) >= 2)))[1].host as at_) y)
select subfield, key, kind, item_id, host from z where item_id is not null""")
def absorb_exact(spark, d):
    """The exact leader clustering of design items within a subfield."""
    i = _items(spark, d).filter(F.col("key").isin("threats", "evidence_standards", "protocols", "validity_checks")).withColumn("kind", F.coalesce("kind", F.lit("")))
    return c.absorb(i, ["subfield", "key", "kind"])


@q("menu_merged", f"""with recursive {_SLOTS}, ro as (select m.*, x.slot from menu_item m join (select z.key, z.kind, nr.name, z.slot from z join nr on nr.key = z.key and nr.kind = z.kind and nr.node = z.node) x on x.key = m.key and x.kind = coalesce(m.kind, '') and x.name = {strip_sql('m.name')}),
 ev as (select slot, array_to_string(list_sort(list_distinct(list(e))), '|') as evidence from (select slot, unnest(evidence) as e from ro) where trim(e) <> '' group by slot),
 sh as (select z.slot, arg_max(nr.canon, (length(nr.canon), -nr.node)) as name from z join nr on nr.key = z.key and nr.kind = z.kind and nr.node = z.node group by z.slot)
select ro.slot as item_id, any_value(ro.key) as key, any_value(sh.name) as name, coalesce(any_value(ev.evidence), '') as evidence, array_to_string(list_sort(list_distinct(list(ro.subfield) filter (where trim(ro.subfield) <> ''))), '|') as subfields,
 arg_max(ro.detail, (length(ro.detail), -ro.item_id)) filter (where ro.detail <> '') as detail from ro join sh on sh.slot = ro.slot left join ev on ev.slot = ro.slot group by ro.slot""")
def menu_merged(spark, d):
    """The merged menu of all subfields: the longest name of each slot, united evidence and subfields, the longest detail."""
    m = c.merge_menu(_items(spark, d))
    return m.select("item_id", "key", "name", F.array_join("evidence", "|").alias("evidence"), F.nullif(F.array_join("subfields", "|"), F.lit("")).alias("subfields"), "detail")


@q("claim_card")
def claim_card(spark, d):
    """The whole chain: merge, absorption, pruning and allocation of a claim's card in format 2."""
    card = c.curate(_items(spark, d), fmt="2")
    return card.select("key", "place", "item_id", "name", "kind", F.size("evidence").alias("n_evidence"), F.array_join("subfields", "|").alias("subfields"), F.array_join("variants", "|").alias("variants"))


@q("curation_report")
def curation_report(spark, d):
    """Items in and out of each key of the claim's card, and the slots of each subfield."""
    items = _items(spark, d)
    r = c.curation_report(c.absorb_design(c.merge_menu(items)), c.curate(items, fmt="2"))
    return r.select("key", "n_in", "n_out", "relaxed", F.to_json("by_subfield").alias("by_subfield"))


_W = SQUASH('name')
_B = SQUASH(r"regexp_replace(name, '\(.*?\)', '', 'g')")


@q("grounding_guard", f"""with e as (select item_id, name, unnest(evidence) as title from menu_item where key in {_RES} and name is not null), p as (select item_id, any_value(name) as name, list({SQUASH("title")}) as pool from e where title is not null group by item_id)
select item_id, len(list_filter(pool, lambda t: ({_W} <> '' and contains(t, {_W})) or ({_B} <> '' and contains(t, {_B})) or (length({_W}) >= 6 and len(list_filter(range(1, greatest(2, length({_W}) - 4)), lambda i: contains(t, substr({_W}, i::int, 6)))) > 0))) > 0 as grounded from p""")
def grounding_guard(spark, d):
    """Whether each resource is named, whole, without brackets or by six letters in a row, in a title that vouches for it."""
    i = _items(spark, d).filter(F.col("key").isin(*c.RESOURCES) & F.col("name").isNotNull() & F.exists("evidence", lambda t: t.isNotNull()))
    return i.select("item_id", c.grounded(F.col("name"), F.col("evidence")).alias("grounded"))


@q("render_section", f"""with {_PRUNED}, z as (select *, row_number() over (partition by subfield, key order by n desc, name, item_id) as rank from p)
select subfield, key, string_agg('- ' || name || case when coalesce(role, '') <> '' then ' (' || role || ')' else '' end || case when coalesce(detail, '') <> '' then ': ' || detail else '' end, chr(10) order by rank) as section from z where rank <= 20 and name is not null group by subfield, key""")
def render_section(spark, d):
    """The card's sections: twenty items of each subfield and key, a line each."""
    w = Window.partitionBy("subfield", "key").orderBy(F.desc("n"), "name", "item_id")
    r = _pruned(spark, d).withColumn("rank", F.row_number().over(w)).filter("rank <= 20 and name is not null")
    part = lambda col, a, z: F.when(F.coalesce(col, F.lit("")) != "", F.concat(F.lit(a), F.col(col), F.lit(z))).otherwise("")
    line = F.concat(F.lit("- "), "name", part("role", " (", ")"), part("detail", ": ", ""))
    g = r.groupBy("subfield", "key").agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("x"))
    return g.select("subfield", "key", F.array_join(F.transform("x", lambda x: x["line"]), "\n").alias("section"))


@q("curation_stats", f"""with {_PRUNED} select i.subfield, i.key, count(*) as n_in, (select count(*) from p where p.subfield is not distinct from i.subfield and p.key = i.key) as n_out, coalesce((select bool_or(relaxed) from p where p.subfield is not distinct from i.subfield and p.key = i.key), false) as relaxed from i group by i.subfield, i.key""")
def curation_stats(spark, d):
    """Items in and out of each subfield and key, and whether the evidence threshold was relaxed."""
    n_in = _items(spark, d).groupBy("subfield", "key").agg(F.count(F.lit(1)).alias("n_in"))
    out = _pruned(spark, d).groupBy("subfield", "key").agg(F.count(F.lit(1)).alias("n_out"), F.max("relaxed").alias("relaxed"))
    j = n_in.join(out.withColumnsRenamed({"subfield": "s", "key": "k"}), F.col("subfield").eqNullSafe(F.col("s")) & (F.col("key") == F.col("k")), "left")
    return j.select("subfield", "key", "n_in", F.coalesce("n_out", F.lit(0)).alias("n_out"), F.coalesce("relaxed", F.lit(False)).alias("relaxed"))


# ---- labels and taxonomy -------------------------------------------------


@q("listagg_sorted", "select coalesce(nullif(area, ''), 'Other') as area, string_agg(task, ', ' order by task) as tasks from taxonomy group by 1")
def listagg_sorted(spark, d):
    t = table(spark, d, "taxonomy").withColumn("area", F.coalesce(F.nullif("area", F.lit("")), F.lit("Other")))
    return t.groupBy("area").agg(F.array_join(F.array_sort(F.collect_list("task")), ", ").alias("tasks"))


@q("label_freq", "select f as label, count(*) as n, count(distinct venue) as n_venues, min(seq) as first from (select seq, venue, unnest(fields_of_study) as f from paper) where f is not null group by f")
def label_freq(spark, d):
    p = table(spark, d, "paper").select("seq", "venue", F.explode("fields_of_study").alias("label")).filter("label is not null")
    return p.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("venue").alias("n_venues"), F.min("seq").alias("first"))


@q("support_having", "select f as label, count(distinct seq) as n from (select seq, unnest(fields_of_study) as f from paper) where f is not null group by f having count(distinct seq) >= 100")
def support_having(spark, d):
    p = table(spark, d, "paper").select("seq", F.explode("fields_of_study").alias("label")).filter("label is not null")
    return p.groupBy("label").agg(F.countDistinct("seq").alias("n")).filter("n >= 100")


_MERGE = "(values ('Speech', 'Language'), ('Vision', 'Perception'), ('Robotics', 'Agents')) as m(old, new)"


@q("label_consolidate", f"""with x as (select seq, pos, coalesce(m.new, f) as f from (select seq, unnest(fields_of_study) as f, generate_subscripts(fields_of_study, 1) as pos from paper) l left join {_MERGE} on m.old = l.f where f is not null),
 o as (select seq, f, min(pos) as pos from x group by seq, f), k as (select *, count(*) over (partition by seq) as n from o)
select seq, string_agg(f, ',' order by pos) as labels from k where f <> 'Science' or n = 1 group by seq""")
def label_consolidate(spark, d):
    """Labels merged by a map, repeats dropped in order, and a catch-all label dropped beside any other."""
    merge = spark.createDataFrame([("Speech", "Language"), ("Vision", "Perception"), ("Robotics", "Agents")], "label string, new string")
    x = table(spark, d, "paper").select("seq", F.posexplode("fields_of_study").alias("pos", "label")).filter("label is not null").join(F.broadcast(merge), "label", "left")
    o = x.groupBy("seq", F.coalesce("new", "label").alias("f")).agg(F.min("pos").alias("pos"))
    k = o.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("seq"))).filter("f <> 'Science' or n = 1")
    return k.groupBy("seq").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "f"))), lambda y: y["f"]), ",").alias("labels"))


_PAPER_OF = r"regexp_replace(problem_id, '_c\d+$', '')"


def _prune_sql(before: str, n: int) -> str:
    return f"""s{n} as (select label from {before} group by label having count(distinct {_PAPER_OF}) >= 3), k{n} as (select * from {before} where label in (select label from s{n})),
 l{n} as (select problem_id, label from k{n} union select p.problem_id, k.label from (select problem_id from l0 where problem_id not in (select problem_id from k{n})) p join k{n} k on {_PAPER_OF.replace('problem_id', 'k.problem_id')} = {_PAPER_OF.replace('problem_id', 'p.problem_id')})"""


@q("support_prune", f"""with l0 as (select distinct problem_id, r as label from (select problem_id, unnest(roles) as r from benchmark_problem) where r is not null), {_prune_sql('l0', 1)}, {_prune_sql('l1', 2)}
select problem_id, label from l2""")
def support_prune(spark, d):
    """Labels that three papers support, pruned twice; a claim that loses all takes those of its paper's other claims."""
    first = table(spark, d, "benchmark_problem").select("problem_id", F.explode("roles").alias("label")).filter("label is not null").distinct()
    return c.prune_labels(first, 3)


@q("sibling_fill", r"""with b as (select problem_id, regexp_replace(problem_id, '_c\d+$', '') as paper, field from benchmark_problem), f as (select paper, field, min(problem_id) as first from b where field is not null group by all), s as (select paper, string_agg(field, '; ' order by first) as fields from f group by paper)
select problem_id, coalesce(b.field, s.fields) as field from b left join s using (paper)""")
def sibling_fill(spark, d):
    """A claim without a field takes those of the other claims of its paper, in order, each once."""
    b = table(spark, d, "benchmark_problem").select("problem_id", text.paper_of(F.col("problem_id")).alias("paper"), "field")
    f = b.filter("field is not null").groupBy("paper", "field").agg(F.min("problem_id").alias("first"))
    known = f.groupBy("paper").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "field"))), lambda x: x["field"]), "; ").alias("sibling"))
    return b.join(known, "paper", "left").select("problem_id", F.coalesce("field", "sibling").alias("field"))


@q("interleave", "select area, string_agg(k, ',' order by first) as keywords from (select area, k, min((i, task)) as first from (select coalesce(area, '') as area, task, unnest(keywords) as k, generate_subscripts(keywords, 1) as i from taxonomy) group by area, k) group by area")
def interleave(spark, d):
    """The keywords of an area's tasks in turn, repeats dropped."""
    t = table(spark, d, "taxonomy").select(F.coalesce("area", F.lit("")).alias("area"), "task", F.posexplode("keywords").alias("i", "k"))
    first = t.groupBy("area", "k").agg(F.min(F.struct("i", "task")).alias("first"))
    return first.groupBy("area").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "k"))), lambda x: x["k"]), ",").alias("keywords"))


@q("claim_menu_join", """select b.problem_id, m.subfield, count(*) as n_items from benchmark_problem b join taxonomy t on t.area = b.field join menu_item m on m.subfield = t.task group by all
union all select b.problem_id, null, 0 from benchmark_problem b where b.field is null or b.field not in (select t.area from taxonomy t join menu_item m on m.subfield = t.task where t.area is not null)""")
def claim_menu_join(spark, d):
    """Each claim's subfields with a menu, and the claims that have none."""
    menus = _items(spark, d).groupBy("subfield").agg(F.count(F.lit(1)).alias("n_items"))
    areas = table(spark, d, "taxonomy").select("area", F.col("task").alias("subfield")).join(menus, "subfield")
    b = table(spark, d, "benchmark_problem").select("problem_id", F.col("field").alias("area"))
    none = b.join(areas, "area", "left_anti").select("problem_id", F.lit(None).cast("string").alias("subfield"), F.lit(0).cast("long").alias("n_items"))
    return b.join(areas, "area").groupBy("problem_id", "subfield").agg(F.sum("n_items").alias("n_items")).unionByName(none)


# ---- quality and leakage -------------------------------------------------


@q("dq_reference", """select problem_id, concat_ws('; ', case when coalesce(len(experiments), 0) < 2 then 'needs two experiments' end,
 case when len(list_filter(experiments, lambda e: length(trim(coalesce(e, ''))) < 120)) > 0 then len(list_filter(experiments, lambda e: length(trim(coalesce(e, ''))) < 120)) || ' short experiments' end,
 case when trim(coalesce(claim, '')) = '' then 'claim is blank' end, case when len(roles) <> coalesce(len(experiments), 0) then 'roles are not parallel' end,
 case when len(list_filter(roles, lambda r: r is null or r not in ('apparatus', 'headline', 'mechanism', 'control', 'confound', 'external'))) > 0 then 'unknown role' end) as faults from benchmark_problem""")
def dq_reference(spark, d):
    return table(spark, d, "benchmark_problem").select("problem_id", quality.reference_faults(F.col("experiments"), F.col("roles"), F.col("claim")).alias("faults"))


@q("dq_long", "select problem_id, array_to_string(list_filter(range(0, len(experiments)), lambda i: length(experiments[i + 1]) > 150), ',') as long from benchmark_problem where experiments is not null")
def dq_long(spark, d):
    """Numbers of the long experiments, at a limit that these have."""
    long = F.array_compact(F.transform("experiments", lambda e, i: F.when(F.length(e) > 150, i)))
    return table(spark, d, "benchmark_problem").filter("experiments is not null").select("problem_id", F.array_join(long.cast("array<string>"), ",").alias("long"))


_CH = "coalesce(len(list_filter(reasoning_chain, lambda x: trim(x) <> '')), 0)"


@q("dq_judgment", f"""with e as (select *, (coalesce(status, '') not in ('covered', 'partial', 'missing'))::int + (coalesce(status, '') in ('partial', 'missing') and {_CH} < 2)::int + (coalesce(status, '') = 'covered' and coalesce(len(covered_by), 0) = 0)::int
  + (coalesce(status, '') = 'missing' and coalesce(len(covered_by), 0) > 0)::int + (coalesce(len(list_filter(covered_by, lambda j: j < 0 or j >= 5)), 0) > 0)::int + (length(trim(coalesce(rationale, ''))) < 25)::int + (length(trim(coalesce(adequacy, ''))) < 20)::int as f from evaluation),
 g as (select problem_id, model, condition, judge, run, count(*) as n, list_distinct(list(ref_index) filter (where ref_index is not null)) as seen, cast(sum(f) as bigint) as faults from e group by all)
select g.problem_id, model, condition, judge, run, n, array_to_string(list_filter(range(0, len(experiments)), lambda i: not list_contains(coalesce(seen, []), i)), ',') as missing, n - coalesce(len(seen), 0) as repeated, faults from g join benchmark_problem using (problem_id)""")
def dq_judgment(spark, d):
    problems = table(spark, d, "benchmark_problem").select("problem_id", F.size("experiments").alias("n_reference"))
    by = ["problem_id", "model", "condition", "judge", "run"]
    j = quality.judgment_faults(table(spark, d, "evaluation"), problems, by, 5)
    return j.select(*by, "n", F.array_join(F.col("missing").cast("array<string>"), ",").alias("missing"), "repeated", "faults")


@q("dq_audit", """select problem_id, model, condition, count(*) as n, count(*) filter (where coalesce(status, '') not in ('decides', 'supports', 'tangential', 'irrelevant')) as unknown_bears,
 count(*) filter (where covered_by[1] is not null and not coalesce(covered_by[1] between 0 and ref_index - 1, false)) as forward_duplicates, count(*) filter (where trim(coalesce(rationale, '')) = '') as no_reason from evaluation group by all""")
def dq_audit(spark, d):
    e = table(spark, d, "evaluation").withColumn("dup", F.get("covered_by", F.lit(0)))
    return quality.audit_faults(e, ["problem_id", "model", "condition"], "ref_index", "status", "dup", "rationale")


_AX = r"regexp_replace(regexp_replace(coalesce(nullif(arxiv_id, ''), nullif(regexp_extract(coalesce(doi, ''), '(?i)10[.]48550/arxiv[.]([0-9]{4}[.][0-9]{4,5})', 1), ''), ''), '^\s+|\s+$', '', 'g'), 'v\d+$', '')"
_LEAK = f"""b as (select seq, {_AX} as ax, {SQUASH("coalesce(title, '')")} as t from paper where paper_type <> 'survey' or paper_type is null), s as (select seq as source_seq, {_AX} as ax, {SQUASH("coalesce(title, '')")} as u from paper where paper_type = 'survey'),
 lk as (select distinct b.seq, s.source_seq from b join s on (b.ax <> '' and b.ax = s.ax) or (length(b.t) > 25 and s.u <> '' and (contains(s.u, left(b.t, 60)) or contains(b.t, left(s.u, 60)))))"""


def _leaks(spark, d):
    p = table(spark, d, "paper")
    return quality.leaked(p.filter("paper_type <> 'survey' or paper_type is null"), p.filter("paper_type = 'survey'"))


@q("leakage_flag", f"with {_LEAK} select seq, count(*) as n_sources, min(source_seq) as first_source from lk group by seq")
def leakage_flag(spark, d):
    """Papers that are one of the surveys, by number or title."""
    return _leaks(spark, d).groupBy("seq").agg(F.count(F.lit(1)).alias("n_sources"), F.min("source_seq").alias("first_source"))


@q("leakage_anti", f"with {_LEAK} select seq from b where seq not in (select seq from lk)")
def leakage_anti(spark, d):
    """The papers left when those that are one of the surveys are dropped."""
    p = table(spark, d, "paper").filter("paper_type <> 'survey' or paper_type is null").select("seq")
    return p.join(_leaks(spark, d), "seq", "left_anti")


@q("leakage_ids", r"with s as (select distinct regexp_replace(problem_id, '_c\d+$', '') as paper from benchmark_problem) select e.problem_id, count(*) as n from evaluation e where regexp_replace(e.problem_id, '_c\d+$', '') in (select paper from s) group by e.problem_id")
def leakage_ids(spark, d):
    """Verdicts whose paper is a source of the problems, sibling claims included."""
    s = table(spark, d, "benchmark_problem").select(text.paper_of(F.col("problem_id")).alias("paper")).distinct()
    e = table(spark, d, "evaluation").withColumn("paper", text.paper_of(F.col("problem_id"))).join(s, "paper", "left_semi")
    return e.groupBy("problem_id").agg(F.count(F.lit(1)).alias("n"))


@q("key_symdiff", "select coalesce(a.subfield, b.task) as label, case when b.task is null then 'left' else 'right' end as side from (select distinct subfield from menu_item where key = 'threats' and subfield is not null) a full join (select distinct task from taxonomy) b on a.subfield = b.task where a.subfield is null or b.task is null")
def key_symdiff(spark, d):
    a = _items(spark, d).filter("key = 'threats' and subfield is not null").select(F.col("subfield").alias("label"))
    return quality.symmetric_difference(a, table(spark, d, "taxonomy").select(F.col("task").alias("label")), ["label"])


@q("screen_keep", f"""with h as (select {NORM_TITLE('title')} as t, bool_or(bucket = 'norms') as keep from paper_hit where bucket is not null group by 1)
select p.seq from paper p left join h on h.t = {NORM_TITLE('p.title')} where coalesce(h.keep, true)""")
def screen_keep(spark, d):
    """Papers kept unless the screen, here the buckets of the hits of their title, says no; where it has nothing, the paper stays."""
    h = table(spark, d, "paper_hit").filter("bucket is not null").groupBy(text.normalize_title(F.col("title")).alias("t")).agg(F.max(F.col("bucket") == "norms").alias("keep"))
    p = table(spark, d, "paper").select("seq", text.normalize_title(F.col("title")).alias("t"))
    return p.join(h, "t", "left").filter(F.coalesce("keep", F.lit(True))).select("seq")


@q("fulltext_semi", "select seq from paper where seq in (select doc_id from documents where length(text) >= 500)")
def fulltext_semi(spark, d):
    docs = table(spark, d, "documents").filter(F.length("text") >= 500).select(F.col("doc_id").alias("seq"))
    return table(spark, d, "paper").select("seq").join(docs, "seq", "left_semi")


@q("no_number", r"select problem_id from benchmark_problem where claim is not null and not regexp_matches(claim, '\d')")
def no_number(spark, d):
    """Claims whose rule names no number."""
    return table(spark, d, "benchmark_problem").filter(F.col("claim").isNotNull() & ~F.col("claim").rlike(r"\d")).select("problem_id")


@q("numbered_listing", "select problem_id, string_agg('--- EXPERIMENT ' || i || ' ---' || chr(10) || e, chr(10) order by i) as listing from (select problem_id, unnest(experiments) as e, generate_subscripts(experiments, 1) - 1 as i from benchmark_problem) where e is not null group by problem_id")
def numbered_listing(spark, d):
    b = table(spark, d, "benchmark_problem").select("problem_id", F.posexplode("experiments").alias("i", "e")).filter("e is not null")
    block = F.concat(F.lit("--- EXPERIMENT "), "i", F.lit(" ---\n"), "e")
    return b.groupBy("problem_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", block.alias("b")))), lambda x: x["b"]), "\n").alias("listing"))


@q("exemplars", """with x as (select field, problem_id, i, e, row_number() over (partition by problem_id order by i) as n, sum(length(e)) over (partition by problem_id order by i) as chars from (select field, problem_id, unnest(experiments) as e, generate_subscripts(experiments, 1) as i from benchmark_problem) where e is not null)
select problem_id, count(*) as n, cast(sum(length(e)) as bigint) as chars from x where n <= 2 and chars <= 5000 group by problem_id""")
def exemplars(spark, d):
    """The first two experiments of each reference, while they have no more than 5,000 characters."""
    w = Window.partitionBy("problem_id").orderBy("i")
    x = table(spark, d, "benchmark_problem").select("problem_id", F.posexplode("experiments").alias("i", "e")).filter("e is not null").withColumns({"n": F.row_number().over(w), "chars": F.sum(F.length("e")).over(w)})
    return x.filter("n <= 2 and chars <= 5000").groupBy("problem_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("e")).alias("chars"))


@q("shape_stats", "select field, count(*) as n, round(avg(len(experiments)), 6) as mean_items, round(avg((len(experiments) >= 5)::int), 6) as at_cap, round(sum(list_sum(list_transform(experiments, lambda e: length(e)))) / sum(len(experiments)), 6) as mean_chars from benchmark_problem where experiments is not null group by field")
def shape_stats(spark, d):
    """How many experiments references have, how many are at the cap, and how long they are."""
    b = table(spark, d, "benchmark_problem").filter("experiments is not null").withColumns({"k": F.size("experiments"), "ch": F.aggregate("experiments", F.lit(0), lambda s, e: s + F.coalesce(F.length(e), F.lit(0)))})
    return b.groupBy("field").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("k"), 6).alias("mean_items"), F.round(F.avg((F.col("k") >= 5).cast("int")), 6).alias("at_cap"), F.round(F.sum("ch") / F.sum("k"), 6).alias("mean_chars"))


@q("regex_rate", r"select doc_type, count(*) as n, round(avg(regexp_matches(left(text, 300), '(?i)\bwe\b')::int), 6) as we, round(avg(regexp_matches(left(text, 300), '\d')::int), 6) as number from documents where text is not null group by doc_type")
def regex_rate(spark, d):
    """Shares of texts whose first 300 characters fit a pattern."""
    docs = table(spark, d, "documents").filter("text is not null").withColumn("start", F.left("text", F.lit(300)))
    rate = lambda p: F.round(F.avg(F.col("start").rlike(p).cast("int")), 6)
    return docs.groupBy("doc_type").agg(F.count(F.lit(1)).alias("n"), rate(r"(?i)\bwe\b").alias("we"), rate(r"\d").alias("number"))


@q("papers_per_field", "select f as field, count(distinct seq) as n from (select seq, unnest(fields_of_study) as f from paper) where f is not null group by f")
def papers_per_field(spark, d):
    p = table(spark, d, "paper").select("seq", F.explode("fields_of_study").alias("field")).filter("field is not null")
    return p.groupBy("field").agg(F.countDistinct("seq").alias("n"))


@q("draft_membership", "select b.problem_id, i - 1 as ref_index, e.role from (select problem_id, unnest(range(1, coalesce(len(experiments), 0) + 1)) as i, roles from benchmark_problem) b, (select unnest(['headline', 'control', 'confound']) as role) e where list_contains(b.roles, e.role) and b.roles[i] = e.role")
def draft_membership(spark, d):
    """Experiments by the roles that a reference lists, many to many."""
    b = table(spark, d, "benchmark_problem").select("problem_id", F.posexplode("experiments").alias("ref_index", "_e"), "roles")
    x = b.withColumn("role", F.get("roles", F.col("ref_index"))).filter(F.col("role").isin("headline", "control", "confound"))
    return x.select("problem_id", F.col("ref_index").cast("long").alias("ref_index"), "role")


@q("bundle_stats", "select coalesce(venue, '') as pool, count(*) as n, count(distinct lower(title)) as n_titles, count(*) filter (where trim(coalesce(abstract, '')) <> '') as with_abstract, count(*) filter (where coalesce(pdf_url, '') <> '') as with_pdf from paper group by 1")
def bundle_stats(spark, d):
    """Papers of each venue by stage."""
    p = table(spark, d, "paper").groupBy(F.coalesce("venue", F.lit("")).alias("pool"))
    return p.agg(F.count(F.lit(1)).alias("n"), F.countDistinct(F.lower("title")).alias("n_titles"), F.count_if(F.trim(F.coalesce("abstract", F.lit(""))) != "").alias("with_abstract"), F.count_if(F.coalesce("pdf_url", F.lit("")) != "").alias("with_pdf"))


@q("usage_rollup", "select user_id, event_type, count(*) as calls, round(sum(value), 4) as tokens from events group by rollup (user_id, event_type)")
def usage_rollup(spark, d):
    """Calls and tokens of each user and kind, with totals."""
    return table(spark, d, "events").rollup("user_id", "event_type").agg(F.count(F.lit(1)).alias("calls"), F.round(F.sum("value"), 4).alias("tokens"))


@q("canon_merge", f"select subfield, key, {CANON_GENERIC('name')} as canon, count(*) as n, min(item_id) as first_item from menu_item where name is not null group by all")
def canon_merge(spark, d):
    """Items of one canonical name."""
    i = _items(spark, d).filter("name is not null").withColumn("canon", text.canon_generic(F.col("name")))
    return i.groupBy("subfield", "key", "canon").agg(F.count(F.lit(1)).alias("n"), F.min("item_id").alias("first_item"))
