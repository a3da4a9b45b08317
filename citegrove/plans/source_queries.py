"""Queries of source mappers, scans, sinks' plans, taxonomy upkeep, evidence texts and comparisons; service answers are made of the tables' rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from citegrove.functions import text
from citegrove.operators import curation, evidence, reports, scoring, taxonomy
from citegrove.plans.registry import REGISTRY
from citegrove.plans.scoring_queries import _ITEMS, _PASSES, _items, _passes, r6
from citegrove.plans.sqltext import SQUASH, tokens_sql
from citegrove.session import table
from citegrove.sources import records, scans, sinks

q = REGISTRY.add


def _paper(spark, d):
    return table(spark, d, "paper")


@q("openalex_mapper", r"select seq, coalesce(title, '') as title, coalesce(regexp_replace('https://doi.org/' || doi, '^https?://doi\.org/', ''), '') as doi, year, coalesce(citations, 0) as citations, coalesce(venue, '') as venue, coalesce(array_to_string(authors[1:25], '|'), '') as authors, coalesce(array_to_string(topic_ids, '|'), '') as topics from paper")
def openalex_mapper(spark, d):
    """Each paper as a work of the open catalogue, and back."""
    p = _paper(spark, d)
    work = F.struct(
        "title", F.concat(F.lit("https://doi.org/"), "doi").alias("doi"), F.col("year").alias("publication_year"), F.col("citations").alias("cited_by_count"),
        F.transform("authors", lambda a: F.struct(F.struct(a.alias("display_name")).alias("author"))).alias("authorships"), F.struct(F.struct(F.col("venue").alias("display_name")).alias("source")).alias("primary_location"),
        F.transform("topic_ids", lambda t: F.struct(F.concat(F.lit("https://openalex.org/"), t).alias("id"))).alias("topics"),
    )
    m = records.from_openalex(p.select("seq", F.to_json(work).alias("j")), "j", "seq")
    return m.select("seq", "title", "doi", "year", "citations", "venue", F.array_join("authors", "|").alias("authors"), F.array_join("topic_ids", "|").alias("topics"))


@q("scholar_mapper", "select seq, coalesce(title, '') as title, coalesce(nullif(abstract, ''), 'short: ' || title, '') as abstract, coalesce(arxiv_id, '') as arxiv_id, coalesce(pdf_url, '') as pdf_url from paper")
def scholar_mapper(spark, d):
    """Each paper as a work of the scholar service, whose short summary stands in for a missing abstract."""
    work = F.struct("title", "abstract", F.struct(F.concat(F.lit("short: "), "title").alias("text")).alias("tldr"), F.struct(F.col("pdf_url").alias("url")).alias("openAccessPdf"), F.struct(F.col("arxiv_id").alias("ArXiv")).alias("externalIds"))
    return records.from_scholar(_paper(spark, d).select("seq", F.to_json(work).alias("j")), "j", "seq").select("seq", "title", "abstract", "arxiv_id", "pdf_url")


@q("serp_mapper", "select seq, coalesce(title, '') as title, year, coalesce(citations, 0) as citations from paper")
def serp_mapper(spark, d):
    """Each paper as a search result, its year read out of the summary line."""
    line = F.concat_ws(" - ", F.lit("A Author, B Author"), F.concat_ws(", ", F.lit("Venue"), F.col("year").cast("string")))
    work = F.struct("title", F.struct(line.alias("summary")).alias("publication_info"), F.struct(F.struct(F.col("citations").alias("total")).alias("cited_by")).alias("inline_links"))
    return records.from_serp(_paper(spark, d).select("seq", F.to_json(work).alias("j")), "j", "seq").select("seq", "title", "year", "citations")


@q("task_mapper", "select seq, coalesce(title, '') as title, year, coalesce(array_to_string(list_filter(fields_of_study, lambda f: f <> ''), '|'), '') as tasks from paper")
def task_mapper(spark, d):
    """Each paper as one listed under tasks; names and objects with names take turns."""
    work = F.struct("title", F.concat(F.lpad(F.col("year").cast("string"), 4, "0"), F.lit("-01-01")).alias("published"), F.when(F.col("seq") % 2 == 0, F.to_json("fields_of_study")).otherwise(F.to_json(F.transform("fields_of_study", lambda f: F.struct(f.alias("name"))))).alias("raw"))
    j = _paper(spark, d).select("seq", F.regexp_replace(F.to_json(F.struct(work["title"].alias("title"), work["published"].alias("published"))), r"\}$", "").alias("head"), F.coalesce(work["raw"], F.lit("null")).alias("raw"))
    whole = j.select("seq", F.concat(F.when(F.col("head") == "{", F.col("head")).otherwise(F.concat("head", F.lit(","))), F.lit('"tasks":'), "raw", F.lit("}")).alias("j"))
    m = records.from_task_papers(whole, "j", "seq")
    return m.select("seq", "title", "year", F.coalesce(F.array_join(F.col("tags")["tasks"], "|"), F.lit("")).alias("tasks"))


@q("stamped_papers", "select seq, array_to_string(list_sort(list_distinct(list_concat(list_filter(coalesce(sources, []), lambda s: s is not null), ['mirror']))), '|') as sources, 'norms' as buckets from paper")
def stamped_papers(spark, d):
    """Each paper as found again by one more source, in a bucket."""
    none = F.array().cast("array<string>")
    p = _paper(spark, d).select("seq", F.filter(F.coalesce("sources", none), lambda s: s.isNotNull()).alias("sources"), none.alias("queries"), none.alias("buckets"))
    return records.stamped(p, "mirror", "q", "norms").select("seq", F.array_join(F.array_sort("sources"), "|").alias("sources"), F.array_join("buckets", "|").alias("buckets"))


@q("topic_resolver", "select topic as topic_id, round(score, 6) as score from (select topic, score, row_number() over (order by topic) as n from (select topic, count(*) / 1000.0::double as score from (select unnest(topic_ids) as topic from paper) where topic <> '' group by topic) where score >= 0.02) where n <= 3")
def topic_resolver(spark, d):
    """The first three topics of a score high enough."""
    t = _paper(spark, d).select(F.explode("topic_ids").alias("topic")).filter("topic <> ''").groupBy("topic").agg((F.count(F.lit(1)) / 1000.0).alias("score"))
    return records.resolve_topics(t.select(F.col("topic").alias("pos"), F.concat(F.lit("https://openalex.org/"), "topic").alias("id"), "score"), 0.02).select("topic_id", F.round("score", 6).alias("score"))


@q("first_pdf", "select seq, coalesce(nullif(trim(pdf_url), ''), nullif(trim(url), '')) as url, case when nullif(trim(pdf_url), '') is not null then 'field' when nullif(trim(url), '') is not null then 'landing' end as resolver from paper")
def first_pdf(spark, d):
    """The address of each paper's text by the first resolver that has one."""
    p = _paper(spark, d)
    steps = F.array(F.struct(F.lit(0).alias("step"), F.lit("field").alias("resolver"), F.trim("pdf_url").alias("url")), F.struct(F.lit(1).alias("step"), F.lit("landing").alias("resolver"), F.trim("url").alias("url")))
    return reports.resolve_pdfs(p.select("seq"), p.select("seq", F.explode(steps).alias("s")).select("seq", "s.*"), "seq").select("seq", "url", "resolver")


@q("arms_of_problems", "select problem_id, array_to_string(list_sort(list_distinct(list(model || '+' || condition))), '|') as arms from evaluation where model is not null and condition is not null group by problem_id")
def arms_of_problems(spark, d):
    """The arms that each problem's proposals have, read from maps of arms."""
    e = table(spark, d, "evaluation").filter("model is not null and condition is not null").select("problem_id", F.concat_ws("+", "model", "condition").alias("arm"), "model", "condition").distinct()
    arm = F.struct("model", "condition", F.lit(0).alias("repeat"))
    maps = e.select("problem_id", F.create_map("arm", arm).alias("arms"))
    return scans.arms_available(maps).select("problem_id", F.array_join("arms", "|").alias("arms"))


@q("passes_to_run", """with a as (select distinct problem_id, model, condition from evaluation where problem_id is not null and model is not null and condition is not null), w as (select *, unnest(range(0, 4))::int as run from a)
select w.* from w anti join (select distinct problem_id, model, condition, run from evaluation where judge = 'judge_s1') h using (problem_id, model, condition, run)""")
def passes_to_run(spark, d):
    """The passes of one judge, of four, that an arm still lacks."""
    e = table(spark, d, "evaluation").filter("problem_id is not null and model is not null and condition is not null")
    arms = e.select("problem_id", "model", "condition").distinct().withColumn("judge", F.lit("judge_s1"))
    return sinks.passes_to_run(e.select("problem_id", "model", "condition", "run", "judge"), arms, 4, ["judge"])


@q("column_pages", "select source as doc, page, avg((x0 < 50 and x1 > 50)::int) <= 0.03 and avg((x1 <= 50)::int) > 0.2 and avg((x0 >= 50)::int) > 0.2 as two_columns from (select source, doc_id % 7 as page, (n_chars % 90)::double as x0, (n_chars % 90 + 4)::double as x1 from documents where source is not null) group by all")
def column_pages(spark, d):
    """Pages of two columns, with boxes made of the documents' lengths."""
    x0 = (F.col("n_chars") % 90).cast("double")
    w = table(spark, d, "documents").filter("source is not null").select(F.col("source").alias("doc"), (F.col("doc_id") % 7).alias("page"), x0.alias("x0"), (x0 + 4).alias("x1"), F.lit(100.0).alias("width"))
    return scans.pdf_columns(w)


@q("first_votes", f"with {_PASSES}, s as (select problem_id, model, condition, ref_index, (list(status order by judged_at, status nulls first))[1] as status from v group by all) select problem_id, model, condition, count(*) as n, round(avg(case when status = 'covered' then 1.0::double when status is not null then 0.0::double end), 6) as strict from s group by problem_id, model, condition")
def first_votes(spark, d):
    """Strict share of each arm by its first passes alone."""
    s = reports.strict_share(reports.first_votes(scoring.run_statuses(_passes(spark, d))))
    return s.select(*scoring.ARM, "n", r6("strict", "strict"))


@q("runs_compared", f"""with {_ITEMS}, s as (select problem_id, model, condition, ref_index, (list(status order by judged_at, status nulls first))[1] as status from v group by all),
 o as (select problem_id, model, condition, avg(case when status = 'covered' then 1.0::double when status is not null then 0.0::double end) as old from s group by all), w as (select problem_id, model, condition, avg(case when status = 'covered' then 1.0::double when status is not null then 0.0::double end) as new from it group by all)
select problem_id, model, condition, round(old, 6) as old, round(new, 6) as new, round(new - old, 6) as delta from o join w using (problem_id, model, condition)""")
def runs_compared(spark, d):
    """Strict shares by all passes against those by the first."""
    c = reports.compare_runs(reports.first_votes(scoring.run_statuses(_passes(spark, d))), _items(spark, d))
    return c.select(*scoring.ARM, r6("old", "old"), r6("new", "new"), r6("delta", "delta"))


@q("label_table", r"""with r as (select distinct problem_id, regexp_replace(problem_id, '_c\d+$', '') as paper, coalesce(field, 'Other') as field, label from (select problem_id, field, unnest(roles) as label from benchmark_problem) where label is not null),
 b as (select label, field, count(distinct problem_id) as k from r group by all)
select label, (select count(distinct problem_id) from r where r.label = b.label) as n, (select count(distinct paper) from r where r.label = b.label) as n_papers, string_agg(field || ' ' || k, ', ' order by k desc, field) as fields from b group by label""")
def label_table(spark, d):
    """Claims and papers of each role, and its claims by field."""
    b = table(spark, d, "benchmark_problem").select("problem_id", text.paper_of(F.col("problem_id")).alias("paper"), "field", F.explode("roles").alias("label"))
    return reports.label_table(b)


@q("harvest_plan", "select f.field, v.venue from (select distinct field from benchmark_problem where field is not null) f, (select distinct venue from paper where venue <> '') v where (f.field, v.venue) not in (select unnest(fields_of_study), venue from paper where venue <> '' and len(list_filter(fields_of_study, lambda x: x is null)) = 0)")
def harvest_plan(spark, d):
    """Fields and venues without a paper yet."""
    p = _paper(spark, d).filter("venue <> ''")
    done = p.filter(~F.exists("fields_of_study", lambda x: x.isNull())).select(F.explode("fields_of_study").alias("field"), "venue")
    return reports.harvest_plan(table(spark, d, "benchmark_problem").filter("field is not null").select("field"), p.select("venue"), done)


@q("taxonomy_grown", f"""with x as (select task, row_number() over (order by task) as o, list_distinct(flatten(list_concat([{tokens_sql('task')}], list_transform(coalesce(keywords, []), lambda k: {tokens_sql('k')})))) as xs from taxonomy),
 l as (select distinct f as label, {tokens_sql('f')} as ts from (select unnest(fields_of_study) as f from paper) where f is not null),
 s as (select l.label, l.ts, x.task, x.o, case when lower(l.label) = lower(x.task) then 2.0::double when len(l.ts) > 0 and len(x.xs) > 0 then len(list_intersect(l.ts, x.xs)) / len(list_distinct(list_concat(l.ts, x.xs)))::double else 0.0::double end as j from l, x),
 b as (select label, arg_min(task, (-j, o)) filter (where j >= 0.6::double) as task, any_value(ts) as ts from s group by label), n as (select list_sort(ts) as ts, min(label) as fresh from b where task is null group by 1)
select b.label, coalesce(b.task, n.fresh) as task, b.task is null as new from b left join n on n.ts = list_sort(b.ts)""")
def taxonomy_grown(spark, d):
    """The papers' fields of study in the taxonomy's words, with those that it lacks added."""
    labels = _paper(spark, d).select(F.explode("fields_of_study").alias("label")).filter("label is not null").distinct()
    grown, named = taxonomy.add_labels(_ordered(spark, d), labels, "label", "o")
    return named.join(F.broadcast(grown.filter("source = 'custom'").select("task", F.lit(True).alias("new"))), "task", "left").select("label", "task", F.coalesce("new", F.lit(False)).alias("new"))


def _ordered(spark, d):
    """The taxonomy, a fixed table, with the place of each task by name."""
    from citegrove.operators.ranking import numbered

    return numbered(table(spark, d, "taxonomy"), ["task"], "o")


@q("taxonomy_edited", "select task, case when area = '' or area is null then 'Other' else area end as area, array_to_string(list_concat(list_filter(coalesce(keywords, []), lambda k: k <> 'code repair' and k <> 'audit'), ['audit']), '|') as keywords from taxonomy where card_type <> 'method' or card_type is null")
def taxonomy_edited(spark, d):
    """The taxonomy without tasks of methods, with a keyword taken out and one added everywhere, and a name for blank areas."""
    t = table(spark, d, "taxonomy")
    changes = t.select("task", F.array(F.lit("code repair"), F.lit("audit")).alias("remove_keywords"), F.array(F.lit("audit")).alias("add_keywords"), F.when(F.coalesce("area", F.lit("")) == "", "Other").alias("set_area"))
    e = taxonomy.edit(t, t.filter("card_type = 'method'").select("task"), changes)
    return e.select("task", "area", F.array_join("keywords", "|").alias("keywords"))


@q("subfield_keywords", "select b.problem_id, coalesce(array_to_string(list_sort(list_distinct(list(k) filter (where k is not null))), '|'), '') as keywords from benchmark_problem b left join (select area, unnest(keywords) as k from taxonomy) t on t.area = b.field group by b.problem_id")
def subfield_keywords(spark, d):
    """The keywords of all tasks in each claim's field, sorted, each once."""
    t = table(spark, d, "taxonomy")
    subs = table(spark, d, "benchmark_problem").join(F.broadcast(t.select(F.col("area").alias("field"), "task")), "field", "left").select("problem_id", "task")
    return taxonomy.keywords_of(subs, "problem_id", "task", t).select("problem_id", F.array_join("keywords", "|").alias("keywords"))


@q("recipe_grounding", f"""with n as (select subfield, list(distinct {SQUASH('name')}) filter (where length({SQUASH('name')}) > 3) as names from menu_item where key = 'datasets' group by subfield)
select m.item_id, {SQUASH('m.name')} <> '' and len(list_filter(coalesce(n.names, []), lambda x: contains(x, {SQUASH('m.name')}) or contains({SQUASH('m.name')}, x))) > 0 as ok from menu_item m left join n on n.subfield = m.subfield where m.key = 'baselines' and m.name is not null""")
def recipe_grounding(spark, d):
    """Whether each baseline's name traces to a dataset's name of its subfield, either way round."""
    i = table(spark, d, "menu_item").filter("name is not null")
    names = i.filter("key = 'datasets'").groupBy("subfield").agg(F.collect_set(text.squash(F.col("name"))).alias("names"))
    b = i.filter("key = 'baselines'").join(names, "subfield", "left")
    return b.select("item_id", curation.traceable(F.col("name"), F.coalesce("names", F.array().cast("array<string>"))).alias("ok"))


@q("card_sections", """with r as (select *, row_number() over (partition by subfield, key order by item_id) as place from menu_item where name is not null and subfield is not null),
 t as (select subfield, key, max(coalesce(kind, '') <> '') as kinds from r where place <= 20 group by all),
 l as (select r.subfield, r.key, r.place, case when r.key in ('datasets', 'metrics') then name || case when coalesce(role, '') <> '' then ' (' || role || ')' else '' end when r.key = 'baselines' then '- ' || name || case when coalesce(role, '') <> '' then ' (' || role || ')' else '' end
   when r.key = 'threats' and kinds then '- [' || coalesce(kind, '') || '] ' || name || case when coalesce(detail, '') <> '' then ': ' || detail else '' end
   when r.key = 'threats' then '- ' || name || case when coalesce(detail, '') <> '' then ': ' || detail else '' end || case when len(applies_when) > 0 then ' [applies when the claim is: ' || array_to_string(applies_when, '; ') || ']' else '' end
   when r.key = 'validity_checks' then '- ' || name else '- ' || name || case when coalesce(detail, '') <> '' then ': ' || detail else '' end end as line from r join t on t.subfield = r.subfield and t.key = r.key where place <= 20 and r.key in ('threats', 'validity_checks', 'evidence_standards', 'protocols', 'baselines', 'metrics', 'datasets'))
select subfield, key, case when key in ('datasets', 'metrics') then string_agg(line, ', ' order by place) else string_agg(line, chr(10) order by place) end as body from l group by subfield, key""")
def card_sections(spark, d):
    """The sections of each subfield's menu as a proposer reads them, twenty items each."""
    from citegrove.operators.ranking import top_k

    i = table(spark, d, "menu_item").filter("name is not null and subfield is not null")
    card = top_k(i, ["subfield", "key"], [F.col("item_id")], 20, "place").drop("variants")
    return evidence.section_bodies(card.filter(F.col("key").isin(*evidence.SECTIONS["0.4"])), ["subfield"])


@q("condition_evidence", "select problem_id, 'nocard' as condition, 0::bigint as n from benchmark_problem union all select problem_id, 'card', length(claim)::bigint from benchmark_problem where claim <> ''")
def condition_evidence(spark, d):
    """What each claim's proposer is shown in two conditions; the claim itself stands in for a card."""
    b = table(spark, d, "benchmark_problem").select("problem_id", F.col("claim").alias("evidence"))
    c = evidence.conditions(["nocard", "card"], b.select("problem_id"), "problem_id", cards=b)
    return c.select("problem_id", "condition", F.length("evidence").cast("long").alias("n"))
