"""Queries of entity resolution and keyed upserts."""

from __future__ import annotations

from pyspark.sql import functions as F

from citegrove.functions import text
from citegrove.operators import identity
from citegrove.plans.registry import REGISTRY
from citegrove.plans.sqltext import NORM_TITLE, strip_sql
from citegrove.plans.text_queries import DEDUP_KEY, VERSION_KEY
from citegrove.session import table

q = REGISTRY.add


def _first(c: str) -> str:
    return f"arg_min({c}, seq) filter (where coalesce({c}, '') <> '')"


def _union(c: str) -> str:
    return f"list_sort(list_distinct(list_filter(flatten(list(coalesce({c}, []))), lambda x: x is not null)))"


_MERGED = f"""select key, {', '.join(f'{_first(c)} as {c}' for c in identity.SCALARS)},
  arg_max(coalesce(abstract, ''), (length(coalesce(abstract, '')), -seq)) as abstract,
  arg_min(authors, seq) filter (where len(authors) > 0) as authors, arg_min(year, seq) filter (where year <> 0) as year,
  max(coalesce(citations, 0)) as citations, max(semantic_score) as semantic_score,
  {', '.join(f'{_union(c)} as {c}' for c in identity.LISTS)}, min(seq) as seq, count(*) as n from k group by key"""
_FLAT = """seq, n, title, venue, url, doi, arxiv_id, length(abstract) as abstract_length, authors[1] as author, year, citations, round(semantic_score, 6) as semantic_score,
  array_to_string(sources, ',') as sources, array_to_string(topic_ids, ',') as topics, array_to_string(buckets, ',') as buckets"""


def _flat(df, *more):
    some = lambda c: F.filter(c, lambda x: x.isNotNull())
    return df.select(
        "seq", "n", "title", "venue", "url", "doi", "arxiv_id", F.length(F.coalesce("abstract", F.lit(""))).cast("long").alias("abstract_length"), F.get("authors", F.lit(0)).alias("author"),
        "year", "citations", F.round("semantic_score", 6).alias("semantic_score"),
        *(F.array_join(some(c), ",").alias(a) for c, a in (("sources", "sources"), ("topic_ids", "topics"), ("buckets", "buckets"))), *more,
    )


@q("merge_records", f"with k as (select *, {DEDUP_KEY} as key from paper), m as ({_MERGED}) select {_FLAT} from m")
def merge_records(spark, d):
    return _flat(identity.merge_by_identity(table(spark, d, "paper")))


@q("dedup_version", f"""with k as (select *, {DEDUP_KEY} as key from paper), m as ({_MERGED}),
 v as (select * exclude (key, n), {VERSION_KEY} as version from m),
 k2 as (select * exclude (version), version as key from v where version <> ''),
 again as ({_MERGED.replace('from k group', 'from k2 group')})
select {_FLAT}, true as keyed from again union all select {_FLAT.replace('seq, n,', 'seq, 1::bigint as n,', 1)}, false from v where version = ''""")
def dedup_version(spark, d):
    v = identity.merge_by_version(identity.merge_by_identity(table(spark, d, "paper")))
    return _flat(v, "keyed")


@q("dedup_representative", f"""with k as (select seq, title, authors, coalesce(abstract, '') as abstract, {DEDUP_KEY} as key from paper),
 o as (select min(seq) as seq, count(*) as n, arg_max(seq, (length(abstract), -seq)) as kept_seq from k group by key),
 r as (select o.seq, o.n, o.kept_seq, k.title, k.authors, k.abstract from o join k on k.seq = o.kept_seq),
 v as (select *, case when {VERSION_KEY} = '' then chr(1) || seq else {VERSION_KEY} end as version from r)
select min(seq) as seq, arg_max(kept_seq, (length(abstract), -seq)) as kept_seq, cast(sum(n) as bigint) as n from v group by version""")
def dedup_representative(spark, d):
    return identity.representatives(table(spark, d, "paper"))


@q("multi_leg_union", f"""with l as (select hit_id, query, bucket, source, {NORM_TITLE('title')} as norm from paper_hit)
select norm, min(hit_id) as first_hit, count(*) as n, array_to_string(list_sort(list_distinct(list(source) filter (where source is not null))), ',') as sources,
 array_to_string(list_sort(list_distinct(list(bucket) filter (where bucket is not null))), ',') as buckets, count(distinct query) as n_queries from l where norm <> '' group by norm""")
def multi_leg_union(spark, d):
    """The union of all search calls' hits, with the provenance of each title."""
    legs = table(spark, d, "paper_hit").withColumn("norm", text.normalize_title(F.col("title"))).filter("norm <> ''")
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",").alias(f"{c}s")
    return legs.groupBy("norm").agg(F.min("hit_id").alias("first_hit"), F.count(F.lit(1)).alias("n"), joined("source"), joined("bucket"), F.countDistinct("query").alias("n_queries"))


@q("provenance_tag", "select source, bucket, count(*) as n, count(distinct query) as n_queries from paper_hit group by source, bucket")
def provenance_tag(spark, d):
    return table(spark, d, "paper_hit").groupBy("source", "bucket").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("query").alias("n_queries"))


@q("query_flatten", """select query, bucket, hit_id from (select trim(query) as query, bucket, hit_id, row_number() over (partition by lower(trim(query)) order by hit_id) as n from paper_hit where trim(query) <> '') where n = 1""")
def query_flatten(spark, d):
    h = table(spark, d, "paper_hit").select(F.trim("query").alias("query"), "bucket", "hit_id").filter("query <> ''")
    first = h.groupBy(F.lower("query").alias("_k")).agg(F.min_by(F.struct("query", "bucket", "hit_id"), "hit_id").alias("r"))
    return first.select("r.query", "r.bucket", "r.hit_id")


@q("ordered_distinct", """select seq, query, pos from (select seq, query, pos, row_number() over (partition by seq, lower(query) order by pos) as n from
 (select seq, unnest(queries) as query, generate_subscripts(queries, 1) as pos from paper) where query is not null) where n = 1""")
def ordered_distinct(spark, d):
    p = table(spark, d, "paper").select("seq", F.posexplode("queries").alias("pos", "query")).filter("query is not null").withColumn("pos", (F.col("pos") + 1).cast("long"))
    return identity.ordered_distinct(p, [F.col("seq"), F.lower("query")], ["pos"]).select("seq", "query", "pos")


@q("harvest_upsert", """select hit_key, min(hit_id) as hit_id, arg_min(bucket, hit_id) as bucket, array_to_string(list(query order by hit_id) , '|') as queries from
 (select lower(trim(title)) as hit_key, hit_id, bucket, query from paper_hit where trim(title) <> '' and query is not null and fetched_at >= timestamp '2000-01-01') group by hit_key""")
def harvest_upsert(spark, d):
    """Records found by field and venue queries, upserted by key with the list of what found them."""
    h = table(spark, d, "paper_hit").select(F.lower(F.trim("title")).alias("hit_key"), "hit_id", "bucket", "query", "fetched_at")
    h = h.filter(F.col("hit_key").isNotNull() & (F.col("hit_key") != "") & F.col("query").isNotNull() & (F.col("fetched_at") >= F.lit("2000-01-01").cast("timestamp_ntz")))
    return h.groupBy("hit_key").agg(
        F.min("hit_id").alias("hit_id"), F.min_by("bucket", "hit_id").alias("bucket"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("hit_id", "query"))), lambda x: x["query"]), "|").alias("queries")
    ).select("hit_key", "hit_id", "bucket", "queries")


@q("cutoff_filter", "select seq, year from paper where fetched_at >= timestamp '2025-06-01'")
def cutoff_filter(spark, d):
    return table(spark, d, "paper").filter(F.col("fetched_at") >= F.lit("2025-06-01").cast("timestamp_ntz")).select("seq", "year")


@q("cache_key", """select p.seq, left(md5(coalesce(p.title, '')), 12) as key, count(h.hit_id) > 0 as cached from paper p left join paper_hit h on left(md5(coalesce(p.title, '')), 12) = left(md5(h.title), 12) group by 1, 2""")
def cache_key(spark, d):
    """Cache keys of the papers' titles, and whether the hits' cache holds them."""
    p = table(spark, d, "paper").select("seq", F.left(F.md5(F.coalesce("title", F.lit(""))), F.lit(12)).alias("key"))
    h = table(spark, d, "paper_hit").filter("title is not null").select(F.left(F.md5("title"), F.lit(12)).alias("key")).distinct().withColumn("hit", F.lit(True))
    return p.join(h, "key", "left").select("seq", "key", F.col("hit").isNotNull().alias("cached"))


_BODY, _ABSTRACT = (f"nullif({strip_sql(f"coalesce({c}, '')")}, '')" for c in ("d.text", "p.abstract"))


@q("body_fallback", f"select p.seq, case when {_BODY} is not null then 'html' when {_ABSTRACT} is not null then 'abstract' else '' end as origin, length(coalesce({_BODY}, {_ABSTRACT}, '')) as n from paper p left join documents d on d.doc_id = p.seq")
def body_fallback(spark, d):
    """The body of each paper from the first origin that has one."""
    some = lambda c: F.nullif(text.strip(F.coalesce(c, F.lit(""))), F.lit(""))
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("seq"), some("text").alias("html"))
    p = table(spark, d, "paper").select("seq", some("abstract").alias("abstract")).join(docs, "seq", "left")
    origin = F.when(F.col("html").isNotNull(), "html").when(F.col("abstract").isNotNull(), "abstract").otherwise("")
    return p.select("seq", origin.alias("origin"), F.length(F.coalesce("html", "abstract", F.lit(""))).cast("long").alias("n"))


@q("resume_anti", "select distinct task as subfield from taxonomy where task not in (select subfield from menu_item where subfield is not null and key = 'threats')")
def resume_anti(spark, d):
    done = table(spark, d, "menu_item").filter("key = 'threats'").select("subfield")
    return identity.missing_keys(table(spark, d, "taxonomy").select(F.col("task").alias("subfield")).distinct(), done, ["subfield"])


@q("upsert_latest", """with r as (select hit_id, title, 0 as v, 0 as n from (select seq as hit_id, title from paper) union all select hit_id, title, 1, 1 from paper_hit)
select hit_id, arg_max(coalesce(title, '-'), v) as title from r group by hit_id""")
def upsert_latest(spark, d):
    rows = lambda t, k, v: table(spark, d, t).select(F.col(k).alias("hit_id"), F.coalesce("title", F.lit("-")).alias("title"), F.lit(v).alias("v"))
    return identity.upsert_latest(rows("paper", "seq", 0), rows("paper_hit", "hit_id", 1), "hit_id", "v").select("hit_id", "title")


@q("missing_arms", """with w as (select b.problem_id, m.model, c.condition from (select distinct problem_id from benchmark_problem) b, (select distinct model from evaluation) m, (select distinct condition from evaluation) c),
 h as (select distinct problem_id, model, condition from evaluation where len(covered_by) > 0)
select w.* from w left join h using (problem_id, model, condition) where h.problem_id is null""")
def missing_arms(spark, d):
    """Arms still to run: wanted problems, models and conditions without a row that lists an experiment."""
    e = table(spark, d, "evaluation")
    dims = e.select("model").distinct().crossJoin(e.select("condition").distinct())
    wanted = table(spark, d, "benchmark_problem").select("problem_id").distinct().crossJoin(F.broadcast(dims))
    return identity.missing_keys(wanted, e.filter(F.size("covered_by") > 0), ["problem_id", "model", "condition"])


@q("arm_fanout", """select b.problem_id, m.model || '+' || c.condition || case when r.r = 0 then '' else '#' || r.r end as arm, least(5, coalesce(len(b.experiments), 0)) as kept,
 case when coalesce(len(b.experiments), 0) > 5 then coalesce(len(b.experiments), 0) end as n_returned
from benchmark_problem b, (select distinct model from evaluation) m, (select distinct condition from evaluation) c, (select unnest([0, 1]) as r) r""")
def arm_fanout(spark, d):
    """Every problem with every model, condition and repeat, and its experiments trimmed to a budget of five."""
    e = table(spark, d, "evaluation")
    arms = e.select("model").distinct().crossJoin(e.select("condition").distinct()).crossJoin(spark.range(2).select(F.col("id").alias("r")))
    arms = arms.select(F.concat("model", F.lit("+"), "condition", F.when(F.col("r") == 0, F.lit("")).otherwise(F.concat(F.lit("#"), F.col("r")))).alias("arm"))
    n = F.coalesce(F.size("experiments"), F.lit(0))
    return table(spark, d, "benchmark_problem").crossJoin(F.broadcast(arms)).select("problem_id", "arm", F.least(F.lit(5), n).cast("long").alias("kept"), F.when(n > 5, n.cast("long")).alias("n_returned"))
