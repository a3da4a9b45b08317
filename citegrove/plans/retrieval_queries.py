"""Queries of retrieval and ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from citegrove.operators import evidence, ranking, retrieval
from citegrove.plans.registry import REGISTRY
from citegrove.plans.sqltext import BM25_TOKENS, strip_sql, tokens_sql
from citegrove.plans.text_queries import AUTHORITY, PAPER_TYPE, RECENCY
from citegrove.session import table

q = REGISTRY.add


def _bm25_sql(docs: str = "documents", key: str = "doc_id", text: str = "text") -> str:
    return f"""t as (select {key}, {BM25_TOKENS(text)} as toks from {docs}), s as (select count(*) as n, avg(len(toks)) as a from t),
 p as (select {key}, term, count(*) as tf, any_value(ln) as ln from (select {key}, unnest(toks) as term, len(toks) as ln from t) group by {key}, term),
 f as (select term, count(*) as df from p group by term),
 u as (select distinct problem_id, unnest({BM25_TOKENS('claim')}) as term from benchmark_problem),
 w as (select p.{key}, p.term, ln(1 + (s.n - f.df + 0.5::double) / (f.df + 0.5::double)) * (p.tf * 2.5::double) / (p.tf + 1.5::double * (1 - 0.75::double + 0.75::double * greatest(p.ln, 1) / s.a)) as w from p join f using (term), s),
 b as (select u.problem_id, w.{key}, sum(w.w) as score from u join w using (term) group by 1, 2),
 r as (select *, row_number() over (partition by problem_id order by round(score, 9) desc, {key} desc) as rank from b)"""


_BM25 = _bm25_sql()


def _bm25(spark, d, k=10):
    return retrieval.bm25(table(spark, d, "benchmark_problem"), "problem_id", "claim", table(spark, d, "documents"), "doc_id", "text", k)


@q("bm25", f"with {_BM25} select problem_id, doc_id, round(score, 6) as score, rank from r where rank <= 10")
def bm25(spark, d):
    """The ten best documents of every claim."""
    return _bm25(spark, d).select("problem_id", "doc_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@q("term_df", f"with t as (select doc_id, {BM25_TOKENS('text')} as toks from documents) select term, count(*) as df, cast(sum(n) as bigint) as n from (select doc_id, term, count(*) as n from (select doc_id, unnest(toks) as term from t) group by 1, 2) group by term")
def term_df(spark, d):
    postings, _, _ = retrieval.term_stats(table(spark, d, "documents"), "doc_id", "text")
    return postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("n"))


@q("l2_normalize", "select vec_id, round(list_sum(list_transform(embedding, lambda x: x::double * x::double)), 5) as squared, round(embedding[1]::double / sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))), 6) as first from embeddings")
def l2_normalize(spark, d):
    e = table(spark, d, "embeddings")
    v = F.col("embedding").cast("array<double>")
    return e.select("vec_id", F.round(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x), 5).alias("squared"), F.round(F.get(retrieval.l2_normalize(F.col("embedding")), F.lit(0)), 6).alias("first"))


_DENSE = """u as (select vec_id, list_transform(embedding, lambda x: x::double) as v from embeddings),
 n as (select vec_id, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) as v from u),
 c as (select a.vec_id as query_id, b.vec_id, list_inner_product(a.v, b.v) as cosine from n a, n b where a.vec_id % 100 = 0),
 dr as (select *, row_number() over (partition by query_id order by round(cosine, 9) desc, vec_id desc) as rank from c)"""


def _dense(spark, d, k):
    e = table(spark, d, "embeddings")
    queries = e.filter("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id")
    return retrieval.dense_top_k(queries, "query_id", e, "vec_id", "embedding", k)


@q("dense_topk", f"with {_DENSE} select query_id, vec_id, round(cosine, 6) as cosine, rank from dr where rank <= 10")
def dense_topk(spark, d):
    """Exact cosine top ten of the query vectors, those of an id divisible by 100, against all."""
    return _dense(spark, d, 10).select("query_id", "vec_id", F.round("cosine", 6).alias("cosine"), F.col("rank").cast("long").alias("rank"))


@q("rrf", f"""with {_DENSE}, near as (select query_id, vec_id, rank from dr where rank <= 20),
 lab as (select a.vec_id as query_id, b.vec_id, row_number() over (partition by a.vec_id order by b.vec_id) as rank from embeddings a join embeddings b on a.label = b.label where a.vec_id % 100 = 0),
 legs as (select query_id, vec_id, 0 as leg, rank from near union all select query_id, vec_id, 1, rank from lab where rank <= 20),
 fused as (select query_id, vec_id, sum(1.0::double / (60 + rank)) as score, min((leg, rank)) as seen from legs group by 1, 2)
select query_id, vec_id, round(score, 9) as score, row_number() over (partition by query_id order by round(score, 12) desc, seen) as rank from fused""")
def rrf(spark, d):
    """Fusion of the cosine ranking with the ranking of vectors of the same label."""
    e = table(spark, d, "embeddings")
    a = e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "label")
    same = ranking.top_k(a.join(e.select("vec_id", "label"), "label"), ["query_id"], [F.col("vec_id")], 20)
    return retrieval.rrf(_dense(spark, d, 20), same.select("query_id", "vec_id", "rank"), "query_id", "vec_id").select("query_id", "vec_id", F.round("score", 9).alias("score"), F.col("rank").cast("long").alias("rank"))


@q("per_group_cap", f"""with {_BM25}, g as (select r.*, d.source, row_number() over (partition by problem_id, d.source order by rank) as gn from r join documents d using (doc_id)),
 k as (select *, row_number() over (partition by problem_id order by rank) as place from g where gn <= 3) select problem_id, doc_id, source, place from k where place <= 30""")
def per_group_cap(spark, d):
    """The thirty best documents of every claim with three of one source at most."""
    docs = table(spark, d, "documents")
    best = retrieval.bm25(table(spark, d, "benchmark_problem"), "problem_id", "claim", docs, "doc_id", "text", 30, group="source", cap=3)
    return best.join(docs.select("doc_id", "source"), "doc_id").select("problem_id", "doc_id", "source", F.col("rank").cast("long").alias("place"))


@q("budgeted_passages", f"""with recursive {_BM25}, x as (select r.problem_id, r.doc_id, r.rank, length(coalesce(d.text, '')) as n, coalesce(d.source, '') as src from r join documents d using (doc_id) where r.rank <= 30),
 z as (select problem_id, 0::bigint as rank, 0::bigint as used, []::varchar[] as srcs, false as ok from x group by problem_id
  union all select y.problem_id, y.rank, case when y.ok then y.used + y.n else y.used end, case when y.ok then list_append(y.srcs, y.src) else y.srcs end, y.ok
   from (select x.problem_id, x.rank, x.n, x.src, z.used, z.srcs, len(z.srcs) < 30 and z.used < 5820 and z.used + x.n <= 6000 and len(list_filter(z.srcs, lambda c: c = x.src)) < 3 as ok from z join x on x.problem_id = z.problem_id and x.rank = z.rank + 1) y)
select problem_id, doc_id, rank from z join x using (problem_id, rank) where ok""")
def budgeted_passages(spark, d):
    """Texts of the thirty best documents within a budget of 6,000 characters, three of one source at most."""
    docs = table(spark, d, "documents").select("doc_id", "source", F.length("text").alias("length"))
    ranked = _bm25(spark, d, 30).join(docs, "doc_id").select("problem_id", "doc_id", "source", "rank", "length")
    return retrieval.within_budget(ranked, "problem_id", "length", 6000, group="source").select("problem_id", "doc_id", F.col("rank").cast("long").alias("rank"))


_PAPER_TEXT = "coalesce(title, '') || ' ' || coalesce(abstract, '')"


@q("abstract_evidence", f"""with {_bm25_sql("paper", "seq", _PAPER_TEXT)}, e as (select r.problem_id, r.rank, '[' || r.rank || '] ' || {strip_sql("coalesce(p.title, '')")} || chr(10) || '    ' || left(replace({strip_sql("coalesce(p.abstract, '')")}, chr(10), ' '), 700) as t from r join paper p using (seq) where r.rank <= 10)
select problem_id, string_agg(t, chr(10) order by rank) as evidence from e group by problem_id""")
def abstract_evidence(spark, d):
    """The ten papers that fit each claim best, with title and the first 700 characters of the abstract."""
    papers = table(spark, d, "paper").select("seq", "title", "abstract", F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("abstract", F.lit(""))).alias("both"))
    ranked = retrieval.bm25(table(spark, d, "benchmark_problem"), "problem_id", "claim", papers.select("seq", "both"), "seq", "both", 10)
    return evidence.abstracts(ranked.join(papers.drop("both"), "seq"), "problem_id")


_SUBFIELDS, _KEYWORDS = ["vision", "agents"], ["visual grounding", "code repair", "tool-use planning", "in-context learning"]
_TOPICS = ["T10147", "T10038", "T10003"]


def _list(xs):
    return "[" + ", ".join(f"'{x}'" for x in xs) + "]"


_REL = f"""(0.4::double * len(list_distinct(list_filter(coalesce(buckets, []), lambda b: b is not null))) + 0.5::double * len(list_filter({_list(_SUBFIELDS)}, lambda k: contains(lower(coalesce(title, '') || ' ' || coalesce(abstract, '')), k)))
 + 0.3::double * least(6, len(list_filter({_list(_KEYWORDS)}, lambda k: contains(lower(coalesce(title, '') || ' ' || coalesce(abstract, '')), k))))
 + 0.3::double * ({' + '.join(f"len(list_filter(coalesce(fields_of_study, []), lambda f: contains(lower(f), '{s}')))" for s in _SUBFIELDS)})
 + 0.3::double * (len(list_distinct(list_filter(coalesce(sources, []), lambda b: b is not null))) - 1))"""


def _arr(xs):
    return F.array(*map(F.lit, xs))


def _papers(spark, d):
    drop = lambda c: F.filter(c, lambda x: x.isNotNull())
    return table(spark, d, "paper").withColumns({c: drop(c) for c in ("buckets", "sources", "fields_of_study", "topic_ids")}).withColumn("pool", F.coalesce("venue", F.lit("")))


@q("relevance", f"select seq, round({_REL}, 6) as relevance from paper")
def relevance(spark, d):
    return _papers(spark, d).select("seq", F.round(ranking.relevance(_arr(_SUBFIELDS), _arr(_KEYWORDS)), 6).alias("relevance"))


_RANKED = f"""a as (select seq, coalesce(venue, '') as pool, year, {_REL} as rel, {AUTHORITY} as au, {RECENCY} as re, {PAPER_TYPE} as kind, len(list_intersect(list_distinct(coalesce(topic_ids, [])), {_list(_TOPICS)})) as topics from paper),
 m as (select *, coalesce(nullif(max(au) over (partition by pool), 0), 1) as top from a),
 s as (select seq, pool, year, kind, round(rel + 0.8::double * au / top + case kind when 'survey' then 0.6::double when 'benchmark' then 0.5::double else 0.2::double end * 0.8::double + 0.15::double * re + 0.4::double * topics, 4) as score from m),
 k as (select *, row_number() over (partition by pool order by score desc, seq) as rank from s)"""


def _ranked(spark, d):
    return ranking.composite_rank(_papers(spark, d), "pool", _arr(_SUBFIELDS), _arr(_KEYWORDS), _arr(_TOPICS))


@q("composite_rank", f"with {_RANKED} select seq, pool, kind, score, rank from k")
def composite_rank(spark, d):
    return _ranked(spark, d).select("seq", "pool", F.col("paper_type").alias("kind"), "score", F.col("rank").cast("long").alias("rank"))


@q("pool_normalize", f"select seq, round(au / coalesce(nullif(max(au) over (partition by pool), 0), 1), 6) as share from (select seq, coalesce(venue, '') as pool, {AUTHORITY} as au from paper)")
def pool_normalize(spark, d):
    from citegrove.functions.text import authority

    p = _papers(spark, d).withColumn("au", authority(F.col("citations"), F.col("year"), 2026))
    return p.select("seq", F.round(ranking.pool_normalize(p, "pool", "au"), 6).alias("share"))


@q("topk_per_group", "select source, doc_id, rank from (select source, doc_id, row_number() over (partition by source order by n_chars desc, doc_id) as rank from documents) where rank <= 5")
def topk_per_group(spark, d):
    """The five longest documents of each source."""
    return ranking.top_k(table(spark, d, "documents"), ["source"], [F.desc("n_chars"), F.col("doc_id")], 5).select("source", "doc_id", F.col("rank").cast("long").alias("rank"))


@q("balanced_topk", f"""with {_RANKED}, z as (select *, count(*) over (partition by pool) as size, coalesce(year, 0) >= 2022 as recent from k),
 y as (select *, row_number() over (partition by pool, recent order by rank) as rn from z),
 x as (select *, row_number() over (partition by pool order by case when recent and rn <= 10 and size > 30 then 0 else 1 end, rank) as spot from y)
select pool, seq, rank from x where spot <= 30 or size <= 30""")
def balanced_topk(spark, d):
    """Thirty papers of each venue with a quota of ten recent ones."""
    return ranking.balanced_top_k(_ranked(spark, d), "pool", 30).select("pool", "seq", F.col("rank").cast("long").alias("rank"))


@q("lexical_topic_filter", f"select seq, len(list_intersect(list_distinct(topic_ids), {_list(_TOPICS)})) as topics from paper where list_has_any(topic_ids, {_list(_TOPICS)}) and regexp_matches(lower(title), '(^|[^a-z0-9])visual grounding($|[^a-z0-9])|(^|[^a-z0-9])code repair($|[^a-z0-9])')")
def lexical_topic_filter(spark, d):
    """Titles that name a keyword, of papers with one of the topics."""
    from citegrove.functions.text import word_contains

    hit = word_contains(F.lower("title"), F.lit("visual grounding")) | word_contains(F.lower("title"), F.lit("code repair"))
    p = table(spark, d, "paper").filter(F.arrays_overlap("topic_ids", _arr(_TOPICS)) & hit)
    return p.select("seq", F.size(F.array_intersect("topic_ids", _arr(_TOPICS))).cast("long").alias("topics"))


_SHAPES = [
    "{} standard benchmarks and evaluation protocol", "{} experimental setup ablation study", "{} baselines and controls comparison",
    "{} reproducibility evaluation methodology", "{} survey of evaluation practice",
]


@q("query_expand", "with n as (select task, unnest([" + ", ".join("replace('" + s + "', '{}', task)" for s in _SHAPES) + """]) as query, 'norms' as bucket from taxonomy),
 k as (select task, unnest([x || ' benchmark evaluation', x || ' experimental protocol']) as query, 'keyword' as bucket from (select task, unnest(keywords[1:3]) as x from taxonomy)) select * from n union all select * from k""")
def query_expand(spark, d):
    t = table(spark, d, "taxonomy")
    norms = t.select("task", F.explode(F.array(*(F.replace(F.lit(s), F.lit("{}"), F.col("task")) for s in _SHAPES))).alias("query"), F.lit("norms").alias("bucket"))
    kw = t.select("task", F.explode(F.slice("keywords", 1, 3)).alias("x"))
    return norms.unionByName(kw.select("task", F.explode(F.array(F.concat("x", F.lit(" benchmark evaluation")), F.concat("x", F.lit(" experimental protocol")))).alias("query"), F.lit("keyword").alias("bucket")))


_TAX = f"""x as (select task, keywords, datasets, metrics, list_distinct(flatten(list_concat([{tokens_sql('task')}], list_transform(coalesce(keywords, []), lambda k: {tokens_sql('k')})))) as toks from taxonomy)"""


@q("taxonomy_match", f"""with {_TAX}, c as (select problem_id, lower(coalesce(claim, '')) as t, {tokens_sql('claim')} as toks from benchmark_problem),
 s as (select c.problem_id, x.task, coalesce(list_sum(list_transform(list_filter(coalesce(x.keywords, []), lambda k: k <> '' and regexp_matches(c.t, '(^|[^a-z0-9])' || lower(k) || '($|[^a-z0-9])')), lambda k: 2.0 + 0.2 * len(string_split(k, ' '))))::double, 0)
  + 0.5 * len(list_intersect(c.toks, x.toks)) + 1.5 * len(list_filter(coalesce(x.datasets, []), lambda k: k <> '' and regexp_matches(c.t, '(^|[^a-z0-9])' || lower(k) || '($|[^a-z0-9])')))
  + 0.75 * len(list_filter(coalesce(x.metrics, []), lambda k: k <> '' and regexp_matches(c.t, '(^|[^a-z0-9])' || lower(k) || '($|[^a-z0-9])'))) as score from c, x)
select problem_id, task, round(score::double, 3) as score, rank from (select *, row_number() over (partition by problem_id order by score desc, task) as rank from s where score > 0) where rank <= 3""")
def taxonomy_match(spark, d):
    """The three tasks of the taxonomy that each claim fits best; the taxonomy is a fixed table of 60 rows."""
    from citegrove.operators.curation import taxonomy_scores

    s = taxonomy_scores(table(spark, d, "benchmark_problem"), "problem_id", "claim", table(spark, d, "taxonomy"))
    return ranking.top_k(s.filter("score > 0"), ["problem_id"], [F.desc("score"), F.col("task")], 3).select("problem_id", "task", F.round("score", 3).alias("score"), F.col("rank").cast("long").alias("rank"))


@q("jaccard_best", f"""with {_TAX}, l as (select distinct subfield, {tokens_sql('subfield')} as toks from menu_item where subfield is not null),
 j as (select l.subfield, x.task, len(list_intersect(l.toks, x.toks)) / len(list_distinct(list_concat(l.toks, x.toks)))::double as j from l, x where len(l.toks) > 0 and len(x.toks) > 0)
select subfield, case when max(j) >= 0.25 then arg_min(task, (-j, task)) end as task, round(max(j), 6) as j from j group by subfield""")
def jaccard_best(spark, d):
    """The task nearest to each subfield's name by shared tokens."""
    from citegrove.operators.curation import nearest_task

    labels = table(spark, d, "menu_item").filter("subfield is not null").select("subfield").distinct()
    return nearest_task(labels, "subfield", table(spark, d, "taxonomy"), 0.25).select("subfield", "task", F.round("j", 6).alias("j"))


@q("modulo_shards", "select problem_id, (row_number() over (order by problem_id) - 1) % 4 as shard from benchmark_problem")
def modulo_shards(spark, d):
    """Problems dealt to four shards in order."""
    numbered = ranking.numbered(table(spark, d, "benchmark_problem").select("problem_id"), ["problem_id"])
    return numbered.select("problem_id", ((F.col("number") - 1) % 4).alias("shard"))
