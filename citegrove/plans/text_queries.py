"""Queries of the text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from citegrove.functions import html, text
from citegrove.functions.rules import FAMILIES, GENERIC_CLASSES
from citegrove.operators import retrieval
from citegrove.plans.registry import REGISTRY
from citegrove.plans.sqltext import ALIASES, BM25_TOKENS, CANON_GENERIC, CANON_MODEL, NORM_TITLE, SQUASH, STEM, strip_sql, tokens_sql
from citegrove.session import table

q = REGISTRY.add


@q("normalize_title", f"select seq, {NORM_TITLE('title')} as norm from paper")
def normalize_title(spark, d):
    return table(spark, d, "paper").select("seq", text.normalize_title(F.col("title")).alias("norm"))


DEDUP_KEY = f"""case when coalesce(doi, '') <> '' then 'doi:' || {strip_sql('lower(doi)')}
  when coalesce(arxiv_id, '') <> '' then 'arxiv:' || {strip_sql('lower(arxiv_id)')} else 'title:' || {NORM_TITLE('title')} end"""


@q("dedup_key", f"select seq, {DEDUP_KEY} as key from paper")
def dedup_key(spark, d):
    return table(spark, d, "paper").select("seq", text.dedup_key(F.col("doi"), F.col("arxiv_id"), F.col("title")).alias("key"))


VERSION_KEY = f"""case when coalesce(title, '') <> '' and coalesce(len(authors), 0) > 0
  then {NORM_TITLE('title')} || '|' || {strip_sql("lower(coalesce(authors[1], ''))")} else '' end"""


@q("version_key", f"select seq, {VERSION_KEY} as key from paper")
def version_key(spark, d):
    return table(spark, d, "paper").select("seq", text.version_key(F.col("title"), F.col("authors")).alias("key"))


@q("squash_key", f"select doc_id, length({SQUASH('text')}) as n, md5({SQUASH('text')}) as key from documents")
def squash_key(spark, d):
    k = text.squash(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.length(k).cast("long").alias("n"), F.md5(k).alias("key"))


@q("tokens", f"select seq, array_to_string(list_sort({tokens_sql('title')}), ' ') as tokens from paper")
def tokens(spark, d):
    return table(spark, d, "paper").select("seq", F.array_join(F.array_sort(text.taxonomy_tokens(F.col("title"))), " ").alias("tokens"))


@q("bm25_tokens", f"select doc_id, cast(len({BM25_TOKENS('text')}) as bigint) as n, md5(array_to_string({BM25_TOKENS('text')}, ' ')) as bag from documents")
def bm25_tokens(spark, d):
    t = text.bm25_tokens(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(t).cast("long").alias("n"), F.md5(F.array_join(t, " ")).alias("bag"))


@q("word_contains", """select distinct p.seq, k.keyword from paper p, (select distinct unnest(keywords) as keyword from taxonomy) k
where regexp_matches(lower(p.title), '(^|[^a-z0-9])' || lower(k.keyword) || '($|[^a-z0-9])')""")
def word_contains(spark, d):
    k = table(spark, d, "taxonomy").select(F.explode("keywords").alias("keyword")).distinct()
    return table(spark, d, "paper").join(F.broadcast(k), text.word_contains(F.lower("title"), F.col("keyword"))).select("seq", "keyword")


@q("stem", f"select word, {STEM('word')} as stem from (select distinct unnest(regexp_extract_all(lower(title), '[a-z]+')) as word from paper)")
def stem(spark, d):
    w = table(spark, d, "paper").select(F.explode(F.regexp_extract_all(F.lower("title"), F.lit("([a-z]+)"), 1)).alias("word")).distinct()
    return w.select("word", text.stem(F.col("word")).alias("stem"))


CONTENT = f"""list_distinct(list_transform(list_filter(regexp_extract_all(lower(coalesce(name, '')), '[a-z]{{3,}}'), lambda w: w not in ({', '.join(repr(s) for s in text.CONTENT_STOPS)})), lambda w: {STEM('w')}))"""


@q("content_words", f"select item_id, array_to_string(list_sort({CONTENT}), ' ') as words from menu_item")
def content_words(spark, d):
    return table(spark, d, "menu_item").select("item_id", F.array_join(F.array_sort(text.content_words(F.col("name"))), " ").alias("words"))


@q("canon_model", f"select item_id, {CANON_MODEL('name')} as canon from menu_item where key in ('models', 'baselines')")
def canon_model(spark, d):
    m = table(spark, d, "menu_item").filter(F.col("key").isin("models", "baselines"))
    return m.select("item_id", text.canon_model(F.col("name"), FAMILIES, GENERIC_CLASSES).alias("canon"))


@q("release_tier", r"""with m as (select item_id, regexp_extract(name, '(?:^|[^\d.])(\d{1,2})(?:\.(\d))?(?:[^\d]|$)', 1) as a,
  regexp_extract(name, '(?:^|[^\d.])(\d{1,2})(?:\.(\d))?(?:[^\d]|$)', 2) as b from menu_item where key = 'models')
select item_id, case when a = '' or a = '0' or cast(a as int) > 20 then '' when b = '5' then a || '.5' else a end as tier from m""")
def release_tier(spark, d):
    return table(spark, d, "menu_item").filter("key = 'models'").select("item_id", text.release(F.col("name")).alias("tier"))


@q("canon_generic", f"select item_id, {CANON_GENERIC('name')} as canon from menu_item")
def canon_generic(spark, d):
    return table(spark, d, "menu_item").select("item_id", text.canon_generic(F.col("name")).alias("canon"))


@q("alias_set", f"select item_id, array_to_string({ALIASES('name')}, ' ') as aliases from menu_item")
def alias_set(spark, d):
    return table(spark, d, "menu_item").select("item_id", F.array_join(text.alias_set(F.col("name")), " ").alias("aliases"))


_TYPES = "[" + ", ".join(f"'{t}'" for t in text.CLAIM_TYPES) + "]"


@q("claim_types", f"""with t as (select distinct subfield, trim(lower(x)) as t from (select subfield, unnest(applies_when) as x from menu_item)),
 o as (select t, i from (select unnest({_TYPES}) as t, generate_subscripts({_TYPES}, 1) as i))
select s.subfield, coalesce(string_agg(o.t, '; ' order by o.i), '') as types from (select distinct subfield from menu_item) s left join t on t.subfield is not distinct from s.subfield left join o on o.t = t.t group by s.subfield""")
def claim_types(spark, d):
    m = table(spark, d, "menu_item").select("subfield", F.explode_outer("applies_when").alias("tag")).withColumn("tag", text.strip(F.lower("tag")))
    g = m.withColumn("tag", F.when(F.col("tag").isin(*text.CLAIM_TYPES), F.col("tag"))).groupBy("subfield").agg(F.collect_set("tag").alias("tags"))
    return g.select("subfield", F.array_join(text.claim_types(F.col("tags")), "; ").alias("types"))


@q("id_extract", rf"""select seq, regexp_replace({strip_sql("coalesce(nullif(arxiv_id, ''), nullif(regexp_extract(coalesce(pdf_url, ''), '(?i)arxiv[.]org/(?:abs|pdf|html)/([0-9]{4}[.][0-9]{4,5})', 1), ''), nullif(regexp_extract(coalesce(url, ''), '(?i)arxiv[.]org/(?:abs|pdf|html)/([0-9]{4}[.][0-9]{4,5})', 1), ''), nullif(regexp_extract(coalesce(doi, ''), '(?i)10[.]48550/arxiv[.]([0-9]{4}[.][0-9]{4,5})', 1), ''), '')")}, 'v\d+$', '') as arxiv from paper""")
def id_extract(spark, d):
    return table(spark, d, "paper").select("seq", text.arxiv_number(F.col("arxiv_id"), F.col("pdf_url"), F.col("url"), F.col("doi")).alias("arxiv"))


#: A page made of each document, since no table holds pages.
_PAGE = "concat('<html><head><script>var a = 1;</script></head><body><nav>menu</nav><h1>', source, '</h1><p class=\"x\">', replace(replace(text, '&', '&amp;'), '<', '&lt;'), '</p><footer>end</footer></body></html>')"


@q("html_text", r"""with p as (select doc_id, concat('<html><head><script>var a = 1;</script></head><body><nav>menu</nav><h1>', source, '</h1><p class="x">', replace(replace(text, '&', '&amp;'), '<', '&lt;'), '</p><footer>end</footer></body></html>') as h from documents where text is not null and source is not null),
a as (select doc_id, regexp_replace(h, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<nav\b.*?</nav\s*>|<header\b.*?</header\s*>|<footer\b.*?</footer\s*>|<button\b.*?</button\s*>', ' ', 'g') as h from p),
b as (select doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(h, '(?is)<h[1-6][^>]*>', chr(10) || '## ', 'g'), '(?is)</t[dh]>', ' | ', 'g'), '(?is)<(br|/p|/div|/h[1-6]|/li|/tr)[^>]*>', chr(10), 'g'), '(?s)<[^>]+>', '', 'g') as h from a),
c as (select doc_id, replace(replace(replace(replace(replace(replace(h, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&nbsp;', ' '), '&amp;', '&') as h from b)
select doc_id, md5(trim(regexp_replace(regexp_replace(h, '[ \t]+', ' ', 'g'), '\s*\n\s*', chr(10), 'g'))) as body from c""")
def html_text(spark, d):
    p = table(spark, d, "documents").filter("text is not null and source is not null").select("doc_id", F.expr(_PAGE).alias("page"))
    return p.select("doc_id", F.md5(text.html_text(F.col("page"))).alias("body"))


@q("html_text_exact")
def html_text_exact(spark, d):
    p = table(spark, d, "documents").select("doc_id", F.expr(_PAGE).alias("page"))
    return p.select("doc_id", html.html_text_exact(F.col("page")).alias("body"))


def _positions(pattern: str, name: str, wanted: str = "true") -> str:
    return rf"""{name}p as (select doc_id, unnest(regexp_split_to_array(text, '{pattern}')) as part, generate_subscripts(regexp_split_to_array(text, '{pattern}'), 1) as i, regexp_extract_all(text, '{pattern}') as hits from documents where text is not null),
 {name} as (select doc_id, pos from (select doc_id, i <= len(hits) as hit, sum(length(part) + coalesce(length(hits[i]), 0)) over (partition by doc_id order by i) - coalesce(length(hits[i]), 0) as pos, coalesce({wanted}, false) as wanted from {name}p) where hit and wanted)"""


@q("main_body", rf"""with {_positions('[0-9]+', 'nu')}, {_positions('Table|Fig', 'he')}, mk as (select doc_id, pos, 1 as num from nu union all select doc_id, pos, 0 from he),
 ct as (select *, sum(num) over (partition by doc_id order by pos range between current row and 2999 following) as n from mk), dl as (select doc_id, length(text) as size from documents where text is not null),
 cu as (select doc_id, coalesce(min(pos) filter (where num = 0 and n >= 3), min(pos) filter (where num = 1 and n >= 8)) as cut from ct join dl using (doc_id) where pos >= floor(size * 0.3::double) group by doc_id)
select doc_id, cast(coalesce(cut, size) as bigint) as cut from dl left join cu using (doc_id)""")
def main_body(spark, d):
    """Where each text's main body ends; with marks and numbers that these texts have, since they have no reference lists."""
    return retrieval.main_body(table(spark, d, "documents"), "doc_id", "text", "[0-9]+", "Table|Fig", least=3, least_alone=8)


@q("main_body_references", rf"""with {_positions('[0-9]+', 'nu', "length(hits[i]) = 4 and hits[i] between '1950' and '2039'")}, {_positions(text.REFERENCES, 'he')}, mk as (select doc_id, pos, 1 as num from nu union all select doc_id, pos, 0 from he),
 ct as (select *, sum(num) over (partition by doc_id order by pos range between current row and 2999 following) as n from mk), dl as (select doc_id, length(text) as size from documents where text is not null),
 cu as (select doc_id, coalesce(min(pos) filter (where num = 0 and n >= 10), min(pos) filter (where num = 1 and n >= 22)) as cut from ct join dl using (doc_id) where pos >= floor(size * 0.3::double) group by doc_id)
select doc_id, cast(coalesce(cut, size) as bigint) as cut from dl left join cu using (doc_id)""")
def main_body_references(spark, d):
    """Where each text's main body ends, by headings and years of reference lists."""
    return retrieval.main_body(table(spark, d, "documents"), "doc_id", "text", text.YEAR, text.REFERENCES)


@q("chunk_window", """select doc_id, i as pos, md5(substr(text, i * 950 + 1, 1100)) as piece from (
  select doc_id, text, unnest(range(0, greatest(1, cast(ceil((length(text) - 150) / 950.0) as int)))) as i from documents where length(text) > 0)
where length(substr(text, i * 950 + 1, 1100)) > 200""")
def chunk_window(spark, d):
    docs = table(spark, d, "documents").filter("length(text) > 0")
    p = docs.select("doc_id", F.explode(retrieval.fixed_windows(F.col("text"), 1100, 150, 200)).alias("p"))
    return p.select("doc_id", F.col("p.pos").cast("long").alias("pos"), F.md5("p.piece").alias("piece"))


@q("passages", f"""with recursive q as (select doc_id, {strip_sql('x')} as p, k from (select doc_id, unnest(string_split(text, chr(10) || chr(10))) as x, generate_subscripts(string_split(text, chr(10) || chr(10)), 1) as k from documents where text is not null)),
 l as (select doc_id, p, length(p) as n, cast(greatest(0, ceil((length(p) - 1100) / 950.0::double)) as bigint) as w, row_number() over (partition by doc_id order by k) as i from q where p <> ''),
 f as (select doc_id, i, 1 as run, n - w * 950 as held from l where i = 1
  union all select l.doc_id, l.i, case when f.held + l.n + 2 <= 1100 then f.run else f.run + 1 end, case when f.held + l.n + 2 <= 1100 then f.held + l.n + 2 else l.n - l.w * 950 end from f join l on l.doc_id = f.doc_id and l.i = f.i + 1),
 c as (select doc_id, run, 0 as last, j, substr(p, j * 950 + 1, 1100) as t from (select doc_id, run, p, unnest(range(0, w)) as j from l join f using (doc_id, i))
  union all select doc_id, run, 1, 0, string_agg(substr(p, w * 950 + 1), chr(10) || chr(10) order by i) from l join f using (doc_id, i) group by doc_id, run)
select doc_id, row_number() over (partition by doc_id order by run, last, j) - 1 as pos, t as passage from c where length(t) > 200""")
def passages(spark, d):
    """Passages packed from the paragraphs of every document."""
    p = retrieval.passages(table(spark, d, "documents"), "doc_id", "text")
    return p.select("doc_id", F.col("pos").cast("long").alias("pos"), "passage")


@q("redact", rf"""select seq, regexp_replace(url || '?api_key=k' || seq || '&page=1&token=t' || seq, '(?i)((?:api_|access_|auth_|secret_)?key|token|password)=[^&\s''"]+', '\1=<redacted>', 'g') as url from paper where url is not null""")
def redact(spark, d):
    u = F.concat("url", F.lit("?api_key=k"), "seq", F.lit("&page=1&token=t"), "seq")
    return table(spark, d, "paper").filter("url is not null").select("seq", text.redact(u).alias("url"))


@q("slug", "select distinct model, condition, translate(model || ':' || condition || ',' || coalesce(judge, '') || '/x', ':,/', '-_-') as slug from evaluation")
def slug(spark, d):
    e = table(spark, d, "evaluation").select("model", "condition", text.slug(F.concat("model", F.lit(":"), "condition", F.lit(","), F.coalesce("judge", F.lit("")), F.lit("/x"))).alias("slug"))
    return e.distinct()


@q("arm_base", """select distinct model || '+' || condition as arm, case when contains(lower(model || '+' || condition), 'nocard') then 'nocard' when contains(lower(model || '+' || condition), 'rag') then 'rag'
 when contains(lower(model || '+' || condition), 'retr') then 'retrieval' when contains(lower(model || '+' || condition), 'card') then 'card' else lower(model || '+' || condition) end as base from evaluation where model is not null and condition is not null""")
def arm_base(spark, d):
    e = table(spark, d, "evaluation").filter("model is not null and condition is not null").select(F.concat("model", F.lit("+"), "condition").alias("arm")).distinct()
    return e.select("arm", text.arm_base(F.col("arm")).alias("base"))


@q("problem_ids", r"""select problem_id, regexp_replace(problem_id, '_c\d+$', '') as paper,
  case when regexp_extract(problem_id, '_(c\d+)$', 1) in ('', 'c0') then replace(regexp_replace(problem_id, '_c\d+$', ''), '.', '_') else replace(regexp_replace(problem_id, '_c\d+$', ''), '.', '_') || '_' || regexp_extract(problem_id, '_(c\d+)$', 1) end as again
from benchmark_problem""")
def problem_ids(spark, d):
    b = table(spark, d, "benchmark_problem")
    claim = F.coalesce(F.nullif(F.regexp_extract("problem_id", r"_(c\d+)$", 1), F.lit("")), F.lit("c0"))
    paper = text.paper_of(F.col("problem_id"))
    return b.select("problem_id", paper.alias("paper"), text.problem_id(paper, claim).alias("again"))


# Wordings that point back at the paper, or at what its reader can't see.
SELF_REF = r"(?i)\bthe authors'?\b|\bthis (?:paper|work|study)\b|\bwe (?:propose|introduce|present)\b|\bour (?:method|approach|system|model)\b"
FIGURE = (
    r"(?i)\b(?:orange|green|blue|red|purple|dashed|solid)\s+(?:line|curve|bar)s?\b|\bFig(?:ure)?\.?\s*\d|\bTable\s*\d|\bpanel\b|\bsubplot\b"
    r"|\bleft (?:panel|plot)\b|\bas shown in the (?:figure|plot|chart)\b"
)
VENUE_BAD = r"(?i)under review|submitted to|submission|workshop|findings|tiny paper|position|blog|demo track|student"
VENUE_GOOD = r"(?i)accept|to appear|camera|published|proceedings|main (?:track|conference)|oral|spotlight|poster|^\s*(?:neurips|icml|iclr|cvpr|eccv|acl|emnlp|naacl|corl|rss|icra|aaai) 20"


@q("selfref_flags", f"select doc_id, regexp_matches(text, '{SELF_REF.replace(chr(39), chr(39) * 2)}') as self_ref, nullif(regexp_extract(text, '{FIGURE}', 0), '') as figure from documents where text is not null")
def selfref_flags(spark, d):
    docs = table(spark, d, "documents").filter("text is not null")
    return docs.select("doc_id", F.col("text").rlike(SELF_REF).alias("self_ref"), F.nullif(F.regexp_extract("text", FIGURE, 0), F.lit("")).alias("figure"))


PAPER_TYPE = r"""case when regexp_matches(coalesce(title, '') || ' ' || left(coalesce(abstract, ''), 400), '(?i)\b(survey|a review|overview of|systematic review)\b') then 'survey'
 when regexp_matches(coalesce(title, '') || ' ' || left(coalesce(abstract, ''), 400), '(?i)\b(benchmark|dataset|evaluation|toolkit|leaderboard)\b') then 'benchmark' else 'method' end"""


@q("paper_type", f"select seq, {PAPER_TYPE} as kind from paper")
def paper_type(spark, d):
    return table(spark, d, "paper").select("seq", text.paper_type(F.col("title"), F.col("abstract")).alias("kind"))


@q("venue_ok", f"select seq, coalesce(regexp_matches(venue, '{VENUE_GOOD}') and not regexp_matches(venue, '{VENUE_BAD}'), false) as ok from (select seq, case when seq % 3 = 0 then 'Accepted at ' || venue || ', oral' else venue end as venue from paper)")
def venue_ok(spark, d):
    """Whether a comment names an accepted main paper; the papers' venues, every third with a remark as authors add it."""
    comment = F.when(F.col("seq") % 3 == 0, F.concat(F.lit("Accepted at "), "venue", F.lit(", oral"))).otherwise(F.col("venue"))
    return table(spark, d, "paper").select("seq", text.matches_but_not(comment, VENUE_GOOD, VENUE_BAD).alias("ok"))


AUTHORITY = "case when coalesce(year, 0) between 1 and 2026 then ln(1 + coalesce(citations, 0)::double / greatest(1, 2026 - year + 1)) else 0.5 * ln(1 + coalesce(citations, 0)::double) end"
RECENCY = "case when coalesce(year, 0) = 0 then 0.0::double else greatest(0.0::double, 1 - (2026 - year) / 15.0::double) end"


@q("authority_recency", f"select seq, round({AUTHORITY}, 6) as authority, round({RECENCY}, 6) as recency from paper")
def authority_recency(spark, d):
    return table(spark, d, "paper").select("seq", F.round(text.authority(F.col("citations"), F.col("year"), 2026), 6).alias("authority"), F.round(text.recency(F.col("year"), 2026), 6).alias("recency"))


@q("menu_format", """select subfield, case when max(case when key = 'threats' then 1 else 0 end) = 1 and max(case when key in ('validity_checks', 'protocols') then 1 else 0 end) = 0 then '2'
 when max(case when key in ('threats', 'baselines') then 1 else 0 end) = 1 then '0.4' else '0.3' end as format from menu_item group by subfield""")
def menu_format(spark, d):
    g = table(spark, d, "menu_item").groupBy("subfield").agg(F.collect_set("key").alias("keys"))
    return g.select("subfield", text.menu_format(F.col("keys")).alias("format"))


@q("line_dedup", r"""with l as (select doc_id, i, regexp_replace(x, '^[\s\-]+|[\s\-]+$', '', 'g') as line from (select doc_id, unnest(string_split(text, chr(10))) as x, generate_subscripts(string_split(text, chr(10)), 1) as i from documents where text is not null)),
 f as (select doc_id, line, min(i) as i from l where line <> '' group by doc_id, line)
select doc_id, cast(count(*) as bigint) as n, md5(string_agg(line, chr(10) order by i)) as lines from f group by doc_id""")
def line_dedup(spark, d):
    lines = table(spark, d, "documents").filter("text is not null").select("doc_id", text.distinct_lines(F.col("text")).alias("x")).filter(F.size("x") > 0)
    return lines.select("doc_id", F.size("x").cast("long").alias("n"), F.md5(F.array_join("x", "\n")).alias("lines"))


@q("abstract_cut", "select seq, left(replace(abstract, chr(10), ' '), 700) as abstract from paper")
def abstract_cut(spark, d):
    return table(spark, d, "paper").select("seq", text.truncated(F.col("abstract"), 700).alias("abstract"))


@q("json_extract")
def json_extract(spark, d):
    """The JSON text found in each record of paper_hit, as a model's answer would be read."""
    return table(spark, d, "paper_hit").select("hit_id", text.json_candidates(F.col("record")).alias("json"))


@q("map_values", "select seq, array_to_string(list_sort(flatten(map_values(tags))), ' ') as tags from paper where tags is not null and len(map_values(tags)) > 0")
def map_values(spark, d):
    p = table(spark, d, "paper").filter(F.size("tags") > 0)
    return p.select("seq", F.array_join(F.array_sort(F.flatten(F.map_values("tags"))), " ").alias("tags"))


@q("provenance_line", "select seq, concat_ws(' · ', nullif(paper_type, ''), case when coalesce(authors[1], '') <> '' then 'by ' || authors[1] end, case when len(list_filter(sources, lambda s: s is not null)) > 0 then 'sources: ' || array_to_string(list_filter(sources, lambda s: s is not null)[1:3], ', ') end) as line from paper")
def provenance_line(spark, d):
    s = F.filter("sources", lambda x: x.isNotNull())
    a = F.get("authors", F.lit(0))
    return table(spark, d, "paper").select("seq", text.provenance_line(F.col("paper_type"), a, s).alias("line"))


@q("inverted_index_roundtrip", """select doc_id, md5(array_to_string(string_split_regex(trim(regexp_replace(text, '[ \\n\\t\\r]+', ' ', 'g')), ' '), ' ')) as text from documents where regexp_matches(text, '[A-Za-z0-9]')""")
def inverted_index_roundtrip(spark, d):
    words = table(spark, d, "documents").filter(F.col("text").rlike("[A-Za-z0-9]")).select("doc_id", F.posexplode(F.split(F.trim(F.regexp_replace("text", r"[ \n\t\r]+", " ")), " ")).alias("pos", "word"))
    index = words.groupBy("doc_id", "word").agg(F.collect_list("pos").alias("positions"))
    return retrieval.word_by_positions(index, "doc_id", "word", "positions").select("doc_id", F.md5("text").alias("text"))
