"""The best representative of each group of duplicate records: two-sided source quality decides field by field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citegrove.llm.dictionary import encode
from citegrove.operators.graph import connected
from citegrove.plans.materialize import settle

#: Prefix of preprint DOIs, and the mark of DOIs of whole volumes; fixed values of the data.
PREPRINT, VOLUME = "10.48550/", r"/vol\."
#: A sentence in more than this share of all distinct texts, and in three at least, is a notice and not an abstract's own.
NOTICE_SHARE = 0.02
#: Words that an abstract has at least.
LEAST_WORDS = 8
#: First characters that a cut abstract and the full one share at least: so long are LEAST_WORDS words with blanks between.
SHARED = 2 * LEAST_WORDS - 1
#: Rounds of expectation and maximisation; counts that a source starts with as (right, wrong) for true and for false values.
ROUNDS = 6
TRUE_PRIOR, FALSE_PRIOR = (3.0, 1.0), (1.0, 6.0)


def title_key(title: Column) -> Column:
    """Letters and digits of the lower-case title; literal escapes of white space are dropped."""
    return F.nullif(F.regexp_replace(F.regexp_replace(F.lower(title), r"\\[nrt]", " "), r"[^\p{L}\p{N}]+", ""), F.lit(""))


def author_key(authors: Column) -> Column:
    """First initial and family name of the first author given, in 'First Family', 'F. Family' or 'Family, First'; null without one."""
    first = F.get(F.filter(authors, lambda a: F.trim(a) != ""), F.lit(0))
    a = F.lower(F.trim(F.regexp_replace(first, r"[\s\p{Z}.]+", " ")))
    turned = F.when(a.contains(","), F.concat_ws(" ", F.trim(F.substring_index(a, ",", -1)), F.trim(F.substring_index(a, ",", 1)))).otherwise(a)
    return F.nullif(F.concat_ws(" ", F.substring(turned, 1, 1), F.substring_index(turned, " ", -1)), F.lit(""))


def doi_key(doi: Column) -> Column:
    """A DOI in bare lower-case form, null if there is none in the text."""
    return F.nullif(F.regexp_replace(F.regexp_extract(F.lower(doi), r"(10\.\d{4,9}/\S+)", 1), r"[.,;:)\]]+$", ""), F.lit(""))


def arxiv_key(arxiv_id: Column, doi: Column) -> Column:
    """The bare arXiv number without version, of the field or else of a preprint DOI; null without one."""
    pattern = r"(\d{4}\.\d{4,5}|[a-z][a-z-]+(?:\.[a-z]{2})?/\d{7})"
    own = F.nullif(F.regexp_extract(F.lower(arxiv_id), pattern, 1), F.lit(""))
    return F.coalesce(own, F.nullif(F.regexp_extract(doi, r"^10\.48550/arxiv\." + pattern, 1), F.lit("")))


def plain_abstract(text: Column) -> Column:
    """An abstract without markup, with single blanks and without a mark of truncation; null for a null one."""
    t = F.trim(F.regexp_replace(F.regexp_replace(text, r"<[^<>]{1,60}>", " "), r"[\s\p{Z}]+", " "))
    return F.trim(F.regexp_replace(t, r"(?:\s*(?:\.\.\.|…|\[truncated\]))+$", ""))


def _keys(papers: DataFrame) -> DataFrame:
    """seq with author, title, doi (without volumes and cut ones) and arxiv, the author of an authorless record taken from its twins."""
    d = doi_key(F.col("doi"))
    k = papers.select("seq", author_key(F.col("authors")).alias("author"), title_key(F.col("title")).alias("title"), F.when(~d.rlike(VOLUME), d).alias("doi"), arxiv_key(F.col("arxiv_id"), d).alias("arxiv"))
    dois = settle(k.filter("doi is not null").select("doi").distinct())
    steps = F.split(F.substring_index("doi", "/", -1), r"\.")
    starts = dois.select(
        F.explode(F.transform(F.filter(F.sequence(F.lit(1), F.size(steps)), lambda n: n < F.size(steps)), lambda n: F.concat_ws("/", F.substring_index("doi", "/", 1), F.array_join(F.slice(steps, 1, n), ".")))).alias("doi")
    ).distinct()
    cut = dois.join(starts, "doi", "left_semi").withColumn("cut", F.lit(True))
    k = settle(k.join(cut, "doi", "left").withColumn("doi", F.when(F.col("cut").isNull(), F.col("doi"))).drop("cut"))
    named = k.filter("author is not null and title is not null")

    def one(by: list[str], to: str) -> DataFrame:
        g = named.dropna(subset=by).groupBy(*by).agg(F.min("author").alias(to), F.max("author").alias("other"))
        return g.filter(F.col(to) == F.col("other")).drop("other")

    bare = k.filter("author is null").drop("author")
    found = bare.join(one(["title", "doi"], "a1"), ["title", "doi"], "left").join(one(["title", "arxiv"], "a2"), ["title", "arxiv"], "left").join(one(["title"], "a3"), "title", "left")
    found = found.select("seq", F.coalesce("a1", "a2", "a3").alias("author"), "title", "doi", "arxiv")
    return k.filter("author is not null").select("seq", "author", "title", "doi", "arxiv").unionByName(found)


def group_works(papers: DataFrame) -> DataFrame:
    """(seq, first_seq): the records of one work share the smallest seq of them.

    papers: seq (unique), title, authors, doi, arxiv_id. Two records are of one work if their first author (initial and family name) and any of
    title, DOI and arXiv number agree, or through further records. DOIs of volumes and DOIs cut short tell nothing. A record
    without author takes that of the one author whose records carry its title and an identifier of it, or else its title. Records without any key are works of their own.

    Records of equal keys are one node, and keys of one node only are dropped, so what is contracted is the conflicts' graph.
    """
    return _components(settle(_keys(papers)))


def _components(k: DataFrame) -> DataFrame:
    """(seq, first_seq) of records with their keys."""
    sig = ["author", "title", "doi", "arxiv"]
    nodes = settle(k.groupBy(*sig).agg(F.min("seq").alias("node"), F.count(F.lit(1)).alias("n")))
    a = F.coalesce("author", F.lit(""))
    key = lambda kind, c, ok=F.lit(True): F.when(F.col(c).isNotNull() & ok, F.concat_ws("\x1f", F.lit(kind), F.col(c), a))
    edges = nodes.select("node", F.explode(F.array_compact(F.array(key("d", "doi"), key("x", "arxiv"), key("t", "title", F.col("author").isNotNull())))).alias("key"))
    roots = connected(edges)
    by_sig = nodes.join(roots, "node", "left").select(*sig, "n", F.coalesce("first", "node").alias("first_seq"))
    keyless = F.col("author").isNull() & F.col("doi").isNull() & F.col("arxiv").isNull()
    plain = [F.coalesce(c, F.lit("")).alias(f"_{c}") for c in sig]
    book = by_sig.filter(~keyless).select(*plain, "n", "first_seq")
    met = encode(k.filter(~keyless).select("seq", *plain), book, [f"_{c}" for c in sig], k.count())
    return met.select("seq", "first_seq").unionByName(k.filter(keyless).select("seq", F.col("seq").alias("first_seq")))


def _real_abstracts(texts: DataFrame) -> DataFrame:
    """The distinct (first_seq, text) that are abstracts: long enough, and not made of notices that stand in many records."""
    t = settle(texts.filter(F.size(F.split("text", " ")) >= LEAST_WORDS).select("first_seq", "text").distinct())
    n = t.count()
    sentences = t.select("first_seq", F.xxhash64("text").alias("h"), F.explode(F.array_distinct(F.split("text", r"(?<=[.!?])\s+"))).alias("s"))
    # at most 1 / NOTICE_SHARE times as many as a text has sentences
    notices = settle(sentences.groupBy("s").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= max(3, NOTICE_SHARE * n)).select("s", F.lit(1).alias("notice")))
    share = sentences.join(F.broadcast(notices), "s", "left").groupBy("first_seq", "h").agg(F.avg(F.coalesce("notice", F.lit(0))).alias("share"))
    return t.withColumn("h", F.xxhash64("text")).join(share.filter("share < 0.5"), ["first_seq", "h"], "left_semi").select("first_seq", "text")


def _full_texts(texts: DataFrame) -> DataFrame:
    """(first_seq, text, value, full): each abstract with every full text of its work that it is or begins, and that text's value.

    texts: first_seq and text, distinct. A full text begins no other text of its work, so texts that go on differently are
    different values, and a text cut before they part is heard for each. Of values alike in all else the longer text's is greater.
    """
    t = texts.withColumn("start", F.left("text", F.lit(SHARED)))
    longer = t.select("first_seq", "start", F.col("text").alias("longer"))
    same = ["first_seq", "start"]
    begins = t.join(longer, same).filter(F.col("longer").startswith(F.col("text")) & (F.length("longer") > F.length("text"))).select("first_seq", "text").distinct()
    full = t.join(begins, ["first_seq", "text"], "left_anti").select(*same, F.col("text").alias("full"), F.concat(F.lpad(F.length("text").cast("string"), 9, "0"), F.md5("text")).alias("value"))
    return t.join(full, same).filter(F.col("full").startswith(F.col("text"))).select("first_seq", "text", "value", "full")


def judge_values(claims: DataFrame) -> DataFrame:
    """(work, field, value, p, score, n): the probability of each claimed value and its log odds, by expectation and maximisation over the sources.

    claims: work, field, value, source; a row for each record that gives the value. Of each field a source has a sensitivity, how
    often its records that give any value give a true one, and a specificity, how often they don't give a false one. Several values
    of a work may be true, and each record is heard. n is the number of claims. Null values and sources are left out; an empty table gives no rows.

    A source that gives the field but not this value speaks against it. Those votes are one sum a work and field, to which the
    sources that do give the value add the difference, so that the cost is that of the claims and not of values times sources.
    """
    c = claims.filter("work is not null and value is not null and source is not null")
    one = c.groupBy("work", "field", "value", "source").agg(F.count(F.lit(1)).cast("double").alias("yes"))
    # rows of a claim, and with the flag whole and no value those of all that a source claims of a work's field
    votes = one.select("work", "field", "value", F.lit(False).alias("whole"), "source", "yes").unionByName(
        one.groupBy("work", "field", "source").agg(F.sum("yes").alias("yes")).select("work", "field", F.lit("").alias("value"), F.lit(True).alias("whole"), "source", "yes")
    )
    votes = settle(votes)
    fact, where, who, whole = ["work", "field", "value", "whole"], ["work", "field"], ["field", "source"], F.col("whole")
    counted = settle(votes.groupBy(*fact).agg(F.sum("yes").alias("n")))
    facts = counted.filter(~whole).join(counted.filter(whole).select(*where, F.col("n").alias("all")), where).select(*fact, "n", F.lit(0.0).alias("score"), (F.col("n") / F.col("all")).alias("p"))
    for _ in range(ROUNDS):
        facts = settle(facts)
        true_false = facts.select(*fact, "p", (1 - F.col("p")).alias("q")).unionByName(facts.groupBy(*where).agg(F.sum("p").alias("p"), F.sum(1 - F.col("p")).alias("q")).select(*where, F.lit("").alias("value"), F.lit(True).alias("whole"), "p", "q"))
        part = lambda c, ok: F.coalesce(F.sum(F.when(ok, F.col("yes") * F.col(c))), F.lit(0.0))
        seen = votes.join(true_false, fact).groupBy(*who).agg(part("p", ~whole).alias("tp"), part("q", ~whole).alias("fp"), part("p", whole).alias("t"), part("q", whole).alias("f"))
        sens = (F.col("tp") + TRUE_PRIOR[0]) / (F.col("t") + sum(TRUE_PRIOR))
        spec = (F.col("f") - F.col("fp") + FALSE_PRIOR[1]) / (F.col("f") + sum(FALSE_PRIOR))
        of_field = Window.partitionBy("field")
        prior = F.log((1 + F.sum("t").over(of_field)) / (1 + F.sum("f").over(of_field)))
        weights = settle(seen.select(*who, prior.alias("prior"), F.log(sens / (1 - spec)).alias("pro"), F.log((1 - sens) / spec).alias("contra")))
        told = F.col("yes") * F.when(whole, F.col("contra")).otherwise(F.col("pro") - F.col("contra"))
        sums = votes.join(weights, who).groupBy(*fact).agg(F.sum("yes").alias("n"), F.sum(told).alias("told"), F.max("prior").alias("prior"))
        against = sums.filter(whole).select(*where, F.col("told").alias("against"))
        scored = sums.filter(~whole).join(against, where).select(*fact, "n", (F.col("prior") + F.col("against") + F.col("told")).alias("score"))
        facts = scored.withColumn("p", 1 / (1 + F.exp(-F.col("score"))))
    return facts.select("work", "field", "value", "p", "score", F.col("n").cast("long").alias("n"))


def survivors(papers: DataFrame) -> DataFrame:
    """One row for each work of two records or more: first_seq, doi, arxiv_id, abstract_seq, sources.

    doi: of publication DOIs, else of preprint DOIs, the one most likely the work's own; a DOI that several works claim is that of the work where it has the better odds. abstract_seq: the first record with the likeliest full abstract, cut ones counting for those that they begin;
    null if no record has an abstract. Null and blank fields say nothing; equal records are of one work.
    """
    k = settle(_keys(papers))
    works = settle(_components(k))
    many = works.groupBy("first_seq").agg(F.count(F.lit(1)).alias("records")).filter("records > 1").select("first_seq")
    d = doi_key(F.col("doi"))
    names = F.array_distinct(F.filter(F.transform("sources", lambda s: F.lower(F.trim(s))), lambda s: s.isNotNull() & (s != "")))
    r = papers.select("seq", F.when(~d.rlike(VOLUME), d).alias("doi"), arxiv_key(F.col("arxiv_id"), d).alias("arxiv"), names.alias("names"), plain_abstract(F.col("abstract")).alias("text"), F.col("abstract").rlike(r"(?:\.\.\.|…|\[truncated\])\s*$").alias("cut"))
    good = k.filter("doi is not null").select("seq", F.col("doi").alias("good_doi"))
    r = r.join(works, "seq").join(many, "first_seq", "left_semi").join(good, "seq", "left").withColumn("doi", F.col("good_doi")).drop("good_doi")
    r = settle(r.withColumn("names", F.when(F.size("names") > 0, F.col("names")).otherwise(F.array(F.lit("?")))))
    texts = _real_abstracts(r.filter("text <> ''"))
    texts = settle(_full_texts(texts))
    real = r.join(texts.select("first_seq", "text", "value"), ["first_seq", "text"])
    claim = lambda df, field, value: df.select(F.col("first_seq").alias("work"), F.lit(field).alias("field"), F.col(value).alias("value"), F.explode("names").alias("source"))
    pub = r.filter(~F.col("doi").startswith(PREPRINT))
    pre = r.filter(F.col("doi").startswith(PREPRINT))
    claims = claim(pub, "doi", "doi").unionByName(claim(pre, "preprint", "doi")).unionByName(claim(r, "arxiv", "arxiv")).unionByName(claim(real, "abstract", "value"))
    judged = settle(judge_values(claims))
    owner = judged.filter("field in ('doi', 'preprint', 'arxiv')").groupBy("field", "value").agg(F.max(F.struct("score", "n", (-F.col("work")).alias("w"))).alias("top"), F.count(F.lit(1)).alias("works"))
    other = owner.filter("works > 1").select("field", "value", (-F.col("top.w")).alias("owner"))
    own = judged.join(other, ["field", "value"], "left").filter("owner is null or owner = work")
    best = own.groupBy("work", "field").agg(F.max_by("value", F.struct("p", "n", "value")).alias("value"))
    best = settle(best.groupBy("work").pivot("field", ["doi", "preprint", "arxiv", "abstract"]).agg(F.first("value")))
    full = texts.filter("text = full").join(best.select(F.col("work").alias("first_seq"), F.col("abstract").alias("value")), ["first_seq", "value"], "left_semi").select("first_seq", "text")
    at = r.filter("text is not null").join(full, ["first_seq", "text"]).groupBy("first_seq").agg(F.min_by("seq", F.struct("cut", "seq")).alias("abstract_seq"))
    sources = r.select("first_seq", F.explode("names").alias("s")).filter("s <> '?'").groupBy("first_seq").agg(F.array_join(F.array_sort(F.collect_set("s")), ",").alias("sources"))
    out = r.select("first_seq").distinct().join(best.withColumnRenamed("work", "first_seq"), "first_seq", "left").join(at, "first_seq", "left").join(sources, "first_seq", "left")
    empty = F.lit("")
    return out.select("first_seq", F.coalesce("doi", "preprint", empty).alias("doi"), F.coalesce("arxiv", empty).alias("arxiv_id"), "abstract_seq", F.coalesce("sources", empty).alias("sources"))
