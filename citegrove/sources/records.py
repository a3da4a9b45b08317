"""Mappers from the answers of search services to paper records, and the registry of sources."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citegrove.schemas import PAPER_COLUMNS

_ATOM = "id string, title string, summary string, published string, author array<struct<name:string>>"
_OPENALEX = (
    "id string, title string, doi string, publication_year int, cited_by_count bigint, abstract_inverted_index map<string,array<int>>, relevance_score double, "
    "authorships array<struct<author:struct<display_name:string>>>, primary_location struct<landing_page_url:string,pdf_url:string,source:struct<display_name:string>>, "
    "open_access struct<oa_url:string>, concepts array<struct<display_name:string>>, topics array<struct<id:string>>"
)
_SCHOLAR = (
    "title string, abstract string, tldr struct<text:string>, year int, venue string, citationCount bigint, url string, openAccessPdf struct<url:string>, "
    "externalIds struct<DOI:string,ArXiv:string>, authors array<struct<name:string>>, fieldsOfStudy array<string>"
)
_SERP = "title string, link string, snippet string, publication_info struct<summary:string>, inline_links struct<cited_by:struct<total:bigint>>"
_PWC = "title string, abstract string, authors array<string>, published string, proceeding string, url_abs string, url_pdf string, arxiv_id string, tasks variant, methods variant, datasets variant, metrics variant"


def as_papers(df: DataFrame, keep: tuple[str, ...] = (), **columns: Column) -> DataFrame:
    """df as paper records: the columns given, '' or empty for the others, after those of df to keep."""
    blank = {"string": F.lit(""), "int": F.lit(None), "bigint": F.lit(0), "double": F.lit(0.0)}
    full = [F.coalesce(columns.get(n, F.lit(None).cast(t)), blank.get(t, F.lit(None)).cast(t) if t in blank else (F.array() if t.startswith("array") else F.create_map()).cast(t)).alias(n) for n, t in PAPER_COLUMNS]
    return df.select(*keep, *full)


def _line(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def from_atom(entries: DataFrame, xml: str) -> DataFrame:
    """Entries of an Atom feed, one XML text a row: white space collapsed, the first 25 authors, the year of publication."""
    e = entries.select(F.from_xml(F.col(xml), _ATOM).alias("e")).select("e.*")
    link = F.element_at(F.split("id", "/abs/"), -1)
    return as_papers(e, title=_line(F.col("title")), abstract=_line(F.col("summary")), authors=F.slice(F.transform("author", lambda a: a["name"]), 1, 25), year=F.try_to_number(F.left("published", F.lit(4)), F.lit("9999")).cast("int"), venue=F.lit("arXiv"), url=F.col("id"), pdf_url=F.replace("id", F.lit("/abs/"), F.lit("/pdf/")), arxiv_id=F.regexp_replace(link, r"v\d+$", ""))


def inverted_text(index: Column) -> Column:
    """An inverted index word -> positions as text, by position and word."""
    pairs = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.array_join(F.transform(F.array_sort(pairs), lambda x: x["w"]), " ")


def from_openalex(works: DataFrame, json: str, *keep: str) -> DataFrame:
    """Works as JSON texts: bare DOI, 25 authors, six concepts, topic ids without their address."""
    w = works.select(*keep, F.from_json(json, _OPENALEX).alias("w")).select(*keep, "w.*")
    tail = lambda c: F.element_at(F.split(c, "/"), -1)
    return as_papers(
        w, keep, title=F.col("title"), abstract=inverted_text(F.col("abstract_inverted_index")), authors=F.slice(F.transform("authorships", lambda a: a["author"]["display_name"]), 1, 25), year=F.col("publication_year"), venue=F.col("primary_location.source.display_name"),
        citations=F.col("cited_by_count"), url=F.coalesce("primary_location.landing_page_url", "id"), pdf_url=F.coalesce("primary_location.pdf_url", "open_access.oa_url"), doi=F.regexp_replace("doi", r"^https?://doi\.org/", ""),
        fields_of_study=F.slice(F.transform("concepts", lambda c: c["display_name"]), 1, 6), topic_ids=F.transform("topics", lambda t: tail(t["id"])), semantic_score=F.col("relevance_score"),
    )


def from_scholar(works: DataFrame, json: str, *keep: str) -> DataFrame:
    """Works as JSON texts; the short summary stands in for a missing abstract."""
    w = works.select(*keep, F.from_json(json, _SCHOLAR).alias("w")).select(*keep, "w.*")
    return as_papers(
        w, keep, title=F.col("title"), abstract=F.coalesce(F.nullif("abstract", F.lit("")), F.col("tldr.text")), authors=F.slice(F.transform("authors", lambda a: a["name"]), 1, 25), year=F.col("year"), venue=F.col("venue"), citations=F.col("citationCount"),
        url=F.col("url"), pdf_url=F.col("openAccessPdf.url"), doi=F.col("externalIds.DOI"), arxiv_id=F.col("externalIds.ArXiv"), fields_of_study=F.col("fieldsOfStudy"),
    )


def from_serp(results: DataFrame, json: str, *keep: str) -> DataFrame:
    """Search results as JSON texts: authors and year read out of the summary line."""
    r = results.select(*keep, F.from_json(json, _SERP).alias("r")).select(*keep, "r.*").withColumn("s", F.coalesce("publication_info.summary", F.lit("")))
    year = F.get(F.filter(F.split("s", r"[\s,]+"), lambda t: t.rlike(r"^\d{4}$")), F.lit(0))
    names = F.filter(F.transform(F.split(F.get(F.split("s", " - "), F.lit(0)), ","), lambda a: F.trim(a)), lambda a: a != "")
    return as_papers(r, keep, title=F.col("title"), abstract=F.col("snippet"), authors=names, year=year.cast("int"), url=F.col("link"), citations=F.col("inline_links.cited_by.total"))


def from_task_papers(papers: DataFrame, json: str, *keep: str) -> DataFrame:
    """Papers listed under a task as JSON texts; lists hold names or objects with a name."""
    p = papers.select(*keep, F.from_json(json, _PWC).alias("p")).select(*keep, "p.*")

    def names(c: str) -> Column:
        items = F.from_json(F.to_json(F.col(c)), "array<variant>")
        named = F.transform(items, lambda v: F.coalesce(F.try_variant_get(v, "$.name", "string"), F.try_variant_get(v, "$", "string")))
        return F.coalesce(F.filter(named, lambda x: x != ""), F.array().cast("array<string>"))

    tags = F.map_filter(F.create_map(*(x for c in ("tasks", "methods", "datasets", "metrics") for x in (F.lit(c), names(c)))), lambda _, v: F.size(v) > 0)
    return as_papers(p, keep, title=F.col("title"), abstract=F.col("abstract"), authors=F.slice("authors", 1, 25), year=F.left("published", F.lit(4)).cast("int"), venue=F.col("proceeding"), url=F.col("url_abs"), pdf_url=F.col("url_pdf"), arxiv_id=F.col("arxiv_id"), tags=tags)


def stamped(papers: DataFrame, source: str, query: str, bucket: str | None = None) -> DataFrame:
    """papers with where they come from."""
    p = papers.withColumn("sources", F.array_union("sources", F.array(F.lit(source)))).withColumn("queries", F.array_union("queries", F.array(F.lit(query))))
    return p.withColumn("buckets", F.array_union("buckets", F.array(F.lit(bucket)))) if bucket else p


def first_pdf(*candidates: Column) -> Column:
    """The first address of a resolver chain that isn't empty."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in candidates))


def resolve_topics(answer: DataFrame, least: float = 0.6, k: int = 3) -> DataFrame:
    """(topic_id, score): the first k topics of a score of least or more; answer: pos, id, score."""
    good = answer.filter(F.col("score") >= least).orderBy("pos").limit(k)
    return good.select(F.element_at(F.split("id", "/"), -1).alias("topic_id"), "score")


def merge_taxonomy(pages: DataFrame, areas: DataFrame, old: DataFrame) -> DataFrame:
    """Tasks of all pages with their area, and the rows of the old taxonomy that were added by hand."""
    new = pages.join(areas, "area_id", "left").select("task", F.coalesce("area", F.lit("")).alias("area"), F.transform(F.split("keywords", ","), lambda k: F.trim(k)).alias("keywords"), F.lit("pwc").alias("source"))
    return new.unionByName(old.filter("source = 'custom'").select("task", "area", "keywords", "source"))


class Sources:
    """Named sources; each is a function (query, limit) -> DataFrame of papers."""

    def __init__(self) -> None:
        self._by_name: dict[str, Callable[[str, int], DataFrame]] = {}
        self.failed: list[tuple[int, str, str, str]] = []

    def register(self, name: str, search: Callable[[str, int], DataFrame]) -> None:
        self._by_name[name] = search

    def get(self, names: list[str]) -> dict[str, Callable[[str, int], DataFrame]]:
        if unknown := sorted(set(names) - set(self._by_name)):
            raise KeyError(f"unknown sources {unknown}; there are {sorted(self._by_name)}")
        return {n: self._by_name[n] for n in names}

    def search(self, names: list[str], queries: list[tuple[str, str]], limit: int) -> DataFrame:
        """The union of all sources over (query, bucket) pairs, tagged with both and numbered by call.

        A call that fails is left out and its error noted in failed, as (call, source, query, error); if none is left, an error is raised.
        """
        legs, self.failed = [], []
        for call, (query, bucket, name, search) in enumerate((q, b, n, s) for q, b in queries for n, s in self.get(names).items()):
            try:
                legs.append(stamped(search(query, limit), name, query, bucket).withColumn("call", F.lit(call)))
            except Exception as e:
                self.failed.append((call, name, query, f"{type(e).__name__}: {e}"[:300]))
        if not legs:
            raise ValueError(f"no call gave an answer: {self.failed or 'no query or no source'}")
        out = legs[0]
        for leg in legs[1:]:
            out = out.unionByName(leg)
        return out
