"""Text functions as Column expressions; all stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lists and patterns that results depend on.
TAXONOMY_STOPS = ["a", "an", "the", "of", "for", "to", "in", "on", "with", "and", "or", "via", "using", "under", "over", "from", "this", "that"]
CONTENT_STOPS = [
    "the", "and", "for", "with", "that", "this", "not", "any", "its", "via", "per", "use", "using", "used", "than", "from", "into", "onto", "same",
    "each", "one", "two", "all", "other", "such", "when", "only", "also",
]
SUFFIXES = ["ations", "ation", "ings", "ing", "ers", "er", "ors", "or", "ies", "es", "ed", "s"]
CLAIM_TYPES = [
    "intervention on model internals", "method comparison", "robustness or attack", "generalisation or transfer", "detection or classification",
    "benchmark or measurement", "agent or embodied task success", "training-signal effect", "any empirical claim",
]
SURVEY = r"(?i)\b(survey|a review|overview of|systematic review)\b"
BENCHMARK = r"(?i)\b(benchmark|dataset|evaluation|toolkit|leaderboard)\b"
SECRET = r"(?i)((?:api_|access_|auth_|secret_)?key|token|password)=[^&\s'\"]+"
YEAR = r"(?<!\d)(?:19[5-9]\d|20[0-3]\d)[a-z]?(?!\d)"
REFERENCES = r"Refer\s?ences|REFER\s?ENCES|Bibliograph|BIBLIOGRAPH"


def blank_to_null(c: Column) -> Column:
    """null for a text that is empty or white space only."""
    return F.when(c.rlike(r"\S"), c)


def strip(c: Column) -> Column:
    """White space of any kind off both ends; null stays null."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def let(value: Column, body) -> Column:
    """body(value), with value worked out once however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def normalize_title(c: Column) -> Column:
    """Lower case, literal escapes dropped, ASCII letters and digits only, single blanks; '' for null."""
    t = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"\\[nrt]", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(t, "[^a-z0-9 ]+", " "), " +", " "))


def dedup_key(doi: Column, arxiv_id: Column, title: Column) -> Column:
    """doi:... before arxiv:... before title:...; an empty identifier is none."""
    own = lambda tag, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(tag), strip(F.lower(c))))
    return F.coalesce(own("doi:", doi), own("arxiv:", arxiv_id), F.concat(F.lit("title:"), normalize_title(title)))


def version_key(title: Column, authors: Column) -> Column:
    """Normal title and first author, '' if either is missing."""
    first = F.get(authors, F.lit(0))
    ok = (F.coalesce(title, F.lit("")) != "") & (F.coalesce(F.size(authors), F.lit(0)) > 0)
    return F.when(ok, F.concat(normalize_title(title), F.lit("|"), strip(F.lower(F.coalesce(first, F.lit("")))))).otherwise("")


def squash(c: Column) -> Column:
    """Lower-case ASCII letters and digits only."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")


def taxonomy_tokens(c: Column) -> Column:
    """Distinct [a-z0-9]+ tokens longer than one letter that aren't stop words."""
    all_of_them = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("([a-z0-9]+)"), 1)
    return F.array_distinct(F.filter(all_of_them, lambda t: (F.length(t) > 1) & ~t.isin(*TAXONOMY_STOPS)))


def bm25_tokens(c: Column) -> Column:
    """The bag of tokens of three characters or more that the ranking counts."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"([a-z0-9][a-z0-9\-]{2,})"), 1)


def word_contains(text: Column, term: Column) -> Column:
    """Whether term stands in the lower-case text with no letter or digit beside it; false for an empty or null term."""
    quoted = F.concat(F.lit(r"(?<![a-z0-9])\Q"), F.replace(F.lower(term), F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E(?![a-z0-9])"))
    return F.coalesce((term != "") & F.regexp_like(text, quoted), F.lit(False))


def stem(w: Column) -> Column:
    """First fitting suffix off, if three letters stay, then a final e."""
    cut = F.when(F.lit(False), w)
    for s in SUFFIXES:
        cut = cut.when((F.length(w) > len(s) + 2) & w.endswith(s), F.left(w, F.length(w) - len(s)))
    cut = cut.otherwise(w)
    return F.when((F.length(cut) > 3) & cut.endswith("e"), F.left(cut, F.length(cut) - 1)).otherwise(cut)


def content_words(c: Column) -> Column:
    """Distinct stems of the words of three letters or more that aren't stop words."""
    w = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("([a-z]{3,})"), 1)
    return F.array_distinct(F.transform(F.filter(w, lambda x: ~x.isin(*CONTENT_STOPS)), stem))


def canon_generic(c: Column) -> Column:
    """Without a bracket at the end and what follows a colon; the whole name if nothing is left; '' for null."""
    head = lambda b: F.when(b.contains(":"), strip(F.get(F.split(b, r"\s*:\s+"), F.lit(0)))).otherwise(b)
    bare = lambda raw: let(strip(F.regexp_replace(raw, r"\s*[\(\[][^\)\]]*[\)\]]\s*$", "")), head)
    return let(strip(F.coalesce(c, F.lit(""))), lambda raw: F.regexp_replace(F.coalesce(F.nullif(bare(raw), F.lit("")), raw), r"^[ .,;\-]+|[ .,;\-]+$", ""))


def release(c: Column) -> Column:
    """Release tier: the first number of one or two digits, with .5 kept; '' if it is 0 or above 20."""
    major = F.regexp_extract(c, r"(?<![\d.])(\d{1,2})(?:\.(\d))?(?!\d)", 1)
    minor = F.regexp_extract(c, r"(?<![\d.])(\d{1,2})(?:\.(\d))?(?!\d)", 2)
    return F.when((major == "") | (major == "0") | (F.try_to_number(major, F.lit("99")) > 20), "").when(minor == "5", F.concat(major, F.lit(".5"))).otherwise(major)


def canon_model(c: Column, families: list[tuple[str, str]], classes: list[str]) -> Column:
    """Family and release tier of a checkpoint's name, by the first family pattern that fits; '' for one of the generic classes.

    Names of no family are treated by canon_generic. families is an ordered rule table of (pattern, display name).
    """

    def named(raw: Column, bare: Column) -> Column:
        scale = F.regexp_replace(bare, r"(?<![A-Za-z0-9])[RV]\d+(?![0-9])", " ")
        scale = F.regexp_replace(F.regexp_replace(scale, r"(?i)\d+\s*x\s*\d+\s*[bm]\b", " "), r"(?i)\d+\s*[bm]\b", " ")
        family = F.when(F.lit(False), raw)
        for pattern, name in families:
            family = family.when(raw.rlike("(?i)" + pattern), name)
        generic = (raw == "") | F.lower(bare).isin(*classes) | F.lower(raw).isin(*classes)
        of_family = lambda f: F.when(f.isNotNull(), F.concat_ws("-", f, F.nullif(let(scale, release), F.lit("")))).otherwise(canon_generic(raw))
        return F.when(generic, "").otherwise(let(family, of_family))

    stripped = lambda raw: F.regexp_replace(F.regexp_replace(raw, r"\s*[\(\[].*?[\)\]]\s*", " "), r"^[ .,;:\-]+|[ .,;:\-]+$", "")
    return let(strip(F.coalesce(c, F.lit(""))), lambda raw: let(stripped(raw), lambda bare: named(raw, bare)))


def alias_set(c: Column) -> Column:
    """Squashed names that an item may also go by: the whole, the content of each bracket unless a size or list, and the rest."""
    raw = strip(F.coalesce(c, F.lit("")))
    inner = F.transform(F.regexp_extract_all(raw, F.lit(r"[\(\[]([^\)\]]{1,60})[\)\]]"), 1), strip)
    inner = F.filter(inner, lambda x: (x != "") & ~x.rlike(r"^[\d.,\s]*[bmkBMK]?$") & ~x.contains("/"))
    names = F.concat(F.array(squash(raw)), F.transform(inner, squash), F.array(squash(F.regexp_replace(raw, r"\s*[\(\[][^\)\]]*[\)\]]\s*", " "))))
    return F.array_sort(F.array_distinct(F.filter(names, lambda x: F.length(x) >= 2)))


def claim_types(*tags: Column) -> Column:
    """The known claim types among the tags, in their fixed order."""
    all_tags = F.transform(F.concat(*(F.coalesce(t, F.array().cast("array<string>")) for t in tags)), lambda t: strip(F.lower(t)))
    return F.filter(F.array(*map(F.lit, CLAIM_TYPES)), lambda t: F.array_contains(all_tags, t))


def arxiv_number(arxiv_id: Column, pdf_url: Column, url: Column, doi: Column) -> Column:
    """arXiv number without version, from the field, else a URL of arxiv.org, else a preprint DOI; '' without any."""
    from_url = lambda c: F.nullif(F.regexp_extract(c, r"(?i)arxiv\.org/(?:abs|pdf|html)/(\d{4}\.\d{4,5})", 1), F.lit(""))
    from_doi = F.nullif(F.regexp_extract(doi, r"(?i)10\.48550/arxiv\.(\d{4}\.\d{4,5})", 1), F.lit(""))
    found = F.coalesce(F.nullif(arxiv_id, F.lit("")), from_url(pdf_url), from_url(url), from_doi, F.lit(""))
    return F.regexp_replace(strip(found), r"v\d+$", "")


def redact(c: Column, known: dict[str, str] | None = None) -> Column:
    """Known secrets by value, and whatever stands behind key=, token= or password=."""
    for name, value in (known or {}).items():
        if len(value) > 6:
            c = F.replace(c, F.lit(value), F.lit(f"<{name}:redacted>"))
    return F.regexp_replace(c, SECRET, "$1=<redacted>")


def slug(c: Column) -> Column:
    return F.translate(c, ":,/", "-_-")


def arm_base(c: Column) -> Column:
    """nocard, rag, retrieval or card by what the arm's name contains, tried in that order; else the lower-case name."""
    a = F.lower(F.coalesce(c, F.lit("")))
    return F.when(a.contains("nocard"), "nocard").when(a.contains("rag"), "rag").when(a.contains("retr"), "retrieval").when(a.contains("card"), "card").otherwise(a)


def problem_id(paper_id: Column, claim_id: Column) -> Column:
    """Dots as _, with the claim behind it unless it is c0."""
    p = F.replace(paper_id, F.lit("."), F.lit("_"))
    return F.when(claim_id == "c0", p).otherwise(F.concat(p, F.lit("_"), claim_id))


def paper_of(problem: Column) -> Column:
    """The paper of a problem id, without the claim's suffix."""
    return F.regexp_replace(problem, r"_c\d+$", "")


def paper_type(title: Column, abstract: Column) -> Column:
    t = F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.left(F.coalesce(abstract, F.lit("")), F.lit(400)))
    return F.when(t.rlike(SURVEY), "survey").when(t.rlike(BENCHMARK), "benchmark").otherwise("method")


def matches_but_not(c: Column, good: str, bad: str) -> Column:
    """Whether a text fits the good pattern and not the bad one; false for null."""
    return F.coalesce(c.rlike(good) & ~c.rlike(bad), F.lit(False))


def authority(citations: Column, year: Column, now: int) -> Column:
    """log1p of the citations a year; half of log1p of all where the year is unknown or to come."""
    cites = F.coalesce(citations, F.lit(0)).cast("double")
    age = F.greatest(F.lit(1), F.lit(now) - year + 1)
    known = F.coalesce(year, F.lit(0)).between(1, now)
    return F.when(known, F.log1p(cites / age)).otherwise(0.5 * F.log1p(cites))


def recency(year: Column, now: int) -> Column:
    return F.when(F.coalesce(year, F.lit(0)) == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), 1 - (F.lit(now) - year) / F.lit(15.0)))


def distinct_lines(c: Column) -> Column:
    """Lines without blanks and list marks at the ends, blank ones and repeats dropped, order kept."""
    lines = F.transform(F.split(c, "\n"), lambda x: F.regexp_replace(x, r"^[\s\-]+|[\s\-]+$", ""))
    return F.array_distinct(F.filter(lines, lambda x: x != ""))


def menu_format(keys: Column) -> Column:
    """'2', '0.4' or '0.3', by the keys that a menu carries."""
    has = lambda *names: reduce(lambda a, b: a | b, (F.array_contains(keys, n) for n in names))
    return F.when(has("threats") & ~has("validity_checks", "protocols"), "2").when(has("threats", "baselines"), "0.4").otherwise("0.3")


def html_text(html: Column) -> Column:
    """Text of a page by patterns alone: script, style, nav, header, footer and button dropped, headings marked, blocks as lines."""
    t = F.regexp_replace(html, r"(?is)<(script|style|nav|header|footer|button)\b.*?</\1\s*>", " ")
    t = F.regexp_replace(t, r"(?is)<h[1-6][^>]*>", "\n## ")
    t = F.regexp_replace(t, r"(?is)</t[dh]>", " | ")
    t = F.regexp_replace(t, r"(?is)<(br|/p|/div|/h[1-6]|/li|/tr)[^>]*>", "\n")
    t = F.regexp_replace(t, r"(?s)<[^>]+>", "")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"[ \t]+", " "), r"\s*\n\s*", "\n"))


def json_candidates(c: Column) -> Column:
    """A model's answer as JSON text: the fenced or whole text if it parses, else the outermost object, else the outermost list; null if none parses."""
    t = strip(F.regexp_replace(F.regexp_replace(strip(c), r"^```[a-zA-Z]*\s*", ""), r"\s*```$", ""))
    tries = [t, F.regexp_extract(t, r"(?s)(\{.*\})", 1), F.regexp_extract(t, r"(?s)(\[.*\])", 1)]
    return F.coalesce(*(F.when((x != "") & F.try_parse_json(x).isNotNull(), x) for x in tries))


def joined_values(m: Column) -> Column:
    """The string values of a map, joined with blanks."""
    return F.array_join(F.map_values(m), " ")


def truncated(c: Column, n: int) -> Column:
    """The first n characters on one line."""
    return F.left(F.translate(c, "\n", " "), F.lit(n))


def provenance_line(kind: Column, author: Column, sources: Column) -> Column:
    """What is known of a reference's origin, joined by a middle dot, with up to three sources."""
    named = F.when(F.size(sources) > 0, F.concat(F.lit("sources: "), F.array_join(F.slice(sources, 1, 3), ", ")))
    return F.concat_ws(" · ", F.nullif(kind, F.lit("")), F.when(author != "", F.concat(F.lit("by "), author)), named)
