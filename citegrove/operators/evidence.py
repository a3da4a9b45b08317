"""Evidence texts for a proposer: abstracts, passages, cards; sections of a card, and the conditions of an experiment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citegrove.functions.text import strip


def listed(rows: DataFrame, by: str | list[str], order: str, line: Column, between: str, name: str) -> DataFrame:
    """(by, name): the lines of each group in order, joined by between; null lines are left out."""
    by = [by] if isinstance(by, str) else by
    lines = rows.select(*by, F.struct(F.col(order).alias("o"), line.alias("t")).alias("x")).filter("x.t is not null")
    return lines.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["t"]), between).alias(name))


def abstracts(ranked: DataFrame, query: str, n: int = 10, chars: int = 700) -> DataFrame:
    """(query, evidence): the first n papers of each query's ranking, numbered, with title and the first chars characters of the abstract.

    ranked: query, rank, title, abstract. Missing titles and abstracts are empty; a query without papers has no row.
    """
    plain = lambda c: strip(F.coalesce(c, F.lit("")))
    cut = F.left(F.translate(plain("abstract"), "\n", " "), F.lit(chars))
    line = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), plain("title"), F.lit("\n    "), cut)
    return listed(ranked.filter(F.col("rank") <= n), query, "rank", line, "\n", "evidence")


def passages(chosen: DataFrame, query: str) -> DataFrame:
    """(query, evidence): the chosen passages of each query in order of rank, each under its paper's title. chosen: query, rank, title, passage."""
    line = F.concat(F.lit("[from: "), F.coalesce("title", F.lit("")), F.lit("]\n"), F.col("passage"))
    return listed(chosen, query, "rank", line, "\n\n", "evidence")


# Keys in the order in which a card is read, by format, and the headings of its sections.
RESOURCE_SECTIONS, DESIGN_SECTIONS = ["datasets", "models", "metrics"], ["protocols", "controls", "confounds"]
SECTIONS = {
    "0.3": ["protocols", "controls", "confounds", "datasets", "models", "metrics"],
    "0.4": ["threats", "validity_checks", "evidence_standards", "protocols", "baselines", "metrics", "datasets"],
    "2": ["threats", "evidence_standards", "baselines", "metrics", "datasets"],
}
TITLES = {
    "datasets": "Datasets this subfield evaluates on",
    "models": "Models and methods this subfield runs",
    "metrics": "Metrics this subfield reports",
    "protocols": "How this subfield takes a measurement",
    "controls": "Control conditions this subfield expects alongside an intervention",
    "confounds": "Rival explanations a referee in this subfield will raise, and what discriminates against each",
    "threats": "What a referee in this subfield will expect an experiment to rule out, what rules each out, and the kinds of claim it applies to",
    "validity_checks": "How this subfield's measurements can mislead, and the check that catches each",
    "evidence_standards": "What this subfield accepts as evidence that a difference is real",
    "baselines": "Baselines this subfield compares against, and what a fair comparison holds equal",
    "threats of kinds": "Control conditions this subfield expects alongside an intervention, and rival explanations a referee will raise, with what each rules out",
}
FIELDS = ["role", "direction", "detail", "rules_out", "ruled_out_by", "rule_out", "fair_comparison", "instrument", "misleads_when", "check", "eval_protocol", "caveat", "kind"]


def with_fields(card: DataFrame) -> DataFrame:
    """card with every text field of an item, '' where it is missing, and applies_when, empty where it is missing."""
    out = card
    for f in FIELDS:
        out = out.withColumn(f, F.coalesce(f, F.lit("")) if f in card.columns else F.lit(""))
    none = F.array().cast("array<string>")
    return out.withColumn("applies_when", F.coalesce("applies_when", none) if "applies_when" in card.columns else none)


def _part(before: str, c: Column | str, after: str = "") -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c != "", F.concat(F.lit(before), c, F.lit(after))).otherwise("")


def section_bodies(card: DataFrame, by: list[str], n: int = 20) -> DataFrame:
    """(by, key, body): the first n items of each key of each card, by place, as a proposer reads them.

    card: by, key, place, name and any of FIELDS and applies_when. Resources stand in one line unless an item has a recipe or caveat of its own; design
    items have a line each. Threats of kinds show their kind first. A card without items has no rows.
    """
    c = with_fields(card.filter((F.col("place") <= n) & F.col("name").isNotNull()))
    own = F.when(F.col("key") == "datasets", F.col("eval_protocol")).when(F.col("key") == "metrics", F.col("caveat")).otherwise("")
    c = c.withColumn("own", own)
    any_of = c.groupBy(*by, "key").agg(F.max(F.col("own") != "").alias("has_own"), F.max(F.col("kind") != "").alias("has_kind"))
    noun = F.concat(F.col("name"), _part(" (", "role", ")"), _part(" (", "direction", ")"))
    of_kind = F.concat(F.lit("- ["), "kind", F.lit("] "), "name", _part(": ", "detail"), _part(" Rules out: ", "rules_out"), _part(" Ruled out by: ", "ruled_out_by"))
    types = F.array_join("applies_when", "; ")
    threat = F.concat(F.lit("- "), "name", _part(": ", "detail"), _part(" Rule out: ", "rule_out"), _part(" [applies when the claim is: ", types, "]"))
    check = F.concat(F.lit("- "), F.coalesce(F.nullif("instrument", F.lit("")), F.col("name")), _part(" misleads when ", "misleads_when"), _part(" Check: ", "check"))
    baseline = F.concat(F.lit("- "), "name", _part(" (", "role", ")"), _part(": hold equal ", "fair_comparison"))
    tail = F.array_join(F.filter(F.array("detail", "rules_out", "ruled_out_by"), lambda x: x != ""), " ")
    key, resource = F.col("key"), F.col("key").isin(*RESOURCE_SECTIONS)
    line = F.when(F.col("has_own"), F.concat(F.lit("- "), noun, _part(": ", "own"))).when((key == "threats") & F.col("has_kind"), of_kind).when(resource, noun)
    line = line.when(key == "baselines", baseline).when(key == "threats", threat).when(key == "validity_checks", check).otherwise(F.concat(F.lit("- "), "name", _part(": ", tail)))
    lines = c.join(any_of, [*by, "key"]).withColumn("line", line)
    each = lines.groupBy(*by, "key").agg(F.array_sort(F.collect_list(F.struct("place", "line"))).alias("x"), F.max("has_own").alias("has_own"))
    between = F.when(F.col("key").isin(*RESOURCE_SECTIONS) & ~F.col("has_own"), ", ").otherwise("\n")
    texts = F.transform("x", lambda x: x["line"])
    return each.select(*by, "key", F.when(between == ", ", F.array_join(texts, ", ")).otherwise(F.array_join(texts, "\n")).alias("body"))


def resolve_sections(spec: str | None, fmt: str = "0.4") -> list[str]:
    """The keys that a spec names: 'all' (those of the format), 'resources', 'design' or keys with commas between; an unknown key is an error."""
    s = (spec or "all").strip().lower()
    if s == "all":
        return SECTIONS[fmt]
    if s in ("resources", "design"):
        return RESOURCE_SECTIONS if s == "resources" else DESIGN_SECTIONS
    picked = [x.strip() for x in s.split(",") if x.strip()]
    known = list(dict.fromkeys(k for keys in SECTIONS.values() for k in keys))
    if odd := [x for x in picked if x not in known]:
        raise ValueError(f"unknown sections {odd}; there are {known}")
    return picked


def card_sections(card: DataFrame, by: list[str], fmt: str = "0.4", spec: str | None = None, n: int = 20) -> DataFrame:
    """(by, number, title, body): the sections of each card in the order in which they are read."""
    keys = resolve_sections(spec, fmt)
    title = lambda k: TITLES["threats of kinds" if fmt == "2" and k == "threats" else k]
    order = F.create_map(*(x for i, k in enumerate(keys) for x in (F.lit(k), F.struct(F.lit(i).alias("number"), F.lit(title(k)).alias("title")))))
    bodies = section_bodies(card.filter(F.col("key").isin(*keys)), by, n).withColumn("o", order[F.col("key")])
    return bodies.select(*by, "o.number", "o.title", "body")


def card_text(sections: DataFrame, by: list[str]) -> DataFrame:
    """(by, evidence): the sections of each card as one text, their lines indented below the title."""
    block = F.concat("title", F.lit(":\n"), F.array_join(F.transform(F.split("body", "\n"), lambda x: F.concat(F.lit("  "), x)), "\n"))
    return listed(sections, by, "number", block, "\n", "evidence")


def menu_text(card: DataFrame, by: list[str], fmt: str = "0.4", n: int = 18) -> DataFrame:
    """(by, text): a menu as a prompt lists it: resources of a key in a line, then design items with what is known of each."""
    keys = SECTIONS[fmt]
    resources = [k for k in keys if k in (*RESOURCE_SECTIONS, "baselines")]
    order = F.create_map(*(x for i, k in enumerate([*resources, *(k for k in keys if k not in resources)]) for x in (F.lit(k), F.lit(i))))
    c = with_fields(card.filter((F.col("place") <= n) & F.col("name").isNotNull() & F.col("key").isin(*keys)))
    noun = F.concat(F.col("name"), _part(" (", "role", ")"), _part(" (", "direction", ")"))
    tail = F.array_join(F.filter(F.array("detail", "rules_out", "ruled_out_by", "rule_out", "misleads_when", "check"), lambda x: x != ""), " | ")
    c = c.withColumn("line", F.when(F.col("key").isin(*resources), noun).otherwise(F.concat(F.lit("  - "), "name", _part(" — ", tail))))
    each = c.groupBy(*by, "key").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "line"))), lambda x: x["line"]).alias("x"))
    block = F.when(F.col("key").isin(*resources), F.concat("key", F.lit(": "), F.array_join("x", ", "))).otherwise(F.concat("key", F.lit(":\n"), F.array_join("x", "\n")))
    return listed(each.withColumn("number", order[F.col("key")]), by, "number", block, "\n", "text")


def conditions(names: list[str], claims: DataFrame, by: str, cards: DataFrame | None = None, abstracts: DataFrame | None = None, passages: DataFrame | None = None, label: str = "") -> DataFrame:
    """(by, condition, evidence): what each claim's proposer is shown in each condition named; a claim whose input is missing has no row of it.

    nocard shows nothing, retrieval the abstracts, rag the passages, card the card's text; label is put behind card. The inputs have by and
    evidence. An unknown name is an error.
    """
    inputs = {"retrieval": abstracts, "rag": passages, "card": cards}
    if odd := [x for x in names if x not in ("nocard", *inputs)]:
        raise ValueError(f"unknown conditions {odd}; there are nocard, retrieval, rag, card")
    out = claims.select(by, F.lit("").alias("condition"), F.lit("").alias("evidence")).filter("false")
    for name in names:
        shown = f"card:{label}" if name == "card" and label else name
        if name == "nocard":
            out = out.unionByName(claims.select(by, F.lit(shown).alias("condition"), F.lit("").alias("evidence")))
        elif (given := inputs[name]) is not None:
            some = given.filter(F.coalesce("evidence", F.lit("")) != "").select(by, F.lit(shown).alias("condition"), "evidence")
            out = out.unionByName(some.join(claims.select(by).distinct(), by, "left_semi"))
    return out


def choose_ranking(lexical: DataFrame, dense: DataFrame | None, query: str, key: str, mode: str = "bm25") -> DataFrame:
    """(query, key, rank): the ranking by mode bm25, dense or hybrid (both, fused); a query that one of two rankings misses takes the other."""
    from citegrove.operators.retrieval import rrf

    if mode not in ("bm25", "dense", "hybrid"):
        raise ValueError(f"unknown retriever {mode}; there are bm25, dense, hybrid")
    if mode == "bm25" or dense is None:
        return lexical.select(query, key, "rank")
    if mode == "dense":
        return dense.select(query, key, "rank")
    return rrf(lexical, dense, query, key).select(query, key, "rank")
