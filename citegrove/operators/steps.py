"""The model steps of a card's life: analysis of claims, queries, extraction, menus, recipes, proposals, choices, embeddings. All on ModelClient."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citegrove.functions.text import strip
from citegrove.operators import curation, taxonomy
from citegrove.operators.models import ModelClient, StubClient, complete, complete_json

Factory = Callable[[], ModelClient]
ITEM = "array<struct<name:string,detail:string,kind:string,evidence:array<string>,applies_when:array<string>>>"
ANALYSIS = "subfields array<string>, new_subfields array<string>, temporal_mode string, entities struct<models:array<string>,datasets:array<string>,metrics:array<string>,thresholds:array<string>>, confidence double"
RECIPE = "recipes array<struct<dataset:string,model:string,method_under_test:string,metrics:array<string>>>"


def prompt(template: str, **columns: Column) -> Column:
    """template with each {name} replaced by its column; nulls are empty."""
    out = F.lit(template)
    for name, c in columns.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(c.cast("string"), F.lit("")))
    return out


def cleaned(c: Column) -> Column:
    """The entries of an array without blanks at the ends, empty ones and repeats dropped, in order."""
    return F.array_distinct(F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), strip), lambda x: x != ""))


def classify(claims: DataFrame, key: str, claim: str, tasks: DataFrame, order: str, template: str, factory: Factory = StubClient) -> tuple[DataFrame, DataFrame]:
    """(key, subfields, new_subfields, temporal_mode, entities, confidence, error), and the taxonomy with the new subfields.

    Subfields that the model names are put in the taxonomy's words, by name or nearest task, else kept; new ones are added unless
    they are near one that is there. An answer that fails leaves its claim with empty lists and the error.
    """
    p = claims.select(key, prompt(template, claim=F.col(claim)).alias("_p"))
    said = complete_json(p, key, "_p", ANALYSIS, factory)
    said = said.select(key, "value.*", "error")
    named = said.select(key, F.posexplode(cleaned(F.col("subfields"))).alias("pos", "label"), F.lit(False).alias("new"))
    fresh = said.select(key, F.posexplode(cleaned(F.col("new_subfields"))).alias("pos", "label"), F.lit(True).alias("new"))
    grown, placed = taxonomy.add_labels(tasks, fresh, "label", order)
    known = taxonomy.canonical_labels(named, "label", tasks, order).withColumn("task", F.coalesce("task", "label"))
    both = known.select(key, "new", "pos", "task").unionByName(placed.select(key, "new", "pos", "task"))
    lists = both.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("new", "pos", "task"))).alias("x"))
    none = F.array().cast("array<string>")
    out = said.drop("subfields", "new_subfields").join(lists, key, "left")
    every, news = F.transform("x", lambda x: x["task"]), F.transform(F.filter("x", lambda x: x["new"]), lambda x: x["task"])
    return out.select(key, F.coalesce(F.array_distinct(every), none).alias("subfields"), F.coalesce(F.array_distinct(news), none).alias("new_subfields"), F.coalesce("temporal_mode", F.lit("static")).alias("temporal_mode"), "entities", F.coalesce("confidence", F.lit(0.5)).alias("confidence"), "error"), grown


def generate_queries(claims: DataFrame, key: str, text: Column, factory: Factory = StubClient) -> DataFrame:
    """(key, bucket, pos, query): the query buckets that the model gives for each prompt text; a query of two buckets stays in the first, whatever its case."""
    said = complete_json(claims.select(key, text.alias("_p")), key, "_p", "map<string,array<string>>", factory)
    rows = said.select(key, F.explode("value").alias("bucket", "qs")).select(key, "bucket", F.posexplode(cleaned(F.col("qs"))).alias("pos", "query"))
    first = rows.groupBy(key, F.lower("query").alias("_q")).agg(F.min_by(F.struct("bucket", "pos", "query"), F.struct("bucket", "pos")).alias("r"))
    return first.select(key, "r.*")


def extract(papers: DataFrame, key: str, text: Column, keys: list[str], factory: Factory = StubClient) -> tuple[DataFrame, DataFrame]:
    """(paper's key, list's key, name, detail, kind and the rest of each item found in a paper), and (paper's key, error) of the calls that failed."""
    schema = ", ".join(f"`{k}` {ITEM}" for k in keys)
    said = complete_json(papers.select(key, text.alias("_p")), key, "_p", schema, factory)
    lists = F.array(*(F.struct(F.lit(k).alias("list"), F.col(f"value.`{k}`").alias("items")) for k in keys))
    items = said.filter("error is null").select(key, F.explode(lists).alias("l")).select(key, F.col("l.list").alias("list"), F.explode("l.items").alias("i")).select(key, "list", "i.*")
    return items.filter(F.coalesce(strip(F.col("name")), F.lit("")) != ""), said.filter("error is not null").select(key, "error")


def consolidate(menus: DataFrame, key: str, text: Column, keys: list[str], extraction: DataFrame, factory: Factory = StubClient) -> tuple[DataFrame, DataFrame]:
    """One menu for each row of menus (a subfield with its prompt text), guarded by what was extracted from the papers, and the guard's counts.

    Items cite papers by title. extraction: title, key, text. Links to papers that don't say it are dropped, then items without a
    link. Controls and confounds become threats of that kind.
    """
    items, _ = extract(menus, key, text, keys, factory)
    numbered = items.withColumn("item_id", F.monotonically_increasing_id()).withColumnRenamed("list", "key_")
    rows = numbered.select("item_id", F.col(key).alias("subfield"), F.col("key_").alias("key"), "name", F.concat_ws(" ", "name", "detail").alias("text"), "detail", "kind", "evidence", "applies_when")
    kept, counts = curation.guard(rows, extraction)
    kind = F.when(F.col("key") == "controls", "control").when(F.col("key") == "confounds", "confound").otherwise(F.col("kind"))
    return kept.withColumn("kind", kind).withColumn("key", F.when(F.col("key").isin("controls", "confounds"), "threats").otherwise(F.col("key"))), counts


def tag_kinds(items: DataFrame) -> DataFrame:
    """Controls and confounds as threats, with what they were as their kind; other items as they are."""
    was = F.col("key")
    kind = F.when(was == "controls", "control").when(was == "confounds", "confound").otherwise(F.col("kind"))
    return items.withColumn("kind", kind).withColumn("key", F.when(was.isin("controls", "confounds"), "threats").otherwise(was))


def recipes(claims: DataFrame, key: str, text: Column, known: DataFrame, factory: Factory = StubClient) -> DataFrame:
    """(key, dataset, model, method_under_test, metrics, untraceable, checks) of the recipes that the model gives; known: key and names (array)."""
    said = complete_json(claims.select(key, text.alias("_p")), key, "_p", RECIPE, factory)
    rows = said.select(key, F.explode("value.recipes").alias("r")).select(key, "r.*").join(known.select(key, "names"), key, "left")
    names = F.coalesce("names", F.array().cast("array<string>"))
    return curation.recipe_checks(rows, names, ["dataset", "model", "method_under_test"], "metrics").drop("names")


def decompose(claims: DataFrame, key: str, text: Column, factory: Factory = StubClient) -> DataFrame:
    """(key, questions, error): the lines of the answer without list marks, blank ones and repeats dropped."""
    said = complete(claims.select(key, text.alias("_p")), key, "_p", factory)
    lines = F.transform(F.split("answer", "\n"), lambda x: F.regexp_replace(x, r"^[\s\-]+", ""))
    return said.select(key, F.when(F.col("answer").isNotNull(), cleaned(lines)).alias("questions"), "error")


def propose(arms: DataFrame, key: str, text: Column, budget: int, factory: Factory = StubClient) -> DataFrame:
    """(key, experiments, n_returned, error): the experiments proposed for each arm, cut to budget; n_returned is their number where it was more."""
    said = complete_json(arms.select(key, text.alias("_p")), key, "_p", "experiments array<string>", factory)
    e = F.coalesce("value.experiments", F.array().cast("array<string>"))
    return said.select(key, F.slice(e, 1, budget).alias("experiments"), F.when(F.size(e) > budget, F.size(e)).alias("n_returned"), "error")


def choose(rows: DataFrame, key: str, text: Column, choices: list[str], cache: DataFrame | None = None, factory: Factory = StubClient) -> DataFrame:
    """(key, prompt_md5, answer, choice, p): one of the choices for each prompt with its probability, from the cache (prompt_md5, answer) where it is known.

    An answer that names none of the choices has a null choice.
    """
    want = rows.select(key, text.alias("_p")).withColumn("prompt_md5", F.md5("_p"))
    if cache is not None:
        want = want.join(cache.groupBy("prompt_md5").agg(F.max("answer").alias("known")), "prompt_md5", "left")
    else:
        want = want.withColumn("known", F.lit(None).cast("string"))
    asked = complete(want.filter("known is null").select("prompt_md5", "_p").dropDuplicates(["prompt_md5"]), "prompt_md5", "_p", factory).select("prompt_md5", F.col("answer").alias("asked"))
    both = want.join(asked, "prompt_md5", "left").withColumn("answer", F.coalesce("known", "asked"))
    value = F.from_json("answer", "choice string, p double")
    choice = F.when(F.lower(value["choice"]).isin(*choices), F.lower(value["choice"]))
    return both.select(key, "prompt_md5", "answer", choice.alias("choice"), F.when(choice.isNotNull(), value["p"]).alias("p"))


def temperature(model: str, wanted: float) -> float | None:
    """The temperature to ask for; None for model families that take none of their own."""
    return None if model.lower().startswith(("gpt-5", "gpt-6", "o1", "o3", "o4")) else wanted


def delays(tries: int, retry_after: list[float | None], first: float = 1.0, most: float = 60.0) -> list[float]:
    """Seconds to wait before each further try: what the server asks for, else twice as long each time, and most at most."""
    out = []
    for i in range(tries - 1):
        asked = retry_after[i] if i < len(retry_after) else None
        out.append(min(most, first * 2**i if asked is None else max(0.0, asked)))
    return out


def hash_embedder(texts: list[str], dims: int = 64) -> list[list[float]]:
    """A vector of each text out of hashes of its words, for runs without a model; a text without words is a zero vector."""
    out = []
    for t in texts:
        v = [0.0] * dims
        for w in (t or "").lower().split():
            h = int.from_bytes(hashlib.sha1(w.encode()).digest()[:8], "big")
            v[h % dims] += 1.0 if h >> 63 else -1.0
        out.append(v)
    return out


def embed(df: DataFrame, key: str, text: str, model: str = "hash", dims: int = 64, cache: DataFrame | None = None, embedder: Callable[[list[str], int], list[list[float]]] = hash_embedder, batch: int = 128) -> DataFrame:
    """(key, hash, vector): unit vectors of the texts, those of the cache (hash, vector) where known, else by embedder in batches.

    hash is the SHA-1 of model, dims and text. Each distinct text is embedded once; null texts have no row; a zero vector stays as it is.
    """
    want = df.filter(F.col(text).isNotNull()).select(key, text, F.sha1(F.concat_ws(":", F.lit(model), F.lit(str(dims)), text)).alias("hash"))
    new = want.select("hash", text).dropDuplicates(["hash"])
    if cache is not None:
        new = new.join(cache.select("hash").distinct(), "hash", "left_anti")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for i in range(0, len(f), batch):
                part = f.iloc[i : i + batch]
                vs = embedder(list(part[text]), dims)
                unit = [[x / (math.sqrt(sum(y * y for y in v)) or 1.0) for x in v] for v in vs]
                yield pd.DataFrame({"hash": list(part["hash"]), "vector": unit})

    vectors = new.mapInPandas(run, "hash string, vector array<double>")
    if cache is not None:
        vectors = vectors.unionByName(cache.groupBy("hash").agg(F.max("vector").alias("vector")))
    return want.select(key, "hash").join(vectors, "hash").select(key, "hash", "vector")
