"""Passages, BM25, dense ranking and rank fusion."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from citegrove.functions.text import bm25_tokens, strip
from citegrove.plans.materialize import settle, ship


def term_stats(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(postings: key, term, tf, length), (df: term, df), (size: one row with n and avg).

    Documents without a token count in n with length 0. A null text is an empty one. Texts are cut into tokens once: the postings are
    written, and the other two are read from them and from the number of documents.
    """
    toks = docs.select(key, bm25_tokens(F.col(text)).alias("toks"))
    postings = settle(toks.select(key, F.size("toks").cast("long").alias("length"), F.explode("toks").alias("term")).groupBy(key, "term", "length").agg(F.count(F.lit(1)).alias("tf")))
    df = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    total = postings.groupBy().agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("tokens"))
    size = docs.groupBy().agg(F.count(F.lit(1)).alias("n")).crossJoin(total).select("n", (F.col("tokens") / F.greatest("n", F.lit(1))).alias("avg"))
    return postings, df, size


#: Queries that travel to the documents at once; more take several rounds.
TRAVELLING = 20_000
#: Tasks a core that score at most: each leaves lists of its own, so that more tasks, as of many small files, would only make more rows to shuffle.
TASKS_A_CORE = 4
#: Queries whose lists are merged at once, and documents that are scored at once at most.
QUERY_BLOCK, DOC_BLOCK = 512, 4096
#: Weights of terms and documents that a task holds at most, where a block has 64 documents or more.
WEIGHTS_HELD = 1 << 23
#: Groups whose least scores are kept for queries with less than k documents.
GROUPS_KEPT = 64
_TOKEN = re.compile(r"[a-z0-9][a-z0-9\-]{2,}").findall


def bm25(queries: DataFrame, query_key: str, query_text: str, docs: DataFrame, key: str, text: str, k: int, k1: float = 1.5, b: float = 0.75, group: str | None = None, cap: int = 3) -> DataFrame:
    """(query_key, key, score, rank): the k best documents of each query, ties to the larger key; with group, cap of one group at most.

    A query's terms count once. Terms that no document holds and documents of score 0 are left out. A null text is an empty one, documents of a
    null group are a group. Queries of equal terms are scored once.

    Documents are cut into tokens once, and the numbers of the queries' terms are written. The queries go to them in rounds of about TRAVELLING:
    every task scores all its documents for each query of the round and keeps the k best, so only k rows a query and task are
    shuffled, however many pairs have a term in common, and tasks grow with the cores and not with the documents or their files. That is exact
    with a cap too: what a group's cap takes from a task's list, better documents of that group replace elsewhere.
    """
    bags = queries.select(query_key, F.array_sort(F.array_distinct(bm25_tokens(F.col(query_text)))).alias("bag")).filter(F.size("bag") > 0)
    same = settle(bags.groupBy("bag").agg(F.min(query_key).alias("lead")))
    rounds = max(1, -(-same.count() // TRAVELLING))
    coded, terms, df = _coded(same, docs, key, text, group)
    order = [F.desc(F.round("score", 9)), F.desc(key)]
    best = None
    for i in range(rounds):
        part = _scored(same.filter(F.pmod(F.xxhash64("lead"), F.lit(rounds)) == i), coded, terms, df, key, k, k1, b, group, cap).repartition("lead")
        if group:
            part = part.withColumn("_g", F.row_number().over(Window.partitionBy("lead", group).orderBy(*order))).filter(F.col("_g") <= cap).drop("_g", group)
        part = part.withColumn("rank", F.row_number().over(Window.partitionBy("lead").orderBy(*order))).filter(F.col("rank") <= k)
        part = settle(part) if rounds > 1 else part
        best = part if best is None else best.unionByName(part)
    return best.join(bags.join(same, "bag").select(query_key, "lead"), "lead").select(query_key, key, "score", "rank")


def _coded(same: DataFrame, docs: DataFrame, key: str, text: str, group: str | None) -> tuple[DataFrame, dict[str, int], np.ndarray]:
    """(documents: key, group, length, numbers of the queries' terms and how often each is there; number of each term, the most used first; how many documents hold each, with the numbers of documents and tokens at the end)."""
    spark = docs.sparkSession
    ship(spark)
    used = same.select(F.explode("bag").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n")).toArrow().to_pydict()  # a row a word of the queries
    terms = {t: i for i, (_, t) in enumerate(sorted(zip((-n for n in used["n"]), used["t"], strict=True)))}
    known = spark.sparkContext.broadcast(terms)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = known.value
        for batch in batches:
            length, ends, term, tf = [], [0], [], []
            for x in batch.column(1):
                toks = _TOKEN((x.as_py() or "").lower())
                length.append(len(toks))
                for t, n in Counter(toks).items():
                    i = at.get(t)
                    if i is not None:
                        term.append(i)
                        tf.append(n)
                ends.append(len(term))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(xs, pa.int32())) for xs in (term, tf)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *([batch.column(2)] if group else []), pa.array(length, pa.int32()), *lists], names=[key, *(["_group"] if group else []), "_length", "_term", "_tf"])

    kind = docs.schema[key].dataType.simpleString()
    cols = docs.select(key, text, *([F.col(group).cast("string").alias("_group")] if group else []))
    coded = settle(cols.mapInArrow(code, f"`{key}` {kind}, {'_group string, ' if group else ''}_length int, _term array<int>, _tf array<int>"))
    n_terms = len(terms)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(n_terms + 2, np.int64)
        for batch in batches:
            df[:-2] += np.bincount(batch.column(1).flatten().to_numpy(), minlength=n_terms)
            df[-2] += batch.num_rows
            df[-1] += batch.column(0).to_numpy().sum()
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(df[some], pa.int64())], names=["i", "n"])

    df = np.zeros(n_terms + 2, np.int64)
    for r in coded.select("_length", "_term").mapInArrow(count, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).collect():  # a row a word of the queries
        df[r["i"]] = r["n"]
    return coded, terms, df


def _scored(same: DataFrame, coded: DataFrame, terms: dict[str, int], df: np.ndarray, key: str, k: int, k1: float, b: float, group: str | None, cap: int) -> DataFrame:
    """(lead, key, score and group): each task's k best documents of each bag of terms; same and coded as in bm25 and _coded.

    Bags are in order of their terms' numbers, so that neighbours share the sums of the terms that they begin with. Blocks of documents begin small, which
    soon gives each query a score that further documents must reach.
    """
    sc = coded.sparkSession.sparkContext
    n_docs, average = int(df[-2]), float(df[-1] / max(1, df[-2]))
    idf = np.log(1 + (n_docs - df[:-2] + 0.5) / (df[:-2] + 0.5))
    queries = same.select("lead", "bag").toArrow().combine_chunks()  # about TRAVELLING
    rows = sorted((tuple(sorted(i for i in map(terms.__getitem__, bag) if df[i])), at) for at, bag in enumerate(queries["bag"].to_pylist()))
    rows = [(bag, at) for bag, at in rows if bag]
    shared = [0, *(next((i for i, (x, y) in enumerate(zip(a, c)) if x != y), min(len(a), len(c))) for (a, _), (c, _) in zip(rows, rows[1:]))]
    leads = queries["lead"].take(pa.array([at for _, at in rows], pa.int64()))
    shipped = sc.broadcast((idf, [bag for bag, _ in rows], shared, leads.to_pylist()))
    lead_type = leads.type
    most = max(1, min(DOC_BLOCK, max(64, WEIGHTS_HELD // max(1, len(terms)))))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, bags, shared, leads = shipped.value
        n = len(bags)
        no = np.nextafter(0, 1)
        floor = np.full(n, no)  # what a document's rounded score must reach
        group_floor = np.full((n, GROUPS_KEPT + 1), no) if group else None
        codes: dict[str | None, int] = {}
        firsts = range(0, n, QUERY_BLOCK)
        held: list = [None] * len(firsts)  # query, rounded score, key, group, score; the best of each query first
        deepest = max(map(len, bags), default=0)
        key_type, step = None, min(256, most)
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, step)
                at, step = at + step, min(2 * step, most)
                key_type, size = part.column(0).type, part.num_rows
                keys = part.column(0).to_numpy() if pa.types.is_integer(key_type) and not part.column(0).null_count else np.array([*part.column(0).to_pylist(), None], object)[:-1]
                mine = np.zeros(size, np.int64)
                if group:
                    named = part.column(1).dictionary_encode(null_encoding="encode")
                    mine = np.array([codes.setdefault(g, len(codes)) for g in named.dictionary.to_pylist()], np.int64)[named.indices.to_numpy()]
                length, term, tf = part.columns[-3:]
                doc = np.repeat(np.arange(size), term.value_lengths().to_numpy())
                term, tf = term.flatten().to_numpy(), tf.flatten().to_numpy().astype(float)
                if not len(term):
                    continue
                long = k1 * (1 - b + b * np.maximum(1, length.to_numpy()) / average)
                there, place = np.unique(term, return_inverse=True)
                weights = np.zeros((len(there), size))
                weights[place, doc] = idf[term] * (tf * (k1 + 1)) / (tf + long[doc])
                of = dict(zip(there.tolist(), weights))
                space = np.empty((deepest + 1, size))
                room, sums = list(space), [None] * (deepest + 1)
                kept = np.minimum(mine, GROUPS_KEPT)
                for number, first in enumerate(firsts):
                    found, which, scores = [], [], []
                    for q in range(first, min(first + QUERY_BLOCK, n)):
                        bag = bags[q]
                        # The first query of a block of documents has nothing to share with.
                        for i in range(shared[q] if q else 0, len(bag)):
                            row, before = of.get(bag[i]), sums[i]
                            sums[i + 1] = before if row is None else row if before is None else np.add(before, row, room[i + 1])
                        s = sums[len(bag)]
                        if s is None:
                            continue
                        # Scores count as rounded to nine digits; the rest is told by the merge.
                        some = np.flatnonzero(s >= floor[q] - 1e-9)
                        if len(some) and floor[q] == no:
                            some = some[s[some] > 0]
                            if group:
                                some = some[s[some] >= group_floor[q][kept[some]] - 1e-9]
                        if len(some):
                            found.append(some)
                            which.append(np.full(len(some), q))
                            scores.append(s[some])
                    if not found:
                        continue
                    found, which, scores = map(np.concatenate, (found, which, scores))
                    new = [which, np.round(scores, 9), keys[found], mine[found], scores]
                    if held[number] is not None:
                        new = [np.concatenate(x) for x in zip(held[number], new, strict=True)]
                    by_key = new[2]
                    if by_key.dtype == object:
                        rank = {x: i for i, x in enumerate(sorted({*by_key}, key=lambda x: (x is not None, x)))}
                        by_key = np.array([rank[x] for x in by_key])
                    order = np.lexsort((by_key, new[1], new[0]))[::-1]
                    new = [x[order] for x in new]
                    if group:
                        by_group = np.lexsort((np.arange(len(order)), new[3], new[0]))
                        in_group = np.empty(len(order), np.int64)
                        in_group[by_group] = _places(new[0][by_group], new[3][by_group])
                        last = in_group == cap - 1
                        group_floor[new[0][last], np.minimum(new[3][last], GROUPS_KEPT)] = new[1][last]
                        group_floor[:, GROUPS_KEPT] = no
                        new = [x[in_group < cap] for x in new]
                    place = _places(new[0])
                    last = place == k - 1
                    floor[new[0][last]] = np.maximum(new[1][last], no)
                    held[number] = [x[place < k] for x in new]
        names = list(codes)
        for lists in held:
            if lists is not None:
                which, _, found, mine, scores = lists
                cols = [pa.array([leads[q] for q in which], lead_type), pa.array(found, key_type), *([pa.array([names[g] for g in mine], pa.string())] if group else []), pa.array(scores, pa.float64())]
                yield pa.RecordBatch.from_arrays(cols, names=["lead", key, *([group] if group else []), "score"])

    kind = {f.name: f.dataType.simpleString() for f in [*same.schema, *coded.schema]}
    return coded.coalesce(TASKS_A_CORE * sc.defaultParallelism).mapInArrow(score, f"lead {kind['lead']}, `{key}` {kind[key]}, {f'`{group}` string, ' if group else ''}score double")


def _places(*by: np.ndarray) -> np.ndarray:
    """The place of each entry, from 0, in its run of equal values of by."""
    n = len(by[0])
    new = np.ones(n, bool)
    new[1:] = np.any([x[1:] != x[:-1] for x in by], axis=0)
    starts = np.flatnonzero(new)
    return np.arange(n) - np.repeat(starts, np.diff(np.append(starts, n)))


def l2_normalize(v: Column) -> Column:
    """The vector as doubles over its length; a zero vector stays as it is."""
    d = v.cast("array<double>")
    norm = F.sqrt(F.aggregate(d, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(d, lambda x: x / F.when(norm == 0, F.lit(1.0)).otherwise(norm))


def dense_top_k(queries: DataFrame, query_key: str, docs: DataFrame, key: str, vector: str, k: int, block: int = 256) -> DataFrame:
    """(query_key, key, cosine, rank): exact cosine of each query vector against all documents, ties to the larger key.

    The queries travel to the documents in blocks of about block: each is one row, joined to every partition of documents,
    and each pair of block and document gives its cosines at once. Vectors are doubles before they are multiplied.
    """
    unit = docs.select(key, l2_normalize(F.col(vector)).alias("v"))
    q = queries.select(query_key, l2_normalize(F.col(vector)).alias("qv"))
    blocks = max(1, -(-queries.count() // block))
    parts = q.withColumn("block", F.pmod(F.xxhash64(query_key), F.lit(blocks))).groupBy("block").agg(F.collect_list(F.struct(F.col(query_key).alias("q"), "qv")).alias("qs"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    pairs = unit.crossJoin(parts).select(key, F.explode(F.transform("qs", lambda x: F.struct(x["q"].alias("q"), dot(x["qv"], F.col("v")).alias("cosine")))).alias("x"))
    w = Window.partitionBy(query_key).orderBy(F.desc(F.round("cosine", 9)), F.desc(key))
    return pairs.select(F.col("x.q").alias(query_key), key, "x.cosine").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def rrf(first: DataFrame, second: DataFrame, query_key: str, key: str, k: int = 60) -> DataFrame:
    """(query_key, key, score, rank): reciprocal rank fusion of two rankings; ties in order of the first, then the second."""
    legs = first.select(query_key, key, F.lit(0).alias("leg"), "rank").unionByName(second.select(query_key, key, F.lit(1).alias("leg"), "rank"))
    fused = legs.groupBy(query_key, key).agg(F.sum(1 / (F.lit(k) + F.col("rank"))).alias("score"), F.min(F.struct("leg", "rank")).alias("at"))
    w = Window.partitionBy(query_key).orderBy(F.desc(F.round("score", 12)), "at")
    return fused.withColumn("rank", F.row_number().over(w)).select(query_key, key, "score", "rank")


def fixed_windows(text: Column, size: int, overlap: int, least: int) -> Column:
    """Pieces of size characters that overlap, those longer than least; (pos, piece) structs."""
    step = size - overlap
    n = F.greatest(F.lit(0), F.ceil((F.length(text) - overlap) / F.lit(step)).cast("int"))
    at = F.when(F.length(text) > 0, F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1))
    pieces = F.transform(F.coalesce(at, F.array().cast("array<int>")), lambda i: F.struct(i.alias("pos"), F.substring(text, i * step + 1, F.lit(size)).alias("piece")))
    return F.filter(pieces, lambda p: F.length(p["piece"]) > least)


def packed_passages(text: Column, size: int = 1100, overlap: int = 150, least: int = 200, mark: str = "\n\n") -> Column:
    """The passages of a text in order: runs of paragraphs of at most size characters, those longer than least; an empty array for null.

    A run goes on while its paragraphs, with a blank line between, have no more than size characters. A paragraph longer than size
    starts a run of its own: windows of size that overlap are passages by themselves, and what is left after the last one opens the run.
    One fold over the paragraphs' lengths finds where runs start; texts are only cut then.
    """
    paragraphs = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), mark), strip), lambda p: p != "")
    step, blank = size - overlap, 2
    windows = lambda n: F.greatest(F.lit(0), F.ceil((n - size) / F.lit(step))).cast("int")
    start = F.struct(F.lit(0).alias("held"), F.array().cast("array<int>").alias("starts"), F.lit(0).alias("i"))

    def read(state: Column, p: Column) -> Column:
        n = F.length(p)
        goes_on = (state["held"] > 0) & (state["held"] + n + blank <= size)
        held = F.when(goes_on, state["held"] + n + blank).otherwise(n - windows(n) * step)
        return F.struct(held.cast("int").alias("held"), F.when(goes_on, state["starts"]).otherwise(F.concat(state["starts"], F.array(state["i"]))).alias("starts"), (state["i"] + 1).alias("i"))

    starts = F.aggregate(paragraphs, start, read, lambda state: state["starts"])

    def cut(at: Column, number: Column) -> Column:
        first = F.get(paragraphs, at)
        after = F.coalesce(F.get(starts, number + 1), F.size(paragraphs)) - at
        n = windows(F.length(first))
        whole = F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda w: F.substring(first, w * step + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))
        rest = F.array_join(F.concat(F.array(F.substring(first, n * step + 1, F.length(first))), F.slice(paragraphs, at + 2, F.greatest(after - 1, F.lit(0)))), "\n\n")
        return F.concat(whole, F.array(rest))

    return F.filter(F.flatten(F.transform(starts, cut)), lambda p: F.length(p) > least)


def passages(docs: DataFrame, key: str, text: str, *more: str, size: int = 1100, overlap: int = 150, least: int = 200, mark: str = "\n\n") -> DataFrame:
    """(key, more, pos, passage): each text's packed passages, numbered from 0; null and short texts have none."""
    return docs.select(key, *more, F.posexplode(packed_passages(F.col(text), size, overlap, least, mark)).alias("pos", "passage"))


def within_budget(ranked: DataFrame, query: str, text: str, budget: int, group: str | None = None, cap: int = 3, k: int = 30) -> DataFrame:
    """The passages that fit a budget of characters, taken down each query's ranking (column rank, unique in a query).

    A passage too long for what is left, or of a group that has cap already, is passed over, and later ones may still fit; null groups are a group, null texts have
    no length. Nothing is taken after k passages or once 97 % of the budget is used. A query's ranks and lengths are
    one row, which a fold goes through; cut rankings to a top-k first. Texts aren't collected. The column text can also hold the lengths, so that
    no text has to come through the joins before.
    """
    size = F.length(text) if isinstance(ranked.schema[text].dataType, StringType) else F.col(text)
    each = F.struct("rank", F.coalesce(size, F.lit(0)).alias("n"), (F.coalesce(F.col(group).cast("string"), F.lit("")) if group else F.col("rank").cast("string")).alias("g"))
    lists = ranked.groupBy(query).agg(F.array_sort(F.collect_list(each)).alias("xs"))
    taken = "array<struct<rank:bigint,g:string>>"
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast(taken).alias("taken"))

    def choose(state: Column, x: Column) -> Column:
        going = (F.size(state["taken"]) < k) & (state["used"] < budget * 0.97)
        fits = (state["used"] + x["n"] <= budget) & (F.size(F.filter(state["taken"], lambda y: y["g"] == x["g"])) < cap)
        more = F.concat(state["taken"], F.array(F.struct(x["rank"].cast("long").alias("rank"), x["g"].alias("g"))))
        return F.when(going & fits, F.struct((state["used"] + x["n"]).alias("used"), more.alias("taken"))).otherwise(state)

    chosen = lists.select(F.col(query), F.explode(F.aggregate("xs", start, choose, lambda state: F.transform(state["taken"], lambda y: y["rank"]))).alias("rank"))
    return ranked.join(chosen, [query, "rank"], "left_semi").select(*ranked.columns)


def word_by_positions(entries: DataFrame, key: str, word: str, positions: str) -> DataFrame:
    """(key, text): an inverted index (word, positions) back to text, words in order of position and then alphabet."""
    at = entries.select(key, F.col(word).alias("w"), F.explode(positions).alias("p"))
    return at.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "w"))), lambda x: x["w"]), " ").alias("text"))


def pattern_positions(docs: DataFrame, key: str, text: str, pattern: str) -> DataFrame:
    """(key, pos): where pattern matches in each text, from 0, by the lengths of the parts between and of the matches before."""
    cut = docs.filter(F.col(text).isNotNull()).select(key, F.split(text, pattern).alias("parts"), F.regexp_extract_all(F.col(text), F.lit(pattern), 0).alias("hits"))
    each = cut.filter(F.size("hits") > 0).select(key, F.posexplode(F.arrays_zip("parts", "hits")).alias("i", "x"))
    before = F.sum(F.length("x.parts") + F.coalesce(F.length("x.hits"), F.lit(0))).over(Window.partitionBy(key).orderBy("i"))
    return each.withColumn("pos", before - F.coalesce(F.length("x.hits"), F.lit(0))).filter("x.hits is not null").select(key, "pos")


def main_body(docs: DataFrame, key: str, text: str, number: str, heading: str, share: float = 0.3, window: int = 3000, least: int = 10, least_alone: int = 22) -> DataFrame:
    """(key, cut): the length of each text's main body, all of it where no reference list is found.

    The list starts at the first heading behind share of the text that least numbers follow within window characters, else at the first
    number that least_alone do. The count is a range window over the positions. Null texts are left out.
    """
    d = docs.filter(F.col(text).isNotNull()).select(key, F.length(text).alias("size"))
    marks = pattern_positions(docs, key, text, number).withColumn("is_number", F.lit(1)).unionByName(pattern_positions(docs, key, text, heading).withColumn("is_number", F.lit(0)))
    near = F.sum("is_number").over(Window.partitionBy(key).orderBy("pos").rangeBetween(0, window - 1))
    m = marks.withColumn("n", near).join(d, key).filter(F.col("pos") >= F.floor(F.col("size") * share))
    first = lambda kind, n: F.min(F.when((F.col("is_number") == kind) & (F.col("n") >= n), F.col("pos")))
    at = m.groupBy(key).agg(F.coalesce(first(0, least), first(1, least_alone)).alias("at"))
    return d.join(at, key, "left").select(key, F.coalesce("at", "size").cast("long").alias("cut"))
