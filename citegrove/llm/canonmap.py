"""Freely typed names to the entries of a reference list: symmetric-delete lookup, weighted edit distance, misses reported."""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citegrove.llm.dictionary import encode
from citegrove.plans.materialize import settle, ship, spread

#: Entries up to which the delete dictionary is broadcast; a longer list is joined by its deletes.
BROADCAST_ENTRIES = 20_000
#: Most splits of a list too long to broadcast.
MOST_SPLITS = 20_000
#: Edits between a typed stem and the stem meant; fewer for short stems.
EDITS = 2
SHORT = 5
#: Deletes are made of so many first characters.
PREFIX = 10
#: Costs of edits: two neighbours swapped, a letter doubled or halved, a letter more or less, another letter; more on the first letter.
SWAP, DOUBLE, INDEL, OTHER, FIRST = 0.7, 0.6, 0.9, 1.0, 0.3
#: Words that a typed name may carry besides the name, by kind; "" holds for all.
CARRIED = {
    "": {"the", "a", "an", "our"},
    "dataset": {"dataset", "datasets", "data", "corpus", "benchmark"},
    "model": {"model", "models", "checkpoint", "chat", "instruct", "base"},
    "metric": {"metric", "metrics"},
    "baseline": {"method", "baseline", "approach"},
}
_SIZE = re.compile(r"(?<![a-z0-9.])\d+(?:\.\d+)?(?:x\d+)?\s?[bm](?![a-z0-9])")
_VERSION = re.compile(r"(?:[\s_-]v(?:ersion)?[\s_.-]?|[\s_-]|(?<=[a-z]))(\d+(?:\.\d+)?)\s*$")
_DASHES = re.compile("[‐-―−_]")


def distance(a: str, b: str, most: float) -> float:
    """Weighted Damerau-Levenshtein distance (swaps of neighbours not edited again), or inf beyond most."""
    if abs(len(a) - len(b)) > most / min(SWAP, DOUBLE, INDEL):
        return float("inf")
    before, last = None, [0.0]
    for j in range(len(b)):
        last.append(last[-1] + (DOUBLE if j and b[j] == b[j - 1] else INDEL) + (FIRST if j == 0 else 0))
    for i, x in enumerate(a):
        first = FIRST if i == 0 else 0.0
        now = [last[0] + (DOUBLE if i and x == a[i - 1] else INDEL) + first]
        for j, y in enumerate(b):
            cost = min(
                last[j] + (0 if x == y else OTHER + (FIRST if i == 0 and j == 0 else 0)),
                last[j + 1] + (DOUBLE if i and x == a[i - 1] else INDEL) + first,
                now[j] + (DOUBLE if j and y == b[j - 1] else INDEL) + (FIRST if j == 0 else 0),
            )
            if i and j and x == b[j - 1] and a[i - 1] == y:
                cost = min(cost, before[j - 1] + SWAP)
            now.append(cost)
        before, last = last, now
        if min(now) > most:
            return float("inf")
    return last[-1] if last[-1] <= most else float("inf")


def edits_allowed(stem: str) -> int:
    return 0 if len(stem) < 4 else 1 if len(stem) < SHORT + 1 else EDITS


def deletes(stem: str, most: int = EDITS) -> set[str]:
    """The first PREFIX characters of stem with up to most of them left out."""
    p = stem[:PREFIX]
    return {"".join(c for i, c in enumerate(p) if i not in gone) for k in range(most + 1) for gone in combinations(range(len(p)), min(k, len(p)))}


def plain(text: str) -> str:
    s = unicodedata.normalize("NFKC", text).casefold()
    return " ".join(_DASHES.sub("-", s).split())


def squash(text: str) -> str:
    return re.sub(r"[^a-z0-9]+", "", text)


class Book:
    """The reference list, by kind: exact names, short forms, and the deletes of stems.

    A name is read as stem, version (a number at the end) and split (a part after the last hyphen that several entries share or
    that an entry also has without). Versions and splits must agree exactly; only the stem may be typed wrongly. A book of a part
    of the list is given the splits of the whole.
    """

    def __init__(self, entries: list[tuple[int, str, str, str | None]], frequency: dict[int, int] | None = None, splits: dict[str, set[str]] | None = None) -> None:
        self.frequency = frequency or {}
        self.splits: dict[str, set[str]] = defaultdict(set)
        self.short: dict[tuple[str, str], list[int]] = defaultdict(list)
        self.exact: dict[tuple[str, str, str, str], list[int]] = defaultdict(list)
        self.stems: dict[tuple[str, str], set[str]] = defaultdict(set)
        names = defaultdict(set)
        for _, kind, name, _ in entries:
            names[kind].add(plain(name))
        for kind, all_names in names.items():
            ends = defaultdict(set)
            for n in all_names:
                base, dash, end = n.rpartition("-")
                if dash and re.fullmatch("[a-z]{1,8}", end):
                    ends[end].add(base)
            self.splits[kind] = {e for e, bases in ends.items() if len(bases) > 1 or bases & all_names}
        if splits is not None:
            self.splits = splits
        for entry, kind, name, short in sorted(entries):
            for key in self.read(kind, plain(name), own=True)[:1]:
                self.exact[(kind, *key)].append(entry)
                for d in deletes(key[0]):
                    self.stems[(kind, d)].add(key[0])
            if short and short.strip():
                self.short[(kind, squash(plain(short)))].append(entry)

    def read(self, kind: str, text: str, own: bool = False) -> list[tuple[str, str, str]]:
        """(stem, version, split) readings of a plain text, the likeliest first."""
        s = text.strip(" .,;:!?\"'“”‘’*`")
        out = []
        carried = CARRIED[""] | CARRIED.get(kind, set())
        bare = s if own else " ".join(w for w in re.split(r"\s+", s) if w.strip(".,;") not in carried)
        for t in dict.fromkeys((bare, s)):
            version = split = ""
            if kind == "model":
                if not own:
                    t = _SIZE.sub(" ", t)
                    t = re.sub(r"(?:[\s-]+(?:" + "|".join(CARRIED["model"]) + r"))+\s*$", "", re.sub(r"[\s-]+$", "", t))
                    t = re.sub(r"[\s-]+$", "", t)
                if m := _VERSION.search(t):
                    version, t = m[1], t[: m.start()]
            elif self.splits.get(kind):
                head, sep, end = re.match(r"(.*?)([\s-]*)([^\s-]*)$", t.strip(), re.S).groups()
                if sep and head:
                    if end in self.splits[kind]:
                        split, t = end, head
                    elif near := [x for x in self.splits[kind] if len(x) >= 4 and abs(len(end) - len(x)) <= 1 and distance(end, x, 1.3) <= 1.3 or sorted(x) == sorted(end)]:
                        split, t = min(near), head
            if q := squash(t):
                out.append((q, version, split))
        return list(dict.fromkeys(out))

    def nearest(self, kind: str, reading: tuple[str, str, str]) -> tuple[float, int] | None:
        """Distance and entry of the stem nearest to a reading's among entries of its version and split."""
        stem, version, split = reading
        if hit := self.exact.get((kind, stem, version, split)):
            return 0.0, self.best(hit)
        most = edits_allowed(stem)
        found = set()
        for d in deletes(stem, most):
            found |= self.stems.get((kind, d), set())
        ranked = []
        for s in found:
            if abs(len(s) - len(stem)) <= most and (hit := self.exact.get((kind, s, version, split))):
                w = distance(stem, s, most + FIRST)
                if w <= most + FIRST:
                    e = self.best(hit)
                    ranked.append((w, -self.frequency.get(e, 0), e))
        return (min(ranked)[0], min(ranked)[2]) if ranked else None

    def best(self, entries: list[int]) -> int:
        return min(entries, key=lambda e: (-self.frequency.get(e, 0), e))

    def resolve(self, kind: str, text: str) -> int:
        """The entry meant, 0 for none."""
        p = plain(text)
        segments = [x for x in re.split(r"[()\[\]{}:@]", p) if x.strip()]
        found = []
        for i, seg in enumerate(segments):
            for reading in self.read(kind, seg):
                if hit := self.nearest(kind, reading):
                    found.append((hit[0], i, hit[1]))
        for i, seg in enumerate(segments):
            for reading in self.read(kind, seg):
                if short := self.short.get((kind, "".join(reading))):
                    found.append((0.0 if not found else 9.0, i, self.best(short)))
        return min(found)[2] if found else 0

    def is_exact(self, kind: str, text: str) -> int:
        """The entry whose name or short form the text is, apart from case and separators; 0 for none."""
        q = plain(text)
        for key in self.read(kind, q, own=True)[:1]:
            if hit := self.exact.get((kind, *key)):
                return min(hit)
        hit = self.short.get((kind, squash(q)))
        return min(hit) if hit else 0


def map_values(values: DataFrame, entries: DataFrame) -> DataFrame:
    """values (kind, value, and any others) with entry_id, the entry of that kind that the value means, 0 for none.

    entries: entry_id (from 1), kind, name, short_form (may be null). Null and blank values and unknown kinds map to 0. Ties go
    to the entry more often typed exactly, then to the smaller id. An empty list of entries maps all to 0.

    An entry_id that values already has is replaced. Each distinct value is looked up once: broadcast to every task is the delete dictionary of the list, after a check of the
    list's length (BROADCAST_ENTRIES); of a longer list each task gets the entries that its own values' deletes meet, with equal results.
    Such a list may have MOST_SPLITS splits, else an error is raised.
    """
    spark, values = values.sparkSession, values.drop("entry_id")
    ship(spark)
    counted = settle(values.filter("value is not null and kind is not null").groupBy("kind", "value").agg(F.count(F.lit(1)).alias("n")))
    listed = entries.select("entry_id", "kind", "name", "short_form").filter("entry_id is not null and kind is not null and name is not null")
    n_entries = listed.count()
    if n_entries > BROADCAST_ENTRIES:
        mapped = _map_by_join(counted, listed)
    else:
        rows = [tuple(r) for r in listed.collect()]  # at most BROADCAST_ENTRIES
        plain_book = spark.sparkContext.broadcast(rows)

        def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            book = Book(plain_book.value)
            for b in batches:
                kinds, texts, n = (c.to_pylist() for c in b.columns)
                yield pa.RecordBatch.from_arrays([pa.array([book.is_exact(k, t) for k, t in zip(kinds, texts, strict=True)], pa.int64()), pa.array(n, pa.int64())], names=["entry_id", "n"])

        even = spread(counted, "kind", "value")
        seen = even.select("kind", "value", "n").mapInArrow(exact, "entry_id long, n long").filter("entry_id > 0")
        frequency = {r["entry_id"]: r["n"] for r in seen.groupBy("entry_id").agg(F.sum("n").alias("n")).collect()}  # a row an entry
        all_of_it = spark.sparkContext.broadcast((rows, frequency))

        def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            book = Book(*all_of_it.value)
            for b in batches:
                kinds, texts = (c.to_pylist() for c in b.columns)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([book.resolve(k, t) for k, t in zip(kinds, texts, strict=True)], pa.int64())], names=["kind", "value", "entry_id"])

        mapped = even.select("kind", "value").mapInArrow(look_up, "kind string, value string, entry_id long")
    book = settle(mapped.join(counted, ["kind", "value"]).filter("entry_id > 0"))
    known = encode(values.filter("value is not null and kind is not null"), book, ["kind", "value"], counted.groupBy().agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"])
    unknown = values.join(book.select("kind", "value"), ["kind", "value"], "left_anti").withColumn("entry_id", F.lit(0).cast("long"))
    return known.unionByName(unknown)


def _splits(listed: DataFrame) -> dict[str, set[str]]:
    """The splits of the whole list, by kind, as Book has them."""
    names = settle(listed.select("kind", F.udf(plain, "string", useArrow=True)("name").alias("name")).distinct())
    part = lambda i: F.regexp_extract("name", "(?s)^(.*)-([a-z]{1,8})$", i)
    ends = names.select("kind", part(1).alias("base"), part(2).alias("end")).filter("end <> ''")
    shared = ends.groupBy("kind", "end").agg(F.countDistinct("base").alias("n")).filter("n > 1").select("kind", "end")
    also_without = ends.join(names.select("kind", F.col("name").alias("base")), ["kind", "base"], "left_semi").select("kind", "end")
    rows = shared.union(also_without).distinct().limit(MOST_SPLITS + 1).collect()
    if len(rows) > MOST_SPLITS:
        raise ValueError(f"more than {MOST_SPLITS} splits in the list of entries")
    splits = defaultdict(set)
    for kind, end in rows:
        splits[kind].add(end)
    return dict(splits)


def _map_by_join(counted: DataFrame, listed: DataFrame) -> DataFrame:
    """Look-up against a list too long to broadcast: each value meets the entries that Book would find for one of its readings, task by task."""
    splits = counted.sparkSession.sparkContext.broadcast(_splits(listed))
    sep = "\x1f"  # in no key, since squashed texts, versions and splits have none

    @F.udf("array<string>", useArrow=True)
    def own_keys(kind: str, name: str, short: str | None) -> list[str]:
        keys = set()
        for stem, version, split in Book([], splits=splits.value).read(kind, plain(name), own=True)[:1]:
            keys |= {sep.join((d, version, split)) for d in deletes(stem)}
        return sorted(keys | ({squash(plain(short))} if short and short.strip() else set()))

    @F.udf("array<string>", useArrow=True)
    def typed_keys(kind: str, text: str) -> list[str]:
        keys, book = set(), Book([], splits=splits.value)
        for segment in re.split(r"[()\[\]{}:@]", plain(text)):
            for stem, version, split in book.read(kind, segment):
                keys |= {sep.join((d, version, split)) for d in deletes(stem, edits_allowed(stem))} | {stem + version + split}
        return sorted(keys)

    @F.udf("string", useArrow=True)
    def exact_key(kind: str, text: str) -> str | None:
        return next((sep.join(key) for key in Book([], splits=splits.value).read(kind, plain(text), own=True)[:1]), None)

    short_key = F.udf(lambda text: squash(plain(text)), "string", useArrow=True)
    own_short = F.udf(lambda short: squash(plain(short)) if short and short.strip() else None, "string", useArrow=True)
    by_name = listed.select("kind", exact_key("kind", "name").alias("k"), "entry_id").groupBy("kind", "k").agg(F.min("entry_id").alias("by_name"))
    by_short = listed.select("kind", own_short("short_form").alias("s"), "entry_id").groupBy("kind", "s").agg(F.min("entry_id").alias("by_short"))
    seen = counted.select("kind", "n", exact_key("kind", "value").alias("k"), short_key("value").alias("s")).join(by_name, ["kind", "k"], "left").join(by_short, ["kind", "s"], "left")
    frequency = seen.groupBy(F.coalesce("by_name", "by_short").alias("entry_id")).agg(F.sum("n").alias("n")).filter("entry_id is not null")

    names = listed.join(frequency, "entry_id", "left").select("entry_id", "kind", "name", "short_form", F.coalesce("n", F.lit(0)).alias("n"), F.explode(own_keys("kind", "name", "short_form")).alias("d"))
    typed = counted.select("kind", "value", F.explode(typed_keys("kind", "value")).alias("d"))
    met = typed.join(names, ["kind", "d"]).select("kind", "value", "entry_id", "name", "short_form", "n").distinct()
    groups = met.groupBy("kind", "value").agg(F.collect_list(F.struct("entry_id", "kind", "name", "short_form", "n")).alias("near"))

    @F.udf("long", useArrow=True)
    def choose(kind: str, value: str, near: list) -> int:
        return Book([tuple(r)[:4] for r in near], {r[0]: r[4] for r in near}, splits.value).resolve(kind, value)

    return groups.select("kind", "value", choose("kind", "value", "near").alias("entry_id"))


def typed_names(items: DataFrame) -> DataFrame:
    """(item_id, pos, kind, value) of resource items: pos 0 the name, 1, 2, ... the variants; null and blank values are left out."""
    kinds = F.create_map(*(F.lit(x) for pair in (("datasets", "dataset"), ("models", "model"), ("metrics", "metric"), ("baselines", "baseline")) for x in pair))
    all_names = F.concat(F.array("name"), F.coalesce("variants", F.array().cast("array<string>")))
    return (
        items.filter(F.col("key").isin("datasets", "models", "metrics", "baselines"))
        .select("item_id", kinds[F.col("key")].alias("kind"), F.posexplode(all_names).alias("pos", "value"))
        .filter(F.col("value").isNotNull() & F.col("value").rlike(r"[^\s\p{Z}]"))
    )
