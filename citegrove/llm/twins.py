"""Duplicates hidden by formatting differences: dictionary-encoded records grouped as integer tuples."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citegrove.llm.dictionary import encode
from citegrove.plans.materialize import settle, ship

#: Literal two-character escapes that count as white space.
ESCAPES = r"\\[nrt]"


def fold_text(s: str) -> str:
    """NFC, case folded, letters, marks and digits only."""
    s = unicodedata.normalize("NFC", unicodedata.normalize("NFC", s).casefold())
    return "".join(c for c in s if unicodedata.category(c)[0] in "LMN")


def canonical(value: Column) -> Column:
    """What a value says apart from formatting, '' for null.

    White space (also as a literal escape), letter case, punctuation and the encoding of a character don't matter.
    ASCII stays in the JVM; only other values cross to Python.
    """

    @F.pandas_udf("string")
    def fold(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else fold_text(x), na_action="ignore")

    v = F.regexp_replace(value, ESCAPES, " ")
    ascii_only = ~v.rlike(r"[^\x00-\x7F]")
    native = F.when(ascii_only, F.regexp_replace(F.lower(v), "[^a-z0-9]+", ""))
    return F.coalesce(native, fold(F.when(~ascii_only, v)), F.lit(""))


def labelled_values(record: Column) -> Column:
    """The (label, value) pairs of a labelled record, in JSON or as 'label: value' or 'label=value' parted by |, ; or new lines.

    Labels lose case, blanks, _ and -. A null or unreadable record has no pairs.
    """
    label = lambda k: F.regexp_replace(F.lower(k), "[^a-z0-9]+", "")
    as_json = F.transform(F.map_entries(F.from_json(record, "map<string,string>")), lambda e: F.struct(label(e["key"]).alias("label"), e["value"].alias("value")))
    parts = F.split(record, r"[ \t]*[|;\n\r]\s*(?=[A-Za-z][A-Za-z _-]{0,40}[:=])")
    pairs = F.transform(
        parts,
        lambda p: F.struct(
            label(F.substring_index(F.translate(p, "=", ":"), ":", 1)).alias("label"),
            F.substring(p, F.length(F.substring_index(F.translate(p, "=", ":"), ":", 1)) + 2, F.length(p)).alias("value"),
        ),
    )
    return F.when(F.ltrim(record).startswith("{"), as_json).otherwise(pairs)


def collapse_copies(df: DataFrame, key: str, record: Column, required: str) -> DataFrame:
    """One row per record with its number of copies: (key, n_copies), key being the smallest of the copies.

    record: array of (label, value) structs, what a row consists of. Two rows are copies if the sets of their labelled values
    are equal in canonical form. A null, an empty and an absent value are one. Rows whose required label has no letter or
    digit are left out. df may have any other columns; an empty df gives no rows. key must be unique and not null.

    Records are parsed once and written as (key, label, value) rows. Each distinct raw value is canonicalised once and each canonical value of a label gets an integer; a record becomes the
    sorted tuple of its values' integers, and the tuples are grouped with partial counts. Values held by many rows meet
    the dictionary by broadcast, their number being bounded by their share, all others by a shuffle join, so no value makes a
    hot partition.
    """
    ship(df.sparkSession)
    long = settle(
        df.select(F.col(key).alias("_key"), F.explode(record).alias("x"))
        .select("_key", F.col("x.label").alias("label"), F.col("x.value").alias("raw"))
        .filter("raw is not null and raw <> ''")
    )
    values = long.groupBy("label", "raw").agg(F.count(F.lit(1)).alias("n")).withColumn("value", canonical(F.col("raw")))
    values = settle(values.filter("value <> ''").withColumn("rid", F.monotonically_increasing_id()))
    book = values.join(values.groupBy("label", "value").agg(F.min("rid").alias("id")), ["label", "value"]).select("label", "raw", "n", "id")
    rows = values.filter(F.col("label") == required).groupBy().agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).first()["rows"]
    ids = encode(long, book, ["label", "raw"], rows).select("_key", "label", "id")
    tuples = ids.groupBy("_key").agg(F.array_sort(F.collect_set("id")).alias("record"), F.max(F.col("label") == required).alias("whole"))
    return tuples.filter("whole").groupBy("record").agg(F.min("_key").alias(key), F.count(F.lit(1)).alias("n_copies")).select(key, "n_copies")


def paper_hit_record() -> Column:
    """Title, first author, year and venue of a row of paper_hit."""
    kept = F.filter(labelled_values(F.col("record")), lambda e: e["label"].isin("firstauthor", "year", "venue"))
    title = F.array(F.struct(F.lit("title").alias("label"), F.col("title").alias("value")))
    return F.concat(title, F.coalesce(kept, F.array().cast("array<struct<label:string,value:string>>")))
