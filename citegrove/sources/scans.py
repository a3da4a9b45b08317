"""Scans of JSON lines, JSON documents and judgment folders, with their key rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citegrove.schemas import ARM, JUDGMENT, TRACE

#: Older names of arms in files without an arms map.
ARM_ALIASES = {"nocard": ["no_card", "baseline"], "card": ["with_card", "norm_card"], "rag": ["retrieved"]}


def keyed(df: DataFrame, key: str, keep: str) -> DataFrame:
    """One row a key by place in the file: keep is 'first' or 'last'. df carries _seq; rows of a null key are dropped."""
    pick = F.max_by if keep == "last" else F.min_by
    cols = [c for c in df.columns if c not in (key, "_seq")]
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(pick(F.struct(*cols), "_seq").alias("r")).select(key, "r.*")


def scan_jsonl(spark: SparkSession, path: str, schema: str, key: str | None = None, keep: str = "last") -> DataFrame:
    """Rows of JSON lines; blank lines are skipped and a line that isn't JSON fails. With key, one row a key, the last or first line winning.

    The place of a line is its file, block and offset, not the order in which partitions are read.
    """
    df = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    if key is None:
        return df
    seq = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    return keyed(df.withColumn("_seq", seq), key, keep)


def scan_documents(spark: SparkSession, glob: str, schema: str) -> DataFrame:
    """One row a JSON document, with the name of its folder as folder; a missing path fails."""
    df = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(glob)
    return df.withColumn("folder", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2))


def scan_judgments(spark: SparkSession, root: str) -> DataFrame:
    """A row for each verdict of each run in root/problem_*/*.json; files whose names start with _ and trace files are skipped."""
    df = spark.read.schema(JUDGMENT).option("multiLine", True).json(f"{root}/problem_*/*.json")
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    rows = df.withColumn("file", name).filter(~name.startswith("_") & ~name.contains(".trace")).select("problem_id", "arm", "file", F.posexplode("runs").alias("run", "r"))
    return rows.select("problem_id", "arm", "file", "run", F.col("r.decision_sufficiency").alias("sufficiency"), F.explode("r.reference_coverage").alias("c")).select("problem_id", "arm", "file", "run", "sufficiency", "c.*")


def countable(verdicts: DataFrame, proposals: DataFrame, least_arms: int) -> DataFrame:
    """Verdicts of arms with proposals, of models with least_arms arms at least. proposals: problem_id, arm, model, n_proposed."""
    real = proposals.filter("n_proposed > 0")
    models = real.groupBy("model").agg(F.countDistinct("problem_id", "arm").alias("n")).filter(F.col("n") >= least_arms).select("model")
    return verdicts.join(real.join(models, "model", "left_semi").select("problem_id", "arm").distinct(), ["problem_id", "arm"], "left_semi")


def explode_arms(proposals: DataFrame) -> DataFrame:
    """(problem_id, arm, fields of the arm): from the arms map, else from older columns named for an arm."""
    new = proposals.filter(F.size("arms") > 0).select("problem_id", F.explode("arms").alias("arm", "a")).select("problem_id", "arm", "a.*")
    for arm, names in ARM_ALIASES.items():
        for n in (arm, *names):
            if n in proposals.columns:
                old = proposals.filter(F.coalesce(F.size("arms"), F.lit(0)) <= 0).filter(F.col(n).isNotNull())
                new = new.unionByName(old.select("problem_id", F.lit(arm).alias("arm"), f"{n}.*"), allowMissingColumns=True)
    return new


def load_arm(proposals: DataFrame, arm: str) -> DataFrame:
    """The rows of one arm; problems without it fail with the list of what they have."""
    rows = explode_arms(proposals)
    have = rows.groupBy("problem_id").agg(F.array_sort(F.collect_set("arm")).alias("have"))
    j = have.join(rows.filter(F.col("arm") == arm), "problem_id", "left")
    missing = F.raise_error(F.concat(F.lit(f"no arm {arm} in "), "problem_id", F.lit("; it has "), F.array_join("have", ", "))).cast("string")
    return j.withColumn("problem_id", F.when(F.col("arm").isNotNull(), F.col("problem_id")).otherwise(missing)).drop("have")


def arms_available(proposals: DataFrame) -> DataFrame:
    return explode_arms(proposals).groupBy("problem_id").agg(F.array_sort(F.collect_set("arm")).alias("arms"))


def scan_traces(spark: SparkSession, path: str) -> DataFrame:
    """Events of append-only traces; a line cut off in writing is a row of nulls and is dropped."""
    return spark.read.schema(TRACE).json(path).filter("type is not null")


def arm_schema() -> str:
    return f"problem_id string, arms map<string,struct<{', '.join(c.strip().replace(' ', ': ', 1) for c in ARM.split(','))}>>"


def pdf_columns(words: DataFrame) -> DataFrame:
    """(doc, page, two_columns): a page has two if at most 3 % of its words cross the middle and each half has over 20 % of them.

    words: doc, page, x0, x1 of each word's box and the page's width.
    """
    mid = F.col("width") / 2
    g = words.groupBy("doc", "page").agg(
        F.avg(((F.col("x0") < mid) & (F.col("x1") > mid)).cast("double")).alias("cross"), F.avg((F.col("x1") <= mid).cast("double")).alias("left"), F.avg((F.col("x0") >= mid).cast("double")).alias("right")
    )
    return g.select("doc", "page", ((F.col("cross") <= 0.03) & (F.col("left") > 0.2) & (F.col("right") > 0.2)).alias("two_columns"))


def is_pdf(content: Column, content_type: Column) -> Column:
    """Whether bytes are a PDF, by their type or first four bytes."""
    return F.coalesce(content_type.contains("pdf"), F.lit(False)) | F.coalesce(F.substring(content, 1, 4) == F.lit(b"%PDF"), F.lit(False))


def cache_misses(wanted: DataFrame, cache: DataFrame, key: list[str]) -> DataFrame:
    """Wanted rows that the cache has neither as a hit nor as a known miss."""
    return wanted.join(cache.select(*key).distinct(), key, "left_anti")


def cached_text(wanted: DataFrame, cache: DataFrame, key: list[str], least: int) -> DataFrame:
    """wanted with the cached text, where it is a hit of least characters or more."""
    hits = cache.filter((F.col("status") == "hit") & (F.length("text") >= least)).groupBy(*key).agg(F.max("text").alias("text"))
    return wanted.join(hits, key, "left")
