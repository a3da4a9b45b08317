"""Sinks: a folder a key, append with resume, rewriting upsert, top-up of passes, dataset and report files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from citegrove.operators.identity import missing_keys, upsert_latest


def write_by_key(df: DataFrame, path: str, key: str, fmt: str = "json") -> None:
    """One folder a value of key; rows of a key are brought together first, so that a key isn't spread over many small files."""
    df.repartition(F.col(key)).write.mode("overwrite").partitionBy(key).format(fmt).save(path)


def _old(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    there = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
    return spark.read.schema(schema).json(path) if there else None


def append_new(df: DataFrame, path: str, key: str) -> int:
    """Appends the rows whose key isn't there yet as JSON lines; gives their number."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    old = _old(df.sparkSession, path, schema)
    new = df if old is None else missing_keys(df, old, [key])
    seen = Observation()
    new.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("append").json(path)
    return seen.get["n"]


def upsert_file(new: DataFrame, path: str, key: str, version: str, to: str) -> None:
    """Old and new rows together at another path, the highest version of each key winning; the old path stays as it was."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in new.schema)
    old = _old(new.sparkSession, path, schema)
    (new if old is None else upsert_latest(old, new, key, version)).write.mode("overwrite").json(to)


def passes_to_run(kept: DataFrame, arms: DataFrame, k: int, same: list[str]) -> DataFrame:
    """(arm columns, run): the passes 0..k-1 that are still to be made; kept passes count if they agree in the columns same.

    kept: arm columns, run and same; arms: arm columns and same.
    """
    keys = [c for c in arms.columns if c not in same]
    wanted = arms.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    good = kept.join(arms, [*keys, *same], "left_semi").select(*keys, "run").distinct()
    return wanted.join(good, [*keys, "run"], "left_anti").select(*keys, "run")


def materialize(drafts: DataFrame) -> DataFrame:
    """(problem_id, claim, experiments, roles): the claims of drafts with the experiments that name them; claims with fewer than two are dropped.

    drafts: paper_id, claims array of (cid, claim), experiments array of (claims, role, text).
    """
    from citegrove.functions.text import problem_id

    c = drafts.select("paper_id", F.explode("claims").alias("c"))
    e = drafts.select("paper_id", F.posexplode("experiments").alias("pos", "e")).select("paper_id", "pos", "e.role", "e.text", F.explode("e.claims").alias("cid"))
    j = c.select("paper_id", "c.cid", "c.claim").join(e, ["paper_id", "cid"])
    g = j.groupBy("paper_id", "cid", "claim").agg(F.array_sort(F.collect_list(F.struct("pos", "role", "text"))).alias("x")).filter(F.size("x") >= 2)
    return g.select(problem_id(F.col("paper_id"), F.col("cid")).alias("problem_id"), "claim", F.transform("x", lambda x: x["text"]).alias("experiments"), F.transform("x", lambda x: x["role"]).alias("roles"))


def report_table(df: DataFrame, columns: list[str]) -> str:
    """A small report as a Markdown table; numbers with three digits."""
    head = f"| {' | '.join(columns)} |\n|{'---|' * len(columns)}"
    show = lambda v: "–" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v)
    return "\n".join([head, *(f"| {' | '.join(show(r[c]) for c in columns)} |" for r in df.select(*columns).toLocalIterator())])
