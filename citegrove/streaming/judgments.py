"""Judgments as a stream: late and repeated verdicts dropped, and the latest of each item kept in a table. Beyond the reference."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from citegrove.operators.identity import upsert_latest

SCHEMA = "problem_id string, model string, condition string, ref_index int, judge string, run int, status string, judged_at timestamp"


def read_judgments(spark: SparkSession, folder: str, delay: str = "1 day") -> DataFrame:
    """Verdicts from JSON files as they arrive, each once within the delay."""
    s = spark.readStream.schema(SCHEMA).json(folder).withWatermark("judged_at", delay)
    return s.dropDuplicatesWithinWatermark(["problem_id", "model", "condition", "ref_index", "judge", "run", "status"])


def keep_latest(stream: DataFrame, table: str, checkpoint: str, key: list[str]) -> StreamingQuery:
    """Upserts each batch into the Parquet folders table/0, table/1, ... in turn; the highest number is the whole table, the one before is kept for a batch made again."""
    from pyspark.sql import functions as F

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.withColumn("key", F.concat_ws("\x1f", *key))
        if number:
            new = upsert_latest(spark.read.parquet(f"{table}/{number - 1}"), new, "key", "judged_at")
        else:
            cols = [c for c in new.columns if c != "key"]
            new = new.groupBy("key").agg(F.max_by(F.struct(*cols), "judged_at").alias("r")).select("key", "r.*")
        new.write.mode("overwrite").parquet(f"{table}/{number}")
        old = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{table}/{number - 2}")  # the last but one is no batch's input any more
        old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
