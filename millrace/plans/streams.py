"""Queries that run a stream to its end and return what it wrote."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.plans.catalogue import register
from millrace.session import shared_dir, table
from millrace.streaming import incremental


def _as_files(spark: SparkSession, df: DataFrame, time: str, files: int, at: str) -> None:
    """Rows in files by range of time, so that a stream reads them in about their order and several batches."""
    df.repartitionByRange(files, time).write.parquet(at)


@register(
    "stream_windows",
    "SELECT date_trunc('hour', ts) AS start, event_type, CAST(count(*) AS BIGINT) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2",
)
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly counts and means by type over event time, from a stream of several files and batches. Windows are written once,
    when the watermark has passed them; a last row of no type moves it past all."""
    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    e = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    _as_files(spark, e, "ts", 4, f"{at}/in")
    last = e.agg((F.max("ts") + F.expr("interval 400 days")).alias("ts")).select("ts", F.lit(None).cast("string").alias("event_type"), F.lit(None).cast("double").alias("value"))
    out = incremental.windows_of_files(spark, f"{at}/in", last, "ts", "event_type", "value", f"{at}/out", f"{at}/check", late="366 days", files_a_batch=1)
    return out.where("event_type is not null").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("mean", 6).alias("mean"))


@register("stream_deduplicated", "SELECT DISTINCT event_id, event_type FROM events")
def stream_deduplicated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event delivered twice, in other files; each comes out once."""
    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    e = table(spark, sf_dir, "events").select("event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    for k in range(2):
        e.repartition(2 + k).write.mode("append").parquet(f"{at}/in")
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 2).parquet(f"{at}/in")
    once = incremental.deduplicated(stream, "event_id", "ts", "4000 days").select("event_id", "event_type")
    once.writeStream.outputMode("append").option("checkpointLocation", f"{at}/check").trigger(availableNow=True).format("parquet").start(f"{at}/out").awaitTermination()
    return spark.read.schema(once.schema).parquet(f"{at}/out")


@register("accumulated_groups", "WITH g AS (SELECT user_id, CAST(min(event_id % 4) AS INTEGER) AS first FROM events WHERE value > 20 GROUP BY user_id), k AS (SELECT user_id FROM g ORDER BY first, user_id LIMIT 5) SELECT event_id FROM events WHERE value > 20 AND user_id IN (SELECT user_id FROM k) AND event_id % 4 <= (SELECT min(b) FROM (SELECT b FROM (SELECT unnest(range(4)) AS b) WHERE (SELECT count(*) FROM g WHERE first <= b) >= 5))")
def accumulated_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filtered batches until there are five groups: the feature is the cut."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "value")
    batches = [e.where(F.col("event_id") % 4 == k) for k in range(4)]
    return incremental.accumulated(batches, lambda b: b.where("value > 20"), "user_id", 5, 4).select("event_id")


@register("stream_resume", "SELECT sample_id, line_num > 30 AS long_file FROM py_files WHERE line_num IS NOT NULL")
def stream_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The source files as a resumable stream: started, ended and started again, which adds nothing."""
    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    t = table(spark, sf_dir, "py_files").select("sample_id", "line_num")
    t.repartition(4).write.parquet(f"{at}/in")
    schema = "sample_id long, line_num int"
    for _ in range(2):
        incremental.resumable(spark, f"{at}/in", schema, lambda b: b.where("line_num is not null").select("sample_id", (F.col("line_num") > 30).alias("long_file")), f"{at}/out", f"{at}/check", 2).awaitTermination()
    return spark.read.parquet(f"{at}/out").select("sample_id", "long_file")
