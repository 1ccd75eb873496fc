"""Incremental runs on Structured Streaming: resumable batches, accumulation to a batch size, windowed metrics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def resumable(spark: SparkSession, source: str, schema: str, work: Callable[[DataFrame], DataFrame], target: str, checkpoint: str, files_a_batch: int | None = None) -> StreamingQuery:
    """Runs `work` on every new file of a folder, once: the checkpoint remembers the files, and a batch that is repeated
    after a failure replaces its own output, which lies in a folder of its batch. Ends when no new file is left."""
    reader = spark.readStream.schema(schema)
    if files_a_batch:
        reader = reader.option("maxFilesPerTrigger", files_a_batch)

    def each(batch: DataFrame, number: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return reader.parquet(source).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def accumulated(batches: list[DataFrame], keep: Callable[[DataFrame], DataFrame], group: str, wanted: int, most: int) -> DataFrame:
    """Filtered batches, one after another, until `wanted` groups are there or `most` batches are used; then the rows of the
    first `wanted` groups, by batch and group. Too few groups at the end are an error."""
    got: DataFrame | None = None
    for n, batch in enumerate(batches[:most]):
        kept = keep(batch).withColumn("_batch", F.lit(n))
        got = kept if got is None else got.unionByName(kept)
        groups = got.groupBy(group).agg(F.min("_batch").alias("_first"))
        if groups.count() >= wanted:
            first = groups.orderBy("_first", group).limit(wanted).select(group)
            return got.join(first, group, "left_semi").drop("_batch")
    raise ValueError(f"fewer than {wanted} groups in {min(most, len(batches))} batches")


def windowed_metrics(events: DataFrame, time: str, key: str, value: str, window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Count and mean of a value by key and tumbling window of event time; rows later than `late` are left out."""
    if not any("spark.watermarkDelayMs" in f.metadata for f in events.schema):  # a watermark can't be set twice
        events = events.withWatermark(time, late)
    return events.groupBy(F.window(time, window), key).agg(F.count("*").alias("n"), F.avg(value).alias("mean")).select(F.col("window.start").alias("start"), key, "n", "mean")


def windows_of_files(spark: SparkSession, source: str, last: DataFrame, time: str, key: str, value: str, target: str, checkpoint: str, late: str, window: str = "1 hour", files_a_batch: int = 1) -> DataFrame:
    """windowed_metrics over a folder of files, in batches; windows are appended once the watermark has passed them. `last`, rows
    that are later than all by more than `late`, is added to the folder when the stream has read the rest, so that every window
    closes; a second run goes on where the first ended."""
    schema = spark.read.parquet(source).schema
    for more in (None, last):
        if more is not None:
            more.write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(source)
        made = windowed_metrics(stream, time, key, value, window, late)
        made.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(target).awaitTermination()
    return spark.read.schema(made.schema).parquet(target)


def deduplicated(rows: DataFrame, key: str, time: str, late: str = "2 days") -> DataFrame:
    """Each key once, within the watermark: rows that are delivered again are dropped."""
    return rows.withWatermark(time, late).dropDuplicatesWithinWatermark([key])
