"""Structured Streaming forms of the one-pass counts and of deduplication."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ctilake.functions import text as X
from ctilake.sources.tables import checkpoint_dir, table


def daily_counts(events: DataFrame) -> DataFrame:
    """Events and their value by day and type; works on a batch and on a stream."""
    day = F.window("ts", "1 day")
    return events.groupBy(day.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("cents")).select(F.to_date("w.start").alias("day"), "event_type", "n", "cents")


def first_seen(posts: DataFrame, time: str, text: str, delay: str = "7 days") -> DataFrame:
    """First row of every text of a stream. State is kept for ``delay`` behind the watermark and not forever."""
    return posts.withColumn("fp", X.fingerprint(F.coalesce(F.col(text), F.lit("")))).withWatermark(time, delay).dropDuplicatesWithinWatermark(["fp"])


def run_to_table(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Run a stream over what its source holds now and return the table it wrote, in the shared checkpoint folder.

    A batch writes a folder of its own number, so one that is run again replaces what it wrote before.
    """
    spark = stream.sparkSession
    where = f"{checkpoint_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    folder = lambda i: f"{where}/out" if mode == "complete" else f"{where}/out/batch={i}"
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{where}/state").foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(folder(i))).trigger(availableNow=True).start()
    query.awaitTermination()
    out = spark.read.parquet(f"{where}/out")
    return out.drop("batch") if mode != "complete" else out


def event_time(posts: DataFrame, time: str, fetched: str) -> DataFrame:
    """``posts`` with ``event_time``: the written time, else the time of the fetch."""
    return posts.withColumn("event_time", F.coalesce(X.iso_timestamp(F.col(time)), X.iso_timestamp(F.col(fetched))))


def first_texts_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of the posts' texts, each once, from a stream with bounded state; its event time is the time of loading."""
    schema = table(spark, sf_dir, "forum_posts").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(f"{sf_dir}/forum_posts.parquet")
    seen = first_seen(stream.withColumn("loaded_at", F.col("loaded_at").cast("timestamp")).filter("text is not null"), "loaded_at", "text", "365 days")
    return run_to_table(seen.select("fp"), "append")


def fetched_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw posts by day of their event time, that of the fetch where none is written."""
    rows = event_time(table(spark, sf_dir, "raw_posts"), "timestamp", "scraped_at")
    return rows.groupBy(F.date_format("event_time", "yyyy").alias("year")).agg(F.count(F.lit(1)).alias("n"), F.count_if(X.iso_timestamp(F.col("timestamp")).isNotNull()).alias("written"))


def events_daily_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily counts of the events, as a batch."""
    return daily_counts(table(spark, sf_dir, "events"))


def events_daily_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same counts from a stream over the same files, with a watermark of a day."""
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(f"{sf_dir}/events.parquet")
    stream = stream.withColumn("ts", F.col("ts").cast("timestamp"))  # event time needs an instant
    return run_to_table(daily_counts(stream.withWatermark("ts", "1 day")))
