"""Counts kept by a stream and summed on read.

What a batch says is written under its batch id: the buckets it changed, or its own
increments. A batch that runs again replaces its part, and nothing else is touched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKET = "30 minutes"


def country_buckets(tagged: DataFrame, time: str = "created_at", lateness: str = "48 hours") -> DataFrame:
    """Articles per country and half hour.

    A bucket holds the rows after its start up to its end, so that whole buckets
    make up the window that excludes its own start. Tumbling counts: a 48-hour sliding window would copy every row 96 times. The
    count is combined before the shuffle, so a country with a third of all rows
    sends one row per task and bucket.
    """
    return (
        tagged.where("country_code is not null")
        .withColumn("_tick", F.col(time) - F.expr("INTERVAL 1 MICROSECOND"))
        .withWatermark("_tick", lateness)
        .groupBy(F.window("_tick", BUCKET).alias("bucket"), "country_code")
        .agg(F.count("*").alias("news_count"))
        .select(F.col("bucket.start").alias("bucket_start"), "country_code", "news_count")
    )


def rolling_country_counts(buckets: DataFrame, as_of: Column, hours: int = 48) -> DataFrame:
    """Sum of the buckets of the window; ``as_of`` lies on a bucket boundary."""
    edge = as_of - F.make_interval(hours=F.lit(hours))
    inside = (F.col("bucket_start") >= edge) & (F.col("bucket_start") < as_of)
    return buckets.where(inside).groupBy("country_code").agg(F.sum("news_count").alias("news_count"))


def source_days(news: DataFrame, time: str = "created_at") -> DataFrame:
    """Articles, and last time, per source and day of one batch; batches are added up on read.

    Without a watermark: a total of all time counts a row however late it comes.
    """
    named = news.where("source_id is not null")
    return named.groupBy("source_id", F.date_trunc("day", F.col(time)).alias("day")).agg(F.count("*").alias("rows"), F.max(time).alias("last"))


def source_stats_on_read(days: DataFrame) -> DataFrame:
    """Statistics per source from the increments of all batches, which may name a day several times."""
    daily = days.groupBy("source_id", "day").agg(F.sum("rows").alias("rows"), F.max("last").alias("last"))
    return daily.groupBy("source_id").agg(
        F.sum("rows").alias("total_news"),
        F.max_by("rows", "day").alias("today_news"),
        F.max("last").alias("last_publish_time"),
    )


def _write_batch(path: str, make=None):
    """A ``foreachBatch`` function that writes a batch, or what ``make`` gives for it, under its id."""

    def run(batch: DataFrame, batch_id: int) -> None:
        rows = make(batch) if make else batch
        rows.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return run


def _finish(writer, checkpoint: str):
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def run_updates(stream: DataFrame, path: str, checkpoint: str):
    """Run an aggregating stream on what is available; each batch writes the groups it changed, whole.

    In update mode the watermark frees the state of groups that can't change any more.
    """
    return _finish(stream.writeStream.outputMode("update").foreachBatch(_write_batch(path)), checkpoint)


def latest_updates(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The groups as their last batch left them."""
    rows = spark.read.option("basePath", path).parquet(path)
    values = [c for c in rows.columns if c not in (*keys, "batch_id")]
    return rows.groupBy(*keys).agg(*[F.max_by(v, "batch_id").alias(v) for v in values])


def run_increments(stream: DataFrame, make, path: str, checkpoint: str):
    """Run a stream on what is available; each batch writes ``make(batch)``, its own share of the counts."""
    return _finish(stream.writeStream.foreachBatch(_write_batch(path, make)), checkpoint)


def run_to_table(stream: DataFrame, path: str, checkpoint: str):
    """Run what is available and append the rows to a Parquet table."""
    return _finish(stream.writeStream.format("parquet").option("path", path).outputMode("append"), checkpoint)
