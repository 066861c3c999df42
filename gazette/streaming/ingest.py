"""The corpus as a stream: landed files in, tables out, batch by batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import fold_key
from ..operators.index import build_index, index_build_log, rebuild_terms, unindexed_news
from ..operators.rows import assign_ids
from ..operators.stats import job_totals
from ..plans.ingest import ingest_batch
from ..session import StoredFrames
from ..sources.export import apply_retention, committed, exists, read_committed, write_news_tables
from .rolling import source_days

LATENESS = "48 hours"


def landed_files(spark: SparkSession, schema: T.StructType, path: str, fmt: str = "parquet", name_filter: str | None = None,
                 files_per_batch: int | None = None) -> DataFrame:
    """Files as they land below ``path``, which may be a glob; a table that it names may be one file or a folder of files.

    ``name_filter`` looks at the names of the files themselves, so it finds nothing in a folder.
    """
    reader = spark.readStream.schema(schema).format(fmt)
    if name_filter:
        reader = reader.option("pathGlobFilter", name_filter)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def stream_dedupe(articles: DataFrame, arrived_at: str = "created_at") -> DataFrame:
    """One row per address within the life of an article; state ends with the watermark."""
    return (
        articles.withColumn("url_key", fold_key(F.col("source_url")))
        .withWatermark(arrived_at, LATENESS)
        .dropDuplicatesWithinWatermark(["url_key"])
        .drop("url_key")
    )


def split_late(articles: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(on time, late): the age rule as an explicit split; no time passes."""
    late = F.coalesce(F.col("published_at") < now - F.make_interval(hours=F.lit(48)), F.lit(False))
    return articles.where(~late), articles.where(late).withColumn("status", F.lit("Rejected: Exceeds 48h limit"))


def write_split(root: str, now: Column):
    """A ``foreachBatch`` function with two sinks: rows on time and late ones, committed together by batch id."""

    def run(batch: DataFrame, batch_id: int) -> None:
        on_time, late = split_late(batch, now)
        write_news_tables({"on_time": on_time, "late": late}, root, f"b{batch_id}")

    return run


def start_split(articles: DataFrame, root: str, checkpoint: str, now: Column):
    """Start the split of a stream on everything available."""
    writer = articles.writeStream.foreachBatch(write_split(root, now))
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _others(spark: SparkSession, root: str, batch: str) -> DataFrame | None:
    """Commit records of the batches before this one, itself left out if it runs again."""
    done = committed(spark, root)
    return None if done is None else done.where(~F.col("batch_id").isin(batch, f"{batch}-repair"))


def repair(spark: SparkSession, root: str, as_of: Column, batch: str) -> bool:
    """Index the articles of the last hours that have no build log; says whether there were any."""
    missing = unindexed_news(read_committed(spark, root, "news"), read_committed(spark, root, "index_build_logs"), as_of)
    if missing.isEmpty():
        return False
    countries = read_committed(spark, root, "news_countries").where("is_primary").select("news_id", F.col("country_code").alias("primary_country"))
    found = rebuild_terms(missing.drop("ingest_date", "batch_id")).join(countries, "news_id", "left")
    logs = index_build_log(found).withColumn("created_at", F.col("build_time"))
    write_news_tables({"inverted_index": build_index(found), "index_build_logs": logs}, root, f"{batch}-repair")
    return True


def write_ingest(root: str, keywords: DataFrame, categories: DataFrame, now, rules=None, number_by: list | None = None, retain: bool = False):
    """A ``foreachBatch`` function that ingests a micro-batch into the tables below ``root``: the whole polling job.

    The batch id names the partitions it writes, so a batch that is run again
    after a failure replaces what it wrote. Addresses already stored by committed
    batches are duplicates; ``now`` gives the clock of a batch. Beside the tables of
    the articles it writes the rejected ones, the batch's increments of the source
    statistics and its totals. ``number_by`` (columns that end in a unique key) gives
    arrivals consecutive numbers, on from the last one of the batches before. With
    ``retain`` articles whose index is missing are indexed, and what has left the window
    before the batch's last clock goes; so addresses are looked up in the days of
    the window only.
    """

    def stored_urls(spark: SparkSession, others: DataFrame | None) -> DataFrame | None:
        if others is None or not exists(spark, f"{root}/news"):
            return None
        news = read_committed(spark, root, "news").select("news_id", "source_url", "batch_id")
        return news.join(F.broadcast(others), "batch_id", "left_semi")

    def run(batch: DataFrame, batch_id: int) -> None:
        spark, name, last = batch.sparkSession, f"b{batch_id}", None
        others = _others(spark, root, name)
        if number_by:
            start = others.agg(F.max("last_id")).first()[0] if others is not None else None
            batch = assign_ids(batch.drop("news_id"), number_by, start=start or 0)
            last = (start or 0) + batch.count()
        files = StoredFrames(spark)
        try:
            tables, gated, _ = ingest_batch(batch, now, keywords, categories, rules, stored_urls(spark, others), files)
            rejected = gated.where("status_kind != 'ok'").select("news_id", "source_url", "status", "created_at")
            days = source_days(gated.where("status_kind = 'ok'")).withColumn("created_at", F.col("last"))
            clock = gated.agg(F.max(now).alias("clock")).first()["clock"]
            totals = job_totals(gated).withColumn("created_at", F.lit(clock).cast("timestamp"))
            write_news_tables({**tables, "rejected": rejected, "source_days": days, "job_totals": totals}, root, name, last)
        finally:
            files.drop()
        if retain and clock is not None:
            repair(spark, root, F.lit(clock), name)
            apply_retention(spark, root, clock)

    return run


def start_ingest(articles: DataFrame, root: str, checkpoint: str, keywords: DataFrame, categories: DataFrame, now,
                 rules=None, every: str | None = None, number_by: list | None = None, retain: bool = False):
    """Start the ingest stream: every interval, or everything available and stop."""
    run = write_ingest(root, keywords, categories, now, rules, number_by, retain)
    writer = articles.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return writer.trigger(**trigger).start()


def write_retained(root: str, as_of):
    """A ``foreachBatch`` function that stores the batch as the table ``news`` and then retires what is over in storage."""

    def run(batch: DataFrame, batch_id: int) -> None:
        write_news_tables({"news": batch}, root, f"b{batch_id}")
        apply_retention(batch.sparkSession, root, as_of)

    return run
