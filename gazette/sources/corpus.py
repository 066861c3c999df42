"""The driver tables seen as a news corpus.

``documents`` has no title, time or address of its own; all of them follow from
``doc_id`` and the text, so every run and every engine sees the same corpus.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import detect_language, evaluate_once, summary_or_default, tokenize
from ..session import rows_frame

AS_OF = datetime(2024, 1, 4)

# Prose fragments that stand for country names in the generated texts (fixed values).
PROSE_KEYWORDS = [
    ("AA", "thand"), ("AB", "ering"), ("AC", "Tion"), ("AD", "wh"), ("AE", "sthe"), ("BA", "ment"),
    ("BB", "eux"), ("BC", "qu"), ("BD", "ción"), ("BE", "ado"), ("CA", "lich"), ("CB", "sch"),
    ("CC", "The "), ("CD", "É"), ("CE", "In"), ("AA", "Thand"), ("BA", "Ment"), ("XX", "nowhere"),
]
# Prose fragments that stand for category keywords, beside the real ones (fixed values).
PROSE_RULES = [("tech", "TIONTH"), ("economy", "elle"), ("culture", "cion"), ("sports", "heit"), ("military", "erst")]
# Letters of the Latin alphabet written as these characters give the corpus in Chinese script (fixed values).
LATIN = "abcdefghijklmnopqrstuvwxyz"
HAN = "中国经济发展世界和平人民科技文化体育军事政治新闻今日"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in ("documents", "pages") else df


def spread(df: DataFrame) -> DataFrame:
    """Deal out a scan that has fewer partitions than there are cores.

    Text work per row is heavy, and a small file is read by one or two tasks. A
    large table has many more partitions than cores and is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    parts = df._jdf.queryExecution().toRdd().getNumPartitions()
    return df.repartition(cores) if parts < cores else df


def as_of() -> Column:
    return F.lit(AS_OF.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp")


def _back(minutes: Column) -> Column:
    return as_of() - F.make_interval(mins=minutes.cast("int"))


def documents_as_raw(documents: DataFrame) -> DataFrame:
    """Documents as raw articles, times included."""
    key = F.col("doc_id")
    hint = F.get(
        F.array(*[F.lit(h) for h in (None, "technology", "business", "science", "general", "international")]),
        (key % 6).cast("int"),
    )
    created = _back((key * 37) % 4320)
    return documents.select(
        key.alias("news_id"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.col("text").alias("content"),
        F.concat(F.lit("https://"), F.col("source"), F.lit(".example/"), key.cast("string")).alias("source_url"),
        (key % 21 + 1).cast("int").alias("source_id"),
        created.alias("created_at"),
        (created - F.make_interval(hours=((key % 7) * 12).cast("int"))).alias("published_at"),
        hint.alias("hint_category"),
    )


def documents_as_news(documents: DataFrame) -> DataFrame:
    """Stored articles with language, summary and a missing index on every ninth."""
    raw = documents_as_raw(documents)
    return raw.withColumns(
        {
            "language": detect_language(F.concat("title", "content")),
            "summary": summary_or_default(F.lit(None).cast("string"), F.col("content")),
            "has_video": F.lit(False),
        }
    )


def with_terms(news: DataFrame) -> DataFrame:
    """Adds the index terms of title and content."""
    return evaluate_once(
        news,
        {
            "title_terms": tokenize(F.col("title"), F.col("language")),
            "content_terms": tokenize(F.col("content"), F.col("language")),
        },
    )


def documents_in_han(documents: DataFrame) -> DataFrame:
    """The same documents with their Latin letters written as Chinese characters."""
    return documents.withColumn("text", F.translate(F.lower("text"), LATIN, HAN))


def nations_as_countries(nation: DataFrame, region: DataFrame) -> DataFrame:
    """Nations as countries: two-letter codes, a grid of coordinates, every sixth without."""
    key = F.col("n_nationkey")
    located = key % 6 != 5
    return nation.join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey")).select(
        country_code_of(key).alias("country_code"),
        F.initcap("n_name").alias("country_name"),
        F.col("n_name").alias("country_name_en"),
        F.when(located, (key * 5 - 60).cast("double")).alias("latitude"),
        F.when(located, (key * 12 - 150).cast("double")).alias("longitude"),
        F.col("r_name").alias("continent"),
    )


def country_code_of(key: Column) -> Column:
    return F.concat(F.char(F.floor(key / 5) + 65), F.char(key % 5 + 65))


def country_keywords(spark: SparkSession) -> DataFrame:
    return rows_frame(spark, PROSE_KEYWORDS, "country_code string, keyword string")


def suppliers_as_sources(supplier: DataFrame) -> DataFrame:
    """Suppliers as sources: four types, reliability 0 to 10."""
    key = F.col("s_suppkey")
    kinds = F.array(*[F.lit(k) for k in ("rss", "api", "crawler", "print")])
    return supplier.select(
        key.cast("int").alias("source_id"),
        F.col("s_name").alias("source_name"),
        F.get(kinds, (key % 4).cast("int")).alias("source_type"),
        (key % 11).cast("int").alias("reliability_score"),
    )


def events_as_requests(events: DataFrame) -> DataFrame:
    """Events as request log rows."""
    return events.select(
        F.col("event_id").alias("log_id"),
        (F.col("user_id") % 21 + 1).cast("int").alias("source_id"),
        F.col("event_type").alias("request_type"),
        F.when(F.col("event_type") == "error", 500).otherwise(200).alias("http_status"),
        F.col("ts").alias("created_at"),
    )
