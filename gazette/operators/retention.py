"""Retention: articles older than the window leave with all their rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as L


def expired(created_at: Column, as_of: Column) -> Column:
    """Strictly older than the window; a row at the boundary stays."""
    return created_at < as_of - F.make_interval(hours=F.lit(L.WINDOW_HOURS))


def retain_news(news: DataFrame, as_of: Column) -> DataFrame:
    return news.where(~expired(F.col("created_at"), as_of))


def retain_children(child: DataFrame, kept_news: DataFrame) -> DataFrame:
    """Rows of a child table whose article stays; the follow-up of a cascade."""
    return child.join(kept_news.select("news_id"), "news_id", "left_semi")


def retain_logs(logs: DataFrame, as_of: Column) -> DataFrame:
    return logs.where(F.col("created_at") >= as_of - F.make_interval(days=F.lit(L.LOG_DAYS)))


def retention_counts(news: DataFrame, as_of: Column) -> DataFrame:
    return news.agg(
        F.count_if(expired(F.col("created_at"), as_of)).alias("deleted_news_count"),
        F.count_if(~expired(F.col("created_at"), as_of)).alias("kept_news_count"),
    )
