"""Serving queries: details, lists, rankings and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions.geo import heat_color, latlon_to_xyz, marker_size, source_badge
from ..functions.text import fmt_time, fold_key, snippet
from ..functions.urls import video_embed_url, video_type
from .search import recent_news


def country_stats(news: DataFrame, countries: DataFrame, as_of: Column) -> DataFrame:
    """Primary country -> recent articles.

    An article has one primary row, so the count needs no distinct.
    """
    tagged = countries.where("is_primary and country_code is not null").select("news_id", "country_code")
    return (
        recent_news(news, as_of)
        .select("news_id")
        .join(tagged, "news_id")
        .groupBy("country_code")
        .agg(F.count("*").alias("news_count"))
    )


def located(countries_dim: DataFrame) -> DataFrame:
    return countries_dim.where("latitude is not null and longitude is not null").select(
        "country_code", "country_name", "latitude", "longitude"
    )


def region_ranking(stats: DataFrame, countries_dim: DataFrame, most: int = 10) -> DataFrame:
    """Top countries; codes without coordinates are dropped after the limit."""
    top = stats.orderBy(F.desc("news_count"), "country_code").limit(most)
    return top.join(located(countries_dim), "country_code").select("country_code", "news_count", "country_name")


def country_heatmap(stats: DataFrame, countries_dim: DataFrame, radius: float = 5.05) -> DataFrame:
    """Globe markers: position, colour and size per country."""
    x, y, z = latlon_to_xyz(F.col("latitude"), F.col("longitude"), radius)
    return stats.join(located(countries_dim), "country_code").select(
        "country_code",
        "news_count",
        heat_color(F.col("news_count")).alias("color"),
        marker_size(F.col("news_count")).alias("size"),
        x.alias("x"),
        y.alias("y"),
        z.alias("z"),
    )


def country_lookup(codes: DataFrame, countries_dim: DataFrame) -> DataFrame:
    """Name and coordinates of codes in any case; null where unknown."""
    dim = countries_dim.select(
        F.col("country_code").alias("known"), "country_name", "latitude", "longitude"
    )
    return (
        codes.join(dim, F.upper("country_code") == F.col("known"), "left")
        .drop("known")
        .withColumn("is_top", F.upper("country_code").isin(L.TOP_COUNTRIES))
    )


def sources_list(sources: DataFrame) -> DataFrame:
    logo, colour = source_badge(F.col("source_name"), F.col("source_type"), F.col("reliability_score"))
    return sources.select(
        "source_id", F.col("source_name").alias("name"), logo.alias("logo"), colour.alias("color"),
        F.col("source_type").alias("type"),
    ).orderBy("source_id")


def categories_list(categories: DataFrame) -> DataFrame:
    return categories.select("category_id", "category_name", "category_code", "color_code").orderBy("sort_order")


def news_by_category(
    news: DataFrame,
    news_categories: DataFrame,
    countries: DataFrame,
    categories: DataFrame,
    code: str,
    as_of: Column,
    most: int = 20,
) -> DataFrame:
    """Newest articles of a category, its code compared without case and accents; an unknown code raises."""
    named = categories.where(fold_key(F.col("category_code")) == fold_key(F.lit(code))).select("category_id")
    if named.isEmpty():
        raise ValueError(f"Category not found: {code}")
    tagged = news_categories.join(F.broadcast(named), "category_id", "left_semi").select("news_id")
    newest = (
        recent_news(news, as_of)
        .select("news_id", "title", "summary", "created_at")
        .join(tagged, "news_id", "left_semi")
        .orderBy(F.desc("created_at"), F.desc("news_id"))
        .limit(most)
    )
    primary = countries.where("is_primary").select("news_id", "country_code")
    return newest.join(primary, "news_id", "left").select(
        F.col("news_id").alias("id"),
        "title",
        snippet(F.col("summary")).alias("summary"),
        fmt_time(F.col("created_at")).alias("time"),
        F.coalesce("country_code", F.lit("")).alias("country"),
    )


def news_media(media: DataFrame) -> DataFrame:
    """Images (cover first) and typed videos per article; an article has few."""
    ordered = media.groupBy("news_id").agg(
        F.sort_array(
            F.collect_list(
                F.struct((~F.col("is_cover")).alias("after"), "media_id", "media_type", "media_url", "is_cover")
            )
        ).alias("items")
    )

    def of(kind: str) -> Column:
        return F.filter("items", lambda item: item["media_type"] == kind)

    images = F.transform(
        of("image"), lambda i: F.struct(i["media_url"].alias("url"), i["is_cover"].alias("is_cover"))
    )
    videos = F.transform(
        of("video"), lambda v: F.struct(v["media_url"].alias("url"), video_type(v["media_url"]).alias("type"))
    )
    return ordered.select("news_id", images.alias("images"), videos.alias("videos"))


def news_detail(
    news: DataFrame, sources: DataFrame, countries: DataFrame, countries_dim: DataFrame, media: DataFrame,
    ids: list[int] | None = None,
) -> DataFrame:
    """Article pages with source, country and media; all of them or the given ids.

    The id condition is put on news and media before the joins, so a lookup reads
    only the matching row groups. What belongs to an article is put together by
    number first, so its text is shuffled once.
    """
    if ids is not None:
        news = news.where(F.col("news_id").isin(ids))
        countries = countries.where(F.col("news_id").isin(ids))
        media = media.where(F.col("news_id").isin(ids))
    primary = countries.where("is_primary").select("news_id", "country_code")
    names = countries_dim.select("country_code", "country_name")
    empty = F.lit("")
    beside = (
        news.select("news_id", "source_id")
        .join(sources.select("source_id", "source_name"), "source_id", "left")
        .join(primary, "news_id", "left")
        .join(names, "country_code", "left")
        .join(news_media(media), "news_id", "left")
    )
    df = news.join(beside.drop("source_id"), "news_id")
    content = F.coalesce(F.nullif("content", empty), F.nullif("summary", empty), empty)
    return df.select(
        F.col("news_id").alias("id"),
        "title",
        "summary",
        content.alias("content"),
        fmt_time(F.col("published_at")).alias("published_at"),
        "source_url",
        F.coalesce(F.nullif("source_name", empty), F.lit(L.UNKNOWN_SOURCE)).alias("source_name"),
        "country_code",
        "country_name",
        F.coalesce("images", F.array().cast("array<struct<url:string,is_cover:boolean>>")).alias("images"),
        F.coalesce("videos", F.array().cast("array<struct<url:string,type:string>>")).alias("videos"),
    ).withColumn(
        "cover", F.coalesce(F.get(F.filter("images", lambda i: i["is_cover"]), F.lit(0)), F.get("images", F.lit(0)))["url"]
    )


def embed_videos(detail: DataFrame) -> DataFrame:
    """Replaces each video's address by the embeddable one."""
    embedded = F.transform(
        "videos", lambda v: F.struct(video_embed_url(v["url"], v["type"]).alias("url"), v["type"].alias("type"))
    )
    return detail.withColumn("videos", embedded)


def v_news_detail(
    news: DataFrame, sources: DataFrame, countries: DataFrame, countries_dim: DataFrame,
    news_categories: DataFrame, categories: DataFrame, as_of: Column,
) -> DataFrame:
    """The detail view of recent articles: countries (primary first) and categories joined to texts.

    Rows of articles before the window are left out before anything is grouped: by
    their own time where they carry it, else by the numbers of the recent articles.
    """
    recent = recent_news(news, as_of)

    def inside(rows: DataFrame) -> DataFrame:
        if "created_at" in rows.columns:
            return recent_news(rows, as_of)
        return rows.join(recent.select("news_id"), "news_id", "left_semi")

    named = inside(countries).join(countries_dim.select("country_code", "country_name"), "country_code")
    by_news = named.groupBy("news_id").agg(
        F.array_join(
            F.transform(
                F.sort_array(
                    F.collect_list(F.struct((~F.col("is_primary")).alias("after"), "country_code", "country_name"))
                ),
                lambda c: c["country_name"],
            ),
            ", ",
        ).alias("related_countries"),
        F.min(F.when(F.col("is_primary"), F.col("country_code"))).alias("primary_country_code"),
    )
    cats = (
        inside(news_categories).join(categories.select("category_id", "category_name"), "category_id")
        .groupBy("news_id")
        .agg(
            F.array_join(
                F.transform(
                    F.sort_array(F.collect_list(F.struct("category_id", "category_name"))), lambda c: c["category_name"]
                ),
                "/",
            ).alias("category_names")
        )
    )
    return (
        recent.join(sources.select("source_id", "source_name", "reliability_score"), "source_id", "left")
        .join(by_news, "news_id", "left")
        .join(cats, "news_id", "left")
        .select(
            "news_id", "title", "summary", "source_url", "created_at", "published_at", "language", "has_video",
            "source_name", "reliability_score", "related_countries", "primary_country_code", "category_names",
        )
    )


def category_counts(news_categories: DataFrame, categories: DataFrame) -> DataFrame:
    counts = news_categories.groupBy("category_id").agg(F.count("*").alias("news_count"))
    return counts.join(categories.select("category_id", "category_name"), "category_id").select(
        "category_name", "news_count"
    )


def retention_report(news: DataFrame, as_of: Column) -> DataFrame:
    edge = as_of - F.make_interval(hours=F.lit(L.WINDOW_HOURS))
    kept = F.col("created_at") >= edge
    return news.agg(
        F.count_if(~kept).alias("old_news_count"),
        F.count_if(kept).alias("recent_news_count"),
        fmt_time(F.min(F.when(kept, F.col("created_at")))).alias("earliest_news"),
        fmt_time(F.max(F.when(kept, F.col("created_at")))).alias("latest_news"),
    )


def recent_hours(news: DataFrame, as_of: Column, hours: int = 6) -> DataFrame:
    """Articles of the last hours, boundary included, newest first."""
    edge = as_of - F.make_interval(hours=F.lit(hours))
    return news.where(F.col("created_at") >= edge).orderBy(F.desc("created_at"), F.desc("news_id"))


def country_news(news: DataFrame, countries: DataFrame, code: str, as_of: Column) -> DataFrame:
    """Recent articles (boundary included) whose primary country is ``code``."""
    edge = as_of - F.make_interval(hours=F.lit(L.WINDOW_HOURS))
    tagged = countries.where(F.col("is_primary") & (F.col("country_code") == code)).select("news_id")
    return (
        news.where(F.col("created_at") >= edge)
        .join(tagged, "news_id", "left_semi")
        .orderBy(F.desc("created_at"), F.desc("news_id"))
    )


def latest_with_country(news: DataFrame, countries: DataFrame, countries_dim: DataFrame, most: int = 10) -> DataFrame:
    """The newest articles with their countries: the newest are found by number and time, and only they get their titles."""
    named = countries.select("news_id", "country_code", "is_primary").join(countries_dim.select("country_code", "country_name"), "country_code")
    order = [F.desc("created_at"), F.desc("news_id"), "country_code"]
    newest = news.select("news_id", "created_at").join(named, "news_id").orderBy(*order).limit(most)
    shown = news.select("news_id", "title").join(F.broadcast(newest), "news_id")  # ``most`` rows
    return shown.select("title", "country_code", "is_primary", "country_name")


def table_report(tables: dict[str, DataFrame]) -> DataFrame:
    """Name, columns and rows of each table."""
    whole = None
    for name, df in tables.items():
        part = df.agg(F.count("*").alias("table_rows")).select(
            F.lit(name).alias("table_name"), F.lit(len(df.columns)).cast("bigint").alias("table_columns"), "table_rows"
        )
        whole = part if whole is None else whole.unionByName(part)
    return whole
