"""Raw pages as raw articles, ready for the ingest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import evaluate_once
from ..functions.urls import source_from_url
from ..operators.page_media import page_images, page_videos
from ..operators.pages import accepted_content, heading, main_content, page_publish_time


def page_articles(pages: DataFrame, profiles: DataFrame, now: Column, site: str | None = None) -> DataFrame:
    """Raw articles of the pages that pass their site's gates; one pass over the pages, in their own rows.

    Each page goes by the profile of its site: containers and blocks of the text,
    the pictures and videos of the article, trackers, hints and the name of the
    source. A site without a name goes by its address. Pictures and videos come
    from the container the text was found in, else from the whole page.
    """
    found = accepted_content(main_content(pages, profiles, site))
    rule = lambda name: F.col(f"profile.{name}")
    markup = F.coalesce("container", "html")
    made = evaluate_once(
        found,
        {
            "title": heading(F.col("html")),
            "images": page_images(markup, F.col("url"), rule("image_path")),
            "videos": page_videos(markup, F.col("url"), F.col("html"), rule("trackers"), rule("video_parts")),
            "published_at": page_publish_time(F.col("html"), now),
        },
    )
    return made.select(
        "page_id",
        "title",
        "content",
        F.col("url").alias("source_url"),
        F.coalesce(rule("source"), source_from_url(F.col("url"))).alias("source_name"),
        "published_at",
        F.get("images", F.lit(0))["url"].alias("image_url"),
        "images",
        "videos",
        rule("category_hint").alias("category_hint"),
        rule("country_hint").alias("country_hint"),
        F.concat(F.lit("html_"), "site").alias("fetch_method"),
        F.lit(None).cast("string").alias("summary"),
    )
