"""Images and videos out of an article's markup, as maps over the pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import decode_entities, evaluate_once, first_by, strip
from ..functions.urls import (
    absolute_media_url,
    image_pick,
    image_rewrite,
    is_skipped_image,
    is_tracker,
    normalize_url,
    origin,
    video_platform,
)
from .pages import INLINE, attribute

SCRIPT_MEDIA = "https?://[^\\s\"'<>]+\\.(?:mp4|m3u8)"


def _first_filled(*cols: Column) -> Column:
    return F.coalesce(*[F.nullif(col, F.lit("")) for col in cols], F.lit(""))


def page_images(fragment: Column, page_url: Column, path: Column | None = None) -> Column:
    """``array<struct<url,alt,caption>>`` without furniture, first of a repeated address.

    ``path`` is what a site's picture addresses hold; others are left out there. A figure is taken whole, so its caption reaches the images inside it.
    """
    chunks = F.regexp_extract_all(fragment, F.lit("(?is)<figure\\b.*?</figure>|<img\\s[^>]*>"), F.lit(0))

    def images_of(chunk: Column) -> Column:
        tags = F.regexp_extract_all(chunk, F.lit("(?is)<img\\s[^>]*>"), F.lit(0))
        figcaption = F.regexp_extract(chunk, "(?is)<figcaption[^>]*>(.*?)</figcaption>", 1)
        caption = strip(decode_entities(F.regexp_replace(figcaption, INLINE, "")))

        def image(tag: Column) -> Column:
            src = _first_filled(attribute(tag, "src"), attribute(tag, "data-src"), attribute(tag, "data-original"))
            alt = _first_filled(attribute(tag, "alt"), attribute(tag, "title"))
            return F.struct(src.alias("url"), alt.alias("alt"), _first_filled(caption, alt).alias("caption"))

        return F.transform(tags, image)

    images = F.flatten(F.transform(chunks, images_of))
    held = (lambda url: F.lit(True)) if path is None else (lambda url: F.contains(url, F.coalesce(path, F.lit(""))))
    wanted = F.filter(images, lambda i: (i["url"] != "") & held(i["url"]) & ~is_skipped_image(i["url"]))
    absolute = F.transform(
        wanted,
        lambda i: F.struct(
            image_rewrite(absolute_media_url(i["url"], page_url)).alias("url"),
            i["alt"].alias("alt"),
            i["caption"].alias("caption"),
            i["url"].alias("written"),
        ),
    )
    listed = F.transform(_first_of_address(absolute), lambda i: F.struct(i["url"].alias("url"), i["alt"].alias("alt"), i["caption"].alias("caption")))
    return F.coalesce(listed, F.array().cast("array<struct<url:string,alt:string,caption:string>>"))


def _first_of_address(items: Column) -> Column:
    """The first item of each address; where a page without an address leaves none, what the markup has counts."""
    keyed = F.transform(items, lambda i: i.withField("address", F.struct(i["url"], F.when(i["url"].isNull(), i["written"]))))
    return first_by(keyed, "address")


def figure_images(fragment: Column) -> Column:
    """One address per figure: responsive sources first, then the image's attributes."""
    figures = F.regexp_extract_all(fragment, F.lit("(?is)<(?:figure|picture)\\b.*?</(?:figure|picture)>"), F.lit(0))

    def pick(figure: Column) -> Column:
        sources = F.regexp_extract_all(figure, F.lit("(?is)<source\\s[^>]*>"), F.lit(0))
        tag = F.regexp_extract(figure, "(?is)<img\\s[^>]*>", 0)
        return normalize_url(
            image_pick(
                F.transform(sources, lambda s: attribute(s, "srcset")),
                attribute(tag, "src"),
                attribute(tag, "data-src"),
                attribute(tag, "srcset"),
            ),
            F.lit(""),
        )

    return F.array_distinct(F.filter(F.transform(figures, pick), lambda url: url != ""))


def page_videos(fragment: Column, page_url: Column, html: Column, drop_trackers: Column | bool = True, parts: Column | None = None) -> Column:
    """``array<struct<url,type,platform>>``: players, their sources and frames of the article,
    then media named in scripts of the whole page (the article's markup has none left).
    Where ``parts`` names any, only addresses that hold one of them stay."""
    base = origin(page_url)
    drop = F.lit(drop_trackers) if isinstance(drop_trackers, bool) else drop_trackers

    def entry(kind: str, platform):
        def make(url: Column) -> Column:
            full = normalize_url(url, base)
            named = F.lit(platform) if isinstance(platform, str) else platform(full)
            return F.struct(full.alias("url"), F.lit(kind).alias("type"), named.alias("platform"), url.alias("written"))

        return make

    def sources(tags: Column) -> Column:
        return F.filter(F.transform(tags, lambda t: attribute(t, "src")), lambda u: u != "")

    players = F.regexp_extract_all(fragment, F.lit("(?is)<video\\b[^>]*>.*?</video>|<video\\b[^>]*>"), F.lit(0))
    direct = sources(F.transform(players, lambda p: F.regexp_extract(p, "(?is)^<video\\b[^>]*>", 0)))
    nested = sources(
        F.flatten(F.transform(players, lambda p: F.regexp_extract_all(p, F.lit("(?is)<source\\s[^>]*>"), F.lit(0))))
    )
    frames = F.filter(
        sources(F.regexp_extract_all(fragment, F.lit("(?is)<iframe\\s[^>]*>"), F.lit(0))),
        lambda u: ~(drop & is_tracker(u)),
    )
    scripts = F.regexp_extract_all(html, F.lit("(?is)<script\\b.*?</script>"), F.lit(0))
    named = F.flatten(F.transform(scripts, lambda s: F.regexp_extract_all(s, F.lit(SCRIPT_MEDIA), F.lit(0))))
    videos = F.concat(
        F.transform(direct, entry("direct", "unknown")),
        F.transform(nested, entry("source", "unknown")),
        F.transform(frames, entry("iframe", video_platform)),
        F.transform(named, entry("script", "unknown")),
    )
    if parts is not None:
        held = lambda v: (F.size(parts) == 0) | F.exists(parts, lambda part: F.contains(F.lower(v["url"]), part))
        videos = F.filter(videos, held)
    listed = F.transform(_first_of_address(videos), lambda v: F.struct(v["url"].alias("url"), v["type"].alias("type"), v["platform"].alias("platform")))
    return F.coalesce(listed, F.array().cast("array<struct<url:string,type:string,platform:string>>"))


def media_rows(articles: DataFrame, url_chars: int | None = None) -> DataFrame:
    """Media table rows of articles: images (or the single address), then videos.

    The first image is the cover; videos never are. Empty addresses are skipped
    after the cover is decided. ``articles`` needs news_id, images, image_url,
    videos and created_at. Image and video arrays become one array, exploded once.
    """
    image_type = "array<struct<url:string,alt:string,caption:string>>"
    single = F.array(F.struct(F.col("image_url").alias("url"), F.lit("").alias("alt"), F.lit("").alias("caption")))
    given = F.coalesce("images", F.array().cast(image_type))
    images = F.when((F.size(given) == 0) & (F.coalesce("image_url", F.lit("")) != ""), single).otherwise(given)
    videos = F.coalesce("videos", F.array().cast("array<struct<url:string,type:string,platform:string>>"))
    rows = F.concat(
        F.transform(
            images,
            lambda item, i: F.struct(
                F.lit("image").alias("media_type"), item["url"].alias("media_url"), (i == 0).alias("is_cover")
            ),
        ),
        F.transform(
            videos,
            lambda item: F.struct(
                F.lit("video").alias("media_type"), item["url"].alias("media_url"), F.lit(False).alias("is_cover")
            ),
        ),
    )
    return (
        evaluate_once(articles, {"_media": rows})
        .select("news_id", "created_at", F.posexplode("_media").alias("place", "item"))
        .where("coalesce(item.media_url, '') != ''")
        .select(
            "news_id",
            "place",
            F.col("item.media_type").alias("media_type"),
            (F.substring("item.media_url", 1, url_chars) if url_chars else F.col("item.media_url")).alias("media_url"),
            F.col("item.is_cover").alias("is_cover"),
            "created_at",
        )
    )
