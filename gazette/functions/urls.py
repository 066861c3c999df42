"""Link, address and media-address functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon as L

IMAGE_REWRITES = (("thumbLarge", "master1050"),)

# Substring of the address -> site code, first match wins (fixed values).
SITE_HOSTS = [
    ("cn.nytimes.com", "nytimes_cn"),
    ("nytimes.com", "nytimes"),
    ("cctv.com", "cctv"),
    ("guancha.cn", "guancha"),
    ("washingtonpost.com", "washingtonpost"),
    ("sputniknews.cn", "sputnik"),
    ("xinhuanet.com", "xinhua"),
    ("news.cn", "xinhua"),
    ("cnn.com", "cnn"),
    ("jiemian.com", "jiemian"),
    ("aljazeera.com", "aljazeera"),
    ("globaltimes.cn", "globaltimes"),
    ("sciencedaily.com", "sciencedaily"),
    ("bbc.c", "bbc"),
]
# The four sources named by the address lookup (fixed values).
SOURCE_HOSTS = [
    ("nytimes.com", "nytimes"),
    ("cctv.com", "cctv"),
    ("guancha.cn", "guancha"),
    ("washingtonpost.com", "washingtonpost"),
]


def contains_any(col: Column, parts) -> Column:
    """True if the text contains one of a short list of literals."""
    found = F.lit(False)
    for part in parts:
        found = found | F.contains(col, F.lit(part))
    return found


def first_match(col: Column, rules, default: str) -> Column:
    chain = None
    for part, value in rules:
        hit = F.contains(col, F.lit(part))
        chain = F.when(hit, value) if chain is None else chain.when(hit, value)
    return F.lit(default) if chain is None else chain.otherwise(default)


def origin(url: Column) -> Column:
    """Scheme and host."""
    return F.regexp_extract(url, "^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)


def normalize_url(link: Column, base: Column) -> Column:
    """``//x`` gets a scheme, ``/x`` the base; anything else is kept."""
    text = F.trim(F.coalesce(link, F.lit("")))
    return (
        F.when(text.startswith("//"), F.concat(F.lit("https:"), text))
        .when(text.startswith("/"), F.concat(F.regexp_replace(base, "/+$", ""), text))
        .otherwise(text)
    )


def absolute_media_url(src: Column, page_url: Column) -> Column:
    """Like ``normalize_url``; a path without a leading slash hangs below the page."""
    folder = F.when(page_url.endswith("/"), page_url).otherwise(
        F.concat(F.regexp_replace(page_url, "/[^/]*$", ""), F.lit("/"))
    )
    near = F.concat(folder, src)
    full = normalize_url(src, origin(page_url))
    relative = ~src.startswith("/") & ~src.startswith("http")
    return F.when(relative, near).otherwise(full)


def url_date(url: Column) -> Column:
    """Day named by the link: ``/YYYYMMDD/``, ``/YYYY/MM/DD/`` or ``YYYY_MM_DD``."""
    compact = F.regexp_extract(url, "/(\\d{8})/", 1)
    slashed = F.regexp_extract(url, "/(\\d{4}/\\d{2}/\\d{2})/", 1)
    scored = F.regexp_extract(url, "(\\d{4}_\\d{2}_\\d{2})", 1)
    return F.coalesce(
        F.try_to_timestamp(F.nullif(compact, F.lit("")), F.lit("yyyyMMdd")),
        F.try_to_timestamp(F.nullif(slashed, F.lit("")), F.lit("yyyy/MM/dd")),
        F.try_to_timestamp(F.nullif(scored, F.lit("")), F.lit("yyyy_MM_dd")),
    )


def title_from_slug(url: Column) -> Column:
    """Last path part without its ending, dashes as blanks; null if there is none."""
    slug = F.regexp_extract(url, "/([^/?#]+?)(?:\\.html?)?/?(?:[?#].*)?$", 1)
    return F.nullif(F.replace(slug, F.lit("-"), F.lit(" ")), F.lit(""))


def source_from_url(url: Column) -> Column:
    return first_match(url, SOURCE_HOSTS, "unknown")


def site_of(url: Column) -> Column:
    """Site code that selects the extraction profile."""
    return first_match(F.lower(origin(url)), SITE_HOSTS, "generic")


def video_type(url: Column) -> Column:
    """Player kind of a stored video, first match wins."""
    low = F.lower(url)
    return (
        F.when(F.contains(low, F.lit(".m3u8")), "hls")
        .when(contains_any(low, ["youtube", "youtu.be"]), "youtube")
        .when(F.contains(low, F.lit("bilibili")), "bilibili")
        .when(contains_any(low, ["player", "embed"]), "embed")
        .otherwise("mp4")
    )


def video_platform(url: Column) -> Column:
    """Platform of an embedded frame, first match wins."""
    return (
        F.when(contains_any(url, ["youtube.com", "youtu.be"]), "youtube")
        .when(F.contains(url, F.lit("vimeo.com")), "vimeo")
        .when(F.contains(url, F.lit("bilibili.com")), "bilibili")
        .when(F.contains(url, F.lit("aljazeera.com")), "aljazeera")
        .when(F.contains(url, F.lit("nytimes.com")), "nytimes")
        .when(F.contains(url, F.lit("player")), "player")
        .otherwise("unknown")
    )


def is_tracker(url: Column) -> Column:
    return contains_any(F.lower(url), L.TRACKER_PARTS)


def is_placeholder(url: Column) -> Column:
    return (F.coalesce(url, F.lit("")) == "") | contains_any(F.lower(url), L.PLACEHOLDER_PARTS)


def is_skipped_image(url: Column) -> Column:
    return contains_any(F.lower(url), L.IMAGE_SKIP)


def image_rewrite(url: Column) -> Column:
    for small, large in IMAGE_REWRITES:
        url = F.replace(url, F.lit(small), F.lit(large))
    return url


def srcset_pick(srcset: Column) -> Column:
    """First address of a srcset that is no placeholder; null if there is none."""
    urls = F.transform(
        F.split(F.coalesce(srcset, F.lit("")), ","), lambda part: F.split_part(F.trim(part), F.lit(" "), F.lit(1))
    )
    return F.get(F.filter(urls, lambda url: ~is_placeholder(url)), F.lit(0))


def image_pick(source_srcsets: Column, src: Column, data_src: Column, srcset: Column) -> Column:
    """Responsive sources first, then the image's own attributes."""
    from_sources = F.get(
        F.filter(F.transform(source_srcsets, srcset_pick), lambda url: url.isNotNull()), F.lit(0)
    )
    return F.coalesce(
        from_sources,
        F.when(~is_placeholder(src), src),
        F.when(~is_placeholder(data_src), data_src),
        srcset_pick(srcset),
    )


def video_embed_url(url: Column, kind: Column) -> Column:
    """Embeddable address for known players, else the address itself."""
    youtube = F.regexp_extract(
        url, "(?:youtube\\.com/embed/|youtube\\.com/watch\\?v=|youtu\\.be/)([a-zA-Z0-9_-]+)", 1
    )
    bilibili = F.regexp_extract(url, "(?i)bv([a-zA-Z0-9]+)", 1)
    return (
        F.when((kind == "youtube") & (youtube != ""), F.concat(F.lit("https://www.youtube.com/embed/"), youtube))
        .when(
            (kind == "bilibili") & (bilibili != ""),
            F.concat(F.lit("https://player.bilibili.com/player.html?bvid=BV"), bilibili),
        )
        .otherwise(url)
    )


def article_number(url: Column) -> Column:
    """Numeric id of a ``/<digits>.shtml`` article; null if the link has none."""
    return F.nullif(F.regexp_extract(url, "/(\\d+)\\.shtml", 1), F.lit(""))


def author_names(text: Column) -> Column:
    """Names after ``By`` and ``and``, joined by ``and``; null if there is none."""
    names = F.regexp_extract_all(text, F.lit("(?:By\\s+|and\\s+)(\\w+\\s+\\w+)"), F.lit(1))
    return F.nullif(F.array_join(names, " and "), F.lit(""))


def editor_line(text: Column) -> Column:
    line = F.lit(False)
    for end in L.EDITOR_LINE_ENDS:
        line = line | text.endswith(end)
    return line
