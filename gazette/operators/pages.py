"""Articles out of raw pages.

Every operator here is a map over the pages: a page is cut, filtered and joined
again inside its own row with array functions, so pages are read once, never
shuffled and never sent to Python. Site differences come from the profile table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions.text import WHOLE_ELEMENTS, bind, decode_entities, ends_in_mark, evaluate_once, first_by, strip, strip_html, strip_tags
from ..functions.times import publish_time
from ..functions.urls import contains_any, editor_line, normalize_url, origin, site_of

DROPPED = (
    "(?is)<!--.*?-->|<script\\b.*?</script>|<style\\b.*?</style>|<iframe\\b.*?</iframe>|<aside\\b.*?</aside>"
    "|<nav\\b.*?</nav>|<header\\b.*?</header>|<footer\\b.*?</footer>"
)
BLOCK_NAMES = (
    "p|div|h[1-6]|li|ul|ol|dl|dt|dd|table|tr|td|th|section|article|main|figure|figcaption|blockquote|form|pre|hr"
)
BOUNDARY = f"(?i)\\s*<(/?)({BLOCK_NAMES})(?:\\s[^>]*)?/?>\\s*"
INLINE = "\\s*<[^>]*>\\s*"
CUT, HEAD = "\u0001", "\u0002"
PARAGRAPH = "\n\n"
#: Pieces of a page that are walked through as one list.
RUN = 256


def attribute(tag: Column, name: str) -> Column:
    """Value of a quoted or bare attribute of an opening tag, trimmed; empty if absent."""
    rx = f"(?is)\\s{name}\\s*=\\s*(?:\"([^\"]*)\"|'([^']*)'|([^\\s\"'>]+))"
    return F.trim(F.concat(*[F.regexp_extract(tag, rx, group) for group in (1, 2, 3)]))


def container_html(html: Column, open_rx: Column) -> Column:
    """Inner markup of the first element whose opening tag matches; null if none.

    Only the element's own tag name is counted while looking for its end, so
    unclosed tags of other kinds do no harm; without an end it runs to the end.
    """

    def inner(rest: Column) -> Column:
        name = F.regexp_extract(rest, "^<([a-zA-Z][a-zA-Z0-9]*)", 1)
        parts = F.split(rest, F.concat(F.lit("(?i)(?=</?"), name, F.lit("[\\s>/])")))

        def close(cut: Column) -> Column:
            start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("seen"), F.lit(0).alias("end"))

            def step(acc: Column, part: Column) -> Column:
                depth = acc["depth"] + F.when(part.startswith("</"), -1).otherwise(1)
                seen = acc["seen"] + 1
                end = F.when((acc["end"] == 0) & (depth == 0), seen).otherwise(acc["end"])
                return F.struct(depth.alias("depth"), seen.alias("seen"), end.alias("end"))

            last = F.aggregate(cut, start, step, lambda acc: F.when(acc["end"] == 0, acc["seen"] + 1).otherwise(acc["end"]))
            return F.array_join(F.slice(cut, F.lit(1), last - 1), "")

        return F.regexp_replace(bind(parts, close), "^<[^>]*>", "")

    at = F.regexp_instr(html, open_rx)
    return F.when(at > 0, bind(F.substring(html, at, F.length(html)), inner))


def text_blocks(fragment: Column, allowed: Column, dropped: str = DROPPED) -> Column:
    """Texts of the leaf blocks of a fragment, in order.

    A text belongs to its nearest open block tag: it is kept if that tag is
    allowed, or if an allowed div or li is still open around it. Text nodes are
    trimmed and joined without a gap.
    """
    bare = F.regexp_replace(F.translate(fragment, CUT + HEAD, ""), dropped, "")
    marked = F.regexp_replace(bare, BOUNDARY, f"{CUT}$1$2{HEAD}")
    plain = F.regexp_replace(marked, INLINE, "")

    def cut(piece: Column) -> Column:
        label = F.lower(F.split_part(piece, F.lit(HEAD), F.lit(1)))
        holder = F.regexp_replace(label, "^/", "")
        holds = holder.isin("div", "li") & F.array_contains(allowed, holder)
        change = F.when(~holds, 0).when(label.startswith("/"), -1).otherwise(1)
        own = ~label.startswith("/") & F.array_contains(allowed, label)
        return F.struct(change.alias("change"), own.alias("own"), F.split_part(piece, F.lit(HEAD), F.lit(2)).alias("text"))

    def after(open_: Column, piece: Column) -> Column:
        """Allowed holders that are open after a piece; an end without a beginning changes nothing."""
        return F.greatest(open_ + piece["change"], F.lit(0))

    def runs(pieces: Column) -> Column:
        """The pieces in runs of RUN, so that no list grows piece by piece over a whole page."""
        starts = F.sequence(F.lit(0), F.floor((F.size(pieces) - 1) / RUN).cast("int"))
        return F.transform(starts, lambda k: F.slice(pieces, k * RUN + 1, RUN))

    def opened(parts: Column) -> Column:
        """How many holders are open where each run begins."""

        def step(acc: Column, part: Column) -> Column:
            end = F.aggregate(part, F.get(acc, F.size(acc) - 1), after)
            return F.concat(acc, F.array(end))

        return F.aggregate(F.slice(parts, F.lit(1), F.size(parts) - 1), F.array(F.lit(0)), step)

    def chosen(part: Column, begins: Column) -> Column:
        """Texts of a run; the number of holders that are open at each piece is summed up within the run."""
        nothing = F.array().cast("array<boolean>")
        start = F.struct(begins.alias("open"), nothing.alias("kept"))

        def step(acc: Column, piece: Column) -> Column:
            still = after(acc["open"], piece)
            return F.struct(still.alias("open"), F.concat(acc["kept"], F.array(piece["own"] | (still > 0))).alias("kept"))

        def pick(kept: Column) -> Column:
            return F.transform(F.filter(part, lambda piece, k: F.get(kept, k)), lambda piece: strip(decode_entities(piece["text"])))

        return bind(F.aggregate(part, start, step, lambda acc: acc["kept"]), pick)

    def choose(parts: Column) -> Column:
        return bind(opened(parts), lambda begins: F.flatten(F.transform(parts, lambda part, k: chosen(part, F.get(begins, k)))))

    pieces = F.transform(F.split(plain, CUT), cut)
    return F.filter(bind(bind(pieces, runs), choose), lambda text: text != "")


def element_texts(html: Column, open_rx: Column) -> Column:
    """Texts of all elements whose opening tag matches, for sites without one container."""
    whole = F.concat(F.lit("(?s)"), open_rx, F.lit(".*?</(?:p|div|section|span|blockquote)>"))
    found = F.regexp_extract_all(F.regexp_replace(html, DROPPED, ""), whole, F.lit(0))
    return F.transform(found, lambda part: strip(decode_entities(F.regexp_replace(part, INLINE, ""))))


def keep_block(text: Column, least: Column, rule: Column) -> Column:
    """Site text filters: length, and the site's rule for furniture."""
    return (
        (F.length(text) > least)
        & ~((rule == "marks") & ends_in_mark(text))
        & ~((rule == "editor") & editor_line(text))
        & ~((rule == "ads") & contains_any(F.lower(text), L.AD_TEXTS))
    )


def _join_blocks(texts: Column, profile) -> Column:
    kept = F.filter(texts, lambda text: keep_block(text, profile("least"), profile("rule")))
    return F.array_join(F.when(profile("distinct_blocks"), F.array_distinct(kept)).otherwise(kept), PARAGRAPH)


def with_profiles(pages: DataFrame, profiles: DataFrame, site: str | None = None) -> DataFrame:
    """Pages with the profile of their site as a struct; unlisted sites use the generic one."""
    rules = profiles.select(F.col("site"), F.struct(*profiles.columns).alias("profile"))
    # computed as a row value, so that a given site stays a join key
    coded = evaluate_once(pages, {"site": F.lit(site) if site else site_of(F.col("url"))})
    return coded.join(F.broadcast(rules), "site")


def main_content(pages: DataFrame, profiles: DataFrame, site: str | None = None) -> DataFrame:
    """Adds ``content`` and ``container`` (its markup).

    Elements that are blocks by themselves come first, then the containers in
    order; the first text beyond the site's gate wins. If none does, all
    paragraphs (where the site allows it), else the last short text. Where no
    container has a block that counts, the first one with text of any length is the markup.
    """
    df = with_profiles(pages, profiles, site)
    html = F.regexp_replace("html", WHOLE_ELEMENTS, "")
    profile = lambda name: F.col(f"profile.{name}")

    def found(fragment: Column, texts: Column) -> Column:
        return F.struct(fragment.alias("fragment"), _join_blocks(texts, profile).alias("content"))

    candidates = F.concat(
        F.transform(profile("elements"), lambda rx: F.struct(F.lit(True).alias("elements"), rx.alias("rx"))),
        F.transform(profile("containers"), lambda rx: F.struct(F.lit(False).alias("elements"), rx.alias("rx"))),
    )

    def extracted(candidate: Column) -> Column:
        by_element = found(F.lit(None).cast("string"), element_texts(F.col("_html"), candidate["rx"]))
        by_container = bind(
            container_html(F.col("_html"), candidate["rx"]),
            lambda fragment: F.when(
                fragment.isNotNull(), found(fragment, text_blocks(fragment, profile("blocks")))
            ),
        )
        return F.when(candidate["elements"], by_element).otherwise(by_container)

    nothing = F.lit(None).cast("struct<fragment:string,content:string>")
    start = F.struct(nothing.alias("long"), nothing.alias("short"), F.lit(None).cast("string").alias("first"))

    def look(acc: Column, candidate: Column) -> Column:
        """The first long text ends the search; until then the last short one is remembered."""

        def weigh(e: Column) -> Column:
            return F.struct(
                F.when(F.length(e["content"]) > profile("gate"), e).alias("long"),
                F.coalesce(F.when(e["content"] != "", e), acc["short"]).alias("short"),
                F.coalesce(acc["first"], F.when((e["content"] != "") | (strip_html(e["fragment"]) != ""), e["fragment"])).alias("first"),
            )

        return F.when(acc["long"].isNotNull(), acc).otherwise(bind(extracted(candidate), weigh))

    paragraphs = F.array_join(
        F.filter(
            text_blocks(F.col("_html"), F.array(F.lit("p")), WHOLE_ELEMENTS),
            lambda text: F.length(text) > profile("fallback_least"),
        ),
        PARAGRAPH,
    )
    df = evaluate_once(evaluate_once(df, {"_html": html}), {"_found": F.aggregate(candidates, start, look)})
    short = F.coalesce("_found.short.content", F.lit(""))
    fallback = F.when(
        profile("fallback") & F.col("_found.long").isNull() & (F.length(short) != profile("gate")),
        F.nullif(paragraphs, F.lit("")),
    )
    return evaluate_once(
        df,
        {
            "content": F.coalesce("_found.long.content", fallback, short),
            "container": F.coalesce("_found.long.fragment", "_found.short.fragment", "_found.first"),
        },
    ).drop("_html", "_found")


def accepted_content(extracted: DataFrame) -> DataFrame:
    """Pages whose text passes the site's article gate and paywall check."""
    paid = F.col("profile.paywall") & has_paywall(F.col("html"))
    return extracted.where((F.length("content") > F.col("profile.article_gate")) & ~paid)


def has_paywall(html: Column) -> Column:
    return contains_any(F.lower(strip_tags(html)), L.PAYWALL_SIGNS)


def paywall_filter(pages: DataFrame) -> DataFrame:
    return pages.where(~has_paywall(F.col("html")))


def heading(html: Column) -> Column:
    """The text of the first h1, else of the title element."""
    first = strip_html(F.regexp_extract(html, "(?is)<h1[^>]*>(.*?)</h1>", 1))
    return F.coalesce(F.nullif(first, F.lit("")), page_title(html))


def page_title(html: Column) -> Column:
    return strip_html(F.regexp_extract(html, "(?is)<title[^>]*>(.*?)</title>", 1))


def anchors(html: Column, base: Column) -> Column:
    """``array<struct<href,title>>`` of all links, normalised, first of a repeated address."""
    tags = F.regexp_extract_all(html, F.lit("(?is)<a\\s[^>]*>.*?</a>"), F.lit(0))
    links = F.transform(
        tags,
        lambda tag: F.struct(
            normalize_url(attribute(F.regexp_extract(tag, "(?is)^<a\\s[^>]*>", 0), "href"), base).alias("href"),
            strip(decode_entities(F.regexp_replace(tag, INLINE, ""))).alias("title"),
        ),
    )
    return F.filter(links, lambda link: link["href"] != "")


def article_links(pages: DataFrame, profiles: DataFrame, site: str | None = None, capped: bool = False) -> DataFrame:
    """One row per article link: page_id, position, link, link_title, by the site's rules.

    All links are listed; ``capped`` keeps as many per page as the site's profile names.
    """
    df = with_profiles(pages, profiles, site)
    rule = lambda name: F.col(f"profile.{name}")
    wanted = F.filter(
        anchors(F.regexp_replace("html", WHOLE_ELEMENTS, ""), origin(F.col("url"))),
        lambda link: (F.length(link["title"]) >= rule("link_title"))
        & F.regexp_like(link["href"], rule("link_rx"))
        & ((rule("link_skip") == "") | ~F.regexp_like(link["href"], rule("link_skip"))),
    )
    links = first_by(wanted, "href")
    listed = evaluate_once(df, {"_links": F.slice(links, F.lit(1), rule("link_cap")) if capped else links})
    return listed.select("page_id", F.posexplode("_links").alias("position", "link")).select(
        "page_id", "position", F.col("link.href").alias("link"), F.col("link.title").alias("link_title")
    )


def page_publish_time(html: Column, fallback: Column) -> Column:
    """Timestamp attribute, time element, visible text, else the fetch time."""
    tag = F.regexp_extract(html, "(?is)<[a-z][a-z0-9]*\\s[^>]*\\btimestamp\\s*=[^>]*>", 0)
    stamp = attribute(tag, "timestamp")
    moment = attribute(F.regexp_extract(html, "(?is)<[a-z][a-z0-9]*\\s[^>]*\\bdatetime\\s*=[^>]*>", 0), "datetime")
    return publish_time(stamp, moment, strip_tags(html), fallback)


STRUCTURE_TAGS = ["article", "main", "section", "div", "ul", "li", "p", "h1", "h2", "h3", "a", "img", "iframe"]
NEWS_LINK_PARTS = ["/news/", "/article/", "/2024/", "/2025/", "/2026/"]


def page_structure_profile(pages: DataFrame) -> DataFrame:
    """Per page: size, title, elements per kind, links, distinct news links."""
    hrefs = F.regexp_extract_all("html", F.lit("(?is)<a\\s[^>]*href\\s*=\\s*[\"']([^\"']*)[\"']"), F.lit(1))
    counts = [
        F.regexp_count("html", F.lit(f"(?i)<{tag}[\\s>]")).cast("bigint").alias(f"n_{tag}") for tag in STRUCTURE_TAGS
    ]
    return pages.select(
        "page_id",
        F.length("html").cast("bigint").alias("size"),
        page_title(F.col("html")).alias("title"),
        *counts,
        F.size(hrefs).cast("bigint").alias("links"),
        F.size(F.array_distinct(F.filter(hrefs, lambda h: contains_any(h, NEWS_LINK_PARTS)))).cast("bigint").alias(
            "news_links"
        ),
    )


def author_anchors(html: Column) -> Column:
    """Texts of author links joined by ``and``; null if there is none."""
    tags = F.regexp_extract_all(html, F.lit("(?is)<a\\s[^>]*href\\s*=\\s*[\"'][^\"']*/author/[^>]*>.*?</a>"), F.lit(0))
    names = F.transform(tags, lambda tag: strip(decode_entities(F.regexp_replace(tag, INLINE, ""))))
    return F.nullif(F.array_join(names, " and "), F.lit(""))
