"""Site profiles: what differs from site to site, as rows instead of code."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..session import rows_frame

_SELECTOR = re.compile(r'^([a-z][a-z0-9]*)?(?:#([\w-]+))?(?:\.([\w-]+))?(?:\[([\w-]+)(\*?=)"([^"]+)"\])?$')


def open_tag_pattern(selector: str) -> str:
    """Regular expression of the opening tag a short selector names."""
    tag, ident, name, attr, how, value = _SELECTOR.match(selector).groups()
    if ident:
        attr, how, value = "id", "=", ident
    if name:
        want = f"class\\s*=\\s*[\"'](?:[^\"']*\\s)?{re.escape(name)}(?:\\s[^\"']*)?[\"']"
    elif attr:
        around = "[^\"']*" if how == "*=" else ""
        want = f"{attr}\\s*=\\s*[\"']{around}{re.escape(value)}{around}[\"']"
    else:
        return f"(?i)<{tag}(?:\\s[^>]*)?>"
    return f"(?i)<{tag or '[a-z][a-z0-9]*'}\\s(?:[^>]*\\s)?{want}[^>]*>"


GENERIC_CONTAINERS = [
    "article", "main", 'div[id*="content"]', 'div[id*="article"]', 'div[id*="story"]', 'div[class*="content"]',
    'div[class*="article"]', 'div[class*="story"]', 'div[class*="body"]', 'div[class*="text"]', 'div[class*="post"]',
    "div.main", "#p-detail", ".main-content", "#article-content", ".content-detail", "div.article__body",
    "div.l-container", "section#body-text", "div.zn-body__paragraph", "div.Article__content", "#story_text",
    ".article_content", ".article__body", ".article-paragraph", ".article-body-item",
]
FULL_PAGE_CONTAINERS = [
    "div.article", "div#content", "div.main", "article", "div#article-content", "div.content", "div#main",
    "div#p-detail", "div.news-detail", "section.article",
]
GENERIC_BLOCKS = ["p", "div", "h2", "h3", "h4", "h5", "li"]

# One row per site (fixed values): containers in order, elements that are blocks
# by themselves, block tags, least block length (exclusive), block rule, container
# gate and article gate (exclusive), repeated blocks dropped, paragraph fallback,
# link pattern, least link-title length, link cap, link exclusions, paywall check,
# category hint, country hint, source name, path of article pictures, parts of
# video addresses.
PROFILES = [
    dict(site="generic", containers=GENERIC_CONTAINERS, blocks=GENERIC_BLOCKS, least=3, rule="marks", gate=200,
         article_gate=0, distinct=True, fallback=True, link="", title=1, cap=15),
    dict(site="full_page", containers=FULL_PAGE_CONTAINERS, blocks=["p"], least=0, rule="", gate=0, article_gate=200,
         fallback_least=0, fallback=True, link="", title=1, cap=15),
    dict(site="xinhua", containers=["#detailContent", "#detail", ".article-content", "article"], blocks=["p", "div"],
         least=3, rule="editor", gate=0, article_gate=0, distinct=True, link="\\d{8}/[a-f0-9]+/c\\.html$", title=1,
         cap=50, category="politics", country="CN", source="新华网-时政", video_parts=[".mp4", ".m3u8", "vodpub", "news.cn"]),
    dict(site="cnn", elements=[".paragraph-elevate", ".vossi-paragraph_elevate"],
         containers=["div.article__content", "main.article__main", "article"], blocks=["p", "h2", "h3"], least=20,
         rule="ads", gate=0, article_gate=0, link="edition\\.cnn\\.com/.+", title=0, cap=80, link_skip="/live",
         category="international", country="US", source="CNN", image_path="media.cnn.com/api/v1/images/stellar/prod/"),
    dict(site="jiemian", source="界面新闻", containers=[".article-content", "article"], blocks=["p"], least=3, rule="", gate=0,
         article_gate=30, link="/article/\\d+", title=6, cap=15, category="finance", country="CN"),
    dict(site="aljazeera", source="Al Jazeera", containers=GENERIC_CONTAINERS, blocks=GENERIC_BLOCKS, least=3, rule="marks", gate=200,
         article_gate=100, distinct=True, fallback=True, link="/news/\\d{4}/\\d{1,2}/\\d{1,2}/", title=5, cap=15,
         country="US"),
    dict(site="globaltimes", source="环球时报", containers=[".article_content", ".article_right", 'div[class*="article-content"]',
         'div[class*="article_body"]', "article"], blocks=["p", "div"], least=10, rule="", gate=0, article_gate=100,
         link="/page/\\d{6}/\\d+\\.shtml", title=5, cap=15, country="CN"),
    dict(site="sciencedaily", source="ScienceDaily", containers=["#text", "#story_content", ".lead", '[itemprop="articleBody"]',
         ".article-content"], blocks=["p"], least=0, rule="", gate=200, article_gate=200,
         link="/releases/\\d{4}/\\d{2}/", title=11, cap=20, category="science", country="US"),
    dict(site="sputnik", source="俄罗斯卫星通讯社", elements=[".article__text", ".article__quote-text"],
         containers=[".b-article__text", '[itemprop="articleBody"]', "article"], blocks=["p"], least=3, rule="",
         gate=100, article_gate=0, link="/\\d{8}/", title=11, cap=10, category="international", country="RU"),
    dict(site="nytimes_cn", source="纽约时报中文版", elements=[".article-paragraph"], containers=[".article-body-item", ".article-content",
         '[itemprop="articleBody"]', "article"], blocks=["p", "div"], least=0, rule="", gate=0, article_gate=0,
         link="/[a-z]+/\\d{8}/[a-z0-9-]+/$", title=11, cap=8, link_skip="/slideshow/|/video/|/author/",
         trackers=True, category="international", country="US"),
    dict(site="bbc", source="BBC", elements=['div[data-component="text-block"]'], containers=["article",
         '[data-testid="article-body"]', ".ssrcss-pv1rh6-ArticleWrapper"], blocks=["p"], least=10, rule="", gate=0,
         article_gate=100, link="/news/articles/[a-z0-9]+", title=11, cap=15, country="GB"),
    dict(site="nytimes", containers=["article", 'div[class*="article"]', 'div[id*="article"]'], blocks=["p"], least=5,
         rule="", gate=0, article_gate=0, link="/[a-z-]+/\\d{8}/", title=1, cap=15, country="HK"),
    dict(site="cctv", containers=['div[id*="content"]', 'div[class*="body"]', "article", "div.detail-text",
         'div[class*="article-content"]'], blocks=["p"], least=5, rule="", gate=0, article_gate=0,
         link="/\\d{4}/\\d{2}/\\d{2}/[A-Z]+", title=3, cap=15, category="资讯", country="CN"),
    dict(site="guancha", containers=["article", 'div[class*="article-content"]', 'div[id*="content"]'], blocks=["p"],
         least=5, rule="", gate=0, article_gate=0, link="guancha\\.cn/[a-z-]+/\\d{4}_\\d{2}_\\d{2}", title=3, cap=15,
         country="CN"),
    dict(site="washingtonpost", containers=["article", 'div[itemprop="articleBody"]', 'section[data-testid*="body"]',
         'div[class*="article-content"]'], blocks=["p"], least=5, rule="", gate=0, article_gate=0,
         link="/\\d{4}/\\d{2}/\\d{2}/", title=3, cap=15, paywall=True, country="US"),
]

SCHEMA = (
    "site string, containers array<string>, elements array<string>, blocks array<string>, least int, rule string, "
    "gate int, article_gate int, distinct_blocks boolean, fallback boolean, fallback_least int, link_rx string, "
    "link_title int, link_cap int, link_skip string, paywall boolean, trackers boolean, category_hint string, "
    "country_hint string, source string, image_path string, video_parts array<string>"
)


def _row(p: dict) -> tuple:
    return (
        p["site"],
        [open_tag_pattern(s) for s in p["containers"]],
        [open_tag_pattern(s) for s in p.get("elements", [])],
        p["blocks"],
        p["least"],
        p["rule"],
        p["gate"],
        p["article_gate"],
        p.get("distinct", False),
        p.get("fallback", False),
        p.get("fallback_least", 5),
        p["link"],
        p["title"],
        p["cap"],
        p.get("link_skip", ""),
        p.get("paywall", False),
        p.get("trackers", False),
        p.get("category"),
        p.get("country"),
        p.get("source"),
        p.get("image_path", ""),
        p.get("video_parts", []),
    )


def site_profiles(spark: SparkSession) -> DataFrame:
    """The rule table; fifteen rows, so it is broadcast wherever it is joined."""
    return rows_frame(spark, [_row(p) for p in PROFILES], SCHEMA)
