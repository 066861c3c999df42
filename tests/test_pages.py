"""Extraction from pages."""

from pyspark.sql import functions as F

from gazette.operators import page_media, pages
from gazette.sources.profiles import open_tag_pattern, site_profiles


def extract(spark, html, url="https://s/x", site=None):
    df = spark.createDataFrame([(1, url, html)], "page_id long, url string, html string")
    return pages.main_content(df, site_profiles(spark), site)


def content(spark, html, url="https://s/x", site=None):
    return extract(spark, html, url, site).collect()[0].content


LONG = "word " * 50


def test_first_long_container_wins(spark):
    html = f"<main><p>{LONG}main</p></main><article><p>short text</p></article>"
    assert content(spark, html).endswith("main")
    html = f"<article><p>{LONG}one</p></article><main><p>{LONG}two</p></main>"
    assert content(spark, html).endswith("one")


def test_blocks_nested_repeated_and_dropped(spark):
    html = (
        f"<div class='site-content'>direct<div>intro <p>{LONG}<b> bold </b>tail</p> after</div><nav><p>menu menu</p></nav>"
        f"<p>same line</p><p>same line</p><p>ends with:</p><p>abc</p><h1>not kept</h1><h2>kept head</h2></div><p>outside</p>"
    )
    got = content(spark, html).split("\n\n")
    assert got == ["intro", LONG.strip() + "boldtail", "after", "same line", "kept head"]


def test_paragraph_fallback_and_last_short(spark):
    assert content(spark, "<article><div>tiny text</div></article><p>outer paragraph</p>") == "outer paragraph"
    assert content(spark, "<article><div>tiny text</div></article>") == "tiny text"
    assert content(spark, "nothing here") == ""


def test_unclosed_and_nested_same_tag(spark):
    html = f"<article><p><b>{LONG}<br><p>second</article><p>beyond the end"
    assert content(spark, html).split("\n\n") == [LONG.strip(), "second"]
    html = f"<div id='content'><div><div>{LONG}</div></div>inside</div><div>out</div>"
    frame = extract(spark, html)
    assert frame.collect()[0].container.endswith("inside")


def test_site_rules(spark):
    cnn = f"<article class='x'><p>{'long enough text here ' * 2}</p><p>Advertisement for all of you</p><p>short</p></article>"
    assert content(spark, cnn, "https://edition.cnn.com/a") == ("long enough text here " * 2).strip()
    bbc = "<div data-component='text-block'><p>first block text</p></div><div>x</div><div data-component='text-block'>second block</div>"
    assert content(spark, bbc, "https://www.bbc.com/news/articles/c1") == "first block text\n\nsecond block"
    xinhua = "<div id='detail'><p>正文第一段落</p><p>责任编辑：某 编辑：</p><p>正文第一段落</p></div>"
    assert content(spark, xinhua, "http://www.news.cn/a") == "正文第一段落"


def test_article_gate_and_paywall(spark):
    text = "word " * 30
    rows = [
        (1, "https://www.washingtonpost.com/2024/01/02/a", f"<article><p>{text}</p></article>"),
        (2, "https://www.washingtonpost.com/2024/01/02/b", f"<article><p>{text}</p></article><p>Please Subscribe</p>"),
        (3, "https://www.aljazeera.com/news/a", "<article><p>too short</p></article>"),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = pages.accepted_content(pages.main_content(df, site_profiles(spark)))
    assert [r.page_id for r in got.collect()] == [1]


def test_selectors():
    import re

    found = lambda selector, tag: bool(re.search(open_tag_pattern(selector), tag))
    assert found("article", "<article>") and found("article", '<ARTICLE class="x">') and not found("article", "<article-x>")
    assert found("#detail", '<div id="detail">') and not found("#detail", '<div id="detailContent">')
    assert found(".lead", "<p class='big lead x'>") and not found(".lead", '<p class="leader">')
    assert found('div[class*="story"]', '<div data-a="1" class="my-story">') and not found('div[class*="story"]', '<p class="story">')
    assert not found("#text", '<p data-id="text">')


def test_links_keep_first_and_cap(spark):
    many = "".join(f'<a href="/article/{i % 20}">A long enough title {i}</a>' for i in range(40))
    html = f'<a href="/other/1">Some other title</a><a href="/article/0">tiny</a>{many}'
    df = spark.createDataFrame([(1, "https://www.jiemian.com/lists/4.html", html)], "page_id long, url string, html string")
    got = pages.article_links(df, site_profiles(spark)).orderBy("position").collect()
    assert [r.link for r in got] == [f"https://www.jiemian.com/article/{i}" for i in range(20)]
    assert pages.article_links(df, site_profiles(spark), capped=True).count() == 15
    assert got[0].link_title == "A long enough title 0"


def test_images(spark):
    html = '<article><img src="/a.jpg"><img src="/logo.png"><img data-src="//c/d.jpg"></article>'
    got = extract(spark, html).select(page_media.page_images(F.col("container"), F.col("url"))).collect()[0][0]
    # the article has no text, so it is no container for the generic rule
    direct = spark.createDataFrame([(html,)], "h string").select(page_media.page_images(F.col("h"), F.lit("https://s/x"))).collect()[0][0]
    assert [i.url for i in direct] == ["https://s/a.jpg", "https://c/d.jpg"]
    assert got == []


def test_image_captions_and_rewrite(spark):
    html = '<figure><img src="i-thumbLarge.jpg" title="T"><figcaption> A <b>cap</b></figcaption></figure><img src="i-thumbLarge.jpg">'
    got = spark.createDataFrame([(html,)], "h string").select(page_media.page_images(F.col("h"), F.lit("https://s/a/x"))).collect()[0][0]
    assert [(i.url, i.alt, i.caption) for i in got] == [("https://s/a/i-master1050.jpg", "T", "Acap")]


def test_videos(spark):
    html = (
        '<video src="/v.mp4"><source src="/v.mp4"><source src="/w.webm"></video><iframe src="https://vimeo.com/1"></iframe>'
        '<iframe src="https://bat.bing.com/x"></iframe><script>f("https://c/x.m3u8")</script>'
    )
    df = spark.createDataFrame([(html,)], "h string")
    got = df.select(page_media.page_videos(F.col("h"), F.lit("https://s/x"), F.col("h"))).collect()[0][0]
    assert [(v.url, v.type, v.platform) for v in got] == [
        ("https://s/v.mp4", "direct", "unknown"),
        ("https://s/w.webm", "source", "unknown"),
        ("https://vimeo.com/1", "iframe", "vimeo"),
        ("https://c/x.m3u8", "script", "unknown"),
    ]


def test_no_shuffle_and_no_python(spark):
    df = extract(spark, "<article><p>x</p></article>")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "hashpartitioning" not in plan


def test_media_of_a_page_without_an_address(value):
    """Addresses that can't be made absolute aren't one address; what repeats in the markup does."""
    html = '<img src="/a.jpg"><img src="//c.example/b.png"><img src="d.jpg"><img src="/a.jpg"><video src="/v.mp4"><source src="/v.webm"></video>'
    html += '<iframe src="https://youtu.be/x"></iframe><video src="/v.mp4"></video>'
    none = F.col("url").cast("string")
    images = value(page_media.page_images(F.col("html"), none), html=html, url=None)
    assert [i.url for i in images] == [None, "https://c.example/b.png", None]
    videos = value(page_media.page_videos(F.col("html"), none, F.col("html")), html=html, url=None)
    assert [(v.url, v.type) for v in videos] == [(None, "direct"), (None, "source"), ("https://youtu.be/x", "iframe")]


def test_page_articles_query_has_titles_as_written(spark, tmp_path):
    """The query's SQL reads the heading as the markup has it, references included."""
    from gazette.checks import queries

    page = "<html><body><h1>A &amp; B &lt;</h1><article><p>" + "word " * 100 + "</p></article></body></html>"
    spark.createDataFrame([(0, "https://x.example/", page)], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    assert [r.title for r in queries.page_articles(spark, str(tmp_path)).collect()] == ["A &amp; B &lt;"]


def test_media_queries_list_media_of_an_article_without_text(spark, tmp_path):
    """A word of two letters is no block, but its article's pictures and players are still there, as the SQL has them."""
    import duckdb

    from gazette.checks import oracle, queries

    page = "<html><body><nav><p>menu</p></nav><article><h1>De.</h1><p><b>De.<br></article></body></html>"
    rows = [(7, "https://x.example/de/7", page), (8, "https://x.example/de/8/", page.replace("De.", "long enough " * 30))]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    for name in ("page_images", "page_videos"):
        got = queries.queries()[name](spark, str(tmp_path))
        want = con.execute(oracle.oracle_sql()[name])
        names = [c[0] for c in want.description]
        assert sorted(tuple(r) for r in got.select(names).collect()) == sorted(want.fetchall())
