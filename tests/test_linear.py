"""Pages with very many parts, and raw articles out of pages."""

import time

from pyspark.sql import functions as F

from gazette.functions.text import first_by
from gazette.operators import page_media, pages
from gazette.plans.articles import page_articles
from gazette.sources import profiles


def test_first_by(value):
    items = F.from_json(F.lit('[{"k":"b","v":1},{"k":"a","v":2},{"k":"b","v":3},{"k":null,"v":4},{"k":"a","v":5},{"k":null,"v":6}]'), "array<struct<k:string,v:int>>")
    assert [r.v for r in value(first_by(items, "k"))] == [1, 2, 4]
    assert value(first_by(F.from_json(F.lit("[]"), "array<struct<k:string,v:int>>"), "k")) == []


def test_blocks_do_not_depend_on_the_runs(value, monkeypatch):
    html = "<div>a<p>b</p>c<section>d<div>e</div></section>f</div>g<p>h</p></div></li><li>i<ul><p>j</p></ul>k</li>l" * 40
    blocks = lambda allowed: value(pages.text_blocks(F.lit(html), F.array(*map(F.lit, allowed))))
    whole = {allowed: blocks(allowed) for allowed in (("p",), ("p", "div"), ("p", "li", "section"))}
    monkeypatch.setattr(pages, "RUN", 3)
    assert {allowed: blocks(allowed) for allowed in whole} == whole
    assert whole[("p",)] == ["b", "h", "j"] * 40


def timed(spark, n):
    body = "".join(f"<p>paragraph {i} here</p><a href='/news/{i % (n // 2)}'>link {i}</a><img src='/i/{i % (n // 2)}.jpg'>" for i in range(n))
    df = spark.createDataFrame([(1, "https://x.example/", f"<article>{body}</article>")], "page_id long, url string, html string")
    rules = profiles.site_profiles(spark)
    began = time.time()
    assert pages.article_links(df, rules).count() == n // 2
    content = pages.main_content(df, rules).select(F.size(F.split("content", "\n\n"))).first()[0]
    images = df.select(F.size(page_media.page_images(F.col("html"), F.col("url")))).first()[0]
    assert content == n and images == n // 2
    return time.time() - began


def test_twenty_thousand_parts_take_linear_time(spark):
    timed(spark, 1000)
    small, large = timed(spark, 2000), timed(spark, 20_000)
    assert large < 10 * max(small, 1.0) * 2


def test_pages_become_articles(spark):
    body = "<h1>A &amp; B</h1>" + "".join(f"<p>Sentence number {i} of the story.</p>" for i in range(20))
    media = "<figure><img src='https://media.cnn.com/api/v1/images/stellar/prod/a.jpg'><figcaption>cap</figcaption></figure><img src='/b.jpg'><iframe src='https://hotjar.com/x'></iframe><video src='/v'></video><video src='/w.mp4'></video>"
    html = f"<html><head><title>T</title></head><body><article timestamp='2024-01-02 03:04'>{body}{media}</article></body></html>"
    rows = [(1, "https://edition.cnn.com/2024/x", html), (2, "https://www.news.cn/politics/x", html), (3, "https://cn.nytimes.com/a/", html), (4, "https://other.example/", html), (5, "https://other.example/", "<p>short</p>"), (6, "u", None), (7, None, html)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, title string")
    got = {r.page_id: r for r in page_articles(df, profiles.site_profiles(spark), F.lit("2024-01-05 00:00:00").cast("timestamp")).collect()}
    assert {1, 2, 3, 4} <= set(got)
    assert {r.title for r in got.values() if r.page_id < 5} == {"A & B"} and str(got[4].published_at) == "2024-01-02 03:04:00"
    assert [len(got[i].images) for i in (1, 4)] == [1, 2] and got[1].images[0].caption == "cap" and got[1].image_url.endswith("a.jpg")
    urls = {i: [v.url for v in got[i].videos] for i in (2, 3, 4)}
    assert urls[2] == ["https://www.news.cn/v", "https://www.news.cn/w.mp4"]  # videos by their parts, its own host among them
    assert len(urls[3]) == 2 and len(urls[4]) == 3  # trackers go where the site says so
    assert (got[1].source_name, got[1].category_hint, got[1].country_hint, got[1].fetch_method) == ("CNN", "international", "US", "html_cnn")
    assert (got[4].source_name, got[4].category_hint) == ("unknown", None)
