"""Query parsing, dispatch, paging, responses and serving on a small corpus."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gazette.operators import index
from gazette.plans import serve, sru
from gazette.plans.search import Corpus, Request, parse_queries, requests_frame, search, search_answers
from gazette.sources.export import read_committed, write_news_tables
from gazette.sources import corpus as C

NOW = datetime(2024, 1, 4)
AS_OF = lambda: F.lit(str(NOW)).cast("timestamp")

ARTICLES = [
    (1, "Oil price up", "trade war in markets", NOW - timedelta(hours=1), "US"),
    (2, "Price of oil", "elections trade", NOW - timedelta(hours=2), "CN"),
    (3, "Élan vital", "oil oil oil", NOW - timedelta(hours=3), "US"),
    (4, "Old oil price", "trade", NOW - timedelta(hours=48), "US"),
    (5, "中国经济增长", "中国经济报道", NOW - timedelta(hours=4), None),
    (6, "100% sure", "trade", NOW - timedelta(hours=2), None),
]


@pytest.fixture(scope="module")
def tables(spark):
    news = spark.createDataFrame(
        ARTICLES, "news_id long, title string, content string, created_at timestamp, primary_country string"
    ).withColumn("language", F.when(F.col("news_id") == 5, "zh").otherwise("en"))
    news = index.with_xml(news.withColumn("summary", F.col("content"))).cache()
    countries = news.where("primary_country is not null").select(
        "news_id", F.col("primary_country").alias("country_code"), F.lit(True).alias("is_primary"), F.lit(1).alias("mention_count")
    )
    return Corpus(news, countries, index.build_index(C.with_terms(news)))


def found(tables, *requests, **kw):
    rows = search(tables, list(requests), AS_OF(), **kw).orderBy("query_id", "position").collect()
    return [(r.query_id, r.news_id, r.score, r.total) for r in rows]


@pytest.mark.parametrize(
    "query, kind, terms, clean",
    [
        ("Trade AND war in EU", "ranked", ["trade", "and", "war"], "Trade AND war in EU"),
        ("country:us", "country", ["us"], "us"),
        ("http://x", "ranked", ["http"], "http://x"),
        ("Title: a:b", "title", [], "a:b"),
        ("content:Oil oil", "ranked", ["oil", "oil"], "Oil oil"),
        ("other:oil", "ranked", ["other", "oil"], "other:oil"),
        ("a中国 经济中国", "ranked", ["中国", "国 ", "经济", "济中"], "a中国 经济中国"),
        (" * ", "latest", [], " * "),
        ("", "ranked", [], ""),
    ],
)
def test_parse(spark, query, kind, terms, clean):
    row = parse_queries(requests_frame(spark, [Request(query)])).collect()[0]
    assert (row.kind, row.terms, row.clean) == (kind, terms, clean)


def test_ranked_scores_and_threshold(tables):
    # oil stands in title and content of none; in the title of 1 and 2, in the content of 3
    assert found(tables, Request("oil trade")) == [(0, 1, 3.0, 4), (0, 2, 3.0, 4), (0, 6, 1.0, 4), (0, 3, 1.0, 4)]
    # five terms, at least 2.5 of them
    assert found(tables, Request("oil price trade zzz yyy")) == [(0, 1, 5.0, 2), (0, 2, 5.0, 2)]
    assert found(tables, Request("content:oil")) == [(0, 3, 1.0, 1)]


def test_stemming_is_an_option(tables):
    assert found(tables, Request("elections")) == []
    assert found(tables, Request("elections"), stem_query=True) == [(0, 2, 1.0, 1)]


def test_title_phrase_then_keywords(tables):
    assert found(tables, Request("title:oil price")) == [(0, 1, 2.0, 1)]
    assert found(tables, Request("title:oil-price")) == [(0, 1, 1.5, 2), (0, 2, 1.5, 2)]
    assert found(tables, Request("title:ELAN")) == [(0, 3, 2.0, 1)]
    assert found(tables, Request("title:0% s")) == [(0, 6, 2.0, 1)]
    assert found(tables, Request("title:%")) == [(0, 6, 2.0, 1)]
    assert found(tables, Request("title:")) == []
    # a page beyond the phrase hits falls back to keywords, like an empty phrase page
    assert found(tables, Request("title:oil price", start=2)) == [(0, 2, 1.5, 2)]


def test_country_latest_and_pages(tables):
    assert [r[1] for r in found(tables, Request("country:us"))] == [1, 3]
    assert found(tables, Request("country:u")) == []
    assert [r[1] for r in found(tables, Request("*"))] == [1, 6, 2, 3, 5]
    assert found(tables, Request("*", start=2, max_records=2)) == [(0, 6, 1.0, 5), (0, 2, 1.0, 5)]
    assert found(tables, Request("*", start=99)) == []


def test_chinese(tables):
    assert found(tables, Request("中国经济")) == [(0, 5, 9.0, 1)]


def test_many_requests_in_one_call(tables):
    got = found(tables, Request("oil trade", max_records=1), Request("country:CN"), Request("*", max_records=1), Request("title:vital"), Request("nothing"))
    assert [(r[0], r[1]) for r in got] == [(0, 1), (1, 2), (2, 1), (3, 3)]


def test_response_round_trip(tables):
    result = search(tables, [Request("*", max_records=3), Request("a<b & oil")], AS_OF())
    response = sru.sru_response(result)
    rows = {r.query_id: r.response for r in response.collect()}
    assert "<numberOfRecords>5</numberOfRecords>" in rows[0] and rows[0].count("<record>") == 3
    assert "<query>a&lt;b &amp; oil</query>" in rows[1]
    back = sru.sru_parse(response).where("query_id = 0").orderBy(F.desc("time"), F.desc("id")).collect()
    assert [(r.id, r.title, r.country) for r in back][0] == (1, "Oil price up", "US")
    assert back[0].time == "2024-01-03 23:00:00" and back[0].summary == "trade war in markets..."


def test_every_request_has_an_answer(tables):
    asked = [Request("oil trade", max_records=1), Request("nothing"), Request("*", start=99), Request("title:oil price", start=2), Request("title:oil price", start=9), Request("title:"), Request("*", 2, 2), Request("*", 4, 9)]
    found_ = search_answers(tables, asked, AS_OF())
    got = [(r.query_id, r.total, r.page_count, r.first_position) for r in found_.answers.orderBy("query_id").collect()]
    assert got == [(0, 4, 1, 1), (1, 0, 0, None), (2, 5, 0, None), (3, 2, 1, 2), (4, 1, 0, None), (5, 0, 0, None), (6, 5, 2, 2), (7, 5, 2, 4)]
    texts = {r.query_id: r.response for r in sru.sru_response(found_.pages, found_.answers).collect()}
    assert len(texts) == len(asked) and "<numberOfRecords>5</numberOfRecords><records></records>" in texts[2] and "<numberOfRecords>0<" in texts[1]
    pages = {(r.query_id, r.news_id) for r in found_.pages.collect()}
    assert {k for q, k in pages if q == 6} == {6, 2} and {k for q, k in pages if q == 7} == {3, 5}


def test_limits_come_before_the_shuffle(tables):
    requests = [Request("*"), Request("oil trade"), Request("country:us"), Request("title:oil"), Request("title:price", 5000, 20)]
    plan = search(tables, requests, AS_OF())._jdf.queryExecution().executedPlan().toString()
    assert "20, Partial" in plan and "20, Final" in plan and "pmod(xxhash64(news_id" in plan  # the deep one goes in slices
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_days_before_the_window_are_not_read(spark, tables, tmp_path):
    root = str(tmp_path)
    news = tables.news.unionByName(tables.news.withColumns({"news_id": F.col("news_id") + 100, "created_at": F.col("created_at") - F.expr("interval 9 days")}))
    dated = tables.index.unionByName(tables.index.withColumns({"news_id": F.col("news_id") + 100, "created_at": F.col("created_at") - F.expr("interval 9 days")}))
    write_news_tables({"news": news, "inverted_index": dated}, root, "b0")
    stored = Corpus(read_committed(spark, root, "news"), tables.countries, read_committed(spark, root, "inverted_index"))
    result = search(stored, [Request("oil trade"), Request("*"), Request("title:oil")], AS_OF())
    assert {(r.query_id, r.news_id) for r in result.collect()} == {(r.query_id, r.news_id) for r in search(tables, [Request("oil trade"), Request("*"), Request("title:oil")], AS_OF()).collect()}
    scans = [line for line in result._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan" in line and "ingest_date" in line]
    assert scans and all("ingest_date" in line.split("PartitionFilters: [")[1].split("PushedFilters")[0] and ">=" in line for line in scans)


def test_response_tolerates_bad_records(spark):
    results = spark.createDataFrame(
        [(0, "q", 1, 2, NOW, "<news id='1'><broken", "A & B"), (0, "q", 2, 2, None, None, "C")],
        "query_id int, query string, position long, total long, created_at timestamp, xml_content string, title string",
    )
    response = sru.sru_response(results)
    text = response.collect()[0].response
    assert "<news>A &amp; B</news>" in text and text.count("<datestamp>") == 1
    assert [(r.id, r.title, r.country) for r in sru.sru_parse(response).orderBy("id").collect()] == [(1, "", ""), (2, "", "")]
    junk = spark.createDataFrame([(0, "<not a response"), (1, "")], "query_id int, response string")
    assert sru.sru_parse(junk).count() == 0


def test_response_xml_is_readable(spark, tables):
    import xml.etree.ElementTree as ET

    text = sru.sru_response(search(tables, [Request("*")], AS_OF())).collect()[0].response
    root = ET.fromstring(text)
    assert [r.find("recordPosition").text for r in root.iter("record")] == ["1", "2", "3", "4", "5"]


def test_ranked_plan_pushes_terms_and_joins_late(spark, tables, tmp_path):
    path = str(tmp_path / "index")
    tables.index.write.parquet(path)
    stored = Corpus(tables.news, tables.countries, spark.read.parquet(path))
    plan = search(stored, [Request("oil trade")], AS_OF())._jdf.queryExecution().executedPlan().toString()
    pushed = next(part for part in plan.split("PushedFilters: ") if "In(term_key, [oil,trade])" in part)
    assert "GreaterThan(created_at" in pushed.split("ReadSchema")[0]
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_category_page_and_unknown_code(spark, tables):
    from gazette.sources import seeds

    cats = spark.createDataFrame([(i, 3, 1.0) for i in range(1, 7)], "news_id long, category_id int, confidence double")
    news = tables.news.withColumn("summary", F.when(F.col("news_id") == 1, F.repeat(F.lit("s"), 300)))
    got = serve.news_by_category(news, cats, tables.countries, seeds.categories(spark), "economy", AS_OF()).orderBy(F.desc("time"), F.desc("id")).collect()
    assert [r.id for r in got] == [1, 6, 2, 3, 5]
    assert got[0].summary == "s" * 200 + "..." and got[1].summary == "" and got[1].country == ""
    with pytest.raises(ValueError):
        serve.news_by_category(news, cats, tables.countries, seeds.categories(spark), "nope", AS_OF())


def test_detail_prefers_first_cover(spark, tables):
    media = spark.createDataFrame(
        [(1, 1, "image", "b", False), (2, 1, "image", "a", True), (3, 1, "video", "x.m3u8", False), (4, 2, "image", "c", False)],
        "media_id long, news_id long, media_type string, media_url string, is_cover boolean",
    )
    dim = spark.createDataFrame([("US", "United States", 1.0, 2.0)], "country_code string, country_name string, latitude double, longitude double")
    sources = spark.createDataFrame([(1, "S")], "source_id int, source_name string")
    news = tables.news.withColumns({"source_id": F.when(F.col("news_id") == 1, 1).otherwise(9), "published_at": F.col("created_at"), "source_url": F.lit("u")})
    got = {r.id: r for r in serve.news_detail(news, sources, tables.countries, dim, media, ids=[1, 2, 3]).collect()}
    assert set(got) == {1, 2, 3}
    assert [i.url for i in got[1].images] == ["a", "b"] and got[1].cover == "a" and got[1].videos[0].type == "hls"
    assert got[2].cover == "c" and got[2].source_name == "未知来源" and got[2].country_name is None
    assert got[3].images == [] and got[3].cover is None


def test_ranking_drops_unplaced_after_the_limit(spark):
    stats = spark.createDataFrame([(f"C{i}", 20 - i) for i in range(12)], "country_code string, news_count long")
    dim = spark.createDataFrame(
        [(f"C{i}", f"N{i}", None if i == 1 else 1.0, 1.0) for i in range(12)],
        "country_code string, country_name string, latitude double, longitude double",
    )
    got = sorted(r.country_code for r in serve.region_ranking(stats, dim).collect())
    assert got == sorted(f"C{i}" for i in range(10) if i != 1)


def test_tables_of_a_corpus_come_from_one_stored_frame(spark, tmp_path, monkeypatch):
    """Tags and terms cost most; tables that share them read them stored instead of making them anew each."""
    from gazette.checks import queries

    rows = [(i, f"Title {i}\nThe report on place {i}", "en", "web", 9) for i in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    corpus = queries._corpus(spark, str(tmp_path))
    frames = [corpus.news, corpus.countries, corpus.index]
    monkeypatch.setattr(queries.export, "write_news_tables", lambda tables, *_: frames.extend(tables.values()))
    monkeypatch.setattr(queries.export, "read_committed", lambda spark, root, name: spark.range(1).selectExpr("current_date() AS ingest_date"))
    queries.write_news_tables(spark, str(tmp_path))
    assert len(frames) == 3 + 2 * 7
    assert not [f for df in frames for f in df.inputFiles() if "documents.parquet" in f]
