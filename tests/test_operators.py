"""Tagging, gating, index and counters on small tables."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gazette.operators import dictionary, gate, index, process, rows, stats, tagging
from gazette.operators.page_media import media_rows
from gazette.sources import seeds

NOW = datetime(2024, 1, 4)
WORDS = [("CN", "China"), ("JP", "Japan"), ("JP", "Tokyo"), ("US", "US"), ("US", "America")]


def articles(spark, rows_):
    return spark.createDataFrame(rows_, "news_id long, title string, content string")


COUNTRY_CASES = [
    (1, "China and US: US talks", "Japan Japan Japan"),
    (2, "Talks", "Tokyo, Japan"),
    (3, "China, Japan", ""),
    (4, "nothing", "nothing"),
    (5, "", "japan us"),
]
COUNTRY_WANT = {1: "US", 2: "JP", 3: "CN", 4: None, 5: None}


def test_identify_country(spark):
    got = tagging.identify_country(articles(spark, COUNTRY_CASES), WORDS)
    assert {r.news_id: r.primary_country for r in got.collect()} == COUNTRY_WANT


def test_identify_country_from_table_and_by_grams(spark):
    table = spark.createDataFrame(WORDS, "country_code string, keyword string")
    for fn in (tagging.identify_country, tagging.identify_country_large):
        got = fn(articles(spark, COUNTRY_CASES), table)
        assert {r.news_id: r.primary_country for r in got.collect()} == COUNTRY_WANT


def test_gram_join_equals_brute_force(spark):
    texts = [(i, "abab cab" * (i % 4) + "中文ab文" * (i % 3)) for i in range(30)]
    words = [("x", "ab"), ("x", "a"), ("y", "文"), ("y", "b c"), ("z", "abab"), ("z", "zz")]
    df = spark.createDataFrame(texts, "news_id long, body_text string")
    table = spark.createDataFrame(words, "code string, keyword string")
    got = {(r[0], r[1], r[2]): r[3] for r in dictionary.keyword_pairs(df, "news_id", "body_text", table).collect()}
    want = {(i, c, w): t.count(w) for i, t in texts for c, w in words if t.count(w)}
    assert got == want


def test_a_dictionary_that_is_no_dimension_is_refused(spark, monkeypatch):
    monkeypatch.setattr(dictionary, "MOST_CHARS", 20)
    table = spark.createDataFrame(WORDS, "country_code string, keyword string")
    with pytest.raises(ValueError, match="keyword_pairs"):
        tagging.identify_country(articles(spark, COUNTRY_CASES), table)
    got = tagging.identify_country_large(articles(spark, COUNTRY_CASES), table)
    assert {r.news_id: r.primary_country for r in got.collect()} == COUNTRY_WANT


def test_trie_of_twenty_thousand_entries(spark):
    """One pass finds exactly what looking for every keyword finds, prefixes, overlaps and signs of patterns among them."""
    random.seed(8)
    letters = "abcdeABC .*+?()[]{}|^$\\-é中国日本ß𝄞\n'\""
    words = {"".join(random.choice(letters) for _ in range(random.randint(1, 9))) for _ in range(24_000)} - {""}
    pairs = [(f"C{random.randint(0, 300)}", w) for w in sorted(words)[:20_000]] + [("C1", "aa"), ("C2", "aa"), ("C3", ""), (None, "b")]
    texts = [(i, "".join(random.choice(letters) for _ in range(random.randint(0, 60)))) for i in range(60)] + [(60, None), (61, ""), (62, "aaaa")]
    df = spark.createDataFrame(texts, "news_id long, body string")
    found = dictionary.trie(pairs)
    plan = df.select("news_id", dictionary.entries_in(found, F.col("body")).alias("e"), dictionary.best_code(found, F.col("body")).alias("best"))
    got = {r["news_id"]: r for r in plan.collect()}
    for i, text in texts:
        want = {(c, w) for c, w in pairs if c and w and w in (text or "")}
        assert {(e["code"], e["keyword"]) for e in got[i]["e"] or []} == want
        totals = {}
        for c, w in want:
            totals[c] = totals.get(c, 0) + text.count(w)
        assert got[i]["best"] == (min(totals, key=lambda c: (-totals[c], c)) if totals else None)


def test_trie_steps_do_not_grow_with_the_keywords():
    """What is tried at one place of a text: alternatives in a row are few however wide the dictionary is."""
    many = dictionary.trie([("X", chr(0x4E00 + i) + "x") for i in range(20_000)])
    level, deepest, run = 0, 0, 0
    for c in many.pattern:
        level += (c == "(") - (c == ")")
        deepest = max(deepest, level)
    assert deepest < 2 * 20 and max(len(b.split("|")) for b in many.pattern.replace("(", ")").split(")")) <= dictionary.BRANCHES + 1


def _coded(spark, rows_, rules=None):
    df = spark.createDataFrame(rows_, "news_id long, title string, content string, source_id int, hint_category string")
    coded = tagging.category_codes(df, rules)
    pairs = tagging.news_categories(coded, seeds.categories(spark)).collect()
    names = {c.category_id: c.category_code for c in seeds.categories(spark).collect()}
    out = {r[0]: [] for r in rows_}
    for p in pairs:
        out[p.news_id].append(names[p.category_id])
    return {k: sorted(v) for k, v in out.items()}


def test_categories(spark):
    got = _coded(
        spark,
        [
            (1, "x", "SCIENCE here", 1, "technology"),
            (2, "x", "y", 2, None),
            (3, "x", "y", 2, "international"),
            (4, "x", "toward", 2, None),
            (5, "x", "y", 18, "sports"),
            (6, "x", "y", 1, "health"),
            (7, "x", "y" * 1000 + " war", 2, None),
            (8, "Pârliament", "y", 2, None),
            (9, "x", "y", 2, "Sports"),
        ],
    )
    assert got == {
        1: ["tech"], 2: ["else"], 3: [], 4: ["military"], 5: ["tech"], 6: ["else"], 7: ["military"], 8: ["politics"], 9: ["sports"]
    }


def test_categories_from_a_table(spark):
    table = spark.createDataFrame(tagging.category_rules(), "category_code string, keyword string")
    rows_ = [(1, "x", "SCIENCE war", 2, None), (2, "x", "y", 18, None), (3, "x", "y", 2, None)]
    assert _coded(spark, rows_, table) == {1: ["military", "tech"], 2: ["tech"], 3: ["else"]}
    df = spark.createDataFrame(rows_, "news_id long, title string, content string, source_id int, hint_category string")
    by_join = tagging.category_codes_large(df, table).collect()
    assert {r.news_id: sorted(r.category_codes) for r in by_join} == {1: ["military", "tech"], 2: ["tech"], 3: ["else"]}


def _gate(spark, rows_, stored=None):
    df = spark.createDataFrame(rows_, "news_id long, title string, content string, source_url string, published_at timestamp")
    kept = None if stored is None else spark.createDataFrame(stored, "news_id long, source_url string")
    out = gate.gate_articles(df, F.lit(str(NOW)).cast("timestamp"), kept)
    return {r.news_id: r.status for r in out.collect()}


def test_gate_boundaries(spark):
    edge = NOW - timedelta(hours=48)
    body = "c" * 60
    got = _gate(
        spark,
        [
            (1, "t", "c" * 59, "u1", None),
            (2, "t", body, "u2", edge),
            (3, "t", body, "u3", edge - timedelta(seconds=1)),
            (4, "t", body, "u4", None),
            (5, "  ", body, "u5", None),
            (6, "t", body, "http://x/A", None),
            (7, "t", body, "http://x/a ", None),
            (8, "t", body, "u3", None),
            (9, "t", "c", "http://x/a", None),
            (10, "t", body, "U3", edge - timedelta(hours=1)),
        ],
    )
    assert got[1] == "Rejected: Content too short (59 chars)"
    assert [got[i] for i in (2, 4, 6, 8)] == ["Success"] * 4
    assert got[3] == "Rejected: Exceeds 48h limit (published: 2024-01-01 23:59:59)"
    assert got[5] == "Rejected: Title empty"
    assert got[7] == "Rejected: Duplicate URL (id:6)"
    assert got[9].startswith("Rejected: Content too short")
    assert got[10] == "Rejected: Duplicate URL (id:8)"


def test_gate_against_stored(spark):
    got = _gate(spark, [(5, "t", "c" * 60, "HTTP://É/", None)], [(2, "http://e/")])
    assert got[5] == "Rejected: Duplicate URL (id:2)"


def test_hot_address_keeps_one(spark):
    df = spark.range(5000).select(
        (F.col("id") + 1).alias("news_id"), F.lit("t").alias("title"), F.repeat(F.lit("c"), 60).alias("content"),
        F.when(F.col("id") % 3 == 0, "http://same/").otherwise(F.concat(F.lit("http://"), F.col("id"))).alias("source_url"),
        F.lit(None).cast("timestamp").alias("published_at"),
    )
    counts = gate.gate_articles(df, F.lit(str(NOW)).cast("timestamp")).groupBy("status_kind").count().collect()
    assert {r[0]: r[1] for r in counts} == {"ok": 5000 - 1666, "duplicate": 1666}


def test_assign_ids_over_a_hot_value(spark):
    df = spark.range(3000).select(F.col("id"), (F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id") % 11)).alias("at"))
    out = rows.assign_ids(df, ["at", "id"], start=100)
    got = [r.id for r in out.orderBy("news_id").collect()]
    want = [r[1] for r in sorted((5 if i % 3 == 0 else i % 11, i) for i in range(3000))]
    assert got == want
    assert out.agg(F.min("news_id"), F.max("news_id")).collect()[0][:] == (101, 3100)


@pytest.mark.parametrize("deep", [1000, 3])
def test_top_per_group_equals_plain_ranking(spark, monkeypatch, deep):
    monkeypatch.setattr(rows, "DEEP", deep)
    hits = spark.range(2000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 5).alias("g"), F.col("id").alias("k"), (F.col("id") % 17).alias("s")
    )
    top = rows.top_per_group(hits, ["g"], [F.desc("s"), F.desc("k")], 7, "k")
    got = sorted((r.g, r.position, r.k) for r in top.collect())
    want = []
    for g in range(5):
        members = [i for i in range(2000) if (0 if i % 3 == 0 else i % 5) == g]
        want += [(g, p + 1, i) for p, i in enumerate(sorted(members, key=lambda i: (-(i % 17), -i))[:7])]
    assert got == sorted(want)
    assert "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString()


def _indexed(spark):
    return spark.createDataFrame(
        [(1, "en", NOW, ["oil", "price"], ["oil", "a"], "US", "T", "S"), (2, "zh", NOW, ["中国"], [], None, "T", "S")],
        "news_id long, language string, created_at timestamp, title_terms array<string>, content_terms array<string>, "
        "primary_country string, title string, summary string",
    )


def test_build_index(spark):
    got = {(r.term, r.news_id, r.tf_weight, r.xpath_path, r.position) for r in index.build_index(_indexed(spark)).collect()}
    assert got == {
        ("oil", 1, 2.0, "/news/title", 0),
        ("price", 1, 2.0, "/news/title", 1),
        ("oil", 1, 1.0, "/news/content", 1),
        ("US", 1, 1.5, "/news/metadata/country", 0),
        ("中国", 2, 2.0, "/news/title", 0),
    }
    logs = {r.news_id: r.term_count for r in index.index_build_log(_indexed(spark)).collect()}
    assert logs == {1: 4, 2: 1}


def test_process_articles(spark):
    raw = spark.createDataFrame(
        [
            (1, "<b>Oil</b> prices", "<p>rallied today</p>", "u", "CNN", None, None),
            (2, "x", "", "u", "CNN", None, None),
            (3, "of", "to", "u", "CNN", None, None),
            (4, "中国经济", "text", "u", "??", "CN", "tech"),
        ],
        "news_id long, title string, content string, source_url string, source_name string, country_hint string, category_hint string",
    )
    got = {r.news_id: r for r in process.process_articles(raw).collect()}
    assert set(got) == {1, 4}
    assert (got[1].title, got[1].source_id, got[1].title_terms, got[1].term_count) == ("Oil prices", 14, ["oil", "price"], 4)
    assert (got[4].language, got[4].source_id, got[4].hint_country) == ("zh", 1, "CN")


def test_source_stats_follow_arrivals(spark):
    times = [datetime(2024, 1, 2, h) for h in (1, 5)] + [datetime(2024, 1, 3, h) for h in (0, 2, 23)]
    df = spark.createDataFrame([(1, t) for t in times] + [(2, times[0]), (None, times[0])], "source_id int, created_at timestamp")
    got = {r.source_id: (r.total_news, r.today_news, r.last_publish_time) for r in stats.source_stats(df).collect()}
    assert got == {1: (5, 3, times[-1]), 2: (1, 1, times[0])}
    first = stats.source_stats(df.where("created_at < timestamp'2024-01-03 01:00:00'"))
    later = stats.source_stats(df.where("created_at >= timestamp'2024-01-03 01:00:00'"), first)
    assert {r.source_id: (r.total_news, r.today_news, r.last_publish_time) for r in later.collect()} == got


def test_media_rows(spark):
    image, video = "struct<url:string,alt:string,caption:string>", "struct<url:string,type:string,platform:string>"
    df = spark.createDataFrame(
        [
            (1, NOW, [], "u", []),
            (2, NOW, [("", "", ""), ("b" * 900, "", "")], "u", [("v", "", "")]),
            (3, NOW, None, None, None),
        ],
        f"news_id long, created_at timestamp, images array<{image}>, image_url string, videos array<{video}>",
    )
    got = sorted((r.news_id, r.media_type, len(r.media_url), r.is_cover) for r in media_rows(df).collect())
    assert got == [(1, "image", 1, True), (2, "image", 900, False), (2, "video", 1, False)]


def test_unindexed_and_rebuilt(spark):
    news = spark.createDataFrame(
        [(1, "Oil", "prices", "en", NOW), (2, "Gas", "", "en", NOW), (3, "Old", "x", "en", NOW - timedelta(hours=6)), (4, "Coal", "word " * 9000 + "pipeline", "en", NOW)],
        "news_id long, title string, content string, language string, created_at timestamp",
    )
    logs = spark.createDataFrame([(1,)], "news_id long")
    missing = index.unindexed_news(news, logs, F.lit(str(NOW)).cast("timestamp"))
    got = index.rebuild_terms(missing).orderBy("news_id").collect()
    assert [(r.news_id, r.title_terms, sorted(r.content_terms)) for r in got] == [(2, ["gas"], ["gas"]), (4, ["coal"], ["pipeline", "word"])]


@pytest.mark.parametrize("n", [0, 1])
def test_empty_inputs(spark, n):
    df = articles(spark, COUNTRY_CASES).limit(n)
    assert tagging.identify_country(df, []).count() == n


def test_articles_without_address_stay(spark):
    rows = [(1, "t", "c" * 80, None), (2, "t", "c" * 80, None), (3, "t", "c" * 80, "http://a"), (4, "t", "c" * 80, "HTTP://A "), (5, "t", "short", None)]
    df = spark.createDataFrame([(*r, NOW) for r in rows], "news_id long, title string, content string, source_url string, published_at timestamp")
    got = {r.news_id: r.status_kind for r in gate.gate_articles(df, F.lit(str(NOW)).cast("timestamp")).collect()}
    assert got == {1: "ok", 2: "ok", 3: "ok", 4: "duplicate", 5: "short"}
    assert sorted(r.news_id for r in gate.dedupe_url(df).collect()) == [1, 2, 3, 5]


def test_hints_ignore_case(spark):
    df = spark.createDataFrame([(1, "Technology"), (1, "SCIENCE"), (1, "other"), (1, None)], "source_id int, hint string")
    got = df.select(tagging.forced_categories(F.col("source_id"), F.col("hint")).alias("c")).collect()
    assert [r.c for r in got] == [["tech"], ["tech"], ["else"], []]


def test_both_ways_of_a_dictionary_agree(spark):
    pairs = [("X", "aa"), ("X", "aa"), ("X", "aa"), ("Y", "bb"), ("Z", None), (None, "bb"), ("W", "")]
    df = spark.createDataFrame([(1, "aa bb bb", ""), (2, "", "x" * 25000 + " aa"), (3, None, None)], "news_id long, title string, content string")
    table = spark.createDataFrame(pairs, "country_code string, keyword string")
    small = {r.news_id: r.primary_country for r in tagging.identify_country(df, pairs).collect()}
    large = {r.news_id: r.primary_country for r in tagging.identify_country_large(df, table).collect()}
    assert small == large == {1: "Y", 2: "X", 3: None}


def test_few_keywords_are_searched_for_one_by_one(spark):
    """Entries of a small dictionary are a folded literal, and equal what the pattern finds, in ASCII and other texts."""
    from dataclasses import replace

    found = dictionary.trie([("x", "ab"), ("y", "abc"), ("x", "科学"), ("z", "é"), ("y", "ab")])
    df = spark.createDataFrame([("zabcé",), ("科学 ab",), ("none",), ("",), (None,)], "body string")
    both = df.select(dictionary.matching_codes(found, F.col("body")).alias("a"), dictionary.matching_codes(replace(found, few=None), F.col("body")).alias("b"))
    assert [r.a for r in both.collect()] == [r.b for r in both.collect()] == [["x", "y", "z"], ["x", "y"], [], [], None]
    plan = both.select("a")._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan and "from_json" not in plan
