"""The inverted index: postings, build log, coverage and term statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions.text import article_xml, evaluate_once, fold_key, tokenize


def _postings(terms: Column, weight: float, path: str, field: str) -> Column:
    return F.transform(
        F.array_sort(terms),
        lambda term, place: F.struct(
            term.alias("term"),
            F.lit(weight).alias("tf_weight"),
            F.lit(path).alias("xpath_path"),
            F.lit(field).alias("field_type"),
            place.cast("int").alias("position"),
        ),
    )


def build_index(articles: DataFrame) -> DataFrame:
    """One posting per title term, content term and country code.

    ``articles`` needs news_id, title_terms, content_terms, primary_country,
    language and created_at. The three fields of an article become one array that
    is exploded once, so the articles are read a single time and nothing is
    shuffled. Terms of an array are distinct, so (term, news_id, path, position)
    is unique without a deduplication.
    """
    country = F.coalesce(
        F.when(F.col("primary_country").isNotNull(), F.array("primary_country")), F.array().cast("array<string>")
    )
    postings = F.concat(
        _postings(F.col("title_terms"), L.TITLE_WEIGHT, L.TITLE_PATH, "title"),
        _postings(F.col("content_terms"), L.CONTENT_WEIGHT, L.CONTENT_PATH, "content"),
        _postings(country, L.COUNTRY_WEIGHT, L.COUNTRY_PATH, "metadata"),
    )
    long_enough = F.filter(postings, lambda p: F.length(p["term"]) >= 2)
    listed = evaluate_once(
        articles.select("news_id", "language", "created_at", "title_terms", "content_terms", "primary_country"),
        {"postings": long_enough},
    )
    return listed.select("news_id", "language", "created_at", F.inline("postings")).select(
        "term",
        "news_id",
        "tf_weight",
        "xpath_path",
        "field_type",
        "language",
        "position",
        "created_at",
        fold_key(F.col("term")).alias("term_key"),
    )


def with_xml(articles: DataFrame) -> DataFrame:
    """Adds the stored record of each indexed article."""
    xml = article_xml(
        F.col("news_id"), F.col("language"), F.col("title"), F.col("summary"), F.col("primary_country")
    )
    return articles.withColumn("xml_content", xml)


def index_build_log(articles: DataFrame) -> DataFrame:
    """One log row per article with its true number of postings, read off the arrays."""
    size = lambda terms: F.size(F.filter(F.col(terms), lambda term: F.length(term) >= 2))
    country = F.when(F.length("primary_country") >= 2, 1).otherwise(0)
    return articles.select(
        "news_id",
        (size("title_terms") + size("content_terms") + country).alias("term_count"),
        F.col("created_at").alias("build_time"),
        F.lit(L.BUILD_METHOD).alias("build_method"),
    )


def unindexed_news(news: DataFrame, logs: DataFrame, as_of: Column, hours: int = 6, most: int | None = None) -> DataFrame:
    """Recent articles without a build log; ``most`` of them, smallest id first, if given."""
    recent = news.where(F.col("created_at") > as_of - F.make_interval(hours=F.lit(hours)))
    missing = recent.join(logs.select("news_id"), "news_id", "left_anti")
    return missing.orderBy("news_id").limit(most) if most else missing


def rebuild_terms(unindexed: DataFrame) -> DataFrame:
    """Terms from title and content (the title where there is no content)."""
    text = F.when(F.coalesce("content", F.lit("")) == "", F.col("title")).otherwise(F.col("content"))
    return unindexed.withColumns(
        {
            "title_terms": tokenize(F.col("title"), F.col("language")),
            "content_terms": tokenize(text, F.col("language")),
        }
    )


def postings_lookup(index: DataFrame, term: str) -> DataFrame:
    """Postings of a term, heaviest first."""
    key = fold_key(F.lit(term))
    return (
        index.where(F.col("term_key") == key)
        .select("term", "news_id", "tf_weight", "xpath_path")
        .orderBy(F.desc("tf_weight"), "news_id", "xpath_path")
    )


def index_coverage(news: DataFrame, as_of: Column) -> DataFrame:
    """Articles of the window, indexed, missing, and the percentage."""
    recent = news.where(F.col("created_at") > as_of - F.make_interval(hours=F.lit(L.WINDOW_HOURS)))
    has = F.count_if(F.col("xml_content").isNotNull())
    return recent.agg(
        F.count("*").alias("total_news"),
        has.alias("indexed_news"),
        F.count_if(F.col("xml_content").isNull()).alias("missing_xml"),
        F.round(has * F.lit(100.0) / F.count("*"), 2).alias("coverage_percent"),
    )


def index_language_stats(index: DataFrame, as_of: Column) -> DataFrame:
    """Per language: postings, distinct terms, distinct articles, mean weight.

    There are only two languages, so distinct counts by language alone would end
    in two tasks. Terms and articles are counted one level below first: postings
    are reduced per (language, term) and per (language, article), each a
    well-spread key, and only the counts meet in the language group.
    """
    recent = index.where(F.col("created_at") > as_of - F.make_interval(hours=F.lit(L.WINDOW_HOURS)))
    by_term = recent.groupBy("language", "term").agg(
        F.count("*").alias("rows"), F.sum("tf_weight").alias("weight")
    )
    terms = by_term.groupBy("language").agg(
        F.sum("rows").alias("term_count"), F.count("*").alias("unique_terms"), F.sum("weight").alias("weight")
    )
    covered = recent.select("language", "news_id").distinct().groupBy("language").agg(
        F.count("*").alias("covered_news")
    )
    return terms.join(covered, "language").select(
        "language",
        "term_count",
        "unique_terms",
        "covered_news",
        F.round(F.col("weight") / F.col("term_count"), 6).alias("avg_weight"),
    )


def top_terms(index: DataFrame, as_of: Column, hours: int = 6, most: int = 20) -> DataFrame:
    """The most frequent terms of the last hours."""
    recent = index.where(F.col("created_at") > as_of - F.make_interval(hours=F.lit(hours)))
    return (
        recent.groupBy("term", "language")
        .agg(F.count("*").alias("doc_freq"), F.sum("tf_weight").alias("total_weight"))
        .orderBy(F.desc("doc_freq"), "term", "language")
        .limit(most)
    )
