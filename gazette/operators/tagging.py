"""Country and category tags of articles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions.text import evaluate_once, fold, fold_key, fold_literal, strings
from .dictionary import best_code, keyword_pairs, matching_codes, pairs_of, trie


def category_rules() -> list[tuple[str, str]]:
    return [(code, word) for code, words in L.CATEGORY_KEYWORDS.items() for word in words]


def identify_country(articles: DataFrame, keywords, out: str = "primary_country") -> DataFrame:
    """At most one country per article: the title decides, else the content.

    Within the deciding text the country with most keyword occurrences wins and
    the smaller code on a tie. ``articles`` needs news_id, title and content;
    ``keywords`` are (code, keyword) pairs or a DataFrame(country_code, keyword).
    """
    found = trie(pairs_of(keywords, "country_code"))
    title = best_code(found, F.coalesce("title", F.lit("")))
    content = best_code(found, F.coalesce("content", F.lit("")))
    return evaluate_once(articles, {out: F.coalesce(title, content)})


def identify_country_large(articles: DataFrame, keywords: DataFrame, out: str = "primary_country") -> DataFrame:
    """The same for a dictionary that is no dimension table, by joins."""
    entries = keywords.select(F.col("country_code").alias("code"), "keyword")
    by_field = None
    for rank, field in enumerate(("title", "content")):
        found = keyword_pairs(articles, "news_id", field, entries).withColumn("field", F.lit(rank))
        by_field = found if by_field is None else by_field.unionByName(found)
    totals = by_field.groupBy("news_id", "field", "code").agg(F.sum("times").alias("times"))
    best = totals.groupBy("news_id").agg(
        F.min(F.struct("field", (-F.col("times")).alias("order"), "code"))["code"].alias(out)
    )
    return articles.join(best, "news_id", "left")


def forced_categories(source_id: Column, hint: Column) -> Column:
    """Categories decided by the source alone, as an array of codes."""
    mapped = None
    for given, code in L.API_HINT_CATEGORY.items():
        same = fold_key(hint) == fold_literal(given)
        mapped = F.when(same, code) if mapped is None else mapped.when(same, code)
    mapped = mapped.otherwise(L.API_OTHER_CATEGORY)
    from_api = F.when((source_id == L.API_SOURCE_ID) & (F.coalesce(hint, F.lit("")) != ""), F.array(mapped))
    from_tech = F.when(source_id == L.TECH_SOURCE_ID, strings(["tech"]))
    return F.concat(F.coalesce(from_api, strings([])), F.coalesce(from_tech, strings([])))


def category_text(title: Column, content: Column) -> Column:
    """The text that category keywords are looked up in, folded once."""
    return fold(F.concat(title, F.lit(" "), content))


def category_codes(articles: DataFrame, rules=None, out: str = "category_codes") -> DataFrame:
    """Adds the array of matched codes: keyword rules, source rules, then the fallback.

    ``rules`` are (code, keyword) pairs or a DataFrame(category_code, keyword).
    """
    if rules is None:
        rules = category_rules()
    forced = forced_categories(F.col("source_id"), F.col("hint_category"))
    found = trie(pairs_of(rules, "category_code"), folded=True)
    # folded in a step of its own: inside the functions of arrays folding takes several times as long
    folded = evaluate_once(articles, {"_text": category_text(F.col("title"), F.col("content"))})
    matched = matching_codes(found, F.col("_text"))
    return _with_fallback(evaluate_once(folded, {out: F.array_distinct(F.concat(matched, forced))}).drop("_text"), out)


def category_codes_large(articles: DataFrame, rules: DataFrame, out: str = "category_codes") -> DataFrame:
    """The same for a dictionary that is no dimension table, by joins."""
    texts = articles.select("news_id", F.concat(F.col("title"), F.lit(" "), F.col("content")).alias("text"))
    entries = rules.select(F.col("category_code").alias("code"), "keyword")
    pairs = keyword_pairs(texts, "news_id", "text", entries, folded=True)
    codes = pairs.groupBy("news_id").agg(F.sort_array(F.collect_set("code")).alias("found"))
    forced = forced_categories(F.col("source_id"), F.col("hint_category"))
    both = F.array_distinct(F.concat(F.coalesce("found", strings([])), forced))
    return _with_fallback(articles.join(codes, "news_id", "left").withColumn(out, both).drop("found"), out)


def _with_fallback(articles: DataFrame, out: str) -> DataFrame:
    hint = F.coalesce("hint_category", F.lit(L.FALLBACK_CATEGORY))
    return articles.withColumn(out, F.when(F.size(out) == 0, F.array(hint)).otherwise(F.col(out)))


def news_categories(articles: DataFrame, categories: DataFrame, *carried: str) -> DataFrame:
    """Category rows, with the ``carried`` columns of their article; a code that no category has yields no row.

    ``categories`` is the seven-row dimension; the inner join drops unknown hints.
    """
    codes = articles.select("news_id", *carried, F.explode("category_codes").alias("code")).select(
        "news_id", *carried, fold(F.col("code")).alias("code")
    )
    known = categories.select("category_id", fold(F.col("category_code")).alias("code"))
    return codes.join(known, "code").select(
        "news_id", "category_id", F.lit(1.0).cast("float").alias("confidence"), *carried
    )


def news_countries(articles: DataFrame, *carried: str) -> DataFrame:
    """Country rows, with the ``carried`` columns of their article, of the articles that have a primary country."""
    return articles.where("primary_country is not null").select(
        "news_id",
        F.col("primary_country").alias("country_code"),
        F.lit(True).alias("is_primary"),
        F.lit(1).alias("mention_count"),
        *carried,
    )
