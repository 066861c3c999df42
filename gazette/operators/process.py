"""Raw articles to processed articles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions.text import detect_language, evaluate_once, json_literal, strip_html, tokenize


def source_id_lookup(name: Column) -> Column:
    """Source id of a name, 1 for unknown names; a literal map, so no join."""
    ids = json_literal(L.SOURCE_IDS, "map<string,int>")
    return F.coalesce(F.element_at(ids, F.coalesce(name, F.lit(""))), F.lit(L.DEFAULT_SOURCE_ID))


def length_caps(df: DataFrame) -> DataFrame:
    """Column limits of stores with fixed widths, in characters; no plan of the library applies them."""
    return df.withColumns(
        {
            "title": F.substring("title", 1, L.TITLE_CHARS),
            "content": F.substring("content", 1, L.CONTENT_CHARS),
            "source_url": F.substring("source_url", 1, L.URL_CHARS),
        }
    )


def process_articles(
    raw: DataFrame, zh_chars: int | None = None, en_chars: int | None = None
) -> DataFrame:
    """Clean, type and tokenise; articles without title, content or terms are dropped.

    Whole texts are tokenised; a limit of characters can be given for either language.
    Needs title, content, source_url, source_name, category_hint and country_hint;
    other columns are kept.
    """
    clean = evaluate_once(
        raw, {"title": strip_html(F.col("title")), "content": strip_html(F.col("content"))}
    ).where((F.col("title") != "") & (F.col("content") != ""))
    typed = evaluate_once(clean, {"language": detect_language(F.concat("title", "content"))})
    termed = evaluate_once(
        typed,
        {
            "title_terms": tokenize(F.col("title"), F.col("language")),
            "content_terms": tokenize(F.col("content"), F.col("language"), zh_chars, en_chars),
            "source_id": source_id_lookup(F.col("source_name")).cast("int"),
            "hint_country": F.col("country_hint"),
            "hint_category": F.col("category_hint"),
        },
    )
    counted = termed.withColumn("term_count", F.size("title_terms") + F.size("content_terms"))
    return counted.where("term_count > 0").drop("country_hint", "category_hint")
