"""Acceptance of processed articles: length, title, duplicate, age."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions.text import fold_key


def _too_short() -> Column:
    return F.length("content") < L.MIN_CONTENT_CHARS


def _untitled() -> Column:
    return F.coalesce(F.trim("title"), F.lit("")) == ""


def _address() -> Column:
    """Folded address; an article without one has a key of its own."""
    return F.coalesce(fold_key(F.col("source_url")), F.concat(F.lit("\u0000"), F.col("news_id").cast("string")))


def _too_old(now: Column) -> Column:
    limit = now - F.make_interval(hours=F.lit(L.WINDOW_HOURS))
    return F.coalesce(F.col("published_at") < limit, F.lit(False))


def gate_articles(articles: DataFrame, now: Column, stored: DataFrame | None = None) -> DataFrame:
    """Adds ``status`` and ``duplicate_of``, in the documented order of checks.

    ``articles`` needs news_id (a unique arrival number), title, content,
    source_url and published_at; ``now`` is the insertion clock. ``stored`` holds
    news_id and source_url of what is in the corpus already.

    Every article keeps its row; one without an address is no duplicate of another.
    Texts stay where they are: numbers and addresses alone are grouped, and what
    comes back to the articles is a row per duplicate. One address may be repeated
    by a third of the batch; its first acceptable arrival is a plain aggregate,
    combined before the shuffle, and the join back is keyed by address, whose other
    side is a single row, so AQE can split it. Stored addresses are looked up by
    those of the batch before they are grouped.
    """
    passes = ~F.coalesce(_too_short(), F.lit(True)) & ~_untitled() & ~_too_old(now)
    keyed = articles.select("news_id", _address().alias("_url"), F.coalesce(passes, F.lit(False)).alias("_passes"))
    firsts = keyed.groupBy("_url").agg(F.min(F.when(F.col("_passes"), F.col("news_id"))).alias("_first"))
    if stored is not None:
        there = stored.select(fold_key(F.col("source_url")).alias("_url"), F.col("news_id").alias("_known"))
        known = there.join(firsts.select("_url"), "_url").groupBy("_url").agg(F.min("_known").alias("_stored"))
        firsts = firsts.join(known, "_url", "left")
    else:
        firsts = firsts.withColumn("_stored", F.lit(None).cast("bigint"))
    earlier = F.when(F.col("_first") < F.col("news_id"), F.col("_first"))
    duplicates = keyed.join(firsts, "_url").select("news_id", F.coalesce("_stored", earlier).alias("_of")).where("_of is not null")
    joined = articles.join(duplicates, "news_id", "left")
    duplicate = F.col("_of")
    short = F.concat(F.lit("Rejected: Content too short ("), F.length("content").cast("string"), F.lit(" chars)"))
    same = F.concat(F.lit("Rejected: Duplicate URL (id:"), duplicate.cast("string"), F.lit(")"))
    old = F.concat(
        F.lit("Rejected: Exceeds 48h limit (published: "),
        F.date_format("published_at", "yyyy-MM-dd HH:mm:ss"),
        F.lit(")"),
    )
    status = (
        F.when(_too_short(), short)
        .when(_untitled(), "Rejected: Title empty")
        .when(duplicate.isNotNull(), same)
        .when(_too_old(now), old)
        .otherwise("Success")
    )
    kind = (
        F.when(_too_short(), "short")
        .when(_untitled(), "untitled")
        .when(duplicate.isNotNull(), "duplicate")
        .when(_too_old(now), "late")
        .otherwise("ok")
    )
    return joined.withColumns({"status": status, "status_kind": kind, "duplicate_of": duplicate}).drop("_of")


def dedupe_url(articles: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """First arrival per address, case and accents ignored; addresses in ``stored`` are dropped, articles without one kept."""
    keyed = articles.withColumn("_url", _address())
    firsts = keyed.groupBy("_url").agg(F.min("news_id").alias("news_id"))
    if stored is not None:
        known = stored.select(fold_key(F.col("source_url")).alias("_url"))
        firsts = firsts.join(known, "_url", "left_anti")
    return articles.join(firsts.select("news_id"), "news_id", "left_semi")
