"""Search: many requests in one job, each with its page and its total."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions.text import HAN, bind, evaluate_once, fold, fold_key, fold_literal, json_literal, stem_en
from ..operators.rows import top_per_group
from ..schema import QUERY
from ..session import rows_frame


@dataclass(frozen=True)
class Request:
    """One search request; ``start`` is 1-based."""

    query: str
    start: int = 1
    max_records: int = 20


@dataclass(frozen=True)
class Corpus:
    """The tables a search reads.

    news: news_id, title, xml_content, created_at; news_countries; inverted_index.
    """

    news: DataFrame
    countries: DataFrame
    index: DataFrame


def requests_frame(spark: SparkSession, requests: list[Request]) -> DataFrame:
    rows = [(i, r.query, r.start, min(r.max_records, L.PAGE_CAP)) for i, r in enumerate(requests)]
    return rows_frame(spark, rows, QUERY)


def parse_queries(queries: DataFrame, stem_query: bool = False) -> DataFrame:
    """Adds kind, terms, language, xpath, clean and keywords to query rows.

    ``title:``, ``content:`` and ``country:`` select a field unless the query
    holds an address. Boolean words are plain terms. ``stem_query`` stems English
    terms the way the index does.
    """
    text = F.coalesce("query", F.lit(""))
    prefix = F.lower(F.split_part(text, F.lit(":"), F.lit(1)))
    fields = {"title": L.TITLE_PATH, "content": L.CONTENT_PATH, "country": L.COUNTRY_PATH}
    fielded = F.contains(text, F.lit(":")) & ~F.contains(text, F.lit("://")) & prefix.isin(list(fields))
    path = None
    for name, value in fields.items():
        path = F.when(fielded & (prefix == name), value) if path is None else path.when(fielded & (prefix == name), value)
    clean = F.when(
        fielded, F.trim(F.substring(text, F.length(prefix) + F.lit(2), F.length(text)))
    ).otherwise(text)
    df = queries.withColumns({"xpath": path, "clean": clean})
    df = df.withColumn("language", F.when(F.col("clean").rlike(f"[{HAN}]"), "zh").otherwise("en"))
    pairs = F.regexp_extract_all("clean", F.lit(f"(?s)(?=([{HAN}].))"), F.lit(1))
    words = F.transform(
        F.filter(
            F.regexp_extract_all("clean", F.lit("[\\p{L}\\p{N}_]+"), F.lit(0)), lambda w: F.length(w) > 2
        ),
        lambda w: stem_en(F.lower(w)) if stem_query else F.lower(w),
    )
    terms = (
        F.when(F.col("language") == "zh", F.array_distinct(pairs))
        .when(F.col("xpath") == L.COUNTRY_PATH, F.array(F.trim("clean")))
        .otherwise(words)
    )
    keywords = F.filter(F.split("clean", f"[^a-zA-Z0-9{HAN}]+"), lambda k: F.length(k) >= 2)
    kind = (
        F.when(F.trim(text) == "*", "latest")
        .when(F.col("xpath") == L.COUNTRY_PATH, "country")
        .when(F.col("xpath") == L.TITLE_PATH, "title")
        .otherwise("ranked")
    )
    return df.withColumns({"terms": terms, "keywords": keywords}).withColumn("kind", kind)


def recent_news(news: DataFrame, as_of: Column, hours: int = L.WINDOW_HOURS) -> DataFrame:
    """Rows of the rolling window, boundary excluded.

    Stored tables are partitioned by ingest day; the condition on it leaves all
    older days unread.
    """
    edge = as_of - F.make_interval(hours=F.lit(hours))
    inside = news.where(F.col("created_at") > edge)
    return inside.where(F.col("ingest_date") >= F.to_date(edge)) if "ingest_date" in news.columns else inside


def _one(value) -> Column:
    return F.lit(value).cast("bigint")


def latest_hits(asked: list[Row], recent: DataFrame) -> DataFrame:
    """Every recent article, once: all ``*`` requests are one group."""
    (one,) = asked
    return recent.select(
        F.lit(one.query_id).alias("query_id"),
        F.lit(0).alias("stage"),
        "news_id",
        "created_at",
        F.lit(1.0).alias("score"),
        _one(1).alias("match_count"),
    )


def country_hits(asked: list[Row], recent: DataFrame, countries: DataFrame) -> DataFrame:
    """Recent articles whose primary country a ``country:`` request names.

    The codes are a literal condition on the country rows, so only the rows of
    the named countries are read and joined; requests are attached by a map.
    """
    wanted: dict[str, list[int]] = {}
    for row in asked:
        for term in row.terms:
            if len(term) >= 2:
                wanted.setdefault(fold_literal(term).rstrip(" "), []).append(row.query_id)
    by_code = json_literal(wanted, "map<string,array<int>>")
    code = fold_key(F.col("country_code"))
    tagged = countries.where(F.col("is_primary") & code.isin(list(wanted))).select("news_id", code.alias("code"))
    return (
        tagged.join(recent.select("news_id", "created_at"), "news_id")
        .select("news_id", "created_at", F.explode(F.element_at(by_code, F.col("code"))).alias("query_id"))
        .select(
            "query_id",
            F.lit(0).alias("stage"),
            "news_id",
            "created_at",
            F.lit(1.5).alias("score"),
            _one(1).alias("match_count"),
        )
    )


def title_hits(asked: list[Row], recent: DataFrame) -> DataFrame:
    """Title requests: stage 0 holds the phrase, stage 1 all its keywords.

    The requests ride along as one array literal (their number is the number of
    requests of the call), so the titles are folded once and scanned once.
    """
    entries = [
        {"query_id": r.query_id, "phrase": fold_literal(r.clean), "keywords": [fold_literal(k) for k in r.keywords]}
        for r in asked
        if r.clean
    ]
    literal = json_literal(entries, "array<struct<query_id:int,phrase:string,keywords:array<string>>>")

    def hits(title: Column, entry: Column) -> Column:
        phrase = F.contains(title, entry["phrase"])
        words = (F.size(entry["keywords"]) > 0) & F.forall(entry["keywords"], lambda k: F.contains(title, k))
        stages = F.concat(
            F.when(phrase, F.array(F.lit(0))).otherwise(F.array().cast("array<int>")),
            F.when(words, F.array(F.lit(1))).otherwise(F.array().cast("array<int>")),
        )
        return F.transform(stages, lambda s: F.struct(entry["query_id"].alias("query_id"), s.alias("stage")))

    found = bind(
        fold(F.coalesce("title", F.lit(""))), lambda title: F.flatten(F.transform(literal, lambda e: hits(title, e)))
    )
    titled = evaluate_once(recent.select("news_id", "created_at", "title"), {"_found": found})
    return titled.select("news_id", "created_at", F.inline("_found")).select(
        "query_id",
        "stage",
        "news_id",
        "created_at",
        F.when(F.col("stage") == 0, 2.0).otherwise(1.5).alias("score"),
        _one(1).alias("match_count"),
    )


def ranked_hits(asked: list[Row], index: DataFrame, as_of: Column) -> DataFrame:
    """Articles by the postings of the request's terms; at least half of the terms must match.

    The terms of the call are a literal condition on the postings, which are
    stored sorted by term below their ingest day, so files without them and days
    before the window are skipped. A posting carries the time of its article and
    goes with it, so the articles themselves aren't read here. The request rows
    (a few per request) are broadcast. Postings are summed per (request, article,
    term) and then per (request, article), each combined before its shuffle.
    """
    spark = index.sparkSession
    rows = set()
    for row in asked:
        terms = row.terms
        for term in terms:
            key = fold_literal(term).rstrip(" ")
            rows.add((row.query_id, row.language, row.xpath, max(1.0, len(terms) * 0.5), key))
    shape = "query_id int, language string, xpath string, least double, term_key string"
    terms = rows_frame(spark, sorted(rows, key=repr), shape)
    postings = recent_news(index, as_of).where(F.col("term_key").isin(sorted({r[4] for r in rows}))).select(
        "term_key", "language", "news_id", "tf_weight", "xpath_path", "created_at"
    )
    matched = postings.join(F.broadcast(terms), ["term_key", "language"]).where(
        "xpath is null or xpath_path = xpath"
    )
    per_term = matched.groupBy("query_id", "news_id", "term_key", "least").agg(
        F.sum("tf_weight").alias("weight"), F.max("created_at").alias("created_at")
    )
    scored = (
        per_term.groupBy("query_id", "news_id", "least")
        .agg(F.sum("weight").alias("score"), F.count("*").alias("match_count"), F.max("created_at").alias("created_at"))
        .where("match_count >= least")
    )
    return scored.select("query_id", F.lit(0).alias("stage"), "news_id", "created_at", "score", "match_count")


ORDER = ["score", "created_at", "news_id"]


@dataclass(frozen=True)
class Found:
    """Answers of a call: the rows of all pages, and one row per request with its total, hits or not."""

    pages: DataFrame
    answers: DataFrame


def _groups(asked: list[Row]) -> dict[tuple, list[Row]]:
    """Requests that have the same hits, whatever page they want."""
    groups: dict[tuple, list[Row]] = {}
    for row in asked:
        what = (row.kind,) if row.kind == "latest" else (row.kind, row.clean, row.xpath, row.language)
        groups.setdefault(what, []).append(row)
    return groups


def _depth(row: Row) -> int:
    return max(0, row.start - 1 + row.max_records)


def _ranked(hits: DataFrame, depths: dict[int, int]) -> DataFrame:
    """The best hits of each group and stage, as many as its deepest request needs.

    Groups of like depth (within a factor of 16) share a limit, so one deep page
    doesn't make the others deep.
    """
    classes: dict[int, list[int]] = {}
    for group, depth in depths.items():
        classes.setdefault(max(0, depth - 1).bit_length() // 4, []).append(group)
    out = None
    for members in classes.values():
        mine = hits.where(F.col("query_id").isin(members)) if len(classes) > 1 else hits
        most = max(1, *(depths[m] for m in members))
        top = top_per_group(mine, ["query_id", "stage"], [F.desc(c) for c in ORDER], most, "news_id")
        out = top if out is None else out.unionByName(top)
    return out


def search_answers(corpus: Corpus, requests: list[Request], as_of: Column, stem_query: bool = False) -> Found:
    """All requests of a call, dispatched by kind, in one plan.

    Requests with the same hits are one group, ranked once. Only ids, times and
    scores are ranked; totals are counted by an aggregate of their own, so
    nothing stands between a rank and its limit. Every request has an answer: its
    total and the length of its page, 0 where it found nothing or asked for a
    page past the end. A later stage counts only where the page of the earlier
    one is empty and its own is not.
    """
    spark = corpus.news.sparkSession
    asked = parse_queries(requests_frame(spark, requests), stem_query).collect()  # as many rows as the call has requests
    groups = _groups(asked)
    kind = lambda name: [rows[0] for rows in groups.values() if rows[0].kind == name]
    recent = recent_news(corpus.news, as_of)
    parts = []
    if kind("latest"):
        parts.append(latest_hits(kind("latest"), recent))
    if kind("country"):
        parts.append(country_hits(kind("country"), recent, corpus.countries))
    if kind("title"):
        parts.append(title_hits(kind("title"), recent))
    if kind("ranked") or not parts:
        parts.append(ranked_hits(kind("ranked"), corpus.index, as_of))
    hits = parts[0]
    for part in parts[1:]:
        hits = hits.unionByName(part)
    shape = "query_id int, query string, group_id int, skip bigint, take bigint"
    wanted = [(r.query_id, r.query, rows[0].query_id, r.start - 1, r.max_records) for rows in groups.values() for r in rows]
    members = rows_frame(spark, sorted(wanted), shape)
    counts = hits.groupBy(F.col("query_id").alias("group_id"), "stage").agg(F.count("*").alias("hits"))
    inside = F.when(F.col("hits") > F.col("skip"), F.col("stage"))
    least = F.struct(F.when(inside.isNull(), 1).otherwise(0).alias("empty"), "stage", "hits")
    chosen = members.join(F.broadcast(counts), "group_id", "left").groupBy("query_id", "query", "group_id", "skip", "take").agg(
        F.min(F.when(F.col("hits").isNotNull(), least)).alias("best")
    )
    total = F.coalesce("best.hits", F.lit(0).cast("bigint"))
    length = F.greatest(F.lit(0).cast("bigint"), F.least("take", total - F.col("skip")))
    answers = chosen.select(
        "query_id", "query", "group_id", F.col("best.stage").alias("stage"), "skip", "take", total.alias("total"), length.alias("page_count")
    )
    depths = {rows[0].query_id: max(_depth(r) for r in rows) for rows in groups.values()}
    ranked = _ranked(hits, depths).withColumnRenamed("query_id", "group_id")
    page = ranked.join(F.broadcast(answers), ["group_id", "stage"]).where(
        (F.col("position") > F.col("skip")) & (F.col("position") <= F.col("skip") + F.col("take"))
    )
    shown = recent.select("news_id", "title", "xml_content")
    small = len(requests) * L.PAGE_CAP <= 100_000
    pages = shown.join(F.broadcast(page) if small else page, "news_id").select(
        "query_id", "query", "position", "news_id", "title", "xml_content", "score", "match_count", "created_at", "page_count", "total"
    )
    return Found(pages, answers.select("query_id", "query", "total", "page_count", (F.when(F.col("page_count") > 0, F.col("skip") + 1)).alias("first_position")))


def search(corpus: Corpus, requests: list[Request], as_of: Column, stem_query: bool = False) -> DataFrame:
    """The rows of the pages of :func:`search_answers`."""
    return search_answers(corpus, requests, as_of, stem_query).pages
