"""Search results as response documents, and documents back to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fmt_time, xml_escape

# A record is embedded as it stands only if it looks like one (the XPath functions
# and readers raise on anything else).
WELL_FORMED = (
    "(?s)^<news(?:\\s[^<>]*)?>(?:<(title|summary)>(?:<!\\[CDATA\\[.*?\\]\\]>|[^<>]*)</(title|summary)>)*"
    "(?:<metadata>(?:<country>[^<>]*</country>)?</metadata>)?</news>$"
)


def _record_data(xml: Column, title: Column) -> Column:
    plain = F.concat(F.lit("<news>"), xml_escape(F.coalesce(title, F.lit(""))), F.lit("</news>"))
    return F.when(F.coalesce(xml, F.lit("")).rlike(WELL_FORMED), xml).otherwise(plain)


def sru_record(position: Column, created_at: Column, xml: Column, title: Column) -> Column:
    stamp = F.coalesce(
        F.concat(F.lit("<datestamp>"), fmt_time(created_at), F.lit("</datestamp>")), F.lit("")
    )
    return F.concat(
        F.lit("<record><recordSchema>news</recordSchema><recordPacking>xml</recordPacking><recordPosition>"),
        position.cast("string"),
        F.lit("</recordPosition>"),
        stamp,
        F.lit("<recordData>"),
        _record_data(xml, title),
        F.lit("</recordData></record>"),
    )


def sru_response(results: DataFrame, answers: DataFrame | None = None) -> DataFrame:
    """One document per query over its page (at most 50 records).

    ``results`` are the rows of the pages; numberOfRecords is the true total. With
    ``answers`` (a row per request) a request without rows has its document too.
    """
    rows = results.select(
        "query_id",
        "query",
        "position",
        "total",
        sru_record(F.col("position"), F.col("created_at"), F.col("xml_content"), F.col("title")).alias("record"),
    )
    pages = rows.groupBy("query_id", "query").agg(
        F.max("total").alias("total"), F.sort_array(F.collect_list(F.struct("position", "record"))).alias("records")
    )
    if answers is not None:
        listed = pages.select("query_id", "records")
        pages = answers.select("query_id", "query", "total").join(listed, "query_id", "left")
        pages = pages.withColumn("records", F.coalesce("records", F.array().cast(listed.schema["records"].dataType)))
    return pages.select(
        "query_id",
        F.concat(
            F.lit("<searchRetrieveResponse><version>1.1</version><numberOfRecords>"),
            F.col("total").cast("string"),
            F.lit("</numberOfRecords><records>"),
            F.array_join(F.transform("records", lambda r: r["record"]), ""),
            F.lit("</records><echoedSearchRetrieveRequest><query>"),
            xml_escape(F.col("query")),
            F.lit("</query></echoedSearchRetrieveRequest></searchRetrieveResponse>"),
        ).alias("response"),
    )


def _element(xml: Column, name: str) -> Column:
    body = F.regexp_extract(xml, f"(?s)<{name}>(.*?)</{name}>", 1)
    cdata = F.regexp_extract(body, "(?s)<!\\[CDATA\\[(.*?)\\]\\]>", 1)
    text = F.regexp_replace(body, "<[^>]*>", "")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return F.trim(F.when(F.contains(body, F.lit("<![CDATA[")), cdata).otherwise(text))


def sru_parse(responses: DataFrame) -> DataFrame:
    """Rows of response documents: id (else the ordinal), title, summary, country, time.

    Works on whatever text a response holds: a record without ``<news>`` is left
    out and a document that is no response gives no rows.
    """
    records = responses.select(
        "query_id",
        F.posexplode(F.regexp_extract_all("response", F.lit("(?s)<record>.*?</record>"), F.lit(0))).alias("place", "record"),
    ).where(F.contains("record", F.lit("<recordData>")) & F.col("record").rlike("<news[\\s>]"))
    news_id = F.regexp_extract("record", '<news\\s[^>]*\\bid="(\\d+)"', 1)
    return records.select(
        "query_id",
        F.coalesce(F.nullif(news_id, F.lit("")).cast("bigint"), (F.col("place") + 1).cast("bigint")).alias("id"),
        _element(F.col("record"), "title").alias("title"),
        _element(F.col("record"), "summary").alias("summary"),
        _element(F.col("record"), "country").alias("country"),
        _element(F.col("record"), "datestamp").alias("time"),
    )
