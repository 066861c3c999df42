"""Schemas of the records that enter the corpus and of its dimension tables, as DDL text."""

from __future__ import annotations

RSS_ITEM = (
    "feed string, pos int, title string, link string, published string, updated string, pubDate string, "
    "dc_date string, content string, summary string, media_url string, enclosure_url string"
)

API_RESPONSE = (
    "status string, category string, country string, articles array<struct<title:string,url:string,"
    "content:string,description:string,publishedAt:string,urlToImage:string,source:struct<name:string>>>"
)

COUNTRIES = (
    "country_code string, country_name string, country_name_en string, latitude decimal(10,8), "
    "longitude decimal(11,8), continent string"
)

SOURCES = (
    "source_id int, source_name string, source_url string, source_type string, language string, "
    "reliability_score tinyint, created_at timestamp"
)

CATEGORIES = (
    "category_id int, category_name string, category_code string, color_code string, sort_order int"
)

COUNTRY_KEYWORDS = ("country_code string, keyword string, weight_title int, weight_content int")

QUERY = ("query_id int, query string, start int, max_records int")
