"""Dimension tables: the small fixed ones, and loaders for the larger ones.

Countries and country keywords have hundreds of rows; they are data of an
installation and come from CSV or Parquet files, never from code.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..schema import CATEGORIES, COUNTRIES, COUNTRY_KEYWORDS, SOURCES
from ..session import rows_frame


def categories(spark: SparkSession) -> DataFrame:
    rows = [(i, name, code, colour, i) for i, (name, code, colour) in enumerate(L.CATEGORIES, start=1)]
    return rows_frame(spark, rows, CATEGORIES)


def sources(spark: SparkSession) -> DataFrame:
    rows = [(*row, None) for row in L.SOURCES]
    return rows_frame(spark, rows, SOURCES)


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    if path.endswith((".csv", ".csv.gz")):
        return spark.read.schema(schema).option("header", True).csv(path)
    return spark.read.schema(schema).parquet(path)


def countries(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, COUNTRIES)


def country_keywords(spark: SparkSession, path: str, known: DataFrame) -> DataFrame:
    """Keywords whose country exists; the others are rejected by the foreign key."""
    words = _read(spark, path, COUNTRY_KEYWORDS).dropDuplicates(["country_code", "keyword"])
    return words.join(F.broadcast(known.select("country_code").distinct()), "country_code", "left_semi")


def dimension_seed(countries_df: DataFrame, keywords_df: DataFrame) -> DataFrame:
    """Rows per dimension table after the keyword check, as one report."""
    spark = countries_df.sparkSession
    valid = keywords_df.join(countries_df.select("country_code"), "country_code", "left_semi")
    parts = [
        ("countries", countries_df),
        ("country_keywords", valid),
        ("categories", categories(spark)),
        ("sources", sources(spark)),
    ]
    whole = None
    for name, df in parts:
        part = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table_name"), "rows")
        whole = part if whole is None else whole.unionByName(part)
    return whole
