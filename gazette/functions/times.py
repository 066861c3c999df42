"""Time parsing: a fixed list of formats, tried in order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bind

# Formats that occur in feeds and pages (fixed values).
FORMATS = [
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd HH:mm",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm",
    "yyyy-MM-dd",
    "d MMM yyyy HH:mm:ss",
    "d MMM yyyy HH:mm",
    "d MMM yyyy",
    "MMM d, yyyy h:mm a",
    "MMM d, yyyy",
    "MMMM d, yyyy",
]


def _blank_to_null(col: Column) -> Column:
    return F.nullif(F.trim(col), F.lit(""))


def parse_local(col: Column) -> Column:
    """A written time as it stands: weekday, fraction and zone are cut off first."""
    text = F.regexp_replace(F.trim(col), "^[A-Za-z]{3,9},\\s*(?=\\d)", "")
    text = F.regexp_replace(text, "(\\d{2}:\\d{2}:\\d{2})\\.\\d+", "$1")
    text = F.regexp_replace(text, "(\\d{2}:\\d{2}(?::\\d{2})?)\\s*(?:Z|UTC|GMT|EST|EDT|PST|PDT|CST|[+-]\\d{2}:?\\d{2})$", "$1")
    return bind(_blank_to_null(text), lambda cut: F.coalesce(*[F.try_to_timestamp(cut, F.lit(form)) for form in FORMATS]))


def first_time(*cols: Column) -> Column:
    """First column that parses."""
    return F.coalesce(*[parse_local(col) for col in cols])


def instant(col: Column) -> Column:
    """A time that carries its zone, else the written time."""
    return F.coalesce(F.try_to_timestamp(_blank_to_null(col)), parse_local(col))


def written_minute(text: Column) -> Column:
    """``2024-01-02 … 03:04`` or ``2024年01月02日 … 03:04`` inside a text."""
    day = F.regexp_extract(text, "(\\d{4}[-年]\\d{2}[-月]\\d{2})[^\\d]*\\d{2}:\\d{2}", 1)
    clock = F.regexp_extract(text, "\\d{4}[-年]\\d{2}[-月]\\d{2}[^\\d]*(\\d{2}:\\d{2})", 1)
    joined = F.concat(F.translate(day, "年月", "--"), F.lit(" "), clock)
    return F.when(day != "", F.try_to_timestamp(joined, F.lit("yyyy-MM-dd HH:mm")))


def published_label(text: Column) -> Column:
    """Time after ``Published:`` up to the end of the line."""
    return parse_local(F.regexp_extract(text, "Published:\\s*([^\\n]+)", 1))


def publish_time(stamp: Column, datetime_attr: Column, text: Column, fallback: Column) -> Column:
    """Minute attribute, then datetime attribute, then the visible text, then the fallback.

    The visible text is bound: making it costs most, and it is looked at three times.
    """
    return F.coalesce(
        F.try_to_timestamp(_blank_to_null(stamp), F.lit("yyyy-MM-dd HH:mm")),
        parse_local(datetime_attr),
        bind(text, lambda shown: F.coalesce(written_minute(shown), published_label(shown))),
        fallback,
    )
