"""Text column functions: cleaning, folding, language, tokens, snippets."""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache
from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import lexicon as L

HAN = "\\x{4E00}-\\x{9FFF}"
SPACES = " \t\r\n\f\u000b 　"
WHOLE_ELEMENTS = "(?is)<!--.*?-->|<script\\b.*?</script>|<style\\b.*?</style>"
UNIT = "\u001f"
ANY_TAG = "(?i)</?[a-z][^>]*>|<![^>]*>|<\\?[^>]*>"


def strings(values) -> Column:
    """An array literal of strings.

    Written as one folded expression instead of one node per word, so that a
    long list does not make the plan long.
    """
    values = list(values)
    if not values:
        return F.array().cast("array<string>")
    return F.split(F.lit(UNIT.join(values)), UNIT)


def json_literal(value, ddl: str) -> Column:
    """A nested literal as one folded expression."""
    return F.from_json(F.lit(json.dumps(value, ensure_ascii=False)), ddl)


def bind(value: Column, body) -> Column:
    """Evaluate a value once where an expression uses it several times.

    Inside the functions of arrays nothing is shared between uses, so a text that
    is folded or cut for many comparisons has to be bound to a variable first.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def first_by(items: Column, field: str) -> Column:
    """The first item of each value of a field, in order; by sorting, so long lists cost little more than short ones."""

    def firsts(ordered: Column) -> Column:
        new = F.filter(ordered, lambda p, k: (k == 0) | ~F.get(ordered, k - 1)["key"].eqNullSafe(p["key"]))
        placed = F.sort_array(F.transform(new, lambda p: F.struct(p["at"].alias("at"), p["item"].alias("item"))))
        return F.transform(placed, lambda p: p["item"])

    keyed = F.transform(items, lambda item, k: F.struct(item[field].alias("key"), k.alias("at"), item.alias("item")))
    return bind(F.sort_array(keyed), firsts)


def evaluate_once(df: DataFrame, exprs: dict[str, Column]) -> DataFrame:
    """``withColumns`` whose expressions are computed once per row, here.

    A later filter on such a column is not pushed below it and a later projection
    does not repeat it: the optimizer would otherwise copy a costly expression
    into every place that uses its column. It is a one-row generator, so it stays
    inside the stage and its generated code.
    """
    kept = [F.col(c) for c in df.columns if c not in exprs]
    made = F.struct(*[e.alias(name) for name, e in exprs.items()])
    return df.select(*kept, F.inline(F.array(made)))


def strip(col: Column) -> Column:
    """Trim every kind of space, not only the blank."""
    return F.btrim(col, F.lit(SPACES))


# --- markup -----------------------------------------------------------------


@lru_cache(maxsize=1)
def _entity_names() -> dict[str, str]:
    named = {name: chr(point) for name, point in name2codepoint.items()}
    named["apos"] = "'"
    return named


def decode_entities(col: Column) -> Column:
    """Decode named and numeric character references in one pass over the text.

    The text is cut at every ``&``; each piece is looked up once, so ``&amp;lt;``
    becomes ``&lt;`` and not ``<``. Texts without ``&`` are passed through.
    """
    names = json_literal(_entity_names(), "map<string,string>")

    def piece(text: Column, position: Column) -> Column:
        body = F.regexp_extract(text, "^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);", 1)
        rest = F.substring(text, F.length(body) + 2, F.length(text))
        digits = F.when(
            F.lower(F.substring(body, 1, 2)) == "#x",
            F.conv(F.substring(body, F.lit(3), F.length(body)), 16, 10),
        ).otherwise(F.substring(body, F.lit(2), F.length(body)))
        point = digits.cast("bigint")
        valid = (point > 0) & (point <= 0x10FFFF) & ~point.between(0xD800, 0xDFFF)
        coded = F.when(valid, F.decode(F.unhex(F.lpad(F.hex(point), 8, "0")), "UTF-32"))
        decoded = F.when(body.startswith("#"), coded).otherwise(F.element_at(names, body))
        return (
            F.when(position == 0, text)
            .when((body != "") & decoded.isNotNull(), F.concat(decoded, rest))
            .otherwise(F.concat(F.lit("&"), text))
        )

    pieces = F.transform(F.split(col, "&"), piece)
    return F.when(F.contains(col, F.lit("&")), F.array_join(pieces, "")).otherwise(col)


def strip_tags(col: Column) -> Column:
    """Text nodes joined as they stand, references decoded."""
    bare = F.regexp_replace(F.regexp_replace(col, WHOLE_ELEMENTS, ""), ANY_TAG, "")
    return decode_entities(bare)


def strip_html(col: Column) -> Column:
    """Plain text of a fragment; null becomes the empty text."""
    return strip(strip_tags(F.coalesce(col, F.lit(""))))


# --- comparison -------------------------------------------------------------


@lru_cache(maxsize=1)
def _fold_table() -> tuple[str, str]:
    """Single-character folds: accented Latin letters to their base letter.

    The table comes from canonical decomposition; combining marks have no
    counterpart, so ``translate`` removes them.
    """
    source, target = [], []
    for point in list(range(0x00C0, 0x0250)) + list(range(0x1E00, 0x1F00)):
        letter = chr(point).lower()
        base = unicodedata.normalize("NFD", letter)[0]
        if len(letter) == 1 and base != letter and letter not in source:
            source.append(letter)
            target.append(base)
    for letter, base in {"ø": "o", "đ": "d", "ł": "l", "ħ": "h"}.items():
        source.append(letter)
        target.append(base)
    marks = [chr(point) for point in range(0x0300, 0x0370)]
    return "".join(source + marks), "".join(target)


def fold(col: Column) -> Column:
    """Key under which two texts are equal when case and accents are ignored.

    The stored tables compare that way everywhere. Folding once per row keeps
    the comparison a plain binary one, which hashes, sorts and searches fast.
    """
    source, target = _fold_table()
    plain = F.translate(F.lower(col), source, target)
    for letter, pair in (("ß", "ss"), ("æ", "ae"), ("œ", "oe")):
        plain = F.replace(plain, F.lit(letter), F.lit(pair))
    return plain


def fold_key(col: Column) -> Column:
    """``fold`` for equality, where trailing blanks do not count either."""
    return F.rtrim(fold(col))


def fold_literal(text: str) -> str:
    """The same fold for a literal, so dictionaries are folded while planning."""
    source, target = _fold_table()
    table = {ord(c): (target[i] if i < len(target) else None) for i, c in enumerate(source)}
    plain = text.lower().translate(table)
    return plain.replace("ß", "ss").replace("æ", "ae").replace("œ", "oe")


# --- language and tokens ----------------------------------------------------


def detect_language(col: Column) -> Column:
    return F.when(F.coalesce(col, F.lit("")).rlike(f"[{HAN}]"), "zh").otherwise("en")


def language_or_detect(language: Column, title: Column) -> Column:
    """A given language stays; null or empty is decided by the title."""
    return F.when(F.coalesce(language, F.lit("")) != "", language).otherwise(detect_language(title))


def stem_en(word: Column) -> Column:
    size = F.length(word)
    return (
        F.when(word.endswith("ing") & (size > 5), F.left(word, size - 3))
        .when(word.endswith("ed") & (size > 4) & ~word.endswith("ing"), F.left(word, size - 2))
        .when(word.endswith("s") & ~word.endswith("ss") & (size > 3), F.left(word, size - 1))
        .otherwise(word)
    )


def tokenize_en(col: Column) -> Column:
    """Distinct stemmed words of three or more ASCII letters or digits."""
    words = F.regexp_extract_all(F.lower(F.coalesce(col, F.lit(""))), F.lit("[a-z0-9]{3,}"), F.lit(0))
    kept = F.array_except(words, strings(L.EN_STOPWORDS))
    return F.array_distinct(F.transform(kept, stem_en))


def tokenize_zh(col: Column) -> Column:
    """Distinct pairs of neighbouring characters, gaps closed, stop pairs dropped."""
    chars = F.regexp_replace(F.coalesce(col, F.lit("")), f"[^{HAN}a-zA-Z0-9]", "")
    pairs = F.regexp_extract_all(chars, F.lit("(?=(..))"), F.lit(1))
    return F.array_except(pairs, strings(w for w in L.ZH_STOPWORDS if len(w) == 2))


def tokenize(col: Column, language: Column, zh_chars: int | None = None, en_chars: int | None = None) -> Column:
    """Tokens by language, each with its own text limit (``None``: whole text)."""
    zh = F.substring(col, 1, zh_chars) if zh_chars else col
    en = F.substring(col, 1, en_chars) if en_chars else col
    return F.when(language == "zh", tokenize_zh(zh)).otherwise(tokenize_en(en))


# --- stored and shown forms -------------------------------------------------


def summary_or_default(summary: Column, content: Column) -> Column:
    blank = F.trim(F.coalesce(summary, F.lit(""))) == ""
    return F.when(blank, F.substring(content, 1, L.SUMMARY_CHARS)).otherwise(summary)


def snippet(summary: Column, limit: int = L.XML_SUMMARY_CHARS) -> Column:
    text = F.coalesce(summary, F.lit(""))
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("..."))).otherwise(text)


def terms_to_json(terms: Column) -> Column:
    return F.to_json(terms)


def terms_from_json(text: Column) -> Column:
    return F.from_json(text, "array<string>")


def fmt_time(col: Column) -> Column:
    return F.date_format(col, "yyyy-MM-dd HH:mm:ss")


def is_meaningless(phrase: Column) -> Column:
    return phrase.isin(L.FRAGMENT_PHRASES) | phrase.rlike("|".join(L.MEANINGLESS_PATTERNS))


def count_in(text: Column, keyword: Column) -> Column:
    """Non-overlapping, case-sensitive occurrences of a keyword."""
    shorter = F.octet_length(F.replace(text, keyword, F.lit("")))
    times = (F.octet_length(text) - shorter) / F.octet_length(keyword)
    return F.when(F.contains(text, keyword), times.cast("bigint")).otherwise(F.lit(0).cast("bigint"))


def xml_escape(col: Column) -> Column:
    text = F.replace(col, F.lit("&"), F.lit("&amp;"))
    text = F.replace(text, F.lit("<"), F.lit("&lt;"))
    return F.replace(text, F.lit(">"), F.lit("&gt;"))


def article_xml(news_id: Column, language: Column, title: Column, summary: Column, country: Column) -> Column:
    """The stored record of an article; the country element is left out when null."""
    empty = F.lit("")
    return F.concat(
        F.lit('<news id="'), news_id.cast("string"), F.lit('" lang="'), F.coalesce(language, empty), F.lit('">'),
        F.lit("<title><![CDATA["), F.coalesce(title, empty), F.lit("]]></title>"),
        F.lit("<summary><![CDATA["), F.coalesce(F.substring(summary, 1, L.XML_SUMMARY_CHARS), empty),
        F.lit("...]]></summary><metadata>"),
        F.coalesce(F.concat(F.lit("<country>"), country, F.lit("</country>")), empty),
        F.lit("</metadata></news>"),
    )


def ends_in_mark(text: Column) -> Column:
    """True if a block ends in a colon or semicolon, narrow or wide."""
    hit = F.lit(False)
    for mark in L.BLOCK_END_MARKS:
        hit = hit | text.endswith(mark)
    return hit
