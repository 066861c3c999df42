"""Keyword dictionaries against texts: one pass over a text, whatever the number of keywords.

The keywords become a trie, written as a regular expression whose alternatives begin with different characters; wide
branches are halved by the range of that character. At every place of a text it finds the longest keyword that begins there, in a
few steps that don't depend on how many keywords there are. Shorter keywords that begin at the same place are prefixes
of the one found, so they are known beforehand and stand in its entry. Entries are looked up by hash in a literal table. There is
no join, no shuffle, and texts stay where they are. A few keywords are searched for one by one instead: a search for
bytes takes a thousandth of the time that the expression takes at a place.

A dictionary of this kind is a dimension table: it is brought to the driver to build the trie, and travels with the plan.
``MOST_CHARS`` guards that; a dictionary beyond it is an error here and has :func:`keyword_pairs`, an equi-join.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bind, count_in, fold, fold_literal, json_literal

#: Characters of all keywords and codes of a dictionary that travels with the plan.
MOST_CHARS = 1 << 25
#: Alternatives that are tried one after another; more are halved.
BRANCHES = 8
#: Entries that are searched for one by one.
FEW = 256
GRAM_SALTS = 16
_ENTRY = "struct<code:string,keyword:string>"
_ENTRIES = f"array<array<struct<word:string,entries:array<{_ENTRY}>>>>"


@dataclass(frozen=True)
class Trie:
    """A dictionary ready for use: the pattern, the entries of each word by bucket, and where they are few all entries and those in ASCII."""

    pattern: str
    buckets: Column
    size: int
    few: tuple[Column, Column] | None = None


def _branches(children: list[tuple[str, str]]) -> str:
    """Alternatives that begin with different characters, ascending."""
    if len(children) <= BRANCHES:
        return "|".join(pattern for _, pattern in children)
    middle = len(children) // 2
    low, high = children[:middle], children[middle:]
    return f"(?=[\\x{{{ord(low[0][0]):x}}}-\\x{{{ord(low[-1][0]):x}}}])(?:{_branches(low)})|(?:{_branches(high)})"


def _node(words: list[str], depth: int) -> str:
    """Pattern of what may follow the common ``depth`` characters of sorted distinct words; the longest word wins."""
    ends = len(words[0]) == depth
    rest = words[1:] if ends else words
    if not rest:
        return ""
    if not ends and len(rest) == 1:
        return re.escape(rest[0][depth:])
    children: dict[str, list[str]] = {}
    for word in rest:
        children.setdefault(word[depth], []).append(word)
    made = [(first, re.escape(first) + _node(group, depth + 1)) for first, group in sorted(children.items())]
    return f"(?:{_branches(made)})" + ("?" if ends else "")


def trie(entries: Iterable[tuple[str, str]], folded: bool = False) -> Trie:
    """The trie of (code, keyword) pairs; repeats count once, nulls and empty keywords are left out."""
    codes: dict[str, set[str]] = {}
    for code, keyword in entries:
        if code is not None and keyword and (word := fold_literal(keyword) if folded else keyword):
            codes.setdefault(word, set()).add(code)
    words = sorted(codes)
    pattern = f"(?s)(?=({_node(words, 0)}))" if words else "(?!)()"
    size = 1 << max(0, len(words) - 1).bit_length()
    buckets: list[list] = [[] for _ in range(size)]
    for word in words:
        found = [word[:n] for n in range(1, len(word) + 1) if word[:n] in codes]
        rows = [{"code": code, "keyword": prefix} for prefix in found for code in sorted(codes[prefix])]
        buckets[_bucket(word, size)].append({"word": word, "entries": rows})
    listed = [{"code": code, "keyword": word} for word in words for code in sorted(codes[word])]
    plain = [row for row in listed if row["keyword"].isascii()]
    few = (_literal(listed), _literal(plain)) if len(listed) <= FEW else None
    return Trie(pattern, json_literal(buckets, _ENTRIES), size, few)


def _literal(rows: list[dict]) -> Column:
    """Entries as a literal that is folded while planning; one in JSON is parsed for every row."""
    made = [F.struct(F.lit(row["code"]).alias("code"), F.lit(row["keyword"]).alias("keyword")) for row in rows]
    return F.array(*made).cast(f"array<{_ENTRY}>")


def _bucket(word: str, size: int) -> int:
    return zlib.crc32(word.encode()) % size


def entries_in(found: Trie, text: Column) -> Column:
    """The distinct (code, keyword) entries whose keyword stands in the text."""
    if found.few is not None:
        listed, plain = found.few
        fit = F.when(F.octet_length(text) == F.length(text), plain).when(text.isNotNull(), listed)
        return F.filter(fit, lambda e: F.contains(text, e["keyword"]))

    def entries(word: Column) -> Column:
        bucket = F.get(found.buckets, (F.crc32(word.cast("binary")) % found.size).cast("int"))
        return F.flatten(F.transform(F.filter(bucket, lambda e: e["word"] == word), lambda e: e["entries"]))

    words = F.array_distinct(F.regexp_extract_all(text, F.lit(found.pattern), F.lit(1)))
    return F.array_distinct(F.flatten(F.transform(words, entries)))


def best_code(found: Trie, text: Column) -> Column:
    """Code with most keyword occurrences, the smaller code on a tie; null without a hit."""

    def best(body: Column) -> Column:
        def of(counts: Column) -> Column:
            def scored(code: Column) -> Column:
                mine = F.filter(counts, lambda c: c["code"] == code)
                total = F.aggregate(mine, F.lit(0).cast("bigint"), lambda acc, c: acc + c["times"])
                return F.struct((-total).alias("order"), code.alias("code"))

            codes = F.array_distinct(F.transform(counts, lambda c: c["code"]))
            return F.array_min(F.transform(codes, scored))["code"]

        counted = F.transform(entries_in(found, body), lambda e: F.struct(e["code"].alias("code"), count_in(body, e["keyword"]).alias("times")))
        return bind(counted, of)

    return bind(text, best)


def matching_codes(found: Trie, text: Column) -> Column:
    """Every code that has at least one keyword inside the text, ascending."""
    return bind(text, lambda body: F.array_sort(F.array_distinct(F.transform(entries_in(found, body), lambda e: e["code"]))))


def pairs_of(entries, code: str) -> list[tuple[str, str]]:
    """(code, keyword) pairs of a list or of a dimension table, whose size is checked before it is brought here."""
    if not isinstance(entries, DataFrame):
        return list(entries)
    rows = entries.select(F.col(code).alias("code"), "keyword").where(F.col("code").isNotNull() & (F.col("keyword") != "")).distinct()
    chars = rows.agg(F.coalesce(F.sum(F.length("code") + F.length("keyword")), F.lit(0))).first()[0]
    if chars > MOST_CHARS:
        raise ValueError(f"a dictionary of {chars} characters is no dimension table; use keyword_pairs")
    return [(row["code"], row["keyword"]) for row in rows.collect()]


def keyword_pairs(texts: DataFrame, key: str, text: str, entries: DataFrame, folded: bool = False) -> DataFrame:
    """(key, code, keyword, times) for dictionaries of any size, by gram equi-join.

    ``texts`` has one row per key. The grams carry only the key; the text itself
    is joined back once for the surviving candidates. A gram shared by many texts
    is a skewed join key on the text side only, which AQE splits.
    """
    body = fold(F.col(text)) if folded else F.col(text)
    word = fold(F.col("keyword")) if folded else F.col("keyword")
    bodies = texts.select(F.col(key), body.alias("body"))
    words = entries.select("code", word.alias("keyword")).where((F.col("keyword") != "") & F.col("code").isNotNull()).distinct()
    grams = bodies.select(
        key,
        F.explode(
            F.array_union(
                F.regexp_extract_all(F.col("body"), F.lit("(?s)(?=(..))"), F.lit(1)),
                F.array_distinct(F.split(F.col("body"), "")),
            )
        ).alias("gram"),
        F.pmod(F.xxhash64(key), F.lit(GRAM_SALTS)).alias("slice"),
    )
    salted = words.select(
        "code",
        "keyword",
        F.substring("keyword", 1, 2).alias("gram"),
        F.explode(F.sequence(F.lit(0), F.lit(GRAM_SALTS - 1)).cast("array<bigint>")).alias("slice"),
    )
    candidates = grams.join(salted, ["gram", "slice"]).drop("gram", "slice")
    return (
        candidates.join(bodies, key)
        .withColumn("times", count_in(F.col("body"), F.col("keyword")))
        .where("times > 0")
        .select(key, "code", "keyword", "times")
    )
