"""Quality rules as a cascade: the rules that reject most for their cost are asked first, and the first rejection ends it.

Everything is built from column expressions. Cost and selectivity of each rule are measured on a sample; they set the
order alone, so a document's verdict doesn't depend on them.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazette.functions.text import evaluate_once
from gazette.llm.common import stored

WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
#: A document fails the base rules with fewer words, or with a larger share (in percent) of words in repeated windows.
LEAST_WORDS, MOST_REPEATED, WINDOW = 20, 30, 8


@dataclass(frozen=True)
class Rule:
    """``rejects`` is true for a text that is to go; on null and empty texts it is false or null."""

    name: str
    rejects: Column


def count(text: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0)).cast("long")


def words(text: Column) -> Column:
    """The words of a text (null: none)."""
    return F.coalesce(F.array_remove(F.split(text, GAP), ""), F.array().cast("array<string>"))


def letters(text: Column) -> Column:
    """Number of letters (null: 0): what is left when all runs of other characters are cut out."""
    return F.coalesce(F.char_length(F.array_join(F.split(text, r"\P{L}+"), "")), F.lit(0)).cast("long")


def bound(value: Column, use) -> Column:
    """``use`` of a value that is computed once per row, also where lambdas mention it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def repeated_words(found: Column, window: int = WINDOW) -> Column:
    """Words that lie in a window of ``window`` words which occurs more than once in the text.

    Runs of words are compared by 64-bit hashes, each made of the hashes of its two halves, so a word is read once or twice however
    long the window is. A window that occurs again repeats ``window / 2 + 1`` half windows; texts with fewer repeated half windows than
    that have none and end there. Only the others sort the hashes of their windows, and the covered words are summed over
    the sorted places.
    """
    half = window // 2

    def covered(hashes: Column) -> Column:
        def places(pairs: Column) -> Column:
            same = lambda k, h: F.coalesce(F.get(pairs, k)["h"] == h, F.lit(False))
            return F.array_sort(F.transform(F.filter(F.transform(pairs, lambda p, k: F.struct(p["i"].alias("i"), (same(k - 1, p["h"]) | same(k + 1, p["h"])).alias("again"))), lambda p: p["again"]), lambda p: p["i"]))

        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        start = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("total"))
        return F.aggregate(
            bound(pairs, places),
            start,
            lambda acc, i: F.struct((i + window).cast("long").alias("end"), (acc["total"] + F.least(F.lit(window).cast("long"), i + window - acc["end"])).alias("total")),
            lambda acc: acc["total"],
        )

    def joined(hashes: Column, apart: int) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(hashes) - apart - 1), lambda i: F.xxhash64(F.get(hashes, i), F.get(hashes, i + apart)))

    def halves(hashes: Column, size: int) -> Column:
        """From hashes of runs of ``size`` words to those of half a window."""
        return hashes if size >= half else halves(bound(hashes, lambda h: joined(h, size)), 2 * size)

    none = F.lit(0).cast("long")
    several = lambda h: F.when(F.size(h) - F.size(F.array_distinct(h)) > half, bound(joined(h, half), covered)).otherwise(none)
    return F.when(F.size(found) > window, bound(halves(joined(found, 1), 2), several)).otherwise(none)


def repeated_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda line: line.rlike(WORD))
    return bound(lines, lambda found: F.size(found) - F.size(F.array_distinct(found))).cast("long")


def base(documents: DataFrame, text: str = "text", asked: list[Rule] | None = None) -> DataFrame:
    """All columns, and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed; with ``asked``, ``kept`` as well.

    Null and empty texts count 0 everywhere and fail. Raises if the input has a column of one of these names.
    """
    made = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    if taken := set(made) & set(documents.columns):
        raise ValueError(f"the input already has {sorted(taken)}")
    value = F.coalesce(F.col(text), F.lit(""))
    spaces = sum((F.octet_length(value) - F.octet_length(F.replace(value, F.lit(c))) for c in "\t\n\x0b\x0c\r"), F.octet_length(value) - F.octet_length(F.replace(value, F.lit(" "))))
    split, found = with_words(documents, text)
    counted = evaluate_once(
        split,
        {
            "n_words": F.size(found).cast("long"),
            "word_chars": (F.char_length(value) - spaces).cast("long"),
            "n_symbols": count(value, SYMBOLS),
            "n_dup_lines": repeated_lines(F.col(text)),
            "n_repeat_words": repeated_words(F.col(found)),
        },
    )
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    counted = counted.withColumn("base_failed", failed)
    if asked is not None:
        chain = verdict([in_words(rule, text, F.col(found)) for rule in asked])
        counted = counted.withColumn("kept", F.when(F.col("base_failed"), False).otherwise(chain.isNull()))
    return counted.drop(found)


def in_words(rule: Rule, text: str, found: Column) -> Rule:
    """The rule of the same name over words that are at hand; a rule of another origin stays as it is."""
    return next((r for r in base_rules(text, found) + rules(text, found) if r.name == rule.name), rule)


def rules(text: str = "text", found: Column | None = None) -> list[Rule]:
    """Further rules. Fixed thresholds, chosen on the labelled documents so that good ones pass.

    ``found`` are the words of the text where they are at hand.
    """
    t = F.col(text)
    found = words(t) if found is None else found
    total = F.size(found)
    runs = bound(found, lambda w: F.size(F.filter(F.transform(w, lambda word, i: word == F.get(w, i - 1)), lambda same: same)))
    return [
        Rule("symbols", 10 * count(t, SYMBOLS) > total),
        Rule("shouts", 10 * count(t, "!!") > total),
        Rule("capitals", 2 * count(t, r"\p{Lu}") > letters(t)),
        Rule("few_letters", 2 * letters(t) < F.char_length(t)),
        Rule("word_lengths", (F.char_length(t) > 20 * total) | (5 * F.char_length(t) < 12 * total)),
        Rule("word_runs", 5 * runs > total),
    ]


def base_rules(text: str = "text", found: Column | None = None) -> list[Rule]:
    """The base rules in the form of the cascade."""
    found = words(F.col(text)) if found is None else found
    return [
        Rule("few_words", F.size(found) < LEAST_WORDS),
        Rule("repeats", bound(found, lambda w: 100 * repeated_words(w) > MOST_REPEATED * F.size(w))),
    ]


def with_words(documents: DataFrame, text: str) -> tuple[DataFrame, str]:
    """The words of each text as a column of a name that is free, made once for all rules, and the name."""
    name = "__words"
    while name in documents.columns:
        name += "_"
    return evaluate_once(documents, {name: words(F.col(text))}), name


def order(documents: DataFrame, asked: list[Rule], sample: int = 2000, seed: int = 7) -> list[Rule]:
    """The rules by rejections per second on a random sample of about ``sample`` rows, highest first.

    Each rule is run over the stored sample by itself, twice; the time of counting alone is taken off. Rules that reject
    nothing come last, cheapest first. An empty table leaves the order as it is.
    """
    total = documents.count()
    if not total or len(asked) < 2:
        return list(asked)
    rows = stored(documents.sample(fraction=min(1.0, sample / total), seed=seed), "quality-sample").coalesce(1)

    def timed(condition: Column) -> tuple[float, int]:
        best, hits = float("inf"), 0
        for _ in range(2):
            began = time.perf_counter()
            hits = rows.select(F.count_if(condition)).first()[0]
            best = min(best, time.perf_counter() - began)
        return best, hits

    idle, _ = timed(F.lit(True))
    measured = [(rule, max(1e-4, cost - idle), hits) for rule, (cost, hits) in ((rule, timed(F.coalesce(rule.rejects, F.lit(False)))) for rule in asked)]
    return [rule for rule, _, _ in sorted(measured, key=lambda m: (-m[2] / m[1], m[1]))]


def verdict(asked: list[Rule]) -> Column:
    """Name of the first rule that rejects, null if none does. Later rules aren't evaluated for a rejected text."""
    chain = F.when(asked[0].rejects, asked[0].name)
    for rule in asked[1:]:
        chain = chain.when(rule.rejects, rule.name)
    return chain


def judged(documents: DataFrame, text: str = "text", asked: list[Rule] | None = None) -> DataFrame:
    """:func:`base` and ``kept``: false if the base rules fail, else whether the cascade lets the document pass."""
    return base(documents, text, order(documents.select(text), rules(text)) if asked is None else asked)


def filtered(documents: DataFrame, text: str = "text") -> DataFrame:
    """The documents that pass base rules and cascade; columns and rows stay as they are."""
    asked = order(documents.select(text), base_rules(text) + rules(text))
    split, found = with_words(documents, text)
    chain = verdict([Rule("no_text", F.col(text).isNull()), *(in_words(rule, text, F.col(found)) for rule in asked)])
    return split.where(chain.isNull()).drop(found)
