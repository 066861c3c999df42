"""Counts against plain Python, the cascade's order and its verdict."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gazette.llm import quality

WHITE = "[\x20\x09-\x0d]+"
PROSE = " ".join(f"word{i} and" for i in range(40)) + "."
TEXTS = [None, "", " \t\n", PROSE, "a b c d e f g h " * 4, "x y\nx y\n\nx y\n \n", PROSE + "\n" + PROSE, "#*$ %&|<> é 漢字", "one two three four five six seven eight nine one two three four five six seven eight", "w " * 3000, "\x0bé\x0c" + "q" * 5000, PROSE.upper(), "wow!! " * 9 + PROSE[:60], " ".join(w + "%%%" for w in PROSE.split()), "the the the of of of " * 1 + PROSE]


def plain(text):
    text = text or ""
    words = [w for w in re.split(WHITE, text) if w]
    grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = Counter(grams)
    covered = {j for i, g in enumerate(grams) if often[g] > 1 for j in range(i, i + 8)}
    lines = [l for l in text.split("\n") if re.sub(WHITE, "", l)]
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return (len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed)


def test_counts(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)] + [(0, None, "x")], "doc_id long, text string, words string")
    out = quality.judged(df).collect()
    assert len(out) == len(TEXTS) + 1
    for r in out:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain(TEXTS[r.doc_id])
    kept = {r.doc_id for r in out if r.kept}
    assert 3 in kept and not kept & {0, 1, 2, 9, 11, 13}
    assert {r.doc_id for r in quality.filtered(df).collect()} == kept
    assert quality.filtered(df).columns == df.columns
    assert quality.judged(df.limit(0)).collect() == []
    with pytest.raises(ValueError):
        quality.base(df.withColumnRenamed("words", "n_words"))


def test_order_by_rejection_per_cost(spark):
    df = spark.range(3000).select(F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    slow = F.size(F.filter(F.sequence(F.lit(0), F.lit(3000)), lambda i: (i % 7) == F.length("text"))) > 0
    asked = [quality.Rule("never", F.lit(False)), quality.Rule("slow", slow | F.lit(True)), quality.Rule("cheap", F.col("text").endswith("1") | F.col("text").endswith("2"))]
    names = [r.name for r in quality.order(df, asked)]
    assert names.index("cheap") < names.index("never") and set(names) == {"never", "slow", "cheap"}
    assert df.select(quality.verdict(asked).alias("v")).distinct().collect()[0].v == "slow"
