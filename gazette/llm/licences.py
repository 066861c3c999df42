"""Licence notices in texts: a sparse n-gram classifier over paragraphs, confirmed by comparison with templates.

A multinomial logistic regression with an L1 penalty is fitted on variants of licence notices and on paragraphs of the
corpus. Its features are the word 1- to 3-grams of a paragraph. A paragraph is a line; lines that run on without the end of
a sentence are judged as a whole too, for notices that are wrapped. The fitted weights give words of which every notice
must hold one (:func:`anchors`), so passing over the paragraphs without any is exact. The margin of the best licence over
everything else is calibrated on a held-out fold, and a notice must share enough of its word pairs with a template of its
family. A paragraph that is a licence rather than none, but below even odds or unlike the templates, is unknown.

Only DataFrame functions and the JVM's own estimators are used.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazette.functions.text import evaluate_once
from gazette.llm.common import stored
from gazette.session import rows_frame

STEMS = ("licen", "copyright", "permission", "warrant", "redistribut", "public domain", "spdx", "rights reserved")
#: Notices of each family, as their licences or their stewards word them. Fixed values.
TEMPLATES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "SPDX-License-Identifier: Apache-2.0",
        "Distributed under Apache-2.0",
        "Apache-2.0",
    ),
    "MIT": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
        "This project is licensed under the terms of the MIT license.",
        "SPDX-License-Identifier: MIT",
        "Available under the terms of MIT",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "Distributed under the GPLv3",
        "Published under the GNU GPL version 3",
        "GNU GPL version 3",
        "GPL-3.0",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "Licensed under the GNU General Public License version 2 only.",
        "SPDX-License-Identifier: GPL-2.0-only",
        "Distributed under the GPLv2",
        "Published under the GNU GPL version 2",
        "GNU GPL version 2",
        "GPL-2.0",
    ),
    "LGPL": (
        "This library is licensed under the GNU Lesser General Public License.",
        "You can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ),
    "BSD": (
        "Released under the BSD license.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
        "Distributed under MPL-2.0",
    ),
    "CC-BY-NC": (
        "Licensed under CC BY-NC 4.0.",
        "Available under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "CC-BY-SA": (
        "Licensed under CC BY-SA 4.0.",
        "Available under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "CC-BY": (
        "Licensed under CC BY 4.0.",
        "Available under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "CC0": (
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work; it is dedicated to the public domain.",
        "This work is released into the public domain under a CC0 license.",
    ),
}
#: Paragraphs that grant nothing, though they hold words of notices.
OTHERS = (
    "The committee will license new drivers next year.",
    "He lost his driving licence and asked for permission to travel.",
    "The warranty covers two years from the date of purchase.",
    "Copyright law was debated in parliament last week.",
    "Without permission nobody may enter the building.",
    "The policy would redistribute income and warrant further debate.",
    "Police obtained a search warrant for the house.",
    "A licence fee of ten euros is due each month.",
    "All rights reserved.",
    "Copyright 2020 by the author, all rights reserved.",
    "The broadcaster holds a licence for this region and paid the licence fee.",
    "Licensed premises must close at midnight.",
    "The song entered the public domain seventy years after the composer died.",
    "The film was released under a new title and is available now.",
    "The hostages were released under the terms of the ceasefire.",
    "Leaflets were distributed under the bridge.",
    "The report was published under his own name, version 2 follows.",
    "The Apache helicopter was modified in version 3.",
    "Any person with a copy of the software may ask for a refund.",
    "Version 2.0 of the form is available from the office.",
)
NONE = "none"
#: Where a run of lines ends: at a line break after the end of a sentence, and at blank lines.
RUN_ENDS = r"(?<=[.!?])[\x20\x09\x0B-\x0D]*+\n|\n[\x20\x09-\x0D]*\n"


@dataclass(frozen=True)
class Model:
    """Labels in order, weight rows (gram, weights), intercepts, slope and offset of the calibration, anchors (None: there are none)."""

    labels: tuple[str, ...]
    weights: list[tuple[str, list[float]]]
    intercepts: tuple[float, ...]
    slope: float
    offset: float
    anchors: tuple[str, ...] | None


def words(text: Column) -> Column:
    """Lower-case words; versions such as 2.0 are one."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+(?:\.[0-9]+)*"), F.lit(0))


def has_stem(text: Column) -> Column:
    """Whether a lower-case text holds a stem."""
    found = text.contains(STEMS[0])
    for stem in STEMS[1:]:
        found = found | text.contains(stem)
    return found


def grams(found: Column, most: int = 3) -> Column:
    """The distinct 1- to ``most``-grams of words."""

    def of(size: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.size(found) - size + 1, F.lit(1))), lambda i: F.array_join(F.slice(found, i, size), " "))

    return F.array_distinct(F.concat(*(of(size) for size in range(1, most + 1))))


def pairs(found: Column) -> Column:
    """The distinct word pairs."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.size(found) - 1, F.lit(1))), lambda i: F.array_join(F.slice(found, i, 2), " ")))


def examples() -> list[tuple[str, str]]:
    """(label, text): each notice whole, in capitals and within a sentence; long ones in two parts, others with any one or two words left out."""
    out = []
    for label, notices in [*TEMPLATES.items(), (NONE, OTHERS)]:
        for notice in notices:
            out += [(label, notice), (label, notice.upper()), (label, f"Note that this is so. {notice} See below for more on it.")]
            parts = notice.split()
            if len(parts) > 12 and label != NONE:
                for cut in (len(parts) // 2, 2 * len(parts) // 3):
                    out += [(label, " ".join(parts[:cut])), (label, " ".join(parts[cut:]))]
            if len(parts) <= 12:
                out += [(label, " ".join(p for i, p in enumerate(parts) if i not in left)) for size in (1, 2) for left in combinations(range(len(parts)), size) if label == NONE or len(parts) - size >= 4]
    return out


def anchors(weights: list[tuple[str, list[float]]], intercepts: tuple[float, ...], uses: dict[str, int]) -> tuple[str, ...] | None:
    """Words of which a paragraph must hold one for a licence to score above none.

    Every gram that speaks for a licence is booked on its rarest word by ``uses``. The most used of these words may go
    as long as all that is booked on them doesn't lift any licence over none. None if a paragraph without a gram is a licence.
    """
    needed = [intercepts[0] - own - 1e-6 for own in intercepts[1:]]
    if min(needed) <= 0:
        return None
    booked = {}
    for gram, row in weights:
        gain = [max(0.0, own - row[0]) for own in row[1:]]
        if any(gain):
            word = min(gram.split(), key=lambda w: (uses.get(w, 0), w))
            booked[word] = [a + b for a, b in zip(booked.get(word, [0.0] * len(gain)), gain)]
    left, found = [0.0] * len(needed), []
    for word in sorted(booked, key=lambda w: (-uses.get(w, 0), w)):
        more = [a + b for a, b in zip(left, booked[word])]
        if all(a < b for a, b in zip(more, needed)):
            left = more
        else:
            found.append(word)
    return tuple(found)


def likeness(rows: DataFrame) -> DataFrame:
    """key, family, share of the most similar template: of the word pairs of rows (key, words), for families with a common pair."""
    notices = rows_frame(rows.sparkSession, [(family, f"{family}/{i}", notice) for family, several in TEMPLATES.items() for i, notice in enumerate(several)], "family string, template string, notice string")
    notices = notices.withColumn("pairs", pairs(words(F.col("notice")))).select("family", "template", F.size("pairs").alias("template_pairs"), F.explode("pairs").alias("pair"))
    own = evaluate_once(rows.select("key", "words"), {"pairs": pairs(F.col("words"))}).select("key", F.size("pairs").alias("own_pairs"), F.explode("pairs").alias("pair"))
    share = F.count("*") / F.least(F.first("own_pairs"), F.first("template_pairs"))
    return own.join(F.broadcast(notices), "pair").groupBy("key", "family", "template").agg(share.alias("share")).groupBy("key", "family").agg(F.max("share").alias("share"))


def train(documents: DataFrame, sample: int = 3000, vocabulary: int = 4096, seed: int = 3, least: float = 0.6) -> Model:
    """The classifier, fitted on :func:`examples` and on paragraphs of a random sample of about ``sample`` documents as "none".

    Of the sample, paragraphs that hold a stem or are like a template are left out: they may be notices. The model has at most
    ``vocabulary`` grams and is what comes to the driver.
    """
    spark, total = documents.sparkSession, documents.count()
    lines = documents.where("text is not null").sample(fraction=min(1.0, sample / max(1, total)), seed=seed).select(F.explode(F.split("text", "\n")).alias("text"))
    plain = lines.where(~has_stem(F.lower("text"))).limit(sample).select(F.monotonically_increasing_id().alias("key"), "text")
    plain = stored(evaluate_once(plain, {"words": words(F.col("text"))}), "licence-plain")
    plain = plain.join(likeness(plain).where(F.col("share") >= least).select("key"), "key", "left_anti")
    rows = evaluate_once(rows_frame(spark, examples(), "label string, text string"), {"words": words(F.col("text"))})
    rows = rows.unionByName(plain.select(F.lit(NONE).alias("label"), "text", "words"))
    labels = (NONE, *sorted(TEMPLATES))
    number = F.array_position(F.array(*map(F.lit, labels)), F.col("label")).cast("double") - 1
    held = F.pmod(F.xxhash64("text"), F.lit(4)) == 0
    rows = stored(rows.select(number.alias("label"), grams(F.col("words")).alias("grams"), held.alias("held")), "licence-examples").coalesce(1)
    counter = CountVectorizer(inputCol="grams", outputCol="features", vocabSize=vocabulary, binary=True).fit(rows.where(F.col("label") > 0))
    ready = counter.transform(rows)
    fit = lambda data: LogisticRegression(family="multinomial", elasticNetParam=1.0, regParam=2e-4, maxIter=60, standardization=False).fit(data)
    fold = fit(ready.where(~F.col("held")))
    margin = fold.transform(ready.where("held")).select("label", vector_to_array("rawPrediction").alias("raw")).select("label", *_margin(F.col("raw"), len(labels)))
    judged = margin.select((F.col("best") == F.col("label")).cast("double").alias("label"), F.col("margin"))
    line = LogisticRegression(regParam=1e-3, maxIter=50).fit(VectorAssembler(inputCols=["margin"], outputCol="features").transform(judged))
    whole = fit(ready)
    matrix = whole.coefficientMatrix.toArray()
    weights = [(gram, [float(x) for x in matrix[:, i]]) for i, gram in enumerate(counter.vocabulary) if (matrix[:, i] != 0).any()]
    intercepts = tuple(float(x) for x in whole.interceptVector)
    known = rows_frame(spark, [(word,) for word in sorted({word for gram, _ in weights for word in gram.split()})], "word string")
    uses = plain.select(F.explode("words").alias("word")).join(F.broadcast(known), "word").groupBy("word").count().collect()
    return Model(labels, weights, intercepts, float(line.coefficients[0]), float(line.intercept), anchors(weights, intercepts, {r["word"]: r["count"] for r in uses}))


def _margin(raw: Column, count: int) -> tuple[Column, Column]:
    """Number of the best licence, and its score less the logarithm of the summed exponentials of all others."""
    licences = F.slice(raw, 2, count - 1)
    top = F.array_max(licences)
    best = F.array_position(licences, top).cast("double")
    rest = F.filter(raw, lambda x, i: i != best.cast("int"))
    return best.alias("best"), (top - F.array_max(rest) - F.log(F.aggregate(rest, F.lit(0.0), lambda acc, x: acc + F.exp(x - F.array_max(rest))))).alias("margin")


def paragraphs(documents: DataFrame, model: Model) -> DataFrame:
    """uid, doc_id, n_paragraphs (lines with a word), and the runs of lines that hold an anchor, with their place."""
    text = F.coalesce("text", F.lit(""))
    places = F.transform(F.split(text, RUN_ENDS), lambda lines, i: F.struct(i.alias("run"), lines.alias("lines")))
    if model.anchors is not None:
        known = F.array(*map(F.lit, model.anchors)).cast("array<string>")
        places = F.filter(places, lambda p: F.arrays_overlap(words(p["lines"]), known))
    number = F.size(F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))).cast("long")
    return documents.select(F.monotonically_increasing_id().alias("uid"), "doc_id", number.alias("n_paragraphs"), places.alias("found"))


def listed(runs: DataFrame) -> DataFrame:
    """key (uid, run, line; the line is -1 for a whole run) and words: every line of rows (uid, run, lines), and the runs of several lines."""
    lines = runs.select("uid", "run", F.posexplode(F.split("lines", "\n")).alias("line", "text"))
    wrapped = runs.where(F.contains("lines", F.lit("\n"))).select("uid", "run", F.lit(-1).alias("line"), F.col("lines").alias("text"))
    units = lines.unionByName(wrapped).select(F.struct("uid", "run", "line").alias("key"), "text")
    return evaluate_once(units, {"words": words(F.col("text"))}).drop("text").where(F.size("words") > 0)


def classified(units: DataFrame, model: Model, least: float = 0.6) -> DataFrame:
    """key, family, confidence, confirmed for rows (key, words) that the classifier takes for a licence rather than none.

    Confirmed: at even odds at least, and like a template of the family.
    """
    spark = units.sparkSession
    ready = stored(units, "licence-units")
    count = len(model.labels)
    table = rows_frame(spark, [*model.weights, ("", [0.0] * count)], "gram string, weights array<double>")
    shifted = [F.slice("words", start, F.size("words")).alias(name) for start, name in ((1, "a"), (2, "b"), (3, "c"))]
    spaced = ready.select("key", *shifted).select("key", F.inline(F.arrays_zip("a", "b", "c")))
    two = F.concat("a", F.lit(" "), "b")
    own = spaced.select("key", F.explode(F.array("a", two, F.concat(two, F.lit(" "), "c"))).alias("gram")).unionByName(ready.select("key", F.lit("").alias("gram")))
    met = own.join(F.broadcast(table), "gram").groupBy("key", "gram").agg(F.first("weights").alias("weights"))
    raw = met.groupBy("key").agg(F.array(*(F.sum(F.col("weights")[k]) + model.intercepts[k] for k in range(count))).alias("raw"))
    best, margin = _margin(F.col("raw"), count)
    ahead = F.array_max(F.slice("raw", 2, count - 1)) > F.col("raw")[0]
    scored = raw.where(ahead).select("key", best, margin).withColumn("confidence", 1 / (1 + F.exp(-(F.col("margin") * model.slope + model.offset))))
    scored = scored.withColumn("family", F.element_at(F.array(*map(F.lit, model.labels)), (F.col("best") + 1).cast("int")))
    found = scored.join(likeness(ready.join(scored.select("key"), "key", "left_semi")), ["key", "family"], "left")
    sure = (F.col("margin") > 0) & (F.col("confidence") >= 0.5) & (F.coalesce("share", F.lit(0.0)) >= least)
    return found.select("key", "family", "confidence", sure.alias("confirmed"))


def scanned(documents: DataFrame, model: Model) -> DataFrame:
    """Per row of ``documents`` (doc_id, text): doc_id, n_paragraphs, n_licences (confirmed notices), families (sorted, joined by
    commas; null if none), n_unknown (lines that are a licence rather than none, but no confirmed notice).

    A run of lines counts as one notice if it is confirmed and none of its lines is; its lines aren't unknown then. Whole
    texts are read. Null and empty texts have no paragraph; rows that repeat have the same result; an empty table gives no
    rows; other columns aren't read.
    """
    read = stored(paragraphs(documents, model), "paragraphs")
    found = classified(listed(read.select("uid", F.inline("found"))), model).select("key.uid", "key.run", (F.col("key.line") < 0).alias("whole"), "family", "confirmed")
    of = lambda whole, name: F.sort_array(F.collect_list(F.when((F.col("whole") == whole) & F.col("confirmed"), F.col("family")))).alias(name)
    unsure = F.count_if(~F.col("whole") & ~F.col("confirmed")).alias("unsure")
    runs = found.groupBy("uid", "run").agg(of(False, "lines"), of(True, "wrapped"), unsure)
    notices = F.when(F.size("lines") > 0, F.col("lines")).otherwise(F.col("wrapped"))
    left = F.when((F.size("lines") == 0) & (F.size("wrapped") > 0), 0).otherwise(F.col("unsure"))
    totals = runs.select("uid", notices.alias("notices"), left.alias("unsure")).groupBy("uid").agg(
        F.sum(F.size("notices")).alias("n_licences"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("notices")))).alias("families"), F.sum("unsure").alias("n_unknown")
    )
    number = lambda name: F.coalesce(name, F.lit(0)).cast("long").alias(name)
    families = F.when(F.size("families") > 0, F.array_join("families", ","))
    return read.join(totals, "uid", "left").select("doc_id", "n_paragraphs", number("n_licences"), families.alias("families"), number("n_unknown"))
