"""Held-out notices, look-alikes, and edge cases."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from gazette.llm import licences

TEXTS = {
    1: ("Some prose here.\nLicensed under the Apache License, Version 2.0.\nMore prose.", "Apache-2.0"),
    2: ("Released under the MIT License.", "MIT"),
    3: ("x\n\nThis work is licensed under the GNU General Public License, version 3.\nReleased under the MIT License.", "GPL-3.0,MIT"),
    4: ("Licensed under CC BY-NC 4.0.", "CC-BY-NC"),
    5: ("The code in this repository is licensed under the Apache License, Version 2.0, see the file.", "Apache-2.0"),
    6: ("Redistribution and use in source and binary forms, with or without modification, are permitted", "BSD"),
    7: ("The city will license street vendors from May.\nHe had no driving licence.", None),
    8: ("The museum holds the copyright of the picture and gave permission to print it.", None),
    9: ("Plain prose without any of it.\nTwo lines.", None),
    10: (None, None),
    11: ("", None),
    12: ("\n \n", None),
    13: ("word " * 30000 + "\nLICENSED UNDER CC BY-NC 4.0.\n" + "word " * 30000, "CC-BY-NC"),
    14: ("licence " * 50, None),
}


@pytest.fixture(scope="module")
def model(spark):
    return licences.train(spark.createDataFrame([(i, f"Prose number {i} goes on.\nAnd another line {i}.") for i in range(300)], "doc_id long, text string"))


def test_scan(spark, model):
    rows = [(i, t, "x") for i, (t, _) in TEXTS.items()] + [(2, TEXTS[2][0], "x"), (None, TEXTS[2][0], "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, found string")
    out = licences.scanned(df, model).collect()
    assert len(out) == len(rows)
    for r in out:
        want = TEXTS[r.doc_id or 2]
        assert r.families == want[1], r
        assert r.n_licences == (len(want[1].split(",")) if want[1] else 0)
        assert r.n_paragraphs == sum(1 for l in (want[0] or "").split("\n") if l.strip())
    assert licences.scanned(df.limit(0), model).collect() == []


def test_model_is_sparse_and_none_by_default(model):
    assert model.intercepts[0] == max(model.intercepts) and model.slope > 0
    assert sum(x != 0 for _, row in model.weights for x in row) < 0.5 * len(model.weights) * len(model.labels)


def test_every_template_is_found(spark, model):
    rows = [(i, f, t) for i, (f, t) in enumerate((f, t) for f, ts in licences.TEMPLATES.items() for t in ts)]
    got = licences.scanned(spark.createDataFrame(rows, "doc_id long, family string, text string"), model).join(spark.createDataFrame(rows, "doc_id long, family string, text string"), "doc_id")
    right = got.where(F.col("families") == F.col("family")).count()
    assert right >= 0.9 * len(rows)


def test_every_paragraph_is_scored(spark, model):
    want = [
        ("Prose.\nReleased under CC BY-NC 4.0.\nProse.", 1, "CC-BY-NC", 0),
        ("Available under CC BY-SA 4.0.\nDistributed under the GPLv3", 2, "CC-BY-SA,GPL-3.0", 0),
        ("Apache-2.0", 1, "Apache-2.0", 0),
        ("Unter der GNU GPL Version 3 veröffentlicht", 1, "GPL-3.0", 0),
        ("Intro.\n\nPermission is hereby granted, free of charge, to any person\r\nobtaining a copy of this software and associated\r\ndocumentation files, to deal in the Software\r\nwithout restriction", 1, "MIT", 0),
        ("Licensed under the Apache\nLicense, Version 2.0 and so on", 1, "Apache-2.0", 0),
        ("Licensed under the Foobar Source License 3.", 0, None, 1),
        ("Leaflets were passed from hand to hand.", 0, None, 0),
    ]
    texts = spark.createDataFrame([(i, w[0]) for i, w in enumerate(want)], "doc_id long, text string")
    got = licences.scanned(texts, model).orderBy("doc_id").collect()
    assert [(r.n_licences, r.families, r.n_unknown) for r in got] == [w[1:] for w in want]


def test_anchors_pass_over_nothing(spark, model):
    """The same rows come out if no paragraph is passed over, and anchors hold for any sum of weights."""
    notices = [t for several in licences.TEMPLATES.values() for t in several] + list(licences.OTHERS)
    cut = [" ".join(words[start : start + size]) for words in map(str.split, notices) for size in (1, 2, 4, 7) for start in range(0, len(words), 3)]
    texts = spark.createDataFrame(list(enumerate(cut)), "doc_id long, text string")
    assert model.anchors is not None
    some, every = (sorted(map(tuple, licences.scanned(texts, m).collect())) for m in (model, replace(model, anchors=None)))
    assert some == every and any(row[2] for row in some) and any(row[4] for row in some)
    weights = [("the", [0.0, 1.0]), ("of the", [-1.0, 1.0]), ("rare", [0.0, 0.5]), ("none", [2.0, 0.0])]
    assert licences.anchors(weights, (3.4, 0.0), {"the": 9, "of": 5, "rare": 1}) == ("rare",)
    assert licences.anchors(weights, (0.0, 0.0), {}) is None
