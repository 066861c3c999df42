"""Word vectors against plain loops, the classifier by its accuracy on held-out labels."""

import os
import random
import re
import zlib

import numpy as np
import pytest

from gazette.llm import queries, wordvec
from gazette.llm.common import text_bytes

FOLDER = "/root/testdata/sf0.01"
TEXTS = ["Alpha beta!! 12 alpha", "", None, "ünder###x", "   \n", "a", "x y x y x y x y", "1a2b"]


def cut(text):
    return re.findall(r"[^\W\d_]+|[0-9]+|[^\w\s]+", text or "")


def coded(texts):
    import pyarrow as pa

    return wordvec.runs(*text_bytes(pa.array(texts, pa.string())))


def test_runs():
    words, owner = coded(TEXTS)
    want = [(w, i) for i, t in enumerate(TEXTS) for w in cut(t)]
    assert owner.tolist() == [i for _, i in want]
    rows = {}
    for (w, _), row in zip(want, words.tolist()):
        assert rows.setdefault(w, row) == row
    assert len(set(rows.values())) == len(rows)
    assert coded(["", None])[0].tolist() == []


def test_context_vectors_against_loops(spark):
    random.seed(1)
    texts = TEXTS + [" ".join(random.choice("abcdefgh!") for _ in range(random.randint(0, 30))) for _ in range(40)]
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, word int").repartition(3)
    sums, counts = np.zeros((wordvec.WORDS, wordvec.SIZE)), np.zeros(wordvec.WORDS, int)
    for text in texts:
        words = coded([text])[0].tolist()
        for i, w in enumerate(words):
            counts[w] += 1
            for j in range(max(0, i - wordvec.REACH), min(len(words), i + wordvec.REACH + 1)):
                if j != i:
                    for place, value in zip(wordvec._PLACES[words[j]], wordvec._VALUES[words[j]]):
                        sums[w, place] += value
    got_sums, got_counts = wordvec.context_vectors(df)
    assert np.array_equal(got_sums, sums) and np.array_equal(got_counts, counts)


def test_pooled_against_loops():
    rng = np.random.default_rng(0)
    vectors = rng.normal(size=(wordvec.WORDS, wordvec.SIZE)).astype(np.float32)
    words, owner = coded(TEXTS)
    got = wordvec.pooled(words, owner, len(TEXTS), vectors)
    for i in range(len(TEXTS)):
        mine = words[owner == i]
        if not len(mine):
            assert not got[i].any()
            continue
        v = vectors[mine].astype(float)
        want = np.concatenate([v.mean(axis=0), v.std(axis=0), [len(set(mine.tolist())) / len(mine), np.log1p(len(mine)) / 10]])
        assert np.allclose(got[i], want, atol=1e-6)


def test_temperature_mends_overconfidence():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 4))
    y = (rng.random(2000) < 1 / (1 + np.exp(-x[:, 0]))).astype(float)
    model = wordvec.fit(x, y)
    apart = np.arange(len(y)) % 5 == 4
    logits = model.logits(x[apart])
    assert model.temperature > 1 and wordvec._loss(logits / model.temperature, y[apart]) < wordvec._loss(logits, y[apart])


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables not present")
def test_held_out_accuracy(spark):
    rows = {r["doc_id"]: r for r in queries.op13_quality_classifier(spark, FOLDER).collect()}
    assert len(rows) == spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(k).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for k, r in rows.items())
    marks = [(r["quality"], rows[r["doc_id"]]) for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()]
    apart = [(q, r) for q, r in marks if r["held_out"]]
    assert len(apart) > 60 and sum(q == r["predicted"] for q, r in apart) >= 0.93 * len(apart)


def test_held_out_labels_change_nothing(spark):
    texts = ["good plain words here", "bad### words$$$ here###"]
    docs = spark.createDataFrame([(i, texts[i % 2] + f" w{i}") for i in range(200)], "doc_id long, text string")
    labels = [(i, 1 - i % 2) for i in range(200)]
    turned = [(i, y if zlib.crc32(str(i).encode()) % 4 != 2 else 1 - y) for i, y in labels]
    frames = [spark.createDataFrame(rows, "doc_id long, quality int") for rows in (labels, turned)]
    a, b = ({r["doc_id"]: r["score"] for r in wordvec.scored(docs, *wordvec.trained(docs, f)).collect()} for f in frames)
    assert a == b and all((a[i] >= 0.5) == (i % 2 == 0) for i in range(200))


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, "a", 2.0), (None, "x y", "b", 1.0), (2, "", None, None), (2, "", None, None), (3, "long " * 300_000, None, None)], "doc_id long, text string, quality string, score double")
    labels = spark.createDataFrame([(1, 1), (None, 0), (2, None), (9, 0)], "doc_id long, quality int")
    rows = wordvec.scored(docs, *wordvec.trained(docs, labels)).collect()
    assert len(rows) == 5 and {r["score"] for r in rows} == {1.0}  # one example, not enough to learn from
    none = wordvec.scored(docs, *wordvec.trained(docs, labels.limit(0))).collect()
    assert {(r["score"], r["predicted"]) for r in none} == {(0.5, 0)}
    assert wordvec.scored(docs.limit(0), *wordvec.trained(docs.limit(0), labels)).collect() == []
