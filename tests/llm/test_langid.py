"""Held-out accuracy of the text model, and what the other evidence does."""

import os

import pytest

from gazette.llm import langid

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def documents(spark):
    if not os.path.isdir(FOLDER):
        pytest.skip("driver tables not present")
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


def test_held_out_accuracy(spark, documents):
    model = langid.train(documents.where("doc_id % 2 = 0"))
    assert set(model.languages) == {"de", "en", "es", "fr"}
    rows = documents.where("doc_id % 2 = 1 and n_chars > 60").collect()
    score = langid.likelihoods(model, [r.text for r in rows])
    right = sum(model.languages[k] == r.lang for k, r in zip(score.argmax(1), rows))
    assert right >= 0.97 * len(rows)


def test_fusion(spark, documents):
    model = langid.train(documents)
    by = {lang: [r.text for r in documents.where(f"lang = '{lang}' and n_chars > 300").limit(20).collect()] for lang in ("de", "fr")}
    page = lambda text, lang: f"<html lang='{lang}'><title>The title in English</title><script>var the = 'of and';</script><p>{text}</p></html>"
    rows = [(i, f"http://a.example.fr/{i}", page(t, "fr-FR")) for i, t in enumerate(by["fr"])] + [(100 + i, f"http://b.example.de/{i}", page(t, "de")) for i, t in enumerate(by["de"])]
    rows += [(200, "http://a.example.fr/none", "<html lang=fr><p>!</p></html>"), (201, "http://b.example.de/x", None), (202, None, ""), (203, "http://a.example.fr/g", page(by["de"][0], "fr")), (200, "http://a.example.fr/none", "<html lang=fr><p>!</p></html>"), (None, "http://b.example.de/1", page(by["de"][1], "de"))]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, lang string")
    out = langid.identified(df, model).collect()
    got = {r.page_id: r for r in out}
    assert len(out) == len(rows) and all(0 < r.probability <= 1 for r in out)
    assert all(got[i].lang == "fr" for i in range(20)) and all(got[100 + i].lang == "de" for i in range(20)) and got[None].lang == "de"
    assert got[200].lang == "fr" and got[201].lang == "de" and got[200].declared == "fr" and got[202].declared is None
    assert got[203].lang == "de"  # long text outweighs markup and host
    assert langid.identified(df.limit(0), model).collect() == []


def test_no_model(spark, documents):
    model = langid.train(documents.limit(0))
    assert model.languages == ()
    df = spark.createDataFrame([(1, "u", "x")], "page_id long, url string, html string")
    assert [tuple(r) for r in langid.identified(df, model).collect()] == [(1, None, None, None)]


def test_trigrams_stay_apart():
    a, s = langid.trigrams(["ab", "", "c", "dé"])
    assert s.tolist() == [0, 2, 2, 3, 6] and len(a) == 6
    assert (langid.trigrams(["dé"])[0] == a[3:]).all()
