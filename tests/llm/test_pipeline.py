"""Every stage against a plain version of it, on the smallest driver tables."""

import hashlib
import os
import re
from collections import defaultdict

import pytest
from test_minhash import plain as plain_components
from test_mixing import plain_targets
from test_suffix import plain as plain_removal

import __spark_entry__ as entry
import corpus_pipeline
from gazette.llm import bpe
from gazette.llm.common import shared_path
from gazette.llm.common import stored as common_stored
from gazette.llm.queries import vocabulary

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables not present")
WORD = "[^\x20\x09-\x0d]+"


def stored(df, name):
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def passes(text):
    """The quality rules in plain words."""
    words = re.findall(WORD, text or "")
    grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    covered = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(i, i + 8)}
    n, letters = len(words), [c for c in text if c.isalpha()]
    upper = sum(c.isupper() for c in letters)
    runs = sum(a == b for a, b in zip(words, words[1:]))
    return not (
        n < 20 or 100 * len(covered) > 30 * n or 10 * len(re.findall(r"[#*$%&|<>]", text)) > n or 10 * text.count("!!") > n or 2 * upper > len(letters) or 2 * len(letters) < len(text)
        or len(text) > 20 * n or 5 * len(text) < 12 * n or 5 * runs > n
    )


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").where("n_chars < 6000")
    (_, rules), (_, near), (_, passages), (_, mix), (_, tokens) = corpus_pipeline.STAGES
    texts = lambda df: {r.doc_id: r.text for r in df.collect()}

    before = texts(docs)
    good = stored(rules(spark, docs, FOLDER), "t")
    assert good.columns == docs.columns and set(texts(good)) == {i for i, t in before.items() if passes(t)}

    before = texts(good)
    single = stored(near(spark, good, FOLDER), "t")
    assert single.columns == docs.columns
    assert set(texts(single)) == {i for i, _, root in plain_components(list(before.items()), 5) if i == root}

    before = texts(single)
    clean = stored(passages(spark, single, FOLDER), "t")
    want = {i: kept.decode("utf-8", "ignore") for i, (_, _, _, kept) in plain_removal(list(before.items())).items()}
    assert clean.columns == docs.columns and texts(clean) == {i: t for i, t in want.items() if re.search(WORD, t) or t == before[i]}
    assert all(r.n_chars == len(r.text) for r in clean.collect())

    rows = {r.doc_id: r for r in clean.collect()}
    mixed = stored(mix(spark, clean, FOLDER), "t")
    assert mixed.columns == docs.columns
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in rows.values():
        sizes[r.source] += len(re.findall(WORD, r.text))
    for r in mixed.collect():
        own = re.findall(WORD, rows[r.doc_id].text)
        got = re.findall(WORD, r.text)
        assert len(got) <= 2 * len(own) and set(got) <= set(own) and r.source == rows[r.doc_id].source
        taken[r.source] += len(got)
    for source, target in plain_targets(sizes).items():
        assert abs(taken[source] - target) <= 128

    tiktoken = pytest.importorskip("tiktoken")
    path, pattern = vocabulary()
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    mixed_texts = texts(mixed)
    out = tokens(spark, mixed, FOLDER).collect()
    assert {r.doc_id for r in out} == set(mixed_texts)
    for r in out:
        assert list(r.ids) == library.encode_ordinary(mixed_texts[r.doc_id]) and r.decoded_sha256 == hashlib.sha256(mixed_texts[r.doc_id].encode()).hexdigest()


def test_run_is_registered_and_takes_empty_tables(spark, tmp_path):
    assert entry.queries()["pipeline"] is corpus_pipeline.run and "pipeline" not in entry.oracle_sql()
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    docs.limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_tables_of_others_outlive_a_run(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(30)
    mine = common_stored(docs.select("doc_id"), "mine")
    one, other = str(tmp_path / "a"), str(tmp_path / "b")
    first = corpus_pipeline.near_duplicates(spark, docs, one)
    corpus_pipeline.near_duplicates(spark, docs, other)
    assert first.count() > 0 and mine.count() == 30  # the other run took nothing away
    corpus_pipeline.repeated_passages(spark, docs, one)
    assert corpus_pipeline._TABLES[one] and mine.count() == 30
