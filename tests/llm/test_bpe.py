"""Encoding against the reference library, decoding against plain decoding."""

import base64
import random
import tracemalloc

import pytest
import regex

from gazette.llm import bpe, common
from gazette.llm.queries import vocabulary

tiktoken = pytest.importorskip("tiktoken")
PATH, PATTERN = vocabulary()
RANKS = bpe.read_ranks(PATH)
TEXTS = ["", None, " ", "a", "Hello  world\n\n\t x's 12345 !!!", "é漢字🙂🙂 naïve", "a" * 5000, "x\x1cy\x85z  end ", "the the the"]


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=RANKS, special_tokens={})


def test_transducer_equals_library(library):
    random.seed(5)
    made = bpe.Transducer(RANKS)
    for alphabet in ("abcdeé \n", "ththeaning ", "漢字🙂é#*\t1 ", "".join(map(chr, range(32, 700)))):
        for _ in range(400):
            text = "".join(random.choice(alphabet) for _ in range(random.randint(0, 60)))
            got = [i for word in regex.findall(PATTERN, text) for i in made.encode(word.encode())]
            assert got == library.encode_ordinary(text)


def test_splitter():
    random.seed(6)
    split, whole = bpe.splitter(PATTERN), regex.compile(PATTERN).findall
    assert bpe.simple_form(PATTERN) and bpe.simple_form(r"\bx") is None
    for top in (128, 256, 0x250, 0x3000):
        for _ in range(300):
            text = "".join(chr(random.randrange(top)) for _ in range(50)) + "it's  12 we'll\n\n x"
            assert split(text) == whole(text)


def test_restart_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(bpe, "MOST_STATES", 20)
    monkeypatch.setattr(bpe, "MOST_WORDS", 3)
    words = bpe.Words(bpe.Transducer(RANKS))
    text = "several words that are not the same, several times over several"
    assert [i for w in regex.findall(PATTERN, text) for i in words[w]] == library.encode_ordinary(text)


def test_tables_are_small():
    random.seed(7)
    made = bpe.Words(bpe.Transducer(RANKS))
    words = [" " + "".join(random.choice("etaoinshrdlu") for _ in range(random.randint(3, 9))) for _ in range(10_000)]
    tracemalloc.start()
    try:
        for word in words:
            made[word]
        taken = tracemalloc.get_traced_memory()[0]
    finally:
        tracemalloc.stop()
    assert taken / len(words) < 1250, taken / len(words)


def test_memory_of_operators_without_tables_goes_back(monkeypatch):
    trims = []
    monkeypatch.setattr(common, "_TABLES", {})
    monkeypatch.setattr(common.gc, "collect", lambda: trims.append(1))
    common.alone("suffix")
    common.alone("suffix")
    assert not trims
    common.alone("bpe", lambda: None)
    assert len(trims) == 1
    assert list(common.handing_back(lambda batches: iter(batches))([1, 2])) == [1, 2] and len(trims) == 2


def test_stream_decoder_in_any_pieces():
    data = "aé漢🙂z".encode() + b"\xff\xe6\xbc" + "ü".encode() + b"\xf0\x9f" + b"\xed\xa0\x80" + b"\xe6"
    tokens = {i: data[i : i + 1] for i in range(len(data))}
    for size in (1, 2, 3, 5, 100):
        stream = bpe.StreamDecoder(tokens)
        parts = [stream.feed(range(len(data))[at : at + size]) for at in range(0, len(data), size)]
        assert "".join([*parts, stream.close()]) == data.decode("utf-8", "replace")


def test_frames(spark, library):
    rows = [(i, text, "same") for i, text in enumerate(TEXTS)] + [(0, TEXTS[4], None), (None, "x", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, batch string")
    out = bpe.decode(bpe.encode(df, PATH, PATTERN), PATH).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in out) == sorted((i is None, i or 0, t or "") for i, t, _ in rows)
    for row in out:
        assert list(row.ids) == library.encode_ordinary(row.text or "")
        assert bytes(row.decoded).decode() == (row.text or "")
    assert bpe.digests(df.limit(0), PATH, PATTERN).collect() == []
    with pytest.raises(ValueError):
        bpe.encode(df.withColumnRenamed("batch", "ids"), PATH, PATTERN)
