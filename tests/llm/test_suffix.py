"""Suffix arrays and removal against brute force."""

import random

import numpy as np
import pyarrow as pa

from gazette.llm import suffix
from gazette.llm.common import slices


def test_suffix_array_and_prefixes():
    rng = np.random.default_rng(3)
    for n, letters in ((0, 2), (1, 2), (300, 2), (500, 4), (2000, 1), (4000, 30)):
        data = rng.integers(97, 97 + letters, n).astype(np.uint8)
        order = suffix.suffix_array(data, 50)
        text = data.tobytes()
        tops = [text[i : i + 50] for i in order]
        assert sorted(order) == list(range(n)) and [t.ljust(50, b"\0") for t in tops] == sorted(t.ljust(50, b"\0") for t in tops)
        got = suffix.common_prefixes(data, order, 50)
        for k in range(1, n):
            a, b = tops[k - 1], tops[k]
            want = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            assert got[k] == want


def test_shards_give_the_same():
    random.seed(1)
    texts = ["".join(random.choice("ab ") for _ in range(random.randint(10, 60))) for _ in range(60)]
    texts += texts[:20]
    where = {}
    for doc, text in enumerate(texts):
        for i in range(len(text) - 7):
            where.setdefault(text[i : i + 8], doc)
    for size in (1, 7, 80):
        shards, starts = [], []
        for k in range(0, len(texts), size):
            data = "".join(texts[k : k + size]).encode()
            docs = np.full(len(data), np.iinfo(np.int64).max)
            at = 0
            for doc, text in enumerate(texts[k : k + size], k):
                docs[at : at + len(text) - 7] = doc
                starts += [(len(shards), at + i, where[text[i : i + 8]]) for i in range(len(text) - 7)]
                at += len(text)
            shards.append((np.frombuffer(data, np.uint8), docs))
        got = suffix.earliest(shards, 8)
        assert all(got[s][i] == want for s, i, want in starts)


def plain(rows, length=50):
    first = {}
    for doc, text in sorted(rows):
        data = text.encode()
        for i in range(len(data) - length + 1):
            first.setdefault(data[i : i + length], doc)
    out = {}
    for doc, text in rows:
        data = text.encode()
        gone = np.zeros(len(data), bool)
        for i in range(len(data) - length + 1):
            if first[data[i : i + length]] < doc:
                gone[i : i + length] = True
        spans = sum(1 for i in range(len(gone)) if gone[i] and (not i or not gone[i - 1]))
        out[doc] = (len(data), int(gone.sum()), spans, np.frombuffer(data, np.uint8)[~gone].tobytes())
    return out


def corpus():
    random.seed(8)
    words = [f"{a}{b}" for a in "the of and én ing".split() for b in ("", "th", "re", "ion")]
    say = lambda n: " ".join(random.choices(words, k=n))
    passages = [say(20) for _ in range(6)] + ["x" * 200, "ab" * 120]
    rows = []
    for doc in range(160):
        parts = [say(random.randint(1, 60))]
        for _ in range(random.randint(0, 3)):
            p = random.choice(passages)
            a = random.randint(0, 20)
            parts += [p[a : a + random.choice([40, 49, 50, 51, 60, 90, 500])], say(random.randint(0, 30))]
        rows.append((doc * 5 % 167, random.choice(["", " "]).join(parts)))
    rows += [(1000, rows[3][1]), (1001, rows[3][1][:80] + "!" + rows[3][1][81:]), (1002, "x" * 49), (1003, "x" * 50), (1004, ""), (1005, passages[0] + say(9) + passages[0]), (2**40, rows[7][1]), (-4, rows[9][1][5:150])]
    return rows


def test_removal(spark):
    rows = corpus()
    want = plain(rows)
    df = spark.createDataFrame([(*r, 0) for r in rows] + [(None, rows[0][1], 0), (3000, None, 0)], "doc_id long, text string, n_bytes int").repartition(6)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix.removal(df).collect()}
    assert got.pop(3000) == (0, 0, 0, b"") and got.pop(None)[1:3] == (0, 0)
    assert got == want
    assert suffix.removal(df.limit(0)).collect() == []


def test_units_that_share_no_window_are_not_compared():
    """An anchor met by chance, with other bytes on both sides, costs no comparison; with the same on either side it does."""
    rng = np.random.default_rng(5)
    draw = lambda n: rng.integers(97, 123, n).astype(np.uint8).tobytes().decode()
    gram = draw(16)

    def asked(texts):
        data = "".join(texts).encode()
        found = suffix.units(np.frombuffer(data, np.uint8), np.cumsum([0, *map(len, texts)]), 50)
        rows = np.zeros(len(found["at"]), suffix.UNIT)
        for name in ("anchor", "content", "at", "count", "before", "after"):
            rows[name] = found[name]
        rows["doc"] = found["text"]
        return {int(doc) for doc in suffix.grouped(rows)[1]["doc"]}

    assert asked([draw(100) + gram + draw(100) for _ in range(400)]) == set()
    left, right = draw(60), draw(60)
    assert asked([draw(100) + left + gram + draw(100), draw(200), draw(90) + left + gram + draw(70)]) == {0, 2}
    assert asked([draw(100) + gram + right + draw(100), draw(200), draw(90) + gram + right + draw(70)]) == {0, 2}


def test_whole_copies_go_first(spark, monkeypatch):
    """Copies of whole texts make no units, and what is removed is the same with and without that step."""
    rows = corpus()
    rows += [(doc + 5000 * k, text) for k in (1, 2) for doc, text in rows if doc < 200]
    want = plain(rows)
    # ids that repeat: with the same text, and with another one
    extra = [(200000, rows[2][1]), (200000, rows[2][1]), (200000, rows[4][1]), (200001, "short"), (200002, "short")]
    df = spark.createDataFrame([(*r, 7) for r in rows + extra] + [(None, rows[0][1], 7)], "doc_id long, text string, n int").repartition(4)
    handed = []
    made = suffix.packed_units
    monkeypatch.setattr(suffix, "packed_units", lambda texts, *rest: (handed.append(texts.count()), made(texts, *rest))[1])
    results = []
    for most in (8, 0):
        monkeypatch.setattr(suffix, "COPIED", most)
        found = suffix.removal(df, carry=("n",)).collect()
        results.append(sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept), r.n) for r in found))
        assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in found if r.doc_id is not None and r.doc_id < 200000 or r.doc_id == 2**40} == want
    assert results[0] == results[1] and len(results[0]) == len(rows) + len(extra) + 1
    assert handed[0] < len(rows) / 2 and handed[1] == len(rows) + len(extra)


def test_long_text_in_pieces(monkeypatch):
    monkeypatch.setattr(suffix, "PIECE", 64)
    data = np.random.default_rng(0).integers(97, 100, 1000).astype(np.uint8)
    whole = suffix.units(data, np.array([0, 1000]), 50)
    windows = {(a, i) for a, at, n in zip(whole["anchor"], whole["at"], whole["count"]) for i in range(at, at + n)}
    pieces = set()
    for base in range(0, 1000, 64):
        part = suffix.units(data[base : base + 64 + 49], np.array([0, min(1000 - base, 113)]), 50)
        pieces |= {(a, i + base) for a, at, n in zip(part["anchor"], part["at"], part["count"]) for i in range(at, at + n)}
    assert pieces == windows and len({i for _, i in windows}) == 951


def test_slices_leave_long_texts_alone():
    batch = pa.RecordBatch.from_pydict({"text": ["", None, "x" * 30, "", None, "y" * 4, "z" * 5, "w" * 30, "v" * 30]})
    assert [part.column(0).to_pylist() for part in slices(batch, "text", 10)] == [["", None], ["x" * 30], ["", None, "y" * 4, "z" * 5], ["w" * 30], ["v" * 30]]


def test_long_text_behind_empty_ones(spark):
    random.seed(4)
    long = "".join(random.choices("abcdefghijklmnopqrstuvwxyz ", k=suffix.PIECE + 100_000))
    first, last = long[1000:1200], long[-300:-100]
    rows = [(0, ""), (1, None), (7, long), (3, first), (9, last)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in suffix.removal(df).collect()}
    assert got == {0: (0, 0, 0), 1: (0, 0, 0), 7: (len(long), 200, 1), 3: (200, 0, 0), 9: (200, 200, 1)}


def test_pack():
    rng = np.random.default_rng(0)
    n = 50
    columns = {"anchor": rng.integers(0, 2**63, n, dtype=np.uint64), "content": rng.integers(0, 2**63, n, dtype=np.uint64), "doc": np.sort(rng.integers(-(2**60), 2**60, n)), "at": rng.integers(0, 2**31 - 1, n), "count": rng.integers(1, 36, n), "left": rng.integers(0, 35, n)}
    got = suffix.unpack(suffix.pack(columns))
    for name in ("doc", "at", "count"):
        assert (got[name] == columns[name]).all()
    assert (got["anchor"] == columns["anchor"] & np.uint64((1 << 40) - 1)).all()


def test_columns_of_any_name_pass(spark):
    passage = "a passage that is long enough to be found in two of the documents, surely. "
    names = ["kept", "n_removed", "n_bytes", "n_spans", "runs", "place", "carried_kept", "n_chars"]
    rows = [(i, f"begin {i} " + passage + f" end {i}", *range(len(names))) for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} int" for n in names))
    out = {r["doc_id"]: r for r in suffix.cleaned(df).collect()}
    assert suffix.cleaned(df).columns == df.columns
    assert out[0]["text"] == rows[0][1] and passage not in out[1]["text"] and passage not in out[2]["text"]
    assert all(r[n] == i for r in out.values() for i, n in enumerate(names[:-1])) and out[1]["n_chars"] == len(out[1]["text"])
