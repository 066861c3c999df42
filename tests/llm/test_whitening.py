"""Whitening against a plain computation on the driver."""

import math
from collections import Counter

import numpy as np
import pytest

from gazette.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, n int, index string, x int, whitened string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "a", 2, "b") for r in rows], SCHEMA).repartition(4)


def plain(rows):
    good = []
    for key, v in rows:
        if v and all(c is not None and math.isfinite(c) for c in v):
            good.append((key, tuple(math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v)))
    fit = [list(x) for x in sorted({x for _, x in good})]
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array([[(n * v - s) / n for v, s in zip(x, sums)] for x in fit])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:16], vectors[:, ::-1][:, :16]
    out = []
    for key, x in good:
        deviation = sum((n * v - s) ** 2 for v, s in zip(x, sums))
        row = np.array([(n * v - s) / n for v, s in zip(x, sums)]) @ vectors / np.sqrt(values)
        out += [(key, j + 1, n, deviation, row[j], values[j] / np.trace(centred.T @ centred / n)) for j in range(len(values))]
    return out


def compare(got, want):
    assert Counter(r[:4] for r in got) == Counter(r[:4] for r in want)
    order = lambda r: (r[1], r[0] is None, r[0] or 0, abs(r[4]))
    got, want = sorted(got, key=order), sorted(want, key=order)
    for component in {r[1] for r in got}:
        a = np.array([r[4] for r in got if r[1] == component])
        b = np.array([r[4] for r in want if r[1] == component])
        assert np.allclose(a, np.sign(a @ b) * b, atol=1e-8)
    assert np.allclose([r[5] for r in got], [r[5] for r in want], rtol=1e-9)
    assert max(r[6] for r in got) < 1e-8


def test_against_plain_computation(spark, monkeypatch):
    monkeypatch.setattr(whitening, "ROWS", 32)
    monkeypatch.setattr(whitening, "SLAB", 100)
    monkeypatch.setattr(whitening, "TOGETHER", 2)
    rng = np.random.default_rng(1)
    rows = [(i, (rng.normal(size=20) * np.arange(1, 21) + 3).tolist()) for i in range(400)]
    rows += [(1000 + i, rows[7][1]) for i in range(130)] + [rows[3], rows[3]]  # a hot vector, repeated rows
    rows += [(5000, None), (5001, [None] * 20), (5002, [float("nan")] * 20), (5003, [float("inf")] + [0.0] * 19), (5004, []), (None, [1.0] * 20)]
    got = [tuple(r) for r in whitening.whitened(frame(spark, rows)).collect()]
    compare(got, plain(rows))


def test_few_dimensions_and_other_lengths(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=3).tolist()) for i in range(50)]
    got = [tuple(r) for r in whitening.whitened(frame(spark, rows + [(90, [1.0]), (91, [2.0] * 9)])).collect()]
    compare(got, plain(rows))
    assert {r[1] for r in got} == {1, 2, 3}


def test_more_dimensions_than_a_block(spark, monkeypatch):
    monkeypatch.setattr(whitening, "COLUMNS", 8)
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=20) * np.arange(1, 21)).tolist()) for i in range(100)]
    compare([tuple(r) for r in whitening.whitened(frame(spark, rows)).collect()], plain(rows))


def test_directions_without_variance_are_left_out(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [v, 2.0, v]) for i, v in enumerate(rng.normal(size=30).tolist())]
    got = whitening.whitened(frame(spark, rows)).collect()
    assert {r["component"] for r in got} == {1} and len(got) == 30 and abs(got[0]["explained"] - 1) < 1e-12


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [2.0, 3.0])], [(1, [2.0]), (2, [2.0])]])
def test_nothing_to_whiten(spark, rows):
    assert whitening.whitened(frame(spark, rows)).collect() == []


def test_large_entries(spark):
    rows = [(1, [1e9, 0.0]), (2, [-1e9, 5.0]), (3, [0.5, -1e9]), (4, [1e30, 0.0])]
    got = {(r["vec_id"], r["component"]): r["deviation"] for r in whitening.whitened(frame(spark, rows)).collect()}
    assert set(got) == {(i, c) for i in (1, 2, 3) for c in (1, 2)} and set(got.values()) == {None}
