"""Search against brute force."""

import math
import random

import numpy as np

from gazette.llm import topk


def brute(rows, asked, k):
    good = {}
    for key, v in rows:
        if key is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        good[key] = max(good.get(key, []), [math.floor(256 * x) for x in v])
    out = set()
    for q in asked:
        if q in good:
            scored = sorted((-sum(a * b for a, b in zip(good[q], good[c])), c) for c in good if c != q)[:k]
            out |= {(q, rank + 1, c, -s) for rank, (s, c) in enumerate(scored)}
    return out


def test_against_brute_force(spark):
    random.seed(2)
    rows = [(i * 7, [random.gauss(0, 1) for _ in range(8)]) for i in range(400)]
    rows += [(10_000 + i, [0.5] * 8) for i in range(120)]  # ties
    rows += [(20_000, None), (20_001, [1.0, None]), (20_002, [float("nan")] * 8), (20_003, [float("inf")]), (None, [9.0] * 8), (20_004, []), (20_005, [3.0])]
    rows += rows[:3] + [(7, [5.0] * 8)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, score int")
    asked = df.where("vec_id % 5 = 0")
    rounded = [(k, v if v is None else [x if x is None else float(np.float32(x)) for x in v]) for k, v in rows]
    want = brute(rounded, {k for k, _ in rounded if k is not None and k % 5 == 0}, 5)
    got = topk.top_k(df, asked, block=16, shard=4, pack=50).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_blocks_are_skipped():
    rng = np.random.default_rng(0)
    blocks = [(np.arange(i * 10, i * 10 + 10), rng.integers(0, 10, (10, 4)) + 100 * i) for i in range(20)]
    found, score, scored = topk.best_of(np.array([999]), np.ones((1, 4)), blocks, 3)
    assert scored < 5 and sorted(found[0] // 10)[0] == 19


def test_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert {tuple(r) for r in topk.top_k(df, df).collect()} == {(0, 1, 1, 131072), (1, 1, 0, 131072)}
    assert topk.top_k(df.limit(0), df).collect() == [] == topk.top_k(df, df.limit(0)).collect()
    assert topk.top_k(df.limit(1), df.limit(1)).collect() == []


def test_large_components(spark):
    """Exact wherever a score fits into 64 bits."""
    random.seed(4)
    for size in (1e3, 3e5, 1e9, 1e12):
        rows = [(i, [random.uniform(-size, size) for _ in range(4)]) for i in range(60)] + [(100, [size, 1.0, 0.0, 0.0]), (101, [size, 1.0, 0.0, 0.0])]
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        got = {tuple(r) for r in topk.top_k(df, df.where("vec_id % 5 = 0"), block=8, shard=2, pack=9).collect()}
        want = brute(rows, {k for k, _ in rows if k % 5 == 0}, 5)
        assert len(got) == len(want)
        if size < 1e9:  # beyond, scores have no room in 64 bits and tie
            assert got == want
    df = spark.createDataFrame([(0, [300000.0, 1.0]), (1, [900000.0, 0.0]), (2, [800000.0, 5.0])], "vec_id long, embedding array<double>")
    assert [r["vec_id"] for r in topk.top_k(df, df.where("vec_id = 0")).orderBy("rank").collect()] == [1, 2]
    wide = [(np.arange(4), np.array([[10**15, 7], [10**15, 8], [-(10**15), 9], [10**15, 8]]))]
    found, score, _ = topk.best_of(np.array([9]), np.array([[10**12, 1]]), wide, 3)
    assert found.tolist() == [[1, 3, 0]] and set(score[0].tolist()) == {2**63 - 1}
