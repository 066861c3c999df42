"""Targets against plain resharing, permutations, and the mix's bounds."""

import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from gazette.llm import mixing


def plain_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(names)}
    left, out = 1.5 * sum(sizes.values()), {}
    while True:
        open_ = [s for s in names if s not in out]
        over = [s for s in open_ if left * weight[s] / sum(weight[x] for x in open_) > 2 * sizes[s]]
        if not over:
            return out | {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        for s in over:
            out[s] = 2.0 * sizes[s]
        left = 1.5 * sum(sizes.values()) - sum(out.values())


def test_targets(spark):
    random.seed(3)
    for k in (1, 2, 5, 30):
        sizes = {f"s{i}": random.choice([0, 1, 10, 1000, 100000]) for i in range(k)} | {None: 7}
        got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
        want = plain_targets(sizes)
        assert all(abs(got[s] - want[s]) <= 1e-9 * max(1, want[s]) for s in sizes)


def test_permutation(spark):
    for n in (1, 2, 3, 7, 50, 99, 100, 101, 1000, 4097):
        got = [r[0] for r in spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(n * 3).cast("long"))).collect()]
        assert sorted(got) == list(range(n))
    assert got != sorted(got)


def documents(spark):
    random.seed(4)
    rows = []
    for i in range(600):
        source = random.choice(["a"] * 6 + ["b", "b", "c", "d", None])
        text = random.choice([None, "", " \n", " ".join(f"w{i}-{j}" for j in range(random.randint(1, 400)))]) if i % 9 == 0 else " ".join(f"w{i}-{j}" for j in range(random.randint(1, 400)))
        rows.append((i, text, source, "x"))
    rows += [(5, rows[5][1], rows[5][2], "x"), (None, "lost words", "b", "x"), (7000, "only one", "zz", "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size string"), rows


def test_taken(spark):
    df, rows = documents(spark)
    got = mixing.taken(df, block=16).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, mixing.taken(df, block=16).collect()), key=repr)
    size = lambda t: len((t or "").split())
    assert Counter((r.doc_id, r["size"]) for r in got) == Counter((i, size(t)) for i, t, _, _ in rows)
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for _, t, s, _ in rows:
        sizes[s] += size(t)
    names = {i: s for i, _, s, _ in rows}
    for r in got:
        assert 0 <= r.taken <= 2 * r["size"] and r.source_size == sizes[names[r.doc_id]]
        taken[names[r.doc_id]] += r.taken
        target[names[r.doc_id]] = r.target
    for s, want in plain_targets(sizes).items():
        assert abs(target[s] - want) < 1e-6 * want and abs(taken[s] - want) <= 16 * 2
    assert mixing.taken(df.limit(0)).collect() == []
    assert [tuple(r) for r in mixing.taken(spark.createDataFrame([(1, " ", "s")], "doc_id long, text string, source string")).collect()] == [(1, 0, 0, 0.0, 0)]


def test_slots_are_whole_and_texts_follow(spark):
    df, rows = documents(spark)
    laid = mixing.laid_out(df).cache()
    slots = mixing.slots(laid.select("sid", "source_size", "target").distinct(), 16, shard=64).collect()
    assert len({(r.shard, r.slot) for r in slots}) == len(slots) and {r.slot for r in slots} == set(range(len(slots)))
    assert max(Counter((r.sid, r.block) for r in slots).values()) <= 2 and len({(r.sid, r.block, r.round) for r in slots}) == len(slots)
    taken = Counter()
    for r in mixing.taken(df, block=16).collect():
        taken[r.doc_id] += r.taken
    mixed = mixing.mixed(df.where("doc_id is not null"), block=16)
    assert mixed.columns == df.columns
    texts = {i: t for i, t, _, _ in rows}
    for r in mixed.collect():
        words = r.text.split()
        assert words and set(words) <= set(texts[r.doc_id].split())
        assert r.text.split("\n")[0].split() == [w for w in texts[r.doc_id].split() if w in set(r.text.split("\n")[0].split())]
