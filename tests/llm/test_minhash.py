"""Components against all pairs by brute force, and the guarantee of the keys."""

import random
import re

import numpy as np

from gazette.llm import minhash
from gazette.llm.graph import components


def plain(rows, size, percent=80):
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    sets = []
    for _, text in rows:
        w = [x for x in re.split("[\x20\x09-\x0d]+", lower(text)) if x]
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and sets[j] and None not in (rows[i][0], rows[j][0]) and 100 * common >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[find(i)] = min(least.get(find(i), key), key)
    return sorted(((key, len(sets[i]), None if key is None else least[find(i)]) for i, (key, _) in enumerate(rows)), key=repr)


def corpus():
    random.seed(9)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, key = [], 0
    for group in range(25):
        base = random.choices(vocabulary, k=random.randint(3, 150))
        for copy in range(random.choice([1, 2, 3, 12])):
            words = list(base)
            for _ in range(int(len(words) * random.choice([0, 0, 0.02, 0.05, 0.08, 0.1]))):
                words[random.randrange(len(words))] = random.choice(vocabulary)
            rows.append((key * 3 % 1009, random.choice([" ", "\n", " \t"]).join(words).replace("w", random.choice("wW"))))
            key += 1
    return rows + [(5000, None), (5001, ""), (5002, " \n"), (5003, "one"), (5004, "ONE"), (5005, "one é"), (5006, "É one"), (None, "one"), (5003, "one"), (5007, "x " * 20000), (5008, "x " * 30000)]


def test_against_all_pairs(spark):
    rows = corpus()
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, node int").repartition(5)
    for size in (2, 5):
        got = minhash.near_duplicates(df, size).collect()
        assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == plain(rows, size)
        assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert minhash.near_duplicates(df.limit(0)).collect() == []


def test_pairs_within_distance_share_a_key(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**16, (200, minhash.COMPONENTS), dtype=np.uint16)
    near = base.copy()
    for row in near:
        row[rng.choice(minhash.COMPONENTS, minhash.DISTANCE, replace=False)] += 1
    df = spark.createDataFrame([(i, bytearray(r.tobytes())) for i, r in enumerate([*base, *near])], "node long, signature binary")
    got = {}
    for r in minhash.keys(df).collect():
        got.setdefault(r.node, set()).add(r.key)
    assert all(got[i] & got[i + 200] for i in range(200)) and not got[0] & got[1]


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (200, 200)] + [(300, i) for i in range(301, 340)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, **{i: 300 for i in range(300, 340)}}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_one_row_of_each_group_stays(spark):
    text = " ".join(f"word{i}" for i in range(60))
    other = " ".join(f"else{i}" for i in range(60))
    rows = [(1, text, "a"), (1, text, "b"), (None, text, "c"), (None, other, "d"), (None, other, "e"), (7, other + " end", "f"), (7, "quite another text of its own", "g"), (3, text + " end", "h"), (9, "", "i"), (9, None, "j"), (9, None, "k")]
    df = spark.createDataFrame([(*r, 0, 0) for r in rows], "doc_id long, text string, row string, component int, node int").coalesce(1)
    kept = minhash.kept_documents(df)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"], r["row"]) for r in kept.collect()) == [(1, "a"), (7, "f"), (7, "g"), (9, "i"), (9, "j"), (9, "k")]
    assert minhash.kept_documents(df.limit(0)).collect() == []
