"""The manifest against a plain one."""

import random
import zlib
from hashlib import sha256

import pytest

from gazette.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, pos int, total string"


def h(text):
    return sha256(text.encode()).hexdigest()


def shown(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h("".join(out[-1][i : i + 16])) for i in range(0, len(out[-1]), 16)])
    return out


def siblings(tree, place):
    text, steps = "", []
    for level in tree[:-1]:
        start = place // 16 * 16
        run = level[start : start + 16]
        steps.append((run, place - start))
        text += "".join(run[: place - start] + run[place - start + 1 :])
        place //= 16
    return text, steps


def plain(rows):
    def leaf(r, text):
        return h("".join(map(shown, (r[0], r[3], r[2], r[4], text))))

    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    groups = {}
    for r in rows:
        struck = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
        before = leaf(r, r[1])
        groups.setdefault(r[3], []).append((r[0], before, leaf(r, r[1] and r[1].translate(lower)) if struck else before))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        groups[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[s] = levels([x[1] for x in groups[s]])
    top = levels([trees[s][-1][0] for s in order])
    out = []
    for number, s in enumerate(order):
        for place, (doc_id, before, after) in enumerate(groups[s]):
            (a, low), (b, high) = siblings(trees[s], place), siblings(top, number)
            fold = after
            for run, at in low + high:
                fold = h("".join(run[:at] + [fold] + run[at + 1 :]))
            out.append((doc_id, before, trees[s][-1][0], top[-1][0], h(a + b), fold, fold == top[-1][0]))
    return out


def documents(spark, rows):
    return spark.createDataFrame([(*r, "k", 1, "t") for r in rows], SCHEMA).repartition(5)


def same(spark, rows):
    got = [tuple(r) for r in merkle.manifest(documents(spark, rows)).collect()]
    assert sorted(got, key=repr) == sorted(plain(rows), key=repr)
    return got


def test_against_plain_tree(spark):
    random.seed(3)
    text = lambda: " ".join(random.choice(["Alpha", "beta", "Ünder", "GAMMA", "\n"]) for _ in range(random.randint(0, 9)))
    rows = [(i, text(), "en", random.choice(["hot", "hot", "hot", "b", "ä"]), i * 3) for i in range(900)]
    rows += [(2000 + i, text(), "de", f"s{i}", 1) for i in range(290)]  # more sources than a block
    rows += [(5, None, None, None, None), (None, "X", "en", None, 2), (None, None, None, "b", None), (7, "", "", "", 0)]
    rows += [rows[0]] * 3 + [(1, "Other text", "en", "hot", 9), (10, "A" * 300_000, "en", "hot", 9)]
    got = same(spark, rows)
    assert 100 < sum(not r[-1] for r in got) < 400


@pytest.mark.parametrize("n", [1, 2, 16, 17, 256, 257, 273])
def test_sizes_of_one_source(spark, n):
    same(spark, [(i, "Text", "en", "s", 4) for i in range(n)])


def test_a_version_shares_all_but_the_path():
    tree = merkle.grown([h(str(i)) for i in range(200)], 200)
    copied = merkle.version(tree, 37, h("new"))
    assert [(depth, place) for depth, place, _ in copied] == [(0, 37), (1, 2), (2, 0)]
    again = merkle.grown([h(str(i)) if i != 37 else h("new") for i in range(200)], 200)
    changed = {(d, p): node for d, p, node in copied}
    assert all(again[d][p] == changed.get((d, p), tree[d][p]) for d in range(3) for p in range(len(tree[d])))
    assert tree[0][37] == h("37")


def test_empty_table(spark):
    assert merkle.manifest(documents(spark, [])).collect() == []
