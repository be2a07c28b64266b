import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from clausemill.llm import common
from clausemill.llm import jaccard_join as J
from clausemill.llm.common import components, table

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows):
    """{class set: smallest id of its component} by comparing all pairs of classes."""
    classes = {}
    for i, t in rows:
        classes.setdefault(shingles(t), []).append(i)
    sets = [s for s in classes if s]
    head = {s: s for s in sets}

    def root(s):
        while head[s] is not s:
            s = head[s]
        return s

    for k, a in enumerate(sets):
        for b in sets[:k]:
            n = len(a & b)
            if 100 * n >= 80 * len(a | b):
                head[root(a)] = root(b)
    least = {}
    for s in sets:
        ids = [i for i in classes[s] if i is not None] + ([least[root(s)]] if least.get(root(s)) is not None else [])
        least[root(s)] = min(ids, default=None)
    return {s: least[root(s)] for s in sets}


def want(rows):
    heads = brute(rows)
    return sorted(((i, len(s), heads[s] if s else i) for i, t in rows for s in [shingles(t)]), key=str)


def variants(rng, n, words, edits):
    base = [f"w{rng.integers(500)}" for _ in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.integers(edits + 1)):
            w[rng.integers(words)] = f"x{rng.integers(10**6)}"
        out.append(" ".join(w))
    return out


def test_edge_cases(spark):
    rng = np.random.default_rng(5)
    texts = [None, "", " \n\t ", "one", "One", "a b c d", "a b c d e", "a b c d e f", " x y"]
    texts += variants(rng, 30, 60, 3) + variants(rng, 30, 200, 12) + ["same text over and over again here"] * 20
    texts += ["long " + " ".join(f"q{i}" for i in range(30_000)), "long " + " ".join(f"q{i}" for i in range(29_000))]
    rows = list(enumerate(texts))
    rows += [(3, "one"), (7, "a b c d e f"), (None, "a b c d e f"), (None, None), (50, "another text under an id used before, with more words"), (None, "only a null id has this text")]
    df = spark.createDataFrame([(i, t, "n", 1) for i, t in rows], "doc_id long, text string, node string, component_id int")
    got = sorted((tuple(r) for r in J.join_components(df).collect()), key=str)
    assert got == want(rows)
    kept = J.keep_one(df)
    assert kept.columns == df.columns
    kept = [(r.doc_id, r.text) for r in kept.collect()]
    heads = brute(rows)
    # one row of each component: components are those of the plain join, told apart by a member's set
    full = [shingles(t) for _, t in kept if shingles(t)]
    sets = [x for x in {shingles(t) for _, t in rows} if x]
    group = {x: x for x in sets}

    def root(x):
        return x if group[x] is x else root(group[x])

    for k, a in enumerate(sets):
        for b in sets[:k]:
            if 100 * len(a & b) >= 80 * len(a | b):
                group[root(a)] = root(b)
    assert len({root(x) for x in sets}) == len(full) == len({root(x) for x in full})
    assert sorted(str(r) for r in kept if not shingles(r[1])) == sorted(str(r) for r in rows if not shingles(r[1]))
    assert J.join_components(df.limit(0)).count() == 0 and J.keep_one(df.limit(0)).count() == 0


def test_families_of_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(J, "BLOCK", 8)
    monkeypatch.setattr(J, "SPLIT", 1)
    rng = np.random.default_rng(9)
    rows = list(enumerate(variants(rng, 90, 60, 5) + variants(rng, 40, 40, 6) + variants(rng, 3, 50, 1)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(r) for r in J.join_components(df).collect()), key=str) == want(rows)


def test_whole_table(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in J.join_components(docs).collect()), key=str) == want(rows)
    kept = [r.doc_id for r in J.keep_one(docs).collect()]
    assert sorted(kept) == sorted({c for _, n, c in want(rows)})


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(0, 40), min_size=1, max_size=40), min_size=2, max_size=14))
def test_tree_misses_no_pair(lists):
    rng = np.random.default_rng(1)
    names = np.sort(rng.integers(0, 2**63, 41).astype(np.uint64))
    sets = [np.unique(names[x]) for x in lists]
    points = [J.count_point(s) for s in sets]
    every = list(range(len(sets)))
    found = {p for x, y in J.point_survivors(points, every, every) for i, j in zip(x.tolist(), y.tolist()) for p in ((i, j), (j, i))}
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            if J.linked(a, b):
                assert (i, j) in found
                k = J.prefix_length(len(a)), J.prefix_length(len(b))
                assert set(a[: k[0]].tolist()) & set(b[: k[1]].tolist())


@pytest.mark.parametrize("dealt", [4, 1 << 16])
def test_components(spark, monkeypatch, dealt):
    monkeypatch.setattr(common, "EDGES_DEALT", dealt)
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 90), (90, 95), (200, 201), (201, 202), (5, 5), (7, 3)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {i: 1 for i in range(1, 41)} | {90: 90, 95: 90, 100: 90} | {200: 200, 201: 200, 202: 200}


def test_points_of_unlike_widths():
    rng = np.random.default_rng(3)
    names = np.sort(rng.integers(0, 2**63, 4000).astype(np.uint64) * np.uint64(2))
    sets = [names[np.sort(rng.permutation(n)[: n - 9])] for n in (90, 100, 110, 120, 380, 395, 410, 3000, 3100, 3400)]
    points = [J.count_point(s) for s in sets]
    assert all((J.unpack_point(J.pack_point(p)) == p).all() for p in points)
    left, right = list(range(0, 10, 2)), list(range(1, 10, 2))
    every = list(range(10))
    for a, b in ((left, right), (right, left), (every, every)):
        found = {(int(i), int(j)) for x, y in J.point_survivors(points, a, b) for i, j in zip(x, y)}
        for i in a:
            for j in b:
                assert not J.linked(sets[i], sets[j]) or (i, j) in found or a is b and (j, i) in found
