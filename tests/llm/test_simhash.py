import itertools
import re

import numpy as np
import pytest
import xxhash

from clausemill.llm import simhash as S
from clausemill.llm.common import table

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    grams = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = np.array([xxhash.xxh64_intdigest(g.encode(), 42) for g in grams], np.uint64)
    return sum(1 << k for k in range(64) if 2 * int((h >> np.uint64(k) & np.uint64(1)).sum()) > len(h))


def heads_of(values, radius=3):
    """Positions of the components' first members, by comparing all pairs."""
    fp = np.array(values, np.uint64)
    label = list(range(len(fp)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(fp)):
        for j in np.flatnonzero(np.bitwise_count(fp[:i] ^ fp[i]) <= radius).tolist():
            a, b = root(i), root(j)
            label[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(fp))]


def want(rows):
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    fps = [fingerprint(t) for _, t in rows]
    return sorted(((i, f"{f:016x}", rows[h][0]) for (i, _), f, h in zip(rows, fps, heads_of(fps))), key=str)


def got(df):
    return sorted(map(tuple, S.near_duplicates(df).collect()), key=str)


def test_hash_is_that_of_spark(spark):
    from pyspark.sql import functions as F

    r = spark.createDataFrame([("one two three",), ("ünï",), ("x" * 50,)], "t string").select("t", F.xxhash64("t").alias("h")).collect()
    assert all(x.h % 2**64 == xxhash.xxh64_intdigest(x.t.encode(), 42) for x in r)


@pytest.mark.parametrize("bits", [64, 20, 7, 3, 0])
def test_covering_keeps_none_of_any_three_bits(bits):
    masks = S.covering((1 << bits) - 1)
    for some in itertools.combinations(range(bits), min(3, bits)):
        assert any(not m & sum(1 << b for b in some) for m in masks)


def test_levels_leave_few_bits_free():
    levels = S.tables()
    assert [len(x) for x in levels] == [15, 225, 3375]
    assert max((~m & 2**64 - 1).bit_count() for _, _, m in levels[-1]) <= 8


def test_edge_cases(spark):
    rows = [(i, t) for i, t in enumerate([None, "", " \t\n", "One", "ONE", "one two", "one  two\n", "ünï ÜNÏ x y", "é" * 300, "a b c d", "A b\tc D", "a b c d"])]
    rows += [(None, "one"), (None, None), (None, "alone here indeed"), (7, "a b c d"), (20, " ".join(f"w{k % 911}" for k in range(70_000)))]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "doc_id long, text string, fp long, component string")
    assert got(df) == want(rows)
    assert S.near_duplicates(df.limit(0)).columns == ["doc_id", "fingerprint", "component_id"] and S.near_duplicates(df.limit(0)).count() == 0


def test_whole_table(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    result = got(docs)
    assert result == want([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert sum(r[0] != r[2] for r in result) > 20


@pytest.mark.parametrize("block", [512, 16])
def test_large_buckets_lose_no_link(spark, monkeypatch, block):
    """Clouds of fingerprints around few centres, in chains of up to three bits a step."""
    monkeypatch.setattr(S, "BLOCK", block)
    rng, fps = np.random.default_rng(block), {0, 2**64 - 1, 2**63}
    for _ in range(6):
        x = int(rng.integers(0, 2**63))
        for _ in range(400):
            y = x
            for b in rng.choice(64, int(rng.integers(1, 7)), replace=False).tolist():
                y ^= 1 << b
            fps.add(y)
            x = y if rng.random() < 0.03 else x
    for k in range(1 << 9):  # all values of nine neighbouring bits
        fps.add(k)
    fps = sorted(fps)
    df = spark.createDataFrame([(int(np.int64(np.uint64(f))),) for f in fps], "fp long")
    from clausemill.llm.common import components

    heads = {r.id % 2**64: r.component for r in components(S.near_links(df)).collect()}
    ours = [heads.get(f, f"own {f}") for f in fps]
    theirs = heads_of(fps)
    assert [ours.index(x) for x in ours] == theirs
    assert len(set(theirs)) > 3
