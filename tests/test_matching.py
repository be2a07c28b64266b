"""Greedy matching with a tolerance and ordered folds, against plain loops."""

import random

import pytest

from clausemill.operators import matching as mt
from clausemill.operators import selection as sl


def greedy(gold, predicted, tolerance):
    free, out = sorted(set(predicted)), []
    for g in sorted(set(gold)):
        near = min(((abs(p - g), p) for p in free if abs(p - g) <= tolerance), default=None)
        if near:
            free.remove(near[1])
            out.append((g, near[1]))
    return out


@pytest.mark.parametrize("tolerance, bucket", [(0, 8192), (1, 5), (3, 8192), (3, 4), (40, 16)])
def test_matches_equal_a_plain_loop(spark, tolerance, bucket):
    rng = random.Random(tolerance * 100 + bucket)
    docs = {f"d{k}": ([rng.randrange(300) for _ in range(rng.randrange(40))], [rng.randrange(300) for _ in range(rng.randrange(40))]) for k in range(25)}
    docs["dense"] = (list(range(0, 900, 2)), list(range(1, 900)))
    frame = lambda side: spark.createDataFrame([(d, p, 0) for d, x in docs.items() for p in x[side]] + [("d0", None, 0)], "doc string, position int, gold int")
    got = sorted(tuple(r) for r in mt.boundary_matches(frame(0), frame(1), "doc", tolerance, bucket).select("doc", "gold", "predicted").collect())
    assert got == sorted((d, g, p) for d, (a, b) in docs.items() for g, p in greedy(a, b, tolerance))


def test_islands_split_at_wide_gaps(spark):
    rows = [(d, p) for d in range(3) for p in (0, 1, 5, 6, 7, 100, 103, 20_000)]
    for bucket in (2, 8192):
        got = {(r.d, r.at): r.island for r in mt.islands(spark.createDataFrame(rows, "d int, at int"), ["d"], "at", 3, bucket).collect()}
        assert got == {(d, p): s for d in range(3) for p, s in ((0, 0), (1, 0), (5, 5), (6, 5), (7, 5), (100, 100), (103, 100), (20_000, 20_000))}


def test_report_of_one_sided_and_empty_documents(spark):
    gold = spark.createDataFrame([("a", 1), ("a", 5), ("b", 3)], "doc string, position int")
    predicted = spark.createDataFrame([("a", 2), ("a", 9), ("c", 3)], "doc string, position int")
    got = sorted(tuple(r) for r in mt.boundary_report(gold, predicted, "doc", 1).collect())
    assert got == [("a", 2, 2, 1, 0.5, 0.5, 0.5), ("b", 1, 0, 0, 0.0, 0.0, 0.0), ("c", 0, 1, 0, 0.0, 0.0, 0.0)]
    assert mt.boundary_report(gold.limit(0), predicted.limit(0), "doc", 1).count() == 0
    with pytest.raises(ValueError):
        mt.boundary_matches(gold, predicted, "doc", -1)


@pytest.mark.parametrize("limit", [1, 3, 10])
def test_checkpoints_share_what_was_taken(spark, limit):
    rng = random.Random(limit)
    topics = {c: [rng.choice("abcdefghijklmnop") * 2 for _ in range(rng.randrange(9))] for c in "PQRST"} | {"U": [" AA", "aa ", "", "bB"], "V": []}
    rows = [(rng.randrange(12), i, rng.choice("PQRSTUVW")) for i in range(400)]
    want, seen = [], {}
    for d, i, c in sorted(rows):
        seen.setdefault(d, set())
        fresh = [k for k in dict.fromkeys(x.strip().casefold() for x in topics.get(c, [])) if k and k not in seen[d]][:limit]
        seen[d].update(fresh)
        if fresh:
            want.append((d, i, c, fresh))
    df = spark.createDataFrame(rows, "doc int, i int, category string")
    assert sorted(tuple(r) for r in sl.curated_checkpoints(df, topics, "doc", ["i"], limit).collect()) == want
    assert sl.curated_checkpoints(df, {"V": []}, "doc", ["i"]).count() == 0
