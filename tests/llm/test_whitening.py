import math

import numpy as np
import pytest

from clausemill.llm import whitening as W
from clausemill.llm.common import table


def plain(vectors, most=16):
    """Exact sums and deviations by Python's integers, axes by numpy's eigenvectors."""
    xs = [tuple(math.floor(64 * float(c)) + 1_000_000 for c in v) for v in vectors]
    fit = sorted(set(xs))
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    y = np.array([[n * c - s for c, s in zip(x, sums)] for x in fit], float) / n
    e, v = np.linalg.eigh(y.T @ y / n)
    e, v = e[::-1], v[:, ::-1]
    return xs, n, sums, e, v[:, :most]


def compare(spark, rows, result, most=16):
    kept = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    xs, n, sums, e, v = plain([v for _, v in kept], most)
    got: dict = {}
    for r in result:
        got.setdefault(r.vec_id, []).append(r)
    assert set(got) == {i for i, _ in kept}
    signs = None
    for (i, _), x in zip(kept, xs):
        each = sorted(got[i], key=lambda r: r.component)
        assert [r.component for r in each] == list(range(1, v.shape[1] + 1))
        y = [n * c - s for c, s in zip(x, sums)]
        assert {(r.n, r.deviation) for r in each} == {(n, sum(c * c for c in y))}
        z = np.array(y, float) / n @ v / np.sqrt(e[: v.shape[1]])
        w = np.array([r.whitened for r in each])
        signs = np.sign(z * w) if signs is None else signs
        assert w * signs == pytest.approx(z, abs=1e-6)
        assert [r.explained for r in each] == pytest.approx(e[: v.shape[1]] / e.sum(), rel=1e-6)
        assert {r.identity_error for r in each} == {each[0].identity_error} and each[0].identity_error < 1e-9


def test_whole_table(spark):
    rows = table(spark, "/root/testdata/sf0.01", "embeddings")
    compare(spark, [(r.vec_id, r.embedding) for r in rows.collect()], W.whiten(rows).collect())


def test_factors_merge_up_the_tree(spark):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.standard_normal(5) * [9, 5, 3, 2, 1] + [0, 1e4, -3, 0, 0]).tolist()) for i in range(900)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(40)
    n, sums = W.exact_sums(fit := W.whole_vectors(df).distinct().repartition(40))
    r = W.last_factor(fit, n, sums)
    y = np.array([[n * (math.floor(64 * c) + 1_000_000) - s for c, s in zip(v, sums)] for _, v in rows], float) / n
    assert n == 900 and r.shape == (5, 5) and r.T @ r == pytest.approx(y.T @ y, rel=1e-9, abs=1e-3)
    compare(spark, rows, W.whiten(df).collect(), 5)


def test_edge_cases(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.standard_normal(3).tolist()) for i in range(20)]
    rows += [(100, None), (101, [1.0, None, 2.0]), (102, [math.nan, 0.0, 0.0]), (103, [math.inf, 0.0, 0.0]), *((200 + i, rows[0][1]) for i in range(50))]
    df = spark.createDataFrame([(*r, 0, "x") for r in rows], "vec_id long, embedding array<double>, n int, component string")
    compare(spark, rows, W.whiten(df).collect(), 3)
    odd = spark.createDataFrame([(1, []), (2, [1.0]), (3, [1.0, 2.0]), (4, [3.0, 4.0])], "vec_id long, embedding array<double>")
    got = W.whiten(odd).collect()  # of two vectors one component has variance
    assert sorted((r.vec_id, r.component, r.n) for r in got) == [(3, 1, 2), (4, 1, 2)] and sorted(r.whitened for r in got) == pytest.approx([-1, 1])
    assert W.whiten(odd.filter("vec_id < 3")).count() == 0 and W.whiten(odd.limit(0)).count() == 0
    null_ids = spark.createDataFrame([(None, [1.0, 2.0]), (None, [3.0, 4.5]), (5, [3.0, 4.5])], "vec_id long, embedding array<double>")
    assert sorted(str(r.vec_id) for r in W.whiten(null_ids).collect()) == ["5", "None", "None"]


def test_huge_entries_stay_exact_or_null(spark):
    rows = [(1, [1e300, 0.0]), (2, [-1e12, 1.0]), (3, [0.0, 2.0]), (4, [3.0, 7.0])]
    got = W.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r.n for r in got} == {4} and {r.vec_id for r in got} == {1, 2, 3, 4} and {r.deviation for r in got} == {None}
    rows = [(1, [1e4, 0.0]), (2, [-1e4, 1.0]), (3, [0.0, 2.0]), (4, [3.0, 7.0])]
    compare(spark, rows, W.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect(), 2)
