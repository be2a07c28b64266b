import numpy as np

from clausemill.llm import neighbours as N
from clausemill.llm.common import table

SCHEMA = "vec_id long, embedding array<float>, rank int"


def brute(rows, top=20, modulo=20):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = []
    for i, q in [r for r in good if r[0] % modulo == 0]:
        rest = list(good)
        rest.remove(next(r for r in rest if r[0] == i and r[1] is q))
        best = sorted(((-float(v @ q), j) for j, v in rest if j != i))[:top]
        out += [(i, k + 1, j, round(-s, 6)) for k, (s, j) in enumerate(best)]
    return sorted(out)


def rows_of(df):
    return sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 6)) for r in df.collect())


def same(got, want):
    """Ids and ranks are equal, scores up to the order of their sums."""
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert np.allclose([r[3] for r in got], [r[3] for r in want], rtol=1e-9, atol=2e-6)


def test_small_tables_are_exact(spark):
    rng = np.random.default_rng(2)
    rows = [(i, np.round(rng.standard_normal(8), 3).astype(np.float32).tolist()) for i in range(120)]
    rows += [(200 + i, rows[3][1]) for i in range(60)] + [(300 + i, (np.array(rows[5][1]) * 3).tolist()) for i in range(5)]
    rows += [(500, [1.0] * 7), (520, [1.0] * 9), (400, None), (420, [0.0] * 8), (440, [float("nan")] * 8), (460, [1.0] * 7 + [float("inf")]), (None, [1.0] * 8), (480, [None] + [1.0] * 7)]
    df = spark.createDataFrame([(i, v, 7) for i, v in rows], SCHEMA)
    same(rows_of(N.nearest(df)), brute([r for r in rows if r[1] is None or len(r[1]) == 8]))
    few = rows[:9]
    same(rows_of(N.nearest(spark.createDataFrame([(i, v, 7) for i, v in few], SCHEMA))), brute(few))
    assert N.nearest(df.limit(0)).count() == 0 and N.nearest(df.filter("vec_id = 420")).count() == 0


def test_recall_of_the_query(spark):
    """With the query's own parameters, several leaves a tree."""
    df = table(spark, "/root/testdata/sf0.1", "embeddings")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    got, want = rows_of(N.nearest(df)), brute(rows)
    assert len(rows) > 4 * N.LEAF and len(got) == len(want)
    hits = {(q, i): s for q, _, i, s in want}
    assert np.mean([(q, i) in hits for q, _, i, _ in got]) >= 0.9
    assert all(abs(hits.get((q, i), s) - s) < 1e-5 for q, _, i, s in got)


def test_recall_well_above_the_leaf_size(spark):
    n = 8_000
    x = np.random.default_rng(7).standard_normal((n, 128)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>")
    got = {}
    for r in N.nearest(df, leaf=200, trees=3).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    asked = np.arange(0, n, 20)
    s = x[asked] @ x.T
    s[np.arange(len(asked)), asked] = -np.inf
    near = np.argpartition(-s, 20, axis=1)[:, :20]
    assert np.mean([len(got[int(q)] & set(row.tolist())) / 20 for q, row in zip(asked, near)]) >= 0.9


def test_thousands_of_equal_scores_end_and_count_as_found(spark):
    """Vectors with three ones among 64 entries have the scores 0 to 3 alone."""
    rng = np.random.default_rng(3)
    x = np.zeros((2500, 64), np.float32)
    for row in x:
        row[rng.choice(64, 3, replace=False)] = 1
    got: dict = {}
    for r in N.nearest(spark.createDataFrame([(i, v, 0) for i, v in enumerate(x.tolist())], SCHEMA)).collect():
        got.setdefault(r.query_id, []).append((-r.score, r.vec_id))
        assert r.sample_recall >= N.TARGET
    assert set(got) == set(range(0, 2500, 20))
    hits = 0
    for q, found in got.items():
        assert found == sorted(found) and len(found) == 20
        s = x @ x[q]
        s[q] = -1
        hits += sum(-score >= np.sort(s)[-20] for score, _ in found)
    assert hits / (20 * len(got)) >= 0.9


def test_loop_ends_without_reaching_its_target(spark, monkeypatch):
    monkeypatch.setattr(N, "BATCHES", 1)
    df = table(spark, "/root/testdata/sf0.01", "embeddings")
    nodes = N.save(df.selectExpr("vec_id AS node", "transform(embedding, e -> double(e)) AS v").mapInArrow(N._pack, "node long, v array<double>, x binary"))
    queries = nodes.filter("node % 20 = 0").select(N.F.col("node").alias("q"), "x")
    found, recall = N.complete(queries.selectExpr("q", "q AS node", "float(-1) AS score"), nodes, 500, queries, 20, 2, 100, 64, target=1.1, batches=2)
    assert 0.2 < recall <= 1 and found.count() > 0


def test_one_batch_of_trees_finds_most_without_a_graph(spark):
    """Isotropic vectors, of which hardly any near ones share a leaf; a query visits several leaves."""
    x = np.random.default_rng(5).standard_normal((6_000, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "node long, v array<double>")
    nodes = N.save(df.mapInArrow(N._pack, "node long, v array<double>, x binary"))
    queries = nodes.filter("node % 20 = 0").select(N.F.col("node").alias("q"), "x")
    found, recall = N.complete(queries.selectExpr("q", "q AS node", "float(-1) AS score"), nodes, 6_000, queries, 20, 8, 100, 64, batches=1)
    assert recall >= 0.9
    assert found.groupBy("q", "node").count().filter("count > 1").isEmpty()
