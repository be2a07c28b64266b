"""Rows that can't be among the best k go before they are sorted; what remains holds all best ones."""

import random

from pyspark.sql import functions as F

from clausemill.operators import retrieval as rt


def test_promising_rows_hold_the_best(spark):
    rng = random.Random(5)
    rows = [(f"q{rng.randrange(7)}", rng.choice(["a", "b", None]), i, rng.randrange(400) / 8) for i in range(30_000)]
    df = spark.createDataFrame(rows, "query_id string, side string, chunk_id long, score double").repartition(3)
    for by, k in ((["query_id"], 3), (["query_id", "side"], 1), (["query_id", "side"], 4)):
        got = {tuple(r) for r in rt.promising(df, k, by).collect()}
        at = [df.columns.index(c) for c in by]
        groups = {}
        for r in rows:
            groups.setdefault(tuple(r[i] for i in at), []).append(r)
        for members in groups.values():
            worst = sorted((r[3] for r in members), reverse=True)[:k][-1]
            assert {r for r in members if r[3] >= worst} <= got  # ties with the last stay
        assert len(got) < len(rows) / 2


def test_scores_are_cut_into_whole_chunks(spark, tmp_path, monkeypatch):
    rows = [(i, " ".join(f"w{j % (i + 2)}" for j in range(40))) for i in range(60)]
    chunks = spark.createDataFrame(rows, "chunk_id int, text string")
    queries = spark.createDataFrame([(f"q{i}", f"w{i} w{i + 1} w1") for i in range(20)], "query_id string, text string")
    rt.save_index(chunks, f"file://{tmp_path}/i")
    index = rt.load_index(spark, f"file://{tmp_path}/i")
    want = sorted(tuple(r) for r in rt.search(chunks, queries).collect())
    for most in (1 << 20, 50):
        monkeypatch.setattr(rt, "AT_ONCE", most)
        assert sorted(tuple(r) for r in rt.bm25(index, queries).collect()) == want
    monkeypatch.setattr(rt, "SMALL", 3)  # more query terms than may be sent
    assert sorted(tuple(r) for r in rt.bm25(index, queries).collect()) == want
    some = chunks.filter("chunk_id % 3 = 0").select("chunk_id", F.lit("x").alias("tag"))
    joined = [tuple(r) for r in rt.bm25(index, queries, chunks=some).select("query_id", "chunk_id", "score", "matched").collect()]
    assert sorted(joined) == [r for r in want if r[1] % 3 == 0]


def test_queries_without_known_terms_and_repeated_chunks(spark, tmp_path):
    chunks = spark.createDataFrame([(1, ""), (1, "fee due"), (2, None), (3, "fee")], "chunk_id int, text string")
    rt.save_index(chunks, f"file://{tmp_path}/i")
    index = rt.load_index(spark, f"file://{tmp_path}/i")
    assert sorted((r.chunk_id, r.term, r.tf, r.length) for r in index.postings.collect()) == [(1, "due", 1, 2), (1, "fee", 1, 2), (3, "fee", 1, 1)]
    unknown = spark.createDataFrame([("q1", "nothing known"), ("q2", None)], "query_id string, text string")
    assert rt.bm25(index, unknown).collect() == []


def test_products_block_by_block_find_the_nearest(spark, monkeypatch):
    rng = random.Random(7)
    rows = [(i, [rng.randrange(-40, 41) / 80 for _ in range(6)]) for i in range(900)]
    rows += [(1000 + i, rows[3][1]) for i in range(200)]  # one large group of copies
    rows += [(2000, None), (2001, [0.1, None, 0.0, 0.0, 0.0, 0.0]), (2002, [1.0]), (2050, None), (None, rows[0][1])]
    rows += [(2100 + i, [0.00005, 1.0, 0.0, 0.0, 0.0, 0.0]) for i in range(30)] + [(2200, [1.0, 0.0, 0.0, 0.0, 0.0, 0.0])]  # halves
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    asked = df.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("e"))
    pairs = asked.join(df, F.col("vec_id") != F.col("qid")).select("qid", "vec_id", F.round(rt.dot(F.col("e"), F.col("embedding")), 4).alias("score"))
    want = {}
    for r in pairs.collect():
        want.setdefault(r.qid, []).append((r.score is None, -(r.score or 0.0), r.vec_id, r.score))
    want = sorted((q, v, s, k + 1) for q, all_ in want.items() for k, (_, _, v, s) in enumerate(sorted(all_, key=lambda x: x[:3])[:5]))
    for vectors, queries, held in ((1 << 13, 1 << 12, 1 << 22), (100, 7, 1000)):
        monkeypatch.setattr(rt, "VECTOR_BLOCK", vectors)
        monkeypatch.setattr(rt, "QUERY_BLOCK", queries)
        monkeypatch.setattr(rt, "PAIRS_AT_ONCE", held)
        got = rt.nearest_by_product(df, asked, 5)
        assert sorted((r.qid, r.vec_id, r.score, r.rank) for r in got.collect()) == want


def test_siblings_are_ranked_in_parts(spark):
    rng = random.Random(11)
    tiers = ["A0", "A1", "B", "C", "?", None]
    rows = [(f"q{q}", i, rng.randrange(60) / 8 if i % 3 else 2.5, rng.choice(tiers), rng.choice(["", "g1", "g2", "g3", None]), 1) for q in range(5) for i in range(q * q * 100)]
    scored = spark.createDataFrame(rows, "query_id string, chunk_id long, score double, authority_tier string, conflict_group string, matched int").repartition(3)
    order = {t: n for n, t in enumerate(["A0", "A1", "A2", "B", "C"])}
    want = set()
    for q in {r[0] for r in rows}:
        ranked = sorted((r for r in rows if r[0] == q), key=lambda r: (-r[2], order.get(r[3], 99), r[1]))
        groups = {r[4] for r in ranked[:3]} - {"", None}
        want |= {(q, r[1], r[4], r[2], n + 1) for n, r in enumerate(ranked) if n < 3 or r[4] in groups}
    for sample in (scored.filter("chunk_id % 7 = 3"), scored.filter("chunk_id % 100 = 1"), scored.limit(0)):
        for few in (True, False):
            got = rt.with_conflict_siblings(scored, 3, sample, few).cache()
            assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)
    parts = rt.in_parts(scored, scored.filter("chunk_id % 7 = 3")).groupBy("query_id", "_part").count().agg(F.max("count")).first()[0]
    assert parts < 150  # equal scores are parted too: no task sorts a query's whole ranking


def test_texts_that_hold_items(spark, monkeypatch):
    items = spark.createDataFrame([("q1", "x one two three y"), ("q2", "a one two three b c"), ("q3", "too short"), ("q4", "a b  c\td e"), ("q5", None)], "query_id string, item string")
    texts = [(1, "an x one two three yes"), (2, "x one two three"), (3, None), (4, " zza one\x0btwo three b c"), (5, "a one two three b c and x one two three y"), (6, "ga b  c\td end"), (7, "a b c d e"), (8, ""), (9, "one two")]
    chunks = spark.createDataFrame(texts, "chunk_id int, text string").repartition(2)
    want = sorted((q, c) for q, i in (("q1", "x one two three y"), ("q2", "a one two three b c"), ("q4", "a b  c\td e")) for c, t in texts if t and i in t)
    for small, once_ in ((1 << 18, 1 << 20), (1 << 18, 1), (1, 1)):
        monkeypatch.setattr(rt, "SMALL", small)
        monkeypatch.setattr(rt, "AT_ONCE", once_)
        got = rt.holding(chunks, items)
        assert sorted(tuple(r) for r in got.collect()) == want
        assert small == 1 or "Generate explode" not in got._jdf.queryExecution().executedPlan().toString()  # no row for each run of words
    assert rt.holding(chunks, items.filter("query_id = 'q3'")).collect() == []
