import numpy as np
import pytest
from pyspark.sql import functions as F

from clausemill.llm import mixing as M
from clausemill.llm.common import table
from clausemill.llm.queries import labelled_domains

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def fitted(spark):
    docs = table(spark, SF, "documents")
    return docs, labelled_domains(docs, table(spark, SF, "labels"))


def test_targets_are_met_and_nothing_is_lost(spark, fitted):
    docs, labelled = fitted
    rates = M.document_rates(docs, labelled).toPandas()
    assert len(rates) == docs.count() and (rates.rate >= 0).all()
    p = rates[[f"p_{d}" for d in sorted(M.WEIGHTS)]].to_numpy()
    assert np.allclose(p.sum(1), 1)
    total = (rates.tokens.to_numpy() * rates.rate.to_numpy()) @ p
    want = np.array([M.WEIGHTS[d] for d in sorted(M.WEIGHTS)])
    assert np.allclose(total / total.sum(), want / want.sum(), atol=1e-4)
    # the budget is the least that thins no domain
    before = rates.tokens.to_numpy() @ p
    assert np.isclose(total.sum(), (before / want).max(), rtol=1e-4)


def test_rates_equal_a_plain_solution(spark, fitted):
    docs, labelled = fitted
    m = M.Mixture(docs, labelled, M.WEIGHTS, budget=20_000.0)  # far below what there is
    rows = m.posteriors.withColumn("rate", M.rate(m.slope)).toPandas()
    t, p = rows.tokens.to_numpy(float), rows[[f"p{d}" for d in range(4)]].to_numpy()
    # nearest to 1 of all that meet the targets: an active-set solution of the same problem
    y = np.zeros(4)
    for _ in range(200):
        on = p @ y < 1
        k = (p[on] * t[on, None]).T @ p[on]
        y = np.linalg.solve(k, t[on] @ p[on] - m.targets)
    r = np.maximum(0, 1 - p @ y)
    s = (t * rows.rate.to_numpy()) @ p
    assert (r == 0).any() or r.min() < 0.5
    assert np.allclose(r, rows.rate.to_numpy(), atol=1e-3) and np.allclose(s, m.after, rtol=1e-6)
    assert np.allclose(s, m.targets, rtol=1e-3)


def test_classifier_finds_the_language(spark, fitted):
    docs, labelled = fitted
    rates = M.document_rates(docs, labelled).join(docs.select("doc_id", "lang", "n_chars"), "doc_id").filter("n_chars > 300").toPandas()
    names = sorted(M.WEIGHTS)
    guess = [names[k] for k in rates[[f"p_{d}" for d in names]].to_numpy().argmax(1)]
    assert np.mean(np.array(guess) == rates.lang.to_numpy()) > 0.95


def test_mix_repeats_rows_by_their_rate(spark, fitted):
    docs, labelled = fitted
    out = M.mix(docs, labelled)
    assert out.columns == docs.columns
    whole = M.document_rates(docs, labelled)
    plan = whole._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
    rates = {r.doc_id: r.rate for r in whole.collect()}
    copies = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert all(abs(copies.get(i, 0) - r) < 1 + 1e-9 for i, r in rates.items())
    assert abs(sum(copies.values()) - sum(rates.values())) < 4 * np.sqrt(len(rates))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_edge_cases(spark):
    rows = [(1, "the cat", "a"), (1, "the cat", "a"), (None, "die katze mit größe", "a"), (2, None, "b"), (3, "", "b"), (4, "é" * 200_000, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, rate string")
    labelled = spark.createDataFrame([(1, "en"), (4, "fr"), (4, "zz"), (None, "de"), (1, None)], "doc_id long, domain string")
    got = M.document_rates(docs, labelled).toPandas()
    assert len(got) == len(rows) and sorted(got.tokens) == [0, 0, 1, 2, 2, 4]
    assert not got.drop(columns="doc_id").isna().any().any()
    assert got[got.doc_id == 4].p_fr.iloc[0] > 0.5
    assert M.document_rates(docs.limit(0), labelled).count() == 0
    assert M.document_rates(docs, labelled.limit(0)).count() == len(rows)
    assert M.mix(docs, labelled).columns == docs.columns
    assert sorted(got.tokens) == sorted(len((t or "").split()) for _, t, _ in rows)


def test_classifier_learns_any_labelled_table(spark):
    """Topics of one alphabet, told apart by their words alone; posteriors equal a plain count's."""
    rng = np.random.default_rng(6)
    names = ("law", "sea", "tea")
    words = {d: [f"{d}{k}" for k in range(30)] + ["of", "the", "and"] for d in names}
    rows = [(i, " ".join(rng.choice(words[names[i % 3]], 25)), names[i % 3]) for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, domain string")
    known = docs.filter("doc_id % 2 = 0").select("doc_id", "domain")
    got = M.document_rates(docs.drop("domain"), known, dict.fromkeys(names, 1.0)).toPandas().set_index("doc_id")
    p = got[[f"p_{d}" for d in names]].to_numpy()
    assert all(names[k] == rows[i][2] for i, k in zip(got.index, p.argmax(1)))
    bucket = {w: r for w, r in spark.createDataFrame([(w,) for x in words.values() for w in x], "w string").select("w", F.pmod(F.xxhash64("w"), F.lit(M.BUCKETS))).distinct().collect()}
    counts = {d: np.full(M.BUCKETS, M.PSEUDO) for d in names}
    for _, t, d in rows[::2]:
        for w in t.split():
            counts[d][bucket[w]] += 1
    for i, t, _ in rows[:9]:
        z = np.array([np.log(16) + M.EVIDENCE / 25 * sum(np.log(counts[d][bucket[w]] / counts[d].sum()) for w in t.split()) for d in names])
        want = np.exp(z - z.max())
        assert np.allclose(got.loc[i, [f"p_{d}" for d in names]].to_numpy(float), want / want.sum(), atol=1e-4)
