import numpy as np
import pytest
from pyspark.sql import functions as F

from clausemill.llm import quality, toxicity
from clausemill.llm.common import table

SF = "/root/testdata/sf0.1"
CASES = {"quality": (quality.score_quality, 0.97, 0.97), "toxic": (toxicity.score_toxicity, 0.92, 0.95)}


@pytest.mark.parametrize("label", CASES)
def test_held_out_accuracy(spark, label):
    score, least_auc, least_accuracy = CASES[label]
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    out = score(docs, labels)
    assert out.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    out = out.toPandas()
    assert len(out) == docs.count() and out.score.between(0, 1).all()
    g = out.merge(labels.toPandas(), on="doc_id")
    g = g[g.held_out]
    y, rank = g[label].to_numpy(), g.score.rank().to_numpy()
    n1, n0 = (y == 1).sum(), (y == 0).sum()
    auc = (rank[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * n0)
    assert auc >= least_auc and (y == g.predicted).mean() >= least_accuracy


def tiny(spark):
    good, bad = "The quick brown fox, and the dog. It was a fine day.\nAnother line here.", "BUY!! NOW!! BUY!! NOW!! CHEAP!! idiot scum"
    rows = [(i, good + f" {i} and so on" if i % 2 else bad * (1 + i % 3)) for i in range(120)]
    rows += [(200, None), (201, ""), (202, "word " * 60_000), (None, bad), (203, good), (203, good)]
    docs = spark.createDataFrame([(i, t, 1, 0.5) for i, t in rows], "doc_id long, text string, label int, score double")
    labels = spark.createDataFrame([(i, i % 2, 1 - i % 2, "x") for i in range(120)] + [(None, 1, 1, "x"), (3, 1, 0, "x"), (5, None, None, "x"), (7, 9, 9, "x")], "doc_id long, quality int, toxic int, text string")
    return docs, labels, len(rows)


@pytest.mark.parametrize("label", CASES)
def test_edge_cases(spark, label):
    score = CASES[label][0]
    docs, labels, n = tiny(spark)
    out = score(docs, labels).toPandas()
    assert len(out) == n and out.score.between(0, 1).all() and out.predicted.isin([0, 1]).all() and not out.held_out.isna().any()
    even = out[(out.doc_id < 120) & (out.doc_id % 2 == 0)]
    assert (even.predicted == (label == "toxic")).mean() > 0.95
    assert out[out.doc_id == 203].score.nunique() == 1
    assert score(docs.limit(0), labels).count() == 0
    assert score(docs, labels.limit(0)).count() == n
    assert score(docs, labels.filter(f"{label} = 1")).count() == n


def test_labels_of_held_out_rows_are_not_used(spark):
    docs, labels, _ = tiny(spark)
    other = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (dict(quality.score_quality(docs, x).filter("doc_id is not null").select("doc_id", "score").collect()) for x in (labels, other))
    assert a == pytest.approx(b, abs=1e-12)


def test_keep_good_keeps_columns_and_clean_rows(spark):
    docs, labels, _ = tiny(spark)
    kept = quality.keep_good(docs, labels)
    scored = quality.score_quality(docs, labels)
    assert kept.columns == docs.columns and kept.count() == scored.filter("predicted = 1").count()


def test_rules_of_a_printed_tree():
    text = "Tree\n  If (feature 0 <= 0.5)\n   If (feature 1 <= 2.0)\n    Predict: 0.0\n   Else (feature 1 > 2.0)\n    Predict: 1.0\n  Else (feature 0 > 0.5)\n   Predict: 1.0\n"
    a, b = quality.STATS[:2]
    assert {r.terms for r in quality.tree_rules(text)} == {((a, True, 0.5),), ((a, False, 0.5),), tuple(sorted([(a, True, 0.5), (b, True, 2.0)])), tuple(sorted([(a, True, 0.5), (b, False, 2.0)]))}


def test_label_model_finds_classes_without_labels():
    rng = np.random.default_rng(3)
    y = rng.random(6000) < 0.2
    rates = [(0.6, 0.02), (0.5, 0.05), (0.4, 0.01), (0.5, 0.03), (0.3, 0.01)]
    x = np.stack([np.where(y, rng.random(6000) < a, rng.random(6000) < b) for a, b in rates], 1)
    p = toxicity.label_model(np.column_stack([x, x[:, 0], x[:, 0]]))  # with voters that repeat another
    assert ((p > 0.5) == y).mean() > 0.93
    weights = toxicity.shared_weights(np.column_stack([x, x[:, 0], x[:, 0]]).astype(float), y.astype(float), 0.0 + 1e-9)
    assert np.allclose(weights[[0, 5, 6]], 1 / 3, atol=0.05) and (weights[1:5] > 0.8).all()


def test_votes_and_scores_are_those_of_a_plain_count(spark):
    import re

    words = ["idiot", "scum", "trash", "moron"]
    voters = np.unique(np.array([toxicity.hash_word(w) for w in words], np.uint64))
    weight = {toxicity.hash_word(w): 0.3 * (k + 1) for k, w in enumerate(words)}
    model = toxicity.Model(voters, np.array([weight[int(v)] for v in voters]), -1.0)
    texts = ["Idiot, scum! idiot", "trashy idiots", None, "", "fine day", "MORON " * 5000]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = dict(rows.mapInArrow(toxicity._score(spark.sparkContext.broadcast(model)), "doc_id long, score double").collect())
    for i, t in enumerate(texts):
        found = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())
        z = sum(np.log1p(found.count(w)) * weight[toxicity.hash_word(w)] for w in words) - 1.0
        assert got[i] == pytest.approx(1 / (1 + np.exp(-z)))


def test_compiled_column_is_the_rules_one_by_one(spark):
    docs, labels, n = tiny(spark)
    stats = quality.text_stats(docs)
    model = quality.fit(stats, labels)
    rows = stats.withColumn("score", model.score()).collect()
    assert len(rows) == n and model.rules
    for r in rows:
        z = model.intercept + sum(w * all(r[name] <= b if upper else r[name] > b for name, upper, b in rule.terms) for rule, w in model.rules)
        assert r.score == pytest.approx(1 / (1 + np.exp(-z)))


def test_statistics_are_those_of_a_plain_count(spark):
    texts = ["The the cat!! Sat on 12 mats.\nThe the cat!! Sat on 12 mats.\n\nÉté #", "", None, "one", "a b a b a b $ $"]
    rows = {r.doc_id: r for r in quality.text_stats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        t, r = t or "", rows[i]
        raw, words, lines = t.encode(), t.lower().split(), [x for x in t.split("\n") if x]
        n = max(len(words), 1)
        want = {
            "share_upper": sum("A" <= c <= "Z" for c in t) / max(len(raw), 1), "share_digit": sum(c in "0123456789" for c in t) / max(len(raw), 1), "share_bang": t.count("!") / max(len(raw), 1),
            "log_bytes": np.log1p(len(raw)), "log_words": np.log1p(len(words)), "longest_word": np.log1p(max((len(w.encode()) for w in words), default=0)),
            "word_bytes": sum(len(w.encode()) for w in words) / n, "distinct_words": len(set(words)) / np.sqrt(n), "same_as_last": sum(a == b for a, b in zip(words, words[1:])) / n,
            "top_pair": sum(a == b for a, b in zip(words, words[2:])) / n, "symbol_end": sum(w[-1] in "#$%&*@^~+=<>" for w in words) / n, "short_words": sum(len(w.encode()) <= 3 for w in words) / n,
            "words_per_line": np.log1p(len(words) / max(len(lines), 1)), "repeated_lines": 1 - len({x.lower() for x in lines}) / max(len(lines), 1),
        }
        want["repeated_lines"] = want["repeated_lines"] if lines else 1.0
        assert {k: r[k] for k in want} == pytest.approx(want)


def test_repeated_labelled_documents_count_once_in_training(spark):
    from clausemill.llm.common import one_a_document, save

    rows = save(spark.createDataFrame([(1, 1.0, "a")] * 50 + [(1, 1.0, "b"), (2, 0.0, None), (2, 0.0, None), (3, 0.0, "c")], "doc_id long, label double, text string"))
    got = sorted((r.doc_id, r.label, r.text) for r in one_a_document(rows, "text").collect())
    assert [g[:2] for g in got] == [(1, 1.0), (2, 0.0), (3, 0.0)] and got[0][2] in ("a", "b") and got[2][2] == "c"
    single = save(spark.createDataFrame([(1, 1.0, "a"), (2, 0.0, "b")], "doc_id long, label double, text string"))
    assert one_a_document(single, "text") is single
    docs, labels, n = tiny(spark)
    again = docs.unionByName(docs.filter("doc_id IN (2, 3)")).unionByName(docs.filter("doc_id = 4"))
    assert quality.score_quality(again, labels).count() == n + 3 and toxicity.score_toxicity(again, labels).count() == n + 3
