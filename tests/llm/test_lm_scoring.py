import math
import re
from collections import Counter

from clausemill.llm import lm_scoring as L
from clausemill.llm.common import table

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    words = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW)) for _, t in rows]
    one = Counter(w for d in words for w in d)
    two = Counter(p for d in words for p in zip(d, d[1:]))
    n = sum(one.values())
    out = []
    for (i, _), d in zip(rows, words):
        s = sum(math.log(two[v, w] / one[v]) if v and two[v, w] >= 2 else math.log((0.4 if v else 1) * one[w] / n) for v, w in zip([None, *d], d))
        out.append((i, len(d), s, s / len(d) if d else None))
    return out


def close(got, want):
    key = lambda r: (str(r[0]), r[1], r[2])
    got, want = sorted((tuple(r) for r in got), key=key), sorted(want, key=key)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:2] == w[:2] and abs(g[2] - w[2]) < 1e-5 and (g[3] is None) == (w[3] is None) and (w[3] is None or abs(g[3] - w[3]) < 1e-5)


def test_edge_cases(spark):
    rows = [(1, "the cat sat on the mat"), (1, "the cat sat on the mat"), (2, "The CAT ran; the dog ran"), (3, None), (4, ""), (None, "the cat"), (5, "été " * 40_000), (6, "x"), (1, "other words")]
    df = spark.createDataFrame([(i, t, "k", 1) for i, t in rows], "doc_id long, text string, row string, n_words int")
    for ranges in (1, 3):
        close(L.score_documents(df, ranges=ranges).collect(), brute(rows))
    assert L.score_documents(df.limit(0)).count() == 0


def test_whole_table(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    close(L.score_documents(docs).collect(), brute([tuple(r) for r in docs.select("doc_id", "text").collect()]))
