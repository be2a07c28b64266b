import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from clausemill.llm import decontaminate as D
from clausemill.llm.common import table

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text, items, n=10):
    words = WORD.findall((text or "").translate(LOW))
    hit, ids = set(), set()
    for item_id, item in items:
        iw = WORD.findall((item or "").translate(LOW))
        if not iw or item_id is None:
            continue
        m = min(n, len(iw))
        windows = {tuple(iw[i : i + m]) for i in range(len(iw) - m + 1)}
        for i in range(len(words) - m + 1):
            if tuple(words[i : i + m]) in windows:
                hit.update(range(i, i + m))
                ids.add(item_id)
    return len(words), len(hit), len(ids), D.items_digest(ids), bool(hit)


def rows(df):
    return sorted(tuple(r) for r in df.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect())


def test_edge_cases(spark):
    long = " ".join(f"w{i}" for i in range(5000)) + " a b c d e f g h i j k"
    docs = [(1, "x A, b-c d e f g h I j k y"), (2, None), (3, ""), (4, long), (5, "solo"), (5, "solo"), (6, "a b c d e f g h i"), (7, "  ...  "), (8, "Ünï täst solo")]
    items = [(10, "a b c d e f g h i j k"), (11, "SOLO!"), (12, None), (13, ""), (None, "y"), (10, "a b c d e f g h i j k"), (2, "täst solo")]
    d = spark.createDataFrame([(*r, 0, "z") for r in docs], "doc_id long, text string, n_words int, items string")
    b = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, doc_id int")
    want = sorted((i, *brute(t, items)) for i, t in docs)
    assert rows(D.contamination_report(d, b)) == want
    kept = D.remove_contaminated(d, b)
    assert kept.columns == d.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(w[0] for w in want if not w[-1])
    for most in (1, 3):
        found = D.find_contamination(d, b, patterns_per_block=most)
        assert sorted((r.doc_id, r.n_words, r.n_hit, len(r["items"])) for r in found.collect()) == [w[:4] for w in want]
        assert D.remove_contaminated(d, b, patterns_per_block=most).count() == kept.count()


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    b = spark.createDataFrame([], "item_id long, text string")
    assert rows(D.contamination_report(d, b)) == [(1, 2, 0, 0, D.items_digest([]), False)]
    assert D.contamination_report(d.limit(0), b).count() == 0
    assert D.remove_contaminated(d, b).count() == 1


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=60), max_size=5), st.lists(st.lists(st.sampled_from("abc"), max_size=14), min_size=1, max_size=4))
def test_small_alphabets(docs, items):
    import numpy as np

    items = [(i, " ".join(w)) for i, w in enumerate(items)]
    for words in docs:
        hit, ids = set(), set()
        windows = {}
        for i, t in items:
            for w in D.item_windows(t):
                windows.setdefault(w, set()).add(i)
        by = {}
        for w in windows:
            by.setdefault(len(w), []).append(w)
        h = D._hash_words(D.WordHasher(), words) if words else np.empty(0, np.uint64)
        for ws in by.values():
            c = D.PatternClass(ws, [sorted(windows[w]) for w in ws])
            for end, p in c.search(h):
                if " ".join(words[end - c.length + 1 : end + 1]).encode() == c.text[p]:
                    hit.update(range(end - c.length + 1, end + 1))
                    ids.update(c.items[p])
        assert (len(words), len(hit), len(ids), D.items_digest(ids), bool(hit)) == brute(" ".join(words), items)


def test_whole_table_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs, items = (table(spark, sf, t) for t in ("documents", "benchmark"))
    plain = [tuple(r) for r in items.select("item_id", "text").collect()]
    want = sorted((r.doc_id, *brute(r.text, plain)) for r in docs.select("doc_id", "text").collect())
    assert rows(D.contamination_report(docs, items)) == want and any(w[-1] for w in want)


def test_runs_of_several_passes_are_merged(spark):
    from clausemill.llm import decontaminate as D

    sets = [[[0, 3, 10, 12], [4, 5], []], [[1, 9], [2, 3], [20, 20]], [[]], [], [[5, 6], [5, 6], [0, 1, 7, 8]]]
    got = [r.x for r in spark.createDataFrame(list(enumerate(sets)), "i int, s array<array<bigint>>").orderBy("i").select(D._merged_runs(D.F.col("s")).alias("x")).collect()]
    assert got == [[x for run in D.merge_runs(p for f in s for p in zip(f[::2], f[1::2])) for x in run] for s in sets]
