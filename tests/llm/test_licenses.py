import re

from clausemill.llm import licenses as L
from clausemill.llm.common import table

MIT = L.TEMPLATES["MIT"]


def brute(text):
    """Best containment of each template in any window, shingle by shingle."""
    w = re.findall("[a-z0-9]+", (text or "").lower())
    s = [" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else []
    out = {}
    for name, t in L.TEMPLATES.items():
        want = L.shingle_set(t)
        c = L.size_class(len(want))
        step = max(1, c // 2)
        best = 0.0
        for k in range(0, len(s), step):
            best = max(best, len(want & set(s[k : k + c + step])) / len(want))
        if best >= 0.8 - 1e-9:
            out[name] = best
    return out


def test_edge_cases(spark):
    cut = " ".join(MIT.split()[6:])
    broken = " x ".join(" ".join(MIT.split()[i : i + 6]) for i in range(0, 80, 6))
    docs = [
        (1, f"code code {MIT} more"), (2, cut), (3, broken), (4, None), (5, ""), (6, "Released under the MIT\nLicense!"), (6, "Released under the MIT\nLicense!"),
        (None, MIT), (7, "licensed under"), (8, ("filler word " * 30_000) + MIT.upper() + (" tail end" * 20_000)), (9, MIT + L.TEMPLATES["Apache-2.0"]), (10, "a b c"),
    ]
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, license string")
    got = {(r.doc_id, r.license): round(r.containment, 9) for r in L.scan_licenses(df).collect()}
    want = {(i, n): round(c, 9) for i, t in docs if i is not None for n, c in brute(t).items()}
    assert got == want and (8, "MIT") in got and (9, "Apache-2.0") in got and (2, "MIT") in got and (3, "MIT") not in got


def test_empty_and_native(spark):
    df = spark.createDataFrame([(1, MIT)], "doc_id long, text string")
    assert L.scan_licenses(df.limit(0)).count() == 0
    assert L.scan_licenses(df, {}).count() == 0
    plan = L.scan_licenses(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_needed_words_lose_nothing():
    words = set(L.needed_words(L.TEMPLATES))
    for text in L.TEMPLATES.values():
        s = L.shingle_set(text)
        assert sum(not set(x.split()) & words for x in s) < 0.8 * len(s)


def test_whole_table(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    got = {(r.doc_id, r.license) for r in L.scan_licenses(docs).collect()}
    want = {(r.doc_id, n) for r in docs.select("doc_id", "text").collect() for n in brute(r.text)}
    assert got == want and got


def test_lower_threshold_finds_what_it_asks_for(spark):
    """Documents with three fifths of a notice, cut so that its longest words are missing."""
    docs, want = [], {}
    for k, (name, text) in enumerate(L.TEMPLATES.items()):
        words = re.findall("[a-z0-9]+", text.lower())
        cut = words[: 5 + int(0.64 * max(1, len(words) - 4))]
        docs.append((k, " ".join(cut)))
        share = len(L.shingle_set(" ".join(cut)) & L.shingle_set(text)) / len(L.shingle_set(text))
        if share >= 0.6:
            want[k, name] = round(share, 9)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r.doc_id, r.license): round(r.containment, 9) for r in L.scan_licenses(df, threshold=0.6).collect()}
    assert len(want) > 6 and {k: got.get(k) for k in want} == want
    assert L.band_count() == 24 and L.band_count(0.6) > 24
