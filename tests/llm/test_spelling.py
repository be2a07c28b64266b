import re
import zlib
from collections import Counter

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from clausemill.llm import spelling as P
from clausemill.llm.common import table

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def distance_one(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def words_of(rows):
    n = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    return {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}


def variants(n):
    by_cut: dict = {}  # words at distance one share what is left without one code point, or it is one of them
    for w in n:
        for c in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))} if len(w) < 99 else {w}:
            by_cut.setdefault(c, set()).add(w)
    near: dict = {w: set() for w in n}
    for some in by_cut.values():
        for a in some:
            near[a] |= {b for b in some if distance_one(a, b)}
    near = {w: [x for x in near[w]] for w in n}
    form = {w: min(near[w], key=lambda x: (-n[x], x), default=None) for w in n}
    form = {w: f if f and n[f] >= 2 * n[w] else None for w, f in form.items()}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted((w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n)


def got(df):
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in P.spelling_variants(df).collect())


@settings(max_examples=200, deadline=None)
@given(st.sets(st.text("abé", max_size=6), max_size=30))
def test_trie_finds_the_pairs_at_distance_one(words):
    words = list(words)
    pairs = list(P.trie_pairs(words))
    assert len(pairs) == len(set(pairs))
    assert set(pairs) == {(i, j) for j in range(len(words)) for i in range(j) if distance_one(words[i], words[j])}


@pytest.mark.parametrize("weight", [1 << 16, 40])
def test_partitions_give_each_pair_once(spark, monkeypatch, weight):
    """With little weight a subtrie is partitioned again and again."""
    import random

    monkeypatch.setattr(P, "WEIGHT", weight)
    rng, n = random.Random(5), {}
    while len(n) < 700:
        w = "".join(rng.choice("ab") for _ in range(rng.randint(5, 11)))
        n[rng.choice(["", "", "prefix"]) + w + rng.choice(["", "", "suffix"])] = rng.randint(1, 99)
    found = [tuple(r)[:2] for r in P.near_words(spark.createDataFrame(list(n.items()), "word string, n long")).collect()]
    assert len(found) == len(set(found))
    assert set(found) == {(a, b) for a in n for b in n if distance_one(a, b)}


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (None, "abcde abcde abcde"), (3, "ABCDE abcdE-abcdf1abcdf_abcdf"), (3, "ABCDE abcdE"), (4, "Ünïcode Ünïcode ünïcode Ünicode Ünicode Ünicode nïcode nïcode nïcode"), (5, "x" * 30_000 + " " + "x" * 30_001)]
    rows += [(k, "abcde " * k + "zzzzz×÷ zzzzz×÷ zzzzz×÷ " + "y" * 5000) for k in range(6, 10)] + [(k, f"abcd{c} abxd{c} " * 2) for k in range(400, 500) for c in "efgh"]
    df = spark.createDataFrame([(*r, 1, "w") for r in rows], "doc_id long, text string, n int, word string")
    assert got(df) == variants(words_of(rows))
    assert got(df.limit(0)) == []


def test_forms_are_followed_to_the_root(spark):
    counts = {"aaaaaaaaaa"[:k] + "bbbbbbbbbb"[k:]: 3 << k for k in range(10)}
    rows = [(1, " ".join(" ".join([w] * k) for w, k in counts.items()))]
    n = words_of(rows)
    result = got(spark.createDataFrame(rows, "doc_id long, text string"))
    assert result == variants(n) and len({r[2] for r in result}) < len(result) / 4


def test_whole_table_and_sql(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    result = got(docs)
    assert result == variants(words_of([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]))
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.01/documents.parquet'")
    sql = con.execute(P.ORACLE_SQL)
    at = [[d[0] for d in sql.description].index(c) for c in ("word", "form", "root", "n", "n_near", "form_n")]
    assert sorted(tuple(r[k] for k in at) for r in sql.fetchall()) == result
    assert sum(r[1] is not None for r in result) > 20
