"""Interval joins, running sums and role segments against plain loops, and a document of a million spans."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from clausemill.operators import provenance as pv

KEYS = ["doc"]


def spans_of(rng, doc, n):
    at, out = 0, []
    for i in range(n):
        size = rng.choice([0, 1, 3, 10, 40])
        out.append((doc, f"s{doc}-{i}", i, at, at + size))
        at += size + 1
    return out


@pytest.mark.parametrize("bucket", [4, 50, 8192])
def test_located_ranges_equal_plain_overlaps(spark, bucket):
    rng = random.Random(bucket)
    spans = [s for d in range(5) for s in spans_of(rng, d, 30)]
    ranges = [(rng.randrange(6), rng.randrange(-5, 300), rng.randrange(0, 80)) for _ in range(200)]
    ranges = [(d, a, a + n) for d, a, n in ranges] + [(1, 10, 10), (1, 12, 11), (0, 0, 10_000)]
    got = pv.located(spark.createDataFrame(ranges, "doc int, start int, end int"), spark.createDataFrame(spans, "doc int, span_id string, ordinal int, global_start int, global_end int"), KEYS, bucket)
    want = sorted((d, a, e, s, max(a, g), min(e, h)) for d, a, e in ranges for k, s, _, g, h in spans if d == k and a < e and max(a, g) < min(e, h))
    assert sorted((r.doc, r.start, r.end, r.span_id, r.piece_start, r.piece_end) for r in got.collect()) == want


@pytest.mark.parametrize("chunk", [1, 7, 4096])
def test_running_sums(spark, chunk):
    rng = random.Random(chunk)
    rows = [(d, i, rng.randrange(9)) for d in range(4) for i in rng.sample(range(90), 40)]
    got = {(r.doc, r.i): r.before for r in pv.running_before(spark.createDataFrame(rows, "doc int, i int, v int"), KEYS, "i", F.col("v"), "before", chunk).collect()}
    assert got == {(d, i): sum(v for e, j, v in rows if e == d and j < i) for d, i, _ in rows}


@pytest.mark.parametrize("bucket", [3, 8192])
def test_role_segments_equal_plain_cover(spark, bucket):
    rng, names = random.Random(bucket), list(pv.ROLES)
    lengths = {d: rng.randrange(1, 60) for d in range(20)}
    ranges = []
    for d, n in lengths.items():
        for _ in range(rng.randrange(8)):
            a = rng.randrange(n)
            ranges.append((d, a, rng.randrange(a + 1, n + 1), rng.sample(names, rng.randrange(1, 4))))
    want = []
    for d, n in lengths.items():
        cuts = sorted({0, n, *(x for e, a, b, _ in ranges if e == d for x in (a, b))})
        for a, b in zip(cuts, cuts[1:]):
            roles = {r for e, s, t, rs in ranges if e == d and s <= a and b <= t for r in rs}
            want.append((d, a, b, [r for r in names if r in roles], sum(e == d and s == a for e, s, _, _ in ranges)))
    got = pv.role_segments(spark.createDataFrame(ranges, "doc int, start int, end int, roles array<string>"), spark.createDataFrame(list(lengths.items()), "doc int, length int"), KEYS, bucket)
    assert sorted((r.doc, r.start, r.end, r.roles, r.n_ranges) for r in got.collect()) == sorted(want)


def test_candidates_equal_a_scan(spark):
    texts = ["", None, "no match", "수수료 30% 및 1,200원, 12 개월 이내 일반 경비 공제 항목", "Deductions and other costs, 5 days; EXCLUSIVE exclusive", "😀 9% 할 수 있다 12days", "payment due 30 days"]
    want = {}
    for k, t in enumerate(texts):
        for role, patterns in pv.ROLES.items():
            for p in patterns:
                for m in re.finditer(p, t or ""):
                    if m.group().strip():
                        want.setdefault((k, m.start(), m.end(), m.group()), []).append(role)
    got = pv.role_candidates(spark.createDataFrame(list(enumerate(texts)), "k int, text string"), ["k"]).collect()
    assert {(r.k, r.start, r.end, r.exact_text): r.roles for r in got} == {key: [r for r in pv.ROLES if r in roles] for key, roles in want.items()}


def test_missing_sources_and_corrections(spark):
    spans = pv.effective_spans(spark.createDataFrame(
        [("a:ocr-1", 3, "rate", "rate 5%", "mixed", 0.5), ("b", 4, "", None, "ocr", 0.5), ("c", 5, "plain", None, None, 1.0)], "span_id string, page_index int, text string, corrected_text string, text_source string, confidence double"))
    clause_spans = spark.createDataFrame([("k1", 0, "zz"), ("k1", 1, "a:ocr-1"), ("k1", 2, "c"), ("k2", 0, "b"), ("k3", 0, "c"), ("k9", 0, "a:ocr-1")], "clause_id string, ordinal int, span_id string")
    findings = spark.createDataFrame([("f1", "k1"), ("f2", "k1"), ("f3", "k2"), ("f4", "k3"), ("f5", "nowhere"), ("f6", None)], "finding_id string, clause_id string")
    out, parts = pv.source_highlights(findings, clause_spans, spans)
    got = {r.finding_id: r for r in out.collect()}
    assert set(got) == {"f1", "f2", "f3", "f4", "f5", "f6"}
    assert (got["f1"].status, got["f1"].roles, got["f1"].page_index, got["f1"].text_source, got["f1"].is_user_corrected, got["f1"].has_real_bbox) == (pv.VALIDATED, ["amount_or_rate"], 3, "mixed", True, True)
    assert (got["f1"].focus_start, got["f1"].n_segments, got["f1"].text_length, got["f1"].n_spans) == (5, 3, 13, 2) and got["f1"].anchor_id != got["f2"].anchor_id
    assert [(got[f].status, got[f].text_source, got[f].n_segments) for f in ("f3", "f4", "f5", "f6")] == [(pv.MISSING, "missing", 0), (pv.MISSING, "text_layer", 1), (pv.MISSING, "missing", 0), (pv.MISSING, "missing", 0)]
    assert sorted((r.start, r.end, r.span_id) for r in parts.filter("clause_id = 'k1'").collect()) == [(0, 5, None), (5, 7, "a:ocr-1"), (7, 13, None)]


def test_a_document_of_a_million_spans(spark):
    n = 1_000_000
    spans = spark.range(n).select(F.lit(0).alias("doc"), F.col("id").alias("ordinal"), F.repeat(F.lit("x"), (F.col("id") % 7).cast("int")).alias("text"))
    placed = pv.running_before(spans, KEYS, "ordinal", F.length("text") + 1, "global_start").withColumn("global_end", F.col("global_start") + F.length("text")).drop("text")
    ranges = spark.range(50_000).select(F.lit(0).alias("doc"), (F.col("id") * 79).alias("start"), (F.col("id") * 79 + 20).alias("end"))
    got = pv.located(ranges, placed, KEYS)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    began = time.time()
    r = got.agg(F.count("*").alias("n"), F.sum(F.col("piece_end") - F.col("piece_start")).alias("size")).first()
    starts, at = [], 0
    for i in range(n):
        starts.append((at, at + i % 7))
        at += i % 7 + 1
    k = pieces = size = 0
    for a in range(0, 50_000 * 79, 79):
        while k and starts[k][1] > a:
            k -= 1
        while k < n and starts[k][1] <= a:
            k += 1
        j = k
        while j < n and starts[j][0] < a + 20:
            if (x := min(a + 20, starts[j][1]) - max(a, starts[j][0])) > 0:
                pieces, size = pieces + 1, size + x
            j += 1
    assert (r.n, r.size) == (pieces, size) and time.time() - began < 120
