import pytest
from pyspark.sql import functions as F

from clausemill.operators import extract as ex
from clausemill.operators import segment as sg

#: Texts and what they hold: feature, unit, value, open-ended.
GOLDEN = {
    "총매출 1,200,000원, 수익배분율 30%, 지급일 2026년 7월 15일, 지급기일 45일": [("GROSS_SALES", "krw", 1200000, False), ("REVENUE_SHARE_RATE", "frac", 0.3, False), ("PAYMENT_DUE_DATE", "none", 20260715, False), ("PAYMENT_DUE_DAYS", "days", 45, False)],
    "위약금은 2,000,000원, 해지 통지기간은 30일, 독점기간은 1년으로 한다.": [("PENALTY_AMOUNT", "krw", 2000000, False), ("TERMINATION_NOTICE_DAYS", "days", 30, False), ("EXCLUSIVITY_DURATION_MONTHS", "months", 12, False)],
    "공제율 약 15% 및 기타 회사가 정하는 비용을 공제할 수 있다. Revenue share 10~20%.": [("DEDUCTION_RATE", "frac", None, True), ("OPEN_ENDED_NUMERIC_TERMS", "none", None, True), ("DEDUCTION_RATE", "frac", None, True)],
    "Revenue share 150%": [("REVENUE_SHARE_RATE", "frac", None, True)],
    "Revenue share 15% Payment due 45 days": [("REVENUE_SHARE_RATE", "frac", 0.15, False), ("PAYMENT_DUE_DAYS", "days", 45, False)],
    "Gross sales 1.5 million KRW, Revenue share 25%, Payment due March 5, 2026 and 30 days.": [("GROSS_SALES", "krw", 1500000, False), ("REVENUE_SHARE_RATE", "frac", 0.25, False), ("PAYMENT_DUE_DATE", "none", 20260305, False), ("PAYMENT_DUE_DAYS", "days", 30, False)],
    "결제 수수료 3%": [("PAYMENT_PROCESSING_FEE", "frac", 0.03, False)],
    "marketing 100만원": [("MARKETING_COST", "krw", 1000000, False)],
    "약 30%": [("REVENUE_SHARE_RATE", "frac", None, True)],
    "MG 5,000,000원": [("MINIMUM_GUARANTEE", "krw", 5000000, False)],
    "March 5, 2026": [("CONTRACT_DATE", "none", 20260305, False)],
    "5 Sept. 2026": [("CONTRACT_DATE", "none", 20260905, False)],
    "31 June 2026": [("CONTRACT_DATE", "none", None, True)],
    "June 2026": [("CONTRACT_DATE", "none", None, True)],
    "fees as determined by the company": [("OPEN_ENDED_NUMERIC_TERMS", "none", None, True)],
    "no number here, OMG": [],
}


@pytest.fixture(scope="module")
def terms(spark):
    rows = [*enumerate(GOLDEN), (99, None), (98, "")]
    got: dict = {}
    for r in ex.extract_terms(spark.createDataFrame(rows, "id int, text string"), ["id"]).orderBy("id", "position").collect():
        got.setdefault(r.id, []).append(r)
    return got


@pytest.mark.parametrize("k", range(len(GOLDEN)))
def test_golden_terms(terms, k):
    got = [(r.feature_id, r.unit, None if r.value_norm is None else float(r.value_norm), r.is_open_ended) for r in terms.get(k, [])]
    assert got == list(GOLDEN.values())[k]


def test_offsets_point_at_values(terms):
    for text, rows in zip(GOLDEN, (terms.get(k, []) for k in range(len(GOLDEN)))):
        assert all(text[r.start : r.end].strip() == r.value_raw for r in rows)
    assert 98 not in terms and 99 not in terms


def test_clause_markers(spark):
    lines = {"제 3 조 (정산)": "article", "Section 4.2 Fees": "article", "article 1": "article", "Section Income of the author": None, "Clause Various": None, "Section View": None, "(a) one": "subclause", "③ 셋": "subclause", "1.2) x": "subclause", "a sentence": None}
    rows = spark.createDataFrame(list(lines.items()), "text string, want string")
    assert {r.text: r.m for r in rows.select("text", sg.marker(rows.text).alias("m")).collect()} == lines


def test_spans_are_split_at_a_mark_and_texts_may_hold_it(spark):
    """``split`` compiles a pattern for each text; a mark is split at without one."""
    import re

    from clausemill.functions.text import match_spans

    texts = ["7 days", "x 12 y 3", "no", "\x01 4\x01", "a\x015 6", "8", "억 9 원"]
    spans = match_spans(F.col("t"), "[0-9]+", F.regexp_extract_all("t", F.lit("[0-9]+"), F.lit(0)))
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", spans.alias("s"))
    for r in df.collect():
        assert [(m.start, m.end, m.value) for m in r.s] == [(*m.span(), m.group()) for m in re.finditer("[0-9]+", r.t)]
    assert "regexp_replace" in df._jdf.queryExecution().analyzed().toString()
