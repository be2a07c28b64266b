"""Queries against their SQL in DuckDB on the smallest tables, and goldens of the formulas."""

import decimal
import math

import duckdb
import pytest
from pyspark.sql import functions as F

from clausemill.functions import text as tx
from clausemill.operators import finance as fin
from clausemill.operators import metrics as mt
from clausemill.operators import scoring as sc
from clausemill.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    yield con
    con.close()


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    result = duck.execute(catalog.SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=repr) == want


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_queries_without_sql_have_rows(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_formula_goldens(spark):
    assert one(spark, fin.fim2_delay_loss(F.lit(1e7), F.lit(0.05), F.lit(180))) == pytest.approx(237737.47041076, abs=1e-6)
    leak = one(spark, fin.fim1_leakage(F.lit(1e7), F.lit(0.0), F.lit(0.0), F.lit(0.7), fin.triple(0.0, 1e6, 2e6)))
    assert [leak.low, leak.base, leak.high] == pytest.approx([0, 700_000, 1_400_000])
    none = one(spark, fin.fim3_recoupment(F.lit(10.0), F.lit(0.0), F.lit(0.5), F.lit(0.0)))
    assert none.months == math.inf
    cap = one(spark, fin.fim7_liability(F.lit(5e6), F.lit(False), F.lit(False), F.lit(None).cast("struct<low:double,base:double,high:double>"), fin.triple(1.0)))
    assert (cap.exposure.low, cap.exposure.high, cap.user_input_required) == (5e6, 5e6, False)


def test_score_saturates(spark):
    assert one(spark, sc.saturating(F.lit(0.48))) == pytest.approx(100 * (1 - math.exp(-0.48 / 1.5)))
    assert one(spark, sc.saturating(F.lit(1e9))) == 100 and one(spark, sc.saturating(F.lit(1.0), 0.0)) == 100


def test_match_offsets_equal_those_of_a_scan(spark):
    import re

    for text in ("", "none", "12 and 345", "7", "😀 8 x99"):
        got = [(m.start, m.end, m.value) for m in one(spark, tx.find_all(F.lit(text), "[0-9]+"))]
        # Spark counts a character beyond the BMP as one, as Python does
        assert got == [(m.start(), m.end(), m.group()) for m in re.finditer("[0-9]+", text)]


def test_word_error_rate(spark):
    assert one(spark, tx.word_error_rate(F.lit("a b c d"), F.lit("a x c"))) == 0.5
    assert one(spark, tx.word_error_rate(F.lit(" "), F.lit("x"))) == 1.0


def test_threshold_costs_equal_plain_sums(spark):
    rows = [(float(i % 7), i % 3 == 0, 10.0 + i, 1.0 + i % 2) for i in range(40)]
    cases = spark.createDataFrame(rows, "score double, exposed boolean, miss_cost double, effort_cost double")
    got = {r.threshold: r for r in mt.threshold_costs(cases, spark.createDataFrame([(2.0,), (3.5,), (9.0,)], "threshold double")).collect()}
    for t, r in got.items():
        assert r.missed_cost == sum(m for s, e, m, _ in rows if e and s < t)
        assert r.effort_cost == sum(c for s, _, _, c in rows if s >= t)
    assert mt.best_threshold(mt.threshold_costs(cases, spark.createDataFrame([(2.0,), (9.0,)], "threshold double"))).count() == 1


def test_bootstrap_interval_holds_the_mean(spark):
    docs = spark.range(500).select(F.col("id").alias("k"), (F.col("id") % 10).cast("double").alias("v"))
    r = mt.bootstrap_interval(docs, "v", "k").first()
    assert r.samples == 200 and r.low < 4.5 < r.high
