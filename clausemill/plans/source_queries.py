"""Typed loads over text versions of given tables, some rows of which are broken on purpose."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import typed as ty
from ..sources.readers import read_table
from .registry import query

FIELDS = {
    "evidence_id": ty.Field(), "authority_tier": ty.Field(checks={"not official": ty.one_of("A1", "A2")}), "summary": ty.Field(checks={"too long": ty.words_below(15)}), "year": ty.Field("int", False, {"out of range": lambda c: c.between(1900, 2099)}),
    "price": ty.Field("double"),
}


def evidence_rows(spark, sf):
    """An evidence row as text for each order."""
    k = F.col("o_orderkey")
    return read_table(spark, sf, "orders").select(
        F.when(k % 19 != 0, F.concat(F.lit("EV-"), k.cast("string"))).otherwise(" ").alias("evidence_id"), F.when(k % 7 == 0, "B").when(k % 2 == 0, "A1").otherwise("A2").alias("authority_tier"),
        F.when(k % 11 == 0, F.repeat(F.lit("word "), 15)).otherwise(F.col("o_orderpriority")).alias("summary"), F.when(k % 13 == 0, "n/a").when(k % 17 == 0, "1776").when(k % 5 != 0, F.date_format("o_orderdate", "yyyy")).alias("year"),
        F.when(k % 23 != 0, F.col("o_totalprice").cast("string")).otherwise("12,5").alias("price"), k.alias("row"),
    )


@query("""
WITH r AS (SELECT o_orderkey AS k FROM orders), p AS (
  SELECT k, 'evidence_id: missing' AS problem FROM r WHERE k % 19 = 0 UNION ALL SELECT k, 'authority_tier: not official' FROM r WHERE k % 7 = 0 UNION ALL SELECT k, 'summary: too long' FROM r WHERE k % 11 = 0
  UNION ALL SELECT k, 'year: not int' FROM r WHERE k % 13 = 0 UNION ALL SELECT k, 'year: out of range' FROM r WHERE k % 13 <> 0 AND k % 17 = 0 UNION ALL SELECT k, 'price: not double' FROM r WHERE k % 23 = 0)
SELECT k AS row, problem FROM p
""")
def typed_load_problems(spark, sf):
    bad = ty.split_rows(ty.typed(evidence_rows(spark, sf), FIELDS))[1]
    return bad.select("row", F.explode("problems").alias("problem"))


@query("""
WITH b AS (SELECT o_orderkey % 19 = 0 OR o_orderkey % 7 = 0 OR o_orderkey % 11 = 0 OR o_orderkey % 13 = 0 OR o_orderkey % 17 = 0 OR o_orderkey % 23 = 0 AS bad FROM orders), n AS (SELECT count(*) FILTER (NOT bad) AS good, count(*) FILTER (bad) AS bad FROM b),
c AS (SELECT count(*) FILTER (length(trim(c_name)) > 0) AS good, count(*) FILTER (coalesce(trim(c_name), '') = '') AS bad FROM customer)
SELECT 'evidence' AS source, good, bad, CAST(156 AS BIGINT) AS expected, CASE WHEN good = 0 THEN 'no rows' WHEN good <> 156 THEN 'expected 156' END AS problem FROM n UNION ALL SELECT 'parties', good, bad, 1500, CASE WHEN good = 0 THEN 'no rows' WHEN good <> 1500 THEN 'expected 1500' END FROM c
""")
def typed_source_counts(spark, sf):
    """Good and bad rows of two sources against the counts that they should have."""
    parties = ty.typed(read_table(spark, sf, "customer").select("c_custkey", "c_name"), {"c_name": ty.Field()})
    return ty.counts_by_source({"evidence": ty.typed(evidence_rows(spark, sf), FIELDS), "parties": parties}, {"evidence": 156, "parties": 1500})
