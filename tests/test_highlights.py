"""Neighbouring segments that agree become one."""

import duckdb
from pyspark.sql import functions as F

from clausemill.operators import highlights as hl
from clausemill.plans import catalog
from clausemill.plans import review_queries as rq

SF = "/root/testdata/sf0.001"


def test_neighbours_agree_without_term(spark):
    texts, ranges = rq._highlight_input(spark, SF)
    parts = hl.segments(texts, ranges.filter("label <> 'term'"), "doc")
    assert parts.count() == 5 * texts.count()
    merged = hl.merge_equal(parts, "doc").join(texts, "doc").withColumn("labels", F.array_join("labels", "+"))
    got = merged.withColumn("end", F.when(F.col("end") < F.length("text"), F.col("end"))).groupBy("start", "end", "labels").count().collect()
    n = texts.count()
    assert sorted(map(tuple, got), key=lambda r: r[0]) == [(0, 3, "amount", n), (3, 5, "amount+party", n), (5, 12, "party", n), (12, None, "", n)]


def test_merge_equals_sql_where_neighbours_agree(spark, tmp_path):
    """Keys that repeat with texts of two lengths: their plain ends are neighbours."""
    con = duckdb.connect()
    con.execute(f"CREATE VIEW given AS SELECT * FROM '{SF}/orders.parquet'")
    con.execute(f"COPY (FROM given UNION ALL SELECT * REPLACE (o_orderpriority || 'xyz' AS o_orderpriority) FROM given WHERE o_orderkey % 3 = 0) TO '{tmp_path}/orders.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet'")
    rows = lambda name: sorted(tuple(r) for r in catalog.QUERIES[name](spark, str(tmp_path)).select("doc", "start", "end", "labels").collect())
    merged = rows("merge_plain_segments")
    assert merged == sorted(con.execute(f'SELECT doc, start, "end", labels FROM ({catalog.SQL["merge_plain_segments"]})').fetchall())
    assert len(merged) < len(rows("highlight_segments"))
    con.close()
