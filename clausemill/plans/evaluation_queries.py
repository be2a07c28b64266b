"""Evaluation metrics, audits, selections, page edits and sinks over the driver's tables.

Cases are derived from orders and lines by arithmetic on keys, so that the SQL beside each query
states them without the operators.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audit as au
from ..operators import metrics as mt
from ..operators import pages as pg
from ..operators import selection as sl
from ..sources import sinks
from ..sources.readers import read_table
from .registry import query


def key():
    return F.col("o_orderkey")


def priority():
    return F.col("o_orderpriority")


def orders(spark, sf):
    return read_table(spark, sf, "orders")


@query("""
WITH c AS (SELECT o_orderpriority AS arm, o_orderkey % 3 = 0 AS g, o_totalprice > 150000 AS p FROM orders),
s AS (SELECT arm, count(*) FILTER (g AND p) AS tp, count(*) FILTER (NOT g AND p) AS fp, count(*) FILTER (g AND NOT p) AS fn, count(*) FILTER (NOT g AND NOT p) AS tn FROM c GROUP BY arm)
SELECT *, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1, round(CASE WHEN fp + tn > 0 THEN fp / (fp + tn) ELSE 0 END, 6) AS benign_fpr FROM s
""")
def confusion_by_arm(spark, sf):
    return mt.confusion(orders(spark, sf).withColumn("arm", priority()), ["arm"], key() % 3 == 0, F.col("o_totalprice") > 150000)


@query("SELECT o_orderpriority AS arm, round(1 - avg(abs((o_orderkey % 10) / 10 - CASE WHEN o_orderkey % 7 = 0 THEN 0 ELSE (o_custkey % 11) / 10 END)), 6) AS severity_agreement FROM orders WHERE o_orderkey % 3 = 0 GROUP BY 1")
def severity_agreement_by_arm(spark, sf):
    cases = orders(spark, sf).select(priority().alias("arm"), (key() % 3 == 0).alias("gold_is_risk"), (key() % 10 / 10).alias("gold_severity"), F.when(key() % 7 != 0, F.col("o_custkey") % 11 / 10).alias("predicted_severity"))
    return mt.severity_agreement(cases, ["arm"])


@query("""
WITH c AS (SELECT o_orderpriority AS arm, (o_orderkey % 100) / 99 AS p, CAST((o_orderkey * 7) % 2 AS DOUBLE) AS y FROM orders),
b AS (SELECT arm, CASE WHEN p > 2/3 THEN 2 WHEN p > 1/3 THEN 1 ELSE 0 END AS bin, count(*) AS n, avg(p) AS ap, avg(y) AS ay, sum((p - y) * (p - y)) AS se FROM c GROUP BY ALL)
SELECT arm, CAST(sum(n) AS BIGINT) AS cases, round(sum(n * abs(ap - ay)) / sum(n), 6) AS ece, round(sum(se) / sum(n), 6) AS brier FROM b GROUP BY arm
""")
def calibration_by_arm(spark, sf):
    return mt.calibration(orders(spark, sf).select(priority().alias("arm"), (key() % 100 / 99).alias("p"), (key() * 7 % 2).cast("double").alias("y")), ["arm"])


@query("""
WITH c AS (SELECT o_orderpriority AS arm, o_orderkey, o_orderkey * 31 % 1009 AS score, o_custkey % 97 AS value FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY arm ORDER BY score DESC, o_orderkey) AS s, row_number() OVER (PARTITION BY arm ORDER BY value DESC, o_orderkey) AS v FROM c),
t AS (SELECT arm, coalesce(sum(value) FILTER (s <= 5), 0) AS g, coalesce(sum(value) FILTER (v <= 5), 0) AS b FROM r GROUP BY arm)
SELECT arm, CAST(g AS BIGINT) AS captured, CAST(b AS BIGINT) AS oracle, round(CASE WHEN b > 0 THEN g / b ELSE 1 END, 6) AS utility FROM t
""")
def top_utility(spark, sf):
    return mt.top_share(orders(spark, sf).select(priority().alias("arm"), "o_orderkey", (key() * 31 % 1009).alias("score"), (F.col("o_custkey") % 97).alias("value")), ["arm"], "score", "value", 5, "o_orderkey")


@query("""
WITH c AS (SELECT o_orderpriority AS arm, o_orderkey, run, (o_orderkey * 13 + run * (o_orderkey % 5)) % 1013 AS score FROM orders, (VALUES (0), (1), (2)) r(run)),
s AS (SELECT arm, avg(d) AS spread FROM (SELECT arm, o_orderkey, max(score) - min(score) AS d FROM c GROUP BY ALL) GROUP BY arm),
b AS (SELECT arm, run, list(o_orderkey) AS l FROM (SELECT *, row_number() OVER (PARTITION BY arm, run ORDER BY score DESC, o_orderkey) AS n FROM c) WHERE n <= 10 GROUP BY ALL),
a AS (SELECT x.arm, avg(len(list_intersect(x.l, y.l)) / len(list_distinct(list_concat(x.l, y.l)))) AS agreement FROM b x JOIN b y ON y.arm = x.arm AND y.run = 0 WHERE x.run > 0 GROUP BY x.arm)
SELECT arm, round(spread, 6) AS spread, round(agreement, 6) AS agreement FROM s JOIN a USING (arm)
""")
def stability_of_runs(spark, sf):
    runs = orders(spark, sf).select(priority().alias("arm"), "o_orderkey", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("run"))
    return mt.stability(runs.withColumn("score", (key() * 13 + F.col("run") * (key() % 5)) % 1013), ["arm"], "o_orderkey", 10)


_COSTS = "c AS (SELECT o_orderkey % 101 AS score, o_custkey % 4 = 0 AS exposed, CAST(o_orderkey % 50 AS DOUBLE) AS miss, 2.0 AS effort FROM orders), h AS (SELECT CAST(unnest(generate_series(0, 110, 5)) AS DOUBLE) AS threshold), k AS (SELECT threshold, coalesce(sum(miss) FILTER (score < threshold AND exposed), 0) AS missed_cost, CAST(coalesce(sum(effort) FILTER (score >= threshold), 0) AS DOUBLE) AS effort_cost, round(count(*) FILTER (score >= threshold AND NOT exposed) / greatest(count(*) FILTER (NOT exposed), 1), 6) AS false_trigger_rate, round(count(*) FILTER (score >= threshold AND exposed) / greatest(count(*) FILTER (exposed), 1), 6) AS recall FROM c, h GROUP BY threshold), t AS (SELECT threshold, missed_cost, effort_cost, missed_cost + effort_cost AS total_cost, false_trigger_rate, recall FROM k)"


def _costs(spark, sf):
    cases = orders(spark, sf).select((key() % 101).alias("score"), (F.col("o_custkey") % 4 == 0).alias("exposed"), (key() % 50).cast("double").alias("miss_cost"), F.lit(2.0).alias("effort_cost"))
    return mt.threshold_costs(cases, spark.createDataFrame([(float(t),) for t in range(0, 111, 5)], "threshold double"))


@query(f"WITH {_COSTS} SELECT * FROM t")
def threshold_sweep(spark, sf):
    return _costs(spark, sf)


@query(f"WITH {_COSTS} SELECT * FROM t ORDER BY total_cost, false_trigger_rate, recall DESC, threshold DESC LIMIT 1")
def best_threshold(spark, sf):
    return mt.best_threshold(_costs(spark, sf))


@query("""
WITH c AS (SELECT l_orderkey AS doc, l_returnflag AS exposure_type, l_quantity AS w, CASE WHEN l_linenumber <= 2 THEN l_quantity ELSE 0 END AS c FROM lineitem),
k AS (SELECT doc, exposure_type, sum(c) AS c, sum(w) AS w FROM c GROUP BY ALL HAVING sum(w) > 0) SELECT doc, count(*) AS types, round(avg(c / w), 6) AS capture FROM k GROUP BY doc
""")
def exposure_capture(spark, sf):
    rows = read_table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_returnflag").alias("exposure_type"), F.col("l_quantity").alias("weight"), F.when(F.col("l_linenumber") <= 2, F.col("l_quantity")).otherwise(0.0).alias("captured"))
    return mt.exposure_capture(rows, ["doc"])


@query()
def bootstrap_interval(spark, sf):
    """Poisson weights by hash; tested against their properties."""
    return mt.bootstrap_interval(orders(spark, sf).select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey")


@query("""
WITH c AS (SELECT ['m' || (o_orderkey % 4), 'm' || (o_custkey % 6)] AS ms, o_orderkey % 40 < 39 OR o_orderkey % 4 = 1 AS ok FROM orders), r AS (SELECT unnest(ms) AS metric, ok FROM c)
SELECT metric, count(*) AS cases, count(*) FILTER (ok) AS passed, CASE WHEN count(*) FILTER (ok) = count(*) THEN 'pass' ELSE 'fail' END AS status FROM r GROUP BY metric
""")
def gate_status(spark, sf):
    metrics = F.array(F.concat(F.lit("m"), key() % 4), F.concat(F.lit("m"), F.col("o_custkey") % 6))
    return mt.gate_status(orders(spark, sf).select(metrics.alias("metrics"), ((key() % 40 < 39) | (key() % 4 == 1)).alias("passed")))


@query("""
WITH c AS (SELECT CAST(o_orderkey % 100 AS DOUBLE) AS missed, CAST(o_custkey % 10 AS DOUBLE) AS effort FROM orders)
SELECT scenario, count(*) AS fixtures, round(sum(factor * missed + effort), 6) AS loss FROM c, (VALUES ('half', 0.5), ('base', 1.0), ('double', 2.0)) s(scenario, factor) GROUP BY scenario
""")
def sensitivity_losses(spark, sf):
    factors = F.create_map(F.lit("half"), F.lit(0.5), F.lit("base"), F.lit(1.0), F.lit("double"), F.lit(2.0))
    return mt.sensitivity_losses(orders(spark, sf).select((key() % 100).cast("double").alias("missed"), (F.col("o_custkey") % 10).cast("double").alias("effort"), factors.alias("sensitivity")))


@query("SELECT o_orderpriority AS arm, count(*) AS cases, round(avg(s), 6) AS mean, round(avg(s) FILTER (s > 0), 6) AS mean_positive, max(s) AS most FROM (SELECT o_orderpriority, o_orderkey % 50 - 20 AS s FROM orders) GROUP BY 1")
def arm_score_summary(spark, sf):
    return mt.arm_scores(orders(spark, sf).select(priority().alias("arm"), (key() % 50 - 20).alias("score")), "arm", "score")


@query("""
WITH v AS (SELECT o_orderstatus AS metric, o_orderpriority AS arm, max(o_orderkey % 20) AS value FROM orders GROUP BY ALL), e AS (SELECT metric, max(value) AS most, min(value) AS least FROM v GROUP BY metric)
SELECT metric, most, string_agg(arm, ',' ORDER BY arm) FILTER (value = most) AS best_arms, least, string_agg(arm, ',' ORDER BY arm) FILTER (value = least) AS worst_arms FROM v JOIN e USING (metric) GROUP BY metric, most, least
""")
def arm_extrema(spark, sf):
    return mt.arm_extrema(orders(spark, sf).groupBy(F.col("o_orderstatus").alias("metric"), priority().alias("arm")).agg(F.max(key() % 20).alias("value")))


@query("""
WITH f AS (SELECT l_returnflag AS arm, l_orderkey AS doc, l_linenumber AS rank, l_quantity AS w, l_discount > 0.05 AS x, l_tax < 0.05 AS s FROM lineitem),
d AS (SELECT arm, doc, coalesce(sum(w) FILTER (rank <= 1), 0) AS w1, coalesce(sum(w) FILTER (rank <= 3), 0) AS w3, sum(w) AS w, count(*) FILTER (rank <= 3 AND x) AS e3, count(*) FILTER (x) AS e, count(*) FILTER (NOT s) AS u, count(*) AS n FROM f GROUP BY ALL)
SELECT arm, count(*) AS docs, round(avg(CASE WHEN w > 0 THEN w1 / w END), 6) AS capture_1, round(avg(CASE WHEN w > 0 THEN w3 / w END), 6) AS capture_3, round(avg(CASE WHEN e > 0 THEN e3 / e END), 6) AS exposed_recall_3, round(sum(u) / sum(n), 6) AS unsupported_rate FROM d GROUP BY arm
""")
def metric_bundle(spark, sf):
    rows = read_table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("arm"), F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("rank"), F.col("l_quantity").alias("weight"), (F.col("l_discount") > 0.05).alias("exposed"), (F.col("l_tax") < 0.05).alias("supported"))
    return mt.metric_bundle(rows, ["arm"], "doc")


# --- audits --------------------------------------------------------------------------------


@query("""
SELECT l_orderkey, l_linenumber, v AS violation FROM (SELECT l_orderkey, l_linenumber, unnest([CASE WHEN l_quantity > 45 THEN 'too_many' END, CASE WHEN l_discount > 0.09 THEN 'discount' END, CASE WHEN l_shipdate IS NULL THEN 'no_date' END]) AS v FROM lineitem) WHERE v IS NOT NULL
""")
def row_constraints(spark, sf):
    rows = read_table(spark, sf, "lineitem").withColumn("row", F.struct("l_orderkey", "l_linenumber"))
    found = au.violations(rows, "row", {"too_many": F.col("l_quantity") > 45, "discount": F.col("l_discount") > 0.09, "no_date": F.col("l_shipdate").isNull()})
    return found.select("row.l_orderkey", "row.l_linenumber", "violation")


@query("SELECT l_orderkey, l_suppkey, count(*) AS copies FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark, sf):
    return au.duplicates(read_table(spark, sf, "lineitem"), "l_orderkey", "l_suppkey")


@query("SELECT DISTINCT o_custkey FROM orders WHERE o_orderkey % 2 = 0 INTERSECT SELECT DISTINCT o_custkey FROM orders WHERE o_orderkey % 5 = 1")
def split_leakage(spark, sf):
    return au.leaked(orders(spark, sf).filter(key() % 2 == 0), orders(spark, sf).filter(key() % 5 == 1), "o_custkey")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 13 <> 0)")
def missing_references(spark, sf):
    known = read_table(spark, sf, "customer").filter("c_custkey % 13 <> 0")
    return au.missing_references(orders(spark, sf).select("o_orderkey", "o_custkey"), known, "o_custkey", "c_custkey")


@query("""
WITH c AS (SELECT l_orderkey AS item_id, l_suppkey AS source_id FROM lineitem WHERE l_orderkey % 3 <> 0), s AS (SELECT s_suppkey AS source_id, CASE WHEN s_suppkey % 5 = 0 THEN ' unknown ' WHEN s_suppkey % 5 = 1 THEN NULL ELSE 'CC' END AS license FROM supplier WHERE s_suppkey % 7 <> 0)
SELECT DISTINCT item_id, c.source_id, CASE WHEN s.source_id IS NULL THEN 'source_not_listed' ELSE 'license_unknown' END AS problem FROM c LEFT JOIN s ON s.source_id = c.source_id WHERE s.source_id IS NULL OR coalesce(trim(license), '') IN ('', 'unknown')
""")
def license_audit(spark, sf):
    cited = read_table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("item_id")).agg(F.collect_set("l_suppkey").alias("source_ids"))  # lines of an order
    k = F.col("s_suppkey")
    sources = read_table(spark, sf, "supplier").filter(k % 7 != 0).select(k.alias("source_id"), F.when(k % 5 == 0, " unknown ").when(k % 5 != 1, "CC").alias("license"))
    return au.license_audit(cited.withColumn("public", F.col("item_id") % 3 != 0), sources)


@query("""
WITH a AS (SELECT 'f' || o_orderkey AS path, o_custkey AS h FROM orders WHERE o_orderkey % 10 <> 0), b AS (SELECT 'f' || o_orderkey AS path, CASE WHEN o_orderkey % 17 = 0 THEN -1 ELSE o_custkey END AS h FROM orders WHERE o_orderkey % 11 <> 0)
SELECT path, CASE WHEN b.h IS NULL THEN 'missing' WHEN a.h IS NULL THEN 'extra' ELSE 'changed' END AS change FROM a FULL JOIN b USING (path) WHERE a.h IS NULL OR b.h IS NULL OR a.h <> b.h
""")
def manifest_changes(spark, sf):
    files = orders(spark, sf).select(F.concat(F.lit("f"), key()).alias("path"), F.col("o_custkey").alias("hash"), "o_orderkey")
    after = files.filter(key() % 11 != 0).withColumn("hash", F.when(key() % 17 == 0, -1).otherwise(F.col("hash")))
    return au.manifest_diff(files.filter(key() % 10 != 0), after)


@query("""
SELECT conv_id AS run, turn AS surface, marker FROM conversations JOIN (SELECT conv_id, text AS t, substr(text, 1, 12) AS marker FROM conversations WHERE turn = 0) m USING (conv_id) WHERE length(marker) >= 8 AND contains(text, marker)
""")
def marker_leaks(spark, sf):
    """Turns that hold the beginning of their conversation's first turn."""
    turns = read_table(spark, sf, "conversations").select(F.col("conv_id").alias("run"), F.col("turn").alias("surface"), "text")
    markers = turns.filter("surface = 0").select("run", F.substring("text", 1, 12).alias("marker")).filter(F.length("marker") >= 8)
    return au.marker_leaks(turns, markers, "run")


@query("""
SELECT doc_id, i - 1 AS line, length(regexp_replace(x, '[^가-힣]', '', 'g')) AS syllables FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS x, unnest(generate_series(1, len(string_split(t, chr(10))))) AS i FROM (SELECT doc_id, text || chr(10) || repeat('가나', CAST(40 + doc_id % 40 AS INTEGER)) AS t FROM documents)) WHERE length(regexp_replace(x, '[^가-힣]', '', 'g')) >= 120
""")
def private_passages(spark, sf):
    text = F.concat("text", F.lit("\n"), F.expr("repeat('가나', CAST(40 + doc_id % 40 AS INT))"))
    return au.private_passages(read_table(spark, sf, "documents").select("doc_id", text.alias("text")), "doc_id")


@query("""
SELECT o_custkey, CASE WHEN min(k) = 0 THEN 'failed' WHEN min(k) = 1 THEN 'missing' ELSE 'ready' END AS status, count(*) FILTER (k = 0) AS n_failed, count(*) FILTER (k = 1) AS n_missing, count(*) FILTER (k = 2) AS n_ready FROM (SELECT o_custkey, CASE WHEN o_orderkey % 9 = 0 THEN 0 WHEN o_orderkey % 4 = 0 THEN 1 ELSE 2 END AS k FROM orders) GROUP BY 1
""")
def component_status(spark, sf):
    status = F.when(key() % 9 == 0, "failed").when(key() % 4 == 0, "missing").otherwise("ready")
    return au.status_ladder(orders(spark, sf).select("o_custkey", status.alias("status")), "o_custkey", ["failed", "missing", "ready"])


# --- selections and counts -------------------------------------------------------------------


@query("SELECT source, lang, count(*) AS chunks FROM documents GROUP BY ALL")
def corpus_counts(spark, sf):
    return read_table(spark, sf, "documents").groupBy("source", "lang").agg(F.count("*").alias("chunks"))


@query("""
SELECT c.category, CAST(coalesce(sum(CASE WHEN kind = 'presence' THEN 1 END), 0) AS BIGINT) AS presence, CAST(coalesce(sum(CASE WHEN kind = 'missing_protection' THEN 1 END), 0) AS BIGINT) AS missing_protection
FROM (SELECT 'F' || i AS category FROM generate_series(1, 9) g(i)) c LEFT JOIN (SELECT 'F' || (1 + p_size % 7) AS category, CASE WHEN p_partkey % 3 = 0 THEN 'presence' ELSE 'missing_protection' END AS kind FROM part) p USING (category) GROUP BY 1
""")
def kind_counts_grid(spark, sf):
    """Counts of each kind for each category, zero where there is none."""
    kinds = ["presence", "missing_protection"]
    rules = read_table(spark, sf, "part").select(F.concat(F.lit("F"), 1 + F.col("p_size") % 7).alias("category"), F.when(F.col("p_partkey") % 3 == 0, kinds[0]).otherwise(kinds[1]).alias("kind"))
    counts = rules.groupBy("category").pivot("kind", kinds).count()
    grid = spark.range(1, 10).select(F.concat(F.lit("F"), "id").alias("category"))
    return grid.join(counts, "category", "left").fillna(0, kinds)


@query("""
WITH r AS (SELECT l_orderkey AS doc, l_partkey AS record_id, min(l_linenumber) AS o FROM lineitem GROUP BY ALL) SELECT doc, record_id, CAST(row_number() OVER (PARTITION BY doc ORDER BY o, record_id) AS INTEGER) AS place FROM r
""")
def ordered_records(spark, sf):
    """Distinct records of a document in the order of their first occurrence."""
    rows = read_table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_partkey").alias("record_id"), "l_linenumber")
    return sl.first_occurrences(rows, ["doc", "record_id"], ["l_linenumber"])


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE array_to_string(list_filter([CASE WHEN o_orderkey % 2 = 0 THEN 'capped' END, CASE WHEN o_orderkey % 3 <> 0 THEN 'vague' END, CASE WHEN o_orderkey % 2 = 1 THEN 'capped' END], lambda x: x IS NOT NULL), ',') END AS flags FROM orders
""")
def merged_flags(spark, sf):
    none = F.lit(None).cast("array<string>")
    a = F.when(key() % 6 != 0, F.array(F.when(key() % 2 == 0, " capped "), F.when(key() % 3 != 0, "vague"), F.lit("")))
    b = F.when(key() % 2 == 1, F.array(F.lit("capped"), F.lit("capped"))).otherwise(none)
    b = F.when(key() % 6 != 0, b)
    return orders(spark, sf).select("o_orderkey", F.array_join(sl.merged_flags(a, b), ",").alias("flags"))


@query("""
WITH a AS (SELECT o_custkey AS k FROM orders WHERE o_orderkey % 4 <> 0), b AS (SELECT o_custkey AS k FROM orders WHERE o_orderkey % 5 <> 0), x AS (SELECT k, 'missing' AS side FROM (SELECT k FROM a EXCEPT ALL SELECT k FROM b)), y AS (SELECT k, 'extra' AS side FROM (SELECT k FROM b EXCEPT ALL SELECT k FROM a))
SELECT side, k, count(*) AS copies FROM (SELECT * FROM x UNION ALL SELECT * FROM y) GROUP BY ALL
""")
def set_differences(spark, sf):
    rows = orders(spark, sf).select(F.col("o_custkey").alias("k"), "o_orderkey")
    return sl.differences(rows.filter(key() % 4 != 0).select("k"), rows.filter(key() % 5 != 0).select("k")).groupBy("side", "k").agg(F.count("*").alias("copies"))


@query("""
WITH t AS (SELECT o_custkey AS doc, o_orderpriority AS module, o_orderkey % 12 AS item, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) AS turn FROM orders),
f AS (SELECT doc, item, turn, module FROM (SELECT *, row_number() OVER (PARTITION BY doc, item ORDER BY turn, module) AS n FROM t) WHERE n = 1)
SELECT doc, module, item, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY turn, module, item) AS place FROM f) WHERE place <= 6
""")
def round_robin_inputs(spark, sf):
    """At most six different inputs of a document, in turn over its modules."""
    rows = orders(spark, sf).select(F.col("o_custkey").alias("doc"), priority().alias("module"), (key() % 12).alias("item"), "o_orderkey")
    return sl.round_robin(rows, "doc", "module", "item", ["o_orderkey"], 6)


@query("""
WITH f AS (SELECT o_custkey AS doc, o_orderpriority AS category, o_orderkey AS finding, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) AS turn FROM orders),
i AS (SELECT o_orderpriority AS category, g.i AS ordinal FROM (SELECT DISTINCT o_orderpriority FROM orders), generate_series(1, 7) g(i))
SELECT doc, category, finding, category || ':' || ordinal AS item, CAST(ordinal AS INTEGER) AS ordinal FROM f JOIN i USING (category) WHERE ordinal BETWEEN 3 * turn - 2 AND 3 * turn
""")
def dealt_checkpoints(spark, sf):
    """Each finding takes the next three checkpoints of its category that no finding of the document took."""
    findings = orders(spark, sf).select(F.col("o_custkey").alias("doc"), priority().alias("category"), key().alias("finding"))
    items = findings.select("category").distinct().select("category", F.explode(F.sequence(F.lit(1), F.lit(7))).alias("ordinal"))
    return sl.dealt_items(findings, items.withColumn("item", F.concat_ws(":", "category", F.col("ordinal").cast("string"))), "doc", "category", "finding", 3)


@query("""
WITH f AS (SELECT o_custkey AS doc, o_orderpriority AS category, min(o_orderkey) AS first FROM orders GROUP BY ALL) SELECT doc, category, CAST(row_number() OVER (PARTITION BY doc ORDER BY first, category) AS INTEGER) AS place FROM f
""")
def category_guidance(spark, sf):
    return sl.first_occurrences(orders(spark, sf).select(F.col("o_custkey").alias("doc"), priority().alias("category"), "o_orderkey"), ["doc", "category"], ["o_orderkey"])


@query("SELECT o_orderkey, CASE WHEN o_totalprice IS NULL THEN 'unread' WHEN o_orderstatus = 'P' THEN 'partial' WHEN o_totalprice > 200000 THEN 'quantified' ELSE 'qualitative' END AS status FROM orders")
def status_derivation(spark, sf):
    status = sl.clauses_of({"unread": F.col("o_totalprice").isNull(), "partial": F.col("o_orderstatus") == "P", "quantified": F.col("o_totalprice") > 200000}, "qualitative")
    return orders(spark, sf).select("o_orderkey", status.alias("status"))


# --- pages and sinks -------------------------------------------------------------------------

_PAGES = "pg AS (SELECT o_custkey AS doc, o_orderkey AS page_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INTEGER) AS page_index FROM orders)"


def _pages(spark, sf):
    from pyspark.sql import Window

    place = (F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1).cast("int")
    return orders(spark, sf).select(F.col("o_custkey").alias("doc"), key().alias("page_id"), place.alias("page_index"), F.lit(0).alias("rotation_deg"))


@query(f"WITH {_PAGES}, n AS (SELECT doc, count(*) AS n FROM pg GROUP BY doc) SELECT doc, page_id, CASE WHEN doc % 5 = 0 THEN page_index ELSE CAST(n - 1 - page_index AS INTEGER) END AS page_index, 0 AS rotation_deg, doc % 5 <> 0 AS reordered FROM pg JOIN n USING (doc)")
def page_reorder(spark, sf):
    """Pages in reverse; orders of every fifth document name a page that isn't there."""
    pages = _pages(spark, sf)
    wanted = F.reverse(F.sequence(F.lit(0), F.count("*").cast("int") - 1))
    asked = pages.groupBy("doc").agg(F.when(F.col("doc") % 5 == 0, F.transform(wanted, lambda i: i + 1)).otherwise(wanted).alias("page_order"))
    return pg.reorder(pages, asked, "doc")


@query(f"WITH {_PAGES} SELECT doc, page_id, page_index, CASE WHEN page_index = doc % 3 THEN 90 ELSE 0 END AS rotation_deg FROM pg")
def page_rotate(spark, sf):
    pages = _pages(spark, sf)
    return pg.rotate(pages, pages.filter("page_index = doc % 3").select("doc", "page_index", F.lit(90).alias("degrees")), "doc")


@query(f"WITH {_PAGES} SELECT doc, page_id, CAST(row_number() OVER (PARTITION BY doc ORDER BY page_index) - 1 AS INTEGER) AS page_index, 0 AS rotation_deg FROM pg WHERE page_index <> doc % 4")
def page_delete(spark, sf):
    pages = _pages(spark, sf)
    return pg.delete(pages, pages.filter("page_index = doc % 4"), "doc")


@query("SELECT o_custkey AS doc, count(*) FILTER (o_orderstatus = 'F') * 1.5 AS minutes FROM orders GROUP BY 1")
def correction_minutes(spark, sf):
    return pg.correction_minutes(orders(spark, sf).select(F.col("o_custkey").alias("doc"), (F.col("o_orderstatus") == "F").alias("counted")), "doc")


@query("SELECT c_custkey, c_mktsegment FROM customer")
def log_safe_projection(spark, sf):
    """Customers without the columns marked private."""
    marked = sinks.marked(read_table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_acctbal"), c_name="P2", c_acctbal="P3")
    return sinks.log_safe(marked)


@query("""SELECT page_id, '{"source":{"url":"u' || page_id || '"},"spans":[{"text":"a' || page_id || '"}]}' AS payload FROM pages""")
def scrubbed_payload(spark, sf):
    """Keys of raw images go at any depth."""
    k = F.col("page_id").cast("string")
    source = F.struct(F.concat(F.lit("u"), k).alias("url"), F.col("html").alias("raw_image"))
    spans = F.array(F.struct(F.concat(F.lit("a"), k).alias("text"), F.col("html").alias("thumbnail")))
    rows = read_table(spark, sf, "pages").select("page_id", source.alias("source"), spans.alias("spans"), F.col("html").alias("content"))
    return sinks.without_raw(rows).select("page_id", F.to_json(F.struct("source", "spans")).alias("payload"))
