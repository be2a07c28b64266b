"""Sources of findings: spans of pages, semantic roles, display segments.

An order's clause is a phrase or two by its key (see ``review_queries``), each a span of a page;
some spans are read by OCR, corrected or unknown, and some clauses are unknown.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..dims import PHRASES
from ..operators import provenance as pv
from ..operators import segment as sg
from ..operators import signals as sn
from ..sources.readers import read_table
from .registry import query
from .review_queries import CLAUSES_SQL, LINES_SQL, clauses


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_PATTERNS = ", ".join(f"({k}, {_q(p)})" for k, ps in enumerate(pv.ROLES.values()) for p in ps)
_ROLE_LIST = "[" + ", ".join(map(_q, pv.ROLES)) + "]"
#: Matches with offsets of all patterns in the texts of ``tt``.
MATCHES_SQL = f"""
pat(rank, p) AS (VALUES {_PATTERNS}),
mm AS (SELECT text, rank, regexp_extract_all(text, p) AS m, string_split_regex(text, p) AS g FROM tt, pat WHERE regexp_matches(text, p)),
mi AS (SELECT text, rank, m[i] AS v, CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS s FROM (SELECT *, unnest(generate_series(1, len(m))) AS i FROM mm)),
cd AS (SELECT text, s, s + length(v) AS e, v, list_sort(list(DISTINCT rank)) AS ranks FROM mi WHERE trim(v) <> '' GROUP BY ALL)
"""


_LINES = LINES_SQL.split("mk AS")[0].rstrip().rstrip(",")


@query(f"""
WITH {_LINES}, lp AS (SELECT doc_id, line, CASE WHEN line % 3 = 0 THEN text || ' ' || {"[" + ", ".join(map(_q, PHRASES)) + "]"}[1 + (doc_id + line) % {len(PHRASES)}] ELSE text END AS text FROM ln), tt AS (SELECT DISTINCT text FROM lp), {MATCHES_SQL}
SELECT doc_id, CAST(line AS INTEGER) AS line, CAST(s AS INTEGER) AS start, CAST(e AS INTEGER) AS "end", v AS exact_text, array_to_string(list_transform(ranks, lambda k: {_ROLE_LIST}[k + 1]), '+') AS roles FROM lp JOIN cd USING (text)
""")
def role_candidates(spark, sf):
    """Of all lines of all documents, each third with a phrase appended."""
    lines = sg.text_lines(read_table(spark, sf, "documents")).select("doc_id", "line", "text")
    phrase = F.element_at(F.array(*map(F.lit, PHRASES)), ((F.col("doc_id") + F.col("line")) % len(PHRASES) + 1).cast("int"))
    lines = lines.withColumn("text", F.when(F.col("line") % 3 == 0, F.concat("text", F.lit(" "), phrase)).otherwise(F.col("text")))
    return pv.role_candidates(lines, ["doc_id", "line"]).withColumn("roles", F.array_join("roles", "+"))


def _sources(spark, sf):
    """(clause_spans, spans, findings) derived from orders."""
    k = F.col("o_orderkey")
    pick = lambda x: F.element_at(F.array(*map(F.lit, PHRASES)), (x % len(PHRASES) + 1).cast("int"))
    parts = F.array_compact(F.array(F.struct(F.lit(0).alias("ordinal"), pick(k).alias("text")), F.when(k % 3 == 0, F.struct(F.lit(1).alias("ordinal"), pick(k * 5 + 1).alias("text")))))
    rows = read_table(spark, sf, "orders").select(k.alias("clause_id"), F.inline(parts))
    c = F.col("clause_id")
    span_id = F.concat(F.lit("s"), c.cast("string"), F.when(c % 2 == 0, ":ocr-").otherwise(":text-"), F.col("ordinal").cast("string"))
    rows = rows.withColumn("span_id", span_id)
    source = F.when(c % 5 == 0, "mixed").when(c % 5 == 1, "ocr").when(c % 5 == 2, "text_layer").when(c % 5 == 3, " OCR")
    spans = rows.filter((c % 13 != 0) | (F.col("ordinal") == 1)).select(
        "span_id", (c % 4 + F.col("ordinal")).alias("page_index"), "text", F.when(c % 11 == 0, F.concat("text", F.lit(" 30%"))).alias("corrected_text"), source.alias("text_source"), F.when(c % 2 == 1, 0.9).otherwise(1.0).alias("confidence")
    )
    findings = sn.rule_signals(clauses(spark, sf), ["doc", "clause"]).select(F.concat("rule", F.lit("-"), F.col("clause").cast("string")).alias("finding_id"), F.col("clause").alias("clause_id"))
    return rows.filter(c % 17 != 0).select("clause_id", "ordinal", "span_id"), pv.effective_spans(spans), findings


_SOURCES_SQL = f"""
{CLAUSES_SQL},
op AS (SELECT o_orderkey AS clause_id, 0 AS ordinal, p[1 + o_orderkey % {len(PHRASES)}] AS text FROM orders, ph UNION ALL SELECT o_orderkey, 1, p[1 + (o_orderkey * 5 + 1) % {len(PHRASES)}] FROM orders, ph WHERE o_orderkey % 3 = 0),
pl AS (SELECT *, 's' || clause_id || CASE WHEN clause_id % 2 = 0 THEN ':ocr-' ELSE ':text-' END || ordinal AS span_id, clause_id % 4 + ordinal AS page_index,
  CASE WHEN clause_id % 11 = 0 THEN text || ' 30%' ELSE text END AS shown,
  CASE WHEN clause_id % 5 = 0 THEN CASE WHEN clause_id % 2 = 0 THEN 'ocr' ELSE 'text_layer' END WHEN clause_id % 5 IN (1, 3) THEN 'ocr' ELSE 'text_layer' END AS src FROM op WHERE clause_id % 17 <> 0 AND (clause_id % 13 <> 0 OR ordinal = 1)),
pg AS (SELECT * EXCLUDE (text, shown), shown AS text, CAST(coalesce(sum(length(shown) + 1) OVER (PARTITION BY clause_id ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS g0 FROM pl WHERE clause_id IN (SELECT clause FROM sig)),
tt AS (SELECT DISTINCT text FROM pg), {MATCHES_SQL},
rg AS (SELECT clause_id, g0 + s AS s, g0 + e AS e, ranks, span_id, page_index FROM pg JOIN cd USING (text)),
ls AS (SELECT clause_id, max(g0 + length(text)) AS l, count(*) AS n_spans, arg_min(page_index, ordinal) AS page_index, CASE WHEN count(DISTINCT src) = 1 THEN min(src) ELSE 'mixed' END AS src, bool_or(clause_id % 11 = 0) AS corr, bool_or(src = 'ocr' AND clause_id % 2 = 1) AS box FROM pg GROUP BY clause_id),
cu AS (SELECT clause_id, s AS b0 FROM rg UNION SELECT clause_id, e FROM rg UNION SELECT clause_id, 0 FROM ls UNION SELECT clause_id, l FROM ls),
sx AS (SELECT clause_id, b0 AS s, lead(b0) OVER (PARTITION BY clause_id ORDER BY b0) AS e FROM cu),
sy AS (SELECT sx.clause_id, sx.s, sx.e, list_sort(list_distinct(coalesce(flatten(list(rg.ranks)), []))) AS ranks, min(rg.span_id) AS span_id, min(rg.page_index) AS page_index
  FROM sx LEFT JOIN rg ON rg.clause_id = sx.clause_id AND rg.s <= sx.s AND rg.e >= sx.e WHERE sx.e IS NOT NULL GROUP BY ALL)
"""
_NAMES = f"array_to_string(list_transform(ranks, lambda k: {_ROLE_LIST}[k + 1]), '+')"


@query(f"""WITH {_SOURCES_SQL} SELECT clause_id, s AS start, e AS "end", {_NAMES} AS roles, span_id, page_index FROM sy""")
def highlight_source_segments(spark, sf):
    clause_spans, spans, findings = _sources(spark, sf)
    return pv.source_highlights(findings, clause_spans, spans)[1].withColumn("roles", F.array_join("roles", "+"))


@query(f"""
WITH {_SOURCES_SQL}, a AS (SELECT clause_id, count(*) AS n, count(*) FILTER (len(ranks) > 0) AS h, min(s) FILTER (len(ranks) > 0) AS focus, list_sort(list_distinct(flatten(list(ranks)))) AS ranks FROM sy GROUP BY clause_id), c AS (SELECT clause_id, count(*) AS c FROM rg GROUP BY clause_id),
f AS (SELECT rule || '-' || clause AS finding_id, clause AS clause_id FROM sig)
SELECT finding_id, clause_id, 'source-' || substr(sha256(finding_id || '|' || clause_id), 1, 12) AS anchor_id, CASE WHEN h > 0 THEN 'exact_span_validated' ELSE 'missing_exact_span' END AS status, ls.page_index, coalesce(src, 'missing') AS text_source, coalesce(corr, false) AS is_user_corrected, coalesce(box, false) AS has_real_bbox,
  coalesce(n_spans, 0) AS n_spans, coalesce(l, 0) AS text_length, coalesce(c, 0) AS n_candidates, coalesce(n, 0) AS n_segments, coalesce(h, 0) AS n_highlighted, focus AS focus_start, coalesce({_NAMES}, '') AS roles
FROM f LEFT JOIN ls USING (clause_id) LEFT JOIN a USING (clause_id) LEFT JOIN c USING (clause_id)
""")
def source_highlights(spark, sf):
    clause_spans, spans, findings = _sources(spark, sf)
    return pv.source_highlights(findings, clause_spans, spans)[0].withColumn("roles", F.array_join("roles", "+"))


@query(f"""
WITH {_LINES}, o AS (SELECT doc_id, line, length(text) AS n, CAST(coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS g FROM ln),
w AS (SELECT doc_id, 100 * i AS s, least(100 * i + 60, l) AS e FROM (SELECT doc_id, l, unnest(generate_series(0, (l - 1) // 100)) AS i FROM (SELECT doc_id, max(g + n) AS l FROM o GROUP BY doc_id)))
SELECT doc_id, s AS start, CAST(line AS INTEGER) AS line, CAST(line // 40 AS INTEGER) AS page_index, greatest(s, g) AS piece_start, least(e, g + n) AS piece_end FROM w JOIN o USING (doc_id) WHERE greatest(s, g) < least(e, g + n)
""")
def ranges_on_pages(spark, sf):
    """Windows of 60 characters at every 100th of a document, cut at the borders of lines (here
    the spans, forty a page)."""
    lines = sg.text_lines(read_table(spark, sf, "documents")).select("doc_id", F.col("line").alias("ordinal"), "text")
    spans = pv.running_before(lines, ["doc_id"], "ordinal", F.length("text") + 1, "global_start").withColumn("global_end", F.col("global_start") + F.length("text"))
    ends = spans.groupBy("doc_id").agg(F.max("global_end").alias("n"))
    at = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / 100))).alias("i")
    windows = ends.select("doc_id", "n", at).select("doc_id", (100 * F.col("i")).alias("start"), F.least(100 * F.col("i") + 60, F.col("n")).alias("end"))
    got = pv.located(windows, spans.drop("text"), ["doc_id"])
    return got.select("doc_id", "start", F.col("ordinal").alias("line"), F.floor(F.col("ordinal") / 40).cast("int").alias("page_index"), "piece_start", "piece_end")


@query("""
SELECT o_orderkey AS finding_id, 2 AS start, 5 AS "end", 'timing_or_term' AS roles FROM orders WHERE o_orderkey % 9 = 0 AND o_orderkey % 10 <> 0
""")
def valid_highlights(spark, sf):
    """Candidates fail closed: of nine kinds eight fail one predicate each, and some spans have no text."""
    orders = read_table(spark, sf, "orders")
    k, text, kind = F.col("o_orderkey"), F.col("o_orderpriority"), F.col("o_orderkey") % 9
    c = orders.select(
        k.alias("finding_id"), F.when(kind == 1, -k).otherwise(k).alias("clause_id"), F.when(kind == 2, k + 1).otherwise(k).alias("span_id"), F.when(kind == 3, -1).otherwise(2).alias("start"),
        F.when(kind == 4, 50).when(kind == 5, 2).otherwise(5).alias("end"), F.when(kind == 6, "??").when(kind == 5, "").otherwise(F.substring(text, 3, 3)).alias("exact_text"),
        F.when(kind == 7, F.array(F.lit("color"))).otherwise(F.array(F.lit("color"), F.lit("timing_or_term"))).alias("roles"),
    )
    spans = orders.select(k.alias("span_id"), F.when(k % 10 != 0, text).alias("text"))
    out = pv.valid_candidates(c, orders.filter(kind != 8).select(k.alias("finding_id")), orders.select(k.alias("clause_id"), k.alias("span_id")), spans)
    return out.select("finding_id", "start", "end", F.array_join("roles", "+").alias("roles"))
