"""Invariants over derived reviews, some rows of which are broken on purpose."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import finance as fin
from ..operators import invariants as iv
from ..operators import retrieval as rt
from .registry import query
from .retrieval_queries import INDEX_SQL, chunk_table, scored
from .review_queries import EXPOSURES_SQL, GROUND_SQL, exposures, grounded


def eligibility_rows(spark, sf):
    g, k = grounded(spark, sf), F.col("clause")
    return g.select(
        F.concat("rule", F.lit("-"), k.cast("string")).alias("signal"), F.when(k % 43 == 1, "X1").otherwise(F.col("category")).alias("category"), F.size("evidence_ids").cast("long").alias("n_evidence"),
        F.col("practice_reference").cast("int").alias("n_practice"), (F.col("score_eligible") | (k % 41 == 1)).alias("score_eligible"), (F.col("practice_reference") & (k % 37 != 1)).alias("practice_reference"),
        (F.col("contribution") + F.when(k % 31 == 1, 0.5).otherwise(0.0)).alias("contribution"),
    )


@query(f"""
WITH {GROUND_SQL}, e AS (SELECT rule || '-' || clause AS signal, CASE WHEN clause % 43 = 1 THEN 'X1' ELSE category END AS category, n_evidence, practice_reference AS p, score_eligible OR clause % 41 = 1 AS se, practice_reference AND clause % 37 <> 1 AS pr, contribution + CASE WHEN clause % 31 = 1 THEN 0.5 ELSE 0 END AS c FROM gr)
SELECT signal, 'eligible_iff_grounded' AS violation FROM e WHERE se <> (n_evidence > 0 AND category <> 'X1') UNION ALL SELECT signal, 'not_eligible_contributes' FROM e WHERE NOT se AND c <> 0 UNION ALL SELECT signal, 'practice_not_marked' FROM e WHERE p AND n_evidence = 0 AND NOT se AND NOT pr
""")
def eligibility_violations(spark, sf):
    return iv.eligibility_gate().checked(eligibility_rows(spark, sf), "signal")[0]


def widened_rows(spark, sf):
    e, k = exposures(spark, sf), F.col("doc")
    plain = fin.triple(F.col("low"), F.col("base"), F.col("high"))
    wide = fin.fim8_widen(plain, k % 4, 0.1)
    return e.select(
        F.concat(k.cast("string"), F.lit("/"), "fim_module").alias("exposure"), F.when(k % 53 != 1, F.col("exposure_type")).alias("exposure_type"), F.when(k % 47 == 1, wide["high"] + 1).otherwise(wide["low"]).alias("low"),
        (wide["base"] + F.when(k % 59 == 1, 1.0).otherwise(0.0)).alias("base"), wide["high"].alias("high"), (F.col("user_input_required") | (k % 61 == 1)).alias("user_input_required"),
        *(F.col(c).alias(f"plain_{c}") for c in ("low", "base", "high")),
    )


@query(f"""
WITH {EXPOSURES_SQL}, w AS (SELECT doc || '/' || m AS exposure, CASE WHEN doc % 53 <> 1 THEN t END AS t, CASE WHEN NOT blank THEN CASE WHEN doc % 47 = 1 THEN v * 2 * (1 + doc % 4 * 0.1::DOUBLE) + 1 ELSE v * 0.5 / (1 + doc % 4 * 0.1::DOUBLE) END END AS lo,
  CASE WHEN NOT blank THEN v + CASE WHEN doc % 59 = 1 THEN 1 ELSE 0 END END AS ba, CASE WHEN NOT blank THEN v * 2 * (1 + doc % 4 * 0.1::DOUBLE) END AS hi, blank OR doc % 61 = 1 AS uir, CASE WHEN NOT blank THEN v * 0.5 END AS plo, CASE WHEN NOT blank THEN v END AS pba, CASE WHEN NOT blank THEN v * 2 END AS phi FROM xp)
SELECT exposure, 'type_missing' AS violation FROM w WHERE t IS NULL UNION ALL SELECT exposure, 'range_not_ordered' FROM w WHERE lo > ba OR ba > hi UNION ALL SELECT exposure, 'base_moved' FROM w WHERE ba IS DISTINCT FROM pba
UNION ALL SELECT exposure, 'band_narrowed' FROM w WHERE lo > plo OR hi < phi UNION ALL SELECT exposure, 'blank_with_amounts' FROM w WHERE uir AND (lo IS NOT NULL OR ba IS NOT NULL OR hi IS NOT NULL) UNION ALL SELECT exposure, 'amounts_lack' FROM w WHERE NOT uir AND lo IS NULL AND ba IS NULL AND hi IS NULL
""")
def exposure_violations(spark, sf):
    return iv.exposure_gate().checked(widened_rows(spark, sf), "exposure")[0]


@query(f"""
WITH {INDEX_SQL}, r AS (SELECT query_id, chunk_id, grp, tier, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s JOIN c USING (chunk_id)),
u AS (SELECT query_id, chunk_id, CASE WHEN tier LIKE 'A%' THEN 'grounding' ELSE 'explanation' END AS use_, tier, CASE WHEN chunk_id % 5 <> 1 THEN 'verified' ELSE ' ' END AS vs, tier LIKE 'A%' OR chunk_id % 7 = 1 AS se FROM r WHERE rank <= 5)
SELECT query_id, chunk_id, 'tag_missing' AS violation FROM u WHERE vs = ' ' UNION ALL SELECT query_id, chunk_id, 'explanation_scores' FROM u WHERE use_ = 'explanation' AND se
""")
def authority_tag_violations(spark, sf):
    hits = rt.top_k(scored(spark, sf, chunk_table(spark, sf).select("chunk_id", "authority_tier", "canonical_id")), 5)
    official = F.col("authority_tier").startswith("A")
    rows = hits.select(
        F.struct("query_id", "chunk_id").alias("row"), F.when(official, "grounding").otherwise("explanation").alias("use"), F.col("canonical_id").alias("source_id"), "authority_tier",
        F.when(F.col("chunk_id") % 5 != 1, "verified").otherwise(" ").alias("verification_status"), (official | (F.col("chunk_id") % 7 == 1)).alias("score_eligible"),
    )
    return iv.tag_gate().checked(rows, "row")[0].select("row.query_id", "row.chunk_id", "violation")


@query(f"""
WITH {INDEX_SQL}, r AS (SELECT query_id, chunk_id, grp, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s JOIN c USING (chunk_id)), tp AS (SELECT * FROM r WHERE rank <= 2),
g AS (SELECT DISTINCT query_id, grp FROM tp WHERE grp <> '')
SELECT query_id, g.grp AS conflict_group, c.chunk_id FROM g JOIN c USING (grp) ANTI JOIN tp ON tp.query_id = g.query_id AND tp.chunk_id = c.chunk_id
""")
def lost_conflict_members(spark, sf):
    """Members of a conflict group that a plain list of the best two leaves behind."""
    chunks = chunk_table(spark, sf)
    return iv.lost_conflict_members(rt.top_k(scored(spark, sf), 2), chunks, ["query_id"])


@query(f"""
WITH {INDEX_SQL}, h AS (SELECT query_id, source, lang = 'en' AS en, chunk_id, score FROM s JOIN c USING (chunk_id)), b AS (SELECT query_id, en, source, max(score) AS m, arg_max(chunk_id, score * 1e9 - chunk_id) AS chunk_id FROM h GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id, en ORDER BY m DESC, source) AS r FROM b), tp AS (SELECT * FROM k WHERE r <= 2), x AS (SELECT query_id, coalesce(max(source) FILTER (NOT en AND r = 1), max(source) FILTER (r = 1)) AS target FROM tp GROUP BY query_id)
SELECT query_id, target AS canonical_id, count(tp.chunk_id) FILTER (source = target) AS hits, coalesce(bool_and(chunk_id % 3 <> 0) FILTER (source = target), false) AS caveat_present, coalesce(bool_or(chunk_id % 4 <> 0) FILTER (en), false) AS label_violation FROM x JOIN tp USING (query_id) GROUP BY ALL
""")
def koen_caveats(spark, sf):
    """Of each query's best two sources on either side: whether all hits of the target have their
    caveat (every third chunk lacks it), and whether an English hit isn't marked as a translation."""
    hits = scored(spark, sf, chunk_table(spark, sf).select("chunk_id", (F.col("lang") == "en").alias("en"), "canonical_id"))
    rows = hits.withColumns({"caveat": F.when(F.col("chunk_id") % 3 != 0, "not equivalent").otherwise(" "), "translated": F.col("chunk_id") % 4 == 0})
    return rt.caveat_coverage(rows, 2)
