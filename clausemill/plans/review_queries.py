"""Review queries: clauses, terms, signals, scores and rankings.

The driver's tables hold no contract text, so clause texts are derived: an order's clause is a
phrase picked by its key, its document is the customer, its records are its lines' parts.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..dims import HEADS, PHRASES, RULES, SHORT
from ..functions import text as tx
from ..operators import extract as ex
from ..operators import highlights as hl
from ..operators import matching as mt
from ..operators import scoring as sc
from ..operators import segment as sg
from ..operators import selection as sl
from ..operators import signals as sn
from ..sources.readers import read_table
from .registry import query


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def clauses(spark, sf):
    """(doc, clause, text): two neighbouring phrases for each order."""
    pick = lambda k: F.element_at(F.array(*map(F.lit, PHRASES)), (k % len(PHRASES) + 1).cast("int"))
    k = F.col("o_orderkey")
    text = F.when(k % 3 == 0, F.concat_ws(" ", pick(k), pick(k * 5 + 1))).otherwise(pick(k))
    return read_table(spark, sf, "orders").select(F.col("o_custkey").alias("doc"), k.alias("clause"), text.alias("text"))


def records(spark, sf):
    """(clause, record_id, category, record_type, tier): an order's parts, both tables of any size."""
    k = F.col("p_partkey")
    tier = F.element_at(F.array(*map(F.lit, ("A0", "A1", "A2", "B", "C"))), F.col("p_size") % 5 + 1)
    parts = read_table(spark, sf, "part").select(k.alias("l_partkey"), F.element_at(F.array(*map(F.lit, SHORT)), (k % 9 + 1).cast("int")).alias("category"), tier.alias("tier"))
    lines = read_table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("clause"), "l_partkey")
    return lines.join(parts.hint("merge"), "l_partkey").select("clause", F.col("l_partkey").alias("record_id"), "category", F.when(F.col("tier").startswith("A"), "evidence").otherwise("practice").alias("record_type"), "tier")


def grounded(spark, sf):
    s = sn.rule_signals(clauses(spark, sf), ["doc", "clause"])
    return sn.ground(s, records(spark, sf), ["doc", "clause"], "clause").withColumn("contribution", sn.contribution())


_RULE_ROWS = ", ".join(f"({_q(r)}, {_q(c)}, {_q(k)}, {_q(t)}, {_q(p) if p else 'NULL'}, {s}, {f})" for r, c, k, t, p, s, f in RULES)
_PHRASES = "[" + ", ".join(map(_q, PHRASES)) + "]"
CLAUSES_SQL = f"""
ph AS (SELECT {_PHRASES} AS p),
cl AS (SELECT o_custkey AS doc, o_orderkey AS clause, CASE WHEN o_orderkey % 3 = 0 THEN p[1 + o_orderkey % {len(PHRASES)}] || ' ' || p[1 + (o_orderkey * 5 + 1) % {len(PHRASES)}] ELSE p[1 + o_orderkey % {len(PHRASES)}] END AS text FROM orders, ph),
rules(rule, category, kind, topic, protection, severity, confidence) AS (VALUES {_RULE_ROWS}),
txt AS (SELECT DISTINCT text FROM cl),
fired AS (SELECT text, rule, category, kind, CAST(severity AS DOUBLE) AS severity, CAST(confidence AS DOUBLE) AS confidence FROM txt, rules WHERE regexp_matches(text, topic) AND (kind = 'presence' OR NOT regexp_matches(text, protection))),
sig AS (SELECT doc, clause, rule, category, kind, severity, confidence FROM cl JOIN fired USING (text))
"""
GROUND_SQL = CLAUSES_SQL + """,
rec AS (SELECT l_orderkey AS clause, l_partkey AS record_id, ['F1','F2','F3','F4','F5','F6','F7','F8','F9'][1 + p_partkey % 9] AS category, ['A0','A1','A2','B','C'][1 + p_size % 5] AS tier FROM lineitem JOIN part ON p_partkey = l_partkey),
fold AS (SELECT clause, category, min(tier) FILTER (tier LIKE 'A%') AS best_tier, count(DISTINCT record_id) FILTER (tier LIKE 'A%') AS n_evidence, bool_or(tier IN ('B', 'C')) AS practice FROM rec GROUP BY ALL),
gr AS (SELECT s.*, best_tier, coalesce(n_evidence, 0) AS n_evidence, coalesce(n_evidence, 0) > 0 AS score_eligible, coalesce(n_evidence, 0) = 0 AND coalesce(practice, false) AS practice_reference,
       round(CASE WHEN coalesce(n_evidence, 0) > 0 THEN severity * CASE best_tier WHEN 'A0' THEN 1.0 WHEN 'A1' THEN 0.9 ELSE 0.8 END * least(1.0, greatest(confidence, 0.5)) ELSE 0 END, 9) AS contribution
       FROM sig s LEFT JOIN fold USING (clause, category))
"""
SCORES_SQL = GROUND_SQL + """,
tot AS (SELECT doc, category, sum(contribution) AS t FROM gr GROUP BY ALL),
cs AS (SELECT d.doc, c.category, coalesce(t, 0) AS t, least(100, greatest(0, 100 * (1 - exp(-coalesce(t, 0) / 1.5)))) AS s FROM (SELECT DISTINCT doc FROM gr) d CROSS JOIN (SELECT unnest(['F1','F2','F3','F4','F5','F6','F7','F8','F9']) AS category) c LEFT JOIN tot ON tot.doc = d.doc AND tot.category = c.category)
"""


@query(f"WITH {CLAUSES_SQL} SELECT doc, clause, rule, severity, confidence FROM sig WHERE kind = 'presence'")
def rule_signals_presence(spark, sf):
    return sn.rule_signals(clauses(spark, sf), ["doc", "clause"]).filter("kind = 'presence'").select("doc", "clause", "rule", "severity", "confidence")


@query(f"WITH {CLAUSES_SQL} SELECT doc, clause, rule, severity, confidence FROM sig WHERE kind = 'missing_protection'")
def rule_signals_missing(spark, sf):
    """By a theta join with a rule table."""
    rules = spark.createDataFrame(RULES, "rule string, category string, kind string, topic string, protection string, severity double, confidence double")
    return sn.rule_table_signals(clauses(spark, sf), ["doc", "clause"], rules).filter("kind = 'missing_protection'").select("doc", "clause", "rule", "severity", "confidence")


def _head_sql() -> str:
    def count(patterns):
        return "(" + " + ".join(f"CAST(regexp_matches(text, {_q(p)}) AS INTEGER)" for p in patterns) + ")"

    return " UNION ALL ".join(f"SELECT text, {_q(c)} AS category, CAST({s} AS DOUBLE) AS severity, {count(r)} AS h, {count(p)} AS g FROM txt" for c, r, p, s in HEADS)


HEADS_SQL = CLAUSES_SQL + f", hd AS ({_head_sql()}), hs AS (SELECT text, category, severity, round(least(1.0::DOUBLE, 0.52::DOUBLE + 0.14::DOUBLE * h - 0.3::DOUBLE * g), 6) AS confidence FROM hd WHERE h >= 1 AND 0.52::DOUBLE + 0.14::DOUBLE * h - 0.3::DOUBLE * g >= 0.5)"


@query(f"WITH {HEADS_SQL} SELECT doc, clause, category, severity, confidence FROM cl JOIN hs USING (text)")
def model_head_signals(spark, sf):
    return sn.head_signals(clauses(spark, sf), ["doc", "clause"])


@query(f"""
WITH {HEADS_SQL}, u AS (SELECT doc, clause, category, severity, confidence, kind = 'missing_protection' AS missing, 'rule' AS detector FROM sig UNION ALL SELECT doc, clause, category, severity, confidence, false, 'model' FROM cl JOIN hs USING (text))
SELECT doc, clause, category, max(severity) AS severity, round(1 - product(1 - confidence), 6) AS confidence, bool_or(missing) AS missing, array_to_string(list_sort(list(DISTINCT detector)), '+') AS detector, count(*) AS merged FROM u GROUP BY ALL
""")
def hybrid_merge_noisy_or(spark, sf):
    c, keys = clauses(spark, sf), ["doc", "clause"]
    return sn.hybrid_merge(sn.rule_signals(c, keys), sn.head_signals(c, keys), keys)


@query(f"WITH {GROUND_SQL} SELECT doc, clause, rule, n_evidence, best_tier, score_eligible, practice_reference FROM gr")
def authority_gate(spark, sf):
    return grounded(spark, sf).select("doc", "clause", "rule", F.size("evidence_ids").cast("long").alias("n_evidence"), "best_tier", "score_eligible", "practice_reference")


@query(f"WITH {GROUND_SQL} SELECT doc, clause, rule, contribution FROM gr")
def signal_contribution(spark, sf):
    return grounded(spark, sf).select("doc", "clause", "rule", "contribution")


@query(f"WITH {SCORES_SQL} SELECT doc, category, round(t, 6) AS total, round(s, 6) AS score FROM cs")
def category_scores(spark, sf):
    return sc.category_scores(grounded(spark, sf), ["doc"])


@query(f"WITH {SCORES_SQL} SELECT doc, CAST(round_even(round(avg(round(s, 6)), 9), 0) AS INTEGER) AS review_priority, round(max(s), 6) AS top_score FROM cs GROUP BY doc")
def document_priority(spark, sf):
    return sc.priority(sc.category_scores(grounded(spark, sf), ["doc"]), ["doc"])


@query(f"WITH {GROUND_SQL} SELECT doc, clause, category, round(sum(contribution), 6) AS total, round(100 * (1 - exp(-sum(contribution) / 1.5)), 6) AS score FROM gr GROUP BY ALL HAVING sum(contribution) > 0")
def clause_assessments(spark, sf):
    """The same scores at the grain of clauses, where there is a contribution."""
    return sc.category_scores(grounded(spark, sf), ["doc", "clause"]).filter("total > 0")


_FLAGS = "fl AS (SELECT c_custkey AS doc, coalesce(n, 0) % 5 AS n_flags FROM customer LEFT JOIN (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'error' OR value > 50 GROUP BY 1) ON user_id = c_custkey)"


@query(f"""
WITH {GROUND_SQL}, {_FLAGS}, a AS (SELECT doc, avg(confidence) AS r, avg(CAST(score_eligible AS INTEGER)) AS d FROM gr GROUP BY doc),
b AS (SELECT doc, coalesce(r, 1.0) AS r, least(1.0, 0.75 * coalesce(d, 1.0)) AS e, 1 - least(1.0, n_flags * 0.1) AS c FROM fl LEFT JOIN a USING (doc))
SELECT doc, round(r + 1e-9, 6) AS reading, round(e + 1e-9, 6) AS evidence, round(c + 1e-9, 6) AS completeness, round(pow(r, 0.3) * pow(e, 0.4) * pow(c, 0.3) + 1e-9, 6) AS overall FROM b
""")
def confidence_breakdown(spark, sf):
    """Shifted by 1e-9 before rounding, so that sums in another order don't tip halves."""
    out = sc.confidence_breakdown(grounded(spark, sf), flags(spark, sf), "doc", 12)
    return out.select("doc", *(F.round(F.col(c) + 1e-9, 6).alias(c) for c in out.columns if c != "doc"))


def flags(spark, sf):
    counts = read_table(spark, sf, "events").filter("event_type = 'error' OR value > 50").groupBy(F.col("user_id").alias("doc")).agg(F.count("*").alias("n"))
    return read_table(spark, sf, "customer").select(F.col("c_custkey").alias("doc")).join(counts, "doc", "left").select("doc", (F.coalesce("n", F.lit(0)) % 5).alias("n_flags"))


@query("""SELECT c_custkey AS doc, round(CASE WHEN c_custkey % 2 = 0 THEN 0.1 ELSE 0 END + CASE WHEN c_custkey % 3 = 0 THEN 0.2 ELSE 0 END, 6) AS penalty FROM customer""")
def missing_input_penalty(spark, sf):
    k = F.col("c_custkey")
    found = F.array_compact(F.array(F.when(k % 2 == 0, F.lit("advance")), F.when(k % 3 == 0, F.lit("rate"))))
    return read_table(spark, sf, "customer").select(k.alias("doc"), F.round(sc.flag_penalty(found, {"advance": 0.1, "rate": 0.2}), 6).alias("penalty"))


def exposures(spark, sf):
    """(doc, fim_module, exposure_type, low, base, high, nominal, user_input_required, flags) of customers."""
    k, m = F.col("c_custkey"), F.round(F.abs("c_acctbal"), 2)
    kinds = (("FIM-1", "revenue_leakage", 0), ("FIM-2", "present_value_loss", 1), ("FIM-3", "cashflow_deferral", 2), ("FIM-7", "liability_exposure", 3), ("FIM-5", "opportunity_cost", 4), ("FIM-4", "present_value_loss", 5), ("FIM-6", "revenue_leakage", 6))
    none = F.lit(None).cast("double")

    def one(module, kind, i):
        blank = (k + i) % 4 == 0
        amount = lambda f: F.when(blank, none).otherwise(m * f)
        return F.struct(
            F.lit(module).alias("fim_module"), F.lit(kind).alias("exposure_type"), amount(0.5).alias("low"), amount(1.0).alias("base"), amount(2.0).alias("high"), F.when((k + i) % 8 == 0, m).alias("nominal"),
            blank.alias("user_input_required"), F.when((k % 10 == 0) & F.lit(kind == "liability_exposure"), F.array(F.lit("uncapped"))).otherwise(F.array().cast("array<string>")).alias("flags"),
        )

    return read_table(spark, sf, "customer").select(k.alias("doc"), F.inline(F.array(*(one(*x) for x in kinds))))


EXPOSURES_SQL = GROUND_SQL + """,
kd(m, t, i) AS (VALUES ('FIM-1', 'revenue_leakage', 0), ('FIM-2', 'present_value_loss', 1), ('FIM-3', 'cashflow_deferral', 2), ('FIM-7', 'liability_exposure', 3), ('FIM-5', 'opportunity_cost', 4), ('FIM-4', 'present_value_loss', 5), ('FIM-6', 'revenue_leakage', 6)),
xp AS (SELECT c_custkey AS doc, m, t, (c_custkey + i) % 4 = 0 AS blank, round(abs(c_acctbal), 2) AS v, CASE WHEN (c_custkey + i) % 8 = 0 THEN round(abs(c_acctbal), 2) END AS nominal, c_custkey % 10 = 0 AND t = 'liability_exposure' AS unb FROM customer, kd),
mp(category, m, t) AS (VALUES ('F1','FIM-1','revenue_leakage'), ('F2','FIM-1','revenue_leakage'), ('F3','FIM-2','present_value_loss'), ('F4','FIM-3','cashflow_deferral'), ('F5','FIM-6','opportunity_cost'), ('F6','FIM-5','opportunity_cost'), ('F7','FIM-7','liability_exposure'), ('F8','FIM-4','revenue_leakage'), ('F9','FIM-8',NULL)),
f0 AS (SELECT g.*, mp.m, mp.t, x.doc IS NOT NULL AS has, x.t AS xt, x.blank, x.v, x.nominal, coalesce(x.unb, false) AS unb FROM gr g JOIN mp USING (category) LEFT JOIN xp x ON x.doc = g.doc AND x.m = mp.m AND mp.t IS NOT NULL),
f1 AS (SELECT *, CASE WHEN t IS NULL THEN 'not_applicable' WHEN NOT has THEN 'input_required' WHEN unb THEN 'unbounded' WHEN NOT blank THEN 'quantified' WHEN nominal IS NOT NULL THEN 'partially_bounded' WHEN blank THEN 'input_required' ELSE 'not_applicable' END AS quantification FROM f0),
f2 AS (SELECT *, contribution > 0 AS scored, CASE WHEN quantification = 'quantified' THEN CASE WHEN v <> 0 THEN 2 * v ELSE 0.5 * v END WHEN quantification = 'partially_bounded' THEN nominal END AS amount FROM f1)
"""


def _rank_sql(scored: str, order: str) -> str:
    basis = f"""CASE WHEN NOT ({scored}) THEN 'unverified_candidate' WHEN quantification = 'unbounded' THEN 'uncapped_or_unbounded' WHEN has AND xt = 'present_value_loss' THEN 'present_value_timing'
      WHEN quantification IN ('quantified', 'partially_bounded') THEN 'quantified_exposure' WHEN category IN ('F1', 'F9') THEN 'counterparty_verification' ELSE 'grounded_qualitative_signal' END"""
    keys = {
        "exposure": "list_position(['uncapped_or_unbounded', 'quantified_exposure', 'counterparty_verification', 'grounded_qualitative_signal', 'unverified_candidate'], CASE basis WHEN 'present_value_timing' THEN 'quantified_exposure' ELSE basis END), "
        "CASE quantification WHEN 'quantified' THEN 0 WHEN 'unbounded' THEN 0 WHEN 'partially_bounded' THEN 1 WHEN 'input_required' THEN 2 ELSE 3 END, "
        "coalesce(list_position(['liability_exposure', 'revenue_leakage', 'present_value_loss', 'opportunity_cost', 'cashflow_deferral'], t), 6), coalesce(nullif(amount, 0), nominal, 0) DESC, severity DESC, rule, clause",
        "severity": "severity * confidence DESC, rule, clause",
    }[order]
    return f"WITH {EXPOSURES_SQL}, f3 AS (SELECT *, {basis} AS basis FROM f2) SELECT doc, clause, rule AS signal_id, category, basis, quantification, round(amount, 2) AS amount, row_number() OVER (PARTITION BY doc ORDER BY {keys}) AS rank FROM f3"


def _signals(spark, sf):
    return grounded(spark, sf).select("doc", F.col("clause").alias("clause_id"), F.col("rule").alias("signal_id"), "category", "severity", "confidence", "contribution")


def _ranked(spark, sf, **how):
    return sc.rank_findings(_signals(spark, sf), exposures(spark, sf), "doc", **how).withColumnRenamed("clause_id", "clause")


@query(_rank_sql("scored", "exposure"))
def rank_exposure_aware(spark, sf):
    return _ranked(spark, sf)


@query(_rank_sql("scored", "severity"))
def rank_severity_baseline(spark, sf):
    return _ranked(spark, sf, policy="severity_baseline")


_ARM = "SELECT '{arm}' AS arm, basis, count(*) AS findings, count(*) FILTER (rank <= 3) AS top3 FROM ({sql}) GROUP BY ALL"


@query(" UNION ALL ".join(_ARM.format(arm=f"{p}/{g}", sql=_rank_sql("scored" if g == "enforced" else "true", o)) for p, o in (("exposure_aware", "exposure"), ("severity_baseline", "severity")) for g in ("enforced", "bypass")))
def ablation_four_arms(spark, sf):
    """Both policies with and without the authority gate."""
    arms = [(p, g) for p in ("exposure_aware", "severity_baseline") for g in ("enforced", "bypass")]
    out = sc.rank_arms(_signals(spark, sf), exposures(spark, sf), "doc", arms)
    return out.groupBy("arm", "basis").agg(F.count("*").alias("findings"), F.count_if(F.col("rank") <= 3).alias("top3"))


_COUNTS = "ct AS (SELECT o_custkey AS doc, count(*) AS pages, count(*) FILTER (o_orderstatus = 'P') AS corrections, count(*) FILTER (o_totalprice > 200000) AS flagged FROM orders GROUP BY 1)"


@query(f"WITH {_COUNTS}, {_FLAGS} SELECT doc, CAST(5 + 2 * pages + corrections + 3 * flagged + 2 * n_flags AS DOUBLE) AS minutes FROM ct JOIN fl USING (doc)")
def review_minutes(spark, sf):
    c = _counts(spark, sf).join(flags(spark, sf), "doc")
    return c.select("doc", sc.review_minutes(F.col("pages"), F.col("corrections"), F.col("flagged"), F.col("n_flags")).alias("minutes"))


def _counts(spark, sf):
    return read_table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("doc")).agg(F.count("*").alias("pages"), F.count_if(F.col("o_orderstatus") == "P").alias("corrections"), F.count_if(F.col("o_totalprice") > 200000).alias("flagged"))


@query(f"""
WITH {SCORES_SQL}, pr AS (SELECT doc, CAST(round_even(round(avg(round(s, 6)), 9), 0) AS INTEGER) AS p FROM cs GROUP BY doc), ha AS (SELECT doc, bool_or(category IN ('F5', 'F7')) AS f FROM gr GROUP BY doc)
SELECT doc, p AS review_priority, CASE WHEN f AND doc % 4 = 0 OR p >= 70 THEN 'professional_review' WHEN doc % 5 = 0 OR p >= 35 THEN 'negotiation_required' WHEN doc % 7 = 0 OR doc % 60 >= 30 THEN 'dispute_preparation' ELSE 'clarification' END AS pathway FROM pr JOIN ha USING (doc)
""")
def pathway_label(spark, sf):
    g = grounded(spark, sf)
    p = sc.priority(sc.category_scores(g, ["doc"]), ["doc"]).join(g.groupBy("doc").agg(F.bool_or(F.col("category").isin("F5", "F7")).alias("f")), "doc")
    d = F.col("doc")
    return p.select("doc", "review_priority", sc.pathway(F.col("review_priority"), F.col("f") & (d % 4 == 0), d % 5 == 0, d % 7 == 0, d % 60).alias("pathway"))


@query(f"""
WITH {CLAUSES_SQL}, d AS (SELECT p_partkey AS id, ['A0', 'A1', 'A2', 'B', 'C'][1 + p_size % 5] AS tier, lower(p_name || ' ' || p_type || ' ' || p_brand) AS t FROM part),
k AS (SELECT id, tier, t, unnest(regexp_extract_all(t, '[a-z0-9]+')) AS term FROM d), p AS (SELECT id, tier, t, term, count(*) AS tf FROM k GROUP BY ALL), l AS (SELECT id, count(*) AS l FROM k GROUP BY id),
n AS (SELECT count(*) AS n, (SELECT count(*) FROM k) / count(*) AS av FROM d), f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
q(rule, term) AS (VALUES ('V1', 'red'), ('V1', 'widget'), ('V2', 'blue'), ('V2', 'economy'), ('V3', 'gear')),
s AS (SELECT rule, id, t, tier, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * l / av))), 9) AS score FROM q JOIN f USING (term) JOIN p USING (term) JOIN l USING (id) CROSS JOIN n GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY rule ORDER BY score DESC, tier, id) AS r FROM s WHERE tier IN ('B', 'C')),
h AS (SELECT *, row_number() OVER (PARTITION BY rule ORDER BY r) AS n FROM r WHERE r <= 12 AND (rule = 'V1' AND (contains(t, 'widget') OR contains(t, 'small')) OR rule = 'V2' AND contains(t, 'brand#1') OR rule = 'V3' AND contains(t, 'no such marker'))),
li AS (SELECT rule, string_agg(CAST(id AS VARCHAR), ',' ORDER BY n) AS support_ids FROM h WHERE n <= 3 GROUP BY rule)
SELECT doc, clause, rule, support_ids, 0.0::DOUBLE AS contribution FROM (SELECT doc, clause, 'V1' AS rule FROM cl WHERE regexp_matches(text, '(?i)advance|선급금') UNION ALL SELECT doc, clause, 'V2' FROM cl WHERE regexp_matches(text, '(?i)payment') UNION ALL SELECT doc, clause, 'V3' FROM cl WHERE regexp_matches(text, '(?i)payment')) JOIN li USING (rule)
""")
def verification_signals(spark, sf):
    """Rules fire on clauses; each needs support among the 12 best practice chunks (here: parts) that hold one of its markers."""
    rules = (("V1", r"(?i)advance|선급금", "red widget", ("Widget", "small")), ("V2", r"(?i)payment", "blue economy", ("Brand#1",)), ("V3", r"(?i)payment", "gear", ("no such marker",)))
    tier = F.element_at(F.array(*map(F.lit, ("A0", "A1", "A2", "B", "C"))), F.col("p_size") % 5 + 1)
    chunks = read_table(spark, sf, "part").select(F.col("p_partkey").alias("chunk_id"), F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("text"), tier.alias("authority_tier"), F.lit("practice").alias("chunk_type"), F.array().cast("array<string>").alias("risk_categories"))
    out = sn.verification_signals(clauses(spark, sf), ["doc", "clause"], rules, chunks)
    return out.select("doc", "clause", "rule", F.array_join(F.transform("support_ids", lambda x: x.cast("string")), ",").alias("support_ids"), "contribution")


# --- segmentation --------------------------------------------------------------------------

LINES_SQL = r"""
ln AS (SELECT doc_id, unnest(l) AS text, unnest(generate_series(0, len(l) - 1)) AS line FROM (SELECT doc_id, list_filter(string_split_regex(text, '\r\n|[\n\r]'), lambda x: trim(x) <> '') AS l FROM documents)),
mk AS (SELECT doc_id, line, CASE WHEN line % 4 = 1 THEN (1 + line // 4) || '. ' || text WHEN line % 9 = 5 THEN 'Section ' || (1 + line // 9) || ' ' || text ELSE text END AS text FROM ln),
sg AS (SELECT *, regexp_matches(text, '^\s*([①-⑳]|\(\s*[0-9]+\s*\)|\(\s*[A-Za-z가-힣]\s*\)|[0-9]+(\.[0-9]+)*[.)]|[A-Za-z가-힣][.)])\s+') OR regexp_matches(text, '^\s*((?i:article|section|clause)\s+[0-9]+[A-Za-z0-9_.-]*)\b') AS m FROM mk),
cz AS (SELECT *, sum(CASE WHEN m AND line > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line) AS clause FROM sg)
"""


def marked_lines(spark, sf):
    """Lines of documents, some given a number or section mark by their place."""
    lines = sg.text_lines(read_table(spark, sf, "documents"))
    k = F.col("line")
    text = F.when(k % 4 == 1, F.concat(F.floor(k / 4) + 1, F.lit(". "), "text")).when(k % 9 == 5, F.concat(F.lit("Section "), F.floor(k / 9) + 1, F.lit(" "), "text")).otherwise(F.col("text"))
    return lines.withColumn("text", text)


@query(f"""
WITH {LINES_SQL}
SELECT doc_id, CAST(clause AS INTEGER) AS clause, CAST(min(line) AS INTEGER) AS first_line, CAST(count(*) AS INTEGER) AS n_lines, arg_min(m, line) AS marked, sha256(string_agg(text, chr(10) ORDER BY line)) AS digest, round(0.85 + 0.15 * CASE WHEN arg_min(m, line) THEN 1 ELSE 0.55 END, 6) AS seg_confidence
FROM cz GROUP BY doc_id, clause
""")
def clause_segmentation(spark, sf):
    return sg.clauses(marked_lines(spark, sf)).select("doc_id", "clause", "first_line", "n_lines", F.col("heading").isNotNull().alias("marked"), F.sha2("text", 256).alias("digest"), "seg_confidence")


@query(f"""
WITH {LINES_SQL}, p AS (SELECT DISTINCT doc_id, min(line) AS pos FROM cz WHERE clause > 0 GROUP BY doc_id, clause), g AS (SELECT doc_id, line AS pos FROM ln WHERE line % 4 = 1 AND line > 0), h AS (SELECT count(*) AS hit FROM p JOIN g USING (doc_id, pos)), c AS (SELECT (SELECT count(*) FROM g) AS gold, (SELECT count(*) FROM p) AS predicted, hit FROM h)
SELECT gold, predicted, hit, round(hit / predicted, 6) AS precision, round(hit / gold, 6) AS recall, round(2 * (hit / predicted) * (hit / gold) / (hit / predicted + hit / gold), 6) AS f1 FROM c
""")
def boundary_f1(spark, sf):
    lines = marked_lines(spark, sf)
    predicted = sg.clauses(lines).filter("clause > 0").select("doc_id", F.col("first_line").alias("position"))
    gold = lines.filter("line % 4 = 1 AND line > 0").select("doc_id", F.col("line").alias("position"))
    return sg.boundary_scores(gold, predicted)


@query("""
WITH RECURSIVE s AS (SELECT l_orderkey AS page, CAST(5 + 7 * l_linenumber AS INTEGER) AS x, min(l_returnflag) || l_linenumber AS t, 3.0::DOUBLE * max(l_quantity) + (8 + max(l_partkey % 10)) / 2.0::DOUBLE AS c, CAST(8 + max(l_partkey % 10) AS DOUBLE) AS h, 1 - min(l_discount) AS f FROM lineitem GROUP BY l_orderkey, l_linenumber),
o AS (SELECT page, list(struct_pack(c := c, x := x, h := h) ORDER BY c, x) AS l FROM s GROUP BY page),
r(page, l, i, cs, hs, ns, who) AS (
  SELECT page, l, 0, CAST([] AS DOUBLE[]), CAST([] AS DOUBLE[]), CAST([] AS INTEGER[]), CAST([] AS INTEGER[]) FROM o UNION ALL
  SELECT page, l, i + 1, CASE WHEN k IS NULL THEN list_append(cs, v.c) ELSE list_transform(cs, lambda y, j: CASE WHEN j = k THEN (y * ns[k] + v.c) / (ns[k] + 1) ELSE y END) END,
    CASE WHEN k IS NULL THEN list_append(hs, v.h) ELSE list_transform(hs, lambda y, j: CASE WHEN j = k THEN (y * ns[k] + v.h) / (ns[k] + 1) ELSE y END) END,
    CASE WHEN k IS NULL THEN list_append(ns, 1) ELSE list_transform(ns, lambda y, j: CASE WHEN j = k THEN y + 1 ELSE y END) END, list_append(who, CAST(coalesce(k, len(cs) + 1) AS INTEGER))
  FROM (SELECT *, l[i + 1] AS v, list_sort(list_filter(list_transform(cs, lambda y, j: CASE WHEN abs(y - l[i + 1].c) <= greatest(8.0, 0.65 * least(l[i + 1].h, hs[j])) THEN struct_pack(d := abs(y - l[i + 1].c), j := j) END), lambda z: z IS NOT NULL))[1].j AS k FROM r WHERE i < len(l))),
e AS (SELECT page, cs, hs, l[q].x AS x, who[q] AS g FROM (SELECT *, unnest(generate_series(1, len(l))) AS q FROM r WHERE i = len(l))),
m AS (SELECT page, g, any_value(cs[g]) AS c, any_value(hs[g]) AS h, string_agg(t, ' ' ORDER BY x) AS text, round(avg(f), 6) AS confidence FROM e JOIN s USING (page, x) GROUP BY page, g)
SELECT page, CAST(row_number() OVER (PARTITION BY page ORDER BY c, h, g) - 1 AS INTEGER) AS line, text, confidence FROM m
""")
def ocr_line_clustering(spark, sf):
    """An order is a page, its lines are spans; quantities are heights on the page."""
    lines = read_table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("t"), F.max("l_quantity").alias("q"), F.max(F.col("l_partkey") % 10).alias("p"), F.min("l_discount").alias("d"))
    spans = lines.select(
        F.col("l_orderkey").alias("page"), F.concat("t", F.col("l_linenumber").cast("string")).alias("text"), (5 + 7 * F.col("l_linenumber")).alias("x"),
        (3 * F.col("q")).alias("y"), (8 + F.col("p")).alias("h"), (1 - F.col("d")).alias("confidence"),
    )
    return sg.line_clusters(spans, ["page"])


@query(f"""
WITH RECURSIVE {LINES_SQL}, g AS (SELECT doc_id, list(line ORDER BY line) AS g FROM ln WHERE line % 5 = 2 GROUP BY doc_id), p AS (SELECT doc_id, list(pos ORDER BY pos) AS p FROM (SELECT doc_id, min(line) AS pos FROM cz WHERE clause > 0 GROUP BY doc_id, clause) GROUP BY doc_id),
b AS (SELECT doc_id, coalesce(g, CAST([] AS BIGINT[])) AS g, coalesce(p, CAST([] AS BIGINT[])) AS p FROM g FULL JOIN p USING (doc_id)),
r(doc_id, i, g, free, n) AS (SELECT doc_id, 0, g, p, 0 FROM b UNION ALL
  SELECT doc_id, i + 1, g, CASE WHEN best IS NULL THEN free ELSE list_filter(free, lambda x: x <> best) END, n + CASE WHEN best IS NULL THEN 0 ELSE 1 END
  FROM (SELECT *, list_sort(list_transform(list_filter(free, lambda x: abs(x - g[i + 1]) <= 2), lambda x: struct_pack(d := abs(x - g[i + 1]), p := x)))[1].p AS best FROM r WHERE i < len(g))),
c AS (SELECT doc_id, len(b.g) AS gold, len(p) AS predicted, n AS matched FROM b JOIN r USING (doc_id) WHERE i = len(r.g))
SELECT doc_id, gold, predicted, CAST(matched AS BIGINT) AS matched, round(CASE WHEN predicted > 0 THEN matched / predicted ELSE 0 END, 6) AS precision, round(CASE WHEN gold > 0 THEN matched / gold ELSE 0 END, 6) AS recall, round(CASE WHEN matched > 0 THEN 2 * matched / (gold + predicted) ELSE 0 END, 6) AS f1 FROM c
""")
def boundary_tolerance_matches(spark, sf):
    """Starts of clauses against every fifth line of a document, up to two lines off."""
    lines = marked_lines(spark, sf)
    predicted = sg.clauses(lines).filter("clause > 0").select("doc_id", F.col("first_line").alias("position"))
    return mt.boundary_report(lines.filter("line % 5 = 2").select("doc_id", F.col("line").alias("position")), predicted, "doc_id", 2)


#: Lists of checkpoints by category; neighbours share most of theirs.
_TOPICS = {f"F{c}": [f"K{c + j}" for j in range(6)] + ["common"] for c in range(1, 10)}


@query(f"""
WITH RECURSIVE {CLAUSES_SQL}, tp(category, keys) AS (VALUES {', '.join(f"({_q(c)}, {[k.casefold() for k in ks]})" for c, ks in _TOPICS.items())}),
f AS (SELECT doc, clause, rule, s.category, keys, row_number() OVER (PARTITION BY doc ORDER BY clause, rule) AS i FROM sig s JOIN tp ON tp.category = s.category),
r(doc, i, clause, rule, category, pick, seen) AS (
  SELECT doc, i, clause, rule, category, keys[1:3], keys[1:3] FROM f WHERE i = 1 UNION ALL
  SELECT doc, i, clause, rule, category, pick, list_concat(seen, pick) FROM (SELECT r.doc, f.i, f.clause, f.rule, f.category, r.seen, list_filter(f.keys, lambda k: NOT list_contains(r.seen, k))[1:3] AS pick FROM r JOIN f ON f.doc = r.doc AND f.i = r.i + 1))
SELECT doc, clause, rule, category, array_to_string(pick, '+') AS keys FROM r WHERE len(pick) > 0
""")
def shared_checkpoints(spark, sf):
    """Checkpoints of a document's findings in turn, none twice, from lists that overlap."""
    findings = sn.rule_signals(clauses(spark, sf), ["doc", "clause"]).select("doc", "clause", "rule", "category")
    return sl.curated_checkpoints(findings, _TOPICS, "doc", ["clause", "rule"]).withColumn("keys", F.array_join("keys", "+"))


# --- extraction ----------------------------------------------------------------------------


def sentences(spark, sf):
    """A derived sentence for each order, its values known from the columns."""
    k, price = F.col("o_orderkey"), F.floor("o_totalprice")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    days = 10 + k % 60
    text = F.concat(F.lit("총매출 "), price.cast("string"), F.lit("원 fee. The share is "), (k % 90 + 5).cast("string"), F.lit("% net. Payment within "), days.cast("string"), F.lit(" days, effective "), day, F.lit(". Term "), (k % 8 + 1).cast("string"), F.lit(" years."))
    return read_table(spark, sf, "orders").select(k.alias("order_key"), text.alias("text"))


def _terms(spark, sf, unit):
    t = ex.extract_terms(sentences(spark, sf), ["order_key"], units=(unit,))
    return t.select("order_key", "feature_id", F.col("value_norm").cast("double").alias("value"), "is_open_ended", "extraction_confidence")


@query("SELECT o_orderkey AS order_key, 'GROSS_SALES' AS feature_id, CAST(floor(o_totalprice) AS DOUBLE) AS value, false AS is_open_ended, 1.0::DOUBLE AS extraction_confidence FROM orders")
def extract_money(spark, sf):
    return _terms(spark, sf, "krw")


@query("SELECT o_orderkey AS order_key, 'REVENUE_SHARE_RATE' AS feature_id, CAST((o_orderkey % 90 + 5) / 100 AS DOUBLE) AS value, false AS is_open_ended, 1.0::DOUBLE AS extraction_confidence FROM orders")
def extract_percent(spark, sf):
    return _terms(spark, sf, "frac")


@query("SELECT o_orderkey AS order_key, 'PAYMENT_DUE_DATE' AS feature_id, CAST(strftime(o_orderdate, '%Y%m%d') AS DOUBLE) AS value, false AS is_open_ended, 1.0::DOUBLE AS extraction_confidence FROM orders")
def extract_date(spark, sf):
    return _terms(spark, sf, "none")


@query("""
SELECT o_orderkey AS order_key, 'PAYMENT_DUE_DAYS' AS feature_id, CAST(10 + o_orderkey % 60 AS DOUBLE) AS value, false AS is_open_ended, 1.0::DOUBLE AS extraction_confidence FROM orders
""")
def extract_days(spark, sf):
    return _terms(spark, sf, "days")


@query("SELECT o_orderkey AS order_key, 'CONTRACT_DURATION_MONTHS' AS feature_id, CAST(12 * (o_orderkey % 8 + 1) AS DOUBLE) AS value, false AS is_open_ended, 1.0::DOUBLE AS extraction_confidence FROM orders")
def extract_months(spark, sf):
    return _terms(spark, sf, "months")


_OPEN = [(1, "A fee of 100~200만원 applies."), (2, "approximately 30% of sales"), (3, "150% share"), (4, "additional processing fees apply"), (5, "2026년 13월 40일 계약"), (6, "2026년 7월 말 지급"), (7, "KRW 5,000원"), (8, "3 million won advance"), (9, "3-5 months renewal")]


@query(f"""
WITH t(id, position, feature_id, value, is_open_ended, extraction_confidence) AS (VALUES (1, 0, 'GROSS_SALES', NULL::DOUBLE, true, 0.85::DOUBLE), (2, 0, 'REVENUE_SHARE_RATE', NULL, true, 0.85), (3, 0, 'REVENUE_SHARE_RATE', NULL, true, 0.85), (4, 0, 'OPEN_ENDED_NUMERIC_TERMS', NULL, true, 0.75), (5, 0, 'CONTRACT_DATE', NULL, true, 0.95),
  (6, 0, 'PAYMENT_DUE_DATE', NULL, true, 0.85), (7, 0, 'GROSS_SALES', 5000, false, 1.0), (7, 1, 'GROSS_SALES', 5000, false, 1.0), (8, 0, 'ADVANCE_AMOUNT', 3000000, false, 1.0), (9, 0, 'RENEWAL_DURATION_MONTHS', NULL, true, 0.85))
SELECT o_orderkey AS order_key, position, feature_id, value, is_open_ended, extraction_confidence FROM orders JOIN t ON id = 1 + o_orderkey % {len(_OPEN)}
""")
def extract_open_ended(spark, sf):
    """One of some open-ended forms for each order."""
    k = F.col("o_orderkey")
    text = F.element_at(F.array(*(F.lit(x) for _, x in _OPEN)), (k % len(_OPEN) + 1).cast("int"))
    t = ex.extract_terms(read_table(spark, sf, "orders").select(k.alias("order_key"), text.alias("text")), ["order_key"])
    return t.select("order_key", "position", "feature_id", F.col("value_norm").cast("double").alias("value"), "is_open_ended", "extraction_confidence")


#: Forms of terms: text before and after a number v, feature, value as SQL of v, open-ended, confidence.
_FORMS = (
    ("Payment due March ", ", 2026", "PAYMENT_DUE_DATE", "20260300 + v", False, 1.0),
    ("Effective ", " March 2026", "EFFECTIVE_DATE", "20260300 + v", False, 1.0),
    ("Delivery of part ", " in June 2026", "CONTRACT_DATE", "NULL", True, 0.85),
    ("marketing ", "만원", "MARKETING_COST", "v * 10000", False, 1.0),
    ("결제 수수료 ", "%", "PAYMENT_PROCESSING_FEE", "v / 100", False, 1.0),
    ("MG ", ",000원", "MINIMUM_GUARANTEE", "v * 1000", False, 1.0),
    ("손해배상 한도 ", "억 원", "LIABILITY_CAP", "v * 100000000", False, 1.0),
    ("이차 권리 ", " percent", "SECONDARY_RIGHTS_SHARE", "v / 100", False, 1.0),
    ("수익 약 ", "%", "REVENUE_SHARE_RATE", "NULL", True, 0.85),
    ("Under clause ", " fees are charged as determined by the company", "OPEN_ENDED_NUMERIC_TERMS", "NULL", True, 0.75),
    ("고정금 ", "원", "FIXED_FEE", "v", False, 1.0),
    ("Gross sales ", ".5 million KRW", "GROSS_SALES", "v * 1000000 + 500000", False, 1.0),
    ("작가 몫 ", "%", "REVENUE_SHARE_RATE", "v / 100", False, 1.0),
    ("발효 2026.03.", "", "EFFECTIVE_DATE", "20260300 + v", False, 1.0),
    ("Notice ", " business days", "TERMINATION_NOTICE_DAYS", "v", False, 1.0),
    ("독점 ", "년", "EXCLUSIVITY_DURATION_MONTHS", "v * 12", False, 1.0),
    ("손해배상 ", "만 원 등", "PENALTY_AMOUNT", "NULL", True, 0.85),
    ("Late by ", "-40 days", "PAYMENT_DELAY_DAYS", "NULL", True, 0.85),
)
_FORMS_SQL = ", ".join(f"({k}, {_q(f)}, {str(o).lower()}, {c})" for k, (_, _, f, _, o, c) in enumerate(_FORMS))


@query(f"""
SELECT o_orderkey AS order_key, feature_id, CAST(CASE {' '.join(f'WHEN form = {k} THEN {value}' for k, (_, _, _, value, _, _) in enumerate(_FORMS))} END AS DOUBLE) AS value, is_open_ended, CAST(confidence AS DOUBLE) AS extraction_confidence
FROM (SELECT o_orderkey, o_orderkey % {len(_FORMS)} AS form, 10 + o_orderkey % 18 AS v FROM orders) JOIN (VALUES {_FORMS_SQL}) t(form, feature_id, is_open_ended, confidence) USING (form)
""")
def extract_forms(spark, sf):
    """One of many forms of terms for each order: month names, incomplete dates, units, contexts, vague values."""
    pick = lambda at: F.element_at(F.array(*(F.lit(f[at]) for f in _FORMS)), (F.col("o_orderkey") % len(_FORMS) + 1).cast("int"))
    text = F.concat(pick(0), (10 + F.col("o_orderkey") % 18).cast("string"), pick(1))
    t = ex.extract_terms(read_table(spark, sf, "orders").select(F.col("o_orderkey").alias("order_key"), text.alias("text")), ["order_key"])
    return t.select("order_key", "feature_id", F.col("value_norm").cast("double").alias("value"), "is_open_ended", "extraction_confidence")


def _percent_sql() -> str:
    """Percent terms of the texts of ``tx`` (doc_id, text): matches with offsets, ranges, features by
    the words near, open ends."""
    plain = lambda p: _q("(?i)" + p.replace(r"(?<![가-힣])약", "(?:^|[^가-힣])약"))  # noqa: E731  RE2 has no lookbehind
    families = [(f, p) for f in ("money_range", "percent_range", "time_range", "percent") for p in ex.SCANS[f]]
    rules = " ".join(f"WHEN regexp_matches(words, {plain(p)}) THEN {_q(name)}" for p, name in ex.RULES["percent"])
    return f"""
pt(family, p) AS (VALUES {", ".join(f"({_q(f)}, {plain(p)})" for f, p in families)}),
xm AS (SELECT doc_id, text, family, regexp_extract_all(text, p) AS m, string_split_regex(text, p) AS g FROM tx, pt WHERE regexp_matches(text, p)),
xi AS (SELECT doc_id, text, family, m[i] AS v, CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS s FROM (SELECT *, unnest(generate_series(1, len(m))) AS i FROM xm)),
xr AS (SELECT doc_id, s, s + length(v) AS e FROM xi WHERE family <> 'percent'),
xf AS (SELECT * FROM xi WHERE family = 'percent_range' OR family = 'percent' AND NOT EXISTS (SELECT 1 FROM xr WHERE xr.doc_id = xi.doc_id AND xi.s < xr.e AND xi.s + length(xi.v) > xr.s)),
xw AS (SELECT doc_id, s, family, substr(text, greatest(0, s - {ex.NEAR_FEATURE}) + 1, s + length(v) + {ex.NEAR_FEATURE} - greatest(0, s - {ex.NEAR_FEATURE})) AS words, substr(text, greatest(0, s - {ex.NEAR_OPEN}) + 1, s + length(v) + {ex.NEAR_OPEN} - greatest(0, s - {ex.NEAR_OPEN})) AS close,
  CAST(replace(regexp_extract(v, {_q(ex.NUMBER)}), ',', '') AS DOUBLE) / 100 AS value FROM xf),
xo AS (SELECT doc_id, s, CASE {rules} ELSE {_q(ex.DEFAULTS["percent"])} END AS feature_id, value, family = 'percent_range' OR value NOT BETWEEN 0 AND 1 OR regexp_matches(close, {plain(ex.OPEN_ENDED)}) AS is_open_ended FROM xw)
"""


@query(f"""
WITH tx AS (SELECT doc_id, coalesce(text, '') || chr(10) || repeat('=', 48) || ' Revenue share ' || (5 + doc_id % 90) || '%' AS text FROM documents), {_percent_sql()}
SELECT doc_id, CAST(s AS INTEGER) AS start, feature_id, CASE WHEN NOT is_open_ended THEN value END AS value, is_open_ended FROM xo
""")
def extract_document_terms(spark, sf):
    """Terms of all whole documents, each with one appended behind a rule.  The SQL finds percent
    terms; money, dates and durations don't occur in these texts, and it has no such terms."""
    rate = F.concat(F.lit("\n" + "=" * 48 + " Revenue share "), (5 + F.col("doc_id") % 90).cast("string"), F.lit("%"))
    docs = read_table(spark, sf, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), rate).alias("text"))
    return ex.extract_terms(docs, ["doc_id"]).select("doc_id", "start", "feature_id", F.col("value_norm").cast("double").alias("value"), "is_open_ended")


@query("""
WITH g AS (SELECT CASE WHEN l_linenumber % 2 = 0 THEN 'money' ELSE 'pct' END AS kind, CAST(l_quantity AS INTEGER) AS key FROM lineitem), p AS (SELECT CASE WHEN l_linenumber % 2 = 0 THEN 'money' ELSE 'pct' END AS kind, CAST(l_quantity AS INTEGER) + CASE WHEN l_orderkey % 10 = 0 THEN 1 ELSE 0 END AS key FROM lineitem WHERE l_orderkey % 11 <> 0),
a AS (SELECT kind, key, count(*) AS g FROM g GROUP BY ALL), b AS (SELECT kind, key, count(*) AS p FROM p GROUP BY ALL), c AS (SELECT kind, coalesce(g, 0) AS g, coalesce(p, 0) AS p FROM a FULL JOIN b USING (kind, key))
SELECT kind, CAST(sum(g) AS BIGINT) AS gold, CAST(sum(p) AS BIGINT) AS predicted, CAST(sum(least(g, p)) AS BIGINT) AS matched, round(sum(least(g, p)) / greatest(sum(g), sum(p)), 6) AS accuracy FROM c GROUP BY kind
""")
def exact_match_multiset(spark, sf):
    lines = read_table(spark, sf, "lineitem").select("l_orderkey", F.when(F.col("l_linenumber") % 2 == 0, "money").otherwise("pct").alias("kind"), F.col("l_quantity").cast("int").alias("key"))
    predicted = lines.filter("l_orderkey % 11 <> 0").withColumn("key", F.col("key") + F.when(F.col("l_orderkey") % 10 == 0, 1).otherwise(0))
    return ex.exact_matches(lines.select("kind", "key"), predicted.select("kind", "key"))


# --- highlights ----------------------------------------------------------------------------

_HL = "tx AS (SELECT o_orderkey AS doc, o_orderpriority || ' by ' || o_orderstatus || ' of ' || CAST(o_custkey AS VARCHAR) AS text FROM orders), rg AS (SELECT doc, s, e, label FROM tx, (VALUES (0, 5, 'amount'), (3, 9, 'party'), (3, 9, 'term'), (9, 12, 'party'), (0, 400, 'lost')) r(s, e, label) WHERE e <= length(text))"


def _highlight_input(spark, sf):
    texts = read_table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc"), F.concat("o_orderpriority", F.lit(" by "), "o_orderstatus", F.lit(" of "), F.col("o_custkey").cast("string")).alias("text"))
    spans = ((0, 5, "amount"), (3, 9, "party"), (3, 9, "term"), (9, 12, "party"), (0, 400, "lost"))
    ranges = texts.select("doc", F.inline(F.array(*(F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(c).alias("label")) for a, b, c in spans))))
    return texts, ranges


_SEG = f"WITH {_HL}, ct AS (SELECT doc, s AS cut FROM rg UNION SELECT doc, e FROM rg UNION SELECT doc, 0 FROM tx UNION SELECT doc, length(text) FROM tx), pt AS (SELECT doc, cut AS s, lead(cut) OVER (PARTITION BY doc ORDER BY cut) AS e FROM ct), sg AS (SELECT doc, pt.s, pt.e, coalesce((SELECT string_agg(DISTINCT label, '+' ORDER BY label) FROM rg WHERE rg.doc = pt.doc AND rg.s <= pt.s AND rg.e >= pt.e), '') AS labels FROM pt WHERE e IS NOT NULL)"


@query(f'{_SEG} SELECT doc, s AS start, e AS "end", labels FROM sg')
def highlight_segments(spark, sf):
    return hl.segments(*_highlight_input(spark, sf), "doc").withColumn("labels", F.array_join("labels", "+"))


@query(f"""{_SEG}, g AS (SELECT *, sum(ch) OVER (PARTITION BY doc ORDER BY s) AS i FROM (SELECT *, CASE WHEN lag(labels) OVER (PARTITION BY doc ORDER BY s) = labels THEN 0 ELSE 1 END AS ch FROM sg)) SELECT doc, min(s) AS start, max(e) AS "end", any_value(labels) AS labels FROM g GROUP BY doc, i""")
def merge_plain_segments(spark, sf):
    """Neighbours with equal labels become one.  The ranges hold the term label, as the SQL's do, and
    with it no neighbours agree as long as keys of orders don't repeat."""
    texts, ranges = _highlight_input(spark, sf)
    return hl.merge_equal(hl.segments(texts, ranges, "doc"), "doc").withColumn("labels", F.array_join("labels", "+"))


@query("""
WITH s AS (SELECT o_custkey AS doc, o_orderkey AS span, o_orderpriority AS text FROM orders)
SELECT doc, span, CAST(coalesce(sum(length(text) + 1) OVER (PARTITION BY doc ORDER BY span ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS "offset" FROM s
""")
def span_offsets(spark, sf):
    spans = read_table(spark, sf, "orders").select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("span"), F.col("o_orderpriority").alias("text"))
    return hl.span_offsets(spans, "doc").select("doc", "span", "offset")


@query("""
WITH c AS (SELECT l_orderkey AS k, max(struct_pack(n := l_linenumber, c := l_returnflag)).c AS c FROM lineitem WHERE l_linenumber > 1 GROUP BY 1) SELECT o_orderkey AS span_id, coalesce(c, o_orderstatus) AS text FROM orders LEFT JOIN c ON k = o_orderkey
""")
def span_corrections(spark, sf):
    """The latest correction of each span (of equal revisions the larger text), others as they were."""
    spans = read_table(spark, sf, "orders").select(F.col("o_orderkey").alias("span_id"), F.col("o_orderstatus").alias("text"))
    fixes = read_table(spark, sf, "lineitem").filter("l_linenumber > 1").select(F.col("l_orderkey").alias("span_id"), F.col("l_linenumber").alias("revision"), F.col("l_returnflag").alias("corrected_text"))
    return hl.apply_corrections(spans, fixes)


@query(f"WITH {CLAUSES_SQL} SELECT doc, clause, CASE WHEN regexp_matches(text, '[가-힣]') AND regexp_matches(text, '[A-Za-z]') THEN 'mixed' WHEN regexp_matches(text, '[가-힣]') THEN 'ko' ELSE 'en' END AS tag FROM cl")
def clause_languages(spark, sf):
    return clauses(spark, sf).select("doc", "clause", tx.language_tag(F.col("text")).alias("tag"))
