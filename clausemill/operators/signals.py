"""Risk signals: rules and model heads over clauses, grounding, the authority gate, the
hybrid merge and verification signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..dims import CONF_FLOOR, HEAD_BASE, HEAD_PROTECTION, HEAD_RISK, HEAD_THRESHOLD, HEADS, RULES, SEVERITY_WEIGHT, TIER_FACTOR
from ..functions.text import hit_count, tier_order
from . import retrieval as rt


def _fires(kind: str, topic: str, protection: str | None, text: Column) -> Column:
    hit = text.rlike(topic)
    return hit if kind == "presence" else hit & ~text.rlike(protection)


def rule_signals(clauses: DataFrame, keys: list[str], rules=RULES) -> DataFrame:
    """(keys, rule, category, kind, severity, confidence) of all rules that fire on a clause's
    text.  Rules are literals, so each clause is scanned once and nothing is joined."""
    text = F.col("text")
    found = [
        F.when(_fires(kind, topic, protection, text), F.struct(F.lit(rule).alias("rule"), F.lit(category).alias("category"), F.lit(kind).alias("kind"), F.lit(severity).alias("severity"), F.lit(confidence).alias("confidence")))
        for rule, category, kind, topic, protection, severity, confidence in rules
    ]
    return clauses.select(*keys, F.inline(F.array_compact(F.array(*found))))


def rule_table_signals(clauses: DataFrame, keys: list[str], rules: DataFrame) -> DataFrame:
    """The same with rules of a user's table (rule, category, kind, topic, protection, severity,
    confidence): a theta join.  Spark sends the smaller side of it to all tasks where it may be
    broadcast, and compares partition by partition otherwise."""
    hit = F.expr("text rlike topic") & (F.expr("kind = 'presence'") | ~F.coalesce(F.expr("text rlike protection"), F.lit(False)))
    return clauses.select(*keys, "text").join(rt.small(rules, 10_000), hit).select(*keys, "rule", "category", "kind", "severity", "confidence")


def head_signals(clauses: DataFrame, keys: list[str], heads=HEADS) -> DataFrame:
    """(keys, category, severity, confidence) of model heads with a risk hit and a score of at
    least the threshold; sums run in one fixed order, since scores meet the threshold exactly."""
    text, found = F.col("text"), []
    for category, risks, protections, severity in heads:
        hits = hit_count(text, risks)
        score = F.lit(HEAD_BASE) + F.lit(HEAD_RISK) * hits - F.lit(HEAD_PROTECTION) * hit_count(text, protections)
        fires = (hits >= 1) & (score >= HEAD_THRESHOLD)
        found.append(F.when(fires, F.struct(F.lit(category).alias("category"), F.lit(severity).alias("severity"), F.round(F.least(score, F.lit(1.0)), 6).alias("confidence"))))
    return clauses.select(*keys, F.inline(F.array_compact(F.array(*found))))


def short_category(category: Column) -> Column:
    """The short code of a category: all of it, or what stands before the first underscore."""
    return F.substring_index(category, "_", 1)


def ground(signals: DataFrame, records: DataFrame, keys: list[str], clause: str) -> DataFrame:
    """Adds what a clause's records (clause, record_id, category, record_type, tier) of the
    signal's category give: the official evidence ids in order, its best tier, score_eligible
    and practice_reference.  A record's category matches by its short code.  Records are folded to one row for each clause and category first."""
    official = (F.col("record_type") == "evidence") & F.col("tier").isin(*TIER_FACTOR)
    folded = records.withColumn("category", short_category(F.col("category"))).groupBy(clause, "category").agg(
        F.array_sort(F.collect_set(F.when(official, F.col("record_id")))).alias("evidence_ids"),
        F.min(F.when(official, F.col("tier"))).alias("best_tier"),
        F.max(F.col("tier").isin("B", "C")).alias("has_practice"),
    )
    out = signals.join(folded, [clause, "category"], "left")
    eligible = F.coalesce(F.size("evidence_ids") > 0, F.lit(False)) & F.col("category").rlike("^F[1-9]")
    none = F.array().cast(folded.schema["evidence_ids"].dataType)
    return out.withColumns({
        "evidence_ids": F.coalesce("evidence_ids", none),
        "score_eligible": eligible,
        "practice_reference": ~eligible & F.coalesce("has_practice", F.lit(False)),
    }).drop("has_practice")


def contribution() -> Column:
    """severity weight * severity * tier factor * confidence within [floor, 1]; 0 behind the gate."""
    factor = F.create_map(*(F.lit(x) for kv in TIER_FACTOR.items() for x in kv))[F.col("best_tier")]
    confidence = F.least(F.lit(1.0), F.greatest(F.col("confidence"), F.lit(CONF_FLOOR)))
    value = F.lit(SEVERITY_WEIGHT) * F.col("severity") * F.coalesce(factor, F.lit(0.0)) * confidence
    return F.round(F.when(F.col("score_eligible"), value).otherwise(0.0), 9)


def hybrid_merge(rule: DataFrame, model: DataFrame, keys: list[str]) -> DataFrame:
    """One signal for each clause and category: the largest severity, noisy-or of confidences,
    whether a protection is missing, and the detectors."""
    a = rule.select(*keys, "category", "severity", "confidence", (F.col("kind") == "missing_protection").alias("missing"), F.lit("rule").alias("detector"))
    b = model.select(*keys, "category", "severity", "confidence", F.lit(False).alias("missing"), F.lit("model").alias("detector"))
    return a.unionByName(b).groupBy(*keys, "category").agg(
        F.max("severity").alias("severity"),
        F.round(1 - F.product(1 - F.col("confidence")), 6).alias("confidence"),
        F.bool_or("missing").alias("missing"),
        F.array_join(F.array_sort(F.collect_set("detector")), "+").alias("detector"),
        F.count("*").alias("merged"),
    )


def rule_support(rules, chunks: DataFrame, tiers=("B", "C"), types=(), ranked: int = 12, shown: int = 3) -> DataFrame:
    """(rule, support_ids) of ``rules`` (rule, pattern, query, markers): of the ``ranked`` best
    practice chunks (chunk_id, text, authority_tier, chunk_type, risk_categories) for a rule's
    query those that hold one of its markers in their texts or ids; the first ``shown`` are listed."""
    spark = chunks.sparkSession
    queries = spark.createDataFrame([(r, q) for r, _, q, _ in rules], "query_id string, text string")
    best = rt.filtered(rt.search(chunks, queries), chunks, types=types, tiers=tiers)
    best = rt.top_k(best, ranked, ties=[tier_order(F.col("authority_tier"))]).join(chunks.select("chunk_id", "text"), "chunk_id")
    marks = spark.createDataFrame([(r, m.lower()) for r, _, _, marks in rules for m in marks], "query_id string, marker string")
    held = best.join(F.broadcast(marks), "query_id").filter(F.contains(F.lower(F.concat_ws(" ", "chunk_id", "text")), F.col("marker"))).dropDuplicates(["query_id", "chunk_id"])  # a row for each marker
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    first = held.withColumn("n", place).filter(F.col("n") <= shown).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("n", "chunk_id"))).alias("c"))
    return first.select(F.col("query_id").alias("rule"), F.transform("c", lambda x: x["chunk_id"]).alias("support_ids"))


def verification_signals(clauses: DataFrame, keys: list[str], rules, chunks: DataFrame) -> DataFrame:
    """Signals of rules that fire on a clause and have support in the corpus; they never score."""
    fired = clauses.select(*keys, F.explode(F.array_compact(F.array(*(F.when(F.col("text").rlike(p), F.lit(r)) for r, p, _, _ in rules)))).alias("rule"))
    return fired.join(F.broadcast(rule_support(rules, chunks)), "rule").withColumn("contribution", F.lit(0.0))  # a row for each rule
