"""Scores, confidence, ranking and pathway of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..dims import (
    BASE_EVIDENCE, CATEGORY_WEIGHT, CONFIDENCE_WEIGHTS, DISPUTE_DELAY_DAYS, FLAG_WEIGHT, MODULE_OF, NEGOTIATION_SCORE, PROFESSIONAL_SCORE, REVIEW_MINUTES, SATURATION, SHORT, TYPE_OF, TYPE_ORDER,
    UNVERIFIED_FACTOR,
)


def literal_map(d: dict) -> Column:
    return F.create_map(*(F.lit(x) for k, v in d.items() if v is not None for x in (k, v)))


def saturating(total: Column, k: float = SATURATION) -> Column:
    if k <= 0:
        return F.when(total > 0, 100.0).otherwise(0.0)
    return F.least(F.lit(100.0), F.greatest(F.lit(0.0), 100 * (1 - F.exp(-total / k))))


def category_scores(contributions: DataFrame, keys: list[str], digits: int = 6) -> DataFrame:
    """(keys, category, total, score) with a row for each of the nine categories of each key.
    Totals are summed anew at the grain asked for; scores of clauses are never combined."""
    sums = contributions.groupBy(*keys, "category").agg(F.sum("contribution").alias("total"))
    have = sums.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("category", "total"))).alias("m"))  # nine entries at most
    rows = have.select(*keys, F.explode(F.array(*map(F.lit, SHORT))).alias("category"), "m")
    total = F.coalesce(F.try_element_at("m", F.col("category")), F.lit(0.0))
    return rows.select(*keys, "category", F.round(total, digits).alias("total"), F.round(saturating(total), digits).alias("score"))


def priority(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Weighted mean of the category scores, rounded half to even, within 0..100."""
    mean = F.sum(F.col("score") * CATEGORY_WEIGHT) / F.sum(F.lit(CATEGORY_WEIGHT))
    return scores.groupBy(*keys).agg(F.greatest(F.lit(0), F.least(F.lit(100), F.bround(F.round(mean, 9), 0).cast("int"))).alias("review_priority"), F.round(F.max("score"), 6).alias("top_score"))


def confidence_breakdown(signals: DataFrame, flags: DataFrame, key: str, digits: int = 6) -> DataFrame:
    """Weighted geometric mean of reading, evidence and completeness.  ``flags``: (key,
    n_flags), the missing-input and opacity flags of a document."""
    sums = signals.groupBy(key).agg(F.avg("confidence").alias("reading"), F.avg(F.col("score_eligible").cast("double")).alias("density"))
    out = flags.join(sums, key, "left").withColumns({
        "reading": F.coalesce("reading", F.lit(1.0)),
        "evidence": F.least(F.lit(1.0), BASE_EVIDENCE * UNVERIFIED_FACTOR * F.coalesce("density", F.lit(1.0))),
        "completeness": 1 - F.least(F.lit(1.0), F.col("n_flags") * FLAG_WEIGHT),
    })
    a, b, c = CONFIDENCE_WEIGHTS
    overall = F.pow("reading", F.lit(a)) * F.pow("evidence", F.lit(b)) * F.pow("completeness", F.lit(c))
    return out.select(key, *(F.round(x, digits).alias(x) for x in ("reading", "evidence", "completeness")), F.round(overall, digits).alias("overall"))


def flag_penalty(flags: Column, weights: dict[str, float]) -> Column:
    """Sum of the flags' weights; an unknown flag is an error."""
    known = literal_map(weights)
    bad = lambda f: F.raise_error(F.concat(F.lit("unknown flag: "), f)).cast("double")
    return F.aggregate(F.transform(flags, lambda f: F.coalesce(known[f], bad(f))), F.lit(0.0), lambda s, x: s + x)


def nonzero(c: str) -> Column:
    return F.nullif(F.col(c), F.lit(0.0))


def exposure_order(of: str = "") -> Column:
    """Exposures by (high, base, type); 0 counts as missing."""
    high, base, nominal = nonzero(f"{of}high"), nonzero(f"{of}base"), F.col(f"{of}nominal")
    return F.struct(F.coalesce(high, base, nominal, F.lit(0.0)).alias("h"), F.coalesce(base, nominal, F.lit(0.0)).alias("b"), F.col(f"{of}exposure_type").alias("t"))


def best_exposure() -> Column:
    """The largest exposure of a group."""
    return F.max_by(F.struct("exposure_type", "low", "base", "high", "nominal", "user_input_required", "flags"), exposure_order())


def matched_findings(signals: DataFrame, exposures: DataFrame, key: str) -> DataFrame:
    """Signals (key, clause_id, signal_id, category, severity, confidence, contribution) with their
    exposure, its quantification and amount.  A signal's exposure is that of its module and type, or else
    the largest of its module, if its category has a type at all."""
    module, kind = literal_map(MODULE_OF)[F.col("category")], literal_map(TYPE_OF)[F.col("category")]
    s = signals.withColumns({"fim_module": module, "expected_type": kind})
    # a row for each module of a document, with its largest exposure and that of each type; merged, as
    # exposures that a generator made count as few with Spark, which would send them through the driver
    of_type = exposures.groupBy(key, "fim_module", "exposure_type").agg(best_exposure().alias("e"))
    typed = F.map_from_entries(F.collect_list(F.when(F.col("exposure_type").isNotNull(), F.struct("exposure_type", "e"))))
    module_of = of_type.groupBy(key, "fim_module").agg(typed.alias("_exact"), F.max_by("e", exposure_order("e.")).alias("_any")).withColumnsRenamed({key: "_k", "fim_module": "_m"})
    same = F.col(key).eqNullSafe(F.col("_k")) & (F.col("fim_module") == F.col("_m")) & F.col("expected_type").isNotNull()
    s = s.join(module_of.hint("merge"), same, "left")
    s = s.withColumn("_e", F.coalesce(F.try_element_at("_exact", F.col("expected_type")), "_any")).withColumn("has_exposure", F.when(F.col("_e").isNotNull(), True))
    s = s.select("*", "_e.*").drop("_k", "_m", "_exact", "_any", "_e")
    unbounded = F.exists(F.coalesce("flags", F.array().cast("array<string>")), lambda f: f.isin("uncapped", "unbounded") | f.endswith(":uncapped"))
    whole = F.col("low").isNotNull() & F.col("base").isNotNull() & F.col("high").isNotNull()
    status = (
        F.when(F.col("expected_type").isNull(), "not_applicable").when(F.col("has_exposure").isNull(), "input_required").when(unbounded, "unbounded")
        .when(whole & ~F.col("user_input_required"), "quantified").when(F.col("nominal").isNotNull(), "partially_bounded").when(F.col("user_input_required"), "input_required").otherwise("not_applicable")
    )
    amount = F.when(F.col("quantification") == "quantified", F.coalesce(nonzero("high"), nonzero("base"), F.col("low"))).when(F.col("quantification") == "partially_bounded", F.col("nominal"))
    return s.withColumn("quantification", status).withColumn("amount", amount)


def _basis(gate: str) -> Column:
    """Why a matched finding stands where it does; ``gate``: enforced or bypass."""
    scored = F.lit(True) if gate == "bypass" else F.col("contribution") > 0
    return (
        F.when(~scored, "unverified_candidate").when(F.col("quantification") == "unbounded", "uncapped_or_unbounded").when(F.col("exposure_type") == "present_value_loss", "present_value_timing")
        .when(F.col("quantification").isin("quantified", "partially_bounded"), "quantified_exposure").when(F.col("category").isin("F1", "F9"), "counterparty_verification").otherwise("grounded_qualitative_signal")
    )


def _rank(key: str, policy: str, basis: str) -> Column:
    """The rank of matched findings by ``policy``, their basis being in a column."""
    class_order = literal_map({"uncapped_or_unbounded": 0, "quantified_exposure": 10, "present_value_timing": 10, "counterparty_verification": 20, "grounded_qualitative_signal": 30, "unverified_candidate": 40})[F.col(basis)]
    status_order = literal_map({"quantified": 0, "partially_bounded": 1, "unbounded": 0, "input_required": 2, "not_applicable": 3})[F.col("quantification")]
    type_order = F.coalesce(literal_map(TYPE_ORDER)[F.col("expected_type")], F.lit(len(TYPE_ORDER)))
    by_exposure = [class_order, status_order, type_order, F.coalesce(nonzero("amount"), F.col("nominal"), F.lit(0.0)).desc(), F.col("severity").desc(), "signal_id", "clause_id"]
    by_severity = [(F.col("severity") * F.col("confidence")).desc(), "signal_id", "clause_id"]
    return F.row_number().over(Window.partitionBy(key).orderBy(*(by_exposure if policy == "exposure_aware" else by_severity)))


def rank_findings(signals: DataFrame, exposures: DataFrame, key: str, *, policy: str = "exposure_aware", gate: str = "enforced") -> DataFrame:
    """Ranks a document's signals, matched with exposures, by the ladder unbounded, quantified, to
    verify, qualitative, unverified; amounts are compared inside a type alone.  ``policy``:
    exposure_aware or severity_baseline; ``gate``: enforced or bypass."""
    s = matched_findings(signals, exposures, key).withColumn("basis", _basis(gate))
    return s.select(key, "clause_id", "signal_id", "category", "basis", "quantification", F.round("amount", 2).alias("amount"), _rank(key, policy, "basis").alias("rank"))


def rank_arms(signals: DataFrame, exposures: DataFrame, key: str, arms: list[tuple[str, str]]) -> DataFrame:
    """(arm, key, clause_id, signal_id, basis, rank) of ``rank_findings`` for each arm (policy, gate).
    Signals are matched once, and all arms are ranked where a document's signals lie."""
    s = matched_findings(signals, exposures, key).withColumns({f"_{g}": _basis(g) for g in {g for _, g in arms}})
    s = s.select(key, "clause_id", "signal_id", *(f"_{g}" for g in sorted({g for _, g in arms})), *(_rank(key, p, f"_{g}").alias(f"_r{i}") for i, (p, g) in enumerate(arms)))
    each = F.array(*(F.struct(F.lit(f"{p}/{g}").alias("arm"), F.col(f"_{g}").alias("basis"), F.col(f"_r{i}").alias("rank")) for i, (p, g) in enumerate(arms)))
    return s.select(key, "clause_id", "signal_id", F.inline(each))


def review_minutes(pages: Column, corrections: Column, flagged: Column, missing: Column) -> Column:
    m = REVIEW_MINUTES
    return (F.lit(m["base"]) + m["page"] * pages + m["correction"] * corrections + m["flagged"] * flagged + m["missing"] * missing).cast("double")


def pathway(score: Column, professional: Column, money: Column, unpaid: Column, delay_days: Column) -> Column:
    return (
        F.when(professional | (score >= PROFESSIONAL_SCORE), "professional_review").when(money | (score >= NEGOTIATION_SCORE), "negotiation_required")
        .when(unpaid | (delay_days >= DISPUTE_DELAY_DAYS), "dispute_preparation").otherwise("clarification")
    )
