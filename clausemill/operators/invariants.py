"""Invariants of a review, checked in one pass: metrics by ``observe``, rows that break a rule as the
result.

A gate is a set of rules that no row may break, and of cases that some row must show, so that a table
without them doesn't pass for want of anything to check.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .audit import violations

SUM_LIMIT = 100.0


@dataclass
class Gate:
    """Rules (name: condition of a row that breaks it) and cases (name: condition of a row that shows it)."""

    rules: dict[str, Column]
    cases: dict[str, Column]

    def checked(self, rows: DataFrame, key: str) -> tuple[DataFrame, Observation]:
        """(key, violation) of rows that break a rule, and the counts of all rules and cases, which
        are there once an action has run through these rows."""
        counts = Observation()
        marks = {f"rule:{n}": c for n, c in self.rules.items()} | {f"case:{n}": c for n, c in self.cases.items()}
        seen = rows.observe(counts, F.count("*").alias("rows"), *(F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in marks.items()))
        return violations(seen, key, self.rules), counts

    @staticmethod
    def problems(counts: Observation) -> list[str]:
        """What keeps the gate shut: rules that were broken, cases that no row showed."""
        got = counts.get
        return [n.removeprefix("rule:") for n, k in got.items() if n.startswith("rule:") and k] + [f"no {n.removeprefix('case:')}" for n, k in got.items() if n.startswith("case:") and not k]


def eligibility_gate() -> Gate:
    """Signals (category, n_evidence, n_practice, score_eligible, practice_reference, contribution): they
    may score if, and only if, official evidence grounds a financial category; what may not score
    contributes 0; what rests on practice alone is a practice reference."""
    expected = (F.col("n_evidence") > 0) & F.col("category").rlike("^F[1-9]")
    practice_alone = (F.col("n_practice") > 0) & (F.col("n_evidence") == 0) & ~F.col("score_eligible")
    return Gate(
        {
            "eligible_iff_grounded": F.col("score_eligible") != expected, "not_eligible_contributes": ~F.col("score_eligible") & (F.col("contribution") != 0),
            "practice_not_marked": practice_alone & ~F.col("practice_reference"),
        },
        {"practice_alone": practice_alone, "grounded": F.col("score_eligible")},
    )


def tag_gate() -> Gate:
    """Returned records (use, source_id, authority_tier, verification_status, score_eligible): tags are
    there, explanations are practice sources that don't score, grounding is official and does."""
    blank = lambda c: F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == ""
    explains, grounds = F.col("use") == "explanation", F.col("use") == "grounding"
    return Gate(
        {
            "tag_missing": blank("source_id") | blank("authority_tier") | blank("verification_status"),
            "explanation_scores": explains & (F.col("score_eligible") | ~F.col("authority_tier").isin("B", "C")), "grounding_not_official": grounds & (~F.col("score_eligible") | ~F.col("authority_tier").isin("A0", "A1", "A2")),
        },
        {"explanation": explains, "grounding": grounds},
    )


def score_gate() -> Gate:
    """Scores (score, review_priority, plain_priority, overall, plain_overall): they lie within 0 and
    100, and low confidence or missing records lower the confidence alone, never the priority."""
    return Gate(
        {
            "score_out_of_bounds": ~F.col("score").between(0, SUM_LIMIT), "priority_out_of_bounds": ~F.col("review_priority").between(0, SUM_LIMIT),
            "doubt_moves_priority": F.col("review_priority") != F.col("plain_priority"), "doubt_raises_confidence": F.col("overall") > F.col("plain_overall"),
        },
        {"scored": F.col("score") > 0, "doubted": F.col("overall") < F.col("plain_overall")},
    )


def exposure_gate() -> Gate:
    """Exposures (exposure_type, low, base, high, user_input_required, and plain_low, plain_base,
    plain_high before widening): types are named, ranges are ordered, widening leaves the base and moves
    the ends outwards, and what waits for inputs has no amounts."""
    amounts = [F.col(c) for c in ("low", "base", "high")]
    some = amounts[0].isNotNull() | amounts[1].isNotNull() | amounts[2].isNotNull()
    return Gate(
        {
            "type_missing": F.col("exposure_type").isNull(), "range_not_ordered": (amounts[0] > amounts[1]) | (amounts[1] > amounts[2]),
            "base_moved": ~F.col("base").eqNullSafe(F.col("plain_base")), "band_narrowed": (F.col("low") > F.col("plain_low")) | (F.col("high") < F.col("plain_high")),
            "blank_with_amounts": F.col("user_input_required") & some, "amounts_lack": ~F.col("user_input_required") & ~some,
        },
        {"widened": F.col("high") > F.col("plain_high"), "blank": F.col("user_input_required")},
    )


def lost_conflict_members(returned: DataFrame, records: DataFrame, by: list[str]) -> DataFrame:
    """(by, conflict_group, chunk_id): members of a conflict group of which one is returned (by,
    chunk_id) and they aren't; groups are those of ``records`` (chunk_id, conflict_group)."""
    grouped = records.filter("conflict_group <> ''").select("chunk_id", "conflict_group")
    touched = returned.join(grouped, "chunk_id").select(*by, "conflict_group").distinct()
    return touched.join(grouped, "conflict_group").join(returned.select(*by, "chunk_id"), [*by, "chunk_id"], "left_anti").select(*by, "conflict_group", "chunk_id")
