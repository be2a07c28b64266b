"""Exposures recomputed after an edit of assumptions; a customer is a scenario."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import recompute as rc
from ..sources.readers import read_table
from .registry import query

EDITED = ("annual_discount_rate", "delayed_amount")


def assumptions(spark, sf, edited: bool):
    """A scenario for each customer; the edit raises every third discount rate, and takes every fifth
    delayed amount away."""
    k, m = F.col("c_custkey"), F.round(F.abs("c_acctbal"), 2)
    some = lambda value, n, rest=0: F.when(k % n != rest, value)
    rate = F.when(k % 3 == 0, 0.08).otherwise(0.05) if edited else F.lit(0.05)
    delayed = F.when(k % 5 == 0, F.lit(None)).otherwise(some(m, 7)) if edited else some(m, 7)
    parts = lambda name, a, b, c: {f"{name}_low": a, f"{name}_base": b, f"{name}_high": c}
    none = F.lit(None).cast("double")
    columns = {
        "annual_discount_rate": rate, "delayed_amount": delayed, "gross_sales": m * 10, "refunds": m, "explicitly_allowed_deductions": F.lit(50.0), "revenue_share_rate": some(F.lit(0.4), 11), "fixed_fee": F.lit(0.0), "advance_recoupment": F.lit(0.0),
        **parts("open_ended_deductions", F.lit(0.0), m / 2, m), **parts("delay_days", F.lit(0.0), k % 90 + 0.0, k % 90 + 30.0), "recoupable_advance": m * 3, "cumulative_recouped": m, **parts("sales", m / 4, m / 2, m),
        "unpaid_revision_units": some(k % 6, 4), "hours_per_unit": F.lit(1.5), "creator_hourly_value": F.lit(40.0), "exclusivity_duration_months": (k % 12).cast("int"), "alternative_monthly_revenue": m / 10,
        **parts("scenario_probability", F.lit(0.2), F.lit(0.5), F.lit(0.9)), "renewal_duration_months": F.when(k % 8 == 0, F.lit(6)), "include_renewal": k % 4 == 0, "explicit_penalty_cap": F.when(k % 2 == 0, m),
        "is_uncapped": k % 10 == 1, "is_ambiguous": F.lit(False), "penalty_probability": F.when(k % 6 == 0, F.lit(0.25)).otherwise(none), "penalty_scenario_amount": F.when(k % 12 == 0, m * 2),
    }
    return read_table(spark, sf, "customer").select(k.alias("scenario"), *(c.alias(n) for n, c in columns.items()))


def _sql(rate: str, delayed: str, name: str) -> str:
    """The whole recompute in plain SQL: table ``name`` (scenario, fim_module, low, base, high)."""
    months = "k % 12 + CASE WHEN k % 4 = 0 THEN coalesce(ren, 0) ELSE 0 END"
    five = lambda p: f"CASE WHEN {months} > 0 THEN list_sum(list_transform(generate_series(1, {months}), lambda i: {p} * (m / 10) / pow(1 + rate, i / 12.0::DOUBLE))) ELSE 0 END"
    three = lambda s: f"CASE WHEN m * 3 - m <= 0 THEN 0 WHEN 0.4::DOUBLE * ({s}) <= 0 THEN 'inf'::DOUBLE ELSE ceil((m * 3 - m) / (0.4::DOUBLE * ({s}))) END"
    one = lambda x: f"0.4::DOUBLE * (greatest(m * 10 - m - 50, 0) - greatest(m * 10 - m - 50 - ({x}), 0))"
    two = lambda d: f"da * (1 - pow(1 + rate, -({d}) / 365.0::DOUBLE))"
    modules = {
        "FIM-1": ("k % 11 <> 0", one("0"), one("m / 2"), one("m")), "FIM-2": ("da IS NOT NULL", two("0.0"), two("k % 90"), two("k % 90 + 30")), "FIM-3": ("k % 11 <> 0", three("m / 4"), three("m / 2"), three("m")),
        "FIM-4": ("k % 4 <> 0", *["k % 6 * 1.5::DOUBLE * 40"] * 3), "FIM-5": ("NOT (k % 4 = 0 AND ren IS NULL)", five("0.2::DOUBLE"), five("0.5::DOUBLE"), five("0.9::DOUBLE")),
        "FIM-7": ("(k % 6 <> 0 OR k % 12 = 0) AND (k % 2 = 0 OR k % 6 = 0)", *["CASE WHEN k % 12 = 0 THEN 0.25::DOUBLE * m * 2 ELSE m END"] * 3),
    }
    rows = " UNION ALL ".join(f"SELECT k AS scenario, '{n}' AS fim_module, " + ", ".join(f"CASE WHEN {ok} THEN {v} END AS {part}" for part, v in zip(("low", "base", "high"), values)) + f" FROM b_{name}" for n, (ok, *values) in modules.items())
    return f"b_{name} AS (SELECT c_custkey AS k, round(abs(c_acctbal), 2) AS m, CAST({rate} AS DOUBLE) AS rate, {delayed} AS da, CASE WHEN c_custkey % 8 = 0 THEN 6 END AS ren FROM customer), {name} AS ({rows})"


_BEFORE = _sql("0.05", "CASE WHEN c_custkey % 7 <> 0 THEN round(abs(c_acctbal), 2) END", "before")
_AFTER = _sql("CASE WHEN c_custkey % 3 = 0 THEN 0.08 ELSE 0.05 END", "CASE WHEN c_custkey % 5 <> 0 AND c_custkey % 7 <> 0 THEN round(abs(c_acctbal), 2) END", "after_")


def _tables(spark, sf):
    before, after = assumptions(spark, sf, False), assumptions(spark, sf, True)
    previous = rc.recompute(before, ["scenario"])
    return previous, rc.recompute_changed(previous, before, after, ["scenario"], EDITED)


@query(f"WITH {_AFTER} SELECT scenario, fim_module, round(low, 4) AS low, round(base, 4) AS base, round(high, 4) AS high, low IS NULL AS user_input_required FROM after_")
def recomputed_exposures(spark, sf):
    """After the edit: two modules anew, the others as they were."""
    out = _tables(spark, sf)[1]
    return out.select("scenario", "fim_module", *(F.round(c, 4).alias(c) for c in ("low", "base", "high")), "user_input_required")


@query(f"""
WITH {_BEFORE}, {_AFTER} SELECT o_orderkey AS finding_id, fim_module FROM orders JOIN before b ON scenario = o_custkey AND fim_module = 'FIM-' || (1 + o_orderkey % 7) JOIN after_ a USING (scenario, fim_module)
WHERE a.low IS DISTINCT FROM b.low OR a.base IS DISTINCT FROM b.base OR a.high IS DISTINCT FROM b.high
""")
def changed_findings(spark, sf):
    """Findings (here an order of the customer, its module by its key) that the edit bears on."""
    previous, current = _tables(spark, sf)
    findings = read_table(spark, sf, "orders").select(F.col("o_orderkey").alias("finding_id"), F.col("o_custkey").alias("scenario"), F.concat(F.lit("FIM-"), (1 + F.col("o_orderkey") % 7).cast("string")).alias("fim_module"))
    return rc.changed_findings(previous, current, findings, ["scenario"]).select("finding_id", "fim_module")
