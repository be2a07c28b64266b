"""Scenario finance: eight modules over low/base/high ranges, as Column builders.

A range is a struct of three doubles; a module returns ranges or scalars of one exposure
type.  Amounts of different types are never added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def triple(low, base=None, high=None) -> Column:
    low = low if isinstance(low, Column) else F.lit(low)
    base, high = (low if x is None else x if isinstance(x, Column) else F.lit(x) for x in (base, high))
    return F.struct(low.cast("double").alias("low"), base.cast("double").alias("base"), high.cast("double").alias("high"))


def checked(r: Column, label: str) -> Column:
    """The range itself; an error where it isn't ordered."""
    wrong = F.raise_error(F.lit(f"{label}: low <= base <= high is asked for")).cast("struct<low:double,base:double,high:double>")
    return F.when((r["low"] <= r["base"]) & (r["base"] <= r["high"]), r).otherwise(wrong)


def payout(fixed_fee: Column, rate: Column, net_sales: Column, advance: Column) -> Column:
    return fixed_fee + rate * F.greatest(net_sales, F.lit(0.0)) - advance


def fim1_leakage(gross: Column, refunds: Column, allowed: Column, rate: Column, open_deductions: Column) -> Column:
    """What open-ended deductions take from a revenue share: the share on the net with and
    without them.  ``open_deductions`` is a range."""
    def lost(x):
        base = F.greatest(gross - refunds - allowed, F.lit(0.0))
        return rate * (base - F.greatest(gross - refunds - allowed - x, F.lit(0.0)))

    return triple(lost(open_deductions["low"]), lost(open_deductions["base"]), lost(open_deductions["high"]))


def fim2_delay_loss(amount: Column, annual_rate: Column, delay_days: Column) -> Column:
    return amount * (1 - F.pow(1 + annual_rate, -delay_days / F.lit(365.0)))


def fim3_recoupment(advance: Column, recouped: Column, rate: Column, monthly_sales: Column) -> Column:
    """Open balance, monthly recoupment and months to recoup (0, a whole number or Infinity)."""
    balance = F.greatest(advance - recouped, F.lit(0.0))
    monthly = rate * F.greatest(monthly_sales, F.lit(0.0))
    months = F.when(balance == 0, F.lit(0.0)).when(monthly <= 0, F.lit(float("inf"))).otherwise(F.ceil(balance / monthly).cast("double"))
    return F.struct(balance.alias("balance"), monthly.alias("monthly"), months.alias("months"))


def fim4_unpaid_work(units: Column, hours: Column, hourly_value: Column) -> Column:
    """A range, or null where an input is missing.  ``hours`` is a range."""
    cost = triple(units * hours["low"] * hourly_value, units * hours["base"] * hourly_value, units * hours["high"] * hourly_value)
    return F.when(units.isNotNull() & hours.isNotNull() & hourly_value.isNotNull(), cost)


def discounted_months(value: Column, probability: Column, annual_rate: Column, months: Column) -> Column:
    terms = F.transform(F.sequence(F.lit(1), F.greatest(months, F.lit(1))), lambda m: probability * value / F.pow(1 + annual_rate, m / F.lit(12.0)))
    return F.when(months > 0, F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)).otherwise(F.lit(0.0))


def fim5_opportunity(value: Column, probability: Column, annual_rate: Column, months: Column) -> Column:
    """``value``, ``probability`` and ``annual_rate`` are ranges; the low case discounts with
    the high rate, the high case with the low rate."""
    return triple(*(discounted_months(value[c], probability[c], annual_rate[r], months) for c, r in (("low", "high"), ("base", "base"), ("high", "low"))))


def fim6_rights(rights: Column, annual_rate: Column) -> Column:
    """Sum over an array of (value, probability, timing_months) structs of scenario values;
    without a timing nothing is discounted.  ``annual_rate`` is a range."""
    def total(rate):
        term = lambda x: x["value"] * x["probability"] / F.when(x["timing_months"].isNull(), F.lit(1.0)).otherwise(F.pow(1 + rate, x["timing_months"] / F.lit(12.0)))
        return F.aggregate(F.transform(rights, term), F.lit(0.0), lambda s, x: s + x)

    return triple(total(annual_rate["high"]), total(annual_rate["base"]), total(annual_rate["low"]))


def fim7_liability(cap: Column, uncapped: Column, ambiguous: Column, probability: Column, scenario: Column) -> Column:
    """struct(exposure range or null, flags, user_input_required).  An expected penalty needs
    a probability; a cap alone gives the cap thrice."""
    expected = F.when(probability.isNotNull(), triple(*(probability[c] * scenario[c] for c in ("low", "base", "high"))))
    flags = F.array_compact(F.array(F.when(uncapped, F.lit("uncapped")), F.when(ambiguous, F.lit("ambiguous")), F.when(expected.isNull() & (uncapped | ambiguous), F.lit("scenario_required"))))
    exposure = F.coalesce(expected, F.when(cap.isNotNull(), triple(cap)))
    return F.struct(exposure.alias("exposure"), flags.alias("flags"), exposure.isNull().alias("user_input_required"))


def fim8_widen(exposure: Column, n_flags: Column, weight: float) -> Column:
    """Low is divided and high multiplied by 1 + the flags' weights."""
    factor = F.lit(1.0) + n_flags * F.lit(weight)
    return triple(exposure["low"] / factor, exposure["base"], exposure["high"] * factor)


def missing_inputs(**columns: Column) -> Column:
    return F.array_compact(F.array(*(F.when(c.isNull(), F.lit(n)) for n, c in columns.items())))


def blank_exposure(module: str, exposure_type: str, missing: Column) -> Column:
    """An exposure that waits for the user: no amounts, one flag for each missing input."""
    none = F.lit(None).cast("double")
    return F.struct(
        F.lit(module).alias("fim_module"), F.lit(exposure_type).alias("exposure_type"), none.alias("low"), none.alias("base"), none.alias("high"),
        F.lit(True).alias("user_input_required"), F.transform(missing, lambda m: F.concat(F.lit("missing_user_input:"), m)).alias("flags"),
    )


def subtotals(exposures: DataFrame, by: list[str], digits: int = 2) -> DataFrame:
    """Sums of each exposure type; blank amounts count as 0."""
    return exposures.groupBy(*by, "exposure_type").agg(*(F.round(F.sum(F.coalesce(c, F.lit(0.0))), digits).alias(c) for c in ("low", "base", "high")))


def changed_exposures(previous: DataFrame, current: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Keys whose values differ or stand on one side alone."""
    a = previous.select(*keys, F.struct(*values).alias("before"))
    b = current.select(*keys, F.struct(*values).alias("after"))
    return a.join(b, keys, "full_outer").filter(~F.col("before").eqNullSafe(F.col("after"))).filter("after IS NOT NULL")
