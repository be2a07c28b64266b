"""Exposures of scenarios from their assumptions, and again where assumptions change.

A scenario is a row of named inputs.  Each module says which it needs; those inputs are the
dependency table.  An edit of some inputs touches the modules that read one of them and no others:
only these are in the plan, and of them only scenarios whose values differ are computed.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import finance as fin

_RANGE = "struct<low:double,base:double,high:double>"


def _ranged(name: str) -> tuple[str, ...]:
    return tuple(f"{name}_{part}" for part in ("low", "base", "high"))


def _triple(name: str) -> Column:
    return fin.triple(*(F.col(c) for c in _ranged(name)))


@dataclass(frozen=True)
class Module:
    """Its exposure type, the inputs that must be there, others that it reads, its range, and, where
    that isn't the plain list of what must be there, what is missing."""

    exposure_type: str
    needed: tuple[str, ...]
    value: Callable[[], Column]
    optional: tuple[str, ...] = ()
    lacks: Callable[[], Column] | None = None

    @property
    def inputs(self) -> tuple[str, ...]:
        return self.needed + self.optional

    def missing(self) -> Column:
        base = fin.missing_inputs(**{c: F.col(c) for c in self.needed}) if self.needed else F.array().cast("array<string>")
        return F.concat(base, self.lacks()) if self.lacks else base


def _named(**conditions: Column) -> Column:
    return F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in conditions.items())))


def _fim3() -> Column:
    return fin.triple(*(fin.fim3_recoupment(F.col("recoupable_advance"), F.col("cumulative_recouped"), F.col("revenue_share_rate"), F.col(c))["months"] for c in _ranged("sales")))


def _fim5() -> Column:
    months = F.col("exclusivity_duration_months") + F.when(F.coalesce("include_renewal", F.lit(False)), F.coalesce("renewal_duration_months", F.lit(0))).otherwise(0)
    return fin.fim5_opportunity(fin.triple(F.col("alternative_monthly_revenue")), _triple("scenario_probability"), fin.triple(F.col("annual_discount_rate")), months)


def _fim7() -> Column:
    flag = lambda c: F.coalesce(c, F.lit(False))
    return fin.fim7_liability(F.col("explicit_penalty_cap"), flag("is_uncapped"), flag("is_ambiguous"), F.when(F.col("penalty_probability").isNotNull(), fin.triple(F.col("penalty_probability"))), fin.triple(F.col("penalty_scenario_amount")))["exposure"]


MODULES = {
    "FIM-1": Module(
        "revenue_leakage", ("gross_sales", "refunds", "explicitly_allowed_deductions", "revenue_share_rate", "fixed_fee", "advance_recoupment", *_ranged("open_ended_deductions")),
        lambda: fin.fim1_leakage(F.col("gross_sales"), F.col("refunds"), F.col("explicitly_allowed_deductions"), F.col("revenue_share_rate"), _triple("open_ended_deductions")),
    ),
    "FIM-2": Module(
        "present_value_loss", ("delayed_amount", "annual_discount_rate", *_ranged("delay_days")),
        lambda: fin.triple(*(fin.fim2_delay_loss(F.col("delayed_amount"), F.col("annual_discount_rate"), F.col(c)) for c in _ranged("delay_days"))),
    ),
    "FIM-3": Module("cashflow_deferral", ("recoupable_advance", "cumulative_recouped", "revenue_share_rate", *_ranged("sales")), _fim3),
    "FIM-4": Module(
        "revenue_leakage", ("unpaid_revision_units", "hours_per_unit", "creator_hourly_value"),
        lambda: fin.fim4_unpaid_work(F.col("unpaid_revision_units"), fin.triple(F.col("hours_per_unit")), F.col("creator_hourly_value")),
    ),
    "FIM-5": Module(
        "opportunity_cost", ("exclusivity_duration_months", "alternative_monthly_revenue", "annual_discount_rate", *_ranged("scenario_probability")), _fim5, ("renewal_duration_months", "include_renewal"),
        lambda: _named(renewal_duration_months=F.coalesce("include_renewal", F.lit(False)) & F.col("renewal_duration_months").isNull()),
    ),
    "FIM-7": Module(
        "liability_exposure", (), _fim7, ("explicit_penalty_cap", "is_uncapped", "is_ambiguous", "penalty_probability", "penalty_scenario_amount"),
        lambda: F.concat(
            _named(penalty_scenario_amount=F.col("penalty_probability").isNotNull() & F.col("penalty_scenario_amount").isNull()),
            F.when(F.col("explicit_penalty_cap").isNull() & F.col("penalty_probability").isNull(), F.array(F.lit("explicit_penalty_cap"), F.lit("penalty_probability"))).otherwise(F.array().cast("array<string>")),
        ),
    ),
}


def touched_modules(edited) -> list[str]:
    """The modules that read one of these inputs."""
    return [m for m, module in MODULES.items() if set(module.inputs) & set(edited)]


def _exposure(name: str) -> Column:
    module = MODULES[name]
    missing = module.missing()
    value = F.when(F.size(missing) == 0, module.value().cast(_RANGE))
    return F.struct(F.lit(name).alias("fim_module"), F.lit(module.exposure_type).alias("exposure_type"), value.alias("value"), missing.alias("missing"))


def _flat(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.select(*keys, "fim_module", "exposure_type", "value.low", "value.base", "value.high", F.col("value").isNull().alias("user_input_required"), "missing")


def recompute(assumptions: DataFrame, keys: list[str], modules=tuple(MODULES)) -> DataFrame:
    """(keys, fim_module, exposure_type, low, base, high, user_input_required, missing): a row for
    each scenario and module.  Where inputs are missing there are no amounts, and they are named."""
    return _flat(assumptions.select(*keys, F.inline(F.array(*map(_exposure, modules)))), keys)


def recompute_changed(previous: DataFrame, before: DataFrame, after: DataFrame, keys: list[str], edited) -> DataFrame:
    """What ``recompute(after)`` gives, from ``previous``, which ``recompute(before)`` gave, where
    no inputs but ``edited`` may differ.  Modules that read none of them aren't computed, nor is a
    module of a scenario whose inputs are the same.  Scenarios that come new are computed whole,
    those that are gone fall away."""
    modules = touched_modules(edited)
    old = before.select(*keys, F.lit(True).alias("_known"), *(F.col(c).alias(f"_{c}") for c in edited))
    pairs = after.join(old, keys, "left")

    def differs(name: str) -> Column:
        out = F.col("_known").isNull()
        for c in (c for c in MODULES[name].inputs if c in edited):
            out = out | ~F.col(c).eqNullSafe(F.col(f"_{c}"))
        return out

    fresh = _flat(pairs.select(*keys, F.inline(F.array_compact(F.array(*(F.when(differs(m), _exposure(m)) for m in modules))))), keys) if modules else previous.limit(0)
    rest = [m for m in MODULES if m not in modules]
    fresh = fresh.unionByName(recompute(after.join(before.select(*keys), keys, "left_anti"), keys, rest)) if rest else fresh
    kept = previous.join(after.select(*keys), keys, "left_semi").join(fresh.select(*keys, "fim_module"), [*keys, "fim_module"], "left_anti")
    return kept.unionByName(fresh)


def changed_findings(before: DataFrame, after: DataFrame, findings: DataFrame, keys: list[str]) -> DataFrame:
    """Findings (keys, fim_module, ...) whose exposure is another after than before."""
    changed = fin.changed_exposures(before, after, [*keys, "fim_module"], ["low", "base", "high", "user_input_required"])
    return findings.join(changed.select(*keys, "fim_module"), [*keys, "fim_module"], "left_semi")
