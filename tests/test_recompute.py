"""Incremental recomputing equals recomputing all, and computes no more than it must."""

import random

from pyspark.sql import functions as F

from clausemill.operators import recompute as rc

INPUTS = sorted({c for m in rc.MODULES.values() for c in m.inputs})
KINDS = {c: "boolean" if c.startswith(("is_", "include_")) else "int" if c.endswith("months") else "double" for c in INPUTS}


def scenarios(spark, rng, n=60):
    pick = {"boolean": lambda: rng.random() < 0.5, "int": lambda: rng.randrange(12), "double": lambda: round(rng.random() * 10, 2)}
    rows = [(k, *(None if rng.random() < 0.04 else pick[KINDS[c]]() for c in INPUTS)) for k in range(n)]
    return rows, "k int, " + ", ".join(f"{c} {KINDS[c]}" for c in INPUTS)


def plain(df):
    return sorted(map(repr, df.collect()))


def test_equals_a_full_recompute(spark):
    rng = random.Random(1)
    rows, schema = scenarios(spark, rng)
    edited = ("annual_discount_rate", "penalty_probability", "sales_low")
    at = [1 + INPUTS.index(c) for c in edited]
    new = [list(r) for r in rows]
    for r in new:
        for i in at:
            if rng.random() < 0.3:
                r[i] = rng.choice([None, 0.5, 0.07])
    new = new[:50] + [[100 + k, *rows[k][1:]] for k in range(5)]  # ten are gone, five come new
    before, after = spark.createDataFrame(rows, schema), spark.createDataFrame(new, schema)
    previous = rc.recompute(before, ["k"])
    got = rc.recompute_changed(previous, before, after, ["k"], edited)
    assert plain(got) == plain(rc.recompute(after, ["k"]))
    findings = spark.createDataFrame([(k * 10 + j, k, m) for k in range(60) for j, m in enumerate(rc.MODULES)], "finding_id int, k int, fim_module string")
    changed = {(r.k, r.fim_module) for r in rc.changed_findings(previous, got, findings, ["k"]).collect()}
    old, now = ({(r.k, r.fim_module): (r.low, r.base, r.high, r.user_input_required) for r in df.collect()} for df in (previous, got))
    assert changed == {key for key in now if key in old and old[key] != now[key]} and changed


def test_untouched_modules_are_not_in_the_plan(spark):
    rows, schema = scenarios(spark, random.Random(2))
    before = spark.createDataFrame(rows, schema)
    assert rc.touched_modules(["delayed_amount"]) == ["FIM-2"] and rc.touched_modules(["annual_discount_rate"]) == ["FIM-2", "FIM-5"]
    saved = spark.createDataFrame(rc.recompute(before, ["k"]).collect(), rc.recompute(before, ["k"]).schema)
    old = before.withColumn("delayed_amount", F.lit(1.0))
    plan = rc.recompute(before, ["k"], rc.touched_modules(["delayed_amount"]))._jdf.queryExecution().optimizedPlan().toString()
    assert "FIM-2" in plan and "FIM-5" not in plan and "gross_sales" not in plan.split("LogicalRDD")[0]
    assert rc.recompute_changed(saved, before, before, ["k"], ()).count() == saved.count()
    assert plain(rc.recompute_changed(saved, before, old, ["k"], ["delayed_amount"])) == plain(rc.recompute(old, ["k"]))


def test_missing_inputs_are_named(spark):
    rows, schema = scenarios(spark, random.Random(3), 1)
    blank = spark.createDataFrame([(1, *([None] * len(INPUTS)))], schema)
    got = {r.fim_module: r for r in rc.recompute(blank, ["k"]).collect()}
    assert all(r.user_input_required and r.low is None for r in got.values())
    assert got["FIM-2"].missing[:2] == ["delayed_amount", "annual_discount_rate"] and got["FIM-7"].missing == ["explicit_penalty_cap", "penalty_probability"]
