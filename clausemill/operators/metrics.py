"""Evaluation metrics as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import jaccard


def confusion(cases: DataFrame, by: list[str], gold: Column, predicted: Column) -> DataFrame:
    """tp, fp, fn, tn, F1 and false-positive rate of benign cases for each group."""
    out = cases.groupBy(*by).agg(
        F.count_if(gold & predicted).alias("tp"), F.count_if(~gold & predicted).alias("fp"), F.count_if(gold & ~predicted).alias("fn"), F.count_if(~gold & ~predicted).alias("tn")
    )
    f1 = F.when(2 * F.col("tp") + F.col("fp") + F.col("fn") > 0, 2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn"))).otherwise(0.0)
    fpr = F.when(F.col("fp") + F.col("tn") > 0, F.col("fp") / (F.col("fp") + F.col("tn"))).otherwise(0.0)
    return out.withColumns({"f1": F.round(f1, 6), "benign_fpr": F.round(fpr, 6)})


def severity_agreement(cases: DataFrame, by: list[str]) -> DataFrame:
    """1 - mean absolute error of severities over risky cases; a missed case predicts 0."""
    error = F.abs(F.col("gold_severity") - F.coalesce(F.col("predicted_severity"), F.lit(0.0)))
    return cases.filter("gold_is_risk").groupBy(*by).agg(F.round(1 - F.avg(error), 6).alias("severity_agreement"))


def calibration(cases: DataFrame, by: list[str], borders=(0.0, 1 / 3, 2 / 3, 1.0)) -> DataFrame:
    """Expected calibration error over bins (lo, hi] (the first holds 0 too) and Brier score, of
    (p, y)."""
    bin_ = F.lit(0)
    for k, b in enumerate(borders[1:-1], 1):
        bin_ = F.when(F.col("p") > b, k).otherwise(bin_)
    rows = cases.withColumn("bin", bin_)
    bins = rows.groupBy(*by, "bin").agg(F.count("*").alias("n"), F.avg("p").alias("ap"), F.avg("y").alias("ay"), F.sum(F.pow(F.col("p") - F.col("y"), F.lit(2.0))).alias("se"))
    return bins.groupBy(*by).agg(F.sum("n").alias("cases"), F.round(F.sum(F.col("n") * F.abs(F.col("ap") - F.col("ay"))) / F.sum("n"), 6).alias("ece"), F.round(F.sum("se") / F.sum("n"), 6).alias("brier"))


def top_share(cases: DataFrame, by: list[str], score: str, value: str, k: int, tie: str) -> DataFrame:
    """Value among the best k by ``score`` over the value among the best k by value."""
    w = Window.partitionBy(*by)
    ranked = cases.withColumns({
        "_s": F.row_number().over(w.orderBy(F.col(score).desc(), tie)), "_v": F.row_number().over(w.orderBy(F.col(value).desc(), tie)),
    }).filter((F.col("_s") <= k) | (F.col("_v") <= k))
    got, best = F.sum(F.when(F.col("_s") <= k, F.col(value)).otherwise(0)), F.sum(F.when(F.col("_v") <= k, F.col(value)).otherwise(0))
    return ranked.groupBy(*by).agg(F.round(got, 2).alias("captured"), F.round(best, 2).alias("oracle"), F.round(F.when(best > 0, got / best).otherwise(1.0), 6).alias("utility"))


def stability(runs: DataFrame, by: list[str], case: str, k: int) -> DataFrame:
    """Of (run, case, score): the mean score range of a case, and the mean Jaccard of each run's
    best k with those of run 0; two empty sets agree."""
    spread = runs.groupBy(*by, case).agg((F.max("score") - F.min("score")).alias("spread")).groupBy(*by).agg(F.avg("spread").alias("spread"))
    w = Window.partitionBy(*by, "run").orderBy(F.col("score").desc(), case)
    best = runs.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= k).groupBy(*by, "run").agg(F.collect_set(case).alias("best"))
    base = best.filter("run = 0").select(*by, F.col("best").alias("base"))
    agree = best.filter("run <> 0").join(base, by).groupBy(*by).agg(F.avg(jaccard(F.col("best"), F.col("base"), 1.0)).alias("agreement"))
    return spread.join(agree, by).select(*by, F.round("spread", 6).alias("spread"), F.round("agreement", 6).alias("agreement"))


def threshold_costs(cases: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Missed, effort and total cost, false-trigger rate and recall for each threshold of
    (score, exposed, miss_cost, effort_cost).  A case counts as triggered from a threshold on.
    Cases are folded by the number of thresholds they reach, so they never meet all of them;
    what follows has a row for each threshold."""
    marks = sorted({r.threshold for r in thresholds.select("threshold").collect()})  # the caller's list
    reached = F.size(F.filter(F.array(*map(F.lit, marks)), lambda t: t <= F.col("score")))
    by = cases.groupBy(reached.alias("reached")).agg(
        F.sum(F.when(F.col("exposed"), F.col("miss_cost")).otherwise(0.0)).alias("miss"), F.sum("effort_cost").alias("effort"), F.count_if("exposed").alias("pos"), F.count_if(~F.col("exposed")).alias("neg")
    )
    place = F.inline(F.array(*(F.struct(F.lit(float(t)).alias("threshold"), F.lit(k + 1).alias("k")) for k, t in enumerate(marks))))
    rows = by.select("*", place)
    hit = F.col("reached") >= F.col("k")
    total = lambda c, when: F.sum(F.when(when, F.col(c)).otherwise(0))
    out = rows.groupBy("threshold").agg(
        total("miss", ~hit).cast("double").alias("missed_cost"), total("effort", hit).cast("double").alias("effort_cost"),
        total("neg", hit).alias("fp"), F.sum("neg").alias("neg"), total("pos", hit).alias("tp"), F.sum("pos").alias("pos"),
    )
    rate = lambda a, b: F.round(F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0), 6)
    return out.select("threshold", "missed_cost", "effort_cost", (F.col("missed_cost") + F.col("effort_cost")).alias("total_cost"), rate("fp", "neg").alias("false_trigger_rate"), rate("tp", "pos").alias("recall"))


def best_threshold(costs: DataFrame) -> DataFrame:
    return costs.orderBy("total_cost", "false_trigger_rate", F.col("recall").desc(), F.col("threshold").desc()).limit(1)


def exposure_capture(rows: DataFrame, by: list[str]) -> DataFrame:
    """Captured over oracle weight within each exposure type, then the mean over types."""
    kinds = rows.groupBy(*by, "exposure_type").agg(F.sum("captured").alias("c"), F.sum("weight").alias("w"))
    return kinds.filter("w > 0").groupBy(*by).agg(F.count("*").alias("types"), F.round(F.avg(F.col("c") / F.col("w")), 6).alias("capture"))


def bootstrap_interval(docs: DataFrame, value: str, key: str, samples: int = 200, level: float = 0.95) -> DataFrame:
    """Percentile interval of a mean under Poisson(1) weights drawn by hash of (key, sample); a
    document is expanded to its weights, sums are folded in the map tasks."""
    u = (F.pmod(F.xxhash64(F.col(key), F.col("sample")), F.lit(1 << 40)) + 0.5) / (1 << 40)
    borders, p, total = [], 0.36787944117144233, 0.0
    for k in range(8):
        total += p
        borders.append(total)
        p /= k + 1
    weight = sum((F.when(u > b, 1).otherwise(0) for b in borders), F.lit(0))
    rows = docs.select(key, value, F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("sample")).withColumn("w", weight)
    means = rows.groupBy("sample").agg((F.sum(F.col("w") * F.col(value)) / F.sum("w")).alias("mean"))
    lo, hi = (1 - level) / 2, 1 - (1 - level) / 2
    place = F.row_number().over(Window.orderBy("mean"))  # one row for each sample
    ranked = means.withColumn("n", place)
    at = lambda q: F.max(F.when(F.col("n") == int(q * (samples - 1)) + 1, F.col("mean")))
    return ranked.agg(F.count("*").alias("samples"), F.round(at(lo), 6).alias("low"), F.round(at(hi), 6).alias("high"))


def gate_status(cases: DataFrame) -> DataFrame:
    """Of (metrics, passed) cases: how many pass for each metric, and whether all do."""
    rows = cases.select(F.explode("metrics").alias("metric"), "passed")
    out = rows.groupBy("metric").agg(F.count("*").alias("cases"), F.count_if("passed").alias("passed"))
    return out.withColumn("status", F.when(F.col("passed") == F.col("cases"), "pass").otherwise("fail"))


def sensitivity_losses(fixtures: DataFrame) -> DataFrame:
    """Of (missed, effort, sensitivity map<scenario, factor>): normalised loss, factor * missed +
    effort, summed for each scenario."""
    rows = fixtures.select("missed", "effort", F.explode("sensitivity").alias("scenario", "factor"))
    return rows.groupBy("scenario").agg(F.count("*").alias("fixtures"), F.round(F.sum(F.col("factor") * F.col("missed") + F.col("effort")), 6).alias("loss"))


def arm_scores(cases: DataFrame, arm: str, score: str) -> DataFrame:
    """Mean, mean of the positive and largest score of each arm."""
    positive = F.when(F.col(score) > 0, F.col(score))
    return cases.groupBy(arm).agg(F.count("*").alias("cases"), F.round(F.avg(score), 6).alias("mean"), F.round(F.avg(positive), 6).alias("mean_positive"), F.max(score).alias("most"))


def arm_extrema(values: DataFrame, arm: str = "arm", metric: str = "metric", value: str = "value") -> DataFrame:
    """Of each metric the arms with the largest and with the least value, ties together."""
    ends = values.groupBy(metric).agg(F.max(value).alias("most"), F.min(value).alias("least"))
    arms = lambda end: F.array_join(F.array_sort(F.collect_set(F.when(F.col(value) == F.col(end), F.col(arm)))), ",")
    return values.join(ends, metric).groupBy(metric).agg(F.first("most").alias("most"), arms("most").alias("best_arms"), F.first("least").alias("least"), arms("least").alias("worst_arms"))


def metric_bundle(findings: DataFrame, by: list[str], doc: str, top: tuple[int, int] = (1, 3)) -> DataFrame:
    """Of ranked findings (by, doc, rank, weight, exposed, supported): captured weight among the
    best one and three, share of exposed findings among them, share of findings without support."""
    first, few = (F.col("rank") <= k for k in top)
    share = lambda when, value: F.sum(F.when(when, F.col(value)).otherwise(0.0))
    docs = findings.groupBy(*by, doc).agg(
        share(first, "weight").alias("w1"), share(few, "weight").alias("w3"), F.sum("weight").alias("w"), F.count_if(few & F.col("exposed")).alias("e3"), F.count_if("exposed").alias("e"),
        F.count_if(~F.col("supported")).alias("u"), F.count("*").alias("n"),
    )
    part = lambda a, b: F.avg(F.when(F.col(b) > 0, F.col(a) / F.col(b)))
    return docs.groupBy(*by).agg(
        F.count("*").alias("docs"), F.round(part("w1", "w"), 6).alias("capture_1"), F.round(part("w3", "w"), 6).alias("capture_3"), F.round(part("e3", "e"), 6).alias("exposed_recall_3"),
        F.round(F.sum("u") / F.sum("n"), 6).alias("unsupported_rate"),
    )
